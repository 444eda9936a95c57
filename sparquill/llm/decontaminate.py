"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: ``build_index`` packs documents into segments of bounded size and stores, for
every term of the documents, the sorted list of its positions in the segment. Terms are stored by 64-bit hashes, so no
dictionary is shared, and the index is built once whatever is asked of it. Segments are rows of a table in the shared
checkpoint folder: postings never cross the network, a lost executor costs re-reading a row, and a row's number is the same
for every block of questions.

``search`` takes each window of benchmark words to each segment: the list of the rarest term, shifted by the
term's offset, gives candidate places; the other terms' lists are intersected with them from rare to frequent.
With every term in its place the match is exact; with each within ``slop`` positions of its place, a proximity match
(so neighbours may be swapped, and a word left out or put in moves the others).

The benchmark is the query set. It is streamed to the driver in blocks of at most ``WINDOWS`` windows, each of
which is searched in all segments, so neither the driver nor a task holds more than one block of it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, byte_rows, checkpointed, fresh, row_key

WINDOW = 10
SLOP = 2
WINDOWS = 200_000  # windows of a block
SEGMENT = 1_000_000  # words of a segment, unless one document has more
GAP = WINDOW + 2 * SLOP + 2  # positions between documents: no match spans two
CANDIDATES = 1 << 20  # candidate places held at once


digest = xxhash.xxh64_intdigest


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Block:
    """Windows of some benchmark items: term numbers, rows of them, lengths, and the items of each window."""

    def __init__(self, windows: dict[tuple, set[str | None]]) -> None:
        self.terms: dict[bytes, int] = {}
        keys = sorted(windows)
        self.rows = np.full((len(keys), WINDOW), -1, np.int32)
        for i, key in enumerate(keys):
            self.rows[i, : len(key)] = [self.terms.setdefault(w, len(self.terms)) for w in key]
        self.hashes = np.array([digest(w) for w in self.terms], np.uint64)
        self.lengths = np.array([len(k) for k in keys], np.int32)
        names = sorted(set().union(*windows.values()) - {None})
        number = {x: i for i, x in enumerate(names)}
        self.names = np.array(names, object)
        self.items = [np.array(sorted(number[x] for x in windows[k] if x is not None), np.int32) for k in keys]


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int = WINDOWS) -> Iterator[Block]:
    windows: dict[tuple, set[str | None]] = {}
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        words = words_of(bytes(r.text))
        for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + WINDOW]), set()).add(r.item)
            if len(windows) >= most:
                yield Block(windows)
                windows = {}
    if windows:
        yield Block(windows)


def build_index(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Segments: ids and n_words of the documents, and as packed numbers their first positions (starts), the terms'
    hashes in order (terms), lengths of their lists (sizes) and the lists (positions)."""
    kind = docs.schema[id_col].dataType.simpleString()  # of one row's id; it may be a struct

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        lengths: list[int] = []
        numbers: list[np.ndarray] = []
        terms: dict[bytes, int] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            n = np.array(lengths, np.int64)
            starts = np.concatenate(([0], np.cumsum(n + GAP)[:-1])) + GAP
            every = np.concatenate(numbers)
            hashes = np.fromiter(map(digest, terms), np.uint64, len(terms))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            # place of each word: its number among all words, moved on by the gaps before its document
            place = np.arange(len(every)) + np.repeat(starts - (np.cumsum(n) - n), n)
            key = (rank[every] << 32) | place
            key.sort()
            sizes = np.bincount(every, minlength=len(terms))[order]
            packed = (starts.astype(np.int32), hashes[order], sizes.astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32))
            cols = [pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int32())), *(pa.array([x.tobytes()], pa.binary()) for x in packed)]
            return pa.record_batch(cols, names=["ids", "n_words", "starts", "terms", "sizes", "positions"])

        for part, texts in byte_rows(batches):
            id_type = part.column(0).type
            for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                words = words_of(text)
                ids.append(doc)
                lengths.append(len(words))
                for w in set(words).difference(terms):
                    terms[w] = len(terms)
                numbers.append(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)))
                held += len(words) + GAP
                if held >= SEGMENT:
                    yield flush()
                    ids, lengths, numbers, terms, held = [], [], [], {}, 0
        if ids:
            yield flush()

    kept = docs.select(id_col, F.col(text_col).cast("binary").alias("__text"))
    return kept.mapInArrow(give, f"ids array<{kind}>, n_words array<int>, starts binary, terms binary, sizes binary, positions binary")


def lists_of(hashes: np.ndarray, terms: np.ndarray, sizes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the asked-for terms that a segment has, lengths of their lists, the lists one after the other)."""
    at = np.searchsorted(terms, hashes)
    found = np.flatnonzero((at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == hashes)) if len(terms) else np.empty(0, np.int64)
    own = at[found]
    n = sizes[own].astype(np.int64)
    first = (np.cumsum(sizes, dtype=np.int64) - sizes)[own]
    where = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return found, n, positions[where]


def intersect(rows: np.ndarray, terms: np.ndarray, sizes: np.ndarray, positions: np.ndarray, n_terms: int, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, position of its first word, whether exact) of the matches in one segment."""
    count = np.zeros(n_terms + 1, np.int64)
    count[terms] = sizes
    first = np.zeros(n_terms + 1, np.int64)
    first[terms] = np.cumsum(sizes) - sizes
    keys = (np.repeat(terms.astype(np.int64), sizes) << 32) | positions
    there = count[rows]  # the pad, -1, is the last term: in no list
    there[rows < 0] = np.iinfo(np.int64).max
    order = np.argsort(there, axis=1, kind="stable")
    least = np.take_along_axis(there, order[:, :1], axis=1)[:, 0]
    alive = np.flatnonzero(least > 0)
    turns = np.cumsum(least[alive]) // CANDIDATES
    for own in np.split(alive, np.flatnonzero(np.diff(turns)) + 1):
        if not len(own):
            continue
        n = least[own]
        window = np.repeat(own, n)
        pivot = order[window, 0]
        within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        at = positions[first[rows[window, pivot]] + within].astype(np.int64) - pivot
        exact = np.ones(len(at), bool)
        for turn in range(1, rows.shape[1]):
            if not len(window):
                break
            place = order[window, turn]
            term = rows[window, place].astype(np.int64)
            wanted = (term << 32) + at + place
            i = np.searchsorted(keys, wanted - slop)
            over = term < 0
            near = over | ((i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= wanted + slop))
            if slop:
                i = np.searchsorted(keys, wanted)
            exact &= over | ((i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] == wanted))
            window, at, exact = window[near], at[near], exact[near]
        yield window, at, exact


def search(index: DataFrame, block: Block, id_col: str, slop: int = SLOP) -> DataFrame:
    """For each document: id, n_words, spans (hit runs of words, [from, to)), items with an exact match, near_items with a
    proximity match (the exact ones among them)."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(pickle.dumps(block))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Block = pickle.loads(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n_words = batch.column(0)[k].values, batch.column(1)[k].values
                starts, terms, sizes, positions = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64 if c == 3 else np.int32) for c in range(2, 6))
                terms, sizes, positions = lists_of(q.hashes, terms, sizes, positions)
                n = n_words.to_numpy()
                hit = np.zeros(int(starts[-1]) + int(n[-1]) + GAP + 1, np.int32)
                exact_of: dict[int, set] = {}
                near_of: dict[int, set] = {}
                for window, at, exact in intersect(q.rows, terms, sizes, positions, len(q.hashes), slop):
                    doc = np.searchsorted(starts, at + slop, "right") - 1
                    np.add.at(hit, at[exact], 1)
                    np.add.at(hit, at[exact] + q.lengths[window[exact]], -1)
                    for d, w, e in set(zip(doc.tolist(), window.tolist(), exact.tolist(), strict=True)):
                        near_of.setdefault(d, set()).update(q.items[w].tolist())
                        if e:
                            exact_of.setdefault(d, set()).update(q.items[w].tolist())
                edge = np.diff((np.cumsum(hit) > 0).astype(np.int8), prepend=0)
                opened, closed = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                whose = np.searchsorted(starts, opened, "right") - 1
                spans: list[list] = [[] for _ in range(len(n))]
                for d, a, b in zip(whose.tolist(), opened.tolist(), closed.tolist(), strict=True):
                    spans[d].append({"from": a - int(starts[d]), "to": b - int(starts[d])})
                names = lambda of: [sorted(q.names[list(of.get(d, ()))].tolist()) for d in range(len(n))]
                cols = [ids, pa.array(n.astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(names(exact_of), pa.list_(pa.string())), pa.array(names(near_of), pa.list_(pa.string()))]
                yield pa.record_batch(cols, names=[id_col, "n_words", "spans", "items", "near_items"])

    return index.mapInArrow(give, f"`{id_col}` {kind}, n_words long, spans array<struct<from:int,to:int>>, items array<string>, near_items array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", slop: int = SLOP, most: int = WINDOWS, *, key: tuple[str, ...] = ()) -> DataFrame:
    """``search`` of all blocks of the benchmark; one row for each row of ``docs``, with n_hit, the words in its spans. ``key``: columns to carry.

    Null and empty texts have no words; long ones are searched whole, in a segment of their own if need be. Benchmark rows without a
    text give no windows, those without an id give windows that are hit and name no item; an empty benchmark matches nothing, and no documents give no rows. Repeated rows of either table
    are kept as they are; a window that several items have is each one's, in whatever order. Other columns are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    row = F.struct(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(key)))
    index = checkpointed(build_index(docs.select(row.alias("row"), F.col(text_col).alias("text")), "row"))
    found, several = None, False
    for block in blocks(benchmark, most=most):
        own = search(index, block, "row", slop)
        several = found is not None
        found = own if found is None else found.unionByName(own.where("size(near_items) > 0 OR size(spans) > 0"))
    if found is None:
        found = search(index, Block({}), "row", slop)
    if several:
        joined = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")}
        found = found.groupBy("row").agg(F.max("n_words").alias("n_words"), *joined.values())
    reach = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["from"], a["end"]))).alias("n"), F.greatest(a["end"], s["to"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    named = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")]
    return found.select(*(F.col(f"row.k{i}").alias(k) for i, k in enumerate(key)), F.col("row.id").cast(kind).alias(id_col), "n_words", reach.alias("n_hit"), "spans", *named)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items."""
    return matches(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs.

    Rows are told by a hash of id and text, so it does not matter in which order a second read gives them, and rows that agree in both
    share their fate. Null and empty texts stay, as does everything where the benchmark is empty. All columns are kept, also such as are named
    like one of this function's own.
    """
    key = fresh(docs, "__k1", "__k2")
    hashed = docs.withColumns(dict(zip(key, row_key(id_col, text_col), strict=True)))
    bad = matches(hashed, benchmark, id_col, text_col, key=tuple(key)).where("n_hit > 0").select(*key).distinct()
    return hashed.join(checkpointed(bad), key, "left_anti").drop(*key)
