"""Best-fit decreasing packing of token sequences.

Sizes are whole numbers from 1 to the capacity, so the global best-fit-decreasing packing of any number of
pieces is fixed by how many pieces there are of each size: at most ``capacity`` counts, whatever the input. The
driver packs those counts. Open bins are held as runs of consecutive bin numbers with equal fill, filed by
remaining capacity; a segment tree over the capacities finds the tightest that has an open bin in logarithmic
time, and a whole run of bins takes its pieces in one step. A run is cut at most once for each size, so there are
at most about twice ``capacity`` runs and the resulting plan has a bounded number of rows.

Each piece then takes the place that the plan has for the rank of it among the pieces of its size. Ranks come
from counts by task and size, added up over the tasks, so no task ever holds all pieces of a size.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import count, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, checkpointed

CAPACITY = 4096
END = 1  # the id after each document
KNOWN = 350_000  # cached words of a worker
SHORT = 48  # bytes of the longest cached word
BEYOND = bytes(range(0xC4, 0x100))  # bytes of UTF-8 from U+0100 on


class Capacities:
    """Segment tree over the remaining capacities 0..n: which of them have an open bin."""

    def __init__(self, n: int) -> None:
        self.width = 1 << n.bit_length()
        self.some = bytearray(2 * self.width)

    def mark(self, at: int, there: bool) -> None:
        i = at + self.width
        self.some[i] = there
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity of ``least`` or more."""
        i = least + self.width
        if self.some[i]:
            return least
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank + 1, first bin, offset): pieces of a size with these ranks go to consecutive bins."""
    tree = Capacities(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}  # by remaining capacity: (first bin, bins)
    out, bins = [], 0

    def file(room: int, run: tuple[int, int]) -> None:
        if room:
            runs.setdefault(room, []).append(run)
            tree.mark(room, True)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                room, start, n = capacity, bins, left
            else:
                start, n = runs[room].pop()
            # a bin that has taken a piece is the tightest for the next one of this size, until none fits
            each = min(room // size, left)
            used = min(n, left // each)
            if start == bins:
                bins += used
            elif n > used:
                runs[room].append((start + used, n - used))
            elif not runs[room]:
                tree.mark(room, False)
            for k in range(each):
                out.append((size, rank, rank + used, start, capacity - room + k * size))
                rank += used
            left -= each * used
            file(room - each * size, (start, used))
    return out


#: Words of ASCII and Latin-1 letters: the tokenizer's normaliser changes nothing in them but case.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The tokenizer's own cut of a word, for such words.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Bytes that byte-level vocabularies show as letters from U+0100 on, in order, as they are no visible Latin-1 letters.
UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SHOWN = {b: 256 + i for i, b in enumerate(UNSEEN)}


class _Ids:
    """Token ids of texts, word by word: white space parts words, and no token spans it.

    Words seen before are looked up: known has the number of each, and the ids of number i are those of flat from
    starts[i] to starts[i + 1]. Plain words are cut here, and the new parts of a text go to the tokenizer's model in one
    call, which ends each part with a token that ends words. Others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        self.bare = Tokenizer(model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(model.end_of_word_suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.long: list[bytes] = []
        self.flat, self.starts = array("i"), array("q", [0])

    @staticmethod
    def lowered(text: bytes) -> bytes:
        """The text with A-Z lower-cased where that cannot change its ids: without letters beyond Latin-1, which might join an
        accent to a small letter only, and without marks of special tokens."""
        return text if b"<|" in text or len(text.translate(None, BEYOND)) < len(text) else text.lower()

    @staticmethod
    def cut(word: bytes) -> list[bytes]:
        """The parts of a plain word as the tokenizer cuts it; none for others."""
        text = word.decode("utf-8", "replace")
        plain = PLAIN.fullmatch(text) and "<|" not in text
        return [p.encode() for p in PARTS.findall(text.lower())] if plain else []

    def add(self, words: set[bytes]) -> None:
        """Give new words their numbers and ids."""
        known, flat, starts = self.known, self.flat, self.starts
        new: dict[bytes, None] = {}
        several: list[tuple[bytes, list[bytes]]] = []
        for word in words:
            if word.isalpha():
                low = word.lower()
                parts = [low]
            elif word[:-1].isalpha() and word[-1] in b".,;:!?":  # as the cut would have it
                low = word[:-1].lower()
                parts = [low, word[-1:]]
            else:
                low = None
                parts = self.cut(word)
            for part in parts:
                if part not in known:
                    new[part] = None
            if low != word and parts != [word]:
                several.append((word, parts))
        if new:
            shown = " ".join([p.decode() if p.isascii() else p.decode("latin-1").translate(SHOWN) for p in new])
            ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(new):
                raise ValueError("the model did not end each part once")
            known.update(zip(new, count(len(starts) - 1), strict=False))
            starts.frombytes((len(flat) + ends).astype(np.int64).tobytes())
            flat.frombytes(ids.tobytes())
        for word, parts in several:
            if len(parts) == 1:
                known[word] = known[parts[0]]
                continue
            for part in parts:
                i = known[part]
                flat.extend(flat[starts[i] : starts[i + 1]])
            if not parts:
                flat.extend(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
            known[word] = len(starts) - 1
            starts.append(len(flat))
        self.long += [w for own in (new, words) for w in own if len(w) > SHORT]

    def of(self, texts: list) -> list[np.ndarray]:
        """The ids of each text, and the end's id."""
        if len(self.known) > KNOWN or len(self.flat) > 8 * KNOWN:
            self.clear()
        known, flat, starts = self.known, self.flat, self.starts
        get = known.get
        numbers, sizes = [], []
        for text in texts:
            words = self.lowered(text or b"").split()
            own = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            if len(missing := np.flatnonzero(own < 0)):
                unseen = [words[i] for i in missing.tolist()]
                self.add(set(unseen))
                own[missing] = [known[word] for word in unseen]
            numbers.append(own)
            sizes.append(len(own))
        ids, edge = np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32), np.frombuffer(starts, np.int64)
        every = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        n = edge[every + 1] - edge[every]
        ends = np.cumsum(n)
        place = np.arange(int(n.sum())) + np.repeat(edge[every] - (ends - n), n)
        joined = ids[place]
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        out = [np.append(joined[a:b], np.int32(END)) for a, b in zip(at, at[1:], strict=False)]
        del ids, edge  # the arrays may grow again
        for word in self.long:  # their ids stay in flat until the next clearing, but the keys would hold whole texts
            known.pop(word, None)
        self.long.clear()
        return out


_cached: dict[str, _Ids] = {}


def pieces(docs: DataFrame, tokenizer: str, carried: list[str], text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each row: the ``carried`` columns, piece, start, length, ids_crc32, and where it was made: task, and
    number among this task's pieces of this length (nth)."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _cached.setdefault(tokenizer, None) or _Ids(tokenizer)
        _cached[tokenizer] = coder
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for part, texts in byte_rows(batches, rows=256):
            rows: list[tuple] = []
            whose: list[int] = []
            for row, ids in enumerate(coder.of(texts)):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    nth = seen.get(len(own), 0)
                    seen[len(own)] = nth + 1
                    whose.append(row)
                    rows.append((k, at, len(own), crc32(own.astype("<u4").tobytes()), nth))
            taken = part.take(pa.array(whose, pa.int32()))
            k, at, n, crc, nth = zip(*rows, strict=True)
            cols = [pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(n), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.record_batch([*taken.columns[:-1], *cols], names=[*carried, "piece", "start", "length", "ids_crc32", "__task", "__nth"])

    kept = docs.select(*carried, F.col(text_col).cast("binary").alias("__text"))
    own = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)
    return kept.mapInArrow(give, own + "piece int, start long, length long, ids_crc32 long, __task int, __nth long")


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (of ``pieces``) with sequence_id and offset in place of the columns on where it was made."""
    made = checkpointed(made)
    spark = made.sparkSession
    by_task = made.groupBy("__task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    base = checkpointed(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r.length: r.n for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    steps = plan(counts, capacity)
    length, first, last, bin0, offset = (np.array(x, np.int64) for x in zip(*steps, strict=True)) if steps else [np.empty(0, np.int64)] * 5
    order = np.lexsort((first, length))
    shared = spark.sparkContext.broadcast([x[order] for x in (length, first, bin0, offset)])
    names = [c for c in made.columns if c not in ("__task", "__nth")]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, bin0, offset = shared.value
        edge = np.searchsorted(length, np.arange(capacity + 2))
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for size in np.unique(n):
                own = n == size
                lo, hi = edge[size], edge[size + 1]
                at[own] = lo + np.searchsorted(first[lo:hi], rank[own], "right") - 1
            cols = [b.column(c) for c in names]
            yield pa.record_batch([*cols, pa.array(bin0[at] + rank - first[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    ranked = made.join(base.select("__task", "length", "base"), ["__task", "length"]).select(*names, (F.col("base") + F.col("__nth")).alias("__rank"))
    own = "".join(f"`{c}` {made.schema[c].dataType.simpleString()}, " for c in names)
    return ranked.mapInArrow(give, own + "sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, carried: list[str], text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs`` into sequences of at most ``capacity`` tokens: one row a piece.

    A text's ids are followed by id 1, so a null or empty text is a piece of one token. Texts over the capacity are
    cut into full pieces and a last one. Repeated rows are packed each. An empty table gives no rows. Columns that
    are not ``carried`` are not read, whatever their names.
    """
    return pack(pieces(docs, tokenizer, carried, text_col, capacity), capacity)
