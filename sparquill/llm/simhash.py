"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most two bits apart share a value in their balls of radius one. Each *distinct*
fingerprint emits the 65 values of its ball; rows meet on the value. All fingerprints that meet on a value lie
in that value's ball, so at most 65 distinct ones do, however many documents share them: no group is large.
Each is linked to the smallest that it meets, the links are deduplicated and verified by their differing bits.
Links of a group form a star, which joins what all its pairs would join.

Components are found by alternating large-star and small-star steps, in which every shuffle is a partial
minimum or a join that Spark may split, with a checkpoint a round.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_rows, checkpointed, delete, fresh, row_key, shared_folder, slices, stored

SEED = 42
SHINGLE = 3
STAGE_SHINGLE = 5  # words of a shingle in the pipeline's stage
SIMILARITY = 0.8  # of two texts' shingles there, at least
SAMPLE = 3  # shingles of a sample
TABLES = 10  # samples; a pair of similarity 0.8 agrees in one with probability 1 - (1 - 0.8^3)^10 = 0.999
SKETCH = 64  # bytes of a text's sketch
LEEWAY = 0.18  # what a sketch may fall short of the similarity: over three standard errors
SMALL = 128  # nodes of a bucket that is compared at once
COUNTED = 20  # bits of the hashes by which shingles are counted, to have the rare ones first
WIDE = 8  # times ``SMALL``: nodes of a pair of blocks of a rare shingle, which are held against each other by their sketches
#: Odd multipliers that give each sample and each byte of a sketch its order.
MIXERS = np.random.default_rng(4).integers(0, 1 << 63, TABLES + 1 + SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included; one of all words where there are fewer, none without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)], np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text; 0 without words."""
    return simhash_of(shingle_hashes(text, shingle))


def simhash_of(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carried: list[str], text_col: str = "text") -> DataFrame:
    """The ``carried`` columns of each row and fp, its fingerprint as a signed long."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_rows(batches):
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([*part.columns[:-1], pa.array(fp)], names=[*carried, "fp"])

    kept = docs.select(*carried, F.col(text_col).cast("binary").alias("__text"))
    return kept.mapInArrow(give, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried) + ", fp long")


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v), u > v: verified links between distinct fingerprints ``fp`` that connect all within ``radius`` bits."""
    if radius not in (0, 1, 2):
        raise ValueError("balls of radius one reach two bits")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    values = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = values.withColumn("least", F.min("fp").over(Window.partitionBy("value")))
    links = met.where("fp > least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    if radius == 2:
        return links.where(close)
    # below two bits a star does not suffice: some members of a ball are two bits apart
    pairs = values.alias("a").join(values.alias("b"), (F.col("a.value") == F.col("b.value")) & (F.col("a.fp") > F.col("b.fp")))
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct().where(close)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. ``links``: (u, v) with u > v. Rounds, of which there are
    some twice the logarithm of the longest path, go on until nothing moves; a round's tables are deleted when the next one's are written."""
    spark = links.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    edges, turn = stored(links, f"{folder}/0/new"), 0
    while True:
        turn += 1
        # Large star: the larger end of a link moves to the least neighbour of the smaller end. A node may be the
        # smaller end of very many links; the other side of that join is a table of its own, so Spark can split it.
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: smaller neighbours, and the node itself, move to the least of them.
        large = stored(large, f"{folder}/{turn}/large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{folder}/{turn}/least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.union(least.select("u", "m")).distinct(), f"{folder}/{turn}/new")
        delete(spark, f"{folder}/{turn - 1}", f"{folder}/{turn}/large", f"{folder}/{turn}/least")
        # a forest of stars: no node that has a root is a root
        if not new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() and not (
            new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        ):
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = new


def component_of(fps: DataFrame, id_col: str, radius: int = 2) -> DataFrame:
    """(fp, component_id, root): the smallest id and fingerprint of each fingerprint's component. ``fps``: (id, fp)."""
    least = checkpointed(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(ball_links(least.select("fp"), radius))
    owned = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    owned = checkpointed(owned)
    smallest = checkpointed(owned.groupBy("root").agg(F.min("least").alias("component_id")))
    return owned.join(smallest, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows are kept; an empty table gives none. A
    null id is never the smallest of a component that has another. Long texts are hashed whole. Other columns are not read, whatever their names.
    """
    fps = checkpointed(fingerprints(docs, [id_col], text_col))
    named = component_of(fps, id_col, radius)
    return fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sample_fingerprints(hashes: np.ndarray, tables: int = TABLES, sample: int = SAMPLE) -> np.ndarray:
    """SimHashes of ``tables`` samples of a text's distinct shingles: each takes the ``sample`` smallest under an order of its own.

    Two texts of similarity J agree in a sample with probability J^sample about, and then in its fingerprint.
    """
    own = np.unique(hashes)
    out = np.zeros(tables, np.uint64)
    for t in range(tables):
        order = own * MIXERS[t]
        order ^= order >> np.uint64(31)
        order *= MIXERS[t + 1]
        few = own[np.argpartition(order, sample - 1)[:sample]] if len(own) > sample else own
        bits = np.unpackbits(few.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        out[t] = np.packbits(bits * 2 > len(few), bitorder="little").view(np.uint64)[0]
    return out


def min_hashes(hashes: np.ndarray, n: int = SKETCH) -> bytes:
    """One byte of each of ``n`` min-hashes of a text's distinct shingles: two texts agree in a share of them that is their similarity, about."""
    own = np.unique(hashes)
    if not len(own):
        return bytes(n)
    out = np.empty(n, np.uint64)
    for i in range(n):
        order = own * MIXERS[TABLES + 1 + i]
        out[i] = (order ^ (order >> np.uint64(32))).min()
    return ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def sample_links(buckets: DataFrame) -> DataFrame:
    """(u, v), u > v: each node with the smallest of every bucket that it is in. ``buckets``: (key, node)."""
    least = buckets.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    return buckets.select("key", "node").join(least, "key").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def fingerprint_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v), u > v: links that join all nodes whose fingerprints are within ``radius`` bits: each node with the smallest of its fingerprint, and of two fingerprints that meet in a
    ball the smallest nodes. ``nodes``: (node, fp)."""
    least = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    own = nodes.join(least.where("n > 1").select("fp", "least"), "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}"))
    met = ball_links(least.select("fp"), radius).join(of("u"), "u").join(of("v"), "v")
    return own.union(met.select(F.greatest("of_u", "of_v"), F.least("of_u", "of_v")))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets of shingles, each without repeats; empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def measured(links: DataFrame, shingled: DataFrame) -> DataFrame:
    """The ``links`` (u, v) with the similarity of their texts' sets of shingles, counted exactly. ``shingled``: (node, shingles)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            found = []
            for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                found.append(jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
            yield pa.record_batch([*part.columns[:2], pa.array(found, pa.float64())], names=["u", "v", "j"])

    side = lambda k: shingled.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}"))
    return links.join(side("u"), "u").join(side("v"), "v").select("u", "v", "of_u", "of_v").mapInArrow(count, "u long, v long, j double")


def likely_members(buckets: DataFrame, least: float, similarity: float = SIMILARITY) -> DataFrame:
    """(key, node): of small buckets (key, node, root, sketch) the nodes that have another of a different component there whose sketch agrees in a share of ``least``. Where the key is a shingle
    and ``size`` and ``rest`` are there, as from ``rare_shingles``, also enough shingles must be left from it on: at the first shingle that two texts of that similarity share there are."""
    known = ["node", "root", "sketch", *(c for c in ("size", "rest") if c in buckets.columns)]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8):
            keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for key, rows in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                node, root = (np.array([m[c] for m in rows], np.int64) for c in ("node", "root"))
                sketch = np.frombuffer(b"".join(m["sketch"] for m in rows), np.uint8).reshape(len(rows), -1)
                size, rest = (np.array([m[c] for m in rows], np.int64) for c in ("size", "rest")) if sized else (None, None)
                met = np.zeros(len(rows), bool)
                for i in range(1, len(rows)):
                    fits = root[:i] != root[i]
                    if sized:
                        fits &= np.minimum(rest[:i], rest[i]) >= similarity / (1 + similarity) * (size[:i] + size[i]) - 1e-9
                    if fits.any():
                        at = np.flatnonzero(fits)
                        fits[at] = (sketch[at] == sketch[i]).mean(axis=1) >= least
                    met[:i] |= fits
                    met[i] |= fits.any()
                nodes.append(node[met])
                keys.append(np.full(len(nodes[-1]), key, np.int64))
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    sized = "rest" in known
    gathered = buckets.groupBy("key").agg(F.collect_list(F.struct(*known)).alias("members"))
    return gathered.mapInArrow(members, "key long, node long")


def likely_links(buckets: DataFrame, least: float) -> DataFrame:
    """(u, v), u > v: links that join, bucket by bucket, all pairs of small buckets (key, node, root, sketch, shingles) whose similarity is ``least``. Pairs whose sketches allow it are
    counted exactly, in order of node, but for those that are joined already, so a bucket gives a link less than it has components, at most, however many pairs it has."""

    def settled(members: list[tuple]) -> Iterator[tuple[int, int]]:
        node, root, sketches, shingles = zip(*members, strict=True)
        of, sketch = np.unique(np.array(root, np.int64), return_inverse=True)[1], np.frombuffer(b"".join(sketches), np.uint8).reshape(len(node), -1)
        sets = [np.frombuffer(b, np.uint64) for b in shingles]
        for i in range(1, len(node)):
            for k in np.flatnonzero((of[:i] != of[i]) & ((sketch[:i] == sketch[i]).mean(axis=1) >= least - LEEWAY)):
                if of[k] != of[i] and jaccard(sets[k], sets[i]) >= least - 1e-9:
                    of[of == of[k]] = of[i]
                    yield max(node[k], node[i]), min(node[k], node[i])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # a bucket may go on in the next batch
        for part in itertools.chain(slices(batches, 256), [None]):
            found = []
            for own, *row in zip(*(c.to_pylist() for c in part.columns), strict=True) if part is not None else [(None,)]:
                if own != key or part is None:
                    found += settled(held) if held else []
                    key, held = own, []
                held.append(tuple(row))
            yield pa.record_batch([pa.array([p[c] for p in found], pa.int64()) for c in (0, 1)], names=["u", "v"])

    rows = buckets.select("key", "node", "root", "sketch", "shingles").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(join, "u long, v long").distinct()


def rare_shingles(shingled: DataFrame, similarity: float) -> DataFrame:
    """(key, node, size, rest): the shingles by which similar texts are sure to meet. In any order common to all texts, two of that similarity share one of the first
    n - ceil(similarity * n) + 1 of each one's n shingles; here the rarest come first, by counts of 2^``COUNTED`` buckets that shingles are hashed to, to which a task adds what it has met twice, ties by their hash. The counts only say which order it is. ``rest``: how many
    shingles a text has from this one on. ``shingled``: (node, shingles)."""
    bucket = lambda own: (own.view(np.uint64) >> np.uint64(64 - COUNTED)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTED, np.int64)
        for part in slices(batches, 256):
            total += np.bincount(bucket(np.frombuffer(b"".join(part.column(0).to_pylist()), np.int64)), minlength=1 << COUNTED)
        at = np.flatnonzero(total > 1)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = shingled.select("shingles").coalesce(max(8, shingled.sparkSession.sparkContext.defaultParallelism)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    texts = np.zeros(1 << COUNTED, np.int64)
    texts[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    given = shingled.sparkSession.sparkContext.broadcast(texts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            rows = [np.empty((4, 0), np.int64)]
            for node, shingles in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = np.frombuffer(shingles, np.int64)
                n = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
                order = np.lexsort((own, given.value[bucket(own)]))[:n]
                rows.append(np.stack([own[order], np.full(n, node), np.full(n, len(own)), len(own) - np.arange(n)]))
            yield pa.record_batch([pa.array(c) for c in np.concatenate(rows, axis=1)], names=["key", "node", "size", "rest"])

    return shingled.select("node", "shingles").mapInArrow(first, "key long, node long, size long, rest long")


def mixed_buckets(buckets: DataFrame) -> DataFrame:
    """(key, n, most, others): of the buckets (key, root) that have several components the number of nodes, the component of most nodes, and the number of nodes of others."""
    each = buckets.groupBy("key", "root").agg(F.count("*").alias("n"))
    whole = each.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    return whole.select("key", "n", F.col("most.root").alias("most"), (F.col("n") - F.col("most.n")).alias("others"))


def cut_to_blocks(buckets: DataFrame, small: int) -> DataFrame:
    """Buckets (key, node, root, ..., n, most, others) in which all pairs of different components of larger ones meet: one of more than ``small`` nodes is cut, by a hash, into blocks of half of that, about,
    and any two of its blocks make a bucket, but for two of the component of most nodes. So nodes are copied as often as there are blocks of the other components, not of the bucket."""
    apart = F.col("root") == F.col("most")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n * 2 / small)).cast("int")
    of_most, of_others = blocks(F.col("n") - F.col("others")), blocks(F.col("others"))
    own = F.pmod(F.xxhash64("node"), F.when(apart, of_most).otherwise(of_others)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    name = lambda kind, i, j: F.xxhash64("key", F.lit(kind), i, j)
    among = F.concat(F.transform(upto(of_most), lambda j: name(0, F.col("own"), j)), F.transform(upto(of_others), lambda j: name(1, F.least("own", j), F.greatest("own", j))))
    keys = F.when(F.col("n") <= small, F.array("key")).when(apart, F.transform(upto(of_others), lambda i: name(0, i, F.col("own")))).otherwise(among)
    return buckets.withColumn("own", own).withColumn("key", F.explode(keys)).drop("own", "n", "most", "others")


def bucket_links(nodes: DataFrame, links: DataFrame, shingled: DataFrame, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """(node, root): the components of all pairs of that similarity that share a bucket or are linked by their fingerprints. ``nodes``: (node, samples, sketch); ``links``: those of
    the fingerprints; a bucket has the nodes
    that agree in one of their samples.

    At first the links of the fingerprints' balls are counted, and every node is held against the smallest of its buckets, which joins most copies. What is left are buckets with several components. In those of up to
    ``small`` nodes every pair of different components whose sketches allow it is counted, unless others have joined it, and only the links that join leave a bucket. The nodes of larger ones, whose samples come from
    passages that many texts have, meet again by their rarest shingles, of which two similar texts share one for sure; so no pair of a large bucket is lost. A node has a fifth of its shingles there and one row for each, however
    many buckets it was in. Where even a rare shingle has many nodes of several components, its bucket is taken in pairs of blocks.
    """
    spark = nodes.sparkSession
    folder = f"{shared_folder(spark)}/links-{uuid.uuid4().hex}"
    buckets = nodes.select("node", "sketch", F.posexplode("samples").alias("t", "value")).select(F.xxhash64("t", "value").alias("key"), "node", "sketch")
    alike = F.col("j") >= similarity - 1e-9
    first = sample_links(buckets).union(links).distinct()
    roots = components(measured(stored(first, f"{folder}/star"), shingled).where(alike).select("u", "v"))

    def live(rows: DataFrame, name: str) -> DataFrame:
        """The rows of the buckets that have several components by now."""
        of = roots.select(F.col("node").alias("of"), "root")
        placed = rows.join(of, F.col("node") == F.col("of"), "left").select(*rows.columns, F.coalesce("root", "node").alias("root"))
        return stored(placed.join(mixed_buckets(placed), "key"), f"{folder}/{name}")

    def joined(few: DataFrame, name: str) -> DataFrame:
        """The components with what the small buckets (key, node, root, sketch) join."""
        likely = stored(few.join(likely_members(few, similarity - LEEWAY, similarity), ["key", "node"]), f"{folder}/likely-{name}")
        found = stored(likely_links(likely.join(shingled, "node"), similarity), f"{folder}/found-{name}")
        return roots if found.isEmpty() else components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found))

    of_samples = live(buckets, "samples")
    n_small, n_large = of_samples.agg(F.count_if(F.col("n") <= small), F.count_if(F.col("n") > small)).first()
    if n_small:
        roots = joined(of_samples.where(F.col("n") <= small).select("key", "node", "root", "sketch"), "samples")
    if n_large:
        crowd = stored(of_samples.where(F.col("n") > small).select("node", "sketch").dropDuplicates(["node"]), f"{folder}/crowd")
        met = checkpointed(rare_shingles(shingled.join(crowd.select("node"), "node", "left_semi"), similarity)).join(crowd, "node")
        of_shingles = stored(cut_to_blocks(live(met, "shingles"), WIDE * small), f"{folder}/blocks")
        roots = joined(of_shingles, "shingles")
    return roots


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """``docs`` with one row of each group of texts of which each is similar to another: that of the smallest id, null ids last.

    Texts are similar if their sets of word shingles are, A-Z lower-cased, by Jaccard's measure. Candidates are first the texts whose SimHashes meet in a ball of radius one, as in
    ``near_duplicates``. Two bits of one fingerprint reach only a few of the similar
    pairs (at a similarity of 0.8 a tenth of the bits differ), so candidates are also those that share one of ``TABLES`` fingerprints more, each the SimHash of a
    sample of the shingles; ``bucket_links`` takes up all pairs that meet, and the shingles decide. Texts without words are one
    group, texts of fewer words than a shingle have one shingle. Long texts are compared whole, equal texts are one text throughout, so copies make
    no large group. Rows are told by a hash of id and text, so it does not matter in which order a second read gives
    them; of rows that agree in both any one stays. An empty table stays empty. All columns are kept, also such as are named like one of
    this function's own.
    """
    key = fresh(docs, "__k1", "__k2")
    hashed = docs.withColumns(dict(zip(key, row_key(id_col, text_col), strict=True)))
    kind = docs.schema[id_col].dataType.simpleString()
    plain = hashed.select(F.col(key[0]).alias("k1"), F.col(key[1]).alias("k2"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_rows(batches):
            node = [xxhash.xxh3_64_intdigest(b" ".join((t or b"").translate(LOWER).split())) - (1 << 63) for t in texts]
            every = [shingle_hashes(t, shingle) for t in texts]
            fps = np.array([simhash_of(h) for h in every], np.uint64).view(np.int64)
            hashes = [np.unique(h) for h in every]
            samples, sketches = [sample_fingerprints(h).view(np.int64) for h in hashes], [min_hashes(h) for h in hashes]
            yield pa.record_batch([*part.columns[:3], pa.array(node, pa.int64()), pa.array(fps), pa.array(samples, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["k1", "k2", "id", "node", "fp", "samples", "sketch"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_rows(batches):
            yield pa.record_batch([part.column(0), pa.array([np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts], pa.binary())], names=["node", "shingles"])

    rows = checkpointed(plain.mapInArrow(sketch, f"k1 long, k2 long, id {kind}, node long, fp long, samples array<long>, sketch binary"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    nodes = checkpointed(rows.groupBy("node").agg(F.min(order).alias("first"), F.min("fp").alias("fp"), F.min("samples").alias("samples"), F.min("sketch").alias("sketch")))
    spread = nodes.select("node", F.posexplode("samples").alias("t", "value"))
    met = spread.join(spread.groupBy("t", "value").agg(F.count("*").alias("n")).where("n > 1"), ["t", "value"]).select("node")
    links = checkpointed(fingerprint_links(nodes.select("node", "fp")))
    met = met.union(links.select("u")).union(links.select("v")).distinct()
    wanted = nodes.join(met, "node", "left_semi").select("node", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    shingled = plain.join(wanted, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]).mapInArrow(shingles, "node long, shingles binary")
    roots = bucket_links(nodes.select("node", "samples", "sketch"), links, checkpointed(shingled), similarity, small)
    owned = nodes.select(F.col("node").alias("own"), "first").join(roots, F.col("own") == F.col("node"), "left").select(F.coalesce("root", "own").alias("root"), "first")
    chosen = owned.groupBy("root").agg(F.min("first").alias("best")).select("best.k1", "best.k2")
    chosen = checkpointed(rows.groupBy("k1", "k2").agg(F.count("*").alias("copies")).join(chosen, ["k1", "k2"]))
    (copies,) = fresh(docs, "__copies")
    kept = hashed.join(chosen.select(F.col("k1").alias(key[0]), F.col("k2").alias(key[1]), F.col("copies").alias(copies)), key)  # one row a key: the text is shuffled once
    return kept.where(F.col(copies) == 1).unionByName(kept.where(F.col(copies) > 1).dropDuplicates(key)).select(*docs.columns)
