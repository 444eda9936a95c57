"""LM scoring by masked pseudo-likelihood.

A bidirectional window network, trained here in numpy, predicts each token of a document from the two
tokens on either side. The sum of the conditional log-probabilities, the pseudo-log-likelihood, is the
document's score.

Vocabulary. Words are hashed to ``BUCKETS`` buckets whose counts are taken over *all* documents. The most frequent ``OWN``
buckets are classes of their own, the others share the remaining classes. In each shared class the most frequent buckets, as
many as the corpus supports (``members``, by one rule for every size), are words of their own as input and as output; the rest of a class is one unit, in
which the corpus counts give P(bucket | unit). The network gives P(class | both sides) and P(unit | class, both sides).

Training is data-parallel, in rounds. A hash of id and text deals each document to a shard of about ``SHARD`` tokens, to one of
its ``ROUNDS`` slots and to a place in it, and rows equal in both are learnt once, so that the weights do not depend on how the input is partitioned. The network starts from the corpus frequencies of the
classes. In a round every shard starts from the same weights and AdaGrad state, visits the documents of one slot and predicts
each position; weights and state are then averaged by the number of positions.
A task takes several shards in turn, as many as there are for each of the cluster's cores, and adds up what they give; the sums leave it as blocks of ``BLOCK`` numbers, one row a block, which Spark adds by block. So what is
shuffled in a round grows with the cluster and the vocabulary, not with the corpus, and the driver receives one set of weights. Sums are of whole numbers, so no order of adding matters. ``passes`` repeats the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, byte_rows, checkpointed

BUCKETS = 1 << 18
CLASSES = 128
OWN = 88  # classes of a single bucket
DIM = 16
OFFSETS = (-2, -1, 1, 2)
SHARED = CLASSES - OWN
MEMBERS = 0.055  # words of their own in a shared class, times the corpus's tokens to the power 0.4
BLOCK = 128
BATCH = 4096  # positions of a step
SCORED = 16384  # positions scored at once
SHARD = 1 << 22  # tokens of a shard
ROUNDS = 8  # averages in a pass
TASKS = 2  # tasks for each core of the cluster, at most; each takes the shards that fall to it in turn
PASSES = 1
RATE = 0.08
GRAIN = 2.0**-20  # of weights that are averaged
LARGEST = 2.0**14  # of a weight or a sum of squares that is averaged, larger ones are cut; so the sums of ``HELD`` positions fit 64 bits
HELD = 1 << 27
HALF = 24  # bits of a sum's lower part


def shapes(m: int) -> tuple:
    """Shapes of the weights with ``m`` words of their own in a shared class: inputs by unit, classes, words of a class."""
    words = ((SHARED, DIM, m + 1), (SHARED, m + 1)) if m else ()
    return ((len(OFFSETS), CLASSES + 1 + SHARED * m, DIM), (DIM, CLASSES), (CLASSES,), *words)


def size(m: int) -> int:
    return sum(int(np.prod(s)) for s in shapes(m))


def class_of(m: int) -> np.ndarray:
    """Class of each unit: the classes (of a shared one the rest of it), the boundary mark, the words of the shared classes in turn."""
    return np.concatenate([np.arange(CLASSES + 1), OWN + np.arange(SHARED * m) % SHARED])


def members(n: np.ndarray, rate: float = MEMBERS) -> int:
    """Words of their own in a shared class: ``rate`` times the corpus's tokens to the power 0.4, at any size, as far as there are words that occur 20 times."""
    return min(int(rate * n.sum() ** 0.4), max(0, int((n >= 20).sum()) - OWN) // SHARED)


def _words(text: bytes | None) -> np.ndarray:
    """Bucket of every word."""
    words = (text or b"").translate(WORDS).split()
    return np.fromiter(map(crc32, words), np.uint32, len(words)) & np.uint32(BUCKETS - 1)


def hashed(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, deal, words): each row's id, a hash of id and text, and the bucket of every word as 32-bit numbers. Counting, learning and scoring all read these, so texts are cut into words once."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_rows(batches):
            yield pa.record_batch([*part.columns[:2], pa.array([_words(t).astype("<u4").tobytes() for t in texts], pa.binary())], names=["id", "deal", "words"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("deal"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(give, f"id {docs.schema[id_col].dataType.simpleString()}, deal long, words binary")


def _buckets(words: bytes) -> np.ndarray:
    return np.frombuffer(words, "<u4")


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): occurrences of each word bucket in all documents."""
    return counted(hashed(docs, text_col, text_col))


def counted(rows: DataFrame) -> DataFrame:
    """``corpus_counts`` of ``hashed`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, words in byte_rows(batches):
            total += np.bincount(_buckets(b"".join(words)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return rows.select("words").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def tally(counts: DataFrame) -> np.ndarray:
    """Occurrences of each bucket, from at most ``BUCKETS`` rows of counts."""
    n = np.zeros(BUCKETS)
    rows = counts.toArrow()
    n[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return n


def vocabulary(counts: DataFrame | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit of each bucket, log P(bucket | unit))."""
    n = counts if isinstance(counts, np.ndarray) else tally(counts)
    order = np.lexsort((np.arange(BUCKETS), -n))
    own = SHARED * members(n)
    kind = np.empty(BUCKETS, np.int16)
    kind[order[:OWN]] = np.arange(OWN)
    kind[order[OWN:]] = OWN + order[OWN:] % SHARED
    kind[order[OWN : OWN + own]] = CLASSES + 1 + np.arange(own)
    smooth = n + max(1e-6, min(0.5, n.sum() / (8 * BUCKETS)))
    whole = np.bincount(kind, weights=smooth, minlength=CLASSES)
    return kind, np.log(smooth / whole[kind]).astype(np.float32)


def _unpack(flat: np.ndarray, m: int = 0, first: int = 0) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes(m)[first:]:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def initial_weights() -> np.ndarray:
    rng = np.random.default_rng(20)
    return (rng.standard_normal(size(0)) * 0.1).astype(np.float32)


def from_frequencies(start: np.ndarray, kind: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``start`` with log frequencies added to its biases, and with weights for the words that ``kind`` has besides the classes."""
    m = max(0, int(kind.max()) - CLASSES) // SHARED
    units = np.bincount(kind, weights=n, minlength=CLASSES + 1 + SHARED * m) + 0.5
    flat = np.zeros(size(m), np.float32)
    new, old = _unpack(flat, m), _unpack(start)
    new[0][:] = np.random.default_rng(21).standard_normal(new[0].shape) * 0.1
    new[0][:, : CLASSES + 1] = old[0]
    whole = np.bincount(class_of(m), weights=units)[:CLASSES]
    new[1][:], new[2][:] = old[1], old[2] + np.log(whole / whole.sum())
    if m:
        new[4][:] = np.log(np.column_stack([units[CLASSES + 1 :].reshape(m, SHARED).T, units[OWN:CLASSES]]) / whole[OWN:, None])
    return flat


def _stream(texts: list, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of all tokens with two boundary marks about each document; places of the tokens; buckets."""
    own = [_words(t) for t in texts]
    return *_joined([kind[w] for w in own]), np.concatenate(own) if own else np.empty(0, np.uint32)


def _joined(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    edge = np.full(2, CLASSES, np.int16)
    parts = [edge]
    for units in own:
        parts += (units, edge)
    classes = np.concatenate(parts)
    return classes, np.flatnonzero(classes != CLASSES)


class _Net:
    def __init__(self, flat: np.ndarray, squares: np.ndarray | None = None) -> None:
        self.flat = flat.astype(np.float32).copy()
        self.m = 0 if len(flat) == size(0) else 1 + (len(flat) - size(1)) // (size(2) - size(1))
        self.inside, self.out, self.bias, *self.words = _unpack(self.flat, self.m)
        self.class_of = class_of(self.m)
        self.seen = 0
        self.squares = np.full(len(flat), 1e-3, np.float32) if squares is None else squares.astype(np.float32).copy()
        self.inside_squares = _unpack(self.squares, self.m)[0]
        self.grad = np.zeros(len(flat) - self.inside.size, np.float32)  # of all weights but the inputs
        self.g_out, self.g_bias, *self.g_words = _unpack(self.grad, self.m, 1)

    def shared(self, units: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of a shared class, places of its units, their members' numbers); the rest of a class is its last member."""
        if not self.m:
            return
        own = self.class_of[units] - OWN
        order = np.argsort(own.astype(np.int16), kind="stable")
        edges = np.searchsorted(own[order], np.arange(SHARED + 1))
        u = units[order].astype(np.int64)
        member = np.where(u < CLASSES, self.m, (u - CLASSES - 1) // SHARED)
        for c in range(SHARED):
            if edges[c] < edges[c + 1]:
                yield c, order[edges[c] : edges[c + 1]], member[edges[c] : edges[c + 1]]

    def hidden(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = self.inside[0][classes[at + OFFSETS[0]]]
        for table, o in zip(self.inside[1:], OFFSETS[1:], strict=True):
            h += table[classes[at + o]]
        return np.tanh(h, out=h)

    def log_probs(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = self.hidden(classes, at)
        got = _log_softmax(h @ self.out + self.bias, self.class_of[classes[at]])
        for c, rows, member in self.shared(classes[at]):
            got[rows] += _log_softmax(h[rows] @ self.words[0][c] + self.words[1][c], member)
        return got

    def learn(self, classes: np.ndarray, at: np.ndarray) -> None:
        """One AdaGrad step on the mean loss of some positions. Of the inputs only the rows that occur have a gradient."""
        h = self.hidden(classes, at)
        p = _softmax_grad(h @ self.out + self.bias, self.class_of[classes[at]], len(at))
        self.grad[:] = 0
        self.g_out[:] = h.T @ p
        self.g_bias[:] = np.ones(len(p), np.float32) @ p
        back = p @ self.out.T
        for c, rows, member in self.shared(classes[at]):
            own = h[rows]
            q = _softmax_grad(own @ self.words[0][c] + self.words[1][c], member, len(at))
            self.g_words[0][c] = own.T @ q
            self.g_words[1][c] = np.ones(len(q), np.float32) @ q
            back[rows] += q @ self.words[0][c].T
        back *= 1 - h * h
        for table, squares, o in zip(self.inside, self.inside_squares, OFFSETS, strict=True):
            units = classes[at + o]
            order = np.argsort(units, kind="stable")
            units = units[order]
            starts = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1])))
            g, own = np.add.reduceat(back[order], starts, axis=0), units[starts]
            squares[own] += g * g
            table[own] -= RATE * g / np.sqrt(squares[own])
        tail = len(self.flat) - len(self.grad)
        self.squares[tail:] += self.grad * self.grad
        self.flat[tail:] -= RATE * self.grad / np.sqrt(self.squares[tail:])
        self.seen += len(at)


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in place, and their sums by row; logits are kept where float32 has room for both."""
    np.exp(np.clip(logits, -60, 60, out=logits), out=logits)
    return logits, logits @ np.ones(logits.shape[1], np.float32)


def _log_softmax(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    got = logits[np.arange(len(own)), own]
    return got - np.log(_exp(logits)[1])


def _softmax_grad(logits: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    p, total = _exp(logits)
    p *= (1 / (total * n))[:, None]
    p[np.arange(len(own)), own] -= 1 / n
    return p


def shards(words: DataFrame, kind: np.ndarray, tokens: int, shard: int) -> DataFrame:
    """(units, shard, slot): the units of each of the ``hashed`` documents as 16-bit numbers, dealt to shards of about ``shard`` tokens, a partition each where Spark
    lets it; a partition may as well hold several whole shards or none.

    A hash of id and text says where a document goes and in which order a shard visits it, however the input is partitioned. Rows
    that agree in both are one: the first of a partition is sent, and where they meet in their shard the first is kept.
    """
    place = words.sparkSession.sparkContext.broadcast(kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for part, own in byte_rows(batches):
            deal = part.column(0).to_pylist()
            new = [i for i, d in enumerate(deal) if d not in met and not met.add(d)]
            yield pa.record_batch([pa.array([place.value[_buckets(own[i])].astype("<i2").tobytes() for i in new], pa.binary()), pa.array([deal[i] for i in new], pa.int64())], names=["units", "deal"])

    n = max(1, -(-tokens // shard))
    rows = words.select("deal", "words").mapInArrow(encode, "units binary, deal long").where("length(units) > 0")
    rows = checkpointed(rows.select("units", "deal", F.pmod("deal", F.lit(n)).alias("shard")))
    dealt = rows.repartitionByRange(n, "shard").sortWithinPartitions("shard", "deal").mapInArrow(once, "units binary, deal long, shard long")
    return checkpointed(dealt.select("units", "shard", F.pmod(F.shiftright("deal", 33), F.lit(ROUNDS)).alias("slot")))


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each deal, of rows that are sorted by it."""
    last = None
    for batch in batches:
        deal = batch.column(1).to_numpy()
        first = np.concatenate((deal[:1] != last, deal[1:] != deal[:-1])) if len(deal) else np.empty(0, bool)
        last = deal[-1] if len(deal) else last
        yield batch.filter(pa.array(first))


def of_shards(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[int, list[np.ndarray], bool]]:
    """(shard, units of up to ``rows`` documents, whether the shard ends) of sorted (units, shard) rows, whatever batches they come in."""
    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        for units, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (shard != now or len(held) == rows):
                yield now, held, shard != now
                held = []
            now = shard
            held.append(np.frombuffer(units, "<i2"))
    if held:
        yield now, held, True


def train(docs: DataFrame, kind: np.ndarray, start: np.ndarray, text_col: str = "text", n: np.ndarray | None = None, shard: int = SHARD, passes: int = PASSES, id_col: str = "doc_id", words: DataFrame | None = None) -> np.ndarray:
    """The weights after ``passes`` over all documents, averaged over the shards after each round. ``n``: the buckets' counts; ``words``: ``hashed`` documents, if there already.

    ``start`` goes through ``from_frequencies`` first. What shards add up are multiples of ``GRAIN`` times numbers of positions, as whole numbers, so that their sums are
    exact and the same in whatever order they are added.
    """
    words = hashed(docs, id_col, text_col) if words is None else words
    n = tally(counted(words)) if n is None else n
    tokens = int(n.sum())
    if not tokens:
        return start
    start = from_frequencies(start, kind, n)
    dealt, cut = shards(words, kind, tokens, shard), -(-len(start) // BLOCK) * BLOCK
    flat, squares = start, None

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total, seen = _Net(*shared.value), np.zeros(2 * cut, np.int64), 0
        for _, units, ends in of_shards(batches):
            classes, at = _joined(units)
            at = np.random.default_rng(len(at)).permutation(at)
            for i in range(0, len(at), BATCH):
                net.learn(classes, at[i : i + BATCH])
            if not ends:
                continue
            for k, own in enumerate((net.flat, net.squares)):
                total[k * cut : k * cut + len(start)] += np.rint(np.clip(own.astype(np.float64), -LARGEST, LARGEST) / GRAIN).astype(np.int64) * net.seen
            seen += net.seen
            if seen >= HELD:
                yield summed(total, seen)
                total[:], seen = 0, 0
            net = _Net(*shared.value)
        if seen:
            yield summed(total, seen)

    def summed(total: np.ndarray, seen: int) -> pa.RecordBatch:
        blocks = total.reshape(-1, BLOCK)
        cols = [pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(np.full(len(blocks), seen))]
        return pa.record_batch(cols + [pa.array(blocks[:, i].copy()) for i in range(BLOCK)], names=["block", "n", *names])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Means of the blocks of a partition: sums in two parts, each exact."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            every = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            parts = np.concatenate((every[:, :1], every[:, 1:] >> HALF, every[:, 1:] & ((1 << HALF) - 1)), axis=1)
            for block, own in zip(batch.column(0).to_pylist(), parts, strict=True):
                held[block] = held[block] + own if block in held else own
        if held:
            own = np.array(list(held.values()))
            mean = (own[:, 1 : BLOCK + 1] * 2.0**HALF + own[:, BLOCK + 1 :]) * GRAIN / own[:, :1]
            yield pa.record_batch([pa.array(list(held), pa.int32()), *(pa.array(mean[:, i].copy()) for i in range(BLOCK))], names=["block", *names])

    names = [f"v{i}" for i in range(BLOCK)]
    sent, means = "block int, n long, " + ", ".join(f"{v} long" for v in names), "block int, " + ", ".join(f"{v} double" for v in names)
    tasks = max(8, TASKS * docs.sparkSession.sparkContext.defaultParallelism)
    for turn in range(passes * ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((flat, squares))
        parts = dealt.where(F.col("slot") == turn % ROUNDS).select("units", "shard").coalesce(tasks).mapInArrow(fit, sent)
        rows = parts.repartition(tasks, "block").mapInArrow(merge, means).toArrow().sort_by("block")
        shared.unpersist()
        if rows.num_rows:
            mean = np.stack([rows.column(v).to_numpy() for v in names], axis=1)
            flat, squares = (part[: len(start)].astype(np.float32) for part in mean.reshape(2, cut))
    return np.round(flat, 5)


def score(docs: DataFrame, weights: np.ndarray, kind: np.ndarray, inside: np.ndarray, id_col: str = "doc_id", text_col: str = "text", words: DataFrame | None = None) -> DataFrame:
    """One row a document: id, n_tokens, pll (sum of log-probabilities), pll_mean (per token, null without tokens). ``words``: ``hashed`` documents, if there already."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _Net(weights)
        for part, own in byte_rows(batches, rows=256):
            buckets = _buckets(b"".join(own))
            classes, at = _joined([kind[_buckets(w)] for w in own])
            logs = np.empty(len(at) + 1)
            for i in range(0, len(at), SCORED):
                logs[i : i + SCORED][: len(at) - i] = net.log_probs(classes, at[i : i + SCORED])
            logs[: len(at)] += inside[buckets]
            edges = np.flatnonzero(classes == CLASSES)[1::2]  # the second mark before each document, and the last one
            n = np.diff(edges) - 2
            ends = np.cumsum(n)
            total = np.concatenate(([0.0], np.cumsum(logs[: len(at)])))
            sums = np.round(total[ends] - total[ends - n], 4)
            mean = [None if not k else float(s / k) for s, k in zip(sums, n, strict=True)]
            yield pa.record_batch([part.column(0), pa.array(n.astype(np.int64)), pa.array(sums), pa.array(mean, pa.float64())], names=[id_col, "n_tokens", "pll", "pll_mean"])

    kept = hashed(docs, id_col, text_col) if words is None else words
    return kept.select("id", "words").mapInArrow(give, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, pll double, pll_mean double")


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """Train on ``docs`` in ``passes`` over them and score each of them; a small corpus is learnt better in several.

    A null or empty text, or one without words, has n_tokens 0, pll 0 and a null pll_mean. Repeated rows are
    scored each; equal texts get equal scores, but for the last digit, which
    may follow the batch that a text is in. Long texts are learnt and scored whole. Over an empty table nothing is learnt and nothing returned. Other columns are not read.
    """
    words = checkpointed(hashed(docs, id_col, text_col))
    n = tally(counted(words))
    kind, inside = vocabulary(n)
    weights = train(docs, kind, initial_weights(), text_col, n, passes=passes, id_col=id_col, words=words)
    return score(docs, weights, kind, inside, id_col, text_col, words)
