"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairs summed in linear time as
half of |sum_i v_i x_i|^2 - sum_i |v_i x_i|^2.

It is fitted in numpy on a bounded sample of the labelled rows outside the held-out fold (``SAMPLE``, those of the
smallest hashes of their ids) and scores every whole text. Neither labels nor lang, source or the id are inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, byte_rows, fresh

WORDS_HASHED = 1 << 13
RANK = 8
SAMPLE = 12_000  # labelled rows to fit on, at most
EPOCHS = 12
THRESHOLD = 0.3
LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
UPPER = np.array([65 <= b <= 90 for b in range(256)])
DIGITS = np.array([48 <= b <= 57 for b in range(256)])
SPACE = np.array([b in b" \t\n\r\v\f" for b in range(256)])
MARKS = b"!|#*$%&.,?{}<=:@/\"'()-;"
STATS = 16 + len(MARKS)
SIZE = WORDS_HASHED + STATS


def statistics(text: bytes, words: list[bytes]) -> list[float]:
    """Figures on the structure of a text."""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, k = max(1, len(text)), max(1, len(words))
    letters = max(1, int(n[LETTERS].sum()))
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    distinct = len(set(words))
    pairs = set(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    return [
        np.log1p(len(words)) / 8,
        np.log1p(len(text)) / 10,
        n[LETTERS].sum() / size,
        n[UPPER].sum() / letters,
        n[DIGITS].sum() / size,
        n[SPACE].sum() / size,
        1 - (n[LETTERS].sum() + n[DIGITS].sum() + n[SPACE].sum()) / size,
        lengths.mean() / 10,
        lengths.std() / 10,
        distinct / k,
        len(pairs) / max(1, len(words) - 1),
        len(set(full)) / max(1, len(full)),
        np.log1p(len(full)) / 5,
        len(words) / max(1, len(full)) / 50,
        sum(n[b] for b in range(32) if b not in (9, 10, 13)) / size,
        min(1.0, len(words) / 20),
        *(n[list(MARKS)] / size * 10),
    ]


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the features of some texts: damped word shares of unit length, then statistics."""
    rows, cols, values = [], [], []
    stats = np.arange(WORDS_HASHED, SIZE)
    for i, text in enumerate(texts):
        text = text or b""
        words = text.translate(WORDS).split()
        if words:
            own, n = np.unique(np.fromiter(map(crc32, words), np.uint32, len(words)) % WORDS_HASHED, return_counts=True)
            x = np.log1p(n)
            rows.append(np.full(len(own), i))
            cols.append(own)
            values.append(x / np.sqrt((x * x).sum()))
        rows.append(np.full(STATS, i))
        cols.append(stats)
        values.append(np.nan_to_num(statistics(text, words)))
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(rows), np.concatenate(cols).astype(np.int64), np.concatenate(values)


def standard(cols: np.ndarray, values: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Values with the statistics centred and scaled as the model's sample has them."""
    out = values.copy()
    own = cols >= WORDS_HASHED
    at = cols[own] - WORDS_HASHED
    out[own] = np.clip((values[own] - mean[at]) / spread[at], -4, 4)
    return out


def raw_score(model: dict, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The factorisation machine's sum for each of n rows."""
    x = standard(cols, values, model["mean"], model["spread"])
    vx = model["v"][cols] * x[:, None]
    total = np.stack([np.bincount(rows, vx[:, f], n) for f in range(RANK)], axis=1)
    return model["b"] + np.bincount(rows, model["w"][cols] * x, n) + 0.5 * ((total**2).sum(axis=1) - np.bincount(rows, (vx**2).sum(axis=1), n))


def fit(texts_features: list[tuple], labels: np.ndarray) -> dict:
    """Fit by AdaGrad on the logistic loss. ``texts_features``: (columns, values) of each row."""
    rng = np.random.default_rng(8)
    stats = np.array([v[-STATS:] for _, v in texts_features], np.float64) if texts_features else np.zeros((1, STATS))
    model = {"b": 0.0, "w": np.zeros(SIZE), "v": rng.standard_normal((SIZE, RANK)) * 0.02, "mean": stats.mean(axis=0), "spread": stats.std(axis=0) + 1e-3}
    squares = {"b": 1e-8, "w": np.full(SIZE, 1e-8), "v": np.full((SIZE, RANK), 1e-8)}
    if not len(labels):
        return model
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), 128):
            own = order[i : i + 128]
            rows = np.repeat(np.arange(len(own)), [len(texts_features[k][0]) for k in own])
            cols = np.concatenate([texts_features[k][0] for k in own]).astype(np.int64)
            x = standard(cols, np.concatenate([texts_features[k][1] for k in own]).astype(np.float64), model["mean"], model["spread"])
            v = model["v"][cols]
            vx = v * x[:, None]
            total = np.stack([np.bincount(rows, vx[:, f], len(own)) for f in range(RANK)], axis=1)
            z = model["b"] + np.bincount(rows, model["w"][cols] * x, len(own)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(rows, (vx**2).sum(axis=1), len(own)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            gx = g[rows] * x
            grads = {"b": g.sum(), "w": np.bincount(cols, gx, SIZE) + 1e-5 * model["w"]}
            gv = gx[:, None] * (total[rows] - vx)
            grads["v"] = np.stack([np.bincount(cols, gv[:, f], SIZE) for f in range(RANK)], axis=1) + 1e-4 * model["v"]
            for key, rate in (("b", 0.1), ("w", 0.1), ("v", 0.03)):
                squares[key] = squares[key] + grads[key] ** 2
                model[key] = model[key] - rate * grads[key] / np.sqrt(squares[key])
    return model


def fold(doc_id: str | F.Column) -> F.Column:
    """crc32 of an id's text mod 5; 0 marks the held-out fold. A null id is in none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """A model from at most ``sample`` labelled rows of the folds 1 to 4."""
    usable = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    one = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max("quality").alias("__quality"))
    few = one.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # at most ``sample`` ids and labels: small enough to send
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    chosen = texts.join(F.broadcast(few), "__id")

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_rows(batches, rows=256):
            rows, cols, values = features(texts)
            edge = np.searchsorted(rows, np.arange(part.num_rows + 1))
            split = lambda x: [x[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(split(cols.astype(np.int32)), pa.binary()), pa.array(split(values.astype(np.float32)), pa.binary())], names=["__id", "__quality", "cols", "vals"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = chosen.select("__id", F.col("__quality").cast("int").alias("__quality"), "__text").mapInArrow(give, f"__id {kind}, __quality int, cols binary, vals binary")
    # an id may be on very many rows: one of them is learnt from, so at most ``sample`` rows come here
    single = made.groupBy("__id", "__quality").agg(F.min(F.struct("vals", "cols")).alias("one"))
    found = single.select("__id", "__quality", "one.vals", "one.cols").collect()
    found.sort(key=lambda r: str(r[0]))
    pairs = [(np.frombuffer(r.cols, np.int32), np.frombuffer(r.vals, np.float32)) for r in found]  # as they came: a batch is widened at a time
    return fit(pairs, np.array([float(r[1] > 0) for r in found]))


def score(docs: DataFrame, model: dict, carried: list[str], text_col: str = "text") -> DataFrame:
    """The ``carried`` columns and score (0 to 1) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in byte_rows(batches, rows=128):
            z = raw_score(m, *features(texts), part.num_rows)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch([*part.columns[:-1], pa.array(np.round(s, 9))], names=[*carried, "score"])

    own = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)
    return docs.select(*carried, F.col(text_col).cast("binary").alias("__text")).mapInArrow(give, own + "score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, score, predicted (1 from a score of 0.3).

    A null or empty text is scored by its statistics alone. Null and repeated labels: nulls are not learnt from, the
    larger of several counts. Without labels every score is 0.5; without documents there are no rows. Long texts are read whole. Repeated rows are scored each, but of the rows of one id
    only that of the least feature bytes is learnt from; a null id is not held out.
    """
    scored = score(docs, train(docs, labels, id_col, text_col), [id_col], text_col)
    held = F.coalesce(fold(id_col) == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects: those that ``classify`` predicts 0, by the same rounded score.

    Null and empty texts are judged by their statistics, repeated rows each, long texts whole; without labels all rows stay, and an empty
    table stays empty. All columns are kept, whatever their names.
    """
    model = train(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    (extra,) = fresh(docs, "__text")

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in byte_rows(batches, rows=128):
            z = raw_score(m, *features(texts), part.num_rows)
            good = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9) >= THRESHOLD  # as ``score`` rounds it
            yield pa.record_batch(part.columns[:-1], names=names).filter(pa.array(good))

    return docs.select(*names, F.col(text_col).cast("binary").alias(extra)).mapInArrow(give, docs.schema)
