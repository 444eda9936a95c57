"""Hard negatives by ball-tree branch-and-bound.

Rows are ordered by label and by their product with a fixed direction, and cut into shards of ``SHARD`` rows, so labels of any size make shards
of one size and near rows tend to share one. Every shard has a ball tree over its vectors. A ball with centre c and radius r bounds the inner products
with a query q on both sides: <q, c> - |q| r and <q, c> + |q| r. A node is pruned for a query if its products all lie outside the query's score window,
or all strictly beneath the k-th best found so far, or if its labels cannot match. All queries of a block descend together, each
leaving the descent where it is pruned.

The anchors go to the shards in blocks of some ``BLOCK``: first to the shards of their own label, for their positives, then to all, for the negatives
of each positive. A shard returns k rows a query at most, and windows keep the first k of all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, shared_folder

SHARD = 4096
BLOCK = 4096
LEAF = 128
NONE = np.iinfo(np.int64).min  # score of a place that is not taken yet
LAST = np.iinfo(np.int64).max  # key of a null id


def matrix(blobs: list[bytes], width: int | None = None) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    rows = [np.frombuffer(b, np.float64) for b in blobs]
    out = np.zeros((len(rows), max([width or 0, *map(len, rows)])))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows; refused where they may not fit a long."""
    most = float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most < 1 << 53:
        return (q @ x.T).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("inner products beyond the range of a long")
    return q.astype(np.int64) @ x.astype(np.int64).T


class BallTree:
    """Balls over the rows of ``x``; halves are cut at the median along the line between two far rows."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.x, self.labels = x, labels
        self.nodes: list[tuple] = []  # centre, radius, first row, end, least and greatest label, children
        self._grow(0, len(x), leaf)
        self.x, self.labels = x[self.order], labels[self.order]

    def _grow(self, a: int, b: int, leaf: int) -> int:
        rows = self.order[a:b]
        x, labels = self.x[rows], self.labels[rows]
        centre = x.mean(axis=0)
        far = ((x - centre) ** 2).sum(axis=1)
        at = len(self.nodes)
        self.nodes.append(())
        children = ()
        if b - a > leaf:
            one = x[far.argmax()]
            line = x @ (x[((x - one) ** 2).sum(axis=1).argmax()] - one)
            half = (b - a) // 2
            self.order[a:b] = rows[np.argpartition(line, half)]
            children = (self._grow(a, a + half, leaf), self._grow(a + half, b, leaf))
        self.nodes[at] = (centre, float(np.sqrt(far.max())), a, b, labels.min(), labels.max(), children)
        return at


def search(tree: BallTree, keys: np.ndarray, q: np.ndarray, of: np.ndarray, own: np.ndarray, mine: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """(query, row of the tree, score) of the first k rows of each query, by score from above, then by key.

    Query i asks with vector q[of[i]] of label own[of[i]] for scores from low[i] to high[i], of the same label or of others; ``mine`` is the row that is the
    vector itself, or -1.
    """
    n = len(of)
    norm = np.sqrt((q * q).sum(axis=1))
    score, row, key = np.full((n, k), NONE), np.full((n, k), -1), np.full((n, k), LAST)
    todo = [(0, np.arange(n))]
    while todo:
        node, asked = todo.pop()
        centre, radius, a, b, least, most, children = tree.nodes[node]
        middle = q @ centre
        slack = 1e-9 * norm * (np.sqrt(centre @ centre) + radius) + 1e-6
        above, below = middle + norm * radius + slack, middle - norm * radius - slack
        at = of[asked]
        fits = (own[at] >= least) & (own[at] <= most) if same else (own[at] != least) | (own[at] != most)
        asked = asked[fits & (above[at] >= np.maximum(low[asked], score[asked, -1])) & (below[at] <= high[asked])]
        if not len(asked):
            continue
        if children:  # the child that promises more is taken first
            todo += [(c, asked) for c in sorted(children, key=lambda c: (q[of[asked]] @ tree.nodes[c][0]).mean())]
            continue
        vectors, at = np.unique(of[asked], return_inverse=True)
        found = products(q[vectors], tree.x[a:b])[at]
        alike = own[of[asked]][:, None] == tree.labels[None, a:b]
        kth = score[asked, -1][:, None]
        fits = (alike if same else ~alike) & (found >= low[asked][:, None]) & (found <= high[asked][:, None])
        fits &= (found > kth) | ((found == kth) & (keys[None, a:b] < key[asked, -1][:, None])) | (row[asked, -1][:, None] < 0)
        fits &= mine[of[asked]][:, None] != np.arange(a, b)[None]
        i, j = np.nonzero(fits)
        if not len(i):
            continue
        changed = np.unique(i)
        slots = asked[changed]
        old_i, old_j = np.nonzero(row[slots] >= 0)
        who = np.concatenate((np.searchsorted(changed, i), old_i))
        s = np.concatenate((found[i, j], score[slots][old_i, old_j]))
        r = np.concatenate((j + a, row[slots][old_i, old_j]))
        by = np.lexsort((r, keys[r], -s, who))
        who, s, r = who[by], s[by], r[by]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        who, s, r, rank = (v[rank < k] for v in (who, s, r, rank))
        score[slots[who], rank], row[slots[who], rank], key[slots[who], rank] = s, r, keys[r]
    query, place = np.nonzero(row >= 0)
    return query, row[query, place], score[query, place]


def prepared(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v, along): integer components floor(256 x) as bytes, label changed where 7 divides the id, and the product with a fixed direction; rows that take no part are left out."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat = np.floor(256.0 * np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan)))
            lengths = np.asarray(pa.compute.list_value_length(column).fill_null(0))
            ends = np.cumsum(lengths)
            keep, blobs, along = [], [], []
            for e, n, null in zip(ends.tolist(), lengths.tolist(), column.is_null().to_pylist(), strict=True):
                v = flat[e - n : e] + 0.0
                good = not null and bool(np.isfinite(v).all())
                keep.append(good)
                if good:
                    blobs.append(v.tobytes())
                    along.append(float(v @ np.random.default_rng(7).standard_normal(n)))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([kept.column(0), kept.column(1), pa.array(blobs, pa.binary()), pa.array(along, pa.float64())], names=["id", "label", "v", "along"])

    number, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    changed = F.when(number % 7 == 0, (label + 1) % 10).otherwise(label)
    given = vectors.where(label.isNotNull()).select(number.alias("id"), changed.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return given.mapInArrow(give, "id long, label long, v binary, along double")


def _shard(table: pa.Table) -> tuple[BallTree, np.ndarray, np.ndarray, np.ndarray, list]:
    x, labels = matrix(table.column("v").to_pylist()), np.asarray(table.column("label"))
    tree = BallTree(x, labels)
    ids = table.column("id").take(pa.array(tree.order))
    return tree, np.asarray(ids.fill_null(LAST)), np.asarray(table.column("row"))[tree.order], x, ids.to_pylist()


def _asked(table: pa.Table, x: np.ndarray, tree: BallTree) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a block as wide as the shard's vectors, and their labels."""
    q = matrix(table.column("v").to_pylist(), x.shape[1])
    if q.shape[1] > x.shape[1]:  # components that no vector of the shard has
        q = q[:, : x.shape[1]]
    return q, np.asarray(table.column("label"))


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (``every`` divides its id) and each of its first ``positives`` other rows of its
    label, the first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the positive's.

    Rows with a null label or vector, or a null or non-finite component, take no part; a row of null id does, is no anchor and comes last among ties. Repeated rows are
    rows each: copies of an anchor are anchors and one another's positives, and rows equal in score and id come in any order, which shows nowhere. Vectors of unequal length are filled up with zeros. A
    positive of a negative score has an empty window. Products that may not fit a long are refused. An empty table, and one without anchors, gives no rows. Other
    columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = in_order(prepared(vectors, id_col, label_col, vector_col).withColumn("all", F.lit(0)), "all", ["label", "along"], f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}")
    rows = rows.select(F.expr(f"pos div {SHARD}").alias("shard"), F.col("pos").alias("row"), "id", "label", "v")
    anchors = rows.where(F.col("id") % every == 0)
    n = rows.agg(F.max("shard"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    shards, blocks = (n[0] or 0) + 1, -(-n[1] // BLOCK) or 1
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).drop("shard")
    spans = rows.groupBy("label").agg(F.min("shard").alias("a"), F.max("shard").alias("b"))
    near = anchors.join(spans, "label").select("*", F.explode(F.sequence("a", "b")).alias("shard")).drop("a", "b")

    def together(asked: DataFrame, give, schema: str) -> DataFrame:
        asked = asked.toDF(*asked.columns)
        pairs = asked.select("shard", "block").distinct().toDF("at", "block")
        return rows.join(pairs, F.col("shard") == F.col("at")).drop("at").toDF(*rows.columns, "block").groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(give, schema)

    def own_label(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["row", "positive_row", "positive_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        tree, keys, place, x, ids = _shard(left)
        q, own = _asked(right, x, tree)
        row = np.asarray(right.column("row"))
        at = {r: i for i, r in enumerate(place.tolist())}
        self_at = np.array([at.get(r, -1) for r in row.tolist()])
        whole = np.full(len(q), NONE), np.full(len(q), LAST)
        i, j, s = search(tree, keys, q, np.arange(len(q)), own, self_at, *whole, positives, True)
        return pa.table([pa.array(row[i]), pa.array(place[j]), pa.array([ids[k] for k in j.tolist()], pa.int64()), pa.array(s)], names=names)

    found = together(near, own_label, "row long, positive_row long, positive_id long, score long")
    order = lambda what: [F.col("score").desc(), F.col(f"{what}_id").asc_nulls_last(), F.col(f"{what}_row")]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order("positive")))).where(F.col("rank") <= positives)
    lists = found.where("score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "positive_id"))).alias("wanted"))
    asked = anchors.join(lists, "row").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def other_labels(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["row", "nth", "negative_row", "negative_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names=names)
        tree, keys, place, x, ids = _shard(left)
        q, own = _asked(right, x, tree)
        wanted = right.column("wanted").to_pylist()
        of = np.array([i for i, w in enumerate(wanted) for _ in w])
        nth = np.array([p["rank"] for w in wanted for p in w])
        score = [p["score"] for w in wanted for p in w]
        least, most = np.array([-(-low * s // 100) for s in score]), np.array([high * s // 100 for s in score])
        i, j, s = search(tree, keys, q, of, own, np.full(len(q), -1), least, most, negatives, False)
        row = np.asarray(right.column("row"))
        return pa.table([pa.array(row[of[i]]), pa.array(nth[i].astype(np.int64)), pa.array(place[j]), pa.array([ids[k] for k in j.tolist()], pa.int64()), pa.array(s)], names=names)

    hard = together(asked, other_labels, "row long, nth long, negative_row long, negative_id long, score long")
    hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("row", "nth").orderBy(*order("negative")))).where(F.col("rank") <= negatives)
    named = anchors.select("row", F.col("id").alias("anchor_id")).join(lists, "row").select("row", "anchor_id", F.inline("wanted")).select("row", "anchor_id", F.col("rank").cast("long").alias("nth"), "positive_id", F.col("score").alias("positive_score"))
    return named.join(hard, ["row", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def sql() -> str:
    """The same in SQL over ``embeddings``, whose vectors are of one length."""
    return """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other) AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.r = s.r AND NOT s.alike AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10"""
