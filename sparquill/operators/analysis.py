"""Statistics over results: curves, tests, moves and similarity search."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

QUERIES_HELD, SHARD = 2048, 8192  # query vectors and vectors of a task
AT_ONCE = 64  # queries of a task whose scores are held at once
FEW = 100_000  # groups whose bounds are sent to every task


def same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Equality of columns of two frames, nulls being equal."""
    return reduce(and_, (a[c].eqNullSafe(b[c]) for c in names), F.lit(True))


def running_sums(rows: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """``rows`` with, for each of ``sums``, its sum over the rows of the keys that come before (c_before) and over all of them (c_total), and the next row's ``order`` (next).
    ``order`` must be distinct within the keys.

    Rows are dealt by ranges and summed within their range; what comes before a range is a running sum over the ranges, one row each. So a key of any size is spread over tasks.
    """
    dealt = checkpointed(rows.repartitionByRange(*keys, order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part", *keys).orderBy(order)
    own = dealt.withColumns({f"__{c}": F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums} | {"__next": F.lead(order).over(within)})
    parts = dealt.groupBy("__part", *keys).agg(F.min(order).alias("__least"), *(F.sum(c).alias(f"__{c}_sum") for c in sums))
    across = Window.partitionBy(*keys).orderBy("__part")
    before = {f"__{c}_b": F.coalesce(F.sum(f"__{c}_sum").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums}
    total = {f"__{c}_t": F.sum(f"__{c}_sum").over(Window.partitionBy(*keys)) for c in sums}
    parts = checkpointed(parts.withColumns(before | total | {"__after": F.lead("__least").over(across)}))
    met = own.join(parts, same(own, parts, ["__part", *keys]))
    made = [x for c in sums for x in ((F.col(f"__{c}") + F.col(f"__{c}_b")).alias(f"{c}_before"), F.col(f"__{c}_t").alias(f"{c}_total"))]
    return met.select(*(own[c] for c in rows.columns), *made, F.coalesce("__next", "__after").alias("next"))


def share_below(rows: DataFrame, keys: list[str], value: str, sampled: Column) -> DataFrame:
    """``rows`` with share: the part of the sampled rows of the keys whose value is less; 0 without any."""
    per = rows.groupBy(*keys, value).agg(F.count_if(sampled).alias("r"))
    s = running_sums(per, keys, value, ["r"]).select(*keys, value, F.coalesce(F.try_divide("r_before", "r_total"), F.lit(0.0)).alias("share"))
    return rows.join(s, same(rows, s, [*keys, value])).select(*(rows[c] for c in rows.columns), "share")


def grouped_auc(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Share of (positive, negative) pairs of a group in which the positive scores more, ties a half: from rank sums, without
    making the pairs."""
    per = rows.groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    wins = running_sums(per, keys, score, ["q"]).withColumn("wins", F.col("p") * (F.col("q_before") + F.col("q") / 2.0))
    return wins.groupBy(*keys).agg((F.sum("wins") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def wasserstein(rows: DataFrame, keys: list[str], value: str, first: str) -> DataFrame:
    """Distance of the distributions of a value where ``first`` holds and where not: the area between their step functions; null if one is empty."""
    per = rows.groupBy(*keys, value).agg(F.count_if(first).alias("a"), F.count_if(~F.col(first)).alias("b"))
    steps = running_sums(per, keys, value, ["a", "b"])
    share = lambda c: F.try_divide(F.col(f"{c}_before") + F.col(c), F.col(f"{c}_total"))
    gap = F.abs(share("a") - share("b"))
    return steps.withColumn("area", gap * (F.col("next") - F.col(value))).groupBy(*keys).agg(F.when((F.sum("a") > 0) & (F.sum("b") > 0), F.coalesce(F.sum("area"), F.lit(0.0))).alias("distance"))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, rank, id, score): the k vectors with the largest dot product with each query, ties by id. ``queries``: (query, variant vectors in ``vec_col``); a query may have several rows,
    its variants, of which the best counts for each vector.

    Vectors are dealt to shards of about ``SHARD`` and queries, in blocks of about ``QUERIES_HELD``, to every shard. A task multiplies a block with a shard, ``AT_ONCE`` queries at a time, and
    keeps the k best of each query, so what is shuffled are queries a shard and k rows a query and shard, not a row a pair. Scores are rounded to nine digits. Rows without a vector take no part.
    """
    own = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col("query").cast("long").alias("query"), F.col(vec_col).cast("array<double>").alias("v"))
    shards, blocks = (max(1, -(-df.count() // held)) for df, held in ((own, SHARD), (asked, QUERIES_HELD)))
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = own.select(deal("id", shards).alias("shard"), every("block", blocks), "id", "v")
    right = asked.select(deal("query", blocks).alias("block"), every("shard", shards), "query", "v")

    def give(x: pa.Table, q: pa.Table) -> pa.Table:
        names = ["query", "id", "score"]
        if not x.num_rows or not q.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        q = q.sort_by("query")
        own, ids, of = np.stack(x.column("v").to_numpy()), x.column("id").to_numpy(), q.column("query").to_numpy()
        asked = np.stack(q.column("v").to_numpy())
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        ends = np.append(first[1:], len(of))
        out = []
        for at in range(0, len(first), AT_ONCE):
            a, b = first[at], ends[at : at + AT_ONCE][-1]
            s = np.maximum.reduceat(np.round(asked[a:b] @ own.T, 9), first[at : at + AT_ONCE] - a, axis=0)
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            out.append(pa.table([pa.array(np.repeat(of[first[at : at + AT_ONCE]], order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=names))
        return pa.concat_tables(out)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(give, "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", F.col("rank").cast("long").alias("rank"), "id", "score")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 1000) -> DataFrame:
    """Exact quantiles of a value for each group, linear between ranks; a column for each name of ``probs``. Nulls are left out.

    Approximate quantiles a little below and above each wanted one bound its value. Rows below the bounds are only counted;
    rows between them, about one in 250, are counted by value and ranked. So no buffer holds a group's values. The bounds of up to ``FEW`` groups go to
    the rows, which stay where they are: a shuffle by the keys would put a large group into one task.
    """
    own = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    names = sorted(probs)
    edge = 2.0 / accuracy
    sides = [min(1.0, max(0.0, probs[n] + e)) for n in names for e in (-edge, edge)]
    bounds = own.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", sides, accuracy).alias("q"))
    side = lambda i, far: F.when(F.col("n") < 4 * accuracy, float(far)).otherwise(F.get("q", F.lit(i)))  # noqa: E731  small groups are ranked whole
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(probs[n])).alias("p"), side(2 * i, "-inf").alias("lo"), side(2 * i + 1, "inf").alias("hi")) for i, n in enumerate(names))))
    bounds = checkpointed(bounds)
    near = F.broadcast(bounds) if not keys or bounds.count() <= FEW else bounds  # without keys the bounds are one row
    marked = own.join(near, keys) if keys else own.crossJoin(near)
    marked = marked.select(*keys, "v", "n", wanted.alias("w")).where("v <= w.hi")
    counted = marked.groupBy(*keys, "n", "w", F.when(F.col("v") >= F.col("w.lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys, "w.name").orderBy(F.col("v").asc_nulls_first())
    upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = F.col("w.p") * (F.col("n") - 1)
    ranked = counted.withColumns({"upto": upto, "below": F.floor(at), "part": at - F.floor(at)}).where("v IS NOT NULL")
    first = F.min(F.when(F.col("upto") > F.col("below"), F.col("v")))
    second = F.min(F.when(F.col("upto") > F.least(F.col("below") + 1, F.col("n") - 1), F.col("v")))
    out = ranked.groupBy(*keys, F.col("w.name").alias("name"), "part").agg(first.alias("a"), second.alias("b"))
    found = out.select(*keys, "name", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("x"))
    return found.groupBy(*keys).pivot("name", names).agg(F.first("x"))


def interpolated(rows: DataFrame, breaks: DataFrame, keys: list[str], at: str, value: str, out: str = "interpolated") -> DataFrame:
    """``rows`` with ``out``: the broken line through the keys' ``breaks`` (keys, at, value), read at each row's ``at``; beyond its ends the line is level, and without breaks null.

    An as-of join both ways: rows and breaks are dealt by ranges of keys and place together, the last break before and the first one after are carried along within a
    range, and from range to range by a running look over one row a range. Breaks must be distinct in keys and place; null places have no value.
    """
    both = rows.withColumn("__b", F.lit(None).cast("struct<x:double,v:double>")).unionByName(
        breaks.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(*keys, at, F.struct(F.col(at).cast("double").alias("x"), F.col(value).cast("double").alias("v")).alias("__b")), allowMissingColumns=True)
    order = [F.col(at), F.col("__b").isNull()]  # a break comes before the rows in its place
    dealt = checkpointed(both.repartitionByRange(*keys, at, F.col("__b").isNull()).withColumn("__part", F.spark_partition_id()))
    within, back = (Window.partitionBy("__part", *keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (order, [F.col(at).desc(), F.col("__b").isNull().desc()]))
    across = Window.partitionBy(*keys).orderBy("__part")
    # the next break is the last one seen when going backwards: a frame that shrinks from its start is computed anew for every row
    own = dealt.withColumns({"__low": F.last("__b", True).over(within), "__high": F.last("__b", True).over(back)}).where("__b IS NULL")
    ends = dealt.groupBy("__part", *keys).agg(F.max("__b").alias("__most"), F.min("__b").alias("__least"))
    ends = checkpointed(ends.withColumns({"__before": F.last("__most", True).over(across.rowsBetween(Window.unboundedPreceding, -1)), "__after": F.first("__least", True).over(across.rowsBetween(1, Window.unboundedFollowing))}))
    met = own.join(ends, same(own, ends, ["__part", *keys]))
    low, high = F.coalesce("__low", "__before"), F.coalesce("__high", "__after")
    x = own[at].cast("double")
    line = F.when(high["x"] > low["x"], low["v"] + (high["v"] - low["v"]) * (x - low["x"]) / (high["x"] - low["x"])).otherwise(low["v"])
    return met.select(*(own[c] for c in rows.columns), F.when(x.isNull(), F.lit(None).cast("double")).when(low.isNull(), high["v"]).when(high.isNull(), low["v"]).otherwise(line).alias(out))
