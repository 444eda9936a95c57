"""Candidates of queries: ranks, gaps, pools, suppression and reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .rounds import first_kept
from .scoring import range_pairs

QUERY = ["scene", "query"]


def best_first() -> WindowSpec:
    """A query's candidates by score, ties by position."""
    return Window.partitionBy(*QUERY).orderBy(F.desc("score"), "pos")


def of_query() -> WindowSpec:
    return Window.partitionBy(*QUERY)


def ranked(cand: DataFrame) -> DataFrame:
    """``cand`` with rank (from 0) by score, ties by position."""
    return cand.withColumn("rank", F.row_number().over(best_first()) - 1)


def gaps(cand: DataFrame) -> DataFrame:
    """The first candidate of each query and the gap of its score to the second; infinite where there is none."""
    nxt = F.lead("score").over(best_first())
    return ranked(cand.withColumn("gap", F.coalesce(F.col("score") - nxt, F.lit(float("inf"))))).where("rank = 0").drop("rank")


def slates(cand: DataFrame) -> DataFrame:
    """``cand`` with the roles of a candidate besides its calibration ``score``: ``rank_score``, which orders the pool and is the score
    unless given, and the flags ``eligible`` and ``seed``, false unless given. A role is replaced by giving its column; places stay."""
    roles = {"rank_score": F.col("score"), "eligible": F.lit(False), "seed": F.lit(False)}
    return cand.withColumns({c: v for c, v in roles.items() if c not in cand.columns})


def pool(cand: DataFrame, top_k: int, gap: float, margin: float, limit: int = 1, pool_by: str = "rank") -> DataFrame:
    """Candidates that a query brings, with their ``rank`` in its part of the pool.

    They are the first ``top_k`` where the gap of the two best scores is under ``gap``, else ``limit``, by ranking score, or with
    ``pool_by`` "calib" by score and then put in the order of the ranking score. Eligible candidates are let in whatever the gap and come
    first; where there are any, the cap is one more than their number, at most ``top_k``, at least what it was. Those
    below the best score by more than ``margin`` stay only if they are the first.
    """
    rows = slates(cand)
    place = {"by_rank": "rank_score", "by_calib": "score"}
    rows = rows.withColumns({c: F.row_number().over(Window.partitionBy(*QUERY).orderBy(F.desc(v), "pos")) - 1 for c, v in place.items()})
    second = F.max(F.when(F.col("by_calib") == 1, F.col("score"))).over(of_query())
    rows = rows.withColumns({"best": F.max("score").over(of_query()), "second": second, "n_eligible": F.count_if("eligible").over(of_query())})
    rows = rows.withColumn("ambiguous", F.coalesce(F.col("best") - F.col("second") < gap, F.lit(False)))
    rows = rows.withColumn("most", F.when(F.col("ambiguous"), top_k).otherwise(limit)).where(F.col("eligible") | (F.col("by_calib" if pool_by == "calib" else "by_rank") < F.col("most")))
    order = Window.partitionBy(*QUERY).orderBy(F.desc("eligible"), "by_rank")
    cap = F.when(F.col("n_eligible") > 0, F.greatest("most", F.least(F.lit(top_k), F.col("n_eligible") + 1))).otherwise(F.col("most"))
    rows = rows.withColumn("rank", F.row_number().over(order) - 1).where((F.col("rank") < cap) & ((F.col("rank") == 0) | (F.col("score") >= F.col("best") - margin)))
    return rows.select(*cand.columns, "rank", "ambiguous") if "rank" not in cand.columns else rows.select(*(c for c in cand.columns if c != "rank"), "rank", "ambiguous")


def suppressed(cand: DataFrame, radius: float, keep: int) -> DataFrame:
    """The kept candidates of each query, with their order: no better kept one within ``radius``, ``keep`` at most; better is by score, ties by id.

    Conflicts are pairs within the radius, and ``first_kept`` settles them in rounds, so a query of any number of candidates is rows throughout.
    """
    own = checkpointed(cand.select(*QUERY, "id", "x", "y", "score"))
    better = (F.col("l_score") > F.col("r_score")) | ((F.col("l_score") == F.col("r_score")) & (F.col("l_id") < F.col("r_id")))
    conflicts = range_pairs(own, own, QUERY, radius).where(better).select(*QUERY, F.col("l_id").alias("first"), F.col("r_id").alias("second"))
    kept = first_kept(own, QUERY, conflicts)
    w = Window.partitionBy(*QUERY).orderBy(F.desc("score"), "id")
    return own.join(kept, [*QUERY, "id"]).withColumn("kept_rank", F.row_number().over(w) - 1).where(F.col("kept_rank") < keep).select(*QUERY, "kept_rank", "id", "x", "y", "score")


def reordered(cand: DataFrame, second: str) -> DataFrame:
    """Candidates in the order of a second score, with the sorted first scores dealt out anew."""
    by_second = cand.withColumn("new_rank", F.row_number().over(Window.partitionBy(*QUERY).orderBy(F.desc(second), "pos")) - 1)
    scores = ranked(cand).select(*QUERY, F.col("rank").alias("new_rank"), F.col("score").alias("new_score"))
    return by_second.join(scores, [*QUERY, "new_rank"])
