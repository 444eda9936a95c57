"""Guards on moves: whether a query may leave its own place for the one that the winning fit proposes.

Moves are (scene, query, x, y, nx, ny): the reported place and the proposed one. A guard gives (scene, query, accepted, reason); it never
changes whether a query is present. ``guarded`` applies one: moves shorter than half a pixel are no moves and always stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance
from .geometry import affine_fit
from .ranking import QUERY
from .scoring import range_pairs

SAME, MATCHED = 0.5, 1.5  # pixels: no move; a candidate at a place


def accept_all(moves: DataFrame) -> DataFrame:
    return moves.select(*QUERY, F.lit(True).alias("accepted"), F.lit("baseline").alias("reason"))


def independent_appearance(moves: DataFrame, scores: DataFrame, margin: float = 0.0) -> DataFrame:
    """Accepts where an independent score (scene, query, x, y, score) of the candidate at the proposed place reaches that at the reported
    place plus ``margin``. A place is its query's nearest candidate's, ``MATCHED`` pixels away at most; without one the move is refused."""

    def at(x: str, y: str, name: str) -> DataFrame:
        near = range_pairs(moves.select(*QUERY, F.col(x).alias("x"), F.col(y).alias("y")), scores.select(*QUERY, "x", "y", "score"), QUERY, MATCHED, strict=False)
        return near.groupBy(*QUERY).agg(F.min(F.struct("d", (-F.col("r_score")).alias("s"))).alias("m")).select(*QUERY, (-F.col("m.s")).alias(name))

    rows = moves.join(at("x", "y", "own"), QUERY, "left").join(at("nx", "ny", "new"), QUERY, "left")
    reason = F.when(F.col("own").isNull() | F.col("new").isNull(), "unmatched-candidate").when(F.col("new") >= F.col("own") + margin, "independent").otherwise("independent-lower")
    return rows.select(*QUERY, (reason == "independent").alias("accepted"), reason.alias("reason"))


def held_out_support(moves: DataFrame, pairs: DataFrame, tolerance: float = 18.0, least: int = 4) -> DataFrame:
    """Accepts where the fit without the query's own group still puts the group's node within ``tolerance`` of the proposed place.

    ``moves`` have grp and node besides. ``pairs``: (scene, grp, sx, sy, tx, ty, node) of the winner, pattern and scene. The fits
    come from sums: each group's is over the pairs of the others, of which there must be ``least``.
    """
    groups = pairs.select("scene", F.col("grp").alias("held")).distinct()
    fits = affine_fit(pairs.join(groups, "scene").where(F.col("grp") != F.col("held")), ["scene", "held"]).withColumnRenamed("held", "grp")
    node = pairs.select("scene", "node", F.col("sx").alias("ux"), F.col("sy").alias("uy")).distinct()
    rows = moves.join(fits, ["scene", "grp"], "left").join(node, ["scene", "node"], "left")
    c = F.col
    d = distance(c("a") * c("ux") + c("b") * c("uy") + c("e"), c("c") * c("ux") + c("d") * c("uy") + c("f"), c("nx"), c("ny"))
    reason = F.when(F.coalesce("n", F.lit(0)) < least, "few-correspondences").when(c("ux").isNull(), "no-node").when(d.isNull(), "refit-failed").when(d <= tolerance, "held-out").otherwise("held-out-far")
    return rows.select(*QUERY, (reason == "held-out").alias("accepted"), reason.alias("reason"))


def all_of(*guards: DataFrame) -> DataFrame:
    """Accepts where every guard does; the reason is the first refusal's."""
    named = [g.select(*QUERY, F.col("accepted").alias(f"a{i}"), F.col("reason").alias(f"r{i}")) for i, g in enumerate(guards)]
    rows = reduce(lambda a, b: a.join(b, QUERY), named)
    accepted = reduce(lambda a, b: a & b, (F.col(f"a{i}") for i in range(len(guards))))
    refusal = F.coalesce(*(F.when(~F.col(f"a{i}"), F.col(f"r{i}")) for i in range(len(guards))), F.lit("all guards accept"))
    return rows.select(*QUERY, accepted.alias("accepted"), refusal.alias("reason"))


def guarded(moves: DataFrame, verdict: DataFrame) -> DataFrame:
    """``moves`` with accepted and reason: no move needs a guard, others follow its verdict, and are refused where it has none."""
    same = distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")) < SAME
    rows = moves.join(verdict, QUERY, "left")
    return rows.withColumns({"accepted": same | F.coalesce("accepted", F.lit(False)), "reason": F.when(same, F.lit("no move")).otherwise(F.col("reason"))})
