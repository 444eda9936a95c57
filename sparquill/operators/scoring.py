"""Scores of predictions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WEIGHTS, distance, distance_reward
from ..sources.tables import checkpointed
from .rounds import one_to_one_by_places


def two_class_f1(truth: Column, predicted: Column) -> Column:
    """Mean F1 of the classes present and absent, as an aggregate; a class that neither side has counts 1."""

    def f1(t: Column, p: Column) -> Column:
        both, either = F.count_if(t & p), F.count_if(t) + F.count_if(p)
        return F.when(either == 0, 1.0).otherwise(2.0 * both / either)

    return (f1(truth, predicted) + f1(~truth, ~predicted)) / 2


def localization(present: Column, predicted: Column, d: Column) -> Column:
    """Mean reward over what is present; what was called absent gets 0; 1 where nothing is present."""
    return F.coalesce(F.avg(F.when(present, F.when(predicted, distance_reward(d)).otherwise(0.0))), F.lit(1.0))


def scene_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """presence, localization, identification, n of each group of rows (present, predicted, truth_class, class, tx, ty, x, y)."""
    d = distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    return rows.groupBy(*keys).agg(
        two_class_f1(F.col("present"), F.col("predicted")).alias("presence"),
        localization(F.col("present"), F.col("predicted"), d).alias("localization"),
        F.avg((F.col("truth_class") == F.col("class")).cast("double")).alias("identification"),
        F.count("*").alias("n"),
    )


def weighted(presence: Column, local: Column, recovery: Column, identification: Column) -> Column:
    return sum((c * WEIGHTS[k] for k, c in {"presence": presence, "localization": local, "recovery": recovery, "identification": identification}.items()), F.lit(0.0))


def range_pairs(left: DataFrame, right: DataFrame, keys: list[str], radius: float, strict: bool = True, small: bool = False) -> DataFrame:
    """Pairs of (l) and (r) points of the same keys within ``radius``, by a grid of cells as wide as that. ``small``: the caller has counted the left side and it may be broadcast.

    Each left point looks into the nine cells about its own, so the join is on equal keys and cells; only one side is
    copied, nine times, and no task gets more than a cell's neighbourhood.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.select(*keys, *(F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys), F.explode(steps).alias("s"))
    a = a.withColumns({"cx": F.floor(F.col("l_x") / radius) + F.col("s.i"), "cy": F.floor(F.col("l_y") / radius) + F.col("s.j")}).drop("s")
    b = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys), cell("x").alias("cx"), cell("y").alias("cy"))
    d = distance(F.col("l_x"), F.col("l_y"), F.col("r_x"), F.col("r_y"))
    met = b.join(F.broadcast(a) if small else a, [*keys, "cx", "cy"]).drop("cx", "cy").withColumn("d", d)
    return met.where(F.col("d") < radius) if strict else met.where(F.col("d") <= radius)


def places(points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, id, x, y, n): the places of some points, by the least id there and their number; and (keys, place, rank, id): the points of each place in order of id, from 0."""
    own = points.select(*keys, "id", "x", "y").distinct()
    here = Window.partitionBy(*keys, "x", "y").orderBy("id")
    ids = checkpointed(own.withColumns({"rank": (F.row_number().over(here) - 1).cast("long"), "place": F.min("id").over(Window.partitionBy(*keys, "x", "y"))}))
    return ids.groupBy(*keys, "x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")), ids.select(*keys, "place", "rank", "id")


def matched_runs(left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-to-one pairs of points nearer than ``radius``, nearest first, ties by left id and then right id, as runs of ``n`` between two places; and the ids of the left and right places.
    Points in one place are one row until they are numbered, so the pairs grow with the places."""
    (a, left_ids), (b, right_ids) = places(left, keys), places(right, keys)
    near = range_pairs(a, b, keys, radius).select(*keys, F.col("l_id").alias("left"), F.col("r_id").alias("right"), F.col("l_n").alias("n_left"), F.col("r_n").alias("n_right"), "d")
    return one_to_one_by_places(near, left_ids, right_ids, keys), left_ids, right_ids


def matched_points(left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """(keys, l_id, r_id, d): the pairs of ``matched_runs``, a row each."""
    runs, left_ids, right_ids = matched_runs(left, right, keys, radius)
    each = runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.select(*keys, "left", "right", "d", (F.col("at_left") + F.col("k")).alias("i"), (F.col("at_right") + F.col("k")).alias("j"))
    of = lambda ids, side, rank: ids.select(*keys, F.col("place").alias(side), F.col("rank").alias(rank), F.col("id").alias(f"{side[0]}_id"))
    return each.join(of(left_ids, "left", "i"), [*keys, "left", "i"]).join(of(right_ids, "right", "j"), [*keys, "right", "j"]).select(*keys, "l_id", "r_id", "d")


def greedy_recovery(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_figure, recovery): one-to-one pairs of truth and found points, nearest first, rewards over the truth's number.

    Rewards end at 36 pixels and nearer pairs come first, so pairs beyond that cannot change the sum and are not made.
    """
    runs, _, _ = matched_runs(truth, found, keys, 36.0)
    reward = runs.groupBy(*keys).agg(F.sum(F.col("n") * distance_reward(F.col("d"))).alias("reward"))
    return truth.groupBy(*keys).agg(F.count("*").alias("n_figure")).join(reward, keys, "left").select(*keys, "n_figure", F.coalesce(F.col("reward") / F.col("n_figure"), F.lit(0.0)).alias("recovery"))


def failure_category(present: Column, predicted: Column, d: Column, other_near: Column) -> Column:
    return (
        F.when(~present & ~predicted, "correct_absent").when(~present, "false_present").when(~predicted, "false_absent")
        .when(d <= 12, "correct_location").when(other_near, "wrong_appearance_ranking").otherwise("no_correct_verified_alternative")
    )
