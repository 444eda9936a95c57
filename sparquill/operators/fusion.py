"""Fusion of two branches' hypotheses by policy, and predictions under a policy.

Fits are (scene, stage, name, score, nodes), ``nodes`` an array of mapped places (x, y) in a class's order; only those with support. All
policies are settled in one pass: fits are dealt out by scene once, every window below is within a scene, and the policies are rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance

POLICIES = ("baseline", "refined", "coarse", "rrf", "mean_regret", "min_regret", "agreement_1", "agreement_2", "stable_1")
#: Added to a rank, rank and regret of a class that a branch lacks, the places' median distance that is stable.
RANK_BASE, NO_RANK, NO_REGRET, STABLE = 3, 49, 20.0, 18.0


def median_move(a: Column, b: Column) -> Column:
    """Median distance of two arrays' places, null where they differ in length."""
    d = F.array_sort(F.zip_with(a, b, lambda p, q: distance(p["x"], p["y"], q["x"], q["y"])))
    n = F.size(a)
    mid = (F.get(d, ((n - 1) / 2).cast("int")) + F.get(d, (n / 2).cast("int"))) / 2
    return F.when((n == F.size(b)) & (n > 0), mid)


def class_values(fits: DataFrame) -> DataFrame:
    """``fits`` with a struct ``value``: of the row's class, what each policy that compares classes makes of it; more is better."""
    branch, own = Window.partitionBy("scene", "stage"), Window.partitionBy("scene", "name")
    rows = fits.withColumns({"__rank": F.row_number().over(branch.orderBy(F.desc("score"), "name")), "__regret": F.max("score").over(branch) - F.col("score")})
    of = lambda stage, c: F.max(F.when(F.col("stage") == stage, F.col(c))).over(own)
    rows = rows.withColumns({"__best": F.max("score").over(own)} | {f"__{c}_{s}": of(s, n) for s in ("refined", "coarse") for c, n in (("rank", "__rank"), ("regret", "__regret"), ("nodes", "nodes"))})
    rank = lambda s: F.coalesce(f"__rank_{s}", F.lit(NO_RANK))
    regret = lambda s: F.coalesce(f"__regret_{s}", F.lit(NO_REGRET))
    shared = F.col("__rank_refined").isNotNull() & F.col("__rank_coarse").isNotNull()
    stable = shared & F.coalesce(median_move(F.col("__nodes_refined"), F.col("__nodes_coarse")) <= STABLE, F.lit(False))
    value = F.struct(
        (1.0 / (RANK_BASE + rank("refined")) + 1.0 / (RANK_BASE + rank("coarse"))).alias("rrf"),
        (-(regret("refined") + regret("coarse")) / 2).alias("mean_regret"),
        (-F.greatest(regret("refined"), regret("coarse"))).alias("min_regret"),
        (F.col("__best") + shared.cast("double")).alias("agreement_1"),
        (F.col("__best") + 2 * shared.cast("double")).alias("agreement_2"),
        (F.col("__best") + stable.cast("double")).alias("stable_1"),
    )
    return rows.select(*fits.columns, value.alias("value"))


def fused_all(fits: DataFrame, policies: Sequence[str] = POLICIES) -> DataFrame:
    """The fit that each policy picks in each scene: (policy, scene, name, stage, score) and what else ``fits`` has.

    The baseline is the best score, ties by name and stage. The policies of one branch take that branch's best, those that compare
    classes the class of the best value, ties by name, in its better branch; where the asked-for branch or one of two is missing, the baseline stays.
    """
    if unknown := set(policies) - set(POLICIES):
        raise ValueError(f"no policy {', '.join(sorted(unknown))}")
    scene = Window.partitionBy("scene")
    has = lambda stage: F.max(F.col("stage") == stage).over(scene)
    rows = class_values(fits.repartition("scene")).withColumn("__both", has("refined") & has("coarse"))
    value = lambda p: F.lit(None).cast("double") if p in ("baseline", "refined", "coarse") else F.round(f"value.{p}", 9)
    rows = rows.withColumn("__p", F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), value(p).alias("v")) for p in policies)))).select("__p.policy", "__p.v", "*")
    # values are compared to nine digits, so that sums in another order do not decide
    classes = ~F.col("policy").isin("baseline", "refined", "coarse")
    fits_in = F.when(F.col("policy") == "baseline", F.lit(True)).when(classes, F.col("__both")).otherwise(F.col("stage") == F.col("policy"))
    order = [F.desc("__in"), F.desc(F.when(classes & F.col("__in"), F.col("v")).otherwise(F.col("score"))), "name", F.desc("score"), "stage"]
    first = rows.withColumn("__in", fits_in).withColumn("__k", F.row_number().over(Window.partitionBy("scene", "policy").orderBy(*order))).where("__k = 1")
    return first.select("policy", *fits.columns)


def fused(fits: DataFrame, policy: str) -> DataFrame:
    """``fused_all`` of one policy."""
    return fused_all(fits, [policy]).drop("policy")


def predicted_all(first: DataFrame, moves: DataFrame, fits: DataFrame, kinds: Sequence[tuple[str, bool]], threshold: float = 0.72, radius: float = 18.0) -> DataFrame:
    """(policy, id_only, scene, query, x, y, member, name): the decisions under each of ``kinds``, policies each with whether it changes the name alone.

    ``first``: (scene, query, x, y, score), each query's refined first candidate; ``moves``: (scene, stage, name, query, x, y), the places that
    each fit proposes. With ``id_only`` places and members stay the baseline's and only the name follows the policy.
    """
    wanted = sorted({p for p, _ in kinds} | {"baseline" for _, only in kinds if only})
    picks = fused_all(fits, wanted).groupBy("scene").agg(F.map_from_entries(F.collect_list(F.struct("policy", F.struct("stage", "name", "nodes")))).alias("picks"))
    kind = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(only).alias("id_only"), F.lit("baseline" if only else p).alias("base")) for p, only in kinds)))
    rows = first.join(picks, "scene", "left").withColumn("kind", kind)
    rows = rows.select("scene", "query", "x", "y", "score", "kind.policy", "kind.id_only", F.col("picks")[F.col("kind.base")].alias("base"), F.col("picks")[F.col("kind.policy")]["name"].alias("name"))
    rows = rows.withColumns({"stage": F.col("base.stage"), "fit": F.col("base.name")})
    own = moves.select("scene", "stage", F.col("name").alias("fit"), "query", F.col("x").alias("nx"), F.col("y").alias("ny"))
    rows = rows.join(own, ["scene", "stage", "fit", "query"], "left")
    rows = rows.withColumns({"x": F.coalesce("nx", "x"), "y": F.coalesce("ny", "y"), "present": (F.col("score") >= threshold) & F.col("fit").isNotNull()})
    near = F.exists(F.col("base.nodes"), lambda n: distance(n["x"], n["y"], F.col("x"), F.col("y")) < radius)
    shown = lambda c: F.when(F.col("present"), c)
    return rows.select("policy", "id_only", "scene", "query", shown(F.col("x")).alias("x"), shown(F.col("y")).alias("y"), shown(near.cast("int")).alias("member"), F.coalesce("name", F.lit("unknown")).alias("name"))


def predicted(first: DataFrame, moves: DataFrame, fits: DataFrame, policy: str, identification_only: bool = False, threshold: float = 0.72, radius: float = 18.0) -> DataFrame:
    """``predicted_all`` of one policy."""
    return predicted_all(first, moves, fits, [(policy, identification_only)], threshold, radius).drop("policy", "id_only")
