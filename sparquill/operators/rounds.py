"""Choices that depend on order, made in rounds over rows instead of one by one over an array.

Going through a list from the best on, an entry is taken or dropped by what was taken before it. What an entry waits for are only the better
entries that it is in conflict with, so all that wait for none can be decided at once, and so on: the result is the same, no group is gathered, and a
group of any size is spread over tasks. Rounds go on until nothing is undecided; each is a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def one_to_one(pairs: DataFrame, keys: list[str], left: str, right: str, by: str = "d") -> DataFrame:
    """The pairs (keys, left, right, by) that are left when going from the nearest on, ties by left and then right, and taking each left and right once.

    A pair that is the nearest of both its sides is one that is taken; taking all such pairs at once, and again among the rest, gives the same. No pairs, no rows.
    """
    rest = checkpointed(pairs.select(*keys, left, right, by))
    taken = rest.where("false")
    while not rest.isEmpty():
        first = lambda side: rest.groupBy(*keys, side).agg(F.min(F.struct(by, left, right)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in (left, right, by)))  # noqa: B023, E731
        mutual = checkpointed(first(left).intersect(first(right)))
        taken = taken.unionByName(mutual)
        rest = checkpointed(rest.join(mutual.select(*keys, left), [*keys, left], "left_anti").join(mutual.select(*keys, right), [*keys, right], "left_anti"))
    return taken


def one_to_one_by_places(near: DataFrame, left_ids: DataFrame, right_ids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right, d, at_left, at_right, n): what ``one_to_one`` leaves of the pairs of all ids in some places, as runs: the next ``n`` ids of both places, from the ranks
    ``at_left`` and ``at_right`` on, meet one by one. ``near``: (keys, left, right, n_left, n_right, d), pairs of places; the ids: (keys, place, rank, id), in order from rank 0.

    All ids of a place are equally far from another place, and are used up from the first on. Where two places are the nearest of each other and neither has another one as near,
    the smaller one's ids are all taken at once; where others are as near, the ids decide, and one pair is taken. So rounds follow the places' order, not the number of ids in them.
    """
    zero = F.lit(0).cast("long")
    rest = checkpointed(near.select(*keys, "left", "right", "d", "n_left", "n_right").withColumns({"at_left": zero, "at_right": zero}))
    runs = rest.where("false").select(*keys, "left", "right", "d", "at_left", "at_right", F.col("n_left").alias("n"))
    of_left, of_right = Window.partitionBy(*keys, "left"), Window.partitionBy(*keys, "right")
    named = lambda ids, side: ids.select(*keys, F.col("place").alias(side), F.col("rank").alias(f"at_{side}"), F.col("id").alias(f"id_{side}"))
    d = F.col("d")
    while not rest.isEmpty():
        least = rest.withColumns({"d_left": F.min("d").over(of_left)}).withColumns({"d_right": F.min("d").over(of_right)}).where((d == F.col("d_left")) | (d == F.col("d_right")))
        least = least.join(named(left_ids, "left"), [*keys, "left", "at_left"]).join(named(right_ids, "right"), [*keys, "right", "at_right"])
        own, other = d == F.col("d_left"), d == F.col("d_right")
        least = least.withColumns({"first_right": F.min(F.when(own, F.col("id_right"))).over(of_left), "as_near": F.count_if(own).over(of_left)})
        least = least.withColumns({"first_left": F.min(F.when(other, F.col("id_left"))).over(of_right), "as_near_right": F.count_if(other).over(of_right)})
        mutual = least.where(own & other & (F.col("id_right") == F.col("first_right")) & (F.col("id_left") == F.col("first_left")))
        n = F.when((F.col("as_near") == 1) & (F.col("as_near_right") == 1), F.least(F.col("n_left") - F.col("at_left"), F.col("n_right") - F.col("at_right"))).otherwise(1)
        new = checkpointed(mutual.select(*keys, "left", "right", "d", "at_left", "at_right", n.cast("long").alias("n")))
        runs = runs.unionByName(new)
        # a union, not joins: the planner's sizes of joined checkpoints multiply, and their digits would treble from round to round
        both = rest.withColumn("used", zero).unionByName(new.select(*keys, "left", "right", F.col("n").alias("used")), allowMissingColumns=True)
        upto = {"at_left": F.col("at_left") + F.sum("used").over(of_left), "at_right": F.col("at_right") + F.sum("used").over(of_right)}
        rest = checkpointed(both.withColumns(upto).where("d IS NOT NULL AND at_left < n_left AND at_right < n_right").drop("used"))
    return runs


def first_kept(rows: DataFrame, keys: list[str], conflicts: DataFrame) -> DataFrame:
    """(keys, id) of the rows that are kept when going through them in order and dropping what is in conflict with a kept one.

    ``rows``: (keys, id), distinct; ``conflicts``: (keys, first, second), where ``first`` comes before ``second``. Without conflicts all are kept.
    """
    undecided, edges = checkpointed(rows.select(*keys, "id")), checkpointed(conflicts.select(*keys, "first", "second"))
    kept = undecided.where("false")
    while not undecided.isEmpty():
        waiting = edges.select(*keys, F.col("second").alias("id")).distinct()
        new = checkpointed(undecided.join(waiting, [*keys, "id"], "left_anti"))
        dropped = edges.join(new.withColumnRenamed("id", "first"), [*keys, "first"], "left_semi").select(*keys, F.col("second").alias("id")).distinct()
        kept = kept.unionByName(new)
        undecided = checkpointed(undecided.join(new, [*keys, "id"], "left_anti").join(dropped, [*keys, "id"], "left_anti"))
        both = [undecided.withColumnRenamed("id", side) for side in ("first", "second")]
        edges = checkpointed(edges.join(both[0], [*keys, "first"], "left_semi").join(both[1], [*keys, "second"], "left_semi"))
    return kept


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each node reaches. ``nodes``: (id); ``edges``: (a, b), either way round.

    Edges are contracted: every node takes its least neighbour or itself as its head, heads take their heads', and edges between the
    same heads vanish, so components shrink by half a round at least. A component of any size is rows throughout.
    """
    of = checkpointed(nodes.select("id", F.col("id").alias("root")))
    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not links.isEmpty():
        heads = links.groupBy("u").agg(F.min("v").alias("head"))  # each has a smaller one, so heads make no circle
        while True:  # heads of heads
            heads = checkpointed(heads)
            up = heads.select(F.col("u").alias("head"), F.col("head").alias("next"))
            further = heads.join(up, "head", "left").select("u", F.coalesce("next", "head").alias("new"), "head")
            if not further.where("new <> head").limit(1).count():
                break
            heads = further.select("u", F.col("new").alias("head"))
        moved = lambda df, c: df.join(heads.select(F.col("u").alias(c), F.col("head").alias("__head")), c, "left").withColumn(c, F.coalesce("__head", c)).drop("__head")  # noqa: B023, E731
        of = checkpointed(moved(of, "root"))
        links = moved(moved(links, "u"), "v").where("u <> v")
        links = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return of
