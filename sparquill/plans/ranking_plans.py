"""Queries on candidates: windows, pools, suppression, sets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.analysis import share_below
from ..operators.fusion import fused_all, predicted_all
from ..operators.ranking import QUERY, gaps, of_query, pool, ranked, reordered, suppressed
from ..sources.tables import CAND, candidates, load

R = lambda c, n=6: F.round(c, n)
OVER = "OVER (PARTITION BY scene, query ORDER BY score DESC, pos)"
RANKED = f"{CAND}, r AS (SELECT *, row_number() {OVER} - 1 AS rank FROM cand)"


def w1(spark, sf):
    return ranked(candidates(spark, sf)).select(*QUERY, "id", F.col("rank").cast("long").alias("rank"))


def w2(spark, sf):
    g = gaps(candidates(spark, sf))
    return g.select(*QUERY, "id", R(F.when(F.col("gap") == float("inf"), -1.0).otherwise(F.col("gap"))).alias("gap"))


def c4(spark, sf):
    return pool(candidates(spark, sf), 8, 20.0, 60.0).select(*QUERY, "id", F.col("rank").cast("long").alias("rank"))


def w5(spark, sf):
    """The pool with candidates let in for their place: they come first, and the cap grows with their number."""
    c = candidates(spark, sf).withColumn("eligible", F.col("x") < 600)
    return pool(c, 8, 20.0, 60.0).select(*QUERY, "id", F.col("rank").cast("long").alias("rank"))


def c10(spark, sf):
    """The pool by a second score, with the members that the first one chooses."""
    c = candidates(spark, sf).withColumn("rank_score", F.col("y"))
    return pool(c, 8, 20.0, 60.0, pool_by="calib").select(*QUERY, "id", F.col("rank").cast("long").alias("rank"))


def w6(spark, sf):
    c = candidates(spark, sf)
    pick = lambda order: c.withColumn("k", F.row_number().over(Window.partitionBy(*QUERY).orderBy(order, "pos"))).where("k = 1")
    return pick(F.desc("score")).select(*QUERY, F.col("id").alias("first_max")).join(pick(F.asc("score")).select(*QUERY, F.col("id").alias("first_min")), QUERY)


def w7(spark, sf):
    c = candidates(spark, sf).groupBy("scene", "query").agg(F.max("score").alias("score"))
    w = Window.partitionBy("scene").orderBy(F.desc("score"), "query")
    return c.select("scene", "query", F.row_number().over(w).cast("long").alias("class_rank"), R(F.coalesce(F.col("score") - F.lead("score").over(w), F.lit(-1.0))).alias("gap"))


def w9(spark, sf):
    """The best rank of a candidate near a query's truth, before and after the cut to ten."""
    near = (F.col("x") < 1500) & (F.col("y") < 1500)
    return ranked(candidates(spark, sf)).groupBy(*QUERY).agg(F.min(F.when(near, F.col("rank"))).cast("long").alias("rank"), F.min(F.when(near & (F.col("rank") < 10), F.col("rank"))).cast("long").alias("kept_rank"))


def w10(spark, sf):
    """Share of a reference sample's values below each value: counts of the sample by value, summed in order."""
    e = load(spark, sf, "events").select("event_id", "event_type", "value")
    return share_below(e, ["event_type"], "value", F.col("event_id") % 10 == 0).select("event_id", R(F.col("share")).alias("share"))


def w11(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return d.join(first, "sha").select("doc_id", "first_doc", "copies")


def w12(spark, sf):
    e = load(spark, sf, "events")
    n = e.groupBy("user_id", "value").agg(F.count("*").alias("n"))
    return e.join(n, ["user_id", "value"]).select("event_id", (F.col("n") - 1).alias("repeats"))


def w13(spark, sf):
    c = candidates(spark, sf)
    w = Window.partitionBy(*QUERY).orderBy(F.desc("score"))
    return c.select(*QUERY, "id", R(F.max("score").over(of_query()) - F.col("score")).alias("regret"), R(1.0 / (3.0 + F.rank().over(w))).alias("rr"))


def t1(spark, sf):
    return ranked(candidates(spark, sf)).where("rank < 3").select(*QUERY, "id", F.col("rank").cast("long").alias("rank"), "score")


def t2(spark, sf):
    s = suppressed(candidates(spark, sf), 400.0, 5)
    return s.select(*QUERY, "id", F.col("kept_rank").cast("long").alias("kept_rank"))


T2_SQL = f"""WITH RECURSIVE {RANKED}, go AS (SELECT scene, query, CAST(0 AS BIGINT) AS rank, [{{'id': id, 'x': x, 'y': y}}] AS kept FROM r WHERE rank = 0
 UNION ALL SELECT g.scene, g.query, r.rank, CASE WHEN len(kept) < 5 AND len(list_filter(kept, lambda q: sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)) < 400.0)) = 0
 THEN list_append(kept, {{'id': r.id, 'x': r.x, 'y': r.y}}) ELSE kept END FROM go g JOIN r ON g.scene = r.scene AND g.query = r.query AND r.rank = g.rank + 1),
 f AS (SELECT scene, query, arg_max(kept, rank) AS kept FROM go GROUP BY scene, query), u AS (SELECT scene, query, unnest(range(1, len(kept) + 1)) AS k, kept FROM f)
SELECT scene, query, kept[k].id AS id, k - 1 AS kept_rank FROM u"""


def t5(spark, sf):
    """A budget of six for each query: up to two from the first source, the rest from the second."""
    c = candidates(spark, sf).withColumn("kind", F.when(F.col("id") % 3 == 0, "quad").otherwise("triangle"))
    w = Window.partitionBy(*QUERY, "kind").orderBy(F.desc("score"), "pos")
    c = c.withColumns({"k": F.row_number().over(w), "quads": F.least(F.lit(2), F.count_if(F.col("kind") == "quad").over(of_query()))})
    return c.where(F.when(F.col("kind") == "quad", F.col("k") <= 2).otherwise(F.col("k") <= 6 - F.col("quads"))).select(*QUERY, "id", "kind")


def t6(spark, sf):
    """Half of a budget by score, half by a hash keyed with the scene: the same on any partitioning."""
    c = candidates(spark, sf)
    top = ranked(c).where("rank < 2").select(*QUERY, "id")
    rest = ranked(c).where("rank >= 2").withColumn("h", F.md5(F.concat_ws("-", F.lit("7"), "scene", "query", "id")))
    few = rest.withColumn("k", F.row_number().over(Window.partitionBy(*QUERY).orderBy("h"))).where("k <= 2").select(*QUERY, "id")
    return top.unionByName(few)


def t7(spark, sf):
    """The four best by score, in their first order."""
    c = ranked(candidates(spark, sf)).where("rank < 4")
    return c.select(*QUERY, "id", F.row_number().over(Window.partitionBy(*QUERY).orderBy("pos")).cast("long").alias("place"))


def c15(spark, sf):
    c = candidates(spark, sf).withColumn("second", F.col("x") + F.col("y"))
    return reordered(c, "second").select(*QUERY, "id", F.col("new_rank").cast("long").alias("new_rank"), R(F.col("new_score")).alias("new_score"))


def c16(spark, sf):
    c = candidates(spark, sf).withColumn("score", R((F.col("score") + 0.5 * F.col("x") / 3000) / 1.5, 9))
    return ranked(c).select(*QUERY, "id", F.col("rank").cast("long").alias("rank"), R(F.col("score")).alias("score"))


def k26(spark, sf):
    c = candidates(spark, sf)
    a, b = F.col("x") / 3000, F.col("y") / 3000
    return c.select("id", R((F.col("score") + 0.5 * a + 0.25 * b) / 1.75).alias("fused"), R((a + b) / 2).alias("mean"), R(F.least(a, b)).alias("least"), R(F.greatest(a - 0.5, F.lit(0.0)) * F.greatest(b - 0.5, F.lit(0.0))).alias("product"))


def p1(spark, sf):
    return ranked(candidates(spark, sf)).where("rank = 0").select(*QUERY, "id", (F.col("score") >= 120).cast("int").alias("present"))


def p2(spark, sf):
    best = candidates(spark, sf).groupBy(*QUERY).agg(F.max("score").alias("score")).where("score >= 120")
    return best.groupBy("scene").agg(F.count("*").alias("live")).where("live >= 3")


def p3(spark, sf):
    return load(spark, sf, "events").orderBy("event_id").limit(2).select("event_id", "user_id")


def p4(spark, sf):
    return load(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), (F.count("doc_id") - F.count_distinct("doc_id")).alias("repeated"))


def p5(spark, sf):
    return candidates(spark, sf).where(F.col("query").isin("click", "view") & (F.col("scene") % 3 == 0)).select(*QUERY, "id")


def p6(spark, sf):
    c = candidates(spark, sf)
    inside = lambda m: F.count_if(F.col("x").between(m, 2999 - m) & F.col("y").between(m, 2999 - m)).alias(f"inside{m}")
    return c.groupBy("scene").agg(inside(20), inside(52))


def a22(spark, sf):
    near = F.col("x") < 1000
    r = ranked(candidates(spark, sf)).groupBy(*QUERY).agg(F.min(F.when(near, F.col("rank"))).alias("rank"))
    return r.groupBy("query").agg(F.count("*").alias("n"), R(F.avg((F.coalesce("rank", F.lit(99)) == 0).cast("double"))).alias("top1"), R(F.avg((F.coalesce("rank", F.lit(99)) < 3).cast("double"))).alias("top3"), R(F.avg("rank")).alias("mean_rank"))


def a34(spark, sf):
    c = candidates(spark, sf)
    g = gaps(c).groupBy("scene").agg(F.count_if(F.col("score") >= 120).alias("passing"), F.count_if(F.col("gap") < 20).alias("ambiguous"), R(F.median("score")).alias("median_score"))
    return g.join(pool(c, 8, 20.0, 60.0).groupBy("scene").agg(F.count("*").alias("pool_size")), "scene")


def a32(spark, sf):
    """Precision of the first candidates whose gap is over each of some thresholds."""
    g = gaps(candidates(spark, sf)).withColumn("good", (F.col("x") < 1500).cast("double"))
    g = g.select("scene", "gap", "good", F.explode(F.array(*(F.lit(float(t)) for t in (0, 5, 10, 20, 50)))).alias("threshold")).where("gap > threshold")
    return g.groupBy("threshold").agg(F.count("*").alias("kept"), F.count_distinct("scene").alias("scenes"), R(F.avg("good")).alias("precision"))


def sets(spark, sf):
    """Union, difference both ways and common part of the queries of two branches."""
    c = candidates(spark, sf)
    a, b = c.where("score > 100").select("scene", "query").distinct(), c.where("x > 1500 AND score > 60").select("scene", "query").distinct()
    kind = lambda df, k: df.withColumn("part", F.lit(k))
    return kind(a.union(b).distinct(), "union").unionByName(kind(a.exceptAll(b), "left")).unionByName(kind(b.exceptAll(a), "right")).unionByName(kind(a.intersect(b), "both"))


def j16(spark, sf):
    """Of two branches' best fits in each scene, the winner by score, then name, then stage."""
    c = candidates(spark, sf)
    best = lambda rows, s: rows.groupBy("scene", F.col("query").alias("name")).agg(F.max("score").alias("score")).withColumn("stage", F.lit(s))
    both = best(c.where("id % 2 = 0"), "refined").unionByName(best(c.where("id % 2 = 1"), "coarse"))
    w = Window.partitionBy("scene").orderBy(F.desc("score"), "name", "stage")
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").select("scene", "name", "stage", "score")


def stage_fits(spark, sf):
    """Of each scene's two branches, even and odd candidates, the best score of each class and two mapped places."""
    c = candidates(spark, sf).withColumn("stage", F.when(F.col("id") % 2 == 0, "refined").otherwise("coarse"))
    place = lambda f: F.struct((f("x") % 40).alias("x"), (f("y") % 40).alias("y"))
    return c.groupBy("scene", "stage", F.col("query").alias("name")).agg(F.max("score").alias("score"), F.array(place(F.min), place(F.max)).alias("nodes"))


def c12(spark, sf):
    """The class that each of the nine policies picks in each scene, and the branch it takes it from."""
    return fused_all(stage_fits(spark, sf)).select("policy", "scene", "name", "stage")


def c13(spark, sf):
    """Decisions under two policies, whole and with the baseline's places."""
    fits, first = stage_fits(spark, sf), gaps(candidates(spark, sf)).select(*QUERY, (F.col("x") % 40).alias("x"), (F.col("y") % 40).alias("y"), "score")
    moves = fits.select("scene", "stage", "name", F.explode(F.array(*(F.lit(q) for q in ("click", "view", "error")))).alias("query"), F.col("nodes")[0]["x"].alias("x"), F.col("nodes")[0]["y"].alias("y"))
    kinds = [(p, only) for p in ("rrf", "agreement_2") for only in (False, True)]
    rows = predicted_all(first, moves, fits, kinds, threshold=100.0, radius=9.0)
    return rows.select("policy", F.col("id_only").cast("int").alias("id_only"), "scene", "query", R(F.col("x")).alias("x"), R(F.col("y")).alias("y"), "member", "name")


def best_sql(where):
    return f"SELECT scene, query AS name, max(score) AS score FROM cand WHERE {where} GROUP BY ALL"


VALUES = {"rrf": "rrf", "mean_regret": "mean_regret", "min_regret": "min_regret", "agreement_1": "best + shared", "agreement_2": "best + 2 * shared", "stable_1": "best + stable"}
FITS = f"""{CAND}, fits AS (SELECT scene, CASE WHEN id % 2 = 0 THEN 'refined' ELSE 'coarse' END AS stage, query AS name, max(score) AS score, min(x) % 40 AS ax, min(y) % 40 AS ay, max(x) % 40 AS bx, max(y) % 40 AS \"by\" FROM cand GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY scene, stage ORDER BY score DESC, name) AS rank, max(score) OVER (PARTITION BY scene, stage) - score AS regret FROM fits),
 cv AS (SELECT coalesce(a.scene, b.scene) AS scene, coalesce(a.name, b.name) AS name, greatest(a.score, b.score) AS best, 1.0 / (3 + coalesce(a.rank, 49)) + 1.0 / (3 + coalesce(b.rank, 49)) AS rrf, -(coalesce(a.regret, 20.0) + coalesce(b.regret, 20.0)) / 2 AS mean_regret,
  -greatest(coalesce(a.regret, 20.0), coalesce(b.regret, 20.0)) AS min_regret, CAST(a.rank IS NOT NULL AND b.rank IS NOT NULL AS INT) AS shared,
  CAST(coalesce((sqrt((a.ax-b.ax)**2+(a.ay-b.ay)**2) + sqrt((a.bx-b.bx)**2+(a.\"by\"-b.\"by\")**2)) / 2 <= 18, false) AS INT) AS stable
  FROM (SELECT * FROM rk WHERE stage = 'refined') a FULL JOIN (SELECT * FROM rk WHERE stage = 'coarse') b ON a.scene = b.scene AND a.name = b.name),
 base AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY scene ORDER BY score DESC, name, stage) = 1), two AS (SELECT scene FROM fits GROUP BY scene HAVING count(DISTINCT stage) = 2)"""
PICKED = [("baseline", "SELECT scene, name, stage FROM base")]
PICKED += [(p, f"SELECT scene, name, stage FROM fits WHERE stage = '{p}' QUALIFY row_number() OVER (PARTITION BY scene ORDER BY score DESC, name) = 1") for p in ("refined", "coarse")]
PICKED += [(p, f"SELECT f.scene, f.name, f.stage FROM fits f JOIN (SELECT scene, name FROM cv WHERE scene IN (FROM two) QUALIFY row_number() OVER (PARTITION BY scene ORDER BY round({v}, 9) DESC, name) = 1) c ON f.scene = c.scene AND f.name = c.name QUALIFY row_number() OVER (PARTITION BY f.scene ORDER BY score DESC, stage) = 1") for p, v in VALUES.items()]
PICKS = "own AS (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, * FROM ({q})" for p, q in PICKED) + "), picks AS (FROM own UNION ALL SELECT policy, scene, name, stage FROM base, (SELECT unnest([" + ", ".join(f"'{p}'" for p, _ in PICKED) + "]) AS policy) p WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.policy = p.policy AND own.scene = base.scene))"
C13_SQL = f"""WITH {FITS}, {PICKS}, fst AS (SELECT scene, query, x % 40 AS x, y % 40 AS y, score FROM cand QUALIFY row_number() {OVER} = 1), k AS (SELECT * FROM (VALUES ('rrf'), ('agreement_2')) p(policy), (VALUES (0), (1)) i(id_only)),
 j AS (SELECT k.policy, k.id_only, t.scene, t.query, t.score >= 100 AS present, n.name, CASE WHEN t.query IN ('click', 'view', 'error') THEN f.ax ELSE t.x END AS x, CASE WHEN t.query IN ('click', 'view', 'error') THEN f.ay ELSE t.y END AS y, f.ax, f.ay, f.bx, f.\"by\"
  FROM k CROSS JOIN fst t JOIN picks n ON n.policy = k.policy AND n.scene = t.scene JOIN picks b ON b.policy = CASE WHEN id_only = 1 THEN 'baseline' ELSE k.policy END AND b.scene = t.scene JOIN fits f ON f.scene = t.scene AND f.stage = b.stage AND f.name = b.name)
SELECT policy, id_only, scene, query, round(CASE WHEN present THEN x END, 6) AS x, round(CASE WHEN present THEN y END, 6) AS y, CASE WHEN present THEN CAST(least((x-ax)**2+(y-ay)**2, (x-bx)**2+(y-\"by\")**2) < 81 AS INT) END AS member, name FROM j"""


GAPS = f"g AS (SELECT * FROM (SELECT *, score - lead(score) {OVER} AS gap, row_number() {OVER} AS k FROM cand) WHERE k = 1)"
POOL = f"p AS (SELECT * FROM (SELECT *, max(CASE WHEN rank = 0 THEN score END) OVER w AS best, max(CASE WHEN rank = 1 THEN score END) OVER w AS second FROM r WINDOW w AS (PARTITION BY scene, query)) WHERE rank < CASE WHEN coalesce(best - second < 20.0, false) THEN 8 ELSE 1 END AND (rank = 0 OR score >= best - 60.0))"
GATE = "m AS (SELECT *, CASE WHEN coalesce(best - second < 20.0, false) THEN 8 ELSE 1 END AS most FROM (SELECT *, count(*) FILTER (x < 600) OVER w AS n, max(score) OVER w AS best, max(CASE WHEN rank = 1 THEN score END) OVER w AS second FROM r WINDOW w AS (PARTITION BY scene, query)))"
QUERIES = {
    "w1_rank": (w1, f"WITH {RANKED} SELECT scene, query, id, rank FROM r"),
    "w2_gap": (w2, f"WITH {CAND}, {GAPS} SELECT scene, query, id, round(coalesce(gap, -1.0), 6) AS gap FROM g"),
    "w3_w4_c4_pool": (c4, f"WITH {RANKED}, {POOL} SELECT scene, query, id, rank FROM p"),
    "w5_eligible_first": (w5, f"WITH {RANKED}, {GATE}, o AS (SELECT *, row_number() OVER (PARTITION BY scene, query ORDER BY CASE WHEN x < 600 THEN 0 ELSE 1 END, rank) - 1 AS place FROM m WHERE x < 600 OR rank < most) SELECT scene, query, id, place AS rank FROM o WHERE place < CASE WHEN n > 0 THEN greatest(most, least(8, n + 1)) ELSE most END AND (place = 0 OR score >= best - 60.0)"),
    "c10_pool_by_calibration": (c10, f"WITH {RANKED}, {GATE}, o AS (SELECT *, row_number() OVER (PARTITION BY scene, query ORDER BY y DESC, pos) - 1 AS place FROM m WHERE rank < most) SELECT scene, query, id, place AS rank FROM o WHERE place = 0 OR score >= best - 60.0"),
    "w6_arg_extremes": (w6, f"WITH {CAND} SELECT scene, query, first(id ORDER BY score DESC, pos) AS first_max, first(id ORDER BY score, pos) AS first_min FROM cand GROUP BY scene, query"),
    "w7_w8_class_rank": (w7, f"WITH {CAND}, m AS (SELECT scene, query, max(score) AS score FROM cand GROUP BY ALL) SELECT scene, query, row_number() OVER w AS class_rank, round(coalesce(score - lead(score) OVER w, -1.0), 6) AS gap FROM m WINDOW w AS (PARTITION BY scene ORDER BY score DESC, query)"),
    "w9_truth_rank": (w9, f"WITH {RANKED} SELECT scene, query, min(rank) FILTER (x < 1500 AND y < 1500) AS rank, min(rank) FILTER (x < 1500 AND y < 1500 AND rank < 10) AS kept_rank FROM r GROUP BY ALL"),
    "w10_percentile_of_sample": (w10, "WITH ref AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY event_type) SELECT event_id, round(coalesce(len(list_filter(v, lambda q: q < value)) / n, 0.0), 6) AS share FROM events LEFT JOIN ref USING (event_type)"),
    "w11_s16_first_duplicate": (w11, "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc, count(*) OVER (PARTITION BY text) AS copies FROM documents"),
    "w12_repeats": (w12, "SELECT event_id, count(*) OVER (PARTITION BY user_id, value) - 1 AS repeats FROM events"),
    "w13_regret": (w13, f"WITH {CAND} SELECT scene, query, id, round(max(score) OVER (PARTITION BY scene, query) - score, 6) AS regret, round(1.0 / (3.0 + rank() OVER (PARTITION BY scene, query ORDER BY score DESC)), 6) AS rr FROM cand"),
    "t1_top_k": (t1, f"WITH {RANKED} SELECT scene, query, id, rank, score FROM r WHERE rank < 3"),
    "t2_suppression": (t2, T2_SQL),
    "t5_budgets": (t5, f"WITH {CAND}, k AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'quad' ELSE 'triangle' END AS kind FROM cand), n AS (SELECT *, row_number() OVER (PARTITION BY scene, query, kind ORDER BY score DESC, pos) AS k, least(2, count(*) FILTER (kind = 'quad') OVER (PARTITION BY scene, query)) AS quads FROM k) SELECT scene, query, id, kind FROM n WHERE CASE WHEN kind = 'quad' THEN k <= 2 ELSE k <= 6 - quads END"),
    "t6_keyed_sample": (t6, f"WITH {RANKED}, s AS (SELECT *, row_number() OVER (PARTITION BY scene, query ORDER BY md5(concat_ws('-', '7', scene, query, id))) AS k FROM r WHERE rank >= 2) SELECT scene, query, id FROM r WHERE rank < 2 UNION ALL SELECT scene, query, id FROM s WHERE k <= 2"),
    "t7_cap_in_order": (t7, f"WITH {RANKED} SELECT scene, query, id, row_number() OVER (PARTITION BY scene, query ORDER BY pos) AS place FROM r WHERE rank < 4"),
    "c15_tie_break": (c15, f"WITH {RANKED}, s AS (SELECT *, row_number() OVER (PARTITION BY scene, query ORDER BY x + y DESC, pos) - 1 AS new_rank FROM r) SELECT s.scene, s.query, s.id, s.new_rank, round(r.score, 6) AS new_score FROM s JOIN r ON s.scene = r.scene AND s.query = r.query AND s.new_rank = r.rank"),
    "c16_rescored": (c16, f"WITH {CAND}, s AS (SELECT scene, query, id, pos, round((score + 0.5 * x / 3000) / 1.5, 9) AS score FROM cand) SELECT scene, query, id, row_number() {OVER} - 1 AS rank, round(score, 6) AS score FROM s"),
    "k26_k27_fusion": (k26, f"WITH {CAND} SELECT id, round((score + 0.5 * (x / 3000) + 0.25 * (y / 3000)) / 1.75, 6) AS fused, round((x / 3000 + y / 3000) / 2, 6) AS mean, round(least(x / 3000, y / 3000), 6) AS least, round(greatest(x / 3000 - 0.5, 0.0) * greatest(y / 3000 - 0.5, 0.0), 6) AS product FROM cand"),
    "p1_presence": (p1, f"WITH {RANKED} SELECT scene, query, id, CAST(score >= 120 AS INT) AS present FROM r WHERE rank = 0"),
    "p2_live_queries": (p2, f"WITH {CAND}, m AS (SELECT scene, query, max(score) AS score FROM cand GROUP BY ALL HAVING max(score) >= 120) SELECT scene, count(*) AS live FROM m GROUP BY scene HAVING count(*) >= 3"),
    "p3_smoke_limit": (p3, "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 2"),
    "p4_uniqueness": (p4, "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(doc_id) - count(DISTINCT doc_id) AS repeated FROM documents"),
    "p5_selection": (p5, f"WITH {CAND} SELECT scene, query, id FROM cand WHERE query IN ('click', 'view') AND scene % 3 = 0"),
    "p6_border_margin": (p6, f"WITH {CAND} SELECT scene, " + ", ".join(f"count(*) FILTER (x BETWEEN {m} AND {2999 - m} AND y BETWEEN {m} AND {2999 - m}) AS inside{m}" for m in (20, 52)) + " FROM cand GROUP BY scene"),
    "a22_top_ranks": (a22, f"WITH {RANKED}, m AS (SELECT scene, query, min(rank) FILTER (x < 1000) AS rank FROM r GROUP BY ALL) SELECT query, count(*) AS n, round(avg(CASE WHEN rank = 0 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN rank < 3 THEN 1.0 ELSE 0.0 END), 6) AS top3, round(avg(rank), 6) AS mean_rank FROM m GROUP BY query"),
    "a32_confidence_curve": (a32, f"WITH {CAND}, {GAPS} SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS kept, count(DISTINCT scene) AS scenes, round(avg(CASE WHEN x < 1500 THEN 1.0 ELSE 0.0 END), 6) AS precision FROM g, (VALUES (0), (5), (10), (20), (50)) t(threshold) WHERE coalesce(gap, 1e300) > threshold GROUP BY threshold"),
    "a34_pool_statistics": (a34, f"WITH {RANKED}, {POOL}, {GAPS} SELECT a.scene, passing, ambiguous, median_score, pool_size FROM (SELECT scene, count(*) FILTER (score >= 120) AS passing, count(*) FILTER (gap < 20) AS ambiguous, round(median(score), 6) AS median_score FROM g GROUP BY scene) a JOIN (SELECT scene, count(*) AS pool_size FROM p GROUP BY scene) b ON a.scene = b.scene"),
    "set_operations": (sets, f"WITH {CAND}, a AS (SELECT DISTINCT scene, query FROM cand WHERE score > 100), b AS (SELECT DISTINCT scene, query FROM cand WHERE x > 1500 AND score > 60) SELECT *, 'union' AS part FROM (FROM a UNION FROM b) UNION ALL SELECT *, 'left' FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'both' FROM (FROM a INTERSECT FROM b)"),
    "j16_branch_winner": (j16, f"WITH {CAND}, u AS (SELECT *, 'refined' AS stage FROM ({best_sql('id % 2 = 0')}) UNION ALL SELECT *, 'coarse' FROM ({best_sql('id % 2 = 1')})), k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, name, stage) AS k FROM u) SELECT scene, name, stage, score FROM k WHERE k = 1"),
    "c12_branch_fusion": (c12, f"WITH {FITS}, {PICKS} SELECT policy, scene, name, stage FROM picks"),
    "c13_policy_prediction": (c13, C13_SQL),
}
