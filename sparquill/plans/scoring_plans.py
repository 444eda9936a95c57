"""Queries on scores of predictions."""

from pyspark.sql import functions as F

from ..functions.columns import bucket, clip, distance, distance_reward
from ..operators.analysis import exact_quantiles
from ..operators.scoring import failure_category, greedy_recovery, scene_scores, two_class_f1, weighted
from ..operators.geometry import assigned
from ..operators.ranking import QUERY, ranked, suppressed
from ..sources.tables import DEC, PTS, candidates, decisions, load, points
from .ranking_plans import RANKED

R = lambda c, n=6: F.round(c, n)
REWARD = "greatest(0.0, least(1.0, (36.0 - d) / 24.0))"
D = "sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))"


def f1_sql(t, p):
    one = lambda a, b: f"CASE WHEN count(*) FILTER ({a}) + count(*) FILTER ({b}) = 0 THEN 1.0 ELSE 2.0 * count(*) FILTER (({a}) AND ({b})) / (count(*) FILTER ({a}) + count(*) FILTER ({b})) END"
    return f"({one(t, p)} + {one(f'NOT ({t})', f'NOT ({p})')}) / 2"


SCENES = f"""{DEC}, sc AS (SELECT scene, {f1_sql('present', 'predicted')} AS presence,
 coalesce(avg(CASE WHEN present THEN CASE WHEN predicted THEN greatest(0.0, least(1.0, (36.0 - {D}) / 24.0)) ELSE 0.0 END END), 1.0) AS localization,
 avg(CASE WHEN truth_class = class THEN 1.0 ELSE 0.0 END) AS identification, count(*) AS n FROM dec GROUP BY scene)"""


def a1(spark, sf):
    return decisions(spark, sf).agg(R(two_class_f1(F.col("present"), F.col("predicted"))).alias("presence_f1"), F.count("*").alias("n"))


def a2(spark, sf):
    d = distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    return decisions(spark, sf).select("query", R(distance_reward(d)).alias("reward"))


def a3(spark, sf):
    return scene_scores(decisions(spark, sf), ["scene"]).select("scene", R(F.col("localization")).alias("localization"))


def a4(spark, sf):
    p = points(spark, sf)
    truth = p.where("id % 2 = 0").select("scene", "id", "x", "y")
    return greedy_recovery(truth, p.where("id % 2 = 1"), ["scene"]).select("scene", "n_figure", R(F.col("recovery")).alias("recovery"))


def greedy_sql(truth, found, add):
    """CTEs that end in g (scene, total): over the pairs of truth and found (scene, id, x, y) within 36 pixels, nearest first and one to
    one, the sum of ``add``, an expression of d."""
    return f"""tr AS ({truth}), fo AS ({found}), near AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY d, i, j) AS k FROM (SELECT a.scene, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, a.id AS i, b.id AS j
 FROM tr a JOIN fo b ON a.scene = b.scene AND abs(a.x-b.x) < 36 AND abs(a.y-b.y) < 36) WHERE d < 36),
 go AS (SELECT scene, 0 AS k, CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS vs, CAST(0 AS DOUBLE) AS total FROM (SELECT DISTINCT scene FROM tr)
 UNION ALL SELECT g.scene, g.k + 1, CASE WHEN list_contains(us, i) OR list_contains(vs, j) THEN us ELSE list_append(us, i) END,
 CASE WHEN list_contains(us, i) OR list_contains(vs, j) THEN vs ELSE list_append(vs, j) END,
 total + CASE WHEN list_contains(us, i) OR list_contains(vs, j) THEN 0.0 ELSE {add} END FROM go g JOIN near n ON g.scene = n.scene AND n.k = g.k + 1),
 g AS (SELECT scene, arg_max(total, k) AS total FROM go GROUP BY scene)"""


A4_SQL = f"""WITH RECURSIVE {PTS}, {greedy_sql('SELECT scene, id, x, y FROM pts WHERE id % 2 = 0', 'SELECT scene, id, x, y FROM pts WHERE id % 2 = 1', REWARD)}
SELECT t.scene, n_figure, round(total / n_figure, 6) AS recovery FROM (SELECT scene, count(*) AS n_figure FROM tr GROUP BY scene) t JOIN g ON t.scene = g.scene"""


def figures(d):
    """The figure's true places and what is called present, of decisions."""
    truth = d.where("present AND truth_class = 0").select("scene", F.col("query").alias("id"), F.col("tx").alias("x"), F.col("ty").alias("y"))
    return truth, d.where("predicted").select("scene", F.col("query").alias("id"), "x", "y")


def scored(spark, sf):
    """The four parts of each scene's score and the score."""
    d = decisions(spark, sf)
    s = scene_scores(d, ["scene"]).join(greedy_recovery(*figures(d), ["scene"]), "scene", "left").withColumn("recovery", F.coalesce("recovery", F.lit(1.0)))
    return s.withColumn("score", weighted(*(F.col(c) for c in ("presence", "localization", "recovery", "identification"))))


FIGURE = "SELECT scene, query AS id, tx AS x, ty AS y FROM dec WHERE present AND truth_class = 0", "SELECT scene, query AS id, x, y FROM dec WHERE predicted"


def a5(spark, sf):
    return scene_scores(decisions(spark, sf), ["scene"]).select("scene", "n", R(F.col("identification")).alias("identification"))


def a6(spark, sf):
    return scored(spark, sf).select("scene", R(F.col("recovery")).alias("recovery"), R(F.col("score")).alias("score"))


def a7(spark, sf):
    """Means over scenes and the least score. Scenes count in whole units of 1e-12, so that no order of adding matters, and are rounded half up as whole numbers."""
    unit = lambda c: F.round(F.col(c) * 1e12).cast("long")
    sums = scored(spark, sf).agg(F.count("*").alias("n"), *(F.sum(unit(c)).alias(f"mean_{c}") for c in MEANS), F.min(unit("score")).alias("worst"))
    rounded = lambda c, n: F.expr(f"(`{c}` + {n} * 500000) div ({n} * 1000000)") / 1e6
    return sums.select(*(rounded(f"mean_{c}", "n").alias(f"mean_{c}") for c in MEANS), rounded("worst", "1").alias("worst"))


MEANS = ("presence", "localization", "recovery", "identification", "score")


def a31(spark, sf):
    """Of each scene's figure, how many places a present prediction recovers within 12 pixels, one to one, and how many are left."""
    d = decisions(spark, sf)
    truth, found = figures(d)
    n = truth.groupBy("scene").agg(F.count("*").alias("n_figure"))
    hit = assigned(truth, found, ["scene"], 36.0).groupBy("scene").agg(F.count_if(F.col("d") <= 12).alias("matched"))
    return n.join(hit, "scene", "left").select("scene", F.coalesce("matched", F.lit(0)).alias("matched"), (F.col("n_figure") - F.coalesce("matched", F.lit(0))).alias("unmatched"))


def a20(spark, sf):
    d = distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    rows = decisions(spark, sf).select("scene", failure_category(F.col("present"), F.col("predicted"), d, d < 24).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("scene").alias("scenes"))


CATEGORY = f"""CASE WHEN NOT present AND NOT predicted THEN 'correct_absent' WHEN NOT present THEN 'false_present' WHEN NOT predicted THEN 'false_absent'
 WHEN {D} <= 12 THEN 'correct_location' WHEN {D} < 24 THEN 'wrong_appearance_ranking' ELSE 'no_correct_verified_alternative' END"""


def a8(spark, sf):
    d = distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    rows = decisions(spark, sf).withColumns({"d": d, "category": failure_category(F.col("present"), F.col("predicted"), d, d < 24)})
    q = exact_quantiles(rows, ["category"], "d", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    n = rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("scene").alias("scenes"), R(F.avg((F.col("d") <= 12).cast("double"))).alias("rate12"))
    return n.join(q, "category").select("category", "n", "scenes", *(R(F.col(c)).alias(c) for c in ("p10", "p50", "p90")), "rate12")


def a9(spark, sf):
    rows = decisions(spark, sf).withColumn("strip", bucket(F.col("query") % 20, [(3, "2-3"), (9, "4-9")], "10+"))
    out = rows.groupingSets([["scene"], ["strip"], ["present"]], "scene", "strip", "present").agg(F.count("*").alias("n"), R(F.avg("x")).alias("mean_x"))
    return out.select("scene", "strip", F.col("present").cast("int").alias("present"), "n", "mean_x")


def near_truth(spark, sf):
    """Candidates with rank, and the distance to their query's true place: five pixels from the candidate that comes at place scene mod 7."""
    c = ranked(candidates(spark, sf))
    t = c.where(F.col("pos") == F.col("scene") % 7).select(*QUERY, (F.col("x") + 3).alias("tx"), (F.col("y") + 4).alias("ty"))
    return c.join(t, QUERY).withColumn("d", distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")))


def a23(spark, sf):
    """Shares of a scene's queries whose first candidate, or one of the first twenty, is within 12 pixels; the median rank of the first
    that is; the mean reward as it is and with the nearest of twenty in the first one's place, and what that would gain."""
    first = near_truth(spark, sf).where("rank < 20").groupBy(*QUERY).agg(F.min(F.when(F.col("d") <= 12, F.col("rank"))).alias("rank"), F.min(F.when(F.col("rank") == 0, F.col("d"))).alias("d0"), F.min("d").alias("best"))
    mean = lambda c: F.avg(c)
    return first.groupBy("scene").agg(
        F.count("*").alias("n"), R(mean(F.coalesce((F.col("rank") == 0).cast("double"), F.lit(0.0)))).alias("hit1"), R(mean(F.col("rank").isNotNull().cast("double"))).alias("hit20"), F.coalesce(F.median("rank"), F.lit(-1.0)).alias("median_rank"),
        R(mean(distance_reward(F.col("d0")))).alias("as_is"), R(mean(distance_reward(F.col("best")))).alias("oracle"), R(mean(distance_reward(F.col("best")) - distance_reward(F.col("d0")))).alias("headroom"),
    )


def c18(spark, sf):
    """Where each query's true place is lost: never proposed, suppressed by a better one within 400 pixels, cut beyond five, outranked, or found."""
    c = near_truth(spark, sf)
    # the first five are those of the thousand that come first: one suppression gives both
    kept = suppressed(candidates(spark, sf), 400.0, 1_000).select(*QUERY, "id", F.lit(1).alias("survives"), F.when(F.col("kept_rank") < 5, F.col("kept_rank")).alias("kept_rank"))
    rows = c.where("d <= 12").join(kept, [*QUERY, "id"], "left").groupBy(*QUERY).agg(F.min("rank").alias("rank"), F.max("survives").alias("survives"), F.min("kept_rank").alias("kept"))
    every = candidates(spark, sf).select(*QUERY).distinct().join(rows, QUERY, "left")
    stage = F.when(F.col("rank").isNull(), "not proposed").when(F.col("survives").isNull(), "suppressed").when(F.col("kept").isNull(), "cut").when(F.col("kept") > 0, "outranked").otherwise("found")
    return every.groupBy("scene", stage.alias("stage")).agg(F.count("*").alias("n"))


def a24(spark, sf):
    q = exact_quantiles(decisions(spark, sf), ["present"], "x", {"median_x": 0.5, "p10": 0.1, "p90": 0.9})
    return q.select(F.col("present").cast("int").alias("present"), *(R(F.col(c)).alias(c) for c in ("median_x", "p10", "p90")))


def a27(spark, sf):
    p = F.avg((F.col("truth_class") == F.col("class")).cast("double"))
    return decisions(spark, sf).groupBy("scene").agg(R(p).alias("acc"), R(F.sqrt(p * (1 - p) / F.count("*"))).alias("se"))


def a33(spark, sf):
    return decisions(spark, sf).groupBy("scene").agg(R(F.lit(0.3) / F.count("*"), 9).alias("quantum"), R(F.lit(0.25) / F.greatest(F.lit(1), F.count_if("present")), 9).alias("figure_quantum"))


def s17(spark, sf):
    t = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return t.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.expr("quality = 1 AND toxic = 0")).alias("figure"), F.count_if(F.expr("quality = 1 AND toxic = 1")).alias("off"), F.count_if(F.expr("quality = 0")).alias("absent"))


def c23(spark, sf):
    """Presence F1 of each threshold on length and the best one; the few thresholds go to each row as an array."""
    steps = F.explode(F.sequence(F.lit(100), F.lit(3000), F.lit(100)))
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").select("n_chars", "quality", steps.alias("threshold"))
    return d.groupBy("threshold").agg(R(two_class_f1(F.col("quality") == 1, F.col("n_chars") >= F.col("threshold"))).alias("f1"))


def c22(spark, sf):
    """For each source the threshold with the best mean F1 over the other sources (smallest of ties), and its own F1."""
    steps = F.explode(F.sequence(F.lit(250), F.lit(1500), F.lit(250)))
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").select("source", "n_chars", "quality", steps.alias("threshold"))
    own = d.groupBy("source", "threshold").agg(two_class_f1(F.col("quality") == 1, F.col("n_chars") >= F.col("threshold")).alias("f1"))
    total = own.groupBy("threshold").agg(F.sum("f1").alias("s"), F.count("*").alias("k"))
    dev = own.join(F.broadcast(total), "threshold").where("k > 1").withColumn("dev", F.round((F.col("s") - F.col("f1")) / (F.col("k") - 1), 9))
    best = dev.groupBy("source").agg(F.min(F.struct((-F.col("dev")).alias("o"), F.col("threshold"), F.col("f1"))).alias("b"))
    return best.select("source", F.col("b.threshold").alias("threshold"), R(-F.col("b.o")).alias("dev_mean"), R(F.col("b.f1")).alias("held_out"))


def p11(spark, sf):
    t = load(spark, sf, "labels")
    return t.select("doc_id", F.when(F.col("quality") == 0, "absent").when(F.col("toxic") == 1, "off-figure").otherwise("figure").alias("category"))


def p13(spark, sf):
    d = load(spark, sf, "documents")
    words = bucket(F.col("n_chars"), [(300, "2-3"), (1200, "4-6")], "7+")
    return d.groupBy(words.alias("size"), bucket(F.col("doc_id") % 12, [(4, "1-4"), (8, "5-8")], "9+").alias("issued")).agg(F.count("*").alias("n"))


def a12(spark, sf):
    """Whether each language's median length lies outside the tenth to ninetieth percentile of the other tables' lengths."""
    d = load(spark, sf, "documents")
    ref = exact_quantiles(load(spark, sf, "pages").select(F.length("html").alias("n")), [], "n", {"lo": 0.1, "hi": 0.9})
    mid = exact_quantiles(d, ["lang"], "n_chars", {"mid": 0.5})
    return mid.crossJoin(F.broadcast(ref)).select("lang", R(F.col("mid")).alias("mid"), ((F.col("mid") < F.col("lo")) | (F.col("mid") > F.col("hi"))).cast("int").alias("outside"))


def a14_clip(spark, sf):
    return decisions(spark, sf).select("query", clip(F.col("x"), 20, 2980).alias("x"), clip(F.col("y"), 20, 2980).alias("y"))


SCORED = f"""{SCENES}, {greedy_sql(*FIGURE, REWARD)}, s AS (SELECT *, 0.25 * presence + 0.2 * localization + 0.25 * recovery + 0.3 * identification AS score FROM
 (SELECT sc.*, coalesce(total / n_figure, 1.0) AS recovery FROM sc LEFT JOIN g ON sc.scene = g.scene LEFT JOIN (SELECT scene, count(*) AS n_figure FROM tr GROUP BY scene) f ON sc.scene = f.scene))"""
A7_SQL = f"""WITH RECURSIVE {SCORED}, u AS (SELECT count(*) AS n, {', '.join(f'sum(CAST(round({c} * 1e12) AS BIGINT)) AS {c}' for c in MEANS)}, min(CAST(round(score * 1e12) AS BIGINT)) AS worst FROM s)
SELECT {', '.join(f'CAST(({c} + n * 500000) // (n * 1000000) AS DOUBLE) / 1e6 AS mean_{c}' for c in MEANS)}, CAST((worst + 500000) // 1000000 AS DOUBLE) / 1e6 AS worst FROM u"""
NEAR_TRUTH = f"{RANKED}, t AS (SELECT scene, query, x + 3 AS tx, y + 4 AS ty FROM r WHERE pos = scene % 7), n AS (SELECT r.*, {D} AS d FROM r JOIN t ON r.scene = t.scene AND r.query = t.query)"
C18_SQL = f"""WITH RECURSIVE {NEAR_TRUTH}, go AS (SELECT scene, query, CAST(0 AS BIGINT) AS rank, [{{'id': id, 'x': x, 'y': y}}] AS kept FROM r WHERE rank = 0
 UNION ALL SELECT g.scene, g.query, r.rank, CASE WHEN len(list_filter(kept, lambda q: sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)) < 400.0)) = 0
 THEN list_append(kept, {{'id': r.id, 'x': r.x, 'y': r.y}}) ELSE kept END FROM go g JOIN r ON g.scene = r.scene AND g.query = r.query AND r.rank = g.rank + 1),
 f AS (SELECT scene, query, arg_max(kept, rank) AS kept FROM go GROUP BY scene, query), u AS (SELECT scene, query, unnest(range(1, len(kept) + 1)) AS k, kept FROM f), v AS (SELECT scene, query, kept[k].id AS id, k - 1 AS place FROM u),
 m AS (SELECT n.scene, n.query, min(rank) AS rank, min(place) AS place FROM n LEFT JOIN v ON n.scene = v.scene AND n.query = v.query AND n.id = v.id WHERE d <= 12 GROUP BY ALL),
 w AS (SELECT q.scene, CASE WHEN rank IS NULL THEN 'not proposed' WHEN place IS NULL THEN 'suppressed' WHEN place >= 5 THEN 'cut' WHEN place > 0 THEN 'outranked' ELSE 'found' END AS stage FROM (SELECT DISTINCT scene, query FROM cand) q LEFT JOIN m ON q.scene = m.scene AND q.query = m.query)
SELECT scene, stage, count(*) AS n FROM w GROUP BY ALL"""
QUERIES = {
    "a1_presence_f1": (a1, f"WITH {DEC} SELECT round({f1_sql('present', 'predicted')}, 6) AS presence_f1, count(*) AS n FROM dec"),
    "a2_distance_reward": (a2, f"WITH {DEC}, r AS (SELECT query, {D} AS d FROM dec) SELECT query, round({REWARD}, 6) AS reward FROM r"),
    "a3_localization": (a3, f"WITH {SCENES} SELECT scene, round(localization, 6) AS localization FROM sc"),
    "a4_greedy_recovery": (a4, A4_SQL),
    "a5_identification": (a5, f"WITH {SCENES} SELECT scene, n, round(identification, 6) AS identification FROM sc"),
    "a6_weighted_score": (a6, f"WITH RECURSIVE {SCORED} SELECT scene, round(recovery, 6) AS recovery, round(score, 6) AS score FROM s"),
    "a7_macro_mean": (a7, A7_SQL),
    "a31_recovery_attribution": (a31, f"WITH RECURSIVE {DEC}, {greedy_sql(*FIGURE, 'CASE WHEN d <= 12 THEN 1.0 ELSE 0.0 END')} SELECT scene, CAST(total AS BIGINT) AS matched, n - CAST(total AS BIGINT) AS unmatched FROM g JOIN (SELECT scene, count(*) AS n FROM tr GROUP BY scene) USING (scene)"),
    "a8_category_rollup": (a8, f"WITH {DEC}, r AS (SELECT *, {D} AS d, {CATEGORY} AS category FROM dec) SELECT category, count(*) AS n, count(DISTINCT scene) AS scenes, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(avg(CASE WHEN d <= 12 THEN 1.0 ELSE 0.0 END), 6) AS rate12 FROM r GROUP BY category"),
    "a9_strata": (a9, f"WITH {DEC}, r AS (SELECT *, CASE WHEN query % 20 <= 3 THEN '2-3' WHEN query % 20 <= 9 THEN '4-9' ELSE '10+' END AS strip FROM dec) SELECT scene, strip, CAST(present AS INT) AS present, count(*) AS n, round(avg(x), 6) AS mean_x FROM r GROUP BY GROUPING SETS ((scene), (strip), (present))"),
    "a12_realism_flag": (a12, "WITH ref AS (SELECT quantile_cont(length(html), 0.1) AS lo, quantile_cont(length(html), 0.9) AS hi FROM pages), m AS (SELECT lang, quantile_cont(n_chars, 0.5) AS mid FROM documents GROUP BY lang) SELECT lang, round(mid, 6) AS mid, CAST(mid < lo OR mid > hi AS INT) AS outside FROM m, ref"),
    "a20_failure_taxonomy": (a20, f"WITH {DEC} SELECT {CATEGORY} AS category, count(*) AS n, count(DISTINCT scene) AS scenes FROM dec GROUP BY 1"),
    "a23_hit_rates": (a23, f"WITH {NEAR_TRUTH}, f AS (SELECT scene, query, min(rank) FILTER (d <= 12) AS rank, min(d) FILTER (rank = 0) AS d0, min(d) AS best FROM n WHERE rank < 20 GROUP BY ALL), w AS (SELECT *, greatest(0.0, least(1.0, (36.0 - d0) / 24.0)) AS r0, greatest(0.0, least(1.0, (36.0 - best) / 24.0)) AS r1 FROM f) SELECT scene, count(*) AS n, round(avg(CASE WHEN rank = 0 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit20, coalesce(CAST(median(rank) AS DOUBLE), -1.0) AS median_rank, round(avg(r0), 6) AS as_is, round(avg(r1), 6) AS oracle, round(avg(r1 - r0), 6) AS headroom FROM w GROUP BY scene"),
    "c18_stage_trace": (c18, C18_SQL),
    "a24_separation": (a24, f"WITH {DEC} SELECT CAST(present AS INT) AS present, round(median(x), 6) AS median_x, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90 FROM dec GROUP BY 1"),
    "a27_proportion_se": (a27, f"WITH {DEC}, p AS (SELECT scene, avg(CASE WHEN truth_class = class THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM dec GROUP BY scene) SELECT scene, round(p, 6) AS acc, round(sqrt(p * (1 - p) / n), 6) AS se FROM p"),
    "a33_resolving_power": (a33, f"WITH {DEC} SELECT scene, round(0.3 / count(*), 9) AS quantum, round(0.25 / greatest(1, count(*) FILTER (present)), 9) AS figure_quantum FROM dec GROUP BY scene"),
    "s17_label_summary": (s17, "SELECT source, count(*) AS total, count(*) FILTER (quality = 1 AND toxic = 0) AS figure, count(*) FILTER (quality = 1 AND toxic = 1) AS off, count(*) FILTER (quality = 0) AS absent FROM labels JOIN documents USING (doc_id) GROUP BY source"),
    "c22_leave_one_out": (c22, f"WITH d AS (SELECT source, n_chars, quality, threshold FROM documents JOIN labels USING (doc_id), range(250, 1501, 250) r(threshold)), own AS (SELECT source, threshold, {f1_sql('quality = 1', 'n_chars >= threshold')} AS f1 FROM d GROUP BY ALL), dev AS (SELECT a.source, a.threshold, a.f1, round((SELECT avg(b.f1) FROM own b WHERE b.threshold = a.threshold AND b.source <> a.source), 9) AS dev FROM own a), best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dev DESC, threshold) AS k FROM dev) SELECT source, CAST(threshold AS INT) AS threshold, round(dev, 6) AS dev_mean, round(f1, 6) AS held_out FROM best WHERE k = 1"),
    "c23_threshold_sweep": (c23, f"WITH d AS (SELECT n_chars, quality, threshold FROM documents JOIN labels USING (doc_id), range(100, 3001, 100) r(threshold)) SELECT CAST(threshold AS INT) AS threshold, round({f1_sql('quality = 1', 'n_chars >= threshold')}, 6) AS f1 FROM d GROUP BY threshold"),
    "p11_category": (p11, "SELECT doc_id, CASE WHEN quality = 0 THEN 'absent' WHEN toxic = 1 THEN 'off-figure' ELSE 'figure' END AS category FROM labels"),
    "p13_buckets": (p13, "SELECT CASE WHEN n_chars <= 300 THEN '2-3' WHEN n_chars <= 1200 THEN '4-6' ELSE '7+' END AS size, CASE WHEN doc_id % 12 <= 4 THEN '1-4' WHEN doc_id % 12 <= 8 THEN '5-8' ELSE '9+' END AS issued, count(*) AS n FROM documents GROUP BY 1, 2"),
    "k_clip": (a14_clip, f"WITH {DEC} SELECT query, greatest(20.0, least(2980.0, x)) AS x, greatest(20.0, least(2980.0, y)) AS y FROM dec"),
}
