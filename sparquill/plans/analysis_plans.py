"""Queries on result tables: tests, moves, sources and sinks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import binomial_tail, bucket, format_cell, parse_cell
from ..operators.analysis import exact_quantiles, grouped_auc, interpolated, wasserstein
from ..operators.ranking import QUERY
from ..operators.scoring import scene_scores
from ..sources.results import submission, truth_cells, violations
from ..sources.tables import CAND, DEC, candidates, decisions, load
from .scoring_plans import SCENES

R = lambda c, n=6: F.round(c, n)


def a10(spark, sf):
    d = load(spark, sf, "documents")
    return d.cube("lang", "source").agg(F.count("*").alias("n"), R(F.avg("n_chars")).alias("mean"))


def a11(spark, sf):
    e = load(spark, sf, "lineitem")
    long = e.unpivot([], [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], "field", "v")
    q = exact_quantiles(long, ["field"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.select("field", *(R(F.col(n)).alias(n) for n in ("p10", "p50", "p90")))


def a25(spark, sf):
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").select("lang", "n_chars", (F.col("quality") == 1).alias("good"))
    return grouped_auc(d, ["lang"], "n_chars", "good").where("positives > 0 AND negatives > 0").select("lang", R(F.col("auc")).alias("auc"), "positives", "negatives")


def a26(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(R(F.corr("l_quantity", "l_extendedprice")).alias("r"), F.count("*").alias("n"))


def a28(spark, sf):
    """Queries that one rule gets right and the other does not, by scene, and the exact two-sided probability of such a split."""
    d = decisions(spark, sf)
    a, b = F.col("present") == F.col("predicted"), F.col("present") == (F.col("query") % 3 > 0)
    n = d.groupBy("scene").agg(F.count_if(~a & b).alias("gained"), F.count_if(a & ~b).alias("lost"))
    most = F.greatest("gained", "lost")
    p = F.least(F.lit(1.0), 2.0 * binomial_tail(most - 1, F.col("gained") + F.col("lost"), F.lit(0.5)))
    return n.select("scene", "gained", "lost", R(F.when(F.col("gained") + F.col("lost") == 0, 1.0).otherwise(p)).alias("p"))


def a29(spark, sf):
    """What moving a prediction does: fixed if it comes within 12 pixels, regressed if it leaves, otherwise neutral; and large wrong moves."""
    d = decisions(spark, sf).where("present").select("scene", F.abs(F.col("x") - F.col("tx")).alias("before"), F.abs(F.col("x") - F.col("tx") - F.col("query") % 30).alias("after"), (F.col("query") % 30).alias("move"))
    kind = F.when((F.col("before") > 12) & (F.col("after") <= 12), "fix").when((F.col("before") <= 12) & (F.col("after") > 12), "regress").otherwise("neutral")
    return d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if((F.col("move") > 20) & (F.col("after") > 12)).alias("big_wrong"))


def a30(spark, sf):
    d = decisions(spark, sf).where("present")
    reward = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (36.0 - F.abs(F.col("x") - F.col("tx"))) / 24.0))
    return d.groupBy(F.when(F.col("truth_class") == 0, "figure").otherwise("off-figure").alias("category")).agg(R(F.avg(F.when(F.col("predicted"), reward).otherwise(0.0))).alias("localization"), F.count("*").alias("n"))


def a35(spark, sf):
    c = candidates(spark, sf)
    return c.groupBy((F.floor(F.col("x") % 360 / 45)).cast("long").alias("bin"), (F.floor(F.col("score") / 50) * 50).cast("double").alias("scale")).agg(F.count("*").alias("n"))


def a36(spark, sf):
    s = scene_scores(decisions(spark, sf), ["scene"])
    return s.groupBy(bucket(F.col("n"), [(15, "small"), (20, "mid")], "large").alias("size")).agg(F.count("*").alias("scenes"), R(F.avg("identification")).alias("identification"))


def a37(spark, sf):
    """Each policy's mean against the first's, and in how many scenes it is better or worse."""
    c = candidates(spark, sf).groupBy("scene").pivot("query", ["click", "error", "purchase", "signup", "view"]).agg(F.avg("score"))
    long = c.unpivot(["scene", "click"], ["error", "purchase", "signup", "view"], "policy", "v").where("v IS NOT NULL AND click IS NOT NULL")
    return long.groupBy("policy").agg(R(F.avg(F.col("v") - F.col("click"))).alias("delta"), F.count_if(F.col("v") > F.col("click")).alias("improved"), F.count_if(F.col("v") < F.col("click")).alias("regressed"))


def wass(spark, sf):
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").select("lang", F.col("n_chars").cast("double").alias("n_chars"), (F.col("quality") == 1).alias("good"))
    w = wasserstein(d, ["lang"], "n_chars", "good")
    return w.select("lang", R(F.col("distance"), 4).alias("distance")).where("distance IS NOT NULL")


def s6(spark, sf):
    """Cells written and read again."""
    c = candidates(spark, sf).select("id", format_cell(F.when(F.col("id") % 10 > 0, F.col("x")), F.col("y"), F.col("id") % 2).alias("cell"))
    p = c.select("id", "cell", parse_cell(F.col("cell")).alias("p"))
    return p.select("id", "cell", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.member").alias("member"))


def wide(spark, sf):
    """The submission: a row a scene, ``patch_NN`` columns padded with -1, and the class."""
    c = load(spark, sf, "customer").select((F.col("c_custkey") / 8).cast("long").alias("scene"), (F.col("c_custkey") % 8 + 1).alias("query"), F.col("c_custkey").alias("c"))
    name = load(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    own = c.join(name, F.col("scene") % 25 == F.col("nation")).select("scene", "query", (F.col("c") % 3000).cast("double").alias("x"), (F.col("c") * 7 % 3000).cast("double").alias("y"), (F.col("c") % 2).alias("member"), F.col("n_name").alias("name"))
    cells = [f"patch_{i:02}" for i in range(1, 9)]
    sample = own.select(F.col("scene").alias("Id")).distinct().select("Id", F.lit(8).alias("n_patches"), *(F.lit("-1").alias(p) for p in cells), F.lit("").alias("constellation"))
    return submission(own, sample).select(F.col("Id").alias("id"), *cells, "constellation")


def s5(spark, sf):
    """The wide table read as truth: a row a filled cell."""
    w = wide(spark, sf).withColumnRenamed("id", "Id").withColumn("n_patches", F.lit(8))
    return truth_cells(w).where("x IS NOT NULL").select(F.col("scene").alias("id"), "query", "x", "y", "member")


def s8(spark, sf):
    """How often a spoilt submission breaks each rule: every 13th scene left out, every 7th with a class that is none, every 11th with a cell
    beyond its seven, every 17th with a place outside and every 19th with no cell's form."""
    w = wide(spark, sf).withColumnRenamed("id", "Id").withColumn("n_patches", F.when(F.col("Id") % 11 == 0, 7).otherwise(8))
    order = ["Id", "n_patches", *(f"patch_{i:02}" for i in range(1, 9)), "constellation"]
    cell = F.when(F.col("Id") % 19 == 0, F.lit("(1, 2)")).when(F.col("Id") % 17 == 0, F.lit("(5.000, 3000.500, 1)")).otherwise(F.col("patch_01"))
    name = F.when(F.col("Id") % 7 == 0, F.lit("NOWHERE")).otherwise(F.col("constellation"))
    own = w.where("Id % 13 <> 0").withColumns({"patch_01": cell, "constellation": name})
    return violations(own.select(*order), w.select(*order), load(spark, sf, "nation").select(F.col("n_name").alias("name")))


def s9(spark, sf):
    """Differences of two sets of predictions: presence, moves over half a pixel, membership, median move."""
    c = candidates(spark, sf)
    a = c.where("id % 4 <> 1").select("scene", "id", F.col("x").alias("ax"), (F.col("id") % 2).alias("am"))
    b = c.where("id % 4 <> 2").select("scene", "id", (F.col("x") + F.col("id") % 5 * 0.25).alias("bx"), (F.col("id") % 3 % 2).alias("bm"))
    move = F.abs(F.col("ax") - F.col("bx"))
    return a.join(b, ["scene", "id"], "full").groupBy("scene").agg(F.count_if(F.col("ax").isNull()).alias("appeared"), F.count_if(F.col("bx").isNull()).alias("vanished"), F.count_if(move > 0.5).alias("moved"), F.count_if(F.col("am") != F.col("bm")).alias("membership"), R(F.median(move)).alias("median_move"))


def s10(spark, sf):
    return load(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("json"))


def s11(spark, sf):
    e = load(spark, sf, "events").select("event_type", F.from_json("props", "k INT").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("most"))


def s16(spark, sf):
    p = load(spark, sf, "pages")
    return p.groupBy(F.sha2("html", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def p12(spark, sf):
    """Where a missing query was lost, the first stage that fails."""
    d = decisions(spark, sf)
    stage = F.when(~F.col("present"), "absent").when((F.col("tx") < 52) | (F.col("tx") > 2947), "border").when(F.col("query") % 11 == 0, "index").when(F.col("query") % 7 == 0, "retrieval").when(F.abs(F.col("x") - F.col("tx")) > 12, "refine").when(~F.col("predicted"), "presence").otherwise("found")
    return d.groupBy("scene", stage.alias("stage")).agg(F.count("*").alias("n"))


def p14(spark, sf):
    n = candidates(spark, sf).groupBy(*QUERY).agg(F.count("*").alias("n"))
    return n.groupBy(bucket(F.col("n"), [(6, "4-6"), (9, "7-9"), (13, "10-13"), (18, "14-18")], "19+").alias("size")).agg(F.count("*").alias("queries"))


def c21(spark, sf):
    """A grid of presence thresholds and gaps, each with its number of present and ambiguous queries."""
    c = candidates(spark, sf)
    w = Window.partitionBy(*QUERY).orderBy(F.desc("score"), "pos")
    g = c.withColumns({"k": F.row_number().over(w), "gap": F.coalesce(F.col("score") - F.lead("score").over(w), F.lit(1e9))}).where("k = 1")
    grid = g.select("scene", "score", "gap", F.explode(F.array(*(F.lit(float(t)) for t in (60, 90, 120)))).alias("threshold")).select("*", F.explode(F.array(*(F.lit(float(t)) for t in (5, 20)))).alias("width"))
    return grid.groupBy("threshold", "width").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("present"), F.count_if(F.col("gap") < F.col("width")).alias("ambiguous"))


def c24(spark, sf):
    """Cells of two ways to seed by two ways to rank, presence frozen: each scene's score where places come from the first or the
    true place (seed) and classes from the prediction or the truth (rank), and what each factor and both together add."""
    d = decisions(spark, sf)
    cells = d.select("*", F.explode(F.array(F.lit("first"), F.lit("true"))).alias("seeding")).select("*", F.explode(F.array(F.lit("predicted"), F.lit("true"))).alias("ranking"))
    at = lambda c, t: F.when(F.col("seeding") == "true", F.col(t)).otherwise(F.col(c))
    cells = cells.withColumns({"x": at("x", "tx"), "y": at("y", "ty"), "class": F.when(F.col("ranking") == "true", F.col("truth_class")).otherwise(F.col("class"))})
    s = scene_scores(cells, ["scene", "seeding", "ranking"])
    return s.select("scene", "seeding", "ranking", R(0.25 * F.col("presence") + 0.2 * F.col("localization") + 0.3 * F.col("identification")).alias("score"))


def j17(spark, sf):
    c = candidates(spark, sf)
    return c.where("score > 100").select("id", F.lit("coarse").alias("stage")).unionByName(c.where("x > 2000").select("id", F.lit("refined").alias("stage"))).groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


CELL = "CASE WHEN {x} IS NULL THEN '-1' ELSE '(' || printf('%.3f', {x}) || ', ' || printf('%.3f', {y}) || ', ' || {m} || ')' END"
WIDE = "k AS (SELECT c_custkey // 8 AS id, c_custkey % 8 + 1 AS k, CAST(c_custkey % 3000 AS DOUBLE) AS x, CAST(c_custkey * 7 % 3000 AS DOUBLE) AS y, c_custkey % 2 AS m FROM customer)"
WIDE_SQL = f"WITH {WIDE} SELECT id, " + ", ".join(f"coalesce(max(CASE WHEN k = {i} THEN {CELL.format(x='x', y='y', m='m')} END), '-1') AS patch_{i:02}" for i in range(1, 9)) + ", any_value(n_name) AS constellation FROM k JOIN nation ON id % 25 = n_nationkey GROUP BY id"
GATED = f"{CAND}, g AS (SELECT * FROM (SELECT *, row_number() OVER w AS k, coalesce(score - lead(score) OVER w, 1e9) AS gap FROM cand WINDOW w AS (PARTITION BY scene, query ORDER BY score DESC, pos)) WHERE k = 1)"
LD = "d AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id))"
def interpolation(spark, sf):
    """Every event's value on the broken line through every forty-first event of its type."""
    e = load(spark, sf, "events").select("event_id", "event_type", "value")
    breaks = e.where("event_id % 41 = 0").select("event_type", "event_id", F.col("value").alias("y"))
    return interpolated(e.select("event_id", "event_type"), breaks, ["event_type"], "event_id", "y").select("event_id", R(F.col("interpolated"), 7).alias("interpolated"))


INTERPOLATION_SQL = """WITH b AS (SELECT event_type, event_id AS x, value AS y FROM events WHERE event_id % 41 = 0), l AS (SELECT e.event_id, e.event_type, b.x AS x0, b.y AS y0 FROM events e ASOF LEFT JOIN b ON e.event_type = b.event_type AND e.event_id >= b.x),
 h AS (SELECT l.*, b.x AS x1, b.y AS y1 FROM l ASOF LEFT JOIN b ON l.event_type = b.event_type AND l.event_id <= b.x)
SELECT event_id, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (event_id - x0) / (x1 - x0) END, 7) AS interpolated FROM h"""


def t9(spark, sf):
    """The finalists of a screening: the incumbent, and the three variants with the best cell of their grid; ties by name."""
    e = load(spark, sf, "events").select(F.concat_ws("-", "event_type", F.col("user_id") % 4).alias("variant"), (F.col("event_id") % 5).alias("cell"), "value")
    cells = e.groupBy("variant", "cell").agg(F.round(F.avg("value"), 9).alias("score"))
    best = cells.groupBy("variant").agg(F.max("score").alias("best"))
    first = best.orderBy(F.desc("best"), "variant").limit(3).withColumn("incumbent", F.lit(0)).unionByName(best.where("variant = 'click-0'").withColumn("incumbent", F.lit(1)))
    return first.groupBy("variant").agg(R(F.max("best")).alias("best"), F.max("incumbent").alias("incumbent"))


T9_SQL = """WITH c AS (SELECT event_type || '-' || user_id % 4 AS variant, event_id % 5 AS cell, round(avg(value), 9) AS score FROM events GROUP BY ALL), b AS (SELECT variant, max(score) AS best FROM c GROUP BY variant),
 f AS (SELECT * FROM (SELECT variant, best, 0 AS incumbent FROM b ORDER BY best DESC, variant LIMIT 3) UNION ALL SELECT variant, best, 1 FROM b WHERE variant = 'click-0')
SELECT variant, round(max(best), 6) AS best, max(incumbent) AS incumbent FROM f GROUP BY variant"""


QUERIES = {
    "interpolation": (interpolation, INTERPOLATION_SQL),
    "t9_finalists": (t9, T9_SQL),
    "a10_coverage_cube": (a10, "SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY CUBE (lang, source)"),
    "a11_quantile_table": (a11, "WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME field VALUE v) SELECT field, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90 FROM u GROUP BY field"),
    "a25_auc": (a25, f"WITH {LD} SELECT a.lang, round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END), 6) AS auc, count(DISTINCT a.rid) AS positives, count(DISTINCT b.rid) AS negatives FROM (SELECT *, row_number() OVER () AS rid FROM d) a JOIN (SELECT *, row_number() OVER () AS rid FROM d) b ON a.lang = b.lang AND a.quality = 1 AND b.quality <> 1 GROUP BY a.lang"),
    "a26_correlation": (a26, "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
    "a28_mcnemar": (a28, f"WITH {DEC}, n AS (SELECT scene, count(*) FILTER ((present <> predicted) AND present = (query % 3 > 0)) AS gained, count(*) FILTER (present = predicted AND present <> (query % 3 > 0)) AS lost FROM dec GROUP BY scene) SELECT scene, gained, lost, round(CASE WHEN gained + lost = 0 THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform(range(greatest(gained, lost), gained + lost + 1), lambda i: exp(lgamma(gained+lost+1) - lgamma(i+1) - lgamma(gained+lost-i+1) + (gained+lost)*ln(0.5))))) END, 6) AS p FROM n"),
    "a29_move_audit": (a29, f"WITH {DEC}, m AS (SELECT abs(x - tx) AS before, abs(x - tx - query % 30) AS after, query % 30 AS move FROM dec WHERE present) SELECT CASE WHEN before > 12 AND after <= 12 THEN 'fix' WHEN before <= 12 AND after > 12 THEN 'regress' ELSE 'neutral' END AS kind, count(*) AS n, count(*) FILTER (move > 20 AND after > 12) AS big_wrong FROM m GROUP BY 1"),
    "a30_category_localization": (a30, f"WITH {DEC} SELECT CASE WHEN truth_class = 0 THEN 'figure' ELSE 'off-figure' END AS category, round(avg(CASE WHEN predicted THEN greatest(0.0, least(1.0, (36.0 - abs(x - tx)) / 24.0)) ELSE 0.0 END), 6) AS localization, count(*) AS n FROM dec WHERE present GROUP BY 1"),
    "a35_histogram": (a35, f"WITH {CAND} SELECT CAST(floor(x % 360 / 45) AS BIGINT) AS bin, floor(score / 50) * 50 AS scale, count(*) AS n FROM cand GROUP BY 1, 2"),
    "a36_accuracy_by_size": (a36, f"WITH {SCENES} SELECT CASE WHEN n <= 15 THEN 'small' WHEN n <= 20 THEN 'mid' ELSE 'large' END AS size, count(*) AS scenes, round(avg(identification), 6) AS identification FROM sc GROUP BY 1"),
    "a37_policy_report": (a37, f"WITH {CAND}, m AS (SELECT scene, query, avg(score) AS v FROM cand GROUP BY ALL) SELECT b.query AS policy, round(avg(b.v - a.v), 6) AS delta, count(*) FILTER (b.v > a.v) AS improved, count(*) FILTER (b.v < a.v) AS regressed FROM m a JOIN m b ON a.scene = b.scene AND a.query = 'click' AND b.query IN ('error', 'purchase', 'signup', 'view') GROUP BY b.query"),
    "wasserstein": (wass, f"WITH {LD}, p AS (SELECT lang, CAST(n_chars AS DOUBLE) AS v, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality <> 1) AS b FROM d GROUP BY ALL), f AS (SELECT lang, abs(sum(a) OVER w / sum(a) OVER e - sum(b) OVER w / sum(b) OVER e) * (lead(v) OVER w - v) AS area, sum(a) OVER e AS ta, sum(b) OVER e AS tb FROM p WINDOW w AS (PARTITION BY lang ORDER BY v), e AS (PARTITION BY lang)) SELECT lang, round(sum(area), 4) AS distance FROM f WHERE ta > 0 AND tb > 0 GROUP BY lang"),
    "s5_read_truth": (s5, f"WITH {WIDE} SELECT id, CAST(k AS INT) AS query, x, y, CAST(m AS INT) AS member FROM k"),
    "s6_parse_cell": (s6, f"WITH {CAND} SELECT id, {CELL.format(x='(CASE WHEN id % 10 > 0 THEN x END)', y='y', m='(id % 2)')} AS cell, CASE WHEN id % 10 > 0 THEN x END AS x, CASE WHEN id % 10 > 0 THEN y END AS y, CASE WHEN id % 10 > 0 THEN CAST(id % 2 AS INT) END AS member FROM cand"),
    "s7_submission": (wide, WIDE_SQL),
    "s8_validate": (s8, f"WITH {WIDE}, w AS (SELECT id, count(*) FILTER (k = 8) AS last FROM k JOIN nation ON id % 25 = n_nationkey GROUP BY id), o AS (SELECT * FROM w WHERE id % 13 <> 0) SELECT 'header' AS rule, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'missing scene', count(*) FROM w WHERE id % 13 = 0 UNION ALL SELECT 'unknown scene', 0 UNION ALL SELECT 'repeated scene', 0 UNION ALL SELECT 'other n_patches', 0 UNION ALL SELECT 'unknown class', count(*) FROM o WHERE id % 7 = 0 UNION ALL SELECT 'malformed cell', count(*) FROM o WHERE id % 19 = 0 UNION ALL SELECT 'place outside', count(*) FROM o WHERE id % 17 = 0 AND id % 19 <> 0 UNION ALL SELECT 'cell beyond n_patches', count(*) FROM o WHERE id % 11 = 0 AND last > 0"),
    "s9_diff": (s9, f"WITH {CAND}, a AS (SELECT scene, id, x AS ax, id % 2 AS am FROM cand WHERE id % 4 <> 1), b AS (SELECT scene, id, x + id % 5 * 0.25 AS bx, id % 3 % 2 AS bm FROM cand WHERE id % 4 <> 2) SELECT scene, count(*) FILTER (ax IS NULL) AS appeared, count(*) FILTER (bx IS NULL) AS vanished, count(*) FILTER (abs(ax - bx) > 0.5) AS moved, count(*) FILTER (am <> bm) AS membership, round(median(abs(ax - bx)), 6) AS median_move FROM a FULL JOIN b USING (scene, id) GROUP BY scene"),
    "s10_json_rows": (s10, "SELECT event_id, CAST(json_object('event_id', event_id, 'user_id', user_id, 'event_type', event_type) AS VARCHAR) AS json FROM events"),
    "s11_json_scan": (s11, "SELECT event_type, count(CAST(props->>'k' AS INT)) AS n, CAST(sum(CAST(props->>'k' AS INT)) AS BIGINT) AS total, max(CAST(props->>'k' AS INT)) AS most FROM events GROUP BY event_type"),
    "s16_s21_content_hash": (s16, "SELECT sha256(html) AS sha256, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1"),
    "p12_stage_attribution": (p12, f"WITH {DEC} SELECT scene, CASE WHEN NOT present THEN 'absent' WHEN tx < 52 OR tx > 2947 THEN 'border' WHEN query % 11 = 0 THEN 'index' WHEN query % 7 = 0 THEN 'retrieval' WHEN abs(x - tx) > 12 THEN 'refine' WHEN NOT predicted THEN 'presence' ELSE 'found' END AS stage, count(*) AS n FROM dec GROUP BY 1, 2"),
    "p14_size_buckets": (p14, f"WITH {CAND}, n AS (SELECT count(*) AS n FROM cand GROUP BY scene, query) SELECT CASE WHEN n <= 6 THEN '4-6' WHEN n <= 9 THEN '7-9' WHEN n <= 13 THEN '10-13' WHEN n <= 18 THEN '14-18' ELSE '19+' END AS size, count(*) AS queries FROM n GROUP BY 1"),
    "c21_parameter_grid": (c21, f"WITH {GATED} SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(width AS DOUBLE) AS width, count(*) FILTER (score >= threshold) AS present, count(*) FILTER (gap < width) AS ambiguous FROM g, (VALUES (60), (90), (120)) t(threshold), (VALUES (5), (20)) u(width) GROUP BY 1, 2"),
    "c24_factorial": (c24, f"WITH {DEC.replace('dec AS', 'base AS')}, dec AS (SELECT scene, scene || '|' || seeding || '|' || ranking AS cell, query, present, predicted, truth_class, CASE WHEN ranking = 'true' THEN truth_class ELSE class END AS class, tx, ty, CASE WHEN seeding = 'true' THEN tx ELSE x END AS x, CASE WHEN seeding = 'true' THEN ty ELSE y END AS y, seeding, ranking FROM base, (VALUES ('first'), ('true')) a(seeding), (VALUES ('predicted'), ('true')) b(ranking)), {SCENES[len(DEC) + 2:].replace('FROM dec GROUP BY scene', 'FROM dec GROUP BY scene, seeding, ranking').replace('SELECT scene,', 'SELECT scene, seeding, ranking,', 1)} SELECT scene, seeding, ranking, round(0.25 * presence + 0.2 * localization + 0.3 * identification, 6) AS score FROM sc"),
    "j17_stage_union": (j17, f"WITH {CAND}, u AS (SELECT id, 'coarse' AS stage FROM cand WHERE score > 100 UNION ALL SELECT id, 'refined' FROM cand WHERE x > 2000) SELECT stage, count(*) AS n, count(DISTINCT id) AS ids FROM u GROUP BY stage"),
}
