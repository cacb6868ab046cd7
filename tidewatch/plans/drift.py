"""Drift over lineitem, whose years are cohorts, and over the outputs seen in events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import distributions as S
from tidewatch.functions.scratch import scratch, staged
from tidewatch.operators import drift as D
from tidewatch.operators import evidence as V
from tidewatch.sources import sinks
from tidewatch.streaming import health as H
from tidewatch.streaming.flows import drain

from .bindings import ALERTS, alerts, table
from .registry import query
from .training import digest_tree_sql

R = lambda c, n=6: F.round(c, n)
NUMERIC, FLAGS, CUT, SAMPLE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_shipper"], 1999, 2000
THRESHOLD = 0.01
Q = "[" + ", ".join(str(i / 20) for i in range(21)) + "]"

LONG = f"""
li AS (SELECT *, year(l_shipdate)::INT AS yr, CASE WHEN year(l_shipdate) = 2001 AND l_suppkey % 3 = 0 THEN 'new' || (l_suppkey % 5) ELSE 's' || (l_suppkey % 4) END AS l_shipper, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id FROM lineitem),
"""
LI = LONG
LONG = LI + f"""wide AS (SELECT yr, id, l_quantity + CASE WHEN yr = 2000 THEN 4 ELSE 0 END AS l_quantity, l_extendedprice, l_discount + 0.0::DOUBLE AS l_discount, l_tax + 0.0::DOUBLE AS l_tax FROM li),
long AS (SELECT yr, id, feature, x FROM wide UNPIVOT (x FOR feature IN ({', '.join(NUMERIC)}))),
refs AS (SELECT feature, count(*) AS n, min(x) AS min, max(x) AS max, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.95) AS q95, list_sort(list_distinct(quantile_cont(x, {Q}))) AS e FROM long WHERE yr < {CUT} GROUP BY feature),
binned AS (SELECT yr, feature, CASE WHEN x = e[-1] THEN len(e) - 1 ELSE len(list_filter(e, lambda v: v <= x)) END::INT AS bin FROM long JOIN refs USING (feature)),
ref_hist AS (SELECT feature, bin, count(*) AS n_ref FROM binned WHERE yr < {CUT} GROUP BY 1, 2),
cur_hist AS (SELECT yr, feature, bin, count(*) AS n FROM binned WHERE yr >= {CUT} GROUP BY 1, 2, 3),
grid AS (SELECT yr, feature, bin::INT AS bin FROM (SELECT DISTINCT yr, feature FROM cur_hist), LATERAL (SELECT unnest(range(0, len(e) + 1)) AS bin FROM refs r WHERE r.feature = cur_hist.feature))"""
LONG = LONG.replace("FROM (SELECT DISTINCT yr, feature FROM cur_hist), LATERAL (SELECT unnest(range(0, len(e) + 1)) AS bin FROM refs r WHERE r.feature = cur_hist.feature)", "FROM (SELECT DISTINCT yr, feature FROM cur_hist) JOIN (SELECT feature, unnest(range(0, len(e) + 1)) AS bin FROM refs) USING (feature)")
FULL = """full_hist AS (SELECT yr, feature, bin, coalesce(n_ref, 0) AS n_ref, coalesce(n, 0) AS n FROM grid LEFT JOIN ref_hist USING (feature, bin) LEFT JOIN cur_hist USING (yr, feature, bin)),
probs AS (SELECT *, (n_ref + 0.5::DOUBLE) / sum(n_ref + 0.5::DOUBLE) OVER (PARTITION BY yr, feature) AS p, (n + 0.5::DOUBLE) / sum(n + 0.5::DOUBLE) OVER (PARTITION BY yr, feature) AS q FROM full_hist),
js AS (SELECT yr, feature, sqrt(greatest(0, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2)) AS js FROM probs GROUP BY 1, 2)"""
KS = f"""sample AS (SELECT feature, x FROM (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY md5(feature || '|' || id), id, x) AS r FROM long WHERE yr < {CUT}) WHERE r <= {SAMPLE}),
sides AS (SELECT yr, feature, x, 1 AS a, 0 AS b FROM (SELECT DISTINCT yr FROM long WHERE yr >= {CUT}) CROSS JOIN sample UNION ALL SELECT yr, feature, x, 0, 1 FROM long WHERE yr >= {CUT}),
vals AS (SELECT yr, feature, x, sum(a) AS a, sum(b) AS b FROM sides GROUP BY 1, 2, 3),
cdf AS (SELECT yr, feature, sum(a) OVER w / (sum(a) OVER (PARTITION BY yr, feature))::DOUBLE - sum(b) OVER w / (sum(b) OVER (PARTITION BY yr, feature))::DOUBLE AS gap, sum(a) OVER (PARTITION BY yr, feature) AS m, sum(b) OVER (PARTITION BY yr, feature) AS n FROM vals WINDOW w AS (PARTITION BY yr, feature ORDER BY x ROWS UNBOUNDED PRECEDING)),
ks0 AS (SELECT yr, feature, max(abs(gap)) AS ks, any_value(m)::DOUBLE AS m, any_value(n)::DOUBLE AS n FROM cdf GROUP BY 1, 2),
ks AS (SELECT yr, feature, ks, CASE WHEN x < 0.2 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * list_sum([CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * i * i * x * x) FOR i IN range(1, 101)]))) END AS p FROM (SELECT *, ks * sqrt(n * m / (n + m)) AS x FROM ks0))"""
LEVEL = f"level AS (SELECT yr, feature, avg((x < min OR x > max)::INT::DOUBLE) AS exceed_rate, any_value(q50) AS ref_median, any_value(q95) AS ref_p95, quantile_cont(x, 0.5) AS cur_median, quantile_cont(x, 0.95) AS cur_p95 FROM long JOIN refs USING (feature) WHERE yr >= {CUT} GROUP BY 1, 2)"
CATS = f"""clong AS (SELECT yr, feature, x FROM (SELECT yr, l_returnflag, l_shipper FROM li) UNPIVOT (x FOR feature IN (l_returnflag, l_shipper))),
vocab AS (SELECT feature, x, count(*) AS n_ref FROM clong WHERE yr < {CUT} GROUP BY 1, 2),
ccount AS (SELECT c.yr, c.feature, c.x, count(*) AS n FROM clong c WHERE yr >= {CUT} GROUP BY 1, 2, 3),
cjoin AS (SELECT c.*, v.n_ref FROM ccount c LEFT JOIN vocab v USING (feature, x)),
cgrid AS (SELECT yr, feature, bin, n_ref FROM (SELECT DISTINCT yr, feature FROM ccount) JOIN (SELECT feature, x AS bin, n_ref FROM vocab UNION ALL SELECT DISTINCT feature, '__OTHER__', 0 FROM vocab) USING (feature)),
cfull AS (SELECT g.*, coalesce(n, 0) AS n FROM cgrid g LEFT JOIN (SELECT yr, feature, CASE WHEN n_ref IS NULL THEN '__OTHER__' ELSE x END AS bin, sum(n) AS n FROM cjoin GROUP BY 1, 2, 3) USING (yr, feature, bin)),
cprobs AS (SELECT *, (n_ref + 0.5::DOUBLE) / sum(n_ref + 0.5::DOUBLE) OVER (PARTITION BY yr, feature) AS p, (n + 0.5::DOUBLE) / sum(n + 0.5::DOUBLE) OVER (PARTITION BY yr, feature) AS q FROM cfull),
cjs AS (SELECT yr, feature, sqrt(greatest(0, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2)) AS js, sum(n) AS total FROM cprobs GROUP BY 1, 2),
cnew AS (SELECT yr, feature, sum(n)::BIGINT AS n_unseen, string_agg(x || ':' || n, ',' ORDER BY n DESC, x) AS unseen FROM cjoin WHERE n_ref IS NULL GROUP BY 1, 2),
cat AS (SELECT yr, feature, js, coalesce(n_unseen, 0) AS n_unseen, coalesce(n_unseen, 0) / total::DOUBLE AS unseen_rate, coalesce(unseen, '') AS unseen FROM cjs LEFT JOIN cnew USING (yr, feature))"""
BH = "ranked AS (SELECT yr, feature, js, p, row_number() OVER (PARTITION BY yr ORDER BY p, feature) AS r, count(*) OVER (PARTITION BY yr) AS m FROM js JOIN ks USING (yr, feature)), bh AS (SELECT yr, feature, js, p, least(1.0::DOUBLE, min(p * m / r) OVER (PARTITION BY yr ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ranked)"
JUDGED = f"judged AS (SELECT yr, feature, 'numeric' AS kind, js, q, js > {THRESHOLD} AND q <= 0.05 AS drifted FROM bh UNION ALL SELECT yr, feature, 'categorical', js, NULL, js > {THRESHOLD} FROM cat)"
NUM = f"WITH {LONG}, {FULL}, {KS}, {LEVEL}"


def _wide(spark, d):
    li = table(spark, d, "lineitem").withColumn("yr", F.year("l_shipdate"))
    shipper = F.when((F.col("yr") == 2001) & (F.col("l_suppkey") % 3 == 0), F.concat(F.lit("new"), (F.col("l_suppkey") % 5).cast("string"))).otherwise(F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")))
    li = li.withColumn("l_shipper", shipper).withColumn("id", F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]))
    # 0.0 is added, as some discounts are -0.0.
    return li.withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("yr") == 2000, 4).otherwise(0)).withColumn("l_discount", F.col("l_discount") + 0.0).withColumn("l_tax", F.col("l_tax") + 0.0)


def _long(spark, d):
    return D.long_numeric(_wide(spark, d), ["yr", "id"], NUMERIC)


def _old(df):
    return df.filter(F.col("yr") < CUT)


def _new(df):
    return df.filter(F.col("yr") >= CUT)


def _numeric(spark, d):
    """Values are counted and written once; all statistics but the stored sample are read off the counts."""
    long = _long(spark, d)
    counts = staged(S.counted(long, ["yr", "feature"], "x"), "value-counts")
    ref, sample = staged(D.numeric_reference(_old(counts)), "reference"), staged(D.reference_sample(_old(long), "id", SAMPLE), "sample")
    return D.numeric_drift(ref, _old(counts), sample, _new(counts), ["yr"])


def _categorical(spark, d):
    long = D.long_categorical(_wide(spark, d), ["yr"], FLAGS)
    vocabulary = _old(long).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n_ref"))
    return D.categorical_drift(vocabulary, _new(long), ["yr"])


def _judged(spark, d):
    return D.judge_features(_numeric(spark, d), _categorical(spark, d), _limits(spark), ["yr"])


def _limits(spark):
    return spark.createDataFrame([(f, THRESHOLD) for f in NUMERIC + FLAGS], "feature string, threshold double")


@query("dr01_edges", f"WITH {LONG} SELECT feature, i::INT AS i, round(v, 6) AS edge FROM (SELECT feature, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS i FROM refs)")
def dr01(spark, d):
    return D.numeric_reference(_old(_long(spark, d))).select("feature", F.posexplode("edges").alias("i", "v")).select("feature", "i", R(F.col("v")).alias("edge"))


@query("dr02_histogram", f"WITH {LONG} SELECT yr, feature, bin, n FROM cur_hist")
def dr02(spark, d):
    long = _long(spark, d)
    return D.histogram(_new(long), D.numeric_reference(_old(long)), ["yr"])


@query("dr03_probabilities", f"WITH {LONG} SELECT feature, bin, round((n_ref + 0.5::DOUBLE) / sum(n_ref + 0.5::DOUBLE) OVER (PARTITION BY feature), 9) AS p FROM ref_hist")
def dr03(spark, d):
    old = _old(_long(spark, d))
    return D.histogram(old, D.numeric_reference(old)).select("feature", "bin", R(S.smoothed(F.col("n"), "feature"), 9).alias("p"))


@query("dr04_js_distance", f"WITH {LONG}, {FULL} SELECT yr, feature, round(js, 6) AS js FROM js")
def dr04(spark, d):
    return _numeric(spark, d).select("yr", "feature", R(F.col("js")).alias("js"))


@query("dr05_ks", f"WITH {LONG}, {KS} SELECT yr, feature, round(ks, 6) AS ks, round(p, 6) AS p FROM ks")
def dr05(spark, d):
    return _numeric(spark, d).select("yr", "feature", R(F.col("ks")).alias("ks"), R(F.col("p")).alias("p"))


@query("dr06_numeric_drift", f"{NUM} SELECT yr, feature, round(js, 6) AS js, round(ks, 6) AS ks, round(p, 6) AS p, round(exceed_rate, 6) AS exceed_rate, round(ref_median, 4) AS ref_median, round(ref_p95, 4) AS ref_p95, round(cur_median, 4) AS cur_median, round(cur_p95, 4) AS cur_p95 FROM js JOIN ks USING (yr, feature) JOIN level USING (yr, feature)")
def dr06(spark, d):
    n = _numeric(spark, d)
    return n.select("yr", "feature", *[R(F.col(c)).alias(c) for c in ("js", "ks", "p", "exceed_rate")], *[R(F.col(c), 4).alias(c) for c in ("ref_median", "ref_p95", "cur_median", "cur_p95")])


@query("dr07_categorical_drift", f"WITH {LONG}, {CATS} SELECT yr, feature, round(js, 6) AS js, n_unseen, round(unseen_rate, 6) AS unseen_rate, unseen FROM cat")
def dr07(spark, d):
    return _categorical(spark, d).select("yr", "feature", R(F.col("js")).alias("js"), "n_unseen", R(F.col("unseen_rate")).alias("unseen_rate"), "unseen")


@query("dr08_q_values", f"WITH {LONG}, {FULL}, {KS}, {BH} SELECT yr, feature, round(q, 6) AS q FROM bh")
def dr08(spark, d):
    return S.benjamini_hochberg(_numeric(spark, d), "p", ["yr"], "feature").select("yr", "feature", R(F.col("q")).alias("q"))


@query("dr09_feature_window", f"WITH {LONG}, {FULL}, {KS}, {CATS}, {BH}, {JUDGED} SELECT yr, round(max(js / {THRESHOLD}), 4) AS aggregate_score, count(*) FILTER (WHERE drifted) AS n_drifted, CASE WHEN bool_or(drifted) THEN 'warning' ELSE 'healthy' END AS status FROM judged GROUP BY 1")
def dr09(spark, d):
    s = D.window_status(_judged(spark, d), ["yr"])
    return s.withColumn("aggregate_score", R(F.col("aggregate_score"), 4))


@query("tk09_drift_order", f"WITH {LONG}, {FULL}, {KS}, {CATS}, {BH}, {JUDGED} SELECT yr, feature, drifted, round(js / {THRESHOLD}, 4) AS ratio FROM judged ORDER BY drifted DESC, ratio DESC, feature, yr")
def tk09(spark, d):
    return _judged(spark, d).select("yr", "feature", "drifted", R(F.col("ratio"), 4).alias("ratio")).orderBy(F.desc("drifted"), F.desc("ratio"), "feature", "yr")


@query("jn13_histogram_join", f"WITH {LONG}, c AS (SELECT feature, bin, sum(n)::BIGINT AS n FROM cur_hist GROUP BY 1, 2) SELECT feature, bin, coalesce(n_ref, 0) AS n_ref, coalesce(n, 0) AS n FROM ref_hist FULL JOIN c USING (feature, bin)")
def jn13(spark, d):
    long = _long(spark, d)
    ref = D.numeric_reference(_old(long))
    a = D.histogram(_old(long), ref).withColumnRenamed("n", "n_ref")
    return a.join(D.histogram(_new(long), ref), ["feature", "bin"], "full_outer").na.fill(0, ["n_ref", "n"])


@query("dr11_null_thresholds")
def dr11(spark, d):
    old = _old(_long(spark, d))
    return D.null_thresholds(D.histogram(old, D.numeric_reference(old)), 1000)


@query("dr12_null_rate_threshold")
def dr12(spark, d):
    """For each kind of event, how far the share of attacks of two disjoint samples of it gets apart."""
    counts = alerts(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == "attack").alias("positive"))
    return D.null_rate_thresholds(counts, "event_type", 1000)


@query("dr13_reference_build", f"WITH {LONG}, {KS} SELECT feature, any_value(r.n) AS n, round(any_value(min), 6) AS min, round(any_value(max), 6) AS max, round(any_value(q05), 6) AS q05, round(any_value(q50), 6) AS q50, round(any_value(q95), 6) AS q95, any_value(len(e))::INT AS n_edges, count(*) AS n_sample, round(sum(x), 4) AS sample_sum FROM refs r JOIN sample USING (feature) GROUP BY feature")
def dr13(spark, d):
    old = _old(_long(spark, d))
    s = D.reference_sample(old, "id", SAMPLE).groupBy("feature").agg(F.count(F.lit(1)).alias("n_sample"), R(F.sum("x"), 4).alias("sample_sum"))
    return D.numeric_reference(old).join(s, "feature").select("feature", "n", *[R(F.col(c)).alias(c) for c in ("min", "max", "q05", "q50", "q95")], F.size("edges").alias("n_edges"), "n_sample", "sample_sum")


#: Fitted on the lines before CUT, the outputs held out from CUT's own year.
WHOLE = f"""WITH RECURSIVE {LONG}, clong AS (SELECT yr, feature, x FROM (SELECT yr, l_returnflag, l_shipper FROM li) UNPIVOT (x FOR feature IN (l_returnflag, l_shipper))),
held AS (SELECT CASE WHEN l_extendedprice > 40000 + 900 * l_quantity THEN 'attack' ELSE 'normal' END AS label, (l_discount + 0.0::DOUBLE) * 10 AS score, 'tax_' || (l_suppkey % 3) AS class, (l_tax + 0.0::DOUBLE) * 10 AS class_score FROM li WHERE yr = {CUT}),
words AS (
  SELECT 'categorical' AS kind, feature, x FROM clong WHERE yr < {CUT} UNION ALL SELECT 'output_label', 'detector_labels', label FROM held UNION ALL SELECT 'output_label', 'classifier_labels', class FROM held WHERE label = 'attack'
),
scores AS (SELECT 'detector_scores' AS feature, score AS x FROM held UNION ALL SELECT 'classifier_scores', class_score FROM held WHERE label = 'attack'),
sref AS (SELECT feature, count(*) AS n, min(x) AS min, max(x) AS max, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.95) AS q95, list_sort(list_distinct(quantile_cont(x, {Q}))) AS e FROM scores GROUP BY 1),
shist AS (SELECT feature, CASE WHEN x = e[-1] THEN len(e) - 1 ELSE len(list_filter(e, lambda v: v <= x)) END::INT AS bin, count(*) AS n FROM scores JOIN sref USING (feature) GROUP BY 1, 2),
nums AS (SELECT 'numeric' AS kind, r.*, h.counts FROM refs r JOIN (SELECT feature, string_agg(bin || ':' || n_ref, ',' ORDER BY bin::VARCHAR) AS counts FROM ref_hist GROUP BY 1) h USING (feature)
         UNION ALL SELECT 'output_score', r.*, h.counts FROM sref r JOIN (SELECT feature, string_agg(bin || ':' || n, ',' ORDER BY bin::VARCHAR) AS counts FROM shist GROUP BY 1) h USING (feature)),
parts AS (SELECT CASE WHEN yr < {CUT} THEN 'fit' ELSE 'held_out' END AS part, id AS v FROM li WHERE yr <= {CUT}), {digest_tree_sql('part', 'parts')}
SELECT kind, feature, n, round(min, 6) AS min, round(max, 6) AS max, round(q05, 6) AS q05, round(q50, 6) AS q50, round(q95, 6) AS q95, len(e)::INT AS n_edges, counts FROM nums
UNION ALL SELECT kind, feature, sum(n)::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL, string_agg(x || ':' || n, ',' ORDER BY x) || ',__OTHER__:0' FROM (SELECT kind, feature, x, count(*) AS n FROM words GROUP BY ALL) GROUP BY 1, 2
UNION ALL SELECT 'rate', 'attack_routing_rate', count(*), NULL, NULL, NULL, NULL, NULL, NULL, 'attack:' || count(*) FILTER (WHERE label = 'attack') FROM held
UNION ALL SELECT 'part', k, n, NULL, NULL, NULL, NULL, NULL, NULL, digest FROM tree"""


@query("dr13_whole_reference", WHOLE)
def dr13_whole(spark, d):
    w = staged(_wide(spark, d), "lines")
    label = F.when(F.col("l_extendedprice") > 40000 + 900 * F.col("l_quantity"), "attack").otherwise("normal")
    attack = label == "attack"
    outputs = (label, F.col("l_discount") * 10, F.when(attack, F.concat(F.lit("tax_"), (F.col("l_suppkey") % 3).cast("string"))), F.when(attack, F.col("l_tax") * 10))
    entries, _, parts = D.whole_reference(_old(w), w.filter(F.col("yr") == CUT), "id", NUMERIC, FLAGS, outputs)
    counts = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    levels = ["min", "max", "q05", "q50", "q95"]
    told = entries.select("kind", "feature", "n", *[R(F.col(c)).alias(c) for c in levels], F.when(F.col("edges").isNotNull(), F.size("edges")).alias("n_edges"), counts.alias("counts"))
    nothing = [F.lit(None).cast("double").alias(c) for c in levels]
    return told.unionByName(parts.select(F.lit("part").alias("kind"), F.col("part").alias("feature"), "n", *nothing, F.lit(None).cast("int").alias("n_edges"), F.col("digest").alias("counts")))


#: Thresholds of the output metrics, and of the move of the attack rate.
OUTPUT_THRESHOLDS = {"detector_labels": 0.02, "classifier_labels": 0.05, "detector_scores": 0.05, "classifier_scores": 0.08}
RATE_THRESHOLD = 0.02
#: Output metrics in SQL: of current labels ol (g, metric, v) and scores os (g, metric, x) against those of a baseline, bl and bs.
OUTPUT = f"""
ov AS (SELECT metric, v, count(*) AS n_ref FROM bl GROUP BY 1, 2),
oc AS (SELECT g, metric, v, count(*) AS n FROM ol GROUP BY 1, 2, 3),
ob AS (SELECT g, metric, CASE WHEN n_ref IS NULL THEN '__OTHER__' ELSE v END AS bin, sum(n) AS n FROM oc LEFT JOIN ov USING (metric, v) GROUP BY 1, 2, 3),
ow AS (SELECT metric, v AS bin, n_ref FROM ov UNION ALL SELECT DISTINCT metric, '__OTHER__', 0 FROM ov),
og AS (SELECT g, metric, bin, n_ref, coalesce(n, 0) AS n FROM (SELECT DISTINCT g, metric FROM ol) JOIN ow USING (metric) LEFT JOIN ob USING (g, metric, bin)),
oe AS (SELECT metric, list_sort(list_distinct(quantile_cont(x, {Q}))) AS e FROM bs GROUP BY 1),
sr AS (SELECT metric, CASE WHEN x = e[-1] THEN len(e) - 1 ELSE len(list_filter(e, lambda v: v <= x)) END AS bin, count(*) AS n_ref FROM bs JOIN oe USING (metric) GROUP BY 1, 2),
sc AS (SELECT g, metric, CASE WHEN x = e[-1] THEN len(e) - 1 ELSE len(list_filter(e, lambda v: v <= x)) END AS bin, count(*) AS n FROM os JOIN oe USING (metric) GROUP BY 1, 2, 3),
sg AS (SELECT g, metric, bin::VARCHAR AS bin, coalesce(n_ref, 0) AS n_ref, coalesce(n, 0) AS n FROM (SELECT DISTINCT g, metric FROM os) JOIN (SELECT metric, unnest(range(0, len(e) + 1)) AS bin FROM oe) USING (metric) LEFT JOIN sr USING (metric, bin) LEFT JOIN sc USING (g, metric, bin)),
op AS (SELECT *, (n_ref + 0.5::DOUBLE) / sum(n_ref + 0.5::DOUBLE) OVER w AS p, (n + 0.5::DOUBLE) / sum(n + 0.5::DOUBLE) OVER w AS q FROM (SELECT * FROM og UNION ALL SELECT * FROM sg) WINDOW w AS (PARTITION BY g, metric)),
oj AS (SELECT g, metric, sqrt(greatest(0, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2)) AS js FROM op GROUP BY 1, 2),
on_ AS (SELECT g, metric, count(*) AS n FROM (SELECT g, metric FROM ol UNION ALL SELECT g, metric FROM os) GROUP BY 1, 2),
ot AS (SELECT unnest({list(OUTPUT_THRESHOLDS)}) AS metric, unnest({list(OUTPUT_THRESHOLDS.values())})::DOUBLE AS threshold),
om0 AS (SELECT g, metric, coalesce(n, 0) AS n, CASE WHEN n >= CASE metric WHEN 'classifier_scores' THEN 200 ELSE 1 END THEN js END AS value, threshold FROM (SELECT DISTINCT g FROM ol) CROSS JOIN ot LEFT JOIN on_ USING (g, metric) LEFT JOIN oj USING (g, metric)
        UNION ALL SELECT g, 'attack_routing_rate', count(*), abs(avg((v = 'attack')::INT::DOUBLE) - (SELECT avg((v = 'attack')::INT::DOUBLE) FROM bl WHERE metric = 'detector_labels')), {RATE_THRESHOLD}::DOUBLE FROM ol WHERE metric = 'detector_labels' GROUP BY 1),
om AS (SELECT *, value / threshold AS ratio, coalesce(value / threshold > 1, FALSE) AS drifted, CASE WHEN value IS NULL THEN 'collecting' WHEN value / threshold > 1 THEN 'warning' ELSE 'healthy' END AS status FROM om0)"""
DAYS = f"""{ALERTS}, a AS (SELECT *, day(observed_at)::INT AS g, value / 200 AS class_score FROM alerts),
lab AS (SELECT g, 'detector_labels' AS metric, prediction AS v FROM a UNION ALL SELECT g, 'classifier_labels', attack_class FROM a WHERE attack_class IS NOT NULL),
sco AS (SELECT g, 'detector_scores' AS metric, confidence AS x FROM a UNION ALL SELECT g, 'classifier_scores', class_score FROM a WHERE attack_class IS NOT NULL)"""
BY_DAY = f"{DAYS}, bl AS (SELECT metric, v FROM lab WHERE g < 15), bs AS (SELECT metric, x FROM sco WHERE g < 15), ol AS (SELECT * FROM lab WHERE g >= 15), os AS (SELECT * FROM sco WHERE g >= 15), {OUTPUT}"


def _outputs(spark, d):
    """(labels, scores) of the alerts, by day."""
    a = alerts(spark, d).withColumn("day", F.dayofmonth("observed_at"))
    score = F.when(F.col("attack_class").isNotNull(), F.col("value") / 200)
    return D.output_rows(a, ["day"], F.col("prediction"), F.col("confidence"), F.col("attack_class"), score)


def _thresholds(spark):
    return spark.createDataFrame(list(OUTPUT_THRESHOLDS.items()), "feature string, threshold double")


@query("dr14_output_references", f"WITH {DAYS}, enough AS (SELECT metric FROM (SELECT g, metric FROM lab UNION ALL SELECT g, metric FROM sco) WHERE g BETWEEN 8 AND 14 GROUP BY 1 HAVING count(*) >= 4), l AS (SELECT metric, v, count(*) AS n FROM lab WHERE g < 8 GROUP BY 1, 2), s AS (SELECT metric, count(*) AS n, min(x) AS min, max(x) AS max, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.95) AS q95, len(list_distinct(quantile_cont(x, {Q}))) AS n_edges FROM sco WHERE g < 8 GROUP BY 1) SELECT metric, sum(n)::BIGINT AS n, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS q05, NULL::DOUBLE AS q50, NULL::DOUBLE AS q95, string_agg(v || ':' || n, ',' ORDER BY v) AS counts, NULL::INT AS n_edges FROM l JOIN enough USING (metric) GROUP BY 1 UNION ALL SELECT metric, n, round(min, 6), round(max, 6), round(q05, 6), round(q50, 6), round(q95, 6), NULL, n_edges::INT FROM s JOIN enough USING (metric)")
def dr14(spark, d):
    labels, scores = _outputs(spark, d)
    base, calibration = F.col("day") < 8, F.col("day").between(8, 14)
    vocabulary, reference = D.output_references(labels.filter(base), scores.filter(base), labels.filter(calibration), scores.filter(calibration))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "n_ref"))), lambda r: F.concat(r["x"], F.lit(":"), r["n_ref"].cast("string"))), ",")
    nothing = [F.lit(None).cast("double").alias(c) for c in ("min", "max", "q05", "q50", "q95")]
    told = vocabulary.groupBy(F.col("feature").alias("metric")).agg(F.sum("n_ref").alias("n"), counts.alias("counts")).select("metric", "n", *nothing, "counts", F.lit(None).cast("int").alias("n_edges"))
    levels = [R(F.col(c)).alias(c) for c in ("min", "max", "q05", "q50", "q95")]
    return told.unionByName(reference.select(F.col("feature").alias("metric"), "n", *levels, F.lit(None).cast("string").alias("counts"), F.size("edges").alias("n_edges")))


@query("dr14_output_thresholds")
def dr14_thresholds(spark, d):
    """How far two halves of the calibration part get apart, for each output metric."""
    labels, scores = _outputs(spark, d)
    base, calibration = F.col("day") < 8, F.col("day").between(8, 14)
    counted = labels.filter(calibration).groupBy("feature", F.col("x").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    binned = D.histogram(scores.filter(calibration), D.numeric_reference(scores.filter(base))).withColumn("bin", F.col("bin").cast("string"))
    return D.null_thresholds(counted.unionByName(binned), 1000)


@query("dr10_output_metrics", f"WITH {BY_DAY} SELECT g AS day, metric, n, round(value, 6) AS value, round(ratio, 4) AS ratio, drifted, status FROM om")
def dr10_metrics(spark, d):
    labels, scores = _outputs(spark, d)
    old, new = F.col("day") < 15, F.col("day") >= 15
    vocabulary = labels.filter(old).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n_ref"))
    rate = labels.filter(old & (F.col("feature") == "detector_labels")).agg(F.avg((F.col("x") == "attack").cast("double"))).first()[0] or 0.0
    m = D.output_metrics(vocabulary, D.numeric_reference(scores.filter(old)), scores.filter(old), labels.filter(new), scores.filter(new), _thresholds(spark), ["day"], rate, RATE_THRESHOLD)
    return m.select("day", "metric", "n", R(F.col("value")).alias("value"), R(F.col("ratio"), 4).alias("ratio"), "drifted", "status")


@query("dr10_output_window", f"WITH {BY_DAY} SELECT g AS day, count(*) FILTER (WHERE drifted) AS alarm_count, coalesce(max(round(ratio, 4)), 0) AS aggregate_score, CASE WHEN bool_or(drifted) THEN 'warning' ELSE 'healthy' END AS status FROM om GROUP BY 1")
def dr10(spark, d):
    return D.output_status(dr10_metrics(spark, d), ["day"])


#: The reference's bounds of rows; the days are those in which the lines of an order book come to as many.
HEALTH_WINDOWS = [("fast", 180, 5_000, 1_000), ("slow", 730, 20_000, 5_000)]
CHECKS = (0, 30, 60)
HEALTH = f"""WITH {LI.replace("li AS (", "raw AS (")}
src AS (SELECT * REPLACE (l_quantity + CASE WHEN yr = 2000 THEN 4 ELSE 0 END AS l_quantity), CASE WHEN l_suppkey % 8 < 5 THEN 0 WHEN l_suppkey % 8 = 5 THEN 1 WHEN l_suppkey % 8 = 6 THEN 2 ELSE 3 END AS cno FROM raw),
ck AS (SELECT k, (SELECT max(l_shipdate)::DATE::TIMESTAMP FROM lineitem) - to_days(k * 30) AS checked_at FROM (SELECT unnest([0, 1, 2]) AS k)),
pol AS (SELECT unnest([0, 1]) AS wno, unnest([180, 730]) AS days, unnest([5000, 20000]) AS most, unnest([1000, 5000]) AS least),
cur AS (SELECT s.*, wno, k, least FROM src s JOIN ck ON TRUE JOIN pol ON l_shipdate > checked_at - to_days(days::INT) AND l_shipdate <= checked_at QUALIFY row_number() OVER (PARTITION BY wno, k, cno ORDER BY l_shipdate DESC, id DESC) <= most),
li AS (SELECT * EXCLUDE (cno) REPLACE (0 AS yr) FROM src WHERE yr < {CUT} UNION ALL SELECT * EXCLUDE (cno, wno, k, least) REPLACE ((10000 + wno * 100 + k * 10 + cno)::INT AS yr) FROM cur),
{LONG.removeprefix(LI)}, {FULL}, {KS}, {CATS}, {BH}, {JUDGED},
seen AS (SELECT yr AS g, CASE WHEN l_extendedprice > 40000 + 900 * l_quantity THEN 'attack' ELSE 'normal' END AS label, (l_discount + 0.0::DOUBLE) * 10 AS score, 'tax_' || (l_suppkey % 3) AS class, (l_tax + 0.0::DOUBLE) * 10 AS class_score FROM li),
lab AS (SELECT g, 'detector_labels' AS metric, label AS v FROM seen UNION ALL SELECT g, 'classifier_labels', class FROM seen WHERE label = 'attack'),
sco AS (SELECT g, 'detector_scores' AS metric, score AS x FROM seen UNION ALL SELECT g, 'classifier_scores', class_score FROM seen WHERE label = 'attack'),
bl AS (SELECT metric, v FROM lab WHERE g = 0), bs AS (SELECT metric, x FROM sco WHERE g = 0), ol AS (SELECT * FROM lab WHERE g > 0), os AS (SELECT * FROM sco WHERE g > 0), {OUTPUT},
f AS (SELECT yr AS g, max(js / {THRESHOLD}) AS f_score, bool_or(drifted) AS f_alarm FROM judged GROUP BY 1),
o AS (SELECT g, coalesce(max(ratio), 0) AS o_score, bool_or(drifted) AS o_alarm FROM om GROUP BY 1),
c AS (SELECT 10000 + wno * 100 + k * 10 + cno AS g, wno, k, cno, count(*) AS n, any_value(least) AS least FROM cur GROUP BY ALL),
j AS (SELECT *, cno < 2 AND n >= least AS judged FROM c LEFT JOIN f USING (g) LEFT JOIN o USING (g)),
al AS (SELECT *, judged AND (coalesce(f_alarm, FALSE) OR coalesce(o_alarm, FALSE)) AS alarm FROM j),
es AS (SELECT *, alarm AND coalesce(lag(alarm, 1) OVER w, FALSE) AND coalesce(lag(alarm, 2) OVER w, FALSE) AS critical FROM al WINDOW w AS (PARTITION BY wno, cno ORDER BY k DESC))
SELECT ['fast', 'slow'][wno + 1] AS "window", checked_at, ['live', 'thin', 'stale', 'unrouted'][cno + 1] AS cohort, n, round(CASE WHEN judged THEN greatest(coalesce(f_score, 0), coalesce(o_score, 0)) END, 4) AS score,
       CASE WHEN cno = 3 THEN 'incompatible_source' WHEN cno = 2 THEN 'blocked' WHEN n < least THEN 'collecting' WHEN critical THEN 'critical' WHEN alarm THEN 'warning' ELSE 'healthy' END AS status
FROM es JOIN ck USING (k)"""


def _health_rows(spark, d):
    """(lines with their cohort, checks, the rows of every window of theirs)."""
    w = _cohorts(_wide(spark, d))
    last = w.agg(F.date_trunc("day", F.max("l_shipdate")).cast("timestamp_ntz").alias("last"))
    checks = last.select(F.explode(F.array(*[F.col("last") - F.make_dt_interval(days=F.lit(n)) for n in CHECKS])).alias("checked_at"))
    return w, checks, staged(D.window_rows(w, "cohort", "l_shipdate", "id", checks, HEALTH_WINDOWS), "windows")


@query("dr15_health_evaluation", HEALTH)
def dr15(spark, d):
    return _evaluated(spark, *_health_rows(spark, d))


def _evaluated(spark, w, checks, cur):
    keys, old = ["window", "checked_at", "cohort"], _old(w)
    counts = cur.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("minimum").alias("minimum"))
    long_old, flags = D.long_numeric(old, ["id"], NUMERIC), D.long_categorical(old, [], FLAGS)
    old_counts, new_counts = staged(S.counted(long_old, ["feature"], "x"), "value-counts"), staged(S.counted(D.long_numeric(cur, keys, NUMERIC), [*keys, "feature"], "x"), "window-counts")
    numeric = D.numeric_drift(staged(D.numeric_reference(old_counts), "reference"), old_counts, staged(D.reference_sample(long_old, "id", SAMPLE), "sample"), new_counts, keys)
    categorical = D.categorical_drift(flags.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n_ref")), D.long_categorical(cur, keys, FLAGS), keys)
    features = D.window_status(D.judge_features(numeric, categorical, _limits(spark), keys), keys)
    label = F.when(F.col("l_extendedprice") > 40000 + 900 * F.col("l_quantity"), "attack").otherwise("normal")
    attack = label == "attack"
    put_out = lambda df, k: D.output_rows(df, k, label, F.col("l_discount") * 10, F.when(attack, F.concat(F.lit("tax_"), (F.col("l_suppkey") % 3).cast("string"))), F.when(attack, F.col("l_tax") * 10))
    (base_labels, base_scores), (labels, scores) = put_out(old, []), put_out(cur, keys)
    score_counts = staged(S.counted(base_scores, ["feature"], "x"), "score-counts")
    vocabulary = base_labels.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n_ref"))
    rate = old.agg(F.avg(attack.cast("double"))).first()[0] or 0.0
    outputs = D.output_status(D.output_metrics(vocabulary, D.numeric_reference(score_counts), score_counts, labels, scores, _thresholds(spark), keys, rate, RATE_THRESHOLD), keys)
    routes = spark.createDataFrame([("live", None), ("thin", None), ("stale", "blocked")], "cohort string, reason string")
    return D.health(counts, routes, features, outputs, "cohort").withColumn("score", R(F.col("score"), 4))


def _cohorts(w):
    share = F.col("l_suppkey") % 8
    return w.withColumn("cohort", F.when(share < 5, "live").when(share == 5, "thin").when(share == 6, "stale").otherwise("unrouted"))


#: As dr15, but windows take all their rows, and the two checks before the first count as alarms before it.
STREAMED = HEALTH.replace("unnest([5000, 20000]) AS most", "unnest([1000000000, 1000000000]) AS most").replace("unnest([0, 1, 2]) AS k", "unnest([0, 1, 2, 3, 4]) AS k") + " WHERE k < 3"


@query("ss03_health_evaluation", STREAMED)
def ss03_health(spark, d):
    """The lines as a stream; statuses are judged within it, from panes of a day."""
    out, drop = scratch(spark, "health"), scratch(spark, "lines")
    w = _cohorts(_wide(spark, d))
    label = F.when(F.col("l_extendedprice") > 40000 + 900 * F.col("l_quantity"), "attack").otherwise("normal")
    attack = label == "attack"
    class_, class_score = F.when(attack, F.concat(F.lit("tax_"), (F.col("l_suppkey") % 3).cast("string"))), F.when(attack, F.col("l_tax") * 10)
    old = _old(w)
    counts, sample = staged(S.counted(D.long_numeric(old, ["id"], NUMERIC), ["feature"], "x"), "value-counts"), staged(D.reference_sample(D.long_numeric(old, ["id"], NUMERIC), "id", SAMPLE), "sample")
    flags = D.long_categorical(old, [], FLAGS).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n_ref"))
    labels, scores = D.output_rows(old, [], label, F.col("l_discount") * 10, class_, class_score)
    score_counts = staged(S.counted(scores, ["feature"], "x"), "score-counts")
    rate = old.agg(F.avg(attack.cast("double"))).first()[0] or 0.0
    ref = H.Reference(
        staged(D.numeric_reference(counts), "reference"), counts, sample, staged(flags, "vocabulary"), _limits(spark),
        staged(D.numeric_reference(score_counts), "score-reference"), score_counts, staged(labels.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n_ref")), "labels"), _thresholds(spark), rate, RATE_THRESHOLD,
    )
    w = w.withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    last = w.agg(F.date_trunc("day", F.max("ts"))).first()[0]
    w.select("ts", "cohort", "l_suppkey", *NUMERIC, *FLAGS).repartitionByRange(8, "ts").write.parquet(drop)
    stream = spark.readStream.schema(spark.read.parquet(drop).schema).parquet(drop)
    p = H.panes(stream, "ts", "cohort", NUMERIC, FLAGS, {"detector_labels": label, "classifier_labels": class_}, {"detector_scores": F.col("l_discount") * 10, "classifier_scores": class_score}, ref, "1 day", "1 day")
    routes = spark.createDataFrame([("live", None), ("thin", None), ("stale", "blocked")], "cohort string, reason string")
    step = timedelta(days=30)
    judge = H.evaluated(out, p.schema, step, last - 2 * step, [(name, days, least) for name, days, _, least in HEALTH_WINDOWS], routes, ref)
    drain(p, out, mode="update", write=judge)
    return spark.read.parquet(out).withColumns({"score": R(F.col("score"), 4), "checked_at": F.col("checked_at").cast("timestamp_ntz")})


#: Each window's evidence: rejections are orders, the truth of every third line is known, every fifth was reviewed.
EVIDENCE = f"""WITH st AS ({HEALTH}),
{LI.replace("li AS (", "raw AS (")}
src AS (SELECT *, CASE WHEN l_suppkey % 8 < 5 THEN 'live' WHEN l_suppkey % 8 = 5 THEN 'thin' WHEN l_suppkey % 8 = 6 THEN 'stale' ELSE 'unrouted' END AS cohort FROM raw),
win AS (SELECT DISTINCT "window", checked_at, CASE "window" WHEN 'fast' THEN 180 ELSE 730 END AS days, CASE "window" WHEN 'fast' THEN 5000 ELSE 20000 END AS most FROM st),
cur AS (
  SELECT s.*, w."window", w.checked_at FROM src s JOIN win w ON l_shipdate > checked_at - to_days(days) AND l_shipdate <= checked_at
  QUALIFY row_number() OVER (PARTITION BY w."window", w.checked_at, cohort ORDER BY l_shipdate DESC, id DESC) <= most
),
rated AS (
  SELECT "window", checked_at, cohort, l_extendedprice / 1000 AS ms, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_extendedprice > 42000 + 900 * l_quantity THEN 'tax_' || (l_suppkey % 3) ELSE 'normal' END END AS truth,
         CASE WHEN l_extendedprice > 40000 + 900 * (l_quantity + CASE WHEN yr = 2000 THEN 4 ELSE 0 END) THEN 'attack' ELSE 'normal' END AS said, CASE WHEN l_linenumber <> 6 THEN 'tax_' || (l_suppkey % 3) ELSE 'unclassified_attack' END AS family,
         CASE WHEN l_linenumber % 5 = 0 THEN ['confirmed', 'false_positive', 'open'][(l_suppkey % 3 + 1)::INT] END AS review FROM cur
),
perf AS (
  SELECT "window", checked_at, cohort, count(truth) AS labelled_count, count(*) FILTER (WHERE truth <> 'normal' AND said = 'attack') / nullif(count(*) FILTER (WHERE truth <> 'normal'), 0)::DOUBLE AS recall,
         count(*) FILTER (WHERE truth = 'normal' AND said = 'attack') / nullif(count(*) FILTER (WHERE truth = 'normal'), 0)::DOUBLE AS fpr,
         count(*) FILTER (WHERE truth = CASE WHEN said = 'normal' THEN said ELSE family END) / nullif(count(truth), 0)::DOUBLE AS accuracy, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95,
         count(*) FILTER (WHERE review IN ('confirmed', 'false_positive')) AS reviewed, count(*) FILTER (WHERE review = 'confirmed') AS confirmed
  FROM rated GROUP BY ALL
),
coh(cohort, no, version) AS (VALUES ('live', 0, 'v1'), ('thin', 1, 'v1'), ('stale', 2, 'v2'), ('unrouted', 3, NULL)),
rej AS (
  SELECT w."window", w.checked_at, c.cohort, o_orderpriority AS code, count(*) AS n FROM orders JOIN win w ON o_orderdate > checked_at - to_days(days) AND o_orderdate <= checked_at
  JOIN coh c ON o_custkey % 4 = c.no AND (o_orderkey % 3 = 0 OR version IS NULL OR version = 'v' || (o_orderkey % 3)) GROUP BY ALL
),
codes AS (SELECT "window", checked_at, cohort, sum(n)::BIGINT AS schema_rejections, string_agg(code || ':' || n, ',' ORDER BY code) AS error_codes FROM rej GROUP BY ALL)
SELECT "window", checked_at, cohort, status, labelled_count, round(recall, 6) AS detector_attack_recall, round(fpr, 6) AS detector_normal_false_positive_rate, round(accuracy, 6) AS cascade_accuracy,
       round(p50, 6) AS latency_median, round(p95, 6) AS latency_p95, coalesce(schema_rejections, 0) AS schema_rejections, coalesce(error_codes, '') AS error_codes, reviewed, confirmed
FROM st JOIN perf USING ("window", checked_at, cohort) LEFT JOIN codes USING ("window", checked_at, cohort)"""


@query("dr15_health_evidence", EVIDENCE)
def dr15_evidence(spark, d):
    w, checks, cur = _health_rows(spark, d)
    keys = ["window", "checked_at", "cohort"]
    family = F.concat(F.lit("tax_"), (F.col("l_suppkey") % 3).cast("string"))
    # Lines of 2000 have four more in _wide; the truth is about the line as it is.
    quantity = F.col("l_quantity") - F.when(F.col("yr") == 2000, 4).otherwise(0)
    truth = F.when(F.col("l_linenumber") % 3 == 0, F.when(F.col("l_extendedprice") > 42000 + 900 * quantity, family).otherwise("normal"))
    said = F.when(F.col("l_extendedprice") > 40000 + 900 * F.col("l_quantity"), "attack").otherwise("normal")
    rated = V.performance(cur, keys, truth, said, F.when(F.col("l_linenumber") != 6, family), F.col("l_extendedprice") / 1000)
    review = F.element_at(F.array(*map(F.lit, ("confirmed", "false_positive", "open"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    reviewed = V.reviews(cur, keys, "id", w.filter("l_linenumber % 5 = 0").select("id", review.alias("status")))
    windows = checks.select("checked_at", F.explode(F.array(*[F.struct(F.lit(name).alias("window"), F.lit(days).alias("days")) for name, days, *_ in HEALTH_WINDOWS])).alias("p")).select("checked_at", "p.*")
    windows = windows.withColumn("since", F.col("checked_at") - F.make_dt_interval(days="days"))
    o = table(spark, d, "orders")
    no = F.col("o_custkey") % 4
    channel = F.when(no == 0, "live").when(no == 1, "thin").when(no == 2, "stale").otherwise("unrouted")
    failures = o.select("o_orderdate", channel.alias("channel"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string"))).alias("version"), F.col("o_orderpriority").alias("code"))
    cohorts = spark.createDataFrame([("live", "live", "v1"), ("thin", "thin", "v1"), ("stale", "stale", "v2"), ("unrouted", "unrouted", None)], "cohort string, channel string, version string")
    told = V.rejections(failures, "o_orderdate", "channel", "version", "code", windows, cohorts, 86_400)
    out = _evaluated(spark, w, checks, cur).select(*keys, "status").join(rated, keys).join(told, keys, "left").join(reviewed, keys, "left")
    codes = F.array_join(F.transform(F.map_entries("error_codes"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    rates = [R(F.col(c)).alias(c) for c in ("detector_attack_recall", "detector_normal_false_positive_rate", "cascade_accuracy")]
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("schema_rejections", "reviewed", "confirmed")]
    return out.select(*keys, "status", "labelled_count", *rates, R(F.col("latency_median")).alias("latency_median"), R(F.col("latency_p95")).alias("latency_p95"), F.coalesce(codes, F.lit("")).alias("error_codes"), *counts)


@query("dr16_output_summary", f"WITH {ALERTS} SELECT count(*) FILTER (WHERE prediction = 'attack') AS n_attack, count(*) FILTER (WHERE prediction = 'normal') AS n_normal, round(avg((prediction = 'attack')::INT::DOUBLE), 6) AS routing_rate, round(median(confidence), 6) AS score_median, round(quantile_cont(confidence, 0.95), 6) AS score_p95 FROM alerts")
def dr16(spark, d):
    p, a = F.col("prediction"), alerts(spark, d)
    counts = a.agg(F.count_if(p == "attack").alias("n_attack"), F.count_if(p == "normal").alias("n_normal"), R(F.avg((p == "attack").cast("double"))).alias("routing_rate"))
    levels = S.quantiles(S.counted(a, [], "confidence"), [], "confidence", [0.5, 0.95])
    return counts.crossJoin(levels.select(R(F.col("q")[0]).alias("score_median"), R(F.col("q")[1]).alias("score_p95")))  # a row each


SNAPS = f"WITH {ALERTS}, snap AS (SELECT event_type AS cohort, observed_at::DATE::TIMESTAMP AS checked_at, count(*) AS n, count(*) FILTER (WHERE confidence > 0.7) > 14 AS alarm FROM alerts GROUP BY 1, 2), esc AS (SELECT *, alarm AND coalesce(lag(alarm, 1) OVER w, FALSE) AND coalesce(lag(alarm, 2) OVER w, FALSE) AS critical FROM snap WINDOW w AS (PARTITION BY cohort ORDER BY checked_at)), st AS (SELECT *, CASE WHEN critical THEN 'critical' WHEN alarm THEN 'warning' ELSE 'healthy' END AS status FROM esc)"


def _snapshots(spark, d):
    s = alerts(spark, d).groupBy(F.col("event_type").alias("cohort"), F.date_trunc("day", "observed_at").cast("timestamp_ntz").alias("checked_at"))
    s = s.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("confidence") > 0.7) > 14).alias("alarm"))
    critical = D.escalated(s, "alarm", ["cohort"], ["checked_at"])
    return s.withColumn("status", F.when(critical, "critical").when(F.col("alarm"), "warning").otherwise("healthy"))


@query("wn06_escalation", f"{SNAPS} SELECT cohort, checked_at, status FROM st")
def wn06(spark, d):
    return _snapshots(spark, d).select("cohort", "checked_at", "status")


@query("wn07_status_changed", f"{SNAPS} SELECT cohort, checked_at, status, status IS DISTINCT FROM lag(status) OVER (PARTITION BY cohort ORDER BY checked_at) AS changed FROM st")
def wn07(spark, d):
    w = Window.partitionBy("cohort").orderBy("checked_at")
    return _snapshots(spark, d).select("cohort", "checked_at", "status", (~F.lag("status").over(w).eqNullSafe(F.col("status"))).alias("changed"))


@query("wn08_newest_per_cohort", f"WITH {ALERTS} SELECT event_type, alert_id FROM alerts QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY observed_at DESC, alert_id DESC) <= 100")
def wn08(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("observed_at"), F.desc("alert_id"))
    return alerts(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 100").select("event_type", "alert_id")


@query("dr17_latest_snapshot", f"{SNAPS}, l AS (SELECT cohort, checked_at, status FROM st WHERE cohort <> 'signup' ORDER BY checked_at DESC, cohort LIMIT 1), v AS (SELECT cohort, checked_at, status FROM st WHERE cohort = 'signup' ORDER BY checked_at DESC LIMIT 1) SELECT 'default' AS asked, * FROM l UNION ALL SELECT 'signup', * FROM v")
def dr17_latest(spark, d):
    """The latest snapshot that may be deployed, and the latest of a cohort that is asked for; signups aren't eligible."""
    s = _snapshots(spark, d).withColumn("deployment_eligible", F.col("cohort") != "signup")
    one = D.latest_snapshot(s, {}).select(F.lit("default").alias("asked"), "cohort", "checked_at", "status")
    return one.unionByName(D.latest_snapshot(s, {"cohort": "signup"}).select(F.lit("signup").alias("asked"), "cohort", "checked_at", "status"))


@query("dr17_snapshot_history", f"{SNAPS} SELECT cohort, checked_at, status FROM st WHERE cohort = 'click' ORDER BY checked_at DESC LIMIT 10")
def dr17(spark, d):
    return _snapshots(spark, d).filter("cohort = 'click'").orderBy(F.desc("checked_at")).limit(10).select("cohort", "checked_at", "status")


@query("dr18_retention", f"{SNAPS} SELECT cohort, checked_at FROM st WHERE checked_at >= (SELECT max(checked_at) FROM st) - INTERVAL 9 DAY")
def dr18(spark, d):
    """Snapshots kept by day; days before the last nine are dropped."""
    s, path = _snapshots(spark, d).select("cohort", "checked_at"), scratch(spark, "snapshots")
    sinks.append_by_day(s, path, "checked_at")
    newest = spark.read.parquet(path).agg(F.max("checked_at")).first()[0]
    if newest is not None:
        sinks.retain(spark, path, "checked_at", newest - timedelta(days=9))
    return spark.read.schema(s.schema).parquet(path).select("cohort", "checked_at")


@query("dr19_readiness", f"{SNAPS}, l AS (SELECT cohort, arg_max(status, checked_at) AS status FROM st GROUP BY 1) SELECT cohort, status, CASE WHEN status = 'critical' AND cohort <> 'view' AND cohort <> 'signup' THEN 'degraded' ELSE 'ready' END AS component FROM l")
def dr19(spark, d):
    """Views are watched in shadow mode, and signups aren't eligible for deployment."""
    s = _snapshots(spark, d).groupBy("cohort").agg(F.max_by("status", "checked_at").alias("status"))
    return D.readiness(s.withColumn("shadow_mode", F.col("cohort") == "view").withColumn("deployment_eligible", F.col("cohort") != "signup")).select("cohort", "status", "component")


@query("dr20_without_reference", f"WITH {ALERTS}, c AS (SELECT event_type, count(*) AS n FROM alerts GROUP BY 1) SELECT event_type, CASE WHEN event_type = 'error' THEN 'missing_reference' WHEN n < (SELECT avg(n) FROM c) THEN 'not_enough_data' ELSE 'ok' END AS reason FROM c")
def dr20_missing(spark, d):
    """Errors have no reference, and what is rarer than the average isn't enough to be judged."""
    c = alerts(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    least = c.agg(F.avg("n")).first()[0] or 0
    refs = c.filter("event_type <> 'error'").select("event_type", F.lit("ok").alias("reason"))
    return D.judgeable(c, refs, "event_type", "n", least).select("event_type", "reason")


@query("dr20_admissibility", "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'unsupported_version' WHEN p_size % 7 = 0 THEN 'content_checksum' WHEN p_brand = 'Brand#11' THEN 'stale_detector' WHEN p_type LIKE 'PROMO%' THEN 'stale_classifier' WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN 'no_features' ELSE 'ok' END AS reason FROM part")
def dr20(spark, d):
    """Each part as the header of a reference; those of a size that seven divides were altered after their digest was taken."""
    p, size = table(spark, d, "part"), F.col("p_size")
    text = F.to_json(F.struct("p_partkey", "p_name", "p_brand", "p_retailprice"))
    headers = p.select(
        "p_partkey", F.when(size > 45, "drift-reference-v0").otherwise("drift-reference-v1").alias("schema_version"),
        F.concat(text, F.when(size % 7 == 0, " ").otherwise("")).alias("content"), F.sha2(text.cast("binary"), 256).alias("content_sha256"),
        F.when(F.col("p_brand") == "Brand#11", "d1").otherwise("d2").alias("detector_version"), F.when(F.col("p_type").startswith("PROMO"), "c1").otherwise("c2").alias("classifier_version"),
        F.when(F.col("p_partkey") % 13 == 0, 0).otherwise(83).alias("n_numeric"), F.when(F.col("p_partkey") % 17 != 0, 2).alias("n_categorical"),
    )
    return D.admissible(headers, "drift-reference-v1", "d2", "c2").select("p_partkey", "reason")
