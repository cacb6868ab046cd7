"""Evaluation metrics over document labels, and scores over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import distributions as S
from tidewatch.operators import metrics as M

from .bindings import table
from .registry import query

R = lambda c, n=6: F.round(c, n)
#: Fixed classes of events against what a rule says of their value.
PAIRS = "pairs AS (SELECT event_id, event_type AS truth, CASE WHEN value > 60 THEN 'error' WHEN value > 40 THEN 'view' WHEN value > 25 AND event_id % 2 = 0 THEN event_type WHEN value > 12 THEN 'click' ELSE 'signup' END AS predicted, least(value / 100, 1.0::DOUBLE) AS score, user_id % 3 AS seed FROM events)"


def _pairs(spark, d):
    v = F.col("value")
    said = F.when(v > 60, "error").when(v > 40, "view").when((v > 25) & (F.col("event_id") % 2 == 0), F.col("event_type")).when(v > 12, "click").otherwise("signup")
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("truth"), said.alias("predicted"), F.least(v / 100, F.lit(1.0)).alias("score"), (F.col("user_id") % 3).alias("seed"))


def _matrix_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON TRUE"
    return f"n AS (SELECT {k}truth AS actual, predicted, count(*) AS n FROM pairs GROUP BY ALL), labels AS (SELECT {k}actual AS label FROM n UNION SELECT {k}predicted FROM n), matrix AS (SELECT {k}g.actual, g.predicted, coalesce(n, 0) AS n FROM (SELECT {('a.' + keys + ',') if keys else ''} a.label AS actual, b.label AS predicted FROM labels a JOIN labels b {using}) g LEFT JOIN n USING ({k}actual, predicted))"


def _classes_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    return f"""{_matrix_sql(keys)}, c AS (SELECT {k}label, sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM (SELECT {k}actual AS label, n AS t, 0 AS p, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM matrix UNION ALL SELECT {k}predicted, 0, n, 0 FROM matrix) GROUP BY ALL),
r AS (SELECT *, sum(support) {over} AS total, coalesce(tp / nullif(predicted, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall FROM c),
classes AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce((predicted - tp) / nullif(total - support, 0), 0)::DOUBLE AS fpr FROM r)"""


def _summary_sql(keys: str = "") -> str:
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    return f"""{_classes_sql(keys)}, rare AS (SELECT *, CASE WHEN support = min(support) FILTER (WHERE support > 0) {over} THEN recall END AS rare FROM classes),
summary AS (SELECT {k}sum(tp) / sum(support) AS accuracy, avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, avg(fpr) AS macro_fpr,
  sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1,
  coalesce((sum(tp) * sum(support) - sum(support * predicted))::DOUBLE / nullif(sqrt((sum(support) ** 2 - sum(predicted ** 2))::DOUBLE) * sqrt((sum(support) ** 2 - sum(support ** 2))::DOUBLE), 0), 0) AS mcc, avg(rare) AS rare_recall FROM rare {g})"""


SUMMARY = ["accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "macro_fpr", "weighted_precision", "weighted_recall", "weighted_f1"]


@query("ev01_confusion", f"WITH {PAIRS}, {_matrix_sql()} SELECT actual, predicted, n FROM matrix")
def ev01(spark, d):
    return M.confusion(_pairs(spark, d), "truth", "predicted")


@query("ev02_per_class", f"WITH {PAIRS}, {_classes_sql()} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, round(fpr, 6) AS fpr FROM classes")
def ev02(spark, d):
    c = M.per_class(M.confusion(_pairs(spark, d), "truth", "predicted"))
    return c.select("label", *[R(F.col(x)).alias(x) for x in ("precision", "recall", "f1", "fpr")], "support")


def _summary(spark, d, keys=[]):
    return M.summary(M.per_class(M.confusion(_pairs(spark, d), "truth", "predicted", keys), keys), keys)


@query("ev03_summary", f"WITH {PAIRS}, {_summary_sql()} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in SUMMARY)} FROM summary")
def ev03(spark, d):
    return _summary(spark, d).select(*[R(F.col(c)).alias(c) for c in SUMMARY])


@query("ev04_matthews", f"WITH {PAIRS}, {_summary_sql('seed')} SELECT seed, round(mcc, 6) AS mcc FROM summary")
def ev04(spark, d):
    return _summary(spark, d, ["seed"]).select("seed", R(F.col("mcc")).alias("mcc"))


@query("ev05_rare_recall", f"WITH {PAIRS}, {_summary_sql('seed')} SELECT seed, round(rare_recall, 6) AS rare_recall FROM summary")
def ev05(spark, d):
    return _summary(spark, d, ["seed"]).select("seed", R(F.col("rare_recall")).alias("rare_recall"))


EXTRAS = "count(*) FILTER (WHERE truth = 'error') AS p, count(*) FILTER (WHERE truth <> 'error') AS n, count(*) FILTER (WHERE predicted = 'error') AS s, count(*) FILTER (WHERE truth = 'error' AND predicted = 'error') AS tp, count(*) AS a"


@query("ev06_binary", f"WITH {PAIRS}, x AS (SELECT {EXTRAS} FROM pairs) SELECT round((s - tp) / n, 6) AS normal_fpr, round(s / a, 6) AS alert_rate, round(tp / s, 6) AS attack_precision, round(tp / p, 6) AS attack_recall, round(2 * (tp / s) * (tp / p) / (tp / s + tp / p), 6) AS attack_f1 FROM x")
def ev06(spark, d):
    e = M.binary_extras(_pairs(spark, d), F.col("truth") == "error", F.col("predicted") == "error")
    return e.select(*[R(F.col(c)).alias(c) for c in e.columns])


CURVE = "s AS (SELECT seed, score, count(*) FILTER (WHERE truth = 'error') AS pos, count(*) AS n FROM pairs GROUP BY 1, 2), curve AS (SELECT seed, score, sum(pos) OVER w / sum(n) OVER w AS precision, sum(pos) OVER w / sum(pos) OVER (PARTITION BY seed) AS recall FROM s WINDOW w AS (PARTITION BY seed ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


def _curve(spark, d):
    return M.precision_recall(_pairs(spark, d), ["seed"], "score", F.col("truth") == "error")


#: The last class never occurs, so it has no average precision.
CLASSES = ("click", "view", "purchase", "signup", "error", "never")
RANKED = f"""
rated AS (
  SELECT seed, label, truth = label AS positive, CASE WHEN predicted = label THEN score ELSE 1 - score END AS score
  FROM pairs CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in CLASSES)}) v(label)
),
counted AS (SELECT seed, label, score, count(*) FILTER (WHERE positive) AS pos, count(*) AS n FROM rated GROUP BY ALL),
summed AS (
  SELECT seed, label, pos, sum(pos) OVER w / sum(n) OVER w AS precision, sum(pos) OVER (PARTITION BY seed, label) AS positives, sum(n) OVER (PARTITION BY seed, label) AS rows
  FROM counted WINDOW w AS (PARTITION BY seed, label ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
)"""


@query("ev07_average_precision", f"WITH {PAIRS}, {RANKED} SELECT seed, label, round(sum(precision * pos / positives) FILTER (WHERE positives BETWEEN 1 AND rows - 1), 6) AS average_precision FROM summed GROUP BY 1, 2")
def ev07(spark, d):
    own = F.col("predicted") == F.col("label")
    rated = _pairs(spark, d).withColumn("label", F.explode(F.array(*map(F.lit, CLASSES)))).withColumn("score", F.when(own, F.col("score")).otherwise(1 - F.col("score")))
    area = M.average_precision(rated, ["seed", "label"], "score", F.col("truth") == F.col("label"))
    return area.select("seed", "label", R(F.col("average_precision")).alias("average_precision"))


COMPACT = """
placed AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY seed) AS m FROM curve),
steps AS (SELECT seed, m, unnest(CASE WHEN m <= 255 THEN range(m) ELSE list_distinct([k * (m - 1) // 254 FOR k IN range(255)]) END) AS i FROM (SELECT DISTINCT seed, m FROM placed))
SELECT seed, score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM placed JOIN steps USING (seed, m, i) UNION ALL SELECT DISTINCT seed, NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM placed"""


@query("ev08_compact_curve", f"WITH {PAIRS}, {CURVE}, {COMPACT}")
def ev08(spark, d):
    return M.compacted(_curve(spark, d), ["seed"], "score").select("seed", "score", R(F.col("precision")).alias("precision"), R(F.col("recall")).alias("recall"))


@query("ev09_threshold_sweep", f"WITH {PAIRS}, t AS (SELECT i, i / 100 AS threshold, count(*) FILTER (WHERE b >= i) AS s, count(*) FILTER (WHERE b >= i AND truth = 'error') AS tp, count(*) FILTER (WHERE truth = 'error') AS p, count(*) AS a FROM (SELECT truth, least(100, floor(round(score * 100, 9)))::INT AS b FROM pairs) CROSS JOIN range(101) r(i) GROUP BY i) SELECT threshold, round(tp / p, 6) AS recall, round(coalesce(tp / nullif(s, 0), 0), 6) AS precision, round((s - tp) / (a - p), 6) AS fpr, round(s / a, 6) AS alert_rate FROM t")
def ev09(spark, d):
    t = M.threshold_sweep(_pairs(spark, d), "score", F.col("truth") == "error")
    return t.select("threshold", *[R(F.col(c)).alias(c) for c in ("recall", "precision", "fpr", "alert_rate")])


CASCADE = "pairs AS (SELECT user_id % 3 AS seed, CASE WHEN event_type = 'error' THEN 'family_' || (event_id % 4) ELSE 'normal' END AS truth, CASE WHEN routed THEN 'family_' || (CASE WHEN event_type = 'error' AND value > 30 THEN event_id % 4 ELSE (event_id + 1) % 4 END) ELSE 'normal' END AS predicted, routed FROM (SELECT *, (event_type = 'error' AND value > 10) OR value > 90 AS routed FROM events))"


def _cascade(spark, d):
    e = table(spark, d, "events")
    attack = F.col("event_type") == "error"
    family = lambda i: F.concat(F.lit("family_"), i.cast("string"))
    routed = (attack & (F.col("value") > 10)) | (F.col("value") > 90)
    said = family(F.when(attack & (F.col("value") > 30), F.col("event_id") % 4).otherwise((F.col("event_id") + 1) % 4))
    return e.select((F.col("user_id") % 3).alias("seed"), F.when(attack, family(F.col("event_id") % 4)).otherwise("normal").alias("truth"), F.when(routed, said).otherwise("normal").alias("predicted"), routed.alias("routed"))


@query("ev10_cascade", f"WITH {CASCADE}, {_summary_sql('seed')}, x AS (SELECT seed, count(*) FILTER (WHERE truth <> 'normal' AND predicted = 'normal') AS false_negatives, count(*) FILTER (WHERE routed) AS routed FROM pairs GROUP BY 1) SELECT seed, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy, false_negatives, routed, round(avg(macro_f1) OVER (), 6) AS mean_macro_f1 FROM summary JOIN x USING (seed)")
def ev10(spark, d):
    p = _cascade(spark, d)
    s = M.summary(M.per_class(M.confusion(p, "truth", "predicted", ["seed"]), ["seed"]), ["seed"])
    x = p.groupBy("seed").agg(F.count_if((F.col("truth") != "normal") & (F.col("predicted") == "normal")).alias("false_negatives"), F.count_if("routed").alias("routed"))
    return s.join(x, "seed").select("seed", R(F.col("macro_f1")).alias("macro_f1"), R(F.col("accuracy")).alias("accuracy"), "false_negatives", "routed", R(F.avg("macro_f1").over(M.one())).alias("mean_macro_f1"))


RUNS = "SELECT l_shipmode_ AS model, seed, avg(l_discount) AS f1, avg(l_tax) AS fpr, quantile_cont(l_extendedprice, 0.95) AS p95, avg(l_quantity) AS size FROM (SELECT *, 'model_' || (l_suppkey % 4) AS l_shipmode_, l_orderkey % 3 AS seed FROM lineitem) GROUP BY 1, 2"


@query("ev11_candidate_ranking", f"WITH r AS ({RUNS}), m AS (SELECT model, avg(f1) AS f1, avg(fpr) AS fpr, avg(p95) AS p95, avg(size) AS size FROM r GROUP BY 1) SELECT model, round(f1, 6) AS mean_f1, row_number() OVER (ORDER BY round(f1, 9) DESC, round(fpr, 9), p95, size, model)::INT AS rank FROM m")
def ev11(spark, d):
    li = table(spark, d, "lineitem").withColumn("model", F.concat(F.lit("model_"), (F.col("l_suppkey") % 4).cast("string"))).withColumn("seed", F.col("l_orderkey") % 3)
    runs = li.groupBy("model", "seed").agg(F.avg("l_discount").alias("f1"), F.avg("l_tax").alias("fpr"), F.avg("l_quantity").alias("size"))
    levels = S.quantiles(S.counted(li, ["model", "seed"], "l_extendedprice"), ["model", "seed"], "l_extendedprice", [0.95])
    runs = runs.join(levels.select("model", "seed", F.col("q")[0].alias("p95")), ["model", "seed"])
    m = runs.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("f1", "fpr", "p95", "size")])
    return m.select("model", R(F.col("f1")).alias("mean_f1"), F.row_number().over(M.one().orderBy(F.desc(R(F.col("f1"), 9)), R(F.col("fpr"), 9), "p95", "size", "model")).alias("rank"))


Z = 1.959963984540054
WILSON = f"CASE WHEN n = 0 OR s = 0 THEN 0 ELSE greatest(0, (p + {Z * Z}::DOUBLE / (2 * n)) / (1 + {Z * Z}::DOUBLE / n) - {Z}::DOUBLE * sqrt(p * (1 - p) / n + {Z * Z}::DOUBLE / (4 * n * n)) / (1 + {Z * Z}::DOUBLE / n)) END AS low, CASE WHEN n = 0 OR s = n THEN 1 ELSE least(1, (p + {Z * Z}::DOUBLE / (2 * n)) / (1 + {Z * Z}::DOUBLE / n) + {Z}::DOUBLE * sqrt(p * (1 - p) / n + {Z * Z}::DOUBLE / (4 * n * n)) / (1 + {Z * Z}::DOUBLE / n)) END AS high"


@query("ev12_wilson", f"WITH x AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS s, count(*) FILTER (WHERE event_type = 'error') / count(*) AS p FROM events GROUP BY 1), y AS (SELECT user_id, {WILSON} FROM x) SELECT user_id, round(low::DOUBLE, 6) AS low, round(high::DOUBLE, 6) AS high FROM y")
def ev12(spark, d):
    x = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("s"))
    low, high = S.wilson(F.col("s"), F.col("n"))
    return x.select("user_id", R(low).alias("low"), R(high).alias("high"))


BOUNDS = [("detector_recall", 0.95, True, 1000), ("normal_fpr", 0.02, False, 1000), ("macro_f1", 0.85, True, 1000), *[(f"recall_family_{i}", 0.70, True, 200) for i in range(4)]]


@query("ev13_gates", f"WITH {CASCADE}, {_classes_sql()}, g AS (SELECT * FROM (VALUES {', '.join(f'({g!r}, {b}::DOUBLE, {a}, {m})' for g, b, a, m in BOUNDS)}) t(gate, bound, at_least, minimum_support)), v AS (SELECT 'detector_recall' AS gate, count(*) FILTER (WHERE truth <> 'normal' AND routed) / count(*) FILTER (WHERE truth <> 'normal') AS value, count(*) FILTER (WHERE truth <> 'normal') AS support FROM pairs UNION ALL SELECT 'normal_fpr', count(*) FILTER (WHERE truth = 'normal' AND routed) / count(*) FILTER (WHERE truth = 'normal'), count(*) FILTER (WHERE truth = 'normal') FROM pairs UNION ALL SELECT 'macro_f1', avg(f1), sum(support)::BIGINT FROM classes UNION ALL SELECT 'recall_' || label, recall, support FROM classes WHERE label <> 'normal'), j AS (SELECT gate, value, CASE WHEN at_least THEN value >= bound ELSE value <= bound END AND support >= minimum_support AS passed FROM g LEFT JOIN v USING (gate)) SELECT gate, round(value, 6) AS value, passed, bool_and(passed) OVER () AS promoted FROM j")
def ev13(spark, d):
    p = _cascade(spark, d)
    attack = F.col("truth") != "normal"
    a = p.agg(F.count_if(attack).alias("p"), F.count_if(~attack).alias("n"), F.count_if(attack & F.col("routed")).alias("tp"), F.count_if(~attack & F.col("routed")).alias("fp"))
    rates = a.select(F.explode(F.array(F.struct(F.lit("detector_recall").alias("gate"), (F.col("tp") / F.col("p")).alias("value"), F.col("p").alias("support")), F.struct(F.lit("normal_fpr").alias("gate"), (F.col("fp") / F.col("n")).alias("value"), F.col("n").alias("support")))).alias("x")).select("x.*")
    c = M.per_class(M.confusion(p, "truth", "predicted"))
    metrics = rates.unionByName(c.agg(F.lit("macro_f1").alias("gate"), F.avg("f1").alias("value"), F.sum("support").alias("support")))
    metrics = metrics.unionByName(c.filter("label <> 'normal'").select(F.concat(F.lit("recall_"), "label").alias("gate"), F.col("recall").alias("value"), "support"))
    bounds = spark.createDataFrame(BOUNDS, "gate string, bound double, at_least boolean, minimum_support long")
    return M.gates(metrics, bounds).select("gate", R(F.col("value")).alias("value"), "passed", "promoted")


@query("ev14_row_percent", f"WITH {PAIRS}, {_matrix_sql()} SELECT actual, predicted, round(coalesce(n * 100 / nullif(sum(n) OVER (PARTITION BY actual), 0), 0), 6) AS percent FROM matrix")
def ev14(spark, d):
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy("actual"))
    return M.confusion(_pairs(spark, d), "truth", "predicted").select("actual", "predicted", R(F.when(total > 0, F.col("n") * 100 / total).otherwise(0.0)).alias("percent"))


#: Three candidates whose rules are shifted by two each; all kinds of events, and errors against the rest.
CANDIDATES = """
said AS (
  SELECT 'model_' || m AS model, user_id % 3 AS seed, CASE WHEN event_id % 2 = 0 THEN 'validation' ELSE 'test' END AS part, event_type AS truth,
         CASE WHEN v > 60 THEN 'error' WHEN v > 40 THEN 'view' WHEN v > 25 AND event_id % 2 = 0 THEN event_type WHEN v > 12 THEN 'click' ELSE 'signup' END AS predicted
  FROM (SELECT *, value + 2 * m AS v FROM events CROSS JOIN range(3) r(m))
),
pairs AS (
  SELECT 'multiclass|' || model || '|' || seed || '|' || part AS g, truth, predicted FROM said
  UNION ALL SELECT 'binary|' || model || '|' || seed || '|' || part, CASE WHEN truth = 'error' THEN 'attack' ELSE 'normal' END, CASE WHEN predicted = 'error' THEN 'attack' ELSE 'normal' END FROM said
)"""
COMPACTED = f"""WITH {CANDIDATES}, {_summary_sql('g')},
s AS (SELECT *, split_part(g, '|', 1) AS stage, split_part(g, '|', 2) AS model, split_part(g, '|', 3)::BIGINT AS seed, split_part(g, '|', 4) AS part FROM summary),
runs AS (SELECT stage, model, avg(macro_f1) AS selection_value, min(macro_f1) AS low, max(macro_f1) AS high, count(*) AS n_seeds FROM s WHERE part = 'validation' GROUP BY 1, 2),
picked AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY round(selection_value, 9) DESC, model) = 1 AS selected FROM runs),
cells AS (SELECT g, string_agg(actual || '>' || predicted || ':' || n, ',' ORDER BY actual, predicted) AS confusion FROM matrix GROUP BY 1),
sizes AS (SELECT g, string_agg(label || ':' || support, ',' ORDER BY label) AS class_support FROM classes GROUP BY 1)
SELECT p.stage, p.model, CASE WHEN selected THEN p.stage || '-v1' ELSE 'evaluation-only' END AS model_version, selected, round(selection_value, 6) AS selection_value, round(low, 6) AS least_macro_f1, round(high, 6) AS most_macro_f1, n_seeds,
       round(v.macro_f1, 6) AS validation_macro_f1, round(t.macro_f1, 6) AS test_macro_f1, round(t.weighted_f1, 6) AS test_weighted_f1, round(t.accuracy, 6) AS test_accuracy, round(t.mcc, 6) AS test_mcc,
       CASE WHEN p.stage = 'binary' THEN round(t.macro_fpr, 6) END AS test_false_positive_rate, confusion, class_support
FROM picked p JOIN s v ON v.stage = p.stage AND v.model = p.model AND v.seed = 1 AND v.part = 'validation' JOIN s t ON t.stage = p.stage AND t.model = p.model AND t.seed = 1 AND t.part = 'test' JOIN cells ON cells.g = t.g JOIN sizes ON sizes.g = t.g"""


@query("ev16_candidates", COMPACTED)
def ev16_candidates(spark, d):
    """The evaluation view of both stages, with seed 1 promoted."""
    e = table(spark, d, "events").select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("m")).withColumn("v", F.col("value") + 2 * F.col("m"))
    v = F.col("v")
    predicted = F.when(v > 60, "error").when(v > 40, "view").when((v > 25) & (F.col("event_id") % 2 == 0), F.col("event_type")).when(v > 12, "click").otherwise("signup")
    rows = e.select(F.lit("multiclass").alias("stage"), F.concat(F.lit("model_"), F.col("m").cast("string")).alias("model"), (F.col("user_id") % 3).alias("seed"), F.when(F.col("event_id") % 2 == 0, "validation").otherwise("test").alias("part"), F.col("event_type").alias("truth"), predicted.alias("predicted"))
    two = lambda c: F.when(F.col(c) == "error", "attack").otherwise("normal")
    rows = rows.unionByName(rows.withColumns({"stage": F.lit("binary"), "truth": two("truth"), "predicted": two("predicted")}))
    out = M.evaluation_view(rows, {"binary": "binary-v1", "multiclass": "multiclass-v1"}, 1)
    cells = F.array_join(F.transform("confusion", lambda c: F.concat(c["actual"], F.lit(">"), c["predicted"], F.lit(":"), c["n"].cast("string"))), ",")
    support = F.array_join(F.transform("class_support", lambda c: F.concat(c["label"], F.lit(":"), c["support"].cast("string"))), ",")
    rounded = ["selection_value", "least_macro_f1", "most_macro_f1", "validation_macro_f1", "test_macro_f1", "test_weighted_f1", "test_accuracy", "test_mcc", "test_false_positive_rate"]
    return out.select("stage", "model", "model_version", "selected", "n_seeds", *[R(F.col(c)).alias(c) for c in rounded], cells.alias("confusion"), support.alias("class_support"))


@query("ev16_evaluation_view", f"WITH {PAIRS}, {_summary_sql('seed')}, s AS (SELECT seed, string_agg(label || ':' || support, ',' ORDER BY label) AS class_support FROM classes GROUP BY 1) SELECT seed, round(macro_f1, 6) AS f1_macro, round(macro_fpr, 6) AS fpr, class_support, row_number() OVER (ORDER BY round(macro_f1, 9) DESC, seed) = 1 AS champion FROM summary JOIN s USING (seed)")
def ev16(spark, d):
    c = M.per_class(M.confusion(_pairs(spark, d), "truth", "predicted", ["seed"]), ["seed"])
    told = c.groupBy("seed").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "support")))).alias("m"))
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    s = M.summary(c, ["seed"]).join(told, "seed")
    return s.select("seed", R(F.col("macro_f1")).alias("f1_macro"), R(F.col("macro_fpr")).alias("fpr"), text.alias("class_support"), (F.row_number().over(M.one().orderBy(F.desc(R(F.col("macro_f1"), 9)), "seed")) == 1).alias("champion"))
