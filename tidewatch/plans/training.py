"""Splits, training and scoring over the given tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import OneVsRest
from pyspark.sql import functions as F

from tidewatch.operators import metrics as M
from tidewatch.operators import severity as V
from tidewatch.operators import splits as P
from tidewatch.operators import training as TR

from tidewatch.functions import scratch
from tidewatch.functions.identity import digest_tree
from .bindings import table
from .registry import query

R = lambda c, n=6: F.round(c, n)
CUT = "CASE WHEN r <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) THEN 'validation' ELSE 'test' END AS split"

@query("wn10_session_split", f"WITH s AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7|' || c_mktsegment || '|' || c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment, {CUT} FROM s")
def wn10(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    ranked = P.by_digest(c, ["c_mktsegment"], P.digest_order(F.col("c_mktsegment"), F.col("c_custkey"), seed=7, bits=256), "c_custkey")
    return ranked.select("c_custkey", "c_mktsegment", P.cut(F.col("rank"), F.col("n_rows")).alias("split"))

STRATIFIED = f"strat AS (SELECT event_id, event_type, {CUT} FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events))"

@query("ml01_stratified_split", f"WITH {STRATIFIED} SELECT * FROM strat")
def ml01(spark, d):
    return P.stratified(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")

@query("ml02_group_split", f"WITH g AS (SELECT user_id, {CUT} FROM (SELECT user_id, row_number() OVER (ORDER BY md5('42|' || user_id), user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))) SELECT event_id, user_id, split FROM events JOIN g USING (user_id)")
def ml02(spark, d):
    return P.grouped(table(spark, d, "events").select("event_id", "user_id"), "user_id")

TEMPORAL = f"SELECT event_id, {CUT} FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events)"

@query("wn11_temporal_split", TEMPORAL)
def wn11(spark, d):
    return P.temporal(table(spark, d, "events").select("event_id", "ts"), "ts", ["event_id"]).select("event_id", "split")

@query("ml03_temporal_counts", f"SELECT split, count(*) AS n FROM ({TEMPORAL}) GROUP BY 1")
def ml03(spark, d):
    return wn11(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))

SAME = ["l_quantity", "l_returnflag", "l_linestatus", "l_suppkey"]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]

@query("wn12_keep_first", f"SELECT {', '.join(SAME + ORDER)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY {', '.join(SAME)} ORDER BY {', '.join(ORDER)}) = 1")
def wn12(spark, d):
    return P.keep_first(table(spark, d, "lineitem").select(*SAME, *ORDER), SAME, ORDER)

SPLIT3 = "CASE l_orderkey % 5 WHEN 3 THEN 'validation' WHEN 4 THEN 'test' ELSE 'train' END"

@query("st03_split_leaks", f"WITH s AS (SELECT DISTINCT {SPLIT3} AS split, l_quantity, l_returnflag, l_suppkey FROM lineitem), x AS (SELECT a.split AS a, b.split AS b FROM s a JOIN s b USING (l_quantity, l_returnflag, l_suppkey)) SELECT a, b, count(*) AS n_shared FROM x WHERE (a = 'train' AND b IN ('validation', 'test')) OR (a = 'validation' AND b = 'test') GROUP BY 1, 2")
def st03(spark, d):
    m = F.col("l_orderkey") % 5
    li = table(spark, d, "lineitem").withColumn("split", F.when(m == 3, "validation").when(m == 4, "test").otherwise("train"))
    return P.leaks(li, ["l_quantity", "l_returnflag", "l_suppkey"])

@query("st04_session_disjointness", "SELECT user_id, count(DISTINCT event_id % 5) AS parts FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 5) > 1")
def st04(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct(F.col("event_id") % 5).alias("parts")).filter("parts > 1")

@query("ml05_attack_view", f"WITH {STRATIFIED} SELECT * FROM strat WHERE event_type = 'error'")
def ml05(spark, d):
    return ml01(spark, d).filter("event_type = 'error'")

def digest_tree_sql(key: str, rows: str) -> str:
    """The digest tree by key of rows (key, v), in SQL."""
    return f"""
nodes(k, lv, i, d, n) AS (
  SELECT {key}, 0, row_number() OVER (PARTITION BY {key} ORDER BY v) - 1, v, 1::BIGINT FROM {rows}
  UNION ALL
  SELECT k, lv + 1, i // 1000, sha256(string_agg(d, ',' ORDER BY i)), sum(n)::BIGINT FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM nodes) WHERE c > 1 OR lv = 0 GROUP BY k, lv + 1, i // 1000
),
tree AS (SELECT k, arg_max(d, lv) AS digest, arg_max(n, lv) AS n FROM nodes GROUP BY k)"""


@query("ml06_partition_fingerprint", f"WITH RECURSIVE {STRATIFIED}, parts AS (SELECT split, event_id::VARCHAR AS v FROM strat), {digest_tree_sql('split', 'parts')} SELECT k AS split, digest, n FROM tree")
def ml06(spark, d):
    return digest_tree(ml01(spark, d), ["split"], "event_id")

@query("ml07_manifest_split", f"WITH g AS (SELECT c_custkey, {CUT} FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) AS r, count(*) OVER () AS n FROM customer)) SELECT o_orderkey, split FROM orders JOIN g ON o_custkey = c_custkey")
def ml07(spark, d):
    manifest = P.grouped(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return table(spark, d, "orders").join(manifest, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "split")

@query("ag22_session_counts", f"WITH s AS (SELECT c_mktsegment, {CUT} FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7|' || c_mktsegment || '|' || c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)) SELECT split, c_mktsegment AS family, count(*) AS n FROM s GROUP BY 1, 2")
def ag22(spark, d):
    return wn10(spark, d).groupBy("split", F.col("c_mktsegment").alias("family")).agg(F.count(F.lit(1)).alias("n"))

@query("ml09_class_weights", "SELECT event_type, round((SELECT count(*) FROM events)::DOUBLE / (5 * count(*)), 6) AS weight, count(*) AS n FROM events GROUP BY 1")
def ml09(spark, d):
    w = P.balanced_weights(table(spark, d, "events").select("event_type"), "event_type")
    return w.groupBy("event_type", R(F.col("weight")).alias("weight")).agg(F.count(F.lit(1)).alias("n"))

@query("ml22_rule_detector", "SELECT event_id, round(s, 6) AS score, CASE WHEN s >= 0.5 THEN 'attack' ELSE 'normal' END AS label, CASE WHEN s >= 0.5 THEN 'suspicious_activity' END AS family, round(CASE WHEN s >= 0.5 THEN s ELSE 1 - s END, 6) AS confidence FROM (SELECT event_id, least(0.99::DOUBLE, 0.02::DOUBLE + least(value / 100, 0.55::DOUBLE) + least(k / 100::DOUBLE, 0.2::DOUBLE) + least(value * k * 10 / 100000, 0.2::DOUBLE)) AS s FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))")
def ml22(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    s = V.rule_score(F.col("value"), k, F.col("value") * k * 10)
    e = table(spark, d, "events").withColumn("s", s).withColumn("label", V.rule_label(F.col("s")))
    attack = F.col("label") == "attack"
    return e.select("event_id", R(F.col("s")).alias("score"), "label", F.when(attack, "suspicious_activity").alias("family"), R(F.when(attack, F.col("s")).otherwise(1 - F.col("s"))).alias("confidence"))

NUMERIC, CATEGORICAL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_linestatus"]

def _flows(spark, d):
    """Lines as flows that can be told apart: what is dear for its quantity is an attack, of a family by its discount."""
    li = table(spark, d, "lineitem").withColumn("id", F.xxhash64(*ORDER))
    attack = F.col("l_extendedprice") > 40_000 + 900 * F.col("l_quantity")
    family = F.when(F.col("l_discount") > 0.06, "dos").when(F.col("l_discount") > 0.03, "scan").otherwise("brute")
    # Some numbers are missing, as in captured data.
    li = li.withColumn("binary", F.when(attack, "attack").otherwise("normal")).withColumn("family", F.when(attack, family).otherwise("normal")).withColumn("l_tax", F.when(F.col("id") % 11 != 0, F.col("l_tax")))
    return P.stratified(li.select("id", "l_suppkey", *NUMERIC, *CATEGORICAL, "binary", "family"), "family", "id")

def _part(df, name):
    return df.filter(F.col("split") == name)

def _evaluated(scored, truth, label, model):
    s = M.summary(M.per_class(M.confusion(scored, truth, label)))
    return s.select(F.lit(model).alias("model"), R(F.col("macro_f1"), 3).alias("macro_f1"), R(F.col("accuracy"), 3).alias("accuracy"), R(F.col("macro_fpr"), 3).alias("macro_fpr"))

#: Fits of `_compare` that run beside each other; a boosted model is hundreds of short jobs.
AT_ONCE = 4
#: Training rows from which trees are fitted on cells of rows that are the same to them.
CELLS_FROM = 1_000_000

def _compare(spark, d, target, rows, seeds=(42,)):
    """Each candidate of each seed on the validation rows. Rows are prepared once for all of them, and a model that
    has no seed is fitted once."""
    df = scratch.staged(_flows(spark, d).filter(rows), "flows")
    classes = 2 if target == "binary" else 3
    train, validation = _part(df, "train"), _part(df, "validation")

    def prepared(scale):
        p = TR.prepare(train, target, NUMERIC, CATEGORICAL, scale, CELLS_FROM)
        return replace(p, rows=scratch.staged(p.rows, "features"))

    plain, scaled = prepared(False), prepared(True)

    def judged(job):
        name, model, own = job
        fitted = TR.fit_prepared(scaled if name == "logistic" else plain, model)
        applied = fitted.applied(validation, [target])
        part = _evaluated(TR.calibrate_applied(fitted, applied, target).decided(applied, "m"), target, "m_label", name)
        return part.crossJoin(spark.createDataFrame([(s,) for s in own], "seed int"))

    jobs = []
    for seed in seeds:
        for name, model in TR.candidates(classes, seed).items():
            if model.hasParam("seed") or isinstance(model, OneVsRest):
                jobs.append((name, model, [seed]))
            elif seed == seeds[0]:
                jobs.append((name, model, list(seeds)))
    # The longest first.
    jobs.sort(key=lambda j: ["forest", "boosting", "logistic", "tree"].index(j[0]))
    with ThreadPool(AT_ONCE) as pool:
        parts = pool.map(inheritable_thread_target(spark)(judged), jobs, chunksize=1)
    return reduce(lambda a, b: a.unionByName(b), parts)

@query("ml08_preprocess")
def ml08(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    df = scratch.staged(_flows(spark, d), "flows")
    out = Pipeline(stages=TR.preprocessing(NUMERIC, CATEGORICAL, True)).fit(_part(df, "train")).transform(df)
    return out.select("id", "split", F.size(vector_to_array("features")).alias("n_features"), R(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)).alias("total"))

@query("ml10_detector_candidates")
def ml10(spark, d):
    return _compare(spark, d, "binary", "true").drop("seed")

@query("ml13_family_candidates")
def ml13(spark, d):
    c = _compare(spark, d, "family", "binary = 'attack'").drop("seed")
    return c.withColumn("champion", F.row_number().over(M.one().orderBy(F.desc("macro_f1"), "model")) == 1)

@query("ml12_seeds_and_champion")
def ml12(spark, d):
    runs = _compare(spark, d, "binary", "true", (42, 1337, 2026))
    m = runs.groupBy("model").agg(F.avg("macro_f1").alias("mean_f1"), F.avg("macro_fpr").alias("mean_fpr"), F.count(F.lit(1)).alias("runs"))
    return m.withColumn("rank", F.row_number().over(M.one().orderBy(F.desc("mean_f1"), "mean_fpr", "model")))

@query("ml12_realistic_split")
def ml12_realistic(spark, d):
    """The chosen architecture once more, fitted and judged on parts that share no supplier; without enough
    suppliers one row that says why there is no such split."""
    df = scratch.staged(_flows(spark, d).drop("split"), "flows")
    split, how = P.realistic(df, ["l_suppkey"], None, ["id"])
    if split is None:
        return spark.createDataFrame([("none", how["reason"], None, None)], "part string, strategy string, macro_f1 double, accuracy double")
    split = scratch.staged(split, "realistic")
    own = TR.calibrate(TR.fit(_part(split, "train"), "binary", NUMERIC, CATEGORICAL, TR.candidates(2)["tree"]), _part(split, "validation"), "binary")
    parts = [_evaluated(own.score(_part(split, name), "m"), "binary", "m_label", name) for name in ("validation", "test")]
    return parts[0].unionByName(parts[1]).select(F.col("model").alias("part"), F.lit(how["strategy"]).alias("strategy"), "macro_f1", "accuracy")

def _models(spark, d):
    df = scratch.staged(_flows(spark, d), "flows")
    tree = TR.candidates(2)["tree"]
    train = _part(df, "train")
    held, attacks = _part(df, "validation"), "binary = 'attack'"
    detector, classifier = TR.fit(train, "binary", NUMERIC, CATEGORICAL, tree), TR.fit(train.filter(attacks), "family", NUMERIC, CATEGORICAL, tree)
    return df, TR.calibrate(detector, held, "binary"), TR.calibrate(classifier, held.filter(attacks), "family")

@query("ml11_calibration")
def ml11(spark, d):
    """How often a label of each model is right, by the tenth of its calibrated probability, on the test rows."""
    df, detector, classifier = _models(spark, d)
    test = _part(df, "test")
    parts = []
    for name, model, rows, truth in (("detector", detector, test, "binary"), ("classifier", classifier, test.filter("binary = 'attack'"), "family")):
        long = model.score(rows, "m").select(truth, F.explode(F.map_from_arrays(F.array(*map(F.lit, model.labels)), "m_probability")).alias("label", "p"))
        by = long.groupBy(F.lit(name).alias("model"), "label", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin"))
        parts.append(by.agg(F.count(F.lit(1)).alias("n"), R(F.avg("p"), 4).alias("mean_p"), R(F.avg((F.col(truth) == F.col("label")).cast("double")), 4).alias("share")))
    return parts[0].unionByName(parts[1])

@query("ml20_cascade")
def ml20(spark, d):
    df, detector, classifier = _models(spark, d)
    return TR.cascade(_part(df, "test"), detector, classifier).select("id", "binary", "family", "detector_label", "attack_class", R(F.col("confidence"), 4).alias("confidence"))

@query("ml21_class_scores")
def ml21(spark, d):
    df, detector, classifier = _models(spark, d)
    c = TR.cascade(_part(df, "test"), detector, classifier).filter("attack_class is not null")
    return c.select("id", "attack_class", F.explode("class_scores").alias("label", "score")).withColumn("score", R(F.col("score"), 4))
