"""Quality gates, sources and sinks over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema
from tidewatch.operators import quality as C
from tidewatch.sources import sinks, tables
from tidewatch.sources.keyed import KeyedStore

from .bindings import ALERTS, JOBS, alerts, jobs, table
from .registry import query
from .training import digest_tree_sql
from tidewatch.functions.scratch import scratch

R = lambda c, n=6: F.round(c, n)
#: Rows of text with planted defects.
DEFECTS = "raw AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'true' WHEN event_id % 83 = 0 THEN 'abc' WHEN event_id % 79 = 0 THEN 'Infinity' ELSE value::VARCHAR END AS value, CASE WHEN event_id % 71 = 0 THEN ' ' ELSE event_type END AS event_type, CASE WHEN event_id % 61 = 0 THEN 'x' ELSE user_id::VARCHAR END AS user_id FROM events)"
CODES = "CASE WHEN value IS NULL THEN 'missing:value' WHEN value IN ('true','false') THEN 'boolean:value' WHEN try_cast(value AS DOUBLE) IS NULL THEN 'not_numeric:value' WHEN isinf(try_cast(value AS DOUBLE)) THEN 'not_finite:value' END AS e1, CASE WHEN try_cast(user_id AS DOUBLE) IS NULL THEN 'not_numeric:user_id' END AS e2, CASE WHEN trim(event_type) = '' THEN 'blank:event_type' END AS e3"


def _raw(spark, d):
    i = F.col("event_id")
    value = F.when(i % 97 == 0, None).when(i % 89 == 0, "true").when(i % 83 == 0, "abc").when(i % 79 == 0, "Infinity").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select(i, value.alias("value"), F.when(i % 71 == 0, " ").otherwise(F.col("event_type")).alias("event_type"), F.when(i % 61 == 0, "x").otherwise(F.col("user_id").cast("string")).alias("user_id"))


ERRORS = C.row_errors
NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("dq01_row_errors", f"WITH {DEFECTS}, e AS (SELECT event_id, {CODES} FROM raw) SELECT event_id, concat_ws(',', e1, e2, e3) AS errors FROM e")
def dq01(spark, d):
    return _raw(spark, d).select("event_id", F.array_join(ERRORS(["value", "user_id"], ["event_type"]), ",").alias("errors"))


@query("dq01_feature_sets", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'missing:l_tax' WHEN 2 THEN 'extra:port' WHEN 3 THEN 'misordered' ELSE 'missing:l_discount+l_tax,extra:port' END AS errors FROM events")
def dq01_sets(spark, d):
    sent = [NAMES, NAMES[:3], [*NAMES, "port"], NAMES[::-1], ["port", *NAMES[:2]]]
    names, i = F.array(*map(F.lit, sent[0])), F.col("event_id") % 5
    for n, x in enumerate(sent[1:], 1):
        names = F.when(i == n, F.array(*map(F.lit, x))).otherwise(names)
    return table(spark, d, "events").select("event_id", F.array_join(C.feature_set_errors(names, NAMES), ",").alias("errors"))


@query("dq02_envelope", "SELECT event_id, concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'ends_before_start' END, CASE WHEN user_id % 2 = 0 AND event_id % 5 = 0 THEN 'fingerprint_missing' END) AS errors FROM events")
def dq02(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(i, F.col("ts").alias("started"), F.when(i % 13 == 0, F.col("ts") - F.expr("interval 1 second")).otherwise(F.col("ts")).alias("ended"), F.when(F.col("user_id") % 2 == 0, "nfstream-iot-v1").otherwise("rt-iot2022-v1").alias("version"), F.when(i % 5 != 0, "fp").alias("fp"))
    return e.select("event_id", F.array_join(C.envelope_errors("started", "ended", "version", "fp", "nfstream-iot-v1"), ",").alias("errors"))


@query("dq03_column_issues", f"WITH {DEFECTS} SELECT 'value' AS \"column\", count(*) FILTER (WHERE value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL) AS coercion_failures, count(*) FILTER (WHERE value IS NULL) AS missing, count(*) FILTER (WHERE isinf(try_cast(value AS DOUBLE))) AS infinite FROM raw UNION ALL SELECT 'user_id', count(*) FILTER (WHERE try_cast(user_id AS DOUBLE) IS NULL), 0, 0 FROM raw")
def dq03(spark, d):
    return C.column_issues(_raw(spark, d), ["value", "user_id"])


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("dq04_profile", "SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) - count(DISTINCT (l_quantity, l_discount + 0.0, l_tax + 0.0, l_returnflag, l_linestatus)) FROM lineitem) AS duplicate_rows, (SELECT count(*) - count(DISTINCT (l_quantity, l_returnflag)) FROM lineitem) AS duplicate_feature_rows, (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS n_l_returnflag, (SELECT count(DISTINCT nullif(l_linestatus, 'O')) + 1 FROM lineitem) AS n_l_linestatus")
def dq04(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") + 0.0).alias("l_discount"), (F.col("l_tax") + 0.0).alias("l_tax"), "l_returnflag", F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus"))
    p = C.profile(li, ["l_quantity", "l_returnflag"], ["l_returnflag", "l_linestatus"])
    return p.select("n_rows", "duplicate_rows", "duplicate_feature_rows", F.col("n_l_returnflag").cast("long").alias("n_l_returnflag"), F.col("n_l_linestatus").cast("long").alias("n_l_linestatus"))


@query("dq04_class_frequencies", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def dq04_classes(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("dq04_columns", "SELECT 'Unnamed: 0' AS \"column\", 'bigint' AS type, (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS missing, TRUE AS candidate UNION ALL SELECT 'event_id', 'bigint', 0, TRUE UNION ALL SELECT 'value', 'double', (SELECT count(*) FROM events WHERE event_id % 3 = 0), FALSE UNION ALL SELECT 'event_type', 'string', 0, FALSE")
def dq04_columns(spark, d):
    i = F.col("event_id")
    return C.columns_profile(table(spark, d, "events").select(F.when(i % 7 != 0, i).alias("Unnamed: 0"), "event_id", F.when(i % 3 != 0, F.col("value")).alias("value"), "event_type"))


@query("dq05_inference_frame", f"WITH {DEFECTS}, e AS (SELECT *, {CODES} FROM raw) SELECT event_type, try_cast(user_id AS DOUBLE) AS user_id, try_cast(value AS DOUBLE) AS value FROM e WHERE e1 IS NULL AND e2 IS NULL AND e3 IS NULL")
def dq05(spark, d):
    good, _ = C.quarantined(_raw(spark, d), ERRORS(["value", "user_id"], ["event_type"]))
    return C.inference_frame(good.select("value", "user_id", "event_type"), ["event_type", "user_id", "value"], ["event_type"])


BOUNDS = {"l_quantity": (1.0, 49.0), "l_extendedprice": (0.0, 99_000.0), "l_discount": (0.0, 0.09), "l_tax": (0.0, 0.08)}
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("dq06_cell_issues", f"WITH u AS (SELECT {', '.join(KEY)}, feature, x, list_position(['l_quantity','l_extendedprice','l_discount','l_tax'], feature) AS place FROM lineitem UNPIVOT (x FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))), b AS (SELECT * FROM u WHERE {' OR '.join(f'(feature = {c!r} AND (x < {lo} OR x > {hi}))' for c, (lo, hi) in BOUNDS.items())}) SELECT {', '.join(KEY)}, feature, x, (SELECT count(*) FROM b) AS n_issues FROM b ORDER BY {', '.join(KEY)}, place LIMIT 50")
def dq06(spark, d):
    return C.cell_issues(table(spark, d, "lineitem").select(*KEY, *BOUNDS), KEY, BOUNDS)


@query("dq09_quarantine_counts", f"WITH {DEFECTS}, e AS (SELECT r.*, ts, {CODES.replace('value ', 'r.value ').replace('(value ', '(r.value ').replace('(user_id ', '(r.user_id ').replace('(event_type)', '(r.event_type)')} FROM raw r JOIN events o ON r.event_id = o.event_id) SELECT coalesce(e1, e2, e3) AS error_code, count(*) AS n FROM e WHERE coalesce(e1, e2, e3) IS NOT NULL AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1")
def dq09(spark, d):
    ts = table(spark, d, "events").select("event_id", "ts")
    _, bad = C.quarantined(_raw(spark, d).join(ts, "event_id"), ERRORS(["value", "user_id"], ["event_type"]))
    now = F.broadcast(ts.agg(F.max("ts").alias("now")))
    return bad.join(now, F.col("ts") >= F.col("now") - F.expr("interval 10 days")).groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


SESSIONS = "sessions AS (SELECT c_custkey - (c_custkey % 101 = 0)::INT AS session_id, c_mktsegment AS family, c_nationkey % 4 AS run, md5((c_custkey - (c_custkey % 103 = 0)::INT)::VARCHAR) AS digest, TIMESTAMP '2024-01-01' AS started, CASE WHEN c_custkey % 107 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS ended FROM customer)"


def _sessions(spark, d):
    k = F.col("c_custkey")
    t = lambda day: F.lit(datetime(2024, 1, day)).cast("timestamp_ntz")
    return table(spark, d, "customer").select((k - (k % 101 == 0).cast("int")).alias("session_id"), F.col("c_mktsegment").alias("family"), (F.col("c_nationkey") % 4).alias("run"), F.md5((k - (k % 103 == 0).cast("int")).cast("string").cast("binary")).alias("digest"), t(1).alias("started"), F.when(k % 107 == 0, t(1)).otherwise(t(2)).alias("ended"))


@query("dq10_session_rules", f"WITH {SESSIONS}, p AS (SELECT family, count(*) AS n, count(DISTINCT run) AS runs FROM sessions GROUP BY 1) SELECT 'session_repeated' AS rule, session_id::VARCHAR AS subject FROM sessions GROUP BY session_id HAVING count(*) > 1 UNION ALL SELECT 'digest_repeated', digest FROM sessions GROUP BY digest HAVING count(*) > 1 UNION ALL SELECT 'times', session_id::VARCHAR FROM sessions WHERE started >= ended UNION ALL SELECT 'too_few_sessions', family FROM p WHERE n < 300 UNION ALL SELECT 'too_few_runs', family FROM p WHERE runs < 5 UNION ALL SELECT 'families', count(*)::VARCHAR FROM p HAVING count(*) <> 10")
def dq10(spark, d):
    return C.manifest_violations(_sessions(spark, d), 10, 300, 5)


@query("dq11_label_rules", "SELECT 'unknown_session' AS rule, o_orderkey::VARCHAR AS subject FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900) UNION ALL SELECT 'disposition', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def dq11(spark, d):
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("label_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("disposition"))
    known = table(spark, d, "customer").filter("c_acctbal > -900").select(F.col("c_custkey").alias("session_id"))
    return C.label_violations(labels, known, ["O", "F"])


@query("dq11_dispositions", "SELECT o_orderstatus AS disposition, count(*) AS n FROM orders GROUP BY 1")
def dq11_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


@query("src01_flow_csv", "SELECT user_id::VARCHAR AS user_id, event_type, event_id::VARCHAR AS event_id FROM events")
def src01(spark, d):
    path = scratch(spark, "csv")
    e = table(spark, d, "events").select(F.col("event_id").alias("Unnamed: 0"), F.col("event_id").alias("no"), "user_id", "event_type", "event_id")
    e.write.csv(path, header=True)
    return tables.flow_csv(spark, path, metadata=("event_id",), target="event_type", features=("user_id",))


#: The 83 features, as text: a whole number for each, or a category.
CANONICAL = [(c, "event_type" if c in schema.CATEGORICAL else f"CAST((event_id * {n + 3}) % 1009 AS {{}})") for n, c in enumerate(schema.FEATURES)]


@query("src01_canonical_csv", "SELECT " + ", ".join(f"{x.format('VARCHAR')} AS {schema.column(c)}" for c, x in CANONICAL) + f", 'k' || (event_id % 3) AS {schema.TARGET} FROM events")
def src01_canonical(spark, d):
    """Written in another order, beside an index; read as the contract has it."""
    path = scratch(spark, "canonical")
    e = table(spark, d, "events").select(F.col("event_id").alias("Unnamed: 0"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias(schema.TARGET), *[F.expr(x.format("STRING")).alias(c) for c, x in CANONICAL[::-1]])
    e.write.csv(path, header=True)
    return tables.flow_csv(spark, path)


ROW = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


@query("src02_ndjson", "SELECT event_id, event_type, value FROM events")
def src02(spark, d):
    path = scratch(spark, "ndjson")
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(path)
    return tables.observations_json(spark, path, ROW)


@query("src02_wrapped_json", "SELECT event_id, event_type, value FROM events")
def src02_wrapped(spark, d):
    path = scratch(spark, "json")
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    # Documents of some hundred events, a file each.
    wrapped = e.groupBy(F.expr("event_id div 500").alias("g")).agg(F.collect_list(F.struct("event_id", "event_type", "value")).alias("observations"))
    wrapped.write.partitionBy("g").json(path)
    return tables.observations_json(spark, path, ROW, lines=False)


@query("src04_sensor_events", f"WITH {ALERTS} SELECT alert_id::VARCHAR AS flow_id, source AS src_ip, signature FROM alerts WHERE signature IS NOT NULL AND k % 2 = 0")
def src04(spark, d):
    a = alerts(spark, d)
    e = F.to_json(F.struct(F.col("observed_at").cast("string").alias("timestamp"), F.when(F.col("signature").isNotNull(), "alert").otherwise("flow").alias("event_type"), F.col("alert_id").alias("flow_id"), F.col("source").alias("src_ip"), F.struct("signature").alias("alert")))
    line = F.when(F.col("k") % 2 == 0, e).otherwise(F.substring(e, 1, 20))  # torn lines
    return tables.sensor_events(a.select(line.alias("value"))).select("flow_id", "src_ip", F.col("alert.signature").alias("signature"))


@query("src05_packet_records", "SELECT user_id AS flow, count(*) AS n FROM events GROUP BY 1")
def src05(spark, d):
    from .flows import packets

    path = scratch(spark, "packets")
    packets(spark, d).select("flow", "t", "direction", "payload").write.json(path)
    return spark.read.schema("flow long, t long, direction int, payload long").json(path).groupBy("flow").agg(F.count(F.lit(1)).alias("n"))


IDS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'sensor-' || user_id WHEN 1 THEN '-' || user_id WHEN 2 THEN event_type || '.' || repeat('x', (user_id % 70)::INT) WHEN 3 THEN user_id || ' ' END AS sensor, CASE event_id % 4 WHEN 0 THEN sha256(event_type) WHEN 1 THEN md5(event_type) WHEN 2 THEN upper(sha256(event_type)) WHEN 3 THEN 'g' || substr(sha256(event_type), 2) END AS digest FROM events"


@query("dq12_identifiers", f"SELECT event_id, coalesce(regexp_full_match(sensor, '[a-zA-Z0-9][a-zA-Z0-9_.-]{{0,63}}'), FALSE) AS sensor_ok, regexp_full_match(digest, '[0-9a-fA-F]{{64}}') AS digest_ok FROM ({IDS})")
def dq12(spark, d):
    e, five, four = table(spark, d, "events"), F.col("event_id") % 5, F.col("event_id") % 4
    user, sha = F.col("user_id").cast("string"), F.sha2(F.col("event_type").cast("binary"), 256)
    sensor = F.when(five == 0, F.concat(F.lit("sensor-"), user)).when(five == 1, F.concat(F.lit("-"), user)).when(five == 2, F.concat("event_type", F.lit("."), F.repeat(F.lit("x"), (F.col("user_id") % 70).cast("int")))).when(five == 3, F.concat(user, F.lit(" ")))
    digest = F.when(four == 0, sha).when(four == 1, F.md5(F.col("event_type").cast("binary"))).when(four == 2, F.upper(sha)).otherwise(F.concat(F.lit("g"), F.substring(sha, 2, 63)))
    return e.select("event_id", C.sensor_id_ok(sensor).alias("sensor_ok"), C.digest_ok(digest).alias("digest_ok"))


@query("src06_fingerprints", "SELECT 'changed' AS problem, count(*) AS n FROM (SELECT DISTINCT event_type FROM events) WHERE event_type = 'click' UNION ALL SELECT 'missing', 1")
def src06(spark, d):
    path = scratch(spark, "files")
    table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).repartition(1).write.partitionBy("event_type").json(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    found = found.select(F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("name"), F.sha2("content", 256).alias("sha256"))
    want = found.select("name", F.when(F.col("name") == "click", "0").otherwise(F.col("sha256")).alias("sha256")).unionByName(spark.range(1).select(F.lit("model").alias("name"), F.lit("1").alias("sha256")))
    return tables.manifest_mismatches(found, want).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("snk01_idempotent_append", "SELECT event_id, event_type FROM events")
def snk01(spark, d):
    path, e = scratch(spark, "append"), table(spark, d, "events").select("event_id", "event_type")
    sinks.append_new(e.filter("event_id % 3 <> 0"), path, "event_id")
    return sinks.append_new(e, path, "event_id")


@query("snk01_refused", "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def snk01_refused(spark, d):
    path, e = scratch(spark, "append"), table(spark, d, "events").select("event_id", "event_type")
    sinks.append_new(e.filter("event_id % 3 <> 0"), path, "event_id")
    return sinks.refused(e, path, "event_id")


@query("snk01_keyed_store", "SELECT md5(event_id::VARCHAR) AS id, event_type FROM events")
def snk01_keyed(spark, d):
    """Random keys, appended in parts that overlap."""
    e = table(spark, d, "events").select(F.md5(F.col("event_id").cast("string").cast("binary")).alias("id"), "event_type", "event_id")
    store = KeyedStore(spark, scratch(spark, "keyed"), e.drop("event_id").schema, "id")
    for part in ("event_id % 3 = 0", "event_id % 3 <= 1", "true"):
        store.append(e.filter(part).drop("event_id"))
    return store.read()


@query("snk02_outbox", f"WITH {ALERTS} SELECT alert_id AS event_id, 'prediction.created' AS event_type, '{{\"alert_id\":' || alert_id || ',\"prediction\":\"' || prediction || '\"}}' AS payload FROM alerts UNION ALL SELECT alert_id, 'alert.created', '{{\"alert_id\":' || alert_id || ',\"severity\":\"' || severity || '\"}}' FROM alerts WHERE prediction = 'attack'")
def snk02(spark, d):
    a = alerts(spark, d)
    return sinks.outbox(a.select("alert_id", "prediction"), a.filter("prediction = 'attack'").select("alert_id", "severity"), "alert_id")


DEAD = ["job_id", "event_id", "state", "attempts", "error_code", "retryable", "channel", "created_at", "payload_size"]


@query("snk03_dead_letters", f"WITH {JOBS} SELECT {', '.join(DEAD)} FROM jobs WHERE state = 'dead_letter' ORDER BY created_at, job_id")
def snk03(spark, d):
    path = scratch(spark, "dead")
    out = sinks.dead_letters(jobs(spark, d), DEAD)
    out.write.json(path)
    return spark.read.schema(out.schema).json(path).orderBy("created_at", "job_id")


@query("snk04_report", "SELECT event_type, count(*) AS n, sha256('event_type=' || event_type || ';n=' || count(*)) AS digest FROM events GROUP BY 1")
def snk04(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return sinks.write_report(n, scratch(spark, "report"))


@query("snk04_artefact", f"WITH RECURSIVE rows AS (SELECT 0 AS one, sha256('event_id=' || event_id || ';event_type=' || event_type) AS v FROM events), {digest_tree_sql('one', 'rows')} SELECT n AS n_rows, digest FROM tree")
def snk04_artefact(spark, d):
    path = scratch(spark, "report")
    sinks.write_report(table(spark, d, "events").select("event_id", "event_type"), path)
    return sinks.artefact_digest(spark, path)
