"""Streams over events, dropped as files in a folder and read until there is no more."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import identity
from tidewatch.operators.predictors import RuleDetector
from tidewatch.sources import growing, tables
from tidewatch.sources.keyed import KeyedStore
from tidewatch.streaming import flows as S
from tidewatch.streaming import state

from .bindings import ALERTS, alerts
from .registry import query
from tidewatch.functions.scratch import scratch

FIELDS = "alert_id long, user_id long, event_type string, severity string, k int, value double, ts timestamp"


def _stream(spark, d, twice: bool = False):
    """alerts as a stream of files in the order of time; `twice`: every other one is sent again."""
    path = scratch(spark, "drop")
    a = alerts(spark, d).select("alert_id", "user_id", "event_type", "severity", "k", "value", F.col("observed_at").cast("timestamp").alias("ts"))
    if twice:
        a = a.unionByName(a.filter("alert_id % 2 = 0"))
    a.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return S.follow(spark, path, FIELDS)


def _latest(df, keys):
    """The last batch's row of each key, of what an updating stream wrote."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "batch")


@query("src03_follow_files", "SELECT event_id AS alert_id, user_id FROM events")
def src03(spark, d):
    out = scratch(spark, "followed")
    S.drain(_stream(spark, d).select("alert_id", "user_id"), out)
    return spark.read.parquet(out).drop("batch")


@query("ss01_ingest_stream", "SELECT event_id AS alert_id, event_type FROM events")
def ss01(spark, d):
    out = scratch(spark, "ingested")
    sent = _stream(spark, d, twice=True).select("alert_id", "event_type")
    S.drain(sent, out, write=S.ingest(out, "alert_id"))
    return KeyedStore(spark, out, sent.schema, "alert_id").read()


@query("ss02_stream_scoring", "SELECT event_id AS alert_id, CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.75 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT event_id, least(0.99::DOUBLE, 0.02::DOUBLE + least(value / 100, 0.55::DOUBLE) + least(k / 100::DOUBLE, 0.2::DOUBLE) + least(value * k * 10 / 100000, 0.2::DOUBLE)) AS s FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)) WHERE s >= 0.5")
def ss02(spark, d):
    out = scratch(spark, "scored")
    obs = _stream(spark, d, twice=True).select("alert_id", F.col("value").alias("syn"), F.col("k").alias("rst"), (F.col("value") * F.col("k") * 10).alias("rate"))
    S.drain(obs, out, write=S.score_batch(f"{out}-predictions", f"{out}-alerts", "alert_id", RuleDetector(syn="syn", rst="rst", rate="rate")))
    return spark.read.parquet(f"{out}-alerts").select("alert_id", "severity")


@query("ss03_health_windows", f"WITH {ALERTS} SELECT event_type, bucket, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, observed_at, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOUR, observed_at, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS bucket FROM alerts) GROUP BY 1, 2")
def ss03(spark, d):
    out = scratch(spark, "health")
    s = _stream(spark, d).withWatermark("ts", "1 day").groupBy("event_type", F.window("ts", "24 hours", "12 hours")).agg(F.count(F.lit(1)).alias("n"))
    S.drain(s.select("event_type", F.col("window.start").alias("bucket"), "n"), out, mode="update")
    return _latest(spark.read.parquet(out), ["event_type", "bucket"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("ss04_status_changes", f"WITH {ALERTS} SELECT event_type AS key, alert_id AS version, status FROM (SELECT event_type, alert_id, severity AS status, lag(severity) OVER (PARTITION BY event_type ORDER BY alert_id) AS before FROM alerts) WHERE status IS DISTINCT FROM before")
def ss04(spark, d):
    out = scratch(spark, "changes")
    S.drain(state.status_changes(_stream(spark, d).withColumnRenamed("event_type", "key"), ["key"], "alert_id", "severity"), out)
    return spark.read.parquet(out).drop("batch")


@query("ss04_changes_by_cohort", f"WITH {ALERTS} SELECT event_type AS cohort, hour, alert_id AS version, status FROM (SELECT event_type, hour, alert_id, severity AS status, lag(severity) OVER (PARTITION BY event_type, hour ORDER BY alert_id) AS before FROM (SELECT *, hour(observed_at)::INT AS hour FROM alerts)) WHERE status IS DISTINCT FROM before")
def ss04_cohorts(spark, d):
    out = scratch(spark, "cohort-changes")
    s = _stream(spark, d).withColumn("hour", F.hour("ts")).withColumnRenamed("event_type", "cohort")
    S.drain(state.status_changes(s, ["cohort", "hour"], "alert_id", "severity"), out)
    return spark.read.parquet(out).drop("batch")


@query("ss01_stream_dispositions", "SELECT disposition, count(*) AS n FROM (SELECT event_id, 'new' AS disposition FROM events UNION ALL SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'conflict' ELSE 'duplicate' END FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def ss01_dispositions(spark, d):
    """Every event in a first drop; in a second one every other event again, every fourth with another value."""
    path, out = scratch(spark, "sent"), scratch(spark, "taken")
    a = alerts(spark, d).select("alert_id", "event_type", "value")
    even, fourth = F.col("alert_id") % 2 == 0, F.col("alert_id") % 4 == 0
    for part in (a, a.filter(even).withColumn("value", F.when(fourth, F.col("value") + 1).otherwise(F.col("value")))):
        part.coalesce(4).write.mode("append").json(path)
        stream = S.follow(spark, path, "alert_id long, event_type string, value double", files_per_batch=100)
        S.drain(stream, out, write=S.ingest(out, "alert_id"))
    return spark.read.parquet(f"{out}-dispositions").groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query("ss05_sensor_dedupe", f"SELECT event_type, count(*) AS accepted FROM events GROUP BY 1")
def ss05(spark, d):
    out = scratch(spark, "sensor")
    s = _stream(spark, d, twice=True).withColumn("uid", identity.uuid5(NAMESPACE, F.concat_ws("|", F.col("alert_id").cast("string"), "event_type")))
    S.drain(S.once(s, "uid", "ts", "1 day").select("uid", "event_type"), out)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("accepted"))


@query("ss06_sensor_state", f"WITH {ALERTS} SELECT user_id AS sensor, sum(k)::BIGINT AS packets, count(*) AS events_seen, epoch_us(max(observed_at)) AS beat FROM alerts GROUP BY 1")
def ss06(spark, d):
    out = scratch(spark, "state")
    S.drain(state.sensor_presence(_stream(spark, d), "user_id", "ts", "k", 3600, delay="1 hour"), out)
    last = F.max_by(F.struct("packets", "events_seen", "beat"), F.struct("batch", "events_seen")).alias("last")
    return spark.read.parquet(out).groupBy("sensor").agg(last).select("sensor", "last.*")


@query("ss07_threshold_rule", f"WITH {ALERTS} SELECT time_bucket(INTERVAL 24 HOUR, observed_at, TIMESTAMP '1970-01-01') AS started_at, user_id, count(*) AS n FROM alerts GROUP BY 1, 2 HAVING count(*) >= 5")
def ss07(spark, d):
    out = scratch(spark, "rule")
    S.drain(S.threshold_rule(_stream(spark, d), "ts", "user_id", 5, "24 hours", "1 day"), out, mode="update")
    return _latest(spark.read.parquet(out), ["started_at", "user_id"]).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("ss07_limit_rule", f"WITH {ALERTS} SELECT time_bucket(INTERVAL 24 HOUR, observed_at, TIMESTAMP '1970-01-01') AS started_at, user_id, arg_min(alert_id, (observed_at, alert_id)) AS alert_id, count(*) - 1 AS n_suppressed FROM alerts GROUP BY 1, 2")
def ss07_limit(spark, d):
    out = scratch(spark, "limit")
    S.drain(S.limit_rule(_stream(spark, d), "ts", "user_id", "alert_id", "24 hours", "1 day"), out, mode="update")
    return _latest(spark.read.parquet(out), ["started_at", "user_id"]).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("ss08_content_rule", f"WITH {ALERTS} SELECT alert_id FROM alerts WHERE contains(event_type, 'err') OR contains(event_type, 'purch')")
def ss08(spark, d):
    out = scratch(spark, "content")
    S.drain(S.content_rule(_stream(spark, d), "event_type", ["err", "purch"]).select("alert_id"), out)
    return spark.read.parquet(out).drop("batch")


@query("ss09_live_timeline", f"WITH {ALERTS} SELECT time_bucket(INTERVAL 6 HOUR, observed_at, TIMESTAMP '1970-01-01') AS bucket, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'informational') AS informational, count(*) AS total FROM alerts GROUP BY 1")
def ss09(spark, d):
    out = scratch(spark, "timeline")
    S.drain(S.live_timeline(_stream(spark, d), "ts", "6 hours", "1 day"), out, mode="update")
    return _latest(spark.read.parquet(out), ["bucket"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("ss10_exactly_once", "SELECT event_id AS alert_id FROM events")
def ss10(spark, d):
    out = scratch(spark, "consumer")
    S.drain(S.once(_stream(spark, d, twice=True), "alert_id", "ts", "1 day").select("alert_id"), out)
    return spark.read.parquet(out).drop("batch")


PRESENCE = f"""
WITH {ALERTS}, beats AS (SELECT user_id AS sensor, epoch_us(observed_at) AS t FROM alerts),
gaps AS (SELECT *, lag(t) OVER w AS before, lead(t) OVER w AS after FROM beats WINDOW w AS (PARTITION BY sensor ORDER BY t)),
changes AS (
  SELECT sensor, t AS "at", 'online' AS status FROM gaps WHERE before IS NULL OR t - before > 3600000000
  UNION ALL SELECT sensor, t + 3600000000, 'offline' FROM gaps WHERE after IS NULL OR after - t > 3600000000
)"""


@query("ss06_presence_changes", f"{PRESENCE} SELECT sensor, \"at\", status FROM changes WHERE \"at\" < epoch_us(TIMESTAMP '2024-01-20')")
def ss06_changes(spark, d):
    """Sensors go offline after an hour of silence; changes until the 20th, which the clock surely passes."""
    out = scratch(spark, "presence")
    S.drain(state.sensor_presence(_stream(spark, d), "user_id", "ts", "k", 3600, delay="1 hour"), out)
    until = F.unix_micros(F.lit("2024-01-20").cast("timestamp"))
    return spark.read.parquet(out).filter(F.col("changed") & (F.col("at") < until)).select("sensor", "at", "status")


@query("ss06_sensor_presence", f"{PRESENCE} SELECT sensor, arg_max(status, \"at\") AS status FROM changes WHERE \"at\" < epoch_us(TIMESTAMP '2024-01-20') GROUP BY 1")
def ss06_presence(spark, d):
    """What each sensor was at the start of the 20th."""
    return ss06_changes(spark, d).groupBy("sensor").agg(F.max_by("status", "at").alias("status"))


@query("src03_growing_files", "SELECT event_id AS alert_id, user_id FROM events")
def src03_growing(spark, d):
    """Files that are followed by bytes while they grow: read as they are, then with as many lines again."""
    path, out = scratch(spark, "growing"), scratch(spark, "lines")
    a = alerts(spark, d).select("alert_id", "user_id")
    half = F.col("alert_id") % 2 == 0
    local = path.removeprefix("file://")
    for part in (a.filter(half), a.filter(~half)):
        part.coalesce(4).write.mode("append").json(path)
        S.drain(growing.follow_growing(spark, f"{local}/*.json", split=1 << 20), out)
    return spark.read.parquet(out).select(F.from_json("value", "alert_id long, user_id long").alias("x")).select("x.*")


@query("src04_sensor_lines", "SELECT event_id, event_type, sig FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'alert' ELSE 'stats' END AS event_type, CASE WHEN event_id % 2 = 0 THEN user_id::INT END AS sig FROM events WHERE event_id % 5 <> 0)")
def src04_lines(spark, d):
    """A sensor's log, followed; every fifth line can't be read and is passed over."""
    path, out = scratch(spark, "eve"), scratch(spark, "eve-lines")
    e, even = alerts(spark, d), F.col("alert_id") % 2 == 0
    when = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct(when.alias("timestamp"), F.when(even, "alert").otherwise("stats").alias("event_type"), F.col("alert_id").cast("string").alias("flow_id"), F.when(even, F.struct(F.col("user_id").cast("int").alias("signature_id"))).alias("alert")))
    e.select(F.when(F.col("alert_id") % 5 == 0, F.substr(line, F.lit(1), F.length(line) - 4)).otherwise(line).alias("value")).coalesce(3).write.text(path)
    S.drain(tables.sensor_events(growing.follow_growing(spark, f"{path.removeprefix('file://')}/*.txt")), out)
    return spark.read.parquet(out).select(F.col("flow_id").cast("long").alias("event_id"), "event_type", F.col("alert.signature_id").alias("sig"))


@query("ss12_session_stream", f"WITH {ALERTS}, g AS (SELECT user_id, observed_at AS t, alert_id, coalesce((epoch_us(observed_at) - epoch_us(lag(observed_at) OVER w) >= 28800000000)::INT, 0) AS fresh FROM alerts WINDOW w AS (PARTITION BY user_id ORDER BY observed_at, alert_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, alert_id ROWS UNBOUNDED PRECEDING) AS island FROM g), a AS (SELECT user_id, min(t) AS started_at, max(t) AS ended_at, count(*) AS n FROM s GROUP BY user_id, island) SELECT user_id, started_at, n FROM a WHERE ended_at < TIMESTAMP '2024-01-20'")
def ss12_stream(spark, d):
    """A gap of eight hours ends a session; those that end before the 20th, which the watermark surely passes."""
    out = scratch(spark, "sessions")
    S.drain(S.sessions(_stream(spark, d), "user_id", "ts", "8 hours", "1 day"), out)
    done = spark.read.parquet(out).filter(F.col("ended_at").cast("timestamp_ntz") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return done.select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "n")
