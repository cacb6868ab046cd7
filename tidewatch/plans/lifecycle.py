"""Joins, job histories and ingestion status over orders, lines, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import lifecycle as L

from .bindings import ALERTS, JOBS, TRANSITIONS, alerts, jobs, table, transitions
from .registry import query

R = lambda c, n=6: F.round(c, n)
DAY = "date_diff('second', {a}, {b})::DOUBLE"


def _seconds(a, b):
    return (F.unix_seconds(F.col(b).cast("timestamp")) - F.unix_seconds(F.col(a).cast("timestamp"))).cast("double")


@query("jn01_observation_prediction", "SELECT o_orderkey, o_custkey, c_mktsegment, round(o_totalprice, 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def jn01(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return o.join(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_mktsegment", R(F.col("o_totalprice"), 2).alias("o_totalprice"))


@query("jn02_alert_context", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey")
def jn02(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0")
    j = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("jn03_enriched_groups", "SELECT coalesce(n_name, 'unknown') AS nation, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def jn03(spark, d):
    return jn02(spark, d).groupBy(F.coalesce("n_name", F.lit("unknown")).alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("jn04_feedback_in_window", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def jn04(spark, d):
    window = table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(window, "o_custkey", "left_semi")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus")


SENT = """
batch AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN value + 1 ELSE value END AS value, 0 AS place FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT event_id + 1000000, value, 1 FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id + 1000000, value + (event_id % 25 = 0)::INT, 2 FROM events WHERE event_id % 10 = 0
),
h AS (SELECT event_id, round(value * 100)::BIGINT AS digest, place FROM batch),
s AS (SELECT event_id, round(value * 100)::BIGINT AS had FROM events WHERE event_id % 3 = 0),
seen AS (SELECT *, count(*) OVER (PARTITION BY event_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM h),
torn AS (SELECT event_id FROM h GROUP BY 1 HAVING count(DISTINCT digest) > 1),
j AS (
  SELECT event_id, digest, place, CASE WHEN event_id IN (SELECT event_id FROM torn) OR had <> digest THEN 'conflict' WHEN had IS NOT NULL OR earlier > 0 THEN 'duplicate' ELSE 'new' END AS disposition
  FROM seen LEFT JOIN s USING (event_id)
)"""


def _dispositions(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    i = F.col("event_id")
    again = F.col("event_id") + 1_000_000
    batch = e.filter(i % 2 == 0).withColumn("value", F.when(i % 11 == 0, F.col("value") + 1).otherwise(F.col("value")))
    batch = batch.withColumn("place", F.lit(0)).unionByName(e.filter(i % 5 == 0).select(again.alias("event_id"), "value", F.lit(1).alias("place")))
    batch = batch.unionByName(e.filter(i % 10 == 0).select(again.alias("event_id"), (F.col("value") + (i % 25 == 0).cast("int")).alias("value"), F.lit(2).alias("place")))
    digest = F.round(F.col("value") * 100).cast("long")
    stored = e.filter(i % 3 == 0).select("event_id", digest.alias("digest"))
    return L.split_known(batch.select("event_id", digest.alias("digest"), "place"), stored, "event_id", "digest", "place")


@query("jn05_new_or_duplicate", f"WITH {SENT} SELECT event_id, place, disposition FROM j")
def jn05(spark, d):
    return _dispositions(spark, d).select("event_id", "place", "disposition")


@query("jn06_conflicts", f"WITH {SENT} SELECT event_id, count(DISTINCT digest) AS digests FROM j WHERE disposition = 'conflict' GROUP BY 1")
def jn06(spark, d):
    return _dispositions(spark, d).filter("disposition = 'conflict'").groupBy("event_id").agg(F.count_distinct("digest").alias("digests"))


@query("ss01_ingest_dispositions", f"WITH {SENT} SELECT disposition, count(*) AS n FROM j GROUP BY 1")
def ss01(spark, d):
    return _dispositions(spark, d).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@query("jn07_alert_detail", f"WITH {TRANSITIONS} SELECT o_orderkey AS alert_id, c_name, coalesce(string_agg(to_state, '>' ORDER BY occurred_at, transition_id), '') AS history FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN transitions ON job_id = o_orderkey GROUP BY 1, 2")
def jn07(spark, d):
    told = L.ordered_history(transitions(spark, d), "job_id", ["occurred_at", "transition_id"], ["to_state"], "history")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    o = o.join(told, F.col("o_orderkey") == F.col("job_id"), "left")
    return o.select(F.col("o_orderkey").alias("alert_id"), "c_name", F.coalesce(F.array_join("history.to_state", ">"), F.lit("")).alias("history"))


@query("jn08_job_detail", f"WITH {JOBS}, {TRANSITIONS} SELECT j.job_id, state, count(transition_id) AS n_transitions, coalesce(string_agg(to_state || '@' || strftime(occurred_at, '%Y-%m-%d'), ',' ORDER BY occurred_at, t.transition_id), '') AS told FROM jobs j LEFT JOIN transitions t USING (job_id) GROUP BY 1, 2")
def jn08(spark, d):
    told = L.ordered_history(transitions(spark, d), "job_id", ["occurred_at", "transition_id"], ["to_state", "occurred_at"], "h")
    j = jobs(spark, d).join(told, "job_id", "left")
    text = F.array_join(F.transform("h", lambda r: F.concat(r["to_state"], F.lit("@"), F.date_format(r["occurred_at"], "yyyy-MM-dd"))), ",")
    return j.select("job_id", "state", F.coalesce(F.size("h"), F.lit(0)).cast("long").alias("n_transitions"), F.coalesce(text, F.lit("")).alias("told"))


REDRIVE = f"WITH {JOBS}, {TRANSITIONS}, p AS (SELECT DISTINCT job_id, TRUE AS predicted FROM transitions WHERE to_state = 'succeeded'), o AS (SELECT DISTINCT job_id, TRUE AS claimed FROM transitions WHERE to_state = 'claimed' AND seq = 5), r AS (SELECT job_id, CASE WHEN state <> 'dead_letter' THEN 'not_dead_letter' WHEN claimed THEN 'leased' WHEN attempts = 4 THEN 'payload_changed' WHEN predicted THEN 'already_predicted' WHEN NOT retryable AND error_code IS DISTINCT FROM 'extractor_mismatch' THEN 'not_retryable' ELSE 'eligible' END AS reason FROM jobs LEFT JOIN p USING (job_id) LEFT JOIN o USING (job_id))"


def _redrive(spark, d):
    t = transitions(spark, d)
    flag = lambda f, name: t.filter(f).select("job_id").distinct().withColumn(name, F.lit(True))
    j = jobs(spark, d).join(flag("to_state = 'succeeded'", "predicted"), "job_id", "left").join(flag("to_state = 'claimed' and seq = 5", "leased"), "job_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = [("not_dead_letter", F.col("state") != "dead_letter"), ("leased", yes("leased")), ("payload_changed", F.col("attempts") == 4), ("already_predicted", yes("predicted")), ("not_retryable", ~F.col("retryable") & ~F.col("error_code").eqNullSafe(F.lit("extractor_mismatch")))]
    return j.select("job_id", L.first_reason(reasons).alias("reason"))


@query("jn09_redrive_eligibility", f"{REDRIVE} SELECT * FROM r")
def jn09(spark, d):
    return _redrive(spark, d)


@query("lc02_redrive_plan", f"{REDRIVE}, q AS (SELECT i AS job_id FROM (SELECT o_orderkey AS i FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 997 = 0)) SELECT job_id, coalesce(reason, 'not_found') AS reason, bool_and(coalesce(reason, 'not_found') = 'eligible') OVER () AS accepted FROM q LEFT JOIN r USING (job_id)")
def lc02(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    asked = o.filter("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("job_id")).unionByName(o.filter("o_orderkey % 997 = 0").select((-F.col("o_orderkey") - 1).alias("job_id")))
    plan = asked.join(_redrive(spark, d), "job_id", "left").withColumn("reason", F.coalesce("reason", F.lit("not_found")))
    return plan.crossJoin(F.broadcast(plan.agg(F.bool_and(F.col("reason") == "eligible").alias("accepted"))))


@query("lc02_dry_run", f"{REDRIVE}, q AS (SELECT i AS job_id FROM (SELECT o_orderkey AS i FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 997 = 0)) SELECT job_id, coalesce(reason, 'not_found') = 'eligible' AS eligible, coalesce(reason, 'not_found') AS reason FROM q LEFT JOIN r USING (job_id)")
def lc02_dry_run(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    asked = o.filter("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("job_id")).unionByName(o.filter("o_orderkey % 997 = 0").select((-F.col("o_orderkey") - 1).alias("job_id")))
    return L.redrive_plan(asked, _redrive(spark, d), "job_id", "operator", "after an outage")


@query("jn10_session_splits", "WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN 'train' WHEN c_custkey % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM customer WHERE c_custkey % 50 <> 0) SELECT coalesce(split, 'unknown_session') AS split, count(*) AS n FROM orders LEFT JOIN a ON o_custkey = c_custkey GROUP BY 1")
def jn10(spark, d):
    m = F.col("c_custkey") % 5
    a = table(spark, d, "customer").filter("c_custkey % 50 <> 0").select("c_custkey", F.when(m < 3, "train").when(m == 3, "validation").otherwise("test").alias("split"))
    return table(spark, d, "orders").join(a, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.coalesce("split", F.lit("unknown_session")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("jn11_truth_pairs", "SELECT d.doc_id, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS predicted, toxic AS truth FROM documents d JOIN labels USING (doc_id)")
def jn11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("predicted"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("truth")), "doc_id")


JOB_TIMES = f"WITH {JOBS}, {TRANSITIONS}, t AS (SELECT job_id, min(occurred_at) FILTER (WHERE to_state = 'claimed') AS claimed_at, max(occurred_at) FILTER (WHERE to_state IN ('succeeded','dead_letter')) AS ended_at FROM transitions GROUP BY 1)"


def _job_times(spark, d):
    t = transitions(spark, d)
    ends = F.col("to_state").isin("succeeded", "dead_letter")
    per = t.groupBy("job_id").agg(F.min(F.when(F.col("to_state") == "claimed", F.col("occurred_at"))).alias("claimed_at"), F.max(F.when(ends, F.col("occurred_at"))).alias("ended_at"))
    return jobs(spark, d).join(per, "job_id")


@query("jn12_job_times", f"{JOB_TIMES} SELECT job_id, claimed_at, ended_at FROM jobs JOIN t USING (job_id)")
def jn12(spark, d):
    return _job_times(spark, d).select("job_id", "claimed_at", "ended_at")


LOWER = "list_sort(list({x}))[floor({q} * (count({x}) - 1))::INT + 1]"


@query("ag16_pipeline_latency", f"{JOB_TIMES}, w AS (SELECT channel, attempts, state, {DAY.format(a='created_at', b='claimed_at')} AS wait, {DAY.format(a='claimed_at', b='ended_at')} AS run FROM jobs JOIN t USING (job_id)) SELECT channel, count(*) AS n, {LOWER.format(x='wait', q='0.5::DOUBLE')} AS wait_p50, {LOWER.format(x='wait', q='0.95::DOUBLE')} AS wait_p95, {LOWER.format(x='run', q='0.5::DOUBLE')} AS run_p50, {LOWER.format(x='run', q='0.95::DOUBLE')} AS run_p95, count(*) FILTER (WHERE attempts > 1) AS retries, count(*) FILTER (WHERE state = 'dead_letter') AS failures, count(*) FILTER (WHERE state = 'queued') AS pending FROM w GROUP BY 1")
def ag16(spark, d):
    j = _job_times(spark, d).withColumn("wait", _seconds("created_at", "claimed_at")).withColumn("run", _seconds("claimed_at", "ended_at"))
    counts = j.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("attempts") > 1).alias("retries"), F.count_if(F.col("state") == "dead_letter").alias("failures"), F.count_if(F.col("state") == "queued").alias("pending"))
    return counts.join(L.lower_rank_percentiles(j, ["channel"], ["wait", "run"], {"p50": 0.5, "p95": 0.95}), "channel")


@query("ag13_ingestion_status", f"WITH {JOBS} SELECT count(*) FILTER (WHERE state = 'queued') AS queue_depth, count(*) FILTER (WHERE state = 'succeeded') AS succeeded, count(*) FILTER (WHERE state = 'dead_letter') AS dead_letter, date_diff('second', min(created_at) FILTER (WHERE state = 'queued'), max(created_at)) AS oldest_active_age, sum(greatest(attempts - 1, 0))::BIGINT AS retries, count(*) FILTER (WHERE state = 'succeeded' AND created_at >= (SELECT max(created_at) FROM jobs) - INTERVAL 1 DAY) AS succeeded_lately FROM jobs")
def ag13(spark, d):
    j = jobs(spark, d)
    now = F.broadcast(j.agg(F.max("created_at").alias("now")))
    s = lambda x: F.col("state") == x
    j = j.crossJoin(now).agg(
        F.count_if(s("queued")).alias("queue_depth"), F.count_if(s("succeeded")).alias("succeeded"), F.count_if(s("dead_letter")).alias("dead_letter"), F.min(F.when(s("queued"), F.col("created_at"))).alias("oldest"), F.max("now").alias("now"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.count_if(s("succeeded") & (F.col("created_at") >= F.col("now") - F.expr("interval 1 day"))).alias("succeeded_lately"),
    )
    return j.select("queue_depth", "succeeded", "dead_letter", _seconds("oldest", "now").cast("long").alias("oldest_active_age"), "retries", "succeeded_lately")


#: Jobs in all states, with their time of completion; an outbox of which what is open isn't published yet.
STATES = f"WITH {JOBS}, j AS (SELECT CASE WHEN state = 'queued' AND attempts IN (1, 2) THEN 'processing' WHEN state = 'queued' AND attempts > 2 THEN 'retrying' ELSE state END AS state, attempts, created_at, CASE WHEN state <> 'queued' THEN created_at + to_days((job_id % 9)::INT) END AS completed_at FROM jobs), n AS (SELECT max(created_at) AS now FROM jobs)"


@query("ag13_full_status", f"{STATES} SELECT count(*) FILTER (WHERE state IN ('queued', 'processing', 'retrying')) AS queue_depth, count(*) FILTER (WHERE state = 'queued') AS queued, count(*) FILTER (WHERE state = 'processing') AS processing, count(*) FILTER (WHERE state = 'retrying') AS retrying, count(*) FILTER (WHERE state = 'succeeded') AS succeeded, count(*) FILTER (WHERE state = 'dead_letter') AS dead_letter, sum(greatest(attempts - 1, 0))::BIGINT AS retries, count(*) FILTER (WHERE state = 'succeeded' AND completed_at >= now - INTERVAL 3 DAY) AS completed_lately, date_diff('second', min(created_at) FILTER (WHERE state IN ('queued', 'processing', 'retrying')), any_value(now)) AS oldest_active_age, CASE WHEN max(created_at) FILTER (WHERE state = 'succeeded') >= any_value(now) - INTERVAL 30 DAY THEN 'ready' ELSE 'blocked' END AS worker, count(*) FILTER (WHERE completed_at IS NULL) AS outbox_pending, count(completed_at) AS outbox_published, date_diff('second', min(created_at) FILTER (WHERE completed_at IS NULL), any_value(now)) AS oldest_outbox_age, CASE WHEN count(*) > count(completed_at) THEN 'degraded' ELSE 'ready' END AS outbox FROM j, n")
def ag13_full(spark, d):
    waits = F.col("state") == "queued"
    j = jobs(spark, d).withColumn("completed_at", F.when(~waits, F.col("created_at") + F.make_dt_interval(days=(F.col("job_id") % 9).cast("int"))))
    j = j.withColumn("state", F.when(waits & F.col("attempts").isin(1, 2), "processing").when(waits & (F.col("attempts") > 2), "retrying").otherwise(F.col("state")))
    now = F.lit(j.agg(F.max("created_at")).first()[0]).cast("timestamp_ntz")
    return L.ingestion_status(j, j.select("created_at", F.col("completed_at").alias("published_at")), j.filter("state = 'succeeded'").select(F.col("created_at").alias("at")), now, "3 days", "30 days")


@query("ag16_end_to_end", f"{JOB_TIMES}, w AS (SELECT channel, created_at, ended_at, {DAY.format(a='created_at', b='ended_at')} AS total, {DAY.format(a='ended_at', b='ended_at + to_days((job_id % 5)::INT)')} AS lag FROM jobs JOIN t USING (job_id)) SELECT channel, {LOWER.format(x='total', q='0.5::DOUBLE')} AS total_p50, {LOWER.format(x='total', q='0.95::DOUBLE')} AS total_p95, {LOWER.format(x='lag', q='0.5::DOUBLE')} AS lag_p50, {LOWER.format(x='lag', q='0.95::DOUBLE')} AS lag_p95, round(count(*) / date_diff('second', min(created_at), max(ended_at))::DOUBLE, 9) AS per_second FROM w GROUP BY 1")
def ag16_end_to_end(spark, d):
    """Jobs are published some days after their end."""
    j = _job_times(spark, d).withColumn("published_at", F.col("ended_at") + F.make_dt_interval(days=(F.col("job_id") % 5).cast("int")))
    j = j.withColumn("total", _seconds("created_at", "ended_at")).withColumn("lag", _seconds("ended_at", "published_at"))
    span = j.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("a"), F.max("ended_at").alias("z"))
    rate = span.select("channel", R(F.col("n") / _seconds("a", "z"), 9).alias("per_second"))
    return rate.join(L.lower_rank_percentiles(j, ["channel"], ["total", "lag"], {"p50": 0.5, "p95": 0.95}), "channel")


@query("lc01_current_state", f"WITH {TRANSITIONS} SELECT job_id, arg_max(to_state, (occurred_at, transition_id)) AS to_state FROM transitions GROUP BY 1")
def lc01(spark, d):
    return L.latest(transitions(spark, d), "job_id", "to_state", "occurred_at", "transition_id")


@query("lc05_analyst_status", f"WITH {TRANSITIONS}, s AS (SELECT job_id, arg_max(to_state, (occurred_at, transition_id)) AS latest, count(*) AS n_feedback FROM transitions WHERE seq > 2 GROUP BY 1) SELECT o_orderkey AS alert_id, coalesce(latest, o_orderstatus) AS status, coalesce(n_feedback, 0) AS n_feedback FROM orders LEFT JOIN s ON o_orderkey = job_id")
def lc05(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    told = L.with_feedback(o, transitions(spark, d).filter("seq > 2"), "job_id", "to_state", ["occurred_at", "transition_id"], "status")
    return told.withColumnRenamed("job_id", "alert_id")


@query("prj13_model_routes", f"WITH {ALERTS}, r AS (SELECT * FROM (VALUES ('v0', NULL, 'model_rt'), ('v1', 'fp1', 'model_native_1'), ('v1', 'fp2', 'model_native_2')) t(schema, fp, route)), a AS (SELECT alert_id, 'v' || (k % 2) AS schema, CASE WHEN k % 4 <> 0 THEN 'fp' || (k % 4) END AS fp FROM alerts) SELECT alert_id, a.schema, route, CASE WHEN route IS NULL THEN CASE WHEN a.schema = 'v0' THEN 'fingerprint_not_allowed' ELSE 'extractor_not_approved' END END AS error_code FROM a LEFT JOIN r ON a.schema = r.schema AND a.fp IS NOT DISTINCT FROM r.fp")
def prj13(spark, d):
    k = F.col("k")
    a = alerts(spark, d).select("alert_id", F.concat(F.lit("v"), (k % 2).cast("string")).alias("schema"), F.when(k % 4 != 0, F.concat(F.lit("fp"), (k % 4).cast("string"))).alias("fp"))
    pairs = [("v0", None, "model_rt"), ("v1", "fp1", "model_native_1"), ("v1", "fp2", "model_native_2")]
    routes = F.broadcast(spark.createDataFrame(pairs, "schema string, fingerprint string, route string"))
    return L.routed(a, routes, "schema", "fp", "v0").drop("fp")
