"""Alert roll-ups over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import distributions as Q
from tidewatch.functions.distributions import counted, quantiles
from tidewatch.operators import dashboard as D
from tidewatch.operators import severity as S

from .bindings import ALERTS, alerts
from .registry import query

R = lambda c, n=6: F.round(c, n)
MEASURES = """count(*) AS n_alerts, count(*) FILTER (WHERE open) AS n_unresolved, ['informational','low','medium','high','critical'][max(rank) + 1] AS severity,
  ['informational','low','medium','high','critical'][max(rank) FILTER (WHERE open) + 1] AS open_severity, coalesce(array_to_string(list_sort(list(DISTINCT protocol) FILTER (WHERE protocol IS NOT NULL)), ','), '') AS protocols,
  max(observed_at) AS last_seen, count(DISTINCT alert_id) AS n_distinct_alerts"""
RANKED = "ranked AS (SELECT *, status NOT IN ('resolved', 'false_positive') AS open, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank FROM alerts)"


@query("ag01_counts", f"WITH {ALERTS} SELECT 'prediction' AS dimension, prediction AS value, count(*) AS n FROM alerts GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM alerts GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY 2")
def ag01(spark, d):
    return D.counts(alerts(spark, d), "prediction", "status", "severity")


@query("ag01_counts_trailing", f"WITH {ALERTS}, w AS (SELECT * FROM alerts WHERE observed_at >= (SELECT max(observed_at) FROM alerts) - INTERVAL 7 DAY) SELECT 'prediction' AS dimension, prediction AS value, count(*) AS n FROM w GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM w GROUP BY 2")
def ag01_trailing(spark, d):
    a = alerts(spark, d)
    return D.counts(a.join(F.broadcast(a.agg(F.max("observed_at").alias("now"))), F.col("observed_at") >= F.col("now") - F.expr("interval 7 days")), "prediction", "status", "severity")


@query("ag02_families", f"WITH {ALERTS} SELECT coalesce(attack_class, signature, 'unclassified') AS family, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, family")
def ag02(spark, d):
    return D.labelled_counts(alerts(spark, d), F.coalesce("attack_class", "signature"), "unclassified", "family").orderBy(F.desc("n"), "family")


@query("ag03_protocols", f"WITH {ALERTS} SELECT lower(coalesce(protocol, 'unknown')) AS proto, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, proto")
def ag03(spark, d):
    return D.labelled_counts(alerts(spark, d), F.lower("protocol"), "unknown", "proto").orderBy(F.desc("n"), "proto")


@query("ag04_open_scalars", f"WITH {ALERTS} SELECT count(*) AS total, count(*) FILTER (WHERE status NOT IN ('resolved','false_positive')) AS unresolved, count(*) FILTER (WHERE severity = 'critical' AND status NOT IN ('resolved','false_positive')) AS critical_open FROM alerts")
def ag04(spark, d):
    return D.open_counts(alerts(spark, d), "status", "severity")


@query("ag05_median_score", f"WITH {ALERTS} SELECT round(median(confidence), 6) AS median_score FROM alerts")
def ag05(spark, d):
    return Q.quantiles(Q.counted(alerts(spark, d), [], "confidence"), [], "confidence", [0.5]).select(R(F.col("q")[0]).alias("median_score"))


TIMELINE = "count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low"
FILLED = """WITH {A}, b AS (SELECT time_bucket(INTERVAL {m} MINUTE, observed_at, TIMESTAMP '1970-01-01') AS bucket, {T}, count(*) AS total FROM alerts WHERE {w} GROUP BY 1),
e AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL {m} MINUTE)) AS bucket FROM b)
SELECT bucket, {C} FROM e LEFT JOIN b USING (bucket) ORDER BY bucket"""
ZEROS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("critical", "high", "medium", "low", "total"))


@query("ag06_severity_timeline", FILLED.format(A=ALERTS, m=60, T=TIMELINE, w="prediction = 'attack'", C=ZEROS))
def ag06(spark, d):
    return D.severity_timeline(alerts(spark, d).filter("prediction = 'attack'"), "observed_at", 60).orderBy("bucket")


@query("ag06_severity_timeline_all", f"WITH {ALERTS} SELECT time_bucket(INTERVAL 1440 MINUTE, observed_at, TIMESTAMP '1970-01-01') AS bucket, {TIMELINE}, count(*) AS total FROM alerts GROUP BY 1 ORDER BY 1")
def ag06_all(spark, d):
    return D.severity_timeline(alerts(spark, d), "observed_at", 1440, fill=False).orderBy("bucket")


@query("ag07_client_timeline", FILLED.format(A=ALERTS, m=30, T=TIMELINE + ", count(*) FILTER (WHERE severity = 'informational') AS informational", w="TRUE", C=ZEROS + ", coalesce(informational, 0) AS informational"))
def ag07(spark, d):
    return D.severity_timeline(alerts(spark, d), "observed_at", 30, levels=S.LEVELS).orderBy("bucket")


@query("ag08_protocol_share", f"WITH {ALERTS} SELECT coalesce(protocol, 'unknown') AS protocol, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM alerts GROUP BY 1")
def ag08(spark, d):
    return D.shares(alerts(spark, d).withColumn("protocol", F.coalesce("protocol", F.lit("unknown"))), "protocol").withColumn("percent", R(F.col("percent")))


@query("ag09_detections", f"WITH {ALERTS} SELECT coalesce(attack_class, 'none') AS family, count(*) AS n, count(*) FILTER (WHERE status NOT IN ('resolved','false_positive')) AS unresolved, round(median(confidence), 6) AS median_confidence FROM alerts GROUP BY 1")
def ag09(spark, d):
    return D.detections(alerts(spark, d).withColumn("family", F.coalesce("attack_class", F.lit("none"))), "family").withColumn("median_confidence", R(F.col("median_confidence")))


@query("ag10_topology_nodes", f"WITH {ALERTS}, {RANKED}, ends AS (SELECT *, source AS node FROM ranked UNION ALL SELECT *, destination FROM ranked) SELECT node, {MEASURES}, CASE WHEN regexp_matches(node, '^(port )?[0-9]+$') THEN 'port_only' ELSE 'unknown' END AS identity FROM ends WHERE node IS NOT NULL GROUP BY node")
def ag10(spark, d):
    return D.topology_nodes(alerts(spark, d))


@query("ag11_topology_edges", f"WITH {ALERTS}, {RANKED} SELECT source, destination, {MEASURES} FROM ranked WHERE source IS NOT NULL AND destination IS NOT NULL GROUP BY source, destination")
def ag11(spark, d):
    return D.topology_edges(alerts(spark, d))


@query("ag12_graph_summary", f"WITH {ALERTS}, {RANKED}, ends AS (SELECT *, source AS node FROM ranked UNION ALL SELECT *, destination FROM ranked), n AS (SELECT node, max(rank) FILTER (WHERE open) AS r FROM ends GROUP BY node) SELECT count(*) AS n_nodes, count(*) FILTER (WHERE r >= 3) AS n_elevated, count(*) FILTER (WHERE regexp_matches(node, '^[0-9]+$')) AS n_limited_identity, (SELECT sha256(string_agg(digest, '|' ORDER BY part)) FROM (SELECT substr(md5(node), 1, 3) AS part, sha256(string_agg(node, '|' ORDER BY node)) AS digest FROM n GROUP BY 1)) AS membership FROM n")
def ag12(spark, d):
    n = D.topology_nodes(alerts(spark, d))
    # The signature of the members is a digest of the digests of their parts, so no list holds them all.
    joined = lambda order, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda r: r[c]), "|")
    members = F.array_join(F.array_sort(F.collect_set("node")), "|")
    limited, elevated = F.count_if(F.col("identity") != "address"), F.count_if(F.col("open_severity").isin("critical", "high"))
    parts = n.groupBy(F.substring(F.md5(F.col("node").cast("binary")), 1, 3).alias("part")).agg(F.sha2(members, 256).alias("digest"), F.count(F.lit(1)).alias("n"), elevated.alias("e"), limited.alias("l"))
    return parts.agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_elevated"), F.sum("l").alias("n_limited_identity"), F.sha2(joined("part", "digest"), 256).alias("membership"))


@query("ag14_sensor_rollup", f"WITH {ALERTS}, s AS (SELECT user_id, count(*) AS events_seen, count(*) FILTER (WHERE prediction = 'attack') AS alerts_seen, sum(k)::BIGINT AS packets, count(*) FILTER (WHERE k = 0) AS drops, max(observed_at) >= (SELECT max(observed_at) FROM alerts) - INTERVAL 1 HOUR AS online FROM alerts GROUP BY user_id) SELECT count(*) AS sensors, sum(events_seen)::BIGINT AS events_seen, sum(alerts_seen)::BIGINT AS alerts_seen, sum(packets)::BIGINT AS packets, sum(drops)::BIGINT AS drops, bool_or(online) AS online FROM s")
def ag14(spark, d):
    a = alerts(spark, d)
    s = a.groupBy("user_id").agg(F.count(F.lit(1)).alias("events_seen"), F.count_if(F.col("prediction") == "attack").alias("alerts_seen"), F.sum("k").alias("packets"), F.count_if(F.col("k") == 0).alias("drops"), F.max("observed_at").alias("beat"))
    now = F.broadcast(a.agg(F.max("observed_at").alias("now")))
    s = s.crossJoin(now).withColumn("online", F.col("beat") >= F.col("now") - F.expr("interval 1 hour"))
    return s.agg(F.count(F.lit(1)).alias("sensors"), *[F.sum(c).alias(c) for c in ("events_seen", "alerts_seen", "packets", "drops")], F.bool_or("online").alias("online"))


@query("ag15_dispositions", "SELECT CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'duplicate' ELSE 'accepted' END AS disposition, count(*) AS n FROM events GROUP BY 1")
def ag15(spark, d):
    kind = F.col("event_type")
    return alerts(spark, d).groupBy(F.when(kind == "error", "rejected").when(kind == "view", "duplicate").otherwise("accepted").alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


@query("ag17_replay_latency", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY 1")
def ag17(spark, d):
    told = D.latencies(alerts(spark, d), ["event_type"], "value")
    return told.select("event_type", "n", R(F.col("mean")).alias("mean_ms"), R(F.col("q")[0]).alias("p50_ms"), R(F.col("q")[1]).alias("p95_ms"))


@query("ag18_latest_latency", "SELECT round(quantile_cont(value, 0.5), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def ag18(spark, d):
    told = D.latencies(D.lately(alerts(spark, d), "observed_at", "24 hours"), [], "value")
    return told.select(R(F.col("q")[0]).alias("median_ms"), R(F.col("q")[1]).alias("p95_ms"), "n")


@query("ag19_analyst_review", f"WITH {ALERTS} SELECT count(*) FILTER (WHERE status = 'resolved') AS confirmed, count(*) FILTER (WHERE status = 'false_positive') AS false_positive, round(count(*) FILTER (WHERE status = 'resolved')::DOUBLE / nullif(count(*) FILTER (WHERE status IN ('resolved','false_positive')), 0), 6) AS confirmed_rate FROM alerts")
def ag19(spark, d):
    return D.review(alerts(spark, d), "status").withColumn("confirmed_rate", R(F.col("confirmed_rate")))


@query("ag20_ground_truth", f"WITH {ALERTS}, t AS (SELECT *, event_type = 'error' AS truth, prediction = 'attack' AND confidence >= 0.3 AS said FROM alerts) SELECT round(count(*) FILTER (WHERE truth AND said)::DOUBLE / nullif(count(*) FILTER (WHERE truth), 0), 6) AS attack_recall, round(count(*) FILTER (WHERE NOT truth AND said)::DOUBLE / nullif(count(*) FILTER (WHERE NOT truth), 0), 6) AS normal_fpr, round(count(*) FILTER (WHERE truth = said)::DOUBLE / nullif(count(*), 0), 6) AS accuracy FROM t")
def ag20(spark, d):
    truth, said = F.col("event_type") == "error", (F.col("prediction") == "attack") & (F.col("confidence") >= 0.3)
    rates = D.truth_rates(alerts(spark, d), truth, said)
    return rates.select(*[R(F.col(c)).alias(c) for c in rates.columns])


@query("ag21_class_frequency", "SELECT CASE WHEN event_id % 5 < 3 THEN 'train' WHEN event_id % 5 = 3 THEN 'validation' ELSE 'test' END AS split, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2")
def ag21(spark, d):
    m = F.col("alert_id") % 5
    return alerts(spark, d).groupBy(F.when(m < 3, "train").when(m == 3, "validation").otherwise("test").alias("split"), F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("ag23_metric_series", "SELECT event_type AS model, metric, round(v * 100, 6) AS percent FROM (SELECT event_type, avg(least(value/100, 1.0::DOUBLE)) AS accuracy, max(least(value/1000, 1.0::DOUBLE)) AS f1_macro, min(least(value/100, 1.0::DOUBLE)) AS precision_macro, median(least(value/100, 1.0::DOUBLE)) AS recall_macro FROM events GROUP BY 1) UNPIVOT (v FOR metric IN (accuracy, f1_macro, precision_macro, recall_macro))")
def ag23(spark, d):
    c = F.least(F.col("value") / 100, F.lit(1.0))
    a = alerts(spark, d).select(F.col("event_type").alias("model"), c.alias("c"), F.least(F.col("value") / 1000, F.lit(1.0)).alias("f1"))
    m = a.groupBy("model").agg(F.avg("c").alias("accuracy"), F.max("f1").alias("f1_macro"), F.min("c").alias("precision_macro"))
    middle = quantiles(counted(a, ["model"], "c"), ["model"], "c", [0.5])
    m = m.join(middle.select("model", F.col("q")[0].alias("recall_macro")), "model")
    return m.unpivot("model", ["accuracy", "f1_macro", "precision_macro", "recall_macro"], "metric", "v").select("model", "metric", R(F.col("v") * 100).alias("percent"))


@query("ag24_overview", f"WITH {ALERTS} SELECT (SELECT count(DISTINCT n) FROM (SELECT source AS n FROM alerts UNION ALL SELECT destination FROM alerts)) AS endpoints, (SELECT attack_class FROM alerts WHERE attack_class IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, attack_class LIMIT 1) AS top_family")
def ag24(spark, d):
    return D.overview(alerts(spark, d), "source", "destination", "attack_class")


@query("ag25_peak_bucket", f"WITH {ALERTS} SELECT time_bucket(INTERVAL 60 MINUTE, observed_at, TIMESTAMP '1970-01-01') AS bucket, count(*) AS total FROM alerts GROUP BY 1 ORDER BY total DESC, bucket LIMIT 1")
def ag25(spark, d):
    return D.severity_timeline(alerts(spark, d), "observed_at", 60, fill=False).select("bucket", "total").orderBy(F.desc("total"), "bucket").limit(1)
