"""Filters, projections, pages and sets over alerts and jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators import alerts as A
from tidewatch.operators import search as Q
from tidewatch.operators import severity as S

from .bindings import ALERTS, JOBS, alerts, jobs, table
from .registry import query

NORMAL = ("view", "click", "signup", "purchase")
START, END = datetime(2024, 1, 5), datetime(2024, 1, 12)
R = lambda c, n=6: F.round(c, n)

for _name, _where in {"all": "TRUE", "normal": "event_type <> 'error'", "attack": "event_type = 'error'", "class:click": "event_type = 'click'"}.items():
    query(f"flt01_scenario_{_name.replace(':', '_')}", f"SELECT event_id, event_type FROM events WHERE {_where}")(
        lambda spark, d, n=_name: table(spark, d, "events").filter(Q.scenario(F.col("event_type"), n, NORMAL)).select("event_id", "event_type")
    )


@query("flt02_row_slice", "SELECT event_id, event_type FROM events WHERE event_id >= 500 AND event_type = 'error' ORDER BY event_id LIMIT 100")
def flt02(spark, d):
    return Q.row_slice(table(spark, d, "events"), "event_id", Q.scenario(F.col("event_type"), "attack", NORMAL), 500, 100).select("event_id", "event_type")


@query("flt03_alert_predicates", f"WITH {ALERTS} SELECT alert_id, observed_at, severity, status FROM alerts WHERE severity IN ('high','critical','medium') AND status = 'open' AND (attack_class = 'family_1' OR signature = 'sig_1') AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-12'")
def flt03(spark, d):
    f = F.col("severity").isin("high", "critical", "medium") & (F.col("status") == "open") & ((F.col("attack_class") == "family_1") | (F.col("signature") == "sig_1"))
    return alerts(spark, d).filter(f & Q.between("observed_at", START, END)).select("alert_id", "observed_at", "severity", "status")


@query("flt04_text_search", f"WITH {ALERTS} SELECT alert_id FROM alerts WHERE contains(lower(coalesce(event_type,'') || chr(1) || coalesce(attack_class,'') || chr(1) || coalesce(signature,'') || chr(1) || source || chr(1) || destination || chr(1) || coalesce(protocol,'') || chr(1) || props), lower('FAMILY_2')) OR contains(props, '\": 42}}')")
def flt04(spark, d):
    cols = [F.col(c) for c in ("event_type", "attack_class", "signature", "source", "destination", "protocol", "props")]
    return alerts(spark, d).filter(Q.text_search(cols, "FAMILY_2") | Q.text_search(cols, '": 42}')).select("alert_id")


@query("flt05_client_filter", f"WITH {ALERTS} SELECT alert_id FROM alerts WHERE severity = 'critical' AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-12' AND (contains(lower(source), '4') OR contains(lower(destination), '4') OR contains(lower(coalesce(attack_class,'')), '4') OR contains(lower(coalesce(protocol,'')), '4') OR contains(lower(status), '4'))")
def flt05(spark, d):
    cols = [F.col(c) for c in ("source", "destination", "attack_class", "protocol", "status")]
    return alerts(spark, d).filter((F.col("severity") == "critical") & Q.between("observed_at", START, END) & Q.text_search(cols, "4")).select("alert_id")


@query("flt06_topology_filter", f"WITH {ALERTS} SELECT alert_id, source, destination FROM alerts WHERE observed_at >= (SELECT max(observed_at) FROM alerts) - INTERVAL 7 DAY AND lower(protocol) = 'tcp' AND severity IN ('critical','high') AND status NOT IN ('resolved','false_positive')")
def flt06(spark, d):
    f = (F.lower("protocol") == "tcp") & A.elevated_and_open(F.col("severity"), F.col("status"))
    return A.recent(alerts(spark, d), "observed_at", "7 days", f).select("alert_id", "source", "destination")


@query("flt07_job_filter", f"WITH {JOBS} SELECT job_id, state, error_code, channel FROM jobs WHERE state = 'dead_letter' AND error_code = 'timeout' AND channel = '1-URGENT' AND created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01'")
def flt07(spark, d):
    f = (F.col("state") == "dead_letter") & (F.col("error_code") == "timeout") & (F.col("channel") == "1-URGENT")
    return jobs(spark, d).filter(f & F.col("created_at").between(F.lit(datetime(1996, 1, 1)), F.lit(datetime(1998, 1, 1)))).select("job_id", "state", "error_code", "channel")


OUTBOX = "CASE WHEN k % 3 = 0 THEN 'published' WHEN k % 4 > 0 THEN 'failed' ELSE 'pending' END"


@query("flt08_outbox_status", f"WITH {ALERTS} SELECT alert_id, {OUTBOX} AS outbox_status FROM alerts WHERE {OUTBOX} = 'failed'")
def flt08(spark, d):
    a = alerts(spark, d).withColumn("published_at", F.when(F.col("k") % 3 == 0, F.col("observed_at")))
    return a.withColumn("outbox_status", A.delivery_status(F.col("published_at"), F.col("k") % 4)).filter("outbox_status = 'failed'").select("alert_id", "outbox_status")


@query("flt09_signature_seen", f"WITH {ALERTS} SELECT alert_id, observed_at FROM alerts WHERE signature = 'sig_1' AND observed_at > TIMESTAMP '2024-01-12' ORDER BY observed_at DESC, alert_id DESC LIMIT 1")
def flt09(spark, d):
    return A.newest(alerts(spark, d), (F.col("signature") == "sig_1") & (F.col("observed_at") > F.lit(END)), "observed_at", "alert_id").select("alert_id", "observed_at")


@query("prj01_targets", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'attack' ELSE 'normal' END AS binary_target, CASE WHEN event_type = 'error' THEN event_type END AS family_target FROM events")
def prj01(spark, d):
    binary, family = A.targets(F.col("event_type"), NORMAL)
    return table(spark, d, "events").select("event_id", binary.alias("binary_target"), family.alias("family_target"))


@query("prj02_unified_view", f"WITH {ALERTS} SELECT alert_id, CASE WHEN signature IS NOT NULL THEN 'sensor' ELSE 'model' END AS detection_source, CASE WHEN signature IS NOT NULL THEN signature ELSE attack_class END AS attack_class, CASE WHEN signature IS NULL THEN confidence END AS confidence, coalesce(CASE WHEN k % 2 = 0 THEN observed_at END, observed_at + INTERVAL 1 SECOND) AS observed_at FROM alerts")
def prj02(spark, d):
    signature, observed = F.col("signature"), F.col("observed_at")
    view = A.unified(signature.isNotNull(), signature, F.col("attack_class"), F.col("confidence"), F.when(F.col("k") % 2 == 0, observed), observed + F.expr("interval 1 second"))
    return alerts(spark, d).select("alert_id", *view)


@query("prj03_severity_reasons", f"WITH {ALERTS} SELECT alert_id, CASE WHEN prediction = 'normal' AND NOT odd THEN 'informational' WHEN confidence >= 0.9 OR odd THEN 'critical' WHEN confidence >= 0.75 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN quiet THEN 0 ELSE 1 + odd::INT END AS n_reasons, CASE WHEN NOT quiet THEN 'model predicted ' || prediction END AS said FROM (SELECT *, k > 95 AS odd, prediction = 'normal' AND NOT odd AS quiet FROM alerts)")
def prj03(spark, d):
    odd = F.col("k") > 95
    told = S.reasons(F.col("prediction"), F.col("confidence"), F.when(odd, F.array(F.lit("profile"))).otherwise(F.array().cast("array<string>")))
    return alerts(spark, d).select("alert_id", S.assess(F.col("prediction"), F.col("confidence"), odd).alias("severity"), F.size(told).alias("n_reasons"), F.regexp_extract(F.get(told, 0), "^(.*) with [0-9.]+% confidence$", 1).alias("said"))


@query("prj04_sensor_severity", f"WITH {ALERTS} SELECT alert_id, CASE k % 5 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS severity FROM alerts")
def prj04(spark, d):
    return alerts(spark, d).select("alert_id", S.sensor_severity(F.col("k") % 5).alias("severity"))


@query("prj05_device_profile", f"WITH {ALERTS} SELECT alert_id, CASE WHEN k > 90 THEN ['port ' || k] ELSE [] END::VARCHAR AS reasons FROM alerts")
def prj05(spark, d):
    violation = F.when(F.col("k") > 90, F.concat(F.lit("port "), F.col("k").cast("string")))
    return alerts(spark, d).select("alert_id", F.concat(F.lit("["), F.array_join(A.profile_reasons(violation), ", "), F.lit("]")).alias("reasons"))


@query("prj06_sensor_alert", f"WITH {ALERTS} SELECT alert_id, source AS source_ip, k AS signature_id, signature || ',' || event_type AS reasons FROM alerts WHERE signature IS NOT NULL")
def prj06(spark, d):
    a = alerts(spark, d).filter("signature is not null")
    a = a.select("alert_id", F.struct(F.col("source").alias("source_ip"), F.col("destination").alias("destination_ip")).alias("context"), F.struct(F.col("k").alias("signature_id"), F.col("signature")).alias("evidence"), F.array("signature", "event_type").alias("reasons"))
    return a.select("alert_id", "context.source_ip", "evidence.signature_id", F.array_join("reasons", ",").alias("reasons"))


@query("prj07_endpoint_label", f"WITH {ALERTS} SELECT alert_id, coalesce(CASE WHEN k % 3 = 0 THEN source END, CASE WHEN k % 3 = 1 THEN destination END, 'port ' || nullif(k, 50), 'unknown') AS endpoint FROM alerts")
def prj07(spark, d):
    k = F.col("k")
    addresses = F.when(k % 3 == 0, F.col("source")), F.when(k % 3 == 1, F.col("destination"))
    return alerts(spark, d).select("alert_id", A.endpoint(F.nullif(k, F.lit(50)), *addresses).alias("endpoint"))


COHORT = """'{"channel":"' || event_type || '","classifier":"c' || (k % 2) || '","detector":"d1","fingerprint":' || CASE WHEN k % 3 = 0 THEN '"fp' || (k % 3) || '"' ELSE 'null' END || ',"schema":"v' || (k % 2) || '","source":"' || (user_id % 3) || '"}'"""


def _cohort():
    k = F.col("k")
    odd, fingerprint = (k % 2).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("fp"), (k % 3).cast("string")))
    return A.canonical_key(
        source=(F.col("user_id") % 3).cast("string"), schema=F.concat(F.lit("v"), odd), channel=F.col("event_type"),
        fingerprint=fingerprint, detector=F.lit("d1"), classifier=F.concat(F.lit("c"), odd),
    )


@query("prj08_cohort_key", f"WITH {ALERTS} SELECT alert_id, {COHORT} AS cohort_key, event_type = 'view' AND k % 3 = 0 AS eligible FROM alerts")
def prj08(spark, d):
    return alerts(spark, d).select("alert_id", _cohort().alias("cohort_key"), ((F.col("event_type") == "view") & (F.col("k") % 3 == 0)).alias("eligible"))


@query("prj09_display_status", f"WITH {JOBS} SELECT job_id, CASE WHEN state = 'succeeded' THEN 'done' WHEN state = 'dead_letter' THEN 'failed' WHEN attempts > 0 THEN 'retrying' ELSE 'waiting' END AS display_status FROM jobs")
def prj09(spark, d):
    return jobs(spark, d).select("job_id", A.display_status(F.col("state"), F.col("attempts")).alias("display_status"))


@query("prj10_failure_classes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'extractor_incompatible' WHEN event_type = 'view' THEN 'validation_error' WHEN event_type = 'click' THEN 'database_unavailable' ELSE 'processing_error' END AS error_code, event_type NOT IN ('error', 'view') AS retryable FROM events")
def prj10(spark, d):
    kind = F.col("event_type")
    message = F.when(kind == "error", "Extractor mismatch").when(kind == "view", "Validation: bad").when(kind == "click", "database: gone").otherwise("boom")
    code, retryable = A.failure(message)
    return table(spark, d, "events").select("event_id", code.alias("error_code"), retryable.alias("retryable"))


@query("prj11_dead_letter_routing", f"WITH {JOBS} SELECT job_id, CASE WHEN NOT retryable OR attempts > 3 THEN 'dead_letter' ELSE 'retry' END AS next_state, CASE WHEN retryable AND attempts <= 3 THEN created_at + to_seconds([1, 5, 30][greatest(attempts, 1)]) END AS available_at FROM jobs WHERE state <> 'succeeded'")
def prj11(spark, d):
    state, due = A.routing(F.col("retryable"), F.col("attempts"), F.col("created_at"))
    return jobs(spark, d).filter("state <> 'succeeded'").select("job_id", state.alias("next_state"), due.alias("available_at"))


@query("tk01_offset_page", f"WITH {ALERTS} SELECT alert_id, observed_at, (SELECT count(*) FROM alerts WHERE status = 'open') AS total, TRUE AS has_more FROM alerts WHERE status = 'open' ORDER BY observed_at DESC, alert_id LIMIT 50 OFFSET 100")
def tk01(spark, d):
    return Q.offset_page(alerts(spark, d).filter("status = 'open'").select("alert_id", "observed_at"), [F.desc("observed_at"), F.col("alert_id")], 100, 50)


@query("tk02_keyset_page", f"WITH {JOBS}, p AS (SELECT job_id, created_at FROM jobs WHERE created_at < TIMESTAMP '1999-01-01' OR (created_at = TIMESTAMP '1999-01-01' AND job_id < 100) ORDER BY created_at DESC, job_id DESC LIMIT 40) SELECT job_id, created_at, TRUE AS more, to_base64(encode(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') || '|' || job_id)) AS cursor FROM p")
def tk02(spark, d):
    return Q.keyset_page(jobs(spark, d).select("job_id", "created_at"), "created_at", "job_id", (datetime(1999, 1, 1), 100), 40)


@query("tk03_outbox_page", f"WITH {ALERTS}, p AS (SELECT alert_id, observed_at FROM alerts WHERE {OUTBOX} = 'pending' ORDER BY observed_at DESC, alert_id DESC LIMIT 25) SELECT alert_id, observed_at, TRUE AS more, to_base64(encode(strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f') || '|' || alert_id)) AS cursor FROM p")
def tk03(spark, d):
    pending = (F.col("k") % 3 != 0) & (F.col("k") % 4 == 0)
    return Q.keyset_page(alerts(spark, d).filter(pending).select("alert_id", "observed_at"), "observed_at", "alert_id", None, 25)


LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
MAGNITUDES = {"quantity": "l_quantity", "price": "l_extendedprice / 2000", "discount": "l_discount * 400", "tax": "l_tax * 500", "flag": "0"}


@query("tk04_top_features", f"SELECT {LINE}, top[1].n || ',' || top[2].n || ',' || top[3].n AS top_features, round(top[1].v, 6) AS top_value FROM (SELECT *, list_sort([{', '.join(f'{{m: -abs(({e})::DOUBLE), i: {i}, n: {n!r}, v: ({e})::DOUBLE}}' for i, (n, e) in enumerate(MAGNITUDES.items()))}])[1:3] AS top FROM lineitem)")
def tk04(spark, d):
    top = Q.top_by_magnitude({n: F.expr(e) for n, e in MAGNITUDES.items()}, 3)
    return table(spark, d, "lineitem").withColumn("top", top).selectExpr(*LINE.split(", "), "array_join(transform(top, x -> x.name), ',') as top_features", "round(top[0].value, 6) as top_value")


@query("tk05_contributions", "WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) AS r FROM c) SELECT vec_id, CASE WHEN r <= 8 THEN 'f' || i ELSE 'Other ' || count(*) OVER (PARTITION BY vec_id, r <= 8) || ' features' END AS feature, round(CASE WHEN r <= 8 THEN v ELSE sum(v) OVER (PARTITION BY vec_id, r <= 8) END, 6) AS impact FROM r QUALIFY r <= 9")
def tk05(spark, d):
    c = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    top = A.top_contributions(c.withColumn("name", F.concat(F.lit("f"), F.col("i").cast("string"))), "vec_id", "name", "i", "v")
    return top.select("vec_id", "feature", R(F.col("impact")).alias("impact"))


@query("tk06_attributions", "WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1) // 4 AS g FROM embeddings), s AS (SELECT vec_id, 'raw_' || g AS feature, sum(v) AS impact FROM c GROUP BY vec_id, g), t AS (SELECT vec_id, list_sum(embedding)::DOUBLE AS output FROM embeddings) SELECT vec_id, feature, round(impact, 6) AS impact, row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(impact), 9) DESC, feature)::INT AS rank, abs(sum(impact) OVER (PARTITION BY vec_id) - output) <= 1e-4 AS additive FROM s JOIN t USING (vec_id)")
def tk06(spark, d):
    e = table(spark, d, "embeddings").withColumn("values", F.col("embedding").cast("array<double>"))
    # One-hot columns raw_<feature>_<level> fold into their raw feature.
    c = e.select("vec_id", F.posexplode("values").alias("i", "v")).withColumn("name", F.format_string("raw_%d_%d", F.floor(F.col("i") / 4), F.col("i") % 4))
    out = e.select("vec_id", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("output"))
    folded = A.folded_attributions(c, out, "vec_id", F.regexp_replace("name", r"_\d+$", ""), "v", "output", 1e-4)
    return folded.withColumn("impact", R(F.col("impact")))


@query("tk07_recent_open", f"WITH {ALERTS} SELECT alert_id, observed_at, severity FROM alerts WHERE status NOT IN ('resolved','false_positive') ORDER BY observed_at DESC, alert_id LIMIT 6")
def tk07(spark, d):
    return alerts(spark, d).filter(~F.col("status").isin(*S.TERMINAL)).orderBy(F.desc("observed_at"), "alert_id").limit(6).select("alert_id", "observed_at", "severity")


@query("tk08_models_order", "SELECT p_partkey, p_brand, p_size > 25 AS active FROM part ORDER BY active DESC, p_size DESC, p_partkey")
def tk08(spark, d):
    return table(spark, d, "part").withColumn("active", F.col("p_size") > 25).orderBy(F.desc("active"), F.desc("p_size"), "p_partkey").select("p_partkey", "p_brand", "active")


@query("tk10_cohort_order", f"WITH {ALERTS} SELECT DISTINCT event_type = 'view' AND k % 3 = 0 AS eligible, event_type AS channel, 'v' || (k % 2) AS schema, CASE WHEN k % 3 = 0 THEN 'fp' END AS fp FROM alerts ORDER BY eligible DESC, channel, schema, fp NULLS FIRST")
def tk10(spark, d):
    k = F.col("k")
    c = alerts(spark, d).select(((F.col("event_type") == "view") & (k % 3 == 0)).alias("eligible"), F.col("event_type").alias("channel"), F.concat(F.lit("v"), (k % 2).cast("string")).alias("schema"), F.when(k % 3 == 0, "fp").alias("fp"))
    return c.distinct().orderBy(F.desc("eligible"), "channel", "schema", "fp")


@query("tk11_top_rows", "SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 10")
def tk11(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("t")).orderBy(F.desc("t"), "user_id").limit(10).select("user_id", R(F.col("t"), 4).alias("total"))


@query("st01_cohorts", f"WITH {ALERTS} SELECT DISTINCT event_type, k % 2 AS v, user_id % 3 AS s FROM alerts")
def st01(spark, d):
    return alerts(spark, d).select("event_type", (F.col("k") % 2).alias("v"), (F.col("user_id") % 3).alias("s")).distinct()


@query("st02_cohort_union", f"WITH {ALERTS} SELECT DISTINCT {COHORT} AS cohort_key FROM alerts UNION SELECT '{{\"channel\":\"live\"}}'")
def st02(spark, d):
    deployed = spark.range(1).select(F.to_json(F.struct(F.lit("live").alias("channel"))).alias("cohort_key"))
    return deployed.unionByName(alerts(spark, d).select(_cohort().alias("cohort_key"))).dropDuplicates(["cohort_key"])


@query("st06_unseen_values", "SELECT DISTINCT l_suppkey AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-15' EXCEPT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01'")
def st06(spark, d):
    li = table(spark, d, "lineitem")
    now = li.filter(F.col("l_shipdate") >= F.lit(datetime(2001, 10, 15))).select(F.col("l_suppkey").alias("value")).distinct()
    return now.join(li.filter(F.col("l_shipdate") < F.lit(datetime(1995, 2, 1))).select(F.col("l_suppkey").alias("value")).distinct(), "value", "left_anti")


@query("st07_facets", f"WITH {ALERTS} SELECT 'family' AS facet, attack_class AS value FROM alerts WHERE attack_class IS NOT NULL GROUP BY 2 UNION ALL SELECT 'protocol', protocol FROM alerts WHERE protocol IS NOT NULL GROUP BY 2 ORDER BY 1, 2")
def st07(spark, d):
    a = alerts(spark, d).unpivot("alert_id", ["attack_class", "protocol"], "facet", "value").filter("value is not null")
    return a.select(F.when(F.col("facet") == "protocol", "protocol").otherwise("family").alias("facet"), "value").distinct().orderBy("facet", "value")
