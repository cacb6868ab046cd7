"""The roles of the flow schema, bound to the given tables, in Spark and in SQL alike.

`alerts` sees each event as a scored alert between two endpoints; `jobs` and
`transitions` see orders and their lines as ingestion jobs and their audit log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import severity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, kind = F.col("k"), F.col("event_type")
    e = e.withColumn("prediction", F.when((kind == "error") | (F.col("value") > 100), "attack").otherwise("normal"))
    e = e.withColumn("confidence", F.least(F.col("value") / 100, F.lit(1.0)))
    e = e.withColumn("attack_class", F.when((F.col("prediction") == "attack") & (k % 5 != 0), F.concat(F.lit("family_"), (k % 5).cast("string"))))
    e = e.withColumn("signature", F.when(k % 7 == 0, F.concat(F.lit("sig_"), (k % 3).cast("string"))))
    e = e.withColumn("status", F.when(kind == "click", "acknowledged").when(kind == "signup", "resolved").when(kind == "purchase", "false_positive").otherwise("open"))
    e = e.withColumn("protocol", F.when(k % 4 == 0, "TCP").when(k % 4 == 1, "udp").when(k % 4 == 2, "Http"))
    e = e.withColumn("severity", severity.assess(F.col("prediction"), F.col("confidence"), F.lit(False)))
    return e.select(
        F.col("event_id").alias("alert_id"), F.col("ts").alias("observed_at"), F.col("user_id").cast("string").alias("source"), k.cast("string").alias("destination"),
        "prediction", "confidence", "attack_class", "signature", "status", "protocol", "severity", "event_type", "value", "k", "user_id", "props",
    )


ALERTS = """
alerts AS (
  SELECT event_id AS alert_id, ts AS observed_at, user_id::VARCHAR AS source, k::VARCHAR AS destination, prediction, confidence,
         CASE WHEN prediction = 'attack' AND k % 5 <> 0 THEN 'family_' || (k % 5) END AS attack_class,
         CASE WHEN k % 7 = 0 THEN 'sig_' || (k % 3) END AS signature,
         CASE event_type WHEN 'click' THEN 'acknowledged' WHEN 'signup' THEN 'resolved' WHEN 'purchase' THEN 'false_positive' ELSE 'open' END AS status,
         CASE k % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'udp' WHEN 2 THEN 'Http' END AS protocol,
         CASE WHEN prediction = 'normal' THEN 'informational' WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.75 THEN 'high' ELSE 'medium' END AS severity,
         event_type, value, k, user_id, props
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k, CASE WHEN event_type = 'error' OR value > 100 THEN 'attack' ELSE 'normal' END AS prediction, least(value / 100, 1.0::DOUBLE) AS confidence FROM events)
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "dead_letter").otherwise("queued")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("event_id"), state.alias("state"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"),
        F.when(F.col("o_orderkey") % 3 == 0, "extractor_mismatch").when(F.col("o_orderkey") % 3 == 1, "timeout").alias("error_code"),
        (F.col("o_orderkey") % 4 != 0).alias("retryable"), F.col("o_orderpriority").alias("channel"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("payload_size"),
    )


JOBS = """
jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS event_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'dead_letter' ELSE 'queued' END AS state, (o_orderkey % 5)::INT AS attempts,
         CASE o_orderkey % 3 WHEN 0 THEN 'extractor_mismatch' WHEN 1 THEN 'timeout' END AS error_code,
         o_orderkey % 4 <> 0 AS retryable, o_orderpriority AS channel, o_orderdate AS created_at, o_totalprice AS payload_size
  FROM orders
)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows, whose id is unique: a line is named by its part and supplier too."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), n.alias("seq"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]).alias("transition_id"),
        F.when(n % 4 == 1, "claimed").when(n % 4 == 2, "succeeded").when(n % 4 == 3, "retry").otherwise("dead_letter").alias("to_state"), F.col("l_shipdate").alias("occurred_at"),
    )


TRANSITIONS = """
transitions AS (
  SELECT l_orderkey AS job_id, l_linenumber AS seq, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS transition_id,
         CASE l_linenumber % 4 WHEN 1 THEN 'claimed' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'retry' ELSE 'dead_letter' END AS to_state, l_shipdate AS occurred_at
  FROM lineitem
)"""
