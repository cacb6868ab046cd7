"""What stands beside the status of a health window: rejections, performance against ground truth,
latencies and analysts' reviews of the same cohort and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions import distributions as S

UNCLASSIFIED = "unclassified_attack"


def interval_counts(events: DataFrame, ts: str, keys: list[str], windows: DataFrame, window_keys: list[str], bucket_seconds: int = 300) -> DataFrame:
    """Rows (*window_keys, *keys, n): how many events lie within each window (since, checked_at], both ends in its row.

    Events are counted by buckets of time, and a window takes the counts of the buckets that it
    holds whole; only events in the two buckets that its ends cut are compared one by one. So
    an event isn't paired with every window that holds it.
    """
    us = bucket_seconds * 1_000_000
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = events.select(*keys, at(ts).alias("__t")).withColumn("__bucket", F.expr(f"floor(__t / {us})"))
    w = windows.select(*window_keys, at("since").alias("__a"), at("checked_at").alias("__z"))
    # A bucket b holds times from b * us on; those after a and up to z are whole if all of them are.
    first, last = F.expr(f"floor((__a + {us}) / {us})"), F.expr(f"floor((__z + 1) / {us}) - 1")
    whole = w.filter(first <= last).select(*window_keys, F.explode(F.sequence(first, last)).alias("__bucket"))
    inner = e.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("n")).join(whole, "__bucket").groupBy(*window_keys, *keys).agg(F.sum("n").alias("n"))
    ends = F.array_distinct(F.array(F.expr(f"floor(__a / {us})"), F.expr(f"floor(__z / {us})")))
    cut = w.withColumn("__bucket", F.explode(ends)).filter(~F.col("__bucket").between(first, last))
    outer = e.join(cut, "__bucket").filter("__t > __a and __t <= __z").groupBy(*window_keys, *keys).agg(F.count(F.lit(1)).alias("n"))
    return inner.unionByName(outer).groupBy(*window_keys, *keys).agg(F.sum("n").alias("n"))


def rejections(failures: DataFrame, ts: str, channel: str, version: str, code: str, windows: DataFrame, cohorts: DataFrame, bucket_seconds: int = 300) -> DataFrame:
    """Rows (window, checked_at, cohort, schema_rejections, error_codes): the failures of a cohort's channel that have
    its schema version or none; error_codes is a map of counts. cohorts: rows (cohort, channel, version), few."""
    n = interval_counts(failures.select(ts, channel, version, code), ts, [channel, version, code], windows, ["window", "checked_at"], bucket_seconds)
    own = cohorts.select(F.col("cohort"), F.col("channel").alias("__channel"), F.col("version").alias("__version"))
    n = n.join(F.broadcast(own), (F.col(channel) == F.col("__channel")) & (F.col(version).isNull() | F.col("__version").isNull() | (F.col(version) == F.col("__version"))))
    codes = n.groupBy("window", "checked_at", "cohort", F.col(code).alias("code")).agg(F.sum("n").alias("n"))
    every = F.array_sort(F.collect_list(F.struct("code", "n")))  # codes are a fixed list
    return codes.groupBy("window", "checked_at", "cohort").agg(F.sum("n").alias("schema_rejections"), F.map_from_entries(every).alias("error_codes"))


def performance(rows: DataFrame, keys: list[str], truth: Column, binary: Column, family: Column, latency: Column) -> DataFrame:
    """Rows (*keys, labelled_count, detector_attack_recall, detector_normal_false_positive_rate, cascade_accuracy,
    latency_median, latency_p95) of the observations of each window; rates are null where nothing
    could be rated. A row without truth isn't labelled, and counts for the latencies only."""
    normal = F.lower(truth).isin([x.lower() for x in schema.NORMAL_LABELS])
    r = rows.select(*keys, F.when(normal, "normal").otherwise(truth).alias("truth"), binary.alias("binary"), F.when(binary == "normal", "normal").otherwise(F.coalesce(family, F.lit(UNCLASSIFIED))).alias("said"), latency.cast("double").alias("ms"))
    attack, called = F.col("truth") != "normal", F.col("binary") == "attack"
    share = lambda hit, of: F.try_divide(F.count_if(of & hit), F.count_if(of))
    rated = r.groupBy(*keys).agg(
        F.count("truth").alias("labelled_count"), share(called, attack).alias("detector_attack_recall"), share(called, ~attack & F.col("truth").isNotNull()).alias("detector_normal_false_positive_rate"),
        share(F.col("truth") == F.col("said"), F.col("truth").isNotNull()).alias("cascade_accuracy"),
    )
    levels = S.quantiles(S.counted(r, keys, "ms"), keys, "ms", [0.5, 0.95])
    return rated.join(levels.select(*keys, F.col("q")[0].alias("latency_median"), F.col("q")[1].alias("latency_p95")), keys, "left")


def reviews(rows: DataFrame, keys: list[str], event: str, feedback: DataFrame) -> DataFrame:
    """Rows (*keys, reviewed, confirmed, confirmed_rate): what analysts said (event, status) of the alerts of each window."""
    said = feedback.filter(F.col("status").isin("confirmed", "false_positive"))
    j = rows.select(*keys, event).join(said, event)
    n = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("status") == "confirmed").alias("confirmed"))
    return n.withColumn("confirmed_rate", F.col("confirmed") / F.col("reviewed"))
