"""Rules over alerts, their delivery and failed jobs, with the columns they read as parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .severity import TERMINAL

#: Codes of failures that a retry can't mend, and seconds before the first, second and any later retry.
FINAL, WAITS = ("extractor_incompatible", "validation_error"), (1, 5, 30)
#: What a failure's message holds, and the code that stands for it; the first that fits counts.
FAILURES = {"extractor": "extractor_incompatible", "validation": "validation_error", "database": "database_unavailable"}


def targets(label: Column, normal) -> tuple[Column, Column]:
    """(normal or attack, the label of an attack). A null label is an attack of no known family."""
    calm = F.coalesce(label.isin(*normal), F.lit(False))
    return F.when(calm, "normal").otherwise("attack"), F.when(~calm, label)


def recent(df: DataFrame, ts: str, interval: str, condition: Column) -> DataFrame:
    """Rows that meet the condition and are at most `interval` older than the newest row of df."""
    now = F.broadcast(df.agg(F.max(ts).alias("__now")))
    return df.filter(condition).join(now, F.col(ts) >= F.col("__now") - F.expr(f"interval {interval}")).drop("__now")


def elevated_and_open(severity: Column, status: Column, levels=("critical", "high")) -> Column:
    return severity.isin(*levels) & ~status.isin(*TERMINAL)


def newest(df: DataFrame, condition: Column, ts: str, key: str, n: int = 1) -> DataFrame:
    """The n newest rows that meet the condition, ties to the greater key."""
    return df.filter(condition).orderBy(F.desc(ts), F.desc(key)).limit(n)


def delivery_status(published_at: Column, attempts: Column) -> Column:
    return F.when(published_at.isNotNull(), "published").when(attempts > 0, "failed").otherwise("pending")


def display_status(state: Column, attempts: Column) -> Column:
    return F.when(state == "succeeded", "done").when(state == "dead_letter", "failed").when(attempts > 0, "retrying").otherwise("waiting")


def unified(sensor: Column, signature: Column, attack_class: Column, confidence: Column, occurred_at: Column, created_at: Column) -> list[Column]:
    """The columns of alerts of both sources: a sensor's alert has its signature as its class and no confidence."""
    return [
        F.when(sensor, "sensor").otherwise("model").alias("detection_source"), F.when(sensor, signature).otherwise(attack_class).alias("attack_class"),
        F.when(~sensor, confidence).alias("confidence"), F.coalesce(occurred_at, created_at).alias("observed_at"),
    ]


def profile_reasons(*violations: Column) -> Column:
    """The violations that aren't null, as an array."""
    return F.array_compact(F.array(*violations).cast("array<string>"))


def endpoint(port: Column, *addresses: Column) -> Column:
    """The first address known, else the port, else unknown."""
    return F.coalesce(*addresses, F.concat(F.lit("port "), port.cast("string")), F.lit("unknown"))


def canonical_key(**fields: Column) -> Column:
    """JSON of the fields in the order of their names, nulls written out, so that equal identities have equal keys."""
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})


def failure(message: Column, codes: dict[str, str] = FAILURES, other: str = "processing_error", final=FINAL) -> tuple[Column, Column]:
    """(error code, whether a retry may help) by what a message holds, whatever the case. No message: `other`."""
    code = reduce(lambda c, w: F.when(F.lower(message).contains(w), codes[w]).otherwise(c), reversed(codes), F.lit(other))
    return code, ~code.isin(*final)


def routing(retryable: Column, attempts: Column, failed_at: Column, most: int = 3, waits=WAITS) -> tuple[Column, Column]:
    """(next state, when it is due): dead letters are due never. Whether null may be retried isn't known: it is dead."""
    dead = ~F.coalesce(retryable, F.lit(False)) | (attempts > most)
    n = F.least(F.greatest(attempts, F.lit(1)), F.lit(len(waits)))
    wait = F.get(F.array(*[F.lit(w) for w in waits]), n - 1)
    return F.when(dead, "dead_letter").otherwise("retry"), F.when(~dead, failed_at + F.make_dt_interval(secs=wait))


def top_contributions(df: DataFrame, key: str, feature: str, position: str, value: str, k: int = 8) -> DataFrame:
    """Rows (key, feature, impact): the k values of greatest magnitude of each key, ties by position, and one
    row for the sum of its others, if any. Ranks are taken within a key, that is one explained row."""
    r = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs(value)), position)))
    named = r.withColumn("__f", F.when(F.col("__r") <= k, F.col(feature))).withColumn("__rest", F.col("__r") > k)
    sums = named.groupBy(key, "__rest", "__f").agg(F.sum(value).alias("impact"), F.count(F.lit(1)).alias("__n"))
    return sums.select(key, F.when(F.col("__rest"), F.format_string("Other %d features", "__n")).otherwise(F.col("__f")).alias("feature"), "impact")


def folded_attributions(df: DataFrame, outputs: DataFrame, key: str, name: Column, value: str, output: str, tolerance: float = 1e-5) -> DataFrame:
    """Rows (key, feature, impact, rank, additive): encoded columns summed up under their raw feature's `name`,
    ranked by magnitude, and whether a key's impacts add up to its output."""
    w = Window.partitionBy(key)
    s = df.groupBy(key, name.alias("feature")).agg(F.sum(value).alias("impact")).join(outputs.select(key, output), key)
    rank = F.row_number().over(w.orderBy(F.desc(F.round(F.abs("impact"), 9)), "feature"))
    return s.select(key, "feature", "impact", rank.alias("rank"), (F.abs(F.sum("impact").over(w) - F.col(output)) <= tolerance).alias("additive"))
