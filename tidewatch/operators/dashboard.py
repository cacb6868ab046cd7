"""Roll-ups of alerts: counts, shares, timelines and endpoint graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.distributions import counted, quantiles
from . import severity as sev


def counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows (dimension, value, n) of several columns from one pass, by grouping sets."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"__g_{c}") for c in columns])
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        own = F.col(f"__g_{c}") == 0
        dimension, value = F.when(own, c).otherwise(dimension), F.when(own, F.col(c).cast("string")).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n")


def labelled_counts(df: DataFrame, label: Column, missing: str, name: str) -> DataFrame:
    """Rows (name, n), null labels under `missing`."""
    return df.groupBy(F.coalesce(label, F.lit(missing)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(0))))


def bucket(ts: Column, minutes: int) -> Column:
    """The start of the bucket of so many minutes since the epoch."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(seconds - seconds % (60 * minutes)).cast("timestamp_ntz")


def severity_timeline(df: DataFrame, ts: str, minutes: int, levels=("critical", "high", "medium", "low"), fill: bool = True) -> DataFrame:
    """Rows (bucket, <levels>, total): alerts in each bucket, the total over all severities.

    Rows without a time are left out. `fill`: empty buckets between the first and the
    last one too; the bounds come from the few bucket rows, not from the alerts.
    """
    b = df.filter(F.col(ts).isNotNull()).groupBy(bucket(F.col(ts), minutes).alias("bucket"))
    b = b.agg(*[F.count_if(F.col("severity") == x).alias(x) for x in levels], F.count(F.lit(1)).alias("total"))
    if not fill:
        return b
    ends = b.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z")).filter("a is not null")
    every = ends.select(F.explode(F.sequence("a", "z", F.make_dt_interval(mins=F.lit(minutes)))).alias("bucket"))
    return every.join(b, "bucket", "left").na.fill(0, [*levels, "total"])


def detections(df: DataFrame, family: str) -> DataFrame:
    """Rows (family, n, unresolved, median_confidence)."""
    finite = F.when(~F.isnan("confidence") & (F.abs("confidence") != float("inf")), F.col("confidence"))
    counts = df.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("status").isin(*sev.TERMINAL)).alias("unresolved"))
    middle = quantiles(counted(df.select(F.col(family).alias("__f"), finite.alias("__x")), ["__f"], "__x"), ["__f"], "__x", [0.5])
    return counts.join(middle, F.col(family).eqNullSafe(F.col("__f")), "left").select(*counts.columns, F.col("q")[0].alias("median_confidence"))


def _graph_measures(again: Column) -> list[Column]:
    """What alerts of a node or edge come to. `again` is true where a row's alert was counted there before, so
    that alerts are told apart without a shuffle of their ids: a row of the table is an alert."""
    open_ = ~F.col("status").isin(*sev.TERMINAL)
    return [
        F.count(F.lit(1)).alias("n_alerts"), F.count_if(open_).alias("n_unresolved"), sev.from_rank(F.max(sev.rank(F.col("severity")))).alias("severity"),
        sev.from_rank(F.max(F.when(open_, sev.rank(F.col("severity"))))).alias("open_severity"), F.array_join(F.array_sort(F.collect_set("protocol")), ",").alias("protocols"),
        F.max("observed_at").alias("last_seen"), F.count_if(~again).alias("n_distinct_alerts"),
    ]


def identity_quality(endpoint: Column) -> Column:
    """address, port_only or unknown; IPv4 by its four parts, IPv6 by its shape."""
    v4 = endpoint.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    v6 = endpoint.contains(":") & endpoint.rlike(r"^[0-9A-Fa-f:.]{2,45}$")
    return F.when(v4 | v6, "address").when(endpoint.rlike(r"^(port )?\d+$"), "port_only").otherwise("unknown")


def topology_nodes(df: DataFrame) -> DataFrame:
    """One row for each endpoint; an alert counts for both its ends, a loop twice.

    Counts are partly aggregated before the shuffle, so a hot endpoint sends few rows.
    """
    ends = df.select("*", F.posexplode(F.array("source", "destination")).alias("__end", "node")).filter(F.col("node").isNotNull())
    loop = (F.col("__end") == 1) & F.col("source").eqNullSafe(F.col("destination"))
    return ends.groupBy("node").agg(*_graph_measures(loop)).withColumn("identity", identity_quality(F.col("node")))


def topology_edges(df: DataFrame) -> DataFrame:
    both = df.filter(F.col("source").isNotNull() & F.col("destination").isNotNull())
    return both.groupBy("source", "destination").agg(*_graph_measures(F.lit(False)))


def open_counts(df: DataFrame, status: str, severity: str, worst: str = "critical") -> DataFrame:
    """One row (total, unresolved, critical_open)."""
    open_ = ~F.col(status).isin(*sev.TERMINAL)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(open_).alias("unresolved"), F.count_if((F.col(severity) == worst) & open_).alias("critical_open"))


def lately(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """Rows less than `interval` older than the newest one."""
    now = F.broadcast(df.agg(F.max(ts).alias("__now")))
    return df.join(now, F.col(ts) > F.col("__now") - F.expr(f"interval {interval}")).drop("__now")


def latencies(df: DataFrame, by: list[str], value: str, levels=(0.5, 0.95)) -> DataFrame:
    """Rows (by, n, mean, q): rows, mean and interpolated quantiles of each group, from counts of distinct values.
    Without `by` one row; a group without values has no quantiles."""
    means = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    found = quantiles(counted(df, by, value), by, value, list(levels))
    if not by:
        return means.join(F.broadcast(found), F.lit(True), "left")  # a row each
    own = found.select(*[F.col(c).alias(f"__{c}") for c in by], "q")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return means.join(own, same, "left").select(*by, "n", "mean", "q")


def review(df: DataFrame, status: str) -> DataFrame:
    """One row (confirmed, false_positive, confirmed_rate) of what analysts closed; no rate if they closed nothing."""
    yes, no = F.count_if(F.col(status) == "resolved"), F.count_if(F.col(status) == "false_positive")
    return df.agg(yes.alias("confirmed"), no.alias("false_positive"), (yes / F.nullif(yes + no, F.lit(0))).alias("confirmed_rate"))


def truth_rates(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row (attack_recall, normal_fpr, accuracy) of two truth values; a rate over no rows is null."""
    rate = lambda a, b: F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    return df.agg(rate(truth & said, truth).alias("attack_recall"), rate(~truth & said, ~truth).alias("normal_fpr"), rate(truth == said, F.lit(True)).alias("accuracy"))


def overview(df: DataFrame, source: str, destination: str, family: str) -> DataFrame:
    """One row (endpoints, top_family): distinct ends, and the commonest family, ties to the least name."""
    ends = df.select(F.explode(F.array(source, destination)).alias("n")).filter("n is not null").distinct().agg(F.count(F.lit(1)).alias("endpoints"))
    top = df.filter(F.col(family).isNotNull()).groupBy(family).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), family).limit(1)
    return ends.crossJoin(top.agg(F.first(family).alias("top_family")))
