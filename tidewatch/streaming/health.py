"""Health of cohorts judged within a stream, from histograms by pane that add up to windows.

A row of the stream is counted once, in the pane of its time: by bin of the reference's edges,
by slot among the reference's sample, by category, by label. Any window is the sum of its panes,
so a row isn't copied to every window and check that holds it, and the state is a few thousand
counts for each cohort, feature and pane, whatever the traffic. When a batch has brought the clock past a check,
the windows of that check are added up and judged as a batch evaluation judges rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import distributions as S
from tidewatch.operators import drift as D
from tidewatch.sources import sinks

PANE = ["pane", "cohort", "kind", "feature", "bin", "slot", "x"]


class Reference:
    """What windows are held against: small tables, one row for each feature, category or stored value.

    numeric, outputs: rows of `drift.numeric_reference`. sample: (feature, x). vocabulary, output_vocabulary:
    (feature, x, n_ref). numeric_rows, output_rows: counted values (feature, x, n) of the reference.
    limits, output_limits: (feature, threshold).
    """

    def __init__(self, numeric, numeric_rows, sample, vocabulary, limits, outputs, output_rows, output_vocabulary, output_limits, rate: float, rate_limit: float) -> None:
        self.numeric, self.sample, self.vocabulary, self.limits = numeric, sample, vocabulary, limits
        self.outputs, self.output_vocabulary, self.output_limits, self.rate, self.rate_limit = outputs, output_vocabulary, output_limits, rate, rate_limit
        self.slot = S.slots(sample)
        self.histogram, self.output_histogram = D.histogram(numeric_rows, numeric), D.histogram(output_rows, outputs)
        self.sample_slots = sample.select("feature", self.slot(F.col("feature"), F.col("x")).alias("slot"))


def panes(stream: DataFrame, ts: str, cohort: str, numeric: list[str], categorical: list[str], labels: dict[str, Column], scores: dict[str, Column], ref: Reference, pane: str, delay: str) -> DataFrame:
    """Rows (pane, cohort, kind, feature, bin, slot, x, n), updated as rows come: pane is the time at which a
    pane ends, and its rows are those up to and at that time. kind is rows, numeric, category, label or score."""
    cell = lambda kind, feature, value=None, text=None: F.struct(F.lit(kind).alias("kind"), F.lit(feature).alias("feature"), (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(None) if text is None else text).cast("string").alias("x"))
    cells = [cell("rows", "")] + [cell("numeric", c, F.col(c)) for c in numeric] + [cell("category", c, text=F.col(c)) for c in categorical]
    cells += [cell("label", name, text=c) for name, c in labels.items()] + [cell("score", name, c) for name, c in scores.items()]
    # A pane holds (start, end], as windows hold (since, check].
    s = stream.withWatermark(ts, delay).select((F.col(ts) - F.expr("interval 1 microsecond")).alias("ts"), F.col(cohort).alias("cohort"), F.explode(F.array(*cells)).alias("c")).select("ts", "cohort", "c.*")
    number = F.col("kind").isin("numeric", "score")
    sound = F.when(number, F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).otherwise((F.col("kind") == "rows") | F.col("x").isNotNull())
    edges = ref.numeric.select(F.lit("numeric").alias("of"), F.col("feature").alias("f"), "edges").unionByName(ref.outputs.select(F.lit("score").alias("of"), F.col("feature").alias("f"), "edges"))
    s = s.filter(sound).join(F.broadcast(edges), (F.col("kind") == F.col("of")) & (F.col("feature") == F.col("f")), "left")
    s = s.withColumn("bin", F.when(number, S.bin_of(F.col("value"), F.col("edges"))).cast("int"))
    s = s.withColumn("slot", F.when(F.col("kind") == "numeric", ref.slot(F.col("feature"), F.coalesce("value", F.lit(0.0)))))
    n = s.groupBy(F.window("ts", pane).alias("w"), *PANE[1:]).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.end").alias("pane"), *PANE[1:], "n")


def statuses(counts: DataFrame, checks: list[datetime], windows: list[tuple[str, float, int]], routes: DataFrame, ref: Reference) -> DataFrame:
    """Rows (window, checked_at, cohort, n, score, status) of the checks, from panes (*PANE, n): as `drift.health`.

    windows: (name, days, rows at least). Two alarms before a check make it critical, so the checks should start two before
    the first that is of interest.
    """
    spark = counts.sparkSession
    policy = spark.createDataFrame([(name, c, c - timedelta(days=days), least) for name, days, least in windows for c in checks], "window string, checked_at timestamp, since timestamp, minimum int")
    keys = ["window", "checked_at", "cohort"]
    held = counts.join(F.broadcast(policy), (F.col("pane") > F.col("since")) & (F.col("pane") <= F.col("checked_at")))
    held = held.groupBy(*keys, "minimum", *PANE[2:]).agg(F.sum("n").alias("n")).persist()
    of = lambda kind, *columns: held.filter(F.col("kind") == kind).select(*keys, "feature", *columns, "n")
    rows = held.filter("kind = 'rows'").groupBy(*keys).agg(F.sum("n").alias("n"), F.first("minimum").alias("minimum"))
    numeric = of("numeric", "bin", "slot")
    js = D.binned_distance(ref.numeric, ref.histogram, D.histogram(numeric, ref.numeric, keys), keys)
    ks = D.sample_distance(ref.sample_slots, numeric.groupBy(*keys, "feature", "slot").agg(F.sum("n").alias("n")), keys, "slot")
    judged = D.judge_features(js.join(ks, [*keys, "feature"]), D.categorical_drift(ref.vocabulary, of("category", "x"), keys), ref.limits, keys)
    outputs = D.output_metrics(ref.output_vocabulary, ref.outputs, ref.output_histogram, of("label", "x"), of("score", "bin"), ref.output_limits, keys, ref.rate, ref.rate_limit)
    return D.health(rows, routes, D.window_status(judged, keys), D.output_status(outputs, keys), "cohort")


def evaluated(path: str, schema: T.StructType, every: timedelta, since: datetime, windows: list[tuple[str, float, int]], routes: DataFrame, ref: Reference, lag: timedelta = timedelta(0)) -> Callable[[DataFrame, int], None]:
    """A batch writer for `panes`: keeps the counts in `path`-panes, and appends to `path` the statuses of every check,
    `every` from `since` on, that the newest pane less `lag` has passed and that wasn't judged before.

    A pane's count only grows, so of several batches' counts of one cell the greatest holds, and a
    repeated batch changes nothing. Panes from before the widest window's reach of the next check are not read.
    """
    kept, reach = f"{path}-panes", timedelta(days=max(days for _, days, _ in windows))

    def write(df: DataFrame, batch: int) -> None:
        spark: SparkSession = df.sparkSession
        df.write.mode("overwrite").parquet(f"{kept}/batch={batch}")
        every_pane = spark.read.schema(schema).parquet(kept)
        newest = every_pane.agg(F.max("pane")).first()[0]
        done = sinks.stored(spark, path, "checked_at timestamp")
        last = done.agg(F.max("checked_at")).first()[0] if done is not None else None
        first = since if last is None else last + every
        due = [first + i * every for i in range(int((newest - lag - first) / every) + 1)] if newest and newest - lag >= first else []
        if not due:
            return
        before = [due[0] - 2 * every, due[0] - every]
        live = every_pane.filter(F.col("pane") > F.lit(before[0] - reach)).groupBy(*PANE).agg(F.max("n").alias("n"))
        told = statuses(live, before + due, windows, routes, ref).filter(F.col("checked_at") >= F.lit(due[0]))
        told.coalesce(1).write.mode("append").parquet(path)  # a row for each window, check and cohort

    return write
