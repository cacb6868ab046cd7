"""Structured Streaming operators: ingest, scoring, rules, timelines and sensor state.

Each takes and returns a streaming DataFrame, or writes micro-batches by a function that
can be repeated: what a failed batch has written already is recognised by its keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import lifecycle, severity
from tidewatch.sources import sinks
from tidewatch.sources.keyed import KeyedStore


def follow(spark: SparkSession, path: str, schema, files_per_batch: int = 10, form: str = "json") -> DataFrame:
    """Rows of files that are dropped into a folder whole, so a torn line is never read."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def once(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key's first row; state is kept for as long as a repeat may come."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def ingest(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends what the keyed store at `path` doesn't have, and says of each row
    of the batch whether it was new, a duplicate of what is stored or of an earlier row, or in
    conflict with the one or the other: rows (key, digest, disposition) in the folder batch=<n> of
    `path`-dispositions. Rows in conflict are not appended.

    A repeated batch finds its own rows stored; what its folder says already stays.
    """

    store = lambda df: KeyedStore(df.sparkSession, path, df.schema, key)

    def write(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        seen = sinks.stored(spark, f"{path}-dispositions/batch={n}", f"{key} {dict(df.dtypes)[key]}, digest string, disposition string")
        if seen is None:
            digest = lambda x: x.withColumn("__digest", F.sha2(F.to_json(F.struct(*df.columns)), 256))
            own = digest(df).withColumn("__place", F.monotonically_increasing_id()).persist()
            known = digest(store(df).matching(own)).select(key, "__digest")
            told = lifecycle.split_known(own.select(key, "__digest", "__place"), known, key, "__digest", "__place").select(key, F.col("__digest").alias("digest"), "disposition")
            told.write.mode("overwrite").parquet(f"{path}-dispositions/batch={n}")
            own.unpersist()
            seen = spark.read.schema(told.schema).parquet(f"{path}-dispositions/batch={n}")
        new = seen.filter("disposition = 'new'").select(key).distinct()
        store(df).append(df.join(new, key, "left_semi").select(*df.columns))

    return write


def score_batch(predictions: str, alerts: str, key: str, predictor: Transformer) -> Callable[[DataFrame, int], None]:
    """A batch writer: every observation becomes a prediction, every attack an alert. `predictor` adds
    m_label and m_score, as the rule detector and fitted models do."""

    def write(df: DataFrame, _: int) -> None:
        said = predictor.transform(df).select(*df.columns, F.col("m_score").alias("score"), F.col("m_label").alias("prediction"))
        scored = said.persist()
        sinks.append_new(scored, predictions, key)
        hit = scored.filter("prediction = 'attack'").withColumn("severity", severity.assess(F.col("prediction"), F.col("score"), F.lit(False)))
        sinks.append_new(hit, alerts, key)
        scored.unpersist()

    return write


def threshold_rule(stream: DataFrame, ts: str, source: str, at_least: int, window: str, delay: str) -> DataFrame:
    """One row for each source and tumbling window in which it came `at_least` times."""
    n = stream.withWatermark(ts, delay).groupBy(F.window(ts, window), source).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") >= at_least).select(F.col("window.start").alias("started_at"), source, "n")


def limit_rule(stream: DataFrame, ts: str, source: str, key: str, window: str, delay: str) -> DataFrame:
    """One alert for each source and tumbling window, its first row (by time, then key), and how many more there were."""
    b = stream.withWatermark(ts, delay).groupBy(F.window(ts, window), source).agg(F.min(F.struct(ts, key)).alias("first"), (F.count(F.lit(1)) - 1).alias("n_suppressed"))
    return b.select(F.col("window.start").alias("started_at"), source, F.col(f"first.{key}").alias(key), "n_suppressed")


def content_rule(stream: DataFrame, column: str, words: list[str]) -> DataFrame:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col(column).contains(w)
    return stream.filter(hit)


def live_timeline(stream: DataFrame, ts: str, window: str, delay: str) -> DataFrame:
    b = stream.withWatermark(ts, delay).groupBy(F.window(ts, window))
    counts = b.agg(*[F.count_if(F.col("severity") == x).alias(x) for x in severity.LEVELS], F.count(F.lit(1)).alias("total"))
    return counts.select(F.col("window.start").alias("bucket"), *severity.LEVELS, "total")


def sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Rows (key, started_at, ended_at, n) of sessions that a gap ends, once the watermark has passed them."""
    s = stream.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap)).agg(F.max(ts).alias("ended_at"), F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("started_at"), "ended_at", "n")


def drain(stream: DataFrame, path: str, mode: str = "append", write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs a stream over all there is and stops. Each batch's rows are Parquet in a folder
    batch=<n> of `path`, which a repeated batch overwrites, or they are handed to `write`."""
    put = write or (lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
