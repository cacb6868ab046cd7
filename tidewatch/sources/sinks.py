"""Writes that can be repeated without doubling rows."""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewatch.functions.scratch import staged


def stored(spark: SparkSession, path: str, schema, names: str = "*") -> DataFrame | None:
    """The table at `path`, or None before its first write; any other error is raised. Only files whose names
    match the pattern `names` are read."""
    try:
        return (spark.read.schema(schema) if schema is not None else spark.read).option("pathGlobFilter", names).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def within(table: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The rows of a table whose keys lie between the least and the greatest of df, so that a scan skips files and row groups of others."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    return table.filter(F.col(key).between(lo, hi)) if lo is not None else table.filter(F.lit(False))


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the table at `path` doesn't have yet, one for each key; returns the table.

    One writer at a time: streams write batch after batch. Rows without a key are appended as they are.
    """
    spark: SparkSession = df.sparkSession
    fresh = df.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.filter(F.col(key).isNull()))
    if (had := stored(spark, path, df.schema)) is not None:
        fresh = fresh.join(within(had, df, key).select(key), key, "left_anti").select(*df.columns)
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def refused(df: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of df that append_new wouldn't take: their key is stored already, or has an earlier row in df.

    Of rows of a new key that differ any one may be taken, so which ones are refused is then any of them too.
    """
    had = stored(df.sparkSession, path, df.schema)
    known = df.filter(F.lit(False)) if had is None else df.join(within(had, df, key).select(key), key, "left_semi").select(*df.columns)
    new = df if had is None else df.join(within(had, df, key).select(key), key, "left_anti").select(*df.columns)
    return known.unionByName(new.exceptAll(new.dropDuplicates([key])))


def outbox(predictions: DataFrame, alerts: DataFrame, key: str) -> DataFrame:
    """Rows (event_id, event_type, payload): one event for each prediction and one for each alert."""
    made = lambda df, kind: df.select(F.col(key).alias("event_id"), F.lit(kind).alias("event_type"), F.to_json(F.struct("*")).alias("payload"))
    return made(predictions, "prediction.created").unionByName(made(alerts, "alert.created"))


def dead_letters(jobs: DataFrame, columns: list[str]) -> DataFrame:
    """What a dead-letter export holds, in its order."""
    return jobs.filter("state = 'dead_letter'").select(*columns).orderBy("created_at", "job_id")


def write_report(df: DataFrame, path: str, digest: str = "digest") -> DataFrame:
    """Writes rows as JSON, each with the digest of its own canonical text; returns them as read back."""
    from tidewatch.functions.identity import canonical_digest

    text = {f.name: F.col(f.name).cast("string") for f in df.schema.fields}
    df.withColumn(digest, canonical_digest(text)).write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.withColumn(digest, F.lit("")).schema).json(path)


def artefact_digest(spark: SparkSession, path: str, digest: str = "digest") -> DataFrame:
    """One row (n_rows, digest) of a report: the digest tree over its rows' digests in order. It is written
    beside the report, as <path>-manifest."""
    from tidewatch.functions.identity import digest_tree

    out = digest_tree(spark.read.schema(f"{digest} string").json(path), [], digest).select(F.col("n").alias("n_rows"), "digest")
    out.write.mode("overwrite").json(f"{path}-manifest")
    return spark.read.schema(out.schema).json(f"{path}-manifest")


def append_by_day(df: DataFrame, path: str, ts: str) -> None:
    """Appends rows in a folder for each day of `ts`, which `retain` can drop whole."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def retain(spark: SparkSession, path: str, ts: str, cutoff: datetime) -> None:
    """Drops what is older than `cutoff` from a table of append_by_day: whole days by their folders, and of the
    cutoff's own day the rows before it. Files of younger days aren't touched."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for day in files.listStatus(root):  # folders, one for each day
        name = day.getPath().getName()
        if name.startswith("day=") and name.removeprefix("day=") < cutoff.date().isoformat():
            files.delete(day.getPath(), True)
    if cutoff != datetime.combine(cutoff.date(), time()):
        rows = stored(spark, f"{path}/day={cutoff.date().isoformat()}", None)
        if rows is not None:
            kept = staged(rows.filter(F.col(ts) >= F.lit(cutoff)).withColumn("day", F.lit(cutoff.date())), "cutoff-day")
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
