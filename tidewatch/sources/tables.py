"""Scans of flow files, with their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema

#: Columns that an index left behind.
ARTEFACTS = ("no",)


def flow_csv(spark: SparkSession, path: str, metadata: tuple[str, ...] = (), target: str | None = schema.TARGET, features: tuple[str, ...] = schema.FEATURES) -> DataFrame:
    """A flow table in CSV, all as text: its features in order, the target and the declared
    metadata. Index artefacts go; missing or undeclared columns are an error."""
    df = spark.read.csv(path, header=True)
    kept = [c for c in df.columns if not c.startswith("Unnamed:") and c not in ARTEFACTS]
    wanted = [*features, *([target] if target else []), *metadata]
    missing, extra = [c for c in wanted if c not in kept], [c for c in kept if c not in wanted]
    if missing or extra:
        raise ValueError(f"missing columns: {missing}; undeclared columns: {extra}")
    return df.select(*[F.col(f"`{c}`").alias(schema.column(c)) for c in wanted])


def observations_json(spark: SparkSession, path: str, row: T.StructType, lines: bool = True) -> DataFrame:
    """Observations, one on each line, or a document that is an array of them or wraps one in
    `observations`. A bad record fails the whole batch."""
    bad = "_corrupt_record"
    fields = T.StructType([*row.fields, T.StructField(bad, T.StringType())])
    if lines:
        df = spark.read.schema(fields).option("columnNameOfCorruptRecord", bad).json(path)
    else:
        wrapped = T.StructType([*row.fields, T.StructField("observations", T.ArrayType(row)), T.StructField(bad, T.StringType())])
        df = spark.read.schema(wrapped).option("columnNameOfCorruptRecord", bad).option("multiLine", True).json(path)
        own = F.struct(*[F.col(f.name) for f in row.fields])
        df = df.select(bad, F.explode(F.when(F.col("observations").isNotNull(), F.col("observations")).otherwise(F.array(own))).alias("o")).select("o.*", bad)
    # Spark doesn't let a query of raw JSON read the corrupt column alone.
    n, _ = df.agg(F.count_if(F.col(bad).isNotNull()), F.count(row.fields[0].name)).first()
    if n:
        raise ValueError(f"{n} records can't be read; the batch is refused")
    return df.drop(bad)


EVENT = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("flow_id", T.StringType()), T.StructField("src_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dest_ip", T.StringType()), T.StructField("dest_port", T.IntegerType()), T.StructField("proto", T.StringType()), T.StructField("app_proto", T.StringType()),
    T.StructField("alert", T.StructType([T.StructField("signature_id", T.IntegerType()), T.StructField("signature", T.StringType()), T.StructField("category", T.StringType()), T.StructField("severity", T.IntegerType()), T.StructField("action", T.StringType())])),
])


def sensor_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Alerts and statistics among a sensor's lines (static or streaming); what can't be read, or has no time, is skipped."""
    bad = "_corrupt_record"
    row = T.StructType([*EVENT.fields, T.StructField(bad, T.StringType())])
    e = lines.select(F.from_json(value, row, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("e")).select("e.*")
    return e.filter(F.col(bad).isNull() & F.col("event_type").isin("alert", "stats") & F.col("timestamp").isNotNull()).drop(bad)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, sha256, length) of the files under a path, by whole content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def manifest_mismatches(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (name, problem): files of a manifest (name, sha256) that are missing or differ, and files it doesn't have."""
    j = manifest.select("name", F.col("sha256").alias("want")).join(found.select("name", "sha256"), "name", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("sha256"), "changed")
    return j.select("name", problem.alias("problem")).filter("problem is not null")
