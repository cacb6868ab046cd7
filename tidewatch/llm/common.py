"""What the operators of this subpackage share: tables, staging and text constants."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that part words and are stripped from lines: space, tab, LF, VT, FF, CR.
WS = " \t\n\x0b\x0c\r"
#: A word, in the syntax of Java's and RE2's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes that a side may hold, as counted before, to be sent to all executors.
BROADCAST_BYTES = 32 << 20

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder; a cluster has no
    folder that could be assumed, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir.setdefault("at", tempfile.mkdtemp(prefix="spark-shared-"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once as Parquet to the shared folder and read back.

    The lineage ends here, so a lost executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table of rows of at most `row_bytes` bytes may be broadcast."""
    return df.count() * row_bytes <= limit


def attached(docs: DataFrame, side: DataFrame, on: Column, how: str, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs joined with a staged side, which is broadcast if its counted size allows it."""
    return docs.join(F.broadcast(side) if small_enough(side, row_bytes, limit) else side, on, how)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is; pure ASCII text takes the quick way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(doc_id: str, text: str) -> Column:
    """Tells rows apart that share a doc_id but not a text; equal rows share it."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))


def crc32_sql(text: str) -> str:
    """DuckDB's SQL for the crc32 of an ASCII text, unsigned, bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295::BIGINT)"
