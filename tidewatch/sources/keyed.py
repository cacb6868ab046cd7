"""A table of rows by key, for keys in any order: files by bucket of the key's hash, and a Bloom filter for each.

An append asks the filters which of its keys may be stored, and reads only the buckets of those;
for new keys, as most of a stream's are, that is next to nothing, whereas bounds of random keys prune
nothing. Filters are bitmaps that are added up, so every append writes only those of its own keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import stored

#: Bits that a key sets, bits in one bitmap row of Spark's bitmap functions.
HASHES, WORD_BITS = 7, 32_768
BUCKET = "__bucket"


class KeyedStore:
    """Rows (*schema) in the folder `path`, one for each key, with filters in `path`-filters. One writer at a time; rows without a key are appended as they are.

    buckets: files of an append at most. words: bitmap rows of a bucket's filter, of WORD_BITS bits each; some
    3,000 keys for each keep wrong hits at 1 in 100. Beyond that more buckets are read, and
    results stay right. Both are fixed once the first rows are written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64, words: int = 4) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets, self.words = spark, path.rstrip("/"), schema, key, buckets, words

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _bits(self, keys: DataFrame) -> DataFrame:
        """Rows (*keys' columns, word, bit): the bits of each key; words are counted from 1."""
        place = [F.pmod(F.xxhash64(F.lit(i), self.key), F.lit(self.words * WORD_BITS)) for i in range(HASHES)]
        at = keys.withColumn("__at", F.explode(F.array_distinct(F.array(*place))))
        return at.withColumns({"word": F.bitmap_bucket_number(F.col("__at") + 1), "bit": F.bitmap_bit_position(F.col("__at") + 1)}).drop("__at")

    def read(self) -> DataFrame:
        """All rows; none before the first append."""
        had = stored(self.spark, self.path, self.schema)
        return had if had is not None else self.spark.createDataFrame([], self.schema)

    def perhaps(self, keys: DataFrame) -> DataFrame:
        """The distinct keys of a table that may be stored, with their bucket: all that are, and some that aren't."""
        own = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct().withColumn(BUCKET, self._bucket())
        filters = stored(self.spark, f"{self.path}-filters", f"{BUCKET} int, word long, bits binary")
        if filters is None:
            return own.limit(0)
        whole = filters.groupBy(BUCKET, "word").agg(F.bitmap_or_agg("bits").alias("bits"))
        asked = self._bits(own).join(whole, [BUCKET, "word"], "left")
        byte = "cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
        is_set = F.coalesce(F.expr(f"shiftright({byte}, cast(bit % 8 as int)) & 1 = 1"), F.lit(False))
        return asked.groupBy(self.key, BUCKET).agg(F.bool_and(is_set).alias("__all")).filter("__all").drop("__all")

    def matching(self, keys: DataFrame) -> DataFrame:
        """Stored rows of the buckets that may hold some of the keys, and hold all that do."""
        asked = [r[0] for r in self.perhaps(keys).select(BUCKET).distinct().collect()]  # at most `buckets` numbers
        # A file's number is that of its bucket.
        rows = stored(self.spark, self.path, self.schema, f"part-{{{','.join(f'{b:05}' for b in asked)}}}-*") if asked else None
        return rows if rows is not None else self.spark.createDataFrame([], self.schema)

    def append(self, df: DataFrame) -> None:
        """Adds the rows whose key isn't stored, one for each key. Repeating it changes nothing."""
        named = df.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        fresh = named.join(self.matching(named).select(self.key), self.key, "left_anti").select(*df.columns)
        fresh = fresh.unionByName(df.filter(F.col(self.key).isNull())).withColumn(BUCKET, self._bucket())
        # Filters first: if the rows are never written, some buckets are read in vain, and no key is missed.
        bits = self._bits(fresh.filter(F.col(self.key).isNotNull()).select(self.key, BUCKET))
        filters = bits.groupBy(BUCKET, "word").agg(F.bitmap_construct_agg("bit").alias("bits"))
        filters.coalesce(1).write.mode("append").parquet(f"{self.path}-filters")  # at most buckets * words rows
        fresh.repartitionById(self.buckets, F.coalesce(BUCKET, F.lit(0))).drop(BUCKET).write.mode("append").parquet(self.path)
