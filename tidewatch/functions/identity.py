"""Deterministic ids and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running_sum, sorted_ranges
from .scratch import staged


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace (a UUID's text)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def canonical_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of a canonical text: the fields by name, numbers in a fixed format, nulls as null."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("null"))) for name, c in sorted(fields.items())]
    return F.sha2(F.concat_ws(";", *parts).cast("binary"), 256)


def fixed(c: Column, places: int = 6) -> Column:
    """A number as text with so many places, the same in every engine."""
    return F.format_string(f"%.{places}f", c.cast("double"))


def digest_tree(df: DataFrame, keys: list[str], value: str, fanout: int = 1000) -> DataFrame:
    """Rows (*keys, digest, n): one digest for the values of each key, in order, and how many they are.

    Every `fanout` consecutive values, joined by commas, have a digest, every `fanout` of these again, until
    one is left; so no list is longer than that, and how rows are laid out doesn't matter.
    """
    rows = sorted_ranges(df.select(*keys, F.col(value).cast("string").alias("__v")), [*keys, "__v"], "__id", "digest-values")
    level = running_sum(rows, keys, "__id", F.lit(1), "__i").select(*keys, (F.col("__i") - 1).alias("__i"), "__v", F.lit(1).cast("long").alias("n"))
    done = None
    while True:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda r: r["__v"])
        level = level.groupBy(*keys, F.expr(f"__i div {fanout}").alias("__i")).agg(F.sha2(F.array_join(ordered, ",").cast("binary"), 256).alias("__v"), F.sum("n").alias("n"))
        level = staged(level.select(*keys, "__i", "__v", "n"), "digests")
        more = [F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)]
        many, same = level.filter("__i = 1").select(*more), F.lit(True)
        for j, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{j}"))
        alone = level.join(many, same, "left_anti").select(*keys, F.col("__v").alias("digest"), "n")
        done = alone if done is None else done.unionByName(alone)
        if many.isEmpty():
            return done
        level = level.join(many, same, "left_semi")
