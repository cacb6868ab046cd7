"""Running values over groups of any size, by sorted ranges instead of one window for each group.

`sorted_ranges` sorts a table once into ranges of like size and numbers its rows in order, so
that a later step knows a row's range and its place from one column. A value that runs along a
group is taken within each range, and what the ranges before hold of the group is added: that
concerns only groups that go over an edge of a range, at most one for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

#: The number of a row's range within its id, as monotonically_increasing_id has it.
RANGE_BIT = 33


def sorted_ranges(df: DataFrame, order: list[str], row_id: str, name: str) -> DataFrame:
    """df, written in ranges sorted by `order`, with row_id, which rises in that order.

    A random salt is the last of the order, so equal rows may lie in several ranges.
    """
    salted = df.withColumn("__salt", F.rand(17))
    ranged = salted.repartitionByRange(*order, "__salt").sortWithinPartitions(*order, "__salt").drop("__salt")
    return staged(ranged.withColumn(row_id, F.monotonically_increasing_id()), name)


def _range(row_id: str) -> Column:
    return F.shiftright(row_id, RANGE_BIT)


def _edges(df: DataFrame, group: list[str], row_id: str, summed: Column, over: Column) -> DataFrame:
    """Rows (*group as __g0..., __range, __edge) of groups that lie in several ranges: `over`, an expression over
    the column __s, of what `summed` gives for each range of the group."""
    parts = df.groupBy(*group, _range(row_id).alias("__range")).agg(summed.alias("__s"))
    parts = parts.withColumn("__ranges", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    parts = parts.filter("__ranges > 1").withColumn("__edge", over)
    return parts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__range").alias("__of"), "__edge")


def _with_edges(df: DataFrame, group: list[str], row_id: str, edges: DataFrame) -> DataFrame:
    # At most two rows for each range: its first and its last group.
    same = _range(row_id) == F.col("__of")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return df.join(F.broadcast(edges), same, "left").drop("__of", *[f"__g{i}" for i in range(len(group))])


def running_sum(df: DataFrame, group: list[str], row_id: str, value: Column, name: str) -> DataFrame:
    """df of sorted_ranges with the sum of `value` over the rows of the group up to each row."""
    before = F.sum("__s").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    edges = _edges(df.withColumn("__v", value), group, row_id, F.sum("__v"), before)
    inner = Window.partitionBy(*group, "__in").orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("__in", _range(row_id)).withColumn(name, F.sum(value).over(inner)).drop("__in")
    return _with_edges(own, group, row_id, edges).withColumn(name, F.col(name) + F.coalesce("__edge", F.lit(0))).drop("__edge")


def previous(df: DataFrame, group: list[str], row_id: str, value: str, name: str) -> DataFrame:
    """df of sorted_ranges with the value of the row before in the group, null on its first row."""
    before = F.lag("__s").over(Window.partitionBy(*group).orderBy("__range"))
    edges = _edges(df, group, row_id, F.max_by(value, row_id), before)
    own = df.withColumn("__in", _range(row_id)).withColumn(name, F.lag(value).over(Window.partitionBy(*group, "__in").orderBy(row_id))).drop("__in")
    return _with_edges(own, group, row_id, edges).withColumn(name, F.coalesce(name, "__edge")).drop("__edge")


def following(df: DataFrame, group: list[str], row_id: str, value: Column, name: str) -> DataFrame:
    """df of sorted_ranges with the first value of a later row of the group that isn't null, or null."""
    back = Window.partitionBy(*group).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col(row_id)))
    edges = _edges(df.withColumn("__v", value), group, row_id, first, F.last("__s", ignorenulls=True).over(back))
    later = Window.partitionBy(*group, "__in").orderBy(F.desc(row_id)).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("__in", _range(row_id)).withColumn(name, F.last(value, ignorenulls=True).over(later)).drop("__in")
    return _with_edges(own, group, row_id, edges).withColumn(name, F.coalesce(name, "__edge")).drop("__edge")


def reached(first: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (id): the ids of `first` and all that links (id, nxt), at most one for each id, lead to from them.

    Links double with each round, so a chain of n ids takes log2(n) rounds. Very many links to one id
    are the skewed side of a join whose other side has a row for it, which adaptive execution splits.
    """
    found, jumps = staged(first.select("id"), "reached"), staged(links.select("id", "nxt"), "jumps")
    while True:
        new = staged(found.join(jumps, "id").select(F.col("nxt").alias("id")), "reached")
        if new.isEmpty():
            return found
        found = staged(found.unionByName(new), "reached")
        on = jumps.select(F.col("id").alias("nxt"), F.col("nxt").alias("__far"))
        jumps = staged(jumps.join(on, "nxt").select("id", F.col("__far").alias("nxt")), "jumps")
