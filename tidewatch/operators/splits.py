"""Leakage-safe splits of rows, groups and times, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = (("train", 0.6), ("validation", 0.8), ("test", 1.0))


def cut(rank: Column, n: Column) -> Column:
    """The part of a row of rank 1..n, by 60/20/20."""
    out = F.lit(PARTS[-1][0])
    for name, upto in reversed(PARTS[:-1]):
        out = F.when(rank <= F.floor(n * upto + 1e-9), name).otherwise(out)
    return out


def digest_order(*parts: Column, seed: int = 42, bits: int = 0) -> Column:
    """Text that sorts rows at random, but always alike."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.sha2(text.cast("binary"), bits) if bits else F.md5(text.cast("binary"))


#: Leading hex digits of a digest that make a bucket.
BUCKET_DIGITS = 3


def ranked_within(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """df with its rank, from 1, within its keys in the order of (bucket, *order), and the number of rows of the keys.

    Rows are ranked within their bucket and the buckets' counts summed up, so no task
    sees more than a bucket of a key.
    """
    b = df.withColumn("__b", bucket)
    names = [f"__k{i}" for i in range(len(keys))]
    sizes = b.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*(names or [F.lit(0)]))
    before = F.sum("__n").over(whole.orderBy(F.asc_nulls_first("__c")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    sizes = sizes.select(*names, "__c", before.alias("__before"), F.sum("__n").over(whole).alias("n_rows"))
    on = F.col("__b").eqNullSafe(F.col("__c"))
    for k, n in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    ranked = b.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))).join(sizes, on)
    return ranked.withColumn(name, F.col("__r") + F.col("__before")).drop("__b", "__c", "__r", "__before", *names)


def by_digest(df: DataFrame, keys: list[str], digest: Column, tie: str, name: str = "rank") -> DataFrame:
    """ranked_within in the order of (digest, tie)."""
    d = df.withColumn("__d", digest)
    return ranked_within(d, keys, F.substring("__d", 1, BUCKET_DIGITS), ["__d", tie], name).drop("__d")


def stratified(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """df with `split`, 60/20/20 within each label, which needs three rows.

    Buckets are counted, and only rows of those that hold an edge of a part, two for a label, are
    ranked; all others know their part from their bucket, where they are.
    """
    d = df.withColumn("__d", digest_order(F.col(key), seed=seed)).withColumn("__b", F.substring("__d", 1, BUCKET_DIGITS))
    sizes = d.groupBy(F.col(label).alias("__k"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.select("__k", "__c", "__n", upto.alias("__upto"), F.sum("__n").over(Window.partitionBy("__k")).alias("n_rows")).filter("n_rows >= 3")
    edge = lambda share: F.min(F.when(F.col("__upto") > F.floor(F.col("n_rows") * share + 1e-9), F.struct("__c", (F.col("__upto") - F.col("__n")).alias("__before"))))
    (first, second), last = PARTS[:-1], PARTS[-1][0]
    edges = sizes.groupBy("__k", "n_rows").agg(edge(first[1]).alias("__e0"), edge(second[1]).alias("__e1"))
    # A row for each label, of which there are few.
    placed = d.join(F.broadcast(edges), F.col(label).eqNullSafe(F.col("__k")))
    b, e0, e1 = F.col("__b"), F.col("__e0.__c"), F.col("__e1.__c")
    ranked = placed.filter((b == e0) | (b == e1))
    rank = F.row_number().over(Window.partitionBy("__k", "__b").orderBy("__d", key)) + F.when(b == e0, F.col("__e0.__before")).otherwise(F.col("__e1.__before"))
    names = [F.col(f"`{c}`") for c in df.columns]
    ranked = ranked.withColumn("__rank", rank).select(*names, cut(F.col("__rank"), F.col("n_rows")).alias("split"))
    sure = placed.filter((b != e0) & (b != e1)).select(*names, F.when(b < e0, first[0]).when(b < e1, second[0]).otherwise(last).alias("split"))
    return sure.unionByName(ranked)


def grouped(df: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """df with `split`, whole groups going to one part; the groups alone are ranked."""
    g = df.select(F.col(group).alias("__g")).distinct()
    ranked = by_digest(g, [], digest_order(F.col("__g"), seed=seed), "__g", "__rank")
    ranked = ranked.select("__g", cut(F.col("__rank"), F.col("n_rows")).alias("split"))
    return df.join(ranked, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


#: Groups that a split by group needs, one for each part.
LEAST_GROUPS = len(PARTS)


def realistic(df: DataFrame, groups: list[str], ts: str | None, order: list[str], seed: int = 42) -> tuple[DataFrame | None, dict]:
    """(df with `split`, how): whole groups to one part by the first column of `groups` that df has, else by
    time. Without either, or with fewer groups than parts, there is no split, and `how` has the reason."""
    column = next((c for c in groups if c in df.columns), None)
    if column is not None:
        # A few groups tell that there are enough.
        if df.select(F.coalesce(F.col(column).cast("string"), F.lit(""))).distinct().limit(LEAST_GROUPS).count() < LEAST_GROUPS:
            return None, {"available": False, "reason": f"group column {column!r} has fewer than {LEAST_GROUPS} groups"}
        return grouped(df, column, seed), {"available": True, "strategy": "group-aware", "column": column}
    if ts is not None and ts in df.columns:
        return temporal(df, ts, order), {"available": True, "strategy": "temporal", "column": ts}
    return None, {"available": False, "reason": "no group or time column"}


def ranked_globally(df: DataFrame, bucket: Column, order: list[str], name: str = "rank") -> DataFrame:
    """ranked_within over all rows."""
    return ranked_within(df, [], bucket, order, name)


def temporal(df: DataFrame, ts: str, order: list[str]) -> DataFrame:
    ranked = ranked_globally(df, F.date_trunc("day", ts), [ts, *order])
    return ranked.withColumn("split", cut(F.col("rank"), F.col("n_rows"))).drop("rank", "n_rows")


def keep_first(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """The first row of each set of rows that agree on `same`."""
    w = Window.partitionBy(*same).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r")


def leaks(df: DataFrame, same: list[str], parts=("train", "validation", "test")) -> DataFrame:
    """Rows (a, b, n_shared): how many distinct rows two parts have in common."""
    seen = df.groupBy(*same).agg(*[F.bool_or(F.col("split") == p).alias(p) for p in parts])
    pairs = [(a, b) for i, a in enumerate(parts) for b in parts[i + 1 :]]
    counts = seen.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}-{b}") for a, b in pairs])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}-{b}").alias("n_shared")) for a, b in pairs])).alias("x"))
    return long.select("x.*")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """df with `weight`: rows over classes times rows of the class. There are few classes."""
    n = df.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    one = Window.partitionBy(F.lit(0))
    n = n.withColumn("weight", F.sum("__n").over(one) / (F.count(F.lit(1)).over(one) * F.col("__n"))).drop("__n")
    return df.join(F.broadcast(n), F.col(label) == F.col("__l")).drop("__l")
