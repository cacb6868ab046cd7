"""Statistics of distributions as column expressions and small aggregates."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, keys: list[str], value: str, name: str = "n") -> DataFrame:
    """Rows (*keys, value, name): how often each value came, nulls left out. Rows that have a column
    of that name are counts themselves, and are added up."""
    n = F.sum(name) if name in df.columns else F.count(F.lit(1))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias(name))


def running_counts(counts: DataFrame, keys: list[str], value: str, sums: list[str], falling: bool = False) -> DataFrame:
    """counts with <sum>_upto, the running sum in the order of the values, and <sum>_all for each of `sums`.

    Running sums are taken within buckets of near values, 256 to a doubling, and added to
    those of the buckets before, so no task sorts all values of a key.
    """
    x = F.col(value).cast("double")
    scale = F.floor(F.log2(F.greatest(F.abs(x), F.lit(1e-300))) * 256) + 300_000
    bucket = F.when(x > 0, scale).when(x < 0, -scale).otherwise(0) * (-1 if falling else 1)
    c, names = counts.withColumn("__b", bucket), [f"__k{i}" for i in range(len(keys))]
    sizes = c.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__b").alias("__c")).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    whole = Window.partitionBy(*(names or [F.lit(0)]))
    before = whole.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*names, "__c", *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"{s}_before") for s in sums], *[F.sum(f"__{s}").over(whole).alias(f"{s}_all") for s in sums])
    on = F.col("__b") == F.col("__c")
    for k, n in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    run = Window.partitionBy(*keys, "__b").orderBy(F.desc(value) if falling else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({f"{s}_in": F.sum(s).over(run) for s in sums}).join(sizes, on)
    c = c.withColumns({f"{s}_upto": F.col(f"{s}_in") + F.col(f"{s}_before") for s in sums})
    return c.drop("__b", "__c", *names, *[f"{s}_{x}" for s in sums for x in ("in", "before")])


def quantiles(counts: DataFrame, keys: list[str], value: str, levels: list[float], name: str = "q", n: str = "n") -> DataFrame:
    """Rows (*keys, name): the exact quantiles of counted values, an array by level, linear between ranks."""
    c = running_counts(counts, keys, value, [n])
    upto, below, every, x = F.col(f"{n}_upto"), F.col(f"{n}_upto") - F.col(n), F.col(f"{n}_all"), F.col(value).cast("double")
    at = lambda rank: F.max(F.when((below <= rank) & (rank < upto), x))
    places = [F.lit(float(q)) * (every - 1) for q in levels]
    # Few values lie at a rank that is asked for; all others go before the aggregates are taken.
    wanted = reduce(or_, [(below <= F.ceil(p)) & (upto > F.floor(p)) for p in places])
    c = c.filter(wanted)
    aggs = [a.alias(f"__{s}{i}") for i, p in enumerate(places) for s, a in (("l", at(F.floor(p))), ("h", at(F.ceil(p))), ("p", F.max(p)))]
    found = c.groupBy(*keys).agg(*aggs)
    lo, hi, p = (lambda i, s=s: F.col(f"__{s}{i}") for s in "lhp")
    mid = lambda i: F.when(lo(i) == hi(i), lo(i)).otherwise((F.ceil(p(i)) - p(i)) * lo(i) + (p(i) - F.floor(p(i))) * hi(i))
    return found.select(*keys, F.array(*[mid(i) for i in range(len(levels))]).alias(name))


def bin_of(x: Column, e: Column) -> Column:
    """0 below the first edge, size(e) above the last one, which belongs to the last bin."""
    return F.when(x == F.element_at(e, -1), F.size(e) - 1).otherwise(F.size(F.filter(e, lambda v: v <= x)))


def smoothed(count: Column, *group: str) -> Column:
    """Additive-half probabilities within a group."""
    return (count + 0.5) / F.sum(count + 0.5).over(Window.partitionBy(*group))


def js_distance(p: Column, q: Column) -> Column:
    """Aggregate: the square root of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    part = lambda a: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), F.sum(part(p) + part(q)) / 2))


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """The asymptotic two-sided p-value of a two-sample statistic."""
    x = d * F.sqrt(n * m / (n + m))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1).otherwise(-1) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def ks_statistic(df: DataFrame, group: list[str], value: str, side: str, n: str) -> DataFrame:
    """Rows (*group, n_ref, n_cur, ks): the greatest distance of the two distribution functions of
    counted values, `n` of each.

    `side` is 0 for the reference and 1 for the current sample. Running sums go over the
    distinct values of a group, by buckets.
    """
    of = lambda k: F.sum(F.when(F.col(side) == k, F.col(n)).otherwise(0))
    c = running_counts(df.groupBy(*group, value).agg(of(0).alias("a"), of(1).alias("b")), group, value, ["a", "b"])
    gap = F.abs(F.col("a_upto") / F.col("a_all") - F.col("b_upto") / F.col("b_all"))
    both = (F.col("a_all") > 0) & (F.col("b_all") > 0)
    out = c.groupBy(*group).agg(F.first("a_all").alias("n_ref"), F.first("b_all").alias("n_cur"), F.max(F.when(both, gap)).alias("ks"))
    return out.withColumn("ks", F.coalesce("ks", F.lit(0.0)))


def slots(sample: DataFrame):
    """A function of (feature, x) that tells where x lies among the sorted values of a stored sample
    (feature, x): 2 i + 1 on the i-th distinct value, 2 i below it.

    The reference's distribution function is flat between its values, so the greatest
    distance to another one is found on its values or just below: slots may stand for the
    values of any sample, of any size. A stored sample is bounded, and sent along.
    """
    own = {name: np.unique(v.to_numpy()) for name, v in sample.toPandas().groupby("feature")["x"]}

    @F.pandas_udf("long")
    def slot(feature: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int64)
        v, (code, names) = x.to_numpy(), pd.factorize(feature)
        for j, name in enumerate(names):
            at, known = np.flatnonzero(code == j), own.get(name, np.zeros(0))
            i = np.searchsorted(known, v[at])
            hit = np.zeros(len(at), bool) if not len(known) else known[np.minimum(i, len(known) - 1)] == v[at]
            out[at] = 2 * i + hit
        return pd.Series(out)

    return slot


def benjamini_hochberg(df: DataFrame, p: str, group: list[str], tiebreak: str, name: str = "q") -> DataFrame:
    """df with the q-value of p within its group (of tests, which are few)."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(p, tiebreak))).withColumn("__m", F.count(F.lit(1)).over(w))
    raw = F.col(p) * F.col("__m") / F.col("__r")
    q = F.min(raw).over(w.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))).drop("__r", "__m")


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The interval of a share; exactly 0 or 1 where none or all succeed, 0 to 1 without any trial."""
    p, zz = successes / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    none = n == 0
    low = F.when(none | (successes == 0), 0.0).otherwise(F.greatest(F.lit(0.0), mid - half))
    return low, F.when(none | (successes == n), 1.0).otherwise(F.least(F.lit(1.0), mid + half))
