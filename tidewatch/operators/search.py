"""Filters, slices and pages of alerts, jobs and replayed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def scenario(label: Column, name: str, normal) -> Column:
    """The rows of a scenario: all, normal, attack or class:<exact label>."""
    if name == "all":
        return F.lit(True)
    if name in ("normal", "attack"):
        return label.isin(*normal) if name == "normal" else ~label.isin(*normal)
    if name.startswith("class:") and len(name) > 6:
        return label == name[6:]
    raise ValueError(f"unknown scenario: {name}")


def row_slice(df: DataFrame, index: str, condition: Column, offset: int, limit: int) -> DataFrame:
    """The first `limit` rows that match, from row `offset` of all rows on, matching or not."""
    return df.filter(F.col(index) >= offset).filter(condition).orderBy(index).limit(limit)


def between(ts: str, start, end) -> Column:
    """Half open; an empty or backward interval is an error."""
    if start is not None and end is not None and start >= end:
        raise ValueError("the interval must start before it ends")
    parts = [F.col(ts) >= F.lit(start)] * (start is not None) + [F.col(ts) < F.lit(end)] * (end is not None)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def text_search(columns: list[Column], q: str) -> Column:
    """Whether any column holds q, whatever the case; q is literal, so % and _ are too."""
    return any_of(F.coalesce(F.lower(c.cast("string")).contains(q.lower()), F.lit(False)) for c in columns)


def offset_page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with `total` and `has_more`; the count runs over the filter alone, without the order."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def keyset_page(df: DataFrame, ts: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """The page after (ts, key), newest first, one row more than `limit` being looked for.

    `more` tells whether there is a next page, `cursor` is what to ask it with.
    """
    if after:
        t, k = (F.lit(x) for x in after)
        df = df.filter((F.col(ts) < t) | (F.col(ts) == t) & (F.col(key) < k))
    probe = df.orderBy(F.desc(ts), F.desc(key)).limit(limit + 1)
    # limit + 1 rows at most from here on.
    n = probe.agg(F.count(F.lit(1)).alias("__n"))
    cursor = F.base64(F.concat_ws("|", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col(key).cast("string")).cast("binary"))
    page = probe.orderBy(F.desc(ts), F.desc(key)).limit(limit).crossJoin(F.broadcast(n))
    return page.withColumn("more", F.col("__n") > limit).withColumn("cursor", cursor).drop("__n")


def top_by_magnitude(values: dict[str, Column], k: int = 5) -> Column:
    """Array of the k (name, value) of greatest magnitude; nulls count as 0, ties by the order given."""
    rows = [F.struct((-F.abs(F.coalesce(c.cast("double"), F.lit(0.0)))).alias("m"), F.lit(i).alias("i"), F.lit(n).alias("name"), c.cast("double").alias("value")) for i, (n, c) in enumerate(values.items())]
    return F.transform(F.slice(F.array_sort(F.array(*rows)), 1, k), lambda r: F.struct(r["name"].alias("name"), r["value"].alias("value")))
