"""Samples and windows that sort only rows that can be in them."""

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import drift


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_those_of_least_digests_and_little_is_sorted(spark):
    long = spark.range(3000).selectExpr("id", "explode(array('a', 'b')) as feature", "cast(id % 700 as double) as x").unionByName(spark.range(5).selectExpr("id", "'rare' as feature", "cast(id as double) as x"))
    got = drift.reference_sample(long, "id", 50)
    rows = {}
    for r in long.collect():
        rows.setdefault(r.feature, []).append((hashlib.md5(f"{r.feature}|{r.id}".encode()).hexdigest(), r.id, r.x))
    assert sorted(map(tuple, got.collect())) == sorted((f, x) for f, v in rows.items() for _, _, x in sorted(v)[:50])
    assert "__upto" in _plan(got)


def test_windows_hold_the_newest_rows_and_little_is_sorted(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, f"c{i % 3}" if i % 7 else None, start + timedelta(hours=i % 400)) for i in range(2400)]
    df = spark.createDataFrame(rows, "id long, cohort string, ts timestamp")
    at = [start + timedelta(days=12), start + timedelta(days=16, hours=5)]
    checks, windows = spark.createDataFrame([(x,) for x in at], "checked_at timestamp"), [("fast", 2, 20, 5), ("slow", 9, 150, 5)]
    got = drift.window_rows(df, "cohort", "ts", "id", checks, windows)
    want = set()
    for x in at:
        for name, days, most, _ in windows:
            for c in ("c0", "c1", "c2", None):
                own = sorted(((t, i) for i, k, t in rows if k == c and x - timedelta(days=days) < t <= x), reverse=True)
                want |= {(name, x, i) for _, i in own[:most]}
    found = [(r.window, r.checked_at, r.id) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert "__since" in _plan(got) and got.columns == [*df.columns, "checked_at", "window", "minimum"]


def test_fitted_numbers_are_counted_once(spark, monkeypatch):
    whole, given = drift.histogram, []
    monkeypatch.setattr(drift, "histogram", lambda long, *a: given.append(long.columns) or whole(long, *a))
    train, held = (spark.range(a, a + 40).selectExpr("cast(id as string) id", "id * 1.0D x", "'k' c", "if(id % 2 = 0, 'attack', 'normal') l", "id / 100.0D s") for a in (0, 40))
    attack = F.col("l") == "attack"
    drift.whole_reference(train, held, "id", ["x"], ["c"], (F.col("l"), F.col("s"), F.when(attack, "a"), F.when(attack, F.col("s"))), 10)
    assert all("n" in columns for columns in given[:2])
