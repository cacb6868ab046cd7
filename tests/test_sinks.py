"""Stores that are written again and again."""

import datetime
import hashlib
import random

from pyspark.sql import functions as F

from tidewatch.functions import identity
from tidewatch.sources import sinks
from tidewatch.sources.keyed import KeyedStore


def key(i):
    return hashlib.md5(str(i).encode()).hexdigest()


def test_a_keyed_store_reads_only_buckets_that_may_hold_its_keys(spark, tmp_path):
    fields = "id string, n long"
    frame = lambda ids: spark.createDataFrame([(None if i is None else key(i), i) for i in ids], fields)
    store = KeyedStore(spark, str(tmp_path / "s"), frame([]).schema, "id", buckets=16, words=1)
    assert store.read().count() == 0 and store.matching(frame([1])).count() == 0
    store.append(frame([*range(2000), 5, 5, None]))
    # New keys hardly ever look like stored ones, so their buckets aren't read.
    assert store.perhaps(frame(range(10_000, 10_200))).count() <= 4
    one = store.matching(frame([77, 10_001]))
    files = {r[0] for r in one.select(F.input_file_name()).collect()}
    assert one.filter(F.col("id") == key(77)).count() == 1 and 1 <= len(files) <= 2 and len({r[0] for r in store.read().select(F.input_file_name()).collect()}) == 16
    assert {r.id for r in store.perhaps(frame(range(2000))).collect()} == {key(i) for i in range(2000)}
    r = random.Random(1)
    held = set(range(2000))
    for _ in range(2):
        batch = [r.randrange(4000) for _ in range(500)]
        store.append(frame(batch))
        held |= set(batch)
    got = [(x.id, x.n) for x in store.read().collect()]
    assert sorted(x for x in got if x[0]) == sorted((key(i), i) for i in held) and got.count((None, None)) == 1
    store.append(frame(batch))
    assert store.read().count() == len(got)


def files_of(path):
    return {p.name for p in path.rglob("*.parquet")}


def test_retention_drops_days_and_leaves_younger_files_alone(spark, tmp_path):
    path = tmp_path / "snapshots"
    rows = [(f"c{i % 3}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=5 * i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "cohort string, checked_at timestamp, n long")
    sinks.append_by_day(df.filter("n < 40"), str(path), "checked_at")
    sinks.append_by_day(df.filter("n >= 40"), str(path), "checked_at")
    cut = datetime.datetime(2024, 1, 5, 12)
    young = {d.name: files_of(d) for d in path.iterdir() if d.name.startswith("day=") and d.name > "day=2024-01-05"}
    sinks.retain(spark, str(path), "checked_at", cut)
    assert sorted(r.n for r in spark.read.parquet(str(path)).collect()) == [n for _, t, n in rows if t >= cut]
    left = {d.name: files_of(d) for d in path.iterdir() if d.name.startswith("day=")}
    assert min(left) == "day=2024-01-05" and {k: v for k, v in left.items() if k > "day=2024-01-05"} == young and len(young) >= 7
    again = files_of(path)
    sinks.retain(spark, str(path), "checked_at", datetime.datetime(2024, 1, 5))  # a day's start: nothing to rewrite
    assert files_of(path) == again
    sinks.retain(spark, str(path), "checked_at", datetime.datetime(2025, 1, 1))
    assert not files_of(path)


def test_digest_trees_depend_on_order_alone(spark):
    def plain(values, fanout):
        level = [hashlib.sha256(",".join(values[i : i + fanout]).encode()).hexdigest() for i in range(0, len(values), fanout)]
        while len(level) > 1:
            level = [hashlib.sha256(",".join(level[i : i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
        return level[0]

    rows = [("a", f"{i:05}") for i in range(137)] + [("b", "x")] + [(None, f"n{i:03}") for i in range(9)]
    want = {k: (plain(sorted(v for x, v in rows if x == k), 4), sum(x == k for x, _ in rows)) for k in ("a", "b", None)}
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1], "k string, v string").repartition(parts)
        got = {r.k: (r.digest, r.n) for r in identity.digest_tree(df, ["k"], "v", 4).collect()}
        assert got == want
