"""Rules over alerts and jobs on rows known by hand, with columns of other names than the queries'."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as A
from tidewatch.operators import dashboard, lifecycle

T = datetime.datetime(2024, 5, 1, 12)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_targets(spark):
    got = values(spark, [("calm",), ("flood",), (None,)], "kind string", *A.targets(F.col("kind"), ["calm"]))
    assert got == [("normal", None), ("attack", "flood"), ("attack", None)]


@pytest.mark.parametrize("n", [0, 4])
def test_recent_and_newest(spark, n):
    rows = [(i, T - datetime.timedelta(days=d), sev, st) for i, d, sev, st in [(1, 0, "low", "open"), (2, 6, "high", "open"), (3, 8, "high", "open"), (4, 0, "critical", "resolved")]]
    df = spark.createDataFrame(rows[:n], "id int, at timestamp_ntz, sev string, st string")
    # The window ends with the newest row of all, whether it meets the condition or not.
    got = A.recent(df, "at", "7 days", A.elevated_and_open(F.col("sev"), F.col("st")))
    assert got.columns == df.columns and [r.id for r in got.collect()] == ([2] if n else [])
    assert [r.id for r in A.newest(df, F.lit(True), "at", "id", 2).collect()] == ([4, 1] if n else [])


def test_statuses(spark):
    got = values(spark, [(T, 0), (None, 2), (None, 0), (None, None)], "sent timestamp_ntz, tries int", A.delivery_status(F.col("sent"), F.col("tries")))
    assert [x for x, in got] == ["published", "failed", "pending", "pending"]
    jobs = [("succeeded", 3), ("dead_letter", 9), ("queued", 1), ("queued", 0)]
    assert [x for x, in values(spark, jobs, "s string, n int", A.display_status(F.col("s"), F.col("n")))] == ["done", "failed", "retrying", "waiting"]


def test_unified(spark):
    rows = [("scan", "dos", 0.5, None, T), (None, "dos", 0.5, T, None)]
    columns = A.unified(F.col("sig").isNotNull(), F.col("sig"), F.col("family"), F.col("p"), F.col("seen"), F.col("made"))
    got = values(spark, rows, "sig string, family string, p double, seen timestamp_ntz, made timestamp_ntz", *columns)
    assert got == [("sensor", "scan", None, T), ("model", "dos", 0.5, T)]


def test_reasons_endpoints_and_keys(spark):
    rows = [("a", None, "10.0.0.1", 80), (None, None, None, 80), (None, "b", None, None)]
    schema = "u string, v string, ip string, port int"
    reasons = A.profile_reasons(F.col("u"), F.col("v"))
    assert values(spark, rows, schema, reasons, A.endpoint(F.col("port"), F.col("ip"))) == [(["a"], "10.0.0.1"), ([], "port 80"), (["b"], "unknown")]
    one, other = A.canonical_key(b=F.col("u"), a=F.col("v")), A.canonical_key(a=F.col("v"), b=F.col("u"))
    for (x, y), (u, v, *_) in zip(values(spark, rows, schema, one, other), rows):
        assert x == y == json.dumps({"a": v, "b": u}, separators=(",", ":"))


def test_failures_and_routing(spark):
    rows = [("DATABASE gone; validation failed",), ("the Extractor changed",), ("boom",), (None,)]
    want = [("validation_error", False), ("extractor_incompatible", False), ("processing_error", True), ("processing_error", True)]
    assert values(spark, rows, "said string", *A.failure(F.col("said"))) == want
    rows = [(True, 0), (True, 1), (True, 2), (True, 3), (True, 4), (False, 1), (None, 1)]
    got = values(spark, [(*r, T) for r in rows], "again boolean, n int, at timestamp_ntz", *A.routing(F.col("again"), F.col("n"), F.col("at")))
    assert got == [("retry", T + datetime.timedelta(seconds=s)) for s in (1, 1, 5, 30)] + [("dead_letter", None)] * 3
    # More tries than waits: the last wait holds.
    later = values(spark, [(True, 5, T)], "again boolean, n int, at timestamp_ntz", *A.routing(F.col("again"), F.col("n"), F.col("at"), most=9))
    assert later == [("retry", T + datetime.timedelta(seconds=30))]


def test_contributions(spark):
    rows = [(1, i, f"f{i}", x) for i, x in enumerate([1.0, -3.0, 3.0, 0.5])] + [(2, 0, None, 2.0)]
    df = spark.createDataFrame(rows, "row int, i int, f string, x double")
    got = {(r.row, r.feature): r.impact for r in A.top_contributions(df, "row", "f", "i", "x", 2).collect()}
    assert got == {(1, "f1"): -3.0, (1, "f2"): 3.0, (1, "Other 2 features"): 1.5, (2, None): 2.0}
    assert A.top_contributions(df.limit(0), "row", "f", "i", "x").count() == 0


def test_attributions(spark):
    df = spark.createDataFrame([(1, "proto_tcp", 0.25), (1, "proto_udp", 0.5), (1, "port", -2.0), (2, "port", 1.0)], "row int, f string, x double")
    out = spark.createDataFrame([(1, -1.25), (2, 1.1)], "row int, y double")
    got = A.folded_attributions(df, out, "row", F.regexp_replace("f", "_.*$", ""), "x", "y").orderBy("row", "rank").collect()
    assert [tuple(r) for r in got] == [(1, "port", -2.0, 1, True), (1, "proto", 0.75, 2, True), (2, "port", 1.0, 1, False)]


def test_rollups(spark):
    rows = [(1, "open", "critical", "a", "b", "x"), (2, "resolved", "critical", "a", None, "y"), (3, "false_positive", "low", None, "b", "y"), (4, "open", "low", "c", "c", "x")]
    df = spark.createDataFrame(rows, "id int, st string, sev string, src string, dst string, fam string")
    assert tuple(dashboard.open_counts(df, "st", "sev").first()) == (4, 2, 1)
    assert tuple(dashboard.review(df, "st").first()) == (1, 1, 0.5)
    assert tuple(dashboard.overview(df, "src", "dst", "fam").first()) == (3, "x")
    assert tuple(dashboard.truth_rates(df, F.col("id") <= 2, F.col("id") % 2 == 1).first()) == (0.5, 0.5, 0.5)
    none = df.limit(0)
    assert tuple(dashboard.review(none, "st").first()) == (0, 0, None)
    assert tuple(dashboard.overview(none, "src", "dst", "fam").first()) == (0, None)
    assert tuple(dashboard.truth_rates(none, F.col("id") < 2, F.col("id") < 2).first()) == (None, None, None)


def test_latencies(spark):
    rows = [("a", T - datetime.timedelta(hours=h), float(h)) for h in (0, 10, 24, 30)] + [(None, T, 7.0), ("b", T, None)]
    df = spark.createDataFrame(rows, "kind string, at timestamp_ntz, ms double")
    got = {r.kind: (r.n, r["mean"], r.q and list(r.q)) for r in dashboard.latencies(df, ["kind"], "ms", [0.5]).collect()}
    assert got == {"a": (4, 16.0, [17.0]), None: (1, 7.0, [7.0]), "b": (1, None, None)}
    # Half open: what is a whole day old isn't of the last day.
    assert dashboard.lately(df, "at", "24 hours").filter("kind = 'a'").count() == 2
    assert dashboard.latencies(df, [], "ms", [0.5]).first().n == 6


def test_routes_and_feedback(spark):
    df = spark.createDataFrame([(1, "v0", None), (2, "v0", "p"), (3, "v1", "p"), (4, "v1", None)], "id int, s string, f string")
    routes = spark.createDataFrame([("v0", None, "rt"), ("v1", "p", "native")], "schema string, fingerprint string, route string")
    got = [tuple(r) for r in lifecycle.routed(df, routes, "s", "f", "v0").orderBy("id").select("id", "route", "error_code").collect()]
    assert got == [(1, "rt", None), (2, None, "fingerprint_not_allowed"), (3, "native", None), (4, None, "extractor_not_approved")]
    said = spark.createDataFrame([(1, "resolved", 2), (1, "open", 1)], "id int, to string, n int")
    told = lifecycle.with_feedback(df.select("id", "s"), said, "id", "to", ["n"], "s").orderBy("id").collect()
    assert [tuple(r) for r in told][:2] == [(1, "resolved", 2), (2, "v0", 0)]
