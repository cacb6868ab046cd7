"""Operators on small fixtures whose results are known by hand."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions import distributions as S
from tidewatch.functions import identity
from tidewatch.functions import ranges
from tidewatch.operators import dashboard, drift, evidence, flows, lifecycle, metrics, quality, search, severity, splits
from tidewatch.sources import sinks, tables

PACKET = "flow string, t long, seq long, direction int, payload long, ip_size long, window long, protocol int, src_port int, dst_port int, application string, " + ", ".join(f"{x} boolean" for x in flows.FLAGS)


def packets(spark, specs):
    """specs: flow -> (protocol, src, dst, application, [(ms, direction, payload, ip_size, flags, window)])."""
    rows = []
    for name, (proto, src, dst, app, ps) in specs.items():
        rows += [(name, ms * 1000, i, d, pay, size, win, proto, src, dst, app, *[f in fl for f in flows.FLAGS]) for i, (ms, d, pay, size, fl, win) in enumerate(ps)]
    return spark.createDataFrame(rows, PACKET)


@pytest.fixture(scope="module")
def features(spark):
    specs = {
        "handshake": (6, 41000, 443, "TLS", [(1000, 0, 0, 40, {"syn"}, 64240), (1010, 1, 0, 40, {"syn", "ack"}, 65535), (1020, 0, 12, 52, {"ack", "psh"}, 64000)]),
        "scan": (6, 55000, 22, "Unknown", [(6000, 0, 0, 40, {"fin"}, 512), (8000, 0, 0, 40, {"rst"}, 0), (14000, 0, 0, 40, {"syn"}, 512)]),
        "flood": (6, 54000, 80, "HTTP", [(5000 + i, 0, 0, 40, {"syn"}, 1024) for i in range(4)]),
        "other": (17, 51000, 9999, "Unknown", [(2000, 0, 20, 48, set(), 0), (2025, 1, 8, 36, set(), 0)]),
        "bulk": (6, 1, 2, None, [(i * 100, 0, 10, 50, set(), 5) for i in range(5)]),
    }
    f = flows.flow_features(packets(spark, specs))
    assert f.columns == ["flow", *schema.COLUMNS]
    return {r.flow: r for r in flows.violations(f).collect()}


def test_the_schema_has_83_features():
    assert len(schema.FEATURES) == 83 == len(set(schema.FEATURES)) and len(schema.NUMERIC) == 81
    assert schema.FEATURES[:4] == ("id.orig_p", "id.resp_p", "proto", "service") and schema.FEATURES[-1] == "fwd_last_window_size"


def test_flow_features(features):
    h, s, f, o, b = (features[x] for x in ("handshake", "scan", "flood", "other", "bulk"))
    assert (h.flow_duration, h.flow_iat__tot, h.fwd_init_window_size, h.bwd_init_window_size, h.fwd_last_window_size, h.service) == (0.02, 20_000, 64240, 65535, 64000, "ssl")
    assert (s.active__min, s.active__max, s.idle__tot, s.fwd_subflow_pkts, s.service) == (0, 2e6, 6e6, 1.0, "ssh")
    assert (f.flow_SYN_flag_count, f.down_up_ratio, f.fwd_bulk_packets) == (4, 0, 0) and f.fwd_pkts_per_sec == pytest.approx(4 / 0.003)
    assert (o.service, o.proto, o.fwd_init_window_size, o.down_up_ratio) == ("-", "udp", 0, 1)
    assert (b.fwd_bulk_packets, b.fwd_bulk_bytes) == (5, 50) and b.fwd_bulk_rate == pytest.approx(50 / 0.4)
    assert all(not r.violations for r in features.values())


def test_assembly_cuts_idle_and_active(spark):
    t = [0, 5, 9, 30, 35, 41, 47, 53, 59, 65, 71]
    p = spark.createDataFrame([(k, x, i) for k in "ab" for i, x in enumerate(t)], "key string, t long, seq long")
    got = [r.flow_no for r in flows.assemble(p, ["key"], 10, 25).orderBy("key", "t").collect()]
    want, start, last, n = [], 0, 0, 0
    for x in t:
        if x - last > 10 or x - start > 25:
            n, start = n + 1, x
        want.append(n)
        last = x
    assert got == want * 2


def test_uuid5(spark):
    ns = uuid.NAMESPACE_DNS
    names = ["", "example.org", "é|1|2"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(identity.uuid5(str(ns), F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(ns, n)) for n in names]


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([(0, "a", 0.04), (0, "b", 0.001), (0, "c", 0.03)], "g int, f string, p double")
    assert {r.f: round(r.q, 6) for r in S.benjamini_hochberg(p, "p", ["g"], "f").collect()} == {"a": 0.04, "b": 0.003, "c": 0.04}


def test_numeric_and_categorical_drift(spark):
    ref = spark.createDataFrame([("x", float(i)) for i in range(10)], "feature string, x double")
    cur = spark.createDataFrame([(1, "x", 100.0 + i) for i in range(10)] + [(2, "x", float(i)) for i in range(10)], "w int, feature string, x double")
    r = {x.w: x for x in drift.numeric_drift(drift.numeric_reference(ref, bins=3), ref, ref, cur, ["w"]).collect()}
    assert r[1].exceed_rate == 1 and r[1].p < 0.01 and r[1].js > r[2].js and (r[2].ks, r[2].p, r[2].exceed_rate) == (0, 1, 0)
    vocabulary = spark.createDataFrame([("proto", "tcp", 5), ("proto", "udp", 5)], "feature string, x string, n_ref long")
    now = spark.createDataFrame([(1, "proto", "tcp"), (1, "proto", "icmp"), (1, "proto", "icmp")], "w int, feature string, x string")
    c = drift.categorical_drift(vocabulary, now, ["w"]).first()
    assert (c.n_unseen, c.unseen) == (2, "icmp:2") and c.unseen_rate == pytest.approx(2 / 3)


def test_edges_of_one_value(spark):
    e = drift.numeric_reference(spark.createDataFrame([("x", 3.0)] * 4, "feature string, x double")).first().edges
    assert len(e) == 2 and e[0] < 3 < e[1]


def test_null_thresholds_shrink_with_the_window(spark):
    h = spark.createDataFrame([("x", i, 500) for i in range(10)] + [("y", 0, 1)], "feature string, bin int, n long")
    small, large = ({r.feature: r.threshold for r in drift.null_thresholds(h, n).collect()} for n in (50, 2000))
    assert 0 < large["x"] < small["x"] < 1 and small["y"] == 1
    assert drift.null_rate_threshold(500, 5000, 1000) < drift.null_rate_threshold(500, 5000, 50)


def test_three_alarms_escalate(spark):
    rows = [("c", i, a) for i, a in enumerate([True, True, True, False, True, True, True, True])]
    df = spark.createDataFrame(rows, "k string, i int, alarm boolean")
    assert [r[0] for r in df.orderBy("i").select(drift.escalated(df, "alarm", ["k"], ["i"])).collect()] == [False, False, True, False, False, False, True, True]


def test_metrics_against_plain_python(spark):
    r = random.Random(1)
    pairs = [(r.choice("abc"), r.choice("abcd")) for _ in range(500)]
    df = spark.createDataFrame(pairs, "t string, p string")
    s = metrics.summary(metrics.per_class(metrics.confusion(df, "t", "p"))).first()
    assert s.accuracy == pytest.approx(sum(a == b for a, b in pairs) / 500)
    f1 = []
    for c in "abcd":
        tp, said, true = sum(a == b == c for a, b in pairs), sum(b == c for _, b in pairs), sum(a == c for a, _ in pairs)
        f1.append(2 * tp / (said + true) if said + true else 0)
    assert s.macro_f1 == pytest.approx(sum(f1) / 4)


def test_wilson_ends(spark):
    low, high = S.wilson(F.col("s"), F.col("n"))
    got = spark.createDataFrame([(0, 10), (10, 10), (0, 0), (5, 10)], "s long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert (got[0].l, got[1].h, got[2].l, got[2].h) == (0, 1, 0, 1) and got[3].l == pytest.approx(0.2366, abs=1e-4)


def test_threshold_sweep_against_plain_python(spark):
    r = random.Random(3)
    rows = [(r.randrange(101) / 100, r.random() < 0.4) for _ in range(300)]
    for x in metrics.threshold_sweep(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y")).collect():
        said = [(s, y) for s, y in rows if s >= x.threshold - 1e-12]
        assert x.alert_rate == pytest.approx(len(said) / 300) and x.recall == pytest.approx(sum(y for _, y in said) / sum(y for _, y in rows))


def test_average_precision_without_positives_is_left_out(spark):
    df = spark.createDataFrame([("a", 0.9, True), ("a", 0.8, False), ("a", 0.8, True), ("b", 0.5, False)], "k string, s double, y boolean")
    ap = metrics.average_precision(df, ["k"], "s", F.col("y")).orderBy("k").collect()
    assert [(r.k, r.average_precision and round(r.average_precision, 6)) for r in ap] == [("a", round(0.5 + 0.5 * 2 / 3, 6)), ("b", None)]


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 999])
def test_compact_curves_keep_even_steps_and_the_end(spark, n):
    rows = [("a", i / 1000, i % 3 == 0) for i in range(n)] + [("a", 2.0, True), ("a", 2.0, False)]
    curve = metrics.precision_recall(spark.createDataFrame(rows, "k string, s double, y boolean"), ["k"], "s", F.col("y"))
    kept = [r.s for r in metrics.compacted(curve, ["k"], "s").orderBy("s").collect()]
    scores = sorted({s for _, s, _ in rows})
    want = scores if len(scores) <= 255 else [scores[i] for i in sorted({k * (len(scores) - 1) // 254 for k in range(255)})]
    assert kept == [None, *want]


def test_first_row_of_a_batch_is_new_and_its_repeats_are_not(spark):
    batch = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "a", 2), (2, "b", 3), (3, "c", 4), (3, "x", 5), (4, "d", 6), (4, "d", 7)], "id long, digest string, place long")
    stored = spark.createDataFrame([(2, "other"), (4, "d")], "id long, digest string")
    got = [r.disposition for r in lifecycle.split_known(batch, stored, "id", "digest", "place").orderBy("place").collect()]
    assert got == ["new", "duplicate", "duplicate", "conflict", "conflict", "conflict", "duplicate", "duplicate"]


def plain_flows(rows, idle, active):
    """{(key, t, seq): number} of packets in order."""
    out, state = {}, {}
    for key, t, seq in sorted(rows, key=lambda r: (r[0] is not None, r)):
        start, last, number = state.get(key, (t, t, 0))
        if t - last > idle or t - start > active:
            start, number = t, number + 1
        state[key] = (start, t, number)
        out[key, t, seq] = number
    return out


@pytest.mark.parametrize("idle, active", [(10, 25), (3, 1 << 60), (1 << 40, 7), (0, 0), (6, 100)])
def test_flows_of_a_hot_key_and_small_ones(spark, idle, active):
    r = random.Random(idle + active)
    rows, t = [], 0
    for seq in range(4000):  # one key has nine packets in ten, many at one time
        t += r.choice([0, 0, 1, 1, 2, 5, 11])
        rows.append(("hot", t, seq))
    rows += [(r.choice(["a", "b", "c", None]), r.randrange(300), 4000 + i) for i in range(400)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, t long, seq long").repartition(5)
    got = {(x.key, x.t, x.seq): x.flow_no for x in flows.assemble(df, ["key"], idle, active).collect()}
    assert got == plain_flows(rows, idle, active)
    assert flows.assemble(df.limit(0), ["key"], idle, active).count() == 0


def test_a_hot_key_is_spread_over_ranges(spark):
    p = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # so few rows would be one range
    try:
        ranged = ranges.sorted_ranges(p, ["key", "t"], "rid", "hot")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = [r["count"] for r in ranged.filter("key = 0").groupBy(F.shiftright("rid", ranges.RANGE_BIT)).count().collect()]
    assert len(counts) >= 3 and max(counts) <= 20_000


def test_topology(spark):
    a = spark.createDataFrame([(1, "10.0.0.2", "10.0.0.3", "critical", "open", "HTTP"), (2, "10.0.0.2", "10.0.0.3", "high", "resolved", "TCP"), (3, "10.0.0.3", "10.0.0.2", "low", "open", "TCP"), (4, "10.0.0.3", "10.0.0.3", "low", "resolved", None)], "alert_id long, source string, destination string, severity string, status string, protocol string").withColumn("observed_at", F.lit(0))
    e = {(r.source, r.destination): r for r in dashboard.topology_edges(a).collect()}
    assert (e["10.0.0.2", "10.0.0.3"].n_alerts, e["10.0.0.2", "10.0.0.3"].n_unresolved, e["10.0.0.2", "10.0.0.3"].severity, e["10.0.0.2", "10.0.0.3"].protocols) == (2, 1, "critical", "HTTP,TCP")
    assert e["10.0.0.3", "10.0.0.3"].open_severity is None
    n = {r.node: r for r in dashboard.topology_nodes(a).collect()}
    assert n["10.0.0.3"].n_alerts == 5 and n["10.0.0.3"].n_distinct_alerts == 4 and n["10.0.0.3"].identity == "address"


def test_search_is_literal(spark):
    df = spark.createDataFrame([("100%",), ("a_b",), ("ab",), (None,)], "x string")
    found = lambda q: [r.x for r in df.filter(search.text_search([F.col("x")], q)).collect()]
    assert found("%") == ["100%"] and found("A_B") == ["a_b"]
    with pytest.raises(ValueError):
        search.between("x", 2, 2)
    with pytest.raises(ValueError):
        search.scenario(F.col("x"), "class:", ())


def test_severity(spark):
    rows = [("normal", 0.99, False), ("normal", 0.1, True), ("attack", 0.9, False), ("attack", 0.8, False), ("attack", 0.2, False)]
    got = spark.createDataFrame(rows, "p string, c double, o boolean").select(severity.assess(F.col("p"), F.col("c"), F.col("o"))).collect()
    assert [r[0] for r in got] == ["informational", "critical", "critical", "high", "medium"]


def test_row_errors(spark):
    df = spark.createDataFrame([("1.5", "x"), ("true", " "), ("Infinity", None), (None, "x"), ("abc", "x")], "a string, b string")
    got = [r[0] for r in df.select(quality.row_errors(["a"], ["b"])).collect()]
    assert got == [[], ["boolean:a", "blank:b"], ["not_finite:a", "blank:b"], ["missing:a"], ["not_numeric:a"]]


def test_splits_are_stratified_and_whole(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], i // 10) for i in range(300)], "id long, y string, g long")
    n = {(r.y, r.split): r["count"] for r in splits.stratified(df, "y", "id").groupBy("y", "split").count().collect()}
    assert n["b", "train"] == 60 and n["b", "validation"] == n["b", "test"] == 20
    g = splits.grouped(df, "g").groupBy("g").agg(F.count_distinct("split").alias("k")).collect()
    assert len(g) == 30 and all(r.k == 1 for r in g)
    t = splits.ranked_globally(df, F.col("g"), ["id"]).orderBy("id").collect()
    assert [r["rank"] for r in t] == list(range(1, 301))


def test_sources_refuse_bad_input(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Unnamed: 0,no,f,g,y\n0,0,1,2,z\n")
    assert tables.flow_csv(spark, str(tmp_path / "a.csv"), target="y", features=("f", "g")).columns == ["f", "g", "y"]
    with pytest.raises(ValueError, match="undeclared"):
        tables.flow_csv(spark, str(tmp_path / "a.csv"), target="y", features=("f",))
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": \n')
    from pyspark.sql import types as T

    with pytest.raises(ValueError, match="refused"):
        tables.observations_json(spark, str(tmp_path / "b.json"), T.StructType([T.StructField("a", T.LongType())]))
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 2}]')
    assert tables.observations_json(spark, str(tmp_path / "c.json"), T.StructType([T.StructField("a", T.LongType())]), lines=False).count() == 2


def test_appends_can_be_repeated(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.lit(1))
    path = str(tmp_path / "t")
    for _ in range(3):
        out = sinks.append_new(df, path, "id")
    assert out.count() == 10


def test_only_a_missing_table_is_a_first_write(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_new(spark.range(3).withColumn("x", F.lit(1)), path, "id")
    torn = spark.createDataFrame([("a", 1)], "id string, x int")
    with pytest.raises(Exception):
        sinks.append_new(torn, path, "id").collect()
    rows = spark.createDataFrame([(None, 1), (None, 2), (2, 5), (7, 5), (7, 5)], "id long, x int")
    assert sorted((r.id is None, r.id or 0) for r in sinks.append_new(rows, path, "id").collect()) == [(False, 0), (False, 1), (False, 2), (False, 7), (True, 0), (True, 0)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    from tidewatch.streaming import flows

    path = str(tmp_path / "t")
    write = flows.ingest(path, "id")
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "a"), (3, "b")], "id long, x string")
    again = spark.createDataFrame([(1, "a"), (2, "z"), (9, "a")], "id long, x string")
    for df, n in ((batch, 0), (batch, 0), (again, 1), (again, 1)):
        write(df, n)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "a"), (9, "a")]
    told = spark.read.parquet(f"{path}-dispositions").groupBy("batch", "id", "disposition").count().collect()
    assert sorted((r.batch, r.id, r.disposition) for r in told) == [(0, 1, "new"), (0, 2, "duplicate"), (0, 2, "new"), (0, 3, "conflict"), (1, 1, "duplicate"), (1, 2, "conflict"), (1, 9, "new")]


def test_ranks_within_keys(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(500)], "id long, y string")
    got = splits.by_digest(df, ["y"], splits.digest_order(F.col("id")), "id").collect()
    for y in (None, "a", "b"):
        own = [r for r in got if r.y == y]
        assert sorted(r["rank"] for r in own) == list(range(1, len(own) + 1)) and {r.n_rows for r in own} == {len(own)}


def test_health_ladder(spark):
    """Three alarms in a row are critical; what has no route, no reference or too few rows isn't judged."""
    import datetime as dt

    day = lambda i: dt.datetime(2024, 1, i)
    keys = "window string, checked_at timestamp_ntz, cohort string"
    groups = [("fast", day(i), c) for c in ("live", "thin", "stale", "odd") for i in (1, 2, 3, 4)]
    counts = spark.createDataFrame([(*g, 5 if g[2] == "thin" else 50, 10) for g in groups], f"{keys}, n long, minimum int")
    routes = spark.createDataFrame([("live", None), ("thin", None), ("stale", "blocked")], "cohort string, reason string")
    alarm = lambda g: g[1] > day(1)
    features = spark.createDataFrame([(*g, 2.0 if alarm(g) else 0.5, "warning" if alarm(g) else "healthy") for g in groups], f"{keys}, aggregate_score double, status string")
    outputs = spark.createDataFrame([(*g, 3.0 if g[1] == day(4) else 0.1, "healthy") for g in groups], f"{keys}, aggregate_score double, status string")
    got = {(r.cohort, r.checked_at.day): (r.status, r.score) for r in drift.health(counts, routes, features, outputs, "cohort").collect()}
    assert [got["live", i] for i in (1, 2, 3, 4)] == [("healthy", 0.5), ("warning", 2.0), ("warning", 2.0), ("critical", 3.0)]
    assert {got[c, 4] for c in ("thin", "stale", "odd")} == {("collecting", None), ("blocked", None), ("incompatible_source", None)}


def test_output_metrics_need_support(spark):
    base = spark.createDataFrame([("normal" if i % 4 else "attack", i / 400, "a" if i % 2 else "b", i / 400) for i in range(400)], "l string, s double, c string, cs double")
    cur = spark.createDataFrame([(k, "attack", 0.9, "new", 0.5) for k in (1, 2) for _ in range(100 if k == 1 else 250)], "k int, l string, s double, c string, cs double")
    cols = [F.col(c) for c in ("l", "s", "c", "cs")]
    (bl, bs), (cl, cs) = drift.output_rows(base, [], *cols), drift.output_rows(cur, ["k"], *cols)
    vocabulary, reference = drift.output_references(bl, bs, bl, bs)
    limits = spark.createDataFrame([(m, 0.1) for m in drift.LABELS + drift.SCORES], "feature string, threshold double")
    m = drift.output_metrics(vocabulary, reference, bs, cl, cs, limits, ["k"], 0.25, 0.05)
    got = {(r.k, r.metric): (r.status, r.n) for r in m.collect()}
    assert got[1, "classifier_scores"] == ("collecting", 100) and got[2, "classifier_scores"] == ("warning", 250)
    assert all(got[k, x][0] == "warning" for k in (1, 2) for x in (*drift.LABELS, "detector_scores", "attack_routing_rate"))
    assert {(r.k, r.alarm_count, r.aggregate_score >= 15) for r in drift.output_status(m, ["k"]).collect()} == {(1, 4, True), (2, 5, True)}
    # Three values are too few to calibrate with.
    few = drift.output_references(bl, bs, bl.limit(3), bs.limit(3))
    assert few[0].count() == 0 and few[1].count() == 0


def test_newest_rows_of_a_large_key(spark):
    df = spark.createDataFrame([(i % 3 == 0, i % 50, i) for i in range(600)], "k boolean, t int, id int")
    got = drift.newest(df, ["k"], [F.desc("t"), F.desc("id")], 40, F.col("id"), parts=7).collect()
    for k in (True, False):
        want = sorted(((i % 50, i) for i in range(600) if (i % 3 == 0) == k), reverse=True)[:40]
        assert sorted(((r.t, r.id) for r in got if r.k == k), reverse=True) == want


def test_only_critical_degrades(spark):
    rows = [("critical", False, True, "degraded"), ("critical", True, True, "ready"), ("critical", False, False, "ready"), ("warning", False, True, "ready"), (None, False, True, "degraded")]
    df = spark.createDataFrame(rows, "status string, shadow_mode boolean, deployment_eligible boolean, want string")
    assert all(r.component == r.want for r in drift.readiness(df).collect())


def test_redrive_plans_refuse_what_they_must(spark):
    from tidewatch.operators import lifecycle

    known = spark.createDataFrame([(1, "eligible"), (2, "not_quarantined")], "id long, reason string")
    asked = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    plan = lambda a, **k: lifecycle.redrive_plan(a, known, "id", k.pop("operator", "o"), "r", **k)
    assert sorted(map(tuple, plan(asked(1, 2, 3)).collect())) == [(1, True, "eligible"), (2, False, "not_quarantined"), (3, False, "not_found")]
    assert plan(asked(1), dry_run=False).count() == 1
    for bad, k in ((asked(1, 2), {"dry_run": False}), (asked(1, 1), {}), (asked(), {}), (asked(1), {"operator": " "})):
        with pytest.raises(ValueError):
            plan(bad, **k)


def test_inference_frames_are_strict(spark):
    df = spark.createDataFrame([("1.5", "x"), ("2", "y")], "a string, b string")
    assert quality.inference_frame(df.select("b", "a"), ["a", "b"], ["b"]).collect()[1] == (2.0, "y")
    with pytest.raises(ValueError, match="missing"):
        quality.inference_frame(df, ["a", "b", "c"], ["b"])
    for bad in (("Infinity", "x"), (None, "x"), ("1", " ")):
        with pytest.raises(Exception, match="not a finite number"):
            quality.inference_frame(spark.createDataFrame([bad], "a string, b string"), ["a", "b"], ["b"]).collect()


def test_rates_restart_with_an_identity(spark):
    rows = [("s", "a", 0, 5), ("s", "a", 1_000_000, 9), ("s", "b", 2_000_000, 1), ("s", "b", 3_000_000, 4), ("s", "b", 4_000_000, 2), ("t", "a", 0, 1), ("t", "a", 200_000_000, 3)]
    got = flows.counter_rates(spark.createDataFrame(rows, "s string, i string, t long, n long"), "s", "i", "t", ["n"]).orderBy("s", "t").collect()
    assert [(r.s, r.t, r.n_rate) for r in got] == [("s", 2_000_000, None), ("s", 3_000_000, 3.0), ("s", 4_000_000, None), ("t", 200_000_000, 2 / 200)]


def test_quantiles_are_exact(spark):
    import numpy as np

    r = random.Random(8)
    values = {"a": [r.choice([-1, 1]) * 10 ** r.uniform(-4, 6) for _ in range(500)] + [0.0, -0.0, 3.0, 3.0, 3.0], "b": [7.0], "c": [1.0, 2.0]}
    df = spark.createDataFrame([(k, x) for k, v in values.items() for x in v] + [("a", None)], "k string, x double")
    levels = [0, 0.05, 0.31, 0.5, 0.95, 1]
    for row in S.quantiles(S.counted(df, ["k"], "x"), ["k"], "x", levels).collect():
        assert row.q == pytest.approx(np.quantile(values[row.k], levels).tolist(), rel=1e-12)
    run = S.running_counts(S.counted(df, ["k"], "x"), ["k"], "x", ["n"], falling=True).filter("k = 'a'").collect()
    assert all(x.n_upto == sum(v >= x.x for v in values["a"]) and x.n_all == 505 for x in run)


def test_counts_within_intervals_of_any_alignment(spark):
    r = random.Random(12)
    stamp = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    events = [(r.randrange(5000) if i % 5 else r.randrange(0, 5000, 300), r.choice("ab")) for i in range(600)]
    spans = [(i, a, a + r.choice([0, 1, 299, 300, 301, 600, 1500, 4000])) for i, a in enumerate([0, 1, 299, 300, 301, 600, 900] * 6)]
    e = spark.createDataFrame([(stamp(t), k) for t, k in events], "ts timestamp, k string")
    w = spark.createDataFrame([(i, stamp(a), stamp(z)) for i, a, z in spans], "i long, since timestamp, checked_at timestamp")
    got = {(x.i, x.k): x.n for x in evidence.interval_counts(e, "ts", ["k"], w, ["i"]).collect()}
    want = {(i, k): n for i, a, z in spans for k in "ab" if (n := sum(a < t <= z and c == k for t, c in events))}
    assert got == want


def test_performance_without_truth_is_null(spark):
    rows = spark.createDataFrame([("a", None, "attack", "x", 1.0), ("b", "MQTT", "normal", None, 2.0), ("b", "dos", "attack", None, 4.0), ("b", "dos", "attack", "dos", 9.0)], "k string, truth string, said string, family string, ms double")
    got = {x.k: x for x in evidence.performance(rows, ["k"], F.col("truth"), F.col("said"), F.col("family"), F.col("ms")).collect()}
    assert (got["a"].labelled_count, got["a"].detector_attack_recall, got["a"].cascade_accuracy, got["a"].latency_median) == (0, None, None, 1.0)
    assert (got["b"].labelled_count, got["b"].detector_attack_recall, got["b"].detector_normal_false_positive_rate, got["b"].latency_median) == (3, 1.0, 0.0, 4.0)
    assert got["b"].cascade_accuracy == pytest.approx(2 / 3)


def test_splits_say_why_there_is_none(spark):
    df = spark.createDataFrame([(i, f"g{i % 2}", f"h{i % 5}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)) for i in range(50)], "id long, few string, many string, ts timestamp")
    none, how = splits.realistic(df, ["few"], "ts", ["id"])
    assert none is None and not how["available"] and "fewer than 3" in how["reason"]
    got, how = splits.realistic(df, ["absent", "many"], "ts", ["id"])
    assert how["strategy"] == "group-aware" and got.groupBy("many").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    got, how = splits.realistic(df, [], "ts", ["id"])
    assert how["strategy"] == "temporal" and got.filter("split = 'test'").count() == 10
    assert splits.realistic(df.drop("ts"), ["absent"], "ts", ["id"])[1]["reason"] == "no group or time column"


def test_latest_snapshot_prefers_what_may_be_deployed(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [("a", "live", "fast", day(1), True), ("b", "replay", "fast", day(3), False), ("c", "live", "slow", day(4), True), ("d", "live", "fast", day(2), None)]
    s = spark.createDataFrame(rows, "cohort string, channel string, window string, checked_at timestamp, deployment_eligible boolean")
    one = lambda *a, **k: [r.cohort for r in drift.latest_snapshot(s, *a, **k).collect()]
    assert one({}, "fast") == ["a"] and one({}) == ["c"] and one({"channel": "replay"}, "fast") == ["b"] and one({"channel": "none"}) == []
    s = s.withColumn("deployment_eligible", F.lit(False))
    assert one({}, "fast") == [] and one({}, "fast", deployment=("channel", "live")) == ["d"]


def test_cohorts_that_cannot_be_judged(spark):
    c = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1), ("d", None), ("e", 99)], "k string, n long")
    refs = spark.createDataFrame([("a", "ok"), ("b", "stale_detector"), ("c", "ok"), ("d", "ok")], "k string, reason string")
    got = {r.k: r.reason for r in drift.judgeable(c, refs, "k", "n", 5).collect()}
    assert got == {"a": "ok", "b": "stale_detector", "c": "not_enough_data", "d": "not_enough_data", "e": "missing_reference"}


def test_identifiers(spark):
    ids = ["a", "A1._-z", "-a", "", None, "a" * 64, "a" * 65, "a\n", "é"]
    digests = ["0" * 64, "aF" * 32, "g" + "0" * 63, "0" * 63, "0" * 64 + "\n", None]
    said = spark.createDataFrame([(x,) for x in ids + digests], "x string").select(quality.sensor_id_ok(F.col("x")).alias("s"), quality.digest_ok(F.col("x")).alias("d")).collect()
    assert [r.s for r in said[: len(ids)]] == [True, True, False, False, False, True, False, False, False]
    assert [r.d for r in said[len(ids) :]] == [True, True, False, False, False, False]


def test_references_of_parts_that_overlap_or_are_empty_are_refused(spark):
    rows = [(i, float(i % 7), "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, c string")
    outputs = (F.when(F.col("a") > 3, "attack").otherwise("normal"), F.col("a") / 7, F.when(F.col("a") > 3, F.col("c")), F.when(F.col("a") > 3, F.col("a")))
    build = lambda train, held: drift.whole_reference(train, held, "id", ["a"], ["c"], outputs, window=20)
    with pytest.raises(drift.Overlap):
        build(df.filter("id < 40"), df.filter("id >= 39"))
    with pytest.raises(ValueError, match="need rows"):
        build(df, df.limit(0))
    with pytest.raises(ValueError, match="finite"):
        build(df.filter("id < 40").withColumn("a", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("a"))), df.filter("id >= 40"))
    entries, sample, parts = build(df.filter("id < 40"), df.filter("id >= 40"))
    got = {(r.kind, r.feature): r for r in entries.collect()}
    assert got["categorical", "c"].counts == {"x": 20, "y": 20, "__OTHER__": 0} and got["output_label", "detector_labels"].n == 20
    assert sum(got["numeric", "a"].counts.values()) == 40 and 0 < got["numeric", "a"].threshold < 1 and sample.count() == 40
    assert got["rate", "attack_routing_rate"].counts == {"attack": sum(r[1] > 3 for r in rows[40:])} and {r.part: r.n for r in parts.collect()} == {"fit": 40, "held_out": 20}
