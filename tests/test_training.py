"""Models on data that can be told apart, so that what they must learn is known."""

import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidewatch.operators import training
from tidewatch.operators.predictors import RuleDetector
from tidewatch.streaming import flows

NUMERIC, CATEGORICAL = ["a", "b"], ["c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Attacks have a high `a`, and their family is told by `c`; some numbers and categories are missing."""
    r, out = random.Random(4), []
    for i in range(600):
        attack = i % 3 == 0
        family = ("dos" if i % 2 else "scan") if attack else "normal"
        a = r.uniform(5, 9) if attack else r.uniform(0, 4)
        out.append((i, a, None if i % 17 == 0 else r.random(), None if i % 41 == 0 and not attack else {"dos": "x", "scan": "y"}.get(family, "xyz"[i % 3]), "attack" if attack else "normal", family))
    return spark.createDataFrame(out, "id long, a double, b double, c string, binary string, family string")


@pytest.mark.parametrize("name", ["logistic", "tree", "forest", "boosting"])
def test_candidates_learn_what_can_be_told_apart(rows, name):
    train, test = rows.filter("id % 4 <> 1"), rows.filter("id % 4 = 1")
    fitted = training.fit(train, "binary", NUMERIC, CATEGORICAL, training.candidates(2, small=True)[name])
    said = fitted.score(test, "m")
    assert fitted.labels == ["attack", "normal"] and said.columns[: len(rows.columns)] == rows.columns
    n, right = said.agg(F.count(F.lit(1)), F.count_if(F.col("m_label") == F.col("binary"))).first()
    assert right >= 0.98 * n


def test_candidates_are_the_published_ones():
    full = training.candidates(2)
    assert full["logistic"].getMaxIter() == 600 and full["tree"].getMaxDepth() == 14 and full["boosting"].getMaxIter() == 80
    assert (full["forest"].getNumTrees(), full["forest"].getMaxDepth(), full["forest"].getMinInstancesPerNode()) == (80, 18, 2)
    assert training.candidates(3)["boosting"].getClassifier().getMaxIter() == 80


def test_cascade_sends_attacks_only_to_the_classifier(rows):
    tree = training.candidates(2, small=True)["tree"]
    detector = training.fit(rows, "binary", NUMERIC, CATEGORICAL, tree)
    classifier = training.fit(rows.filter("binary = 'attack'"), "family", NUMERIC, CATEGORICAL, tree)
    out = training.cascade(rows, detector, classifier).collect()
    assert len(out) == 600
    for r in out:
        assert (r.attack_class is None) == (r.detector_label == "normal") == (r.class_scores is None)
        if r.class_scores:
            assert max(r.class_scores, key=r.class_scores.get) == r.attack_class and abs(sum(r.class_scores.values()) - 1) < 1e-9
    assert sum(r.detector_label == r.binary for r in out) >= 590 and sum(r.attack_class == r.family for r in out if r.binary == "attack") >= 190


def test_sigmoids_are_those_of_single_fits(spark):
    r = random.Random(2)
    sig = lambda x: 1 / (1 + math.exp(-x))
    rows = []
    for _ in range(4000):
        x = [r.uniform(-1, 1) for _ in range(3)]
        p = [sig(4 * x[0] - 1), sig(2 * x[1]), sig(50 * x[2])]
        rows.append((x, r.choices(range(3), p)[0]))
    df = spark.createDataFrame(rows, "m array<double>, y int")
    slopes, intercepts = training.platt(df, F.col("m"), F.col("y"), 3)
    for k in range(3):  # gradient descent of Newton's kind on each class alone
        own = [(x[k], y == k) for x, y in rows]
        pos = sum(o for _, o in own)
        t = [((pos + 1) / (pos + 2)) if o else 1 / (len(own) - pos + 2) for _, o in own]
        a = b = 0.0
        for _ in range(30):
            ps = [sig(a * s + b) for s, _ in own]
            ga, gb = sum((p - q) * s for p, q, (s, _) in zip(ps, t, own)), sum(p - q for p, q in zip(ps, t))
            w = [p * (1 - p) for p in ps]
            haa, hab, hbb = sum(v * s * s for v, (s, _) in zip(w, own)), sum(v * s for v, (s, _) in zip(w, own)), sum(w)
            det = haa * hbb - hab * hab
            a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        assert (slopes[k], intercepts[k]) == pytest.approx((a, b), rel=1e-3, abs=1e-3)


@pytest.fixture(scope="module")
def noisy(spark):
    """Classes that overlap, so that trees are surer than they should be."""
    r, out = random.Random(8), []
    for i in range(1500):
        family = r.choice(["dos", "scan", "brute"])
        at = {"dos": 0.0, "scan": 1.0, "brute": 2.0}[family]
        out.append((i, r.gauss(at, 1.0), r.gauss(-at, 1.5), "x", "attack" if family == "dos" else "normal", family))
    return spark.createDataFrame(out, "id long, a double, b double, c string, binary string, family string")


@pytest.mark.parametrize("target", ["binary", "family"])
@pytest.mark.parametrize("name", ["tree", "forest", "boosting"])
def test_calibrated_models_are_not_worse(noisy, target, name):
    train, held, test = (noisy.filter(c) for c in ("id % 3 = 0", "id % 3 = 1", "id % 3 = 2"))
    raw = training.fit(train, target, NUMERIC, CATEGORICAL, training.candidates(2 if target == "binary" else 3, small=True)[name])
    own = training.calibrate(raw, held, target)
    scored = own.score(test, "m")
    assert training.log_loss(scored, target, "m_probability", own.labels) <= training.log_loss(raw.score(test, "m"), target, "m_probability", raw.labels) + 0.01
    assert scored.filter("abs(aggregate(m_probability, 0D, (a, x) -> a + x) - 1) > 1e-9 or exists(m_probability, p -> p < 0 or p > 1)").count() == 0
    assert training.calibrate(raw, held.filter(F.col(target) == raw.labels[0]), target) == raw


def test_predictors_are_saved_and_score_alike_in_batch_and_stream(spark, rows, tmp_path):
    rule = RuleDetector(syn="syn", rst="b", rate="rate")
    model = training.calibrate(training.fit(rows, "binary", NUMERIC, CATEGORICAL, training.candidates(2, small=True)["forest"]), rows, "binary").predictor()
    flows_ = rows.fillna({"b": 0.0}).withColumns({"rate": F.col("a") * 20_000, "syn": F.col("a") * 10})
    flows_.write.json(str(tmp_path / "in"))
    for name, predictor, load in (("rule", rule, RuleDetector.load), ("model", model, PipelineModel.load)):
        predictor.write().overwrite().save(str(tmp_path / name))
        loaded = load(str(tmp_path / name))
        told = lambda p: sorted((r.id, r.m_label, round(r.m_score, 9)) for r in p.transform(flows_).collect())  # noqa: E731, B023
        want = told(predictor)
        assert told(loaded) == want and all(s >= 0.5 for *_, s in want) and len({x for _, x, _ in want}) == 2
        out = str(tmp_path / f"out-{name}")
        stream = flows.follow(spark, str(tmp_path / "in"), flows_.schema)
        flows.drain(stream, out, write=flows.score_batch(f"{out}-predictions", f"{out}-alerts", "id", loaded))
        got = sorted((r.id, r.prediction, round(r.score, 9)) for r in spark.read.parquet(f"{out}-predictions").collect())
        assert got == want
        assert spark.read.parquet(f"{out}-alerts").count() == sum(x == "attack" for _, x, _ in want)


def test_fits_and_sigmoids_read_rows_few_times(spark, rows):
    """Labels and weights are found once, and a model runs over its validation rows once."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    own = rows.withColumn("binary", seen("binary"))
    fitted = training.fit(own, "binary", NUMERIC, CATEGORICAL, training.candidates(2, small=True)["logistic"])
    before, n = read.value, rows.count()
    assert before <= 8 * n, before / n
    assert training.calibrate(fitted, own, "binary").slopes
    assert read.value - before == n


def test_seeds_share_what_has_none_and_all_rows_are_prepared_once(spark, rows, monkeypatch):
    from tidewatch.plans import training as plan

    split = rows.withColumn("split", F.when(F.col("id") % 4 == 1, "validation").otherwise("train"))
    fits, prepared = [], []
    fit, prepare = training.fit_prepared, training.prepare
    monkeypatch.setattr(plan, "_flows", lambda *_: split)
    monkeypatch.setattr(plan, "NUMERIC", NUMERIC)
    monkeypatch.setattr(plan, "CATEGORICAL", CATEGORICAL)
    monkeypatch.setattr(plan.TR, "candidates", lambda classes, seed=42: candidates(classes, seed, small=True))
    monkeypatch.setattr(plan.TR, "fit_prepared", lambda p, m: fits.append(m) or fit(p, m))
    monkeypatch.setattr(plan.TR, "prepare", lambda *a: prepared.append(a) or prepare(*a))
    got = plan._compare(spark, "", "binary", "true", (1, 2)).collect()
    assert len(prepared) == 2 and len(fits) == 7
    assert sorted((r.model, r.seed) for r in got) == sorted((m, s) for m in ("logistic", "tree", "forest", "boosting") for s in (1, 2))
    assert all(r.accuracy >= 0.98 for r in got)


candidates = training.candidates


def test_stratified_ranks_few_rows(spark):
    from tidewatch.operators import splits

    df = spark.range(20_000).selectExpr("id", "case when id < 2 then 'rare' when id < 7 then null when id % 3 = 0 then 'a' else 'b' end as label")
    ranked = splits.by_digest(df, ["label"], splits.digest_order(F.col("id")), "id").filter("n_rows >= 3")
    want = {r.id: r.split for r in ranked.select("id", splits.cut(F.col("rank"), F.col("n_rows")).alias("split")).collect()}
    split = splits.stratified(df, "label", "id")
    assert {r.id: r.split for r in split.collect()} == want and len(want) == 19_998
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    # Below the window that ranks rows lies the filter that leaves those at an edge.
    assert plan.count("row_number()") == 1 and "Union" in plan


@pytest.fixture(scope="module")
def many(spark):
    """Rows of few values, each of which comes many times; some numbers are missing."""
    r, out = random.Random(11), []
    for i in range(6000):
        a, b = r.randrange(20), r.randrange(10)
        family = ("dos" if b > 4 else "scan") if a + b > 14 else "normal"
        out.append((i, float(a), None if i % 29 == 0 else float(b), "xyz"[i % 3], "attack" if family != "normal" else "normal", family))
    return spark.createDataFrame(out, "id long, a double, b double, c string, binary string, family string").cache()


@pytest.mark.parametrize("target", ["binary", "family"])
def test_trees_on_cells_are_those_on_rows(many, target):
    plain, cells = (training.prepare(many, target, NUMERIC, CATEGORICAL, False, n) for n in (None, 1))
    assert not plain.cells and cells.cells and cells.rows.agg(F.sum("n")).first()[0] == 6000 and cells.rows.count() <= 1500
    models = training.candidates(2 if target == "binary" else 3, small=True)
    for name in ("tree", "boosting"):
        a, b = (training.fit_prepared(p, models[name]).score(many, "m").select("id", "m_label", F.round(F.element_at("m_probability", 1), 6).alias("p")) for p in (plain, cells))
        assert a.exceptAll(b).count() == 0, name
    forest = training.fit_prepared(cells, models["forest"])
    own = forest.pipeline.stages[-1]
    assert len(own.trees) == 10 and len({t.toDebugString for t in own.trees}) == 10
    # Beyond rows whose number is missing, which are noise, all is learnt.
    assert forest.score(many, "m").filter("b is not null and m_label <> " + target).count() <= 0.03 * 6000
    assert training.calibrate(forest, many, target).slopes


def test_bootstrap_of_cells_is_that_of_their_rows(spark):
    cells = spark.createDataFrame([(0.0, 2.0, n, [float(i)]) for i, n in enumerate([1] * 400 + [50] * 400)], "label double, weight double, n long, x array<double>").coalesce(1)
    drawn = cells.mapInArrow(training._drawn(2, 5), "label double, weight double, x array<double>").groupBy("x").agg(F.sum("weight").alias("w"), F.count("*").alias("k")).collect()
    few, lots = ([r.w / 2 for r in drawn if (r.x[0] < 400) == side] for side in (True, False))
    assert all(w == int(w) for w in few + lots) and all(r.k == min(2, r.w / 2) for r in drawn)
    assert 0.5 < len(few) / 400 < 0.75 and abs(sum(few) / 400 - 1) < 0.2
    mean = sum(lots) / 400
    assert len(lots) == 400 and abs(mean - 50) < 2 and 35 < sum((w - mean) ** 2 for w in lots) / 400 < 65
    whole = cells.mapInArrow(training._drawn(2), "label double, weight double, x array<double>")
    assert whole.count() == 1200 and whole.agg(F.sum("weight")).first()[0] == 2 * (400 + 50 * 400)
