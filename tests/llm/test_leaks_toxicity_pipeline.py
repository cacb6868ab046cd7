import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidewatch.llm import decontamination, toxicity
from tidewatch.llm.mixing import OP5_SQL

from .test_lines_mixing_pii import brute_lines

SF = "/root/testdata/sf0.001"


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_leaks(docs, items, t=0.8):
    out = set()
    for i, x in items:
        want = shingles(x)
        for d, y in docs:
            n = len(want & shingles(y))
            if want and n >= t * len(want) - 1e-9:
                out.add((d, i, len(want), n))
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_contained_items(docs, spark, broadcast_bytes):
    r = random.Random(3)
    text = lambda n: " ".join(f"W{r.randrange(300)}" for _ in range(n))
    items = [(i, text(r.randrange(6, 60))) for i in range(40)] + [(100, "Two words"), (101, None), (102, ""), (103, " "), (None, text(20)), (0, text(12))]
    items.append(items[1])
    rows = []
    for i, x in items:
        w = (x or "").split()
        for broken in (0, 1, 3):
            own = w[:]
            for _ in range(broken if len(own) > 5 else 0):
                own[r.randrange(len(own))] = "zz"
            rows.append((len(rows), f"{text(r.randrange(0, 400))}\n{' '.join(own).upper()}\t{text(50)}"))
    rows += [(900, "two WORDS"), (901, None), (902, ""), (None, items[2][1]), (903, text(60_000) + " " + items[5][1])]
    rows.append(rows[0])
    df = spark.createDataFrame([(i, x, "k") for i, x in items], "item_id long, text string, item string")
    got = decontamination.contained_items(docs([(*x, "s") for x in rows]), df, broadcast_bytes=broadcast_bytes).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(key(tuple(g)[:4]) for g in got) == sorted(map(key, brute_leaks(rows, items)))
    assert decontamination.contained_items(docs([]), df).count() == 0
    assert decontamination.contained_items(docs([(1, "a b c d e f", "s")]), df.limit(0)).count() == 0


def test_logistic_finds_the_optimum():
    rng = np.random.default_rng(0)
    n, k = 400, 12
    dense = (rng.random((n, k)) < 0.3).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * dense[:, 0] - 2 * dense[:, 1] - 0.5)))).astype(float)
    rows, cols = np.nonzero(dense)
    w, b = toxicity.logistic(toxicity.Sparse(rows, cols, n, k, np.zeros((n, 0))), y, 1e-3, 3000)
    r = (1 / (1 + np.exp(-(dense @ w + b))) - y) / n
    g = dense.T @ r
    assert abs(r.sum()) < 1e-5 and (np.abs(g) <= 1e-3 + 1e-5).all() and np.allclose(g[w != 0], -1e-3 * np.sign(w[w != 0]), atol=1e-5)


def test_fit_takes_in_what_was_left_out_at_first():
    """A feature that is as common with the category as without it pulls on nothing, until another weighs something."""
    rng, n = np.random.default_rng(3), 3000
    y = (np.arange(n) % 2 == 0).astype(float)
    told = y == 1
    a = told & (rng.random(n) < 0.9) | ~told & (rng.random(n) < 0.3)
    # Even within all rows, telling among those with a.
    b = np.zeros(n, bool)
    b[rng.permutation(np.flatnonzero(told & ~a))[:100]] = True
    b[rng.permutation(np.flatnonzero(~told & a))[:100]] = True
    x = np.stack([a, b], axis=1)
    rows, cols = np.nonzero(x)
    pull = np.abs(x.T @ (y - y.mean())) / n
    w, bias = toxicity.fit(rows, cols, 2, np.zeros((n, 0)), y, 1e-3, 5000)
    assert pull[0] > 5e-4 >= pull[1] and w[1] != 0
    whole, c = toxicity.logistic(toxicity.Sparse(rows, cols, n, 2, np.zeros((n, 0))), y, 1e-3, 5000)
    assert np.allclose(w, whole, atol=1e-2) and abs(bias - c) < 1e-2
    # Rare features weigh nothing: what `train` leaves out.
    rare = np.zeros((n, 1), bool)
    rare[np.flatnonzero(told)[:3]] = True
    rows, cols = np.nonzero(np.concatenate([x, rare], axis=1))
    assert toxicity.logistic(toxicity.Sparse(rows, cols, n, 3, np.zeros((n, 0))), y, 1e-3, 5000)[0][2] == 0


def test_toxicity_on_held_out_rows(docs, spark):
    r = random.Random(8)
    bad = ["vile", "foul", "Übel"]
    words = [f"w{i}" for i in range(400)]

    def make(i):
        toxic = i % 4 == 0
        t = [r.choice(words) for _ in range(r.randrange(20, 200))]
        low = toxic or i % 7 == 0
        if low:
            t += ["spam", "junk"]
        if toxic:
            t += r.sample(bad, 2)
        r.shuffle(t)
        return i, " ".join(t).capitalize() + ".", toxic, low

    made = [make(i) for i in range(900)]
    rows = [(i, t, "s") for i, t, *_ in made] + [(None, "vile, FOUL!", "s"), (2000, None, "s"), (2001, "", "s"), (2002, "long " * 50_000 + "foul übel", "s"), (0, made[0][1], "s")]
    labels = spark.createDataFrame([(i, int(x), int(low), "t") for i, _, x, low in made if i < 500] + [(901, None, 1, "t"), (None, 1, 1, "t"), (1, 0, 0, "t")], "doc_id long, toxic int, low int, text string")
    chain = {"low": F.col("low"), "toxic": F.col("toxic")}
    got = toxicity.scored_documents(docs(rows), labels, chain).select("doc.doc_id", "doc.rk", "p_low", "p_toxic", "toxic").collect()
    assert len(got) == len(rows) and {g.rk for g in got} == {"x"}
    said = {g.doc_id: g.toxic for g in got}
    held_out = [(said[i], x) for i, _, x, _ in made if i >= 500]
    assert sum(a == b for a, b in held_out) >= 0.97 * len(held_out)
    assert said[None] and said[2002] and not said[2000] and not said[2001]
    low = {g.doc_id: g.p_low >= 0.5 for g in got}
    assert np.mean([low[i] == x for i, _, _, x in made if i >= 500]) >= 0.97
    again = toxicity.scored_documents(docs(rows), labels, chain).select("doc.doc_id", "p_toxic").collect()
    assert sorted((str(g.doc_id), g.p_toxic) for g in again) == sorted((str(g.doc_id), g.p_toxic) for g in got)
    none = toxicity.scored_documents(docs(rows[:3]), labels.limit(0), chain).collect()
    assert [(x.p_toxic, x.toxic) for x in none] == [(None, False)] * 3
    one = toxicity.scored_documents(docs(rows[:3]), labels.filter("toxic = 0"), chain).collect()
    assert not any(x.toxic for x in one)
    assert toxicity.scored_documents(docs([]), labels, chain).count() == 0


def dense_chain(texts, y, fold, penalty):
    """Probabilities of every text by a chain fitted on dense columns, plain gradient steps, one feature at a time."""
    own = []
    for t in texts:
        w = re.findall(rb"[A-Za-z\x80-\xff]+", t.encode().lower())
        own.append(set(w) | {(x[:4],) for x in w if len(x) >= 4})
    names = sorted(set().union(*own), key=repr)
    x = np.array([[f in o for f in names] for o in own], float)
    n = len(y)

    def fit(a, z):
        w, b, rate = np.zeros(a.shape[1]), 0.0, 4 * len(a) / (np.linalg.norm(np.column_stack([a, np.ones(len(a))]), 2) ** 2)
        for _ in range(30_000):
            r = (1 / (1 + np.exp(-(a @ w + b))) - z) / len(a)
            w, b = w - rate * (a.T @ r), b - rate * r.sum()
            w = np.sign(w) * np.maximum(0, abs(w) - rate * penalty)
        return w, b

    said = lambda a, m: 1 / (1 + np.exp(-(a @ m[0] + m[1])))
    out = []
    for j in range(y.shape[1]):
        full = fit(x[:n], y[:, j])
        p = said(x, full)
        out.append(p)
        held = p.copy()  # rows to learn from see the probability by a model without their fold
        for f in set(fold):
            held[:n][fold == f] = said(x[:n][fold == f], fit(x[:n][fold != f], y[fold != f, j]))
        learn, ask = np.column_stack([x[:n], held[:n]]), np.column_stack([x, p])
        if j == 0 and y.shape[1] == 2:
            return [p, said(ask, fit(learn, y[:, 1]))]
    return out


def test_chain_against_a_dense_one(docs, spark):
    r = random.Random(3)
    words = [f"wor{chr(97 + i)}x" for i in range(12)]
    rows, y = [], []
    for i in range(90):
        low, toxic = i % 3 == 0, i % 3 == 0 and i % 2 == 0 or i % 11 == 0
        own = [r.choice(words) for _ in range(r.randrange(3, 9))] + ["junk"] * (low and r.random() < 0.8) + ["vile"] * (toxic and r.random() < 0.8)
        rows.append((i, " ".join(own), "s"))
        y.append((i, int(low), int(toxic)))
    labels = spark.createDataFrame(y[:70], "doc_id long, low int, toxic int")
    chain = {"low": F.col("low"), "toxic": F.col("toxic")}
    got = {g.doc_id: (g.p_low, g.p_toxic) for g in toxicity.scored_documents(docs(rows), labels, chain, penalty=4e-3, steps=20_000).select("doc.doc_id", "p_low", "p_toxic").collect()}
    hashed = {x.i: x.h & (2**64 - 1) for x in spark.range(70).select(F.col("id").alias("i"), F.xxhash64("id").alias("h")).collect()}
    want = dense_chain([t for _, t, _ in rows], np.array([v[1:] for v in y[:70]], float), np.array([hashed[i] % toxicity.FOLDS for i in range(70)]), 4e-3)
    assert max(abs(got[i][j] - want[j][i]) for i in range(90) for j in (0, 1)) < 2e-3


def test_threshold_is_the_best_out_of_fold():
    # 8 of 10 above 0.9, one at 0.4 and one at 0.2; one of 200 others at 0.4, and twenty at 0.2.
    assert toxicity.best_threshold([(95, 8, 0), (40, 1, 1), (20, 1, 20), (1, 0, 179)]) == pytest.approx((0.21 + 0.40) / 2)
    assert toxicity.best_threshold([(95, 8, 0), (40, 2, 1), (1, 0, 199)]) == pytest.approx((0.02 + 0.40) / 2)
    assert toxicity.best_threshold([(3, 0, 100)]) == toxicity.THRESHOLD == toxicity.best_threshold([])


def test_pipeline_against_brute_force(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    out, docs, left = {}, spark.read.parquet(f"{SF}/documents.parquet"), list(zip(given.doc_id, given.text))
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        out[name] = docs.toPandas()
        if name != "mixing":
            assert list(out[name].columns) == list(given.columns)
    scored = __spark_entry__.queries()["op8_toxicity"](spark, SF).toPandas()
    toxic = set(scored[scored.toxic].doc_id)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert set(out["toxicity"].doc_id) == set(given.doc_id) - toxic
    assert not toxic & set(labels[labels.toxic == 0].doc_id)
    left = [(d, t) for d, t in left if d not in toxic]
    left = [(d, t) for d, _, _, t in brute_lines(left)]
    assert sorted(zip(out["line_dedup"].doc_id, out["line_dedup"].text)) == left
    assert (out["line_dedup"].n_chars == out["line_dedup"].text.str.len()).all()
    left = brute_first_copies(left)
    assert sorted(out["near_duplicates"].doc_id) == [d for d, _ in left]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    gone = {d for d, *_ in brute_leaks(left, list(zip(items.item_id, items.text)))}
    assert sorted(out["decontamination"].doc_id) == [d for d, _ in left if d not in gone]
    # The mix against op5's SQL, over what is left.
    documents = out["decontamination"]
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(OP5_SQL).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r[c] for c in columns) for r in docs.collect()]
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(got) == plain(want) and len(got) == len(documents)


def brute_first_copies(docs, similarity=0.8):
    """Of each group that links of like five-word shingles make, the document of the smallest id."""
    sets, first = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= similarity * len(a | b) - 1e-9):
                lo, hi = sorted((first[i], first[j]))
                first = [lo if f == hi else f for f in first]
    return [d for k, d in enumerate(docs) if d[0] == min(docs[i][0] for i in range(len(docs)) if first[i] == first[k])]


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and clashing names, through every stage."""
    clashing = ["gone", "lid", "lrk", "__rk", "rk", "id", "doc", "others", "h", "s", "toxic", "component_id", "item_id"]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clashing)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    at = 1_000_000  # beyond all labelled ids
    one, long = "some words that nobody else has here at all", " ".join(f"word{i}" for i in range(60_000))
    rows = [(at + 1, one, "a"), (at + 1, one, "a"), (None, None, None), (at + 2, "", None), (at + 3, None, "a"), (at + 1, "a second text of the same id", "a"), (at + 4, long, "b"), (at + 5, f"before\n{item}\nafter", "b"), (at + 6, long, "a")]
    given = [(d, t, "en", s, 5, *clashing) for d, t, s in rows]
    docs, seen = spark.createDataFrame(given, names), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert name == "mixing" or docs.columns == before
        seen[name] = docs.collect()
    ids = lambda name: sorted((r.doc_id or 0) - at for r in seen[name])
    assert ids("toxicity") == ids("line_dedup") == sorted((d or 0) - at for d, *_ in rows)
    texts = sorted((r.doc_id or 0, r.text) for r in seen["line_dedup"])
    assert texts == sorted((d or 0, "" if d == at + 6 else t or "") for d, t, _ in rows)
    assert all(r.n_chars == len(r.text) and r.gone == "gone" for r in seen["line_dedup"])
    # Without words are the null id, 2, 3 and 6, whose line was that of 4.
    assert ids("near_duplicates") == [1, 2, 4, 5]
    assert ids("decontamination") == [1, 2, 4]
    assert sorted((r.doc_id - at, r["size"]) for r in seen["mixing"] if r.doc_id != at + 1) == [(2, 0), (4, 60_000)]
    docs = spark.createDataFrame([], names)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_a_fit_holds_no_index_over_all_ones():
    import tracemalloc

    r = np.random.default_rng(4)
    n, each, k = 10_000, 400, 30_000
    cols = np.sort(r.integers(0, k, (n, each), dtype=np.int32), axis=1).ravel()
    rows = np.repeat(np.arange(n, dtype=np.int32), each)
    tracemalloc.start()
    x = toxicity.Sparse(rows, cols, n, k, np.zeros((n, 0)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The ones by column take four bytes each; an index over all of them would take eight more.
    assert peak < 9 * len(cols)
    assert (x.rows == rows[np.argsort(cols, kind="stable")]).all()
    assert (x.back(np.ones(n)) == np.bincount(cols, minlength=k)).all()


@pytest.mark.parametrize("part, most", [(-1, 14), (0, 9)])
def test_a_fit_lets_go_of_what_it_has_read(part, most):
    import tracemalloc

    r = np.random.default_rng(5)
    n, each, k, batch = 8_000, 400, 30_000, 2_000
    cols = np.sort(r.integers(0, k, (n, each), dtype=np.int32), axis=1).ravel()

    def lists(v):
        return pa.ListArray.from_arrays(pa.array(np.arange(batch + 1, dtype=np.int32) * (len(v) // batch)), pa.array(v))

    def batches():
        for a in range(0, n, batch):
            ids = np.arange(a, a + batch)
            own = [pa.array(np.full(batch, part, np.int32)), pa.array(ids), lists((ids % 3 == 0).astype(float)), lists(cols[a * each : (a + batch) * each]), lists(np.zeros(0))]
            yield pa.RecordBatch.from_arrays(own, ["part", "id", "y", "features", "earlier"])

    list(toxicity._fits(k, 0, 3, 1e-3, 1)(b.slice(0, 50) for b in batches()))  # what is imported late isn't counted
    tracemalloc.start()
    list(toxicity._fits(k, 0, 3, 1e-3, 3)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Bytes for each one of the rows read; indexes of 64 bits over all ones made it 17 and 12.
    assert peak < most * len(cols)
