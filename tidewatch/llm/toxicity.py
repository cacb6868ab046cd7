"""Operator 8: toxicity by a classifier chain.

Categories are predicted in order by linear models over the words of a text and their
first bytes; each model also sees the probabilities of the categories before its own.
Those it is trained with are out of fold: predicted by models that hadn't seen the row,
as they will be for new texts. The models are logistic, with an L1 penalty, so most
features weigh nothing. A text is rejected where the last category's probability
reaches a threshold, which is also chosen out of fold.

The models are fitted on at most `sample` labelled rows, those whose ids have the least
hashes. Spark counts in how many of them each feature is. One row moves the loss's slope by
less than 1 / n, so a feature of at most penalty * n rows weighs nothing at the optimum,
whatever the others weigh: only such features are left out. Every fit, of all rows of the
sample or all but a fold, is a task of its own. It starts with the features that pull most
and takes in any other whose slope is over the penalty, until there is none. Scoring reads
whole texts, row by row, and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .hashing import utf8, words

SAMPLE, FOLDS = 20_000, 3
#: Bytes of a word's beginning that make a feature besides the word.
PREFIX = 4
PENALTY, STEPS, TOLERANCE = 5e-4, 400, 1e-6
#: Of rows without the category, the largest share that the threshold may reject, out of fold; the threshold where none can be chosen.
FALSE_SHARE, THRESHOLD = 0.01, 0.5
#: All but ASCII letters and bytes of other letters part words.
APART = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts) of the distinct features of each text, in the order of (text, hash)."""
    h, t, stem = words(column, APART, PREFIX)
    h, t = np.append(h, stem[stem > 0]), np.append(t, t[stem > 0])
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
    return h[new], t[new]


def _lists(values: np.ndarray, t: np.ndarray, n: int) -> pa.Array:
    at = np.searchsorted(t, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def _stretches(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """(first, number) of texts that follow one another, of some `most` bytes together."""
    ends, a = np.cumsum(np.diff(utf8(texts)[1])), 0
    while a < len(texts):
        e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, e - a
        a = e


def _sample_features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for a, n in _stretches(batch.column("text")):
            rows = batch.slice(a, n)
            h, t = features(rows.column("text"))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("y"), _lists(h.view(np.int64), t, n)], ["id", "y", "features"])


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _sums(values: np.ndarray, index: np.ndarray, at: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Of each run of `index` that begins at `at` the sum of values[index], a block of runs at a time."""
    out, cuts = np.zeros(len(at)), np.searchsorted(at, np.arange(0, len(index), block))
    for a, e in zip(cuts, [*cuts[1:], len(at)]):
        if a < e:
            first, last = at[a], at[e] if e < len(at) else len(index)
            out[a:e] = np.add.reduceat(values[index[first:last]], at[a:e] - first)
    return out


def _counts(cols: np.ndarray, k: int, block: int = 1 << 18) -> np.ndarray:
    """How many of each of k columns there are, a block at a time, as bincount widens what it counts."""
    return sum((np.bincount(cols[a : a + block], minlength=k) for a in range(0, len(cols), block)), np.zeros(k, np.int64))


def _picked(values: np.ndarray, index: np.ndarray, ones: np.ndarray | None = None, block: int = 1 << 18) -> np.ndarray:
    """values[index], or values[index[ones]], a block at a time, as numpy widens a whole index to 64 bits."""
    out, n = np.empty(len(index) if ones is None else np.count_nonzero(ones), values.dtype), 0
    for a in range(0, len(index), block):
        own = index[a : a + block] if ones is None else index[a : a + block][ones[a : a + block]]
        out[n : n + len(own)] = values[own]
        n += len(own)
    return out


def _by_column(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """`rows` in the stable order of `cols`, of which there are `counts`, a block at a time: no index over all ones is held."""
    out, nxt = np.empty(len(cols), rows.dtype), np.cumsum(counts) - counts
    for a in range(0, len(cols), block):
        order = np.argsort(cols[a : a + block], kind="stable")
        own = cols[a : a + block][order]
        at = _starts(own)
        size = np.diff(np.append(at, len(own)))
        out[np.repeat(nxt[own[at]] - at, size) + np.arange(len(own))] = rows[a : a + block][order]
        nxt[own[at]] += size
    return out


class Sparse:
    """A 0/1 matrix of (rows, columns) of its ones, in the order of rows, with some dense columns on the right."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, k: int, dense: np.ndarray):
        self.n, self.k, self.dense = n, k, dense
        # The ones by rows and by columns, each with the places where a new one begins.
        self.cols, self.row_at = cols.astype(np.min_scalar_type(k), copy=False), _starts(rows)
        self.used_rows = rows[self.row_at]
        counts = _counts(self.cols, k)
        self.rows = _by_column(rows, self.cols, counts)
        self.used_cols = np.flatnonzero(counts)
        self.col_at = (np.cumsum(counts) - counts)[self.used_cols]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = self.dense @ w[self.k :] if self.dense.shape[1] else np.zeros(self.n)
        out[self.used_rows] += _sums(w, self.cols, self.row_at)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.k)
        out[self.used_cols] = _sums(r, self.rows, self.col_at)
        return np.concatenate([out, self.dense.T @ r])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def constant(y: np.ndarray) -> float:
    """The intercept of a model without features, drawn in a little from a share of 0 or 1."""
    return float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))


def logistic(x: Sparse, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS, tolerance: float = TOLERANCE, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1 logistic model, by accelerated proximal gradient steps, at most
    `steps`, until no weight's step is over `tolerance` as a gradient; `start`: weights and intercept to begin with."""
    w, bias = start or (np.zeros(x.k + x.dense.shape[1]), constant(y))
    if not 0 < y.sum() < len(y):
        return w, bias
    u = np.ones(len(w) + 1)
    for _ in range(20):  # the largest eigenvalue of the matrix, with its column of ones
        z = x.times(u[:-1]) + u[-1]
        u = np.append(x.back(z), z.sum())
        size = np.linalg.norm(u)
        u /= size
    rate = 4 * x.n / (1.05 * size)
    v, c, pace, before, mark = w.copy(), bias, 1.0, w, bias
    for _ in range(steps):
        r = (sigmoid(x.times(v) + c) - y) / x.n
        moved = v - rate * x.back(r)
        w, bias = np.sign(moved) * np.maximum(0, np.abs(moved) - rate * penalty), c - rate * r.sum()
        step = w - v
        if max(np.abs(step).max(initial=0), abs(bias - c)) <= tolerance * rate:
            break
        # Momentum that points uphill is dropped.
        pace = 1.0 if step @ (w - before) < 0 else pace
        nxt = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        v, c = w + (pace - 1) / nxt * (w - before), bias + (pace - 1) / nxt * (bias - mark)
        before, mark, pace = w, bias, nxt
    return w, bias


def fit(rows: np.ndarray, cols: np.ndarray, size: int, dense: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """`logistic` over `size` columns, given by their ones in the order of rows, and the dense ones.

    Only those that pull on the constant model by over half the penalty are fitted at first. Of the
    others those whose slope at the model found is over the penalty join them, until none is: what is
    left out has a weight of 0 at the optimum of all columns.
    """

    def slope(r: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        out = np.zeros(size)
        for a in range(0, len(cols), block):
            out += np.bincount(cols[a : a + block], r[rows[a : a + block]], size)
        return np.abs(out) / max(1, len(y))

    w, bias = np.zeros(size + dense.shape[1]), constant(y)
    used = slope(y - sigmoid(bias)) > penalty / 2
    while True:
        ones, own = _picked(used, cols), np.append(used, np.ones(dense.shape[1], bool))
        number = (np.cumsum(used) - 1).astype(np.min_scalar_type(int(used.sum())))
        x = Sparse(rows[ones], _picked(number, cols, ones), len(y), int(used.sum()), dense)
        del ones
        w[own], bias = logistic(x, y, penalty, steps, tolerance, (w[own], bias))
        late = ~used & (slope(y - sigmoid(x.times(w[own]) + bias)) > penalty + tolerance)
        if not 0 < y.sum() < len(y) or not late.any():
            return w, bias
        used |= late
        del x  # before the next one is built


def _fits(size: int, category: int, folds: int, penalty: float, steps: int):
    """Rows (part, id, y, features, earlier), sorted by (part, id), to rows (id, p, feature,
    weight): of part f the probabilities of the rows of fold f, by a model of all others; of
    part -1 the weights of a model of all rows. Feature -1 is the intercept, and -2 - e the
    probability of category e."""

    def fitted(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([b.column("id").to_numpy() for b in held])
        n, y = len(ids), np.concatenate([b.column("y").flatten().to_numpy() for b in held]).reshape(len(ids), -1)[:, category].copy()
        sizes = np.concatenate([np.diff(b.column("features").offsets.to_numpy()) for b in held])
        dense = np.concatenate([b.column("earlier").flatten().to_numpy() for b in held]).reshape(n, category)
        fold = ids.view(np.uint64) % np.uint64(folds)
        learn = np.ones(n, bool) if part < 0 else fold != part
        rows = lambda keep: np.repeat(np.arange(keep.sum(), dtype=np.min_scalar_type(n)), sizes[keep])
        # The features, batch by batch, each of which goes once it was read.
        cols, apart = (np.empty(sizes[keep].sum(), np.int32) for keep in (learn, ~learn))
        first, at = 0, [0, 0]
        for i, b in enumerate(held):
            held[i] = None
            own = np.repeat(learn[first : first + b.num_rows], sizes[first : first + b.num_rows])
            values = b.column("features").flatten().to_numpy()
            for j, (out, keep) in enumerate(((cols, own), (apart, ~own))):
                m = np.count_nonzero(keep)
                np.compress(keep, values, out=out[at[j] : at[j] + m])
                at[j] += m
            first += b.num_rows
            del b, own, values, keep
        held.clear()
        w, bias = fit(rows(learn), cols, size, dense[learn], y[learn], penalty, steps)
        del cols
        if part >= 0:
            out = [ids[~learn], sigmoid(Sparse(rows(~learn), apart, int((~learn).sum()), size, dense[~learn]).times(w) + bias), None, None]
        else:
            used = np.append(np.flatnonzero(w[:size]), np.arange(size, len(w)))
            out = [None, None, np.append(np.where(used < size, used, size - 2 - used), -1).astype(np.int64), np.append(w[used], bias)]
        m = max(len(c) for c in out if c is not None)
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.nulls(m, k) if c is None else pa.array(c, k) for c, k in zip(out, kinds)], ["id", "p", "feature", "weight"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for rows in it:
            parts = rows.column("part").to_numpy()
            cuts = np.flatnonzero(np.diff(parts)) + 1
            for a, e in zip([0, *cuts], [*cuts, len(parts)]):
                if a == e:
                    continue
                if held and parts[a] != part:
                    yield fitted(part, held)
                    held = []
                part = int(parts[a])
                held.append(rows.slice(a, e - a))
        rows = None  # the last batch is in `held` alone
        if held:
            yield fitted(part, held)

    return run


def _known_only(vocabulary: np.ndarray):
    """The features of rows as numbers in the vocabulary, without those that it hasn't."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            own = rows.column("features")
            h, t = own.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(rows.num_rows), np.diff(own.offsets.to_numpy()))
            at = np.searchsorted(vocabulary, h)
            known = np.append(vocabulary, 0)[at] == h
            known &= at < len(vocabulary)
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("y"), _lists(at[known].astype(np.int32), t[known], rows.num_rows)], ["id", "y", "features"])

    return run


def best_threshold(counts: list[tuple[int, int, int]], false_share: float = FALSE_SHARE) -> float:
    """The middle of the thresholds, in hundredths, of the best F1 among those that reject at
    most `false_share` of the rows without the category. `counts`: (hundredth, rows with it, rows without)."""
    scores = {}
    positive, negative = sum(c[1] for c in counts), sum(c[2] for c in counts)
    for at in range(1, 100):
        hit, false = sum(c[1] for c in counts if c[0] >= at), sum(c[2] for c in counts if c[0] >= at)
        if hit and false <= false_share * negative:
            scores[at] = 2 * hit / (positive + hit + false)
    best = [at for at, f1 in scores.items() if f1 == max(scores.values())]
    return sum(best) / len(best) / 100 if best else THRESHOLD


def train(labelled: DataFrame, categories: int, folds: int = FOLDS, penalty: float = PENALTY, steps: int = STEPS) -> tuple[list[tuple[int, int, float]], np.ndarray, float]:
    """(weights, vocabulary, threshold) for a bounded table (id, text, y: array of 0/1): rows
    (category, feature, weight) as _fits numbers features; no weights for an empty table."""
    sample = staged(labelled.select(F.xxhash64("id").alias("id"), "y", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_sample_features, "id long, y array<double>, features array<long>"), "labelled")
    # The fold of an id as an unsigned number, as _fits takes it.
    fold = (F.shiftrightunsigned("id", 1) % folds * 2 + F.col("id").bitwiseAND(F.lit(1))) % folds
    held = [r["count"] for r in sample.groupBy(fold.alias("fold")).count().collect()]
    if not held:
        return [], np.zeros(0, np.int64), THRESHOLD
    # Of the smallest fit's rows a weight needs more than this many.
    least = penalty * (sum(held) - max(held))
    per = sample.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
    vocabulary = np.sort(per.filter(F.col("rows") > least).select("feature").toPandas()["feature"].to_numpy(np.int64))
    x = sample.mapInArrow(_known_only(vocabulary), "id long, y array<double>, features array<int>")
    x = staged(x.withColumn("earlier", F.array().cast("array<double>")), "sample-known")
    weights = []
    for j in range(categories):
        parts = x.withColumn("part", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1)))).repartitionByRange(folds + 1, "part").sortWithinPartitions("part", "id")
        fits = staged(parts.mapInArrow(_fits(len(vocabulary), j, folds, penalty, steps), "id long, p double, feature long, weight double"), "fits")
        weights += [(j, r.feature, r.weight) for r in fits.filter("id is null").select("feature", "weight").collect()]
        found = fits.filter("id is not null").select("id", "p")
        if j < categories - 1:
            x = staged(x.join(found, "id").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p"), "sample-chained")
    scored = x.join(found, "id").groupBy(F.floor(F.col("p") * 100).cast("int").alias("at"), F.col("y")[categories - 1].alias("y")).count().collect()
    return weights, vocabulary, best_threshold([(r["at"], r["count"] * int(r["y"]), r["count"] * int(1 - r["y"])) for r in scored])


def _scored(weights: list[tuple[int, int, float]], vocabulary: np.ndarray, categories: int):
    base, links, own = np.zeros(categories), np.zeros((categories, categories)), np.zeros((categories, len(vocabulary)))
    for j, f, v in weights:
        if f == -1:
            base[j] = v
        elif f < 0:
            links[j, -2 - f] = v
        else:
            own[j, f] = v
    # What weighs nothing need not be looked up.
    used = np.flatnonzero(own.any(axis=0))
    vocabulary, own = vocabulary[used], own[:, used]

    def run(texts: pa.Array) -> np.ndarray:
        """(categories, texts) probabilities."""
        h, t, stem = words(texts, APART, PREFIX)
        h, t = np.append(h, stem[stem > 0]).view(np.int64), np.append(t, t[stem > 0])
        at = np.searchsorted(vocabulary, h)
        hit = (np.append(vocabulary, 0)[at] == h) & (at < len(vocabulary))
        pairs = np.unique(t[hit] * max(1, len(vocabulary)) + at[hit])
        doc, word = np.divmod(pairs, max(1, len(vocabulary)))
        p = np.zeros((categories, len(texts)))
        for j in range(categories):
            p[j] = sigmoid(base[j] + np.bincount(doc, own[j][word], len(texts)) + links[j] @ p)
        return p

    return run


def scored_documents(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float | None = None, penalty: float = PENALTY, steps: int = STEPS) -> DataFrame:
    """Rows (doc, p_<category>..., <last category>), one for each row of docs, with all its
    columns in the struct doc: the probabilities, and whether the last category's is at
    least `threshold` (None: the one that is best out of fold, see best_threshold).

    `categories`: in the order of the chain, a name and a 0/1 expression over labels,
    whose key is `id_col` too. A labelled id with a null label is not learnt from; one
    labelled several times has each category that any of its rows has; of several texts
    of an id the least is learnt from. No labelled rows:
    probabilities are null and nothing is rejected; one class only: about its share.
    Null or empty text: a text without words, scored by the models' constants. Null ids
    are kept and scored, never learnt from. Repeated rows are scored alike. Other columns
    are carried, whatever their names. No documents: no rows.
    """
    names = list(categories)
    marks = labels.select(F.col(id_col).alias("lid"), *[c.cast("double").alias(n) for n, c in categories.items()]).dropna().groupBy("lid").agg(*[F.max(n).alias(n) for n in names])
    chosen = marks.orderBy(F.xxhash64("lid"), "lid").limit(sample).select("lid", F.array(*names).alias("y"))
    # Ids and labels of at most `sample` rows: small enough for every task. Repeated rows are learnt from once.
    learnt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(staged(chosen, "sample")), F.col("id") == F.col("lid"))
    one = learnt.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    weights, vocabulary, found = train(one, len(names), penalty=penalty, steps=steps)
    base = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not weights:
        return base.select("doc", *[F.lit(None).cast("double").alias(f"p_{n}") for n in names], F.lit(False).alias(names[-1]))
    score, least = _scored(weights, vocabulary, len(names)), found if threshold is None else threshold

    @F.arrow_udf("array<double>")
    def probabilities(texts: pa.Array) -> pa.Array:
        p = np.concatenate([np.zeros((len(names), 0)), *(score(texts.slice(a, n)) for a, n in _stretches(texts))], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(p)), pa.array(p.T.ravel()))

    scored = base.select("doc", probabilities("text").alias("p"))
    return scored.select("doc", *[F.col("p")[j].alias(f"p_{n}") for j, n in enumerate(names)], (F.col("p")[len(names) - 1] >= least).alias(names[-1]))


def categories() -> dict[str, Column]:
    """The chain of the labels that the tables have."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), categories())
    return scored.select("doc.doc_id", "p_low_quality", "p_toxic", "toxic")
