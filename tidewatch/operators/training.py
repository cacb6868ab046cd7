"""Training, calibration and scoring of detectors and family classifiers with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scratch import staged

from .predictors import Decision

MISSING = "__missing__"
#: Bins of a number, as many as Spark's trees make of it; quantiles that they are made of; how many rows a cell must
#: stand for on average; trees of a forest that are fitted beside each other, and cells in a task of theirs and of other fits.
BINS, GRID, ROWS_A_CELL, TREES_AT_ONCE, TREE_CELLS, FIT_CELLS = 32, 1024, 4, 8, 1 << 19, 1 << 16


def preprocessing(numeric: list[str], categorical: list[str], scale: bool, edges: list[list[float]] | None = None) -> list:
    """Stages from columns to `features`: medians for missing numbers, one-hot categories of
    which unknown ones are all zero, standard scores for linear models. With `edges` a number is its bin."""
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric])]
    if edges:
        stages.append(Bucketizer(splitsArray=[[-np.inf, *e, np.inf] for e in edges], inputCols=[f"{c}__i" for c in numeric], outputCols=[f"{c}__b" for c in numeric]))
    stages.append(VectorAssembler(inputCols=[f"{c}__b" if edges else f"{c}__i" for c in numeric], outputCol="__numeric"))
    if scale:
        stages.append(StandardScaler(inputCol="__numeric", outputCol="__scaled", withMean=True))
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"{c}__x" for c in categorical], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__x" for c in categorical], outputCols=[f"{c}__h" for c in categorical], handleInvalid="keep", dropLast=True))
    stages.append(VectorAssembler(inputCols=["__scaled" if scale else "__numeric", *[f"{c}__h" for c in categorical]], outputCol="features"))
    return stages


def filled(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Missing categories take the commonest value of the column."""
    if not categorical:
        return df
    mode = df.agg(*[F.mode(c).alias(c) for c in categorical]).first()
    return df.fillna({c: mode[c] or MISSING for c in categorical})


def candidates(classes: int, seed: int = 42, small: bool = False) -> dict[str, object]:
    """The four models to compare. `small`: for a quick comparison, with fewer and flatter trees."""
    own = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    boosted = GBTClassifier(maxIter=10 if small else 80, stepSize=0.08, maxDepth=5, seed=seed, **own)
    return {
        "logistic": LogisticRegression(maxIter=50 if small else 600, **own),
        "tree": DecisionTreeClassifier(maxDepth=6 if small else 14, minInstancesPerNode=2, seed=seed, **own),
        "forest": RandomForestClassifier(numTrees=10 if small else 80, maxDepth=6 if small else 18, minInstancesPerNode=2, seed=seed, cacheNodeIds=True, **own),
        "boosting": boosted if classes == 2 else OneVsRest(classifier=GBTClassifier(maxIter=10 if small else 80, stepSize=0.08, maxDepth=5, seed=seed, featuresCol="features", labelCol="label"), featuresCol="features", labelCol="label", weightCol="weight", parallelism=classes),
    }


@dataclass
class Fitted:
    """A model with its labels, in the order of its classes, and what it decides by."""

    pipeline: PipelineModel
    labels: list[str]
    margins: str = "probability"
    slopes: tuple[float, ...] = ()
    intercepts: tuple[float, ...] = ()

    def predictor(self, prefix: str = "m") -> PipelineModel:
        """A transformer that adds <prefix>_label, <prefix>_score and <prefix>_probability (an array); it can be saved."""
        decision = Decision(labels=self.labels, margins=self.margins, slopes=list(self.slopes), intercepts=list(self.intercepts), prefix=prefix)
        return PipelineModel([*self.pipeline.stages, decision])

    def applied(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Of df the columns `keep`, written once beside the margins of its rows, for `calibrate` and `decided`."""
        out = self.pipeline.transform(df)
        return staged(out.select(*keep, *[c for c in ("rawPrediction", "probability") if c in out.columns]), "margins")

    def decided(self, applied: DataFrame, prefix: str) -> DataFrame:
        """What `score` adds, to rows of `applied`."""
        return self.predictor(prefix).stages[-1].transform(applied).drop("rawPrediction", "probability")

    def score(self, df: DataFrame, prefix: str) -> DataFrame:
        """df with <prefix>_label and <prefix>_probability (an array)."""
        return self.predictor(prefix).transform(df).select(*[F.col(f"`{c}`") for c in df.columns], f"{prefix}_label", f"{prefix}_probability")


@dataclass
class Prepared:
    """Rows (label, weight, features) that models are fitted on, and how they came about."""

    stages: list
    labels: list[str]
    rows: DataFrame
    #: How many cells (label, weight, n, x) rows are, where x are the features as an array and n how many rows it stands for; 0 where they are no cells.
    cells: int = 0


def bin_edges(df: DataFrame, numeric: list[str]) -> list[list[float]]:
    """For each number the edges of BINS bins at most, of all rows: between any two of its values where they are few."""
    out = []
    for values in df.approxQuantile(numeric, [i / GRID for i in range(GRID + 1)], 1 / (4 * GRID)):
        own = np.unique(values)
        if len(own) > BINS:
            own = np.unique(values[:: GRID // BINS][:-1])
        out.append([float(x) for x in (own[1:] + own[:-1]) / 2] or [0.0])
    return out


def prepare_cells(weighted: DataFrame, labels: list[str], numeric: list[str], categorical: list[str]) -> Prepared:
    """Rows that agree in their label, in the bins of their numbers and in their categories as one, with their number.

    A tree sees of a number only its bin, so fits on cells are those on rows. There are as many cells as
    combinations of bins and categories, whatever the number of rows.
    """
    fitted = Pipeline(stages=preprocessing(numeric, categorical, False, bin_edges(weighted, numeric))).fit(weighted)
    (imputer, bins), rest = fitted.stages[:2], PipelineModel(fitted.stages[2:])
    keys = ["label", "weight", *categorical, *[f"{c}__b" for c in numeric]]
    grouped = bins.transform(imputer.transform(weighted)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    cells = rest.transform(grouped).select("label", "weight", "n", vector_to_array("features").alias("x"))
    cells = staged(cells, "cells")
    return Prepared(fitted.stages, labels, cells, cells.count())


def prepare(df: DataFrame, target: str, numeric: list[str], categorical: list[str], scale: bool, cells_from: int | None = None) -> Prepared:
    """df as models take it; its classes weigh alike. Labels and weights are found once, not in every pass of a fit.

    For trees, from `cells_from` rows on, rows that are the same to them are one cell if this makes them much fewer.
    """
    sizes = dict(tuple(r) for r in df.groupBy(target).agg(F.count(F.lit(1))).collect())  # a handful of classes
    labels = sorted(sizes)
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(target)) - 1
    weights = F.array(*[F.lit(sum(sizes.values()) / (len(labels) * sizes[x])) for x in labels])
    weighted = filled(df, categorical).withColumn("label", index.cast("double")).withColumn("weight", F.get(weights, index.cast("int")))
    n = sum(sizes.values())
    if cells_from is not None and not scale and numeric and n >= cells_from:
        cells = prepare_cells(weighted, labels, numeric, categorical)
        if cells.cells * ROWS_A_CELL <= n:
            return cells
    fitted = Pipeline(stages=preprocessing(numeric, categorical, scale)).fit(weighted)
    return Prepared(fitted.stages, labels, fitted.transform(weighted).select("label", "weight", "features"))


def _instances(cells: DataFrame, labels: list[str]) -> DataFrame:
    """Cells (label, weight, x) as models take them; their classes are all `labels`, whichever of them they have."""
    named = F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "vals": labels}})
    return cells.select(named, "weight", array_to_vector("x").alias("features"))


def _drawn(least: int, seed: int | None = None):
    """Cells to instances (label, weight, x) of all their rows, or of a bootstrap sample of them: a row is drawn as often as
    Poisson's distribution of mean 1 says, so the n rows of a cell together by that of mean n. A cell is as many
    instances as it has rows, `least` at most, so that a least number for a leaf holds for rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed or 0, TaskContext.get().partitionId()])
        for cells in it:
            n = cells.column("n").to_numpy()
            n = n if seed is None else rng.poisson(n)
            at = np.repeat(np.arange(len(n)), np.minimum(n, least))
            own = cells.take(pa.array(at))
            weight = own.column("weight").to_numpy() * n[at] / np.minimum(n[at], least)
            yield pa.RecordBatch.from_arrays([own.column("label"), pa.array(weight), own.column("x")], ["label", "weight", "x"])

    return run


def _instances_drawn(prepared: Prepared, least: int, in_task: int, seed: int | None = None) -> DataFrame:
    cells = prepared.rows.coalesce(-(-prepared.cells // in_task))
    return _instances(cells.mapInArrow(_drawn(least, seed), "label double, weight double, x array<double>"), prepared.labels)


def fit_forest(prepared: Prepared, model: RandomForestClassifier) -> RandomForestClassificationModel:
    """A forest on cells: each tree on its own bootstrap sample of the rows that they stand for."""
    trees = model.getNumTrees()
    strategy = model.getFeatureSubsetStrategy()
    if strategy == "auto":  # as for a forest of so many trees
        strategy = "sqrt" if trees > 1 else "all"
    single = model.copy({model.numTrees: 1, model.featureSubsetStrategy: strategy, model.bootstrap: False, model.cacheNodeIds: False})
    seeds = random.Random(model.getSeed()).sample(range(1, 1 << 31), trees)

    def tree(seed):
        rows = _instances_drawn(prepared, model.getMinInstancesPerNode(), TREE_CELLS, seed if model.getBootstrap() else None).persist()
        try:
            return single.copy({single.seed: seed}).fit(rows)
        finally:
            rows.unpersist()

    spark = prepared.rows.sparkSession
    with ThreadPool(min(TREES_AT_ONCE, trees)) as pool:
        fits = pool.map(inheritable_thread_target(spark)(tree), seeds, chunksize=1)
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.spark.ml.classification
    own = gateway.new_array(jvm.DecisionTreeClassificationModel, trees)
    for i, f in enumerate(fits):
        own[i] = f._java_obj.trees()[0]
    return model._copyValues(RandomForestClassificationModel(jvm.RandomForestClassificationModel(model.uid, own, fits[0].numFeatures, fits[0].numClasses)))


def _fit_cells(prepared: Prepared, model):
    if isinstance(model, RandomForestClassifier):
        return fit_forest(prepared, model)
    tree = model.getClassifier() if isinstance(model, OneVsRest) else model
    rows = _instances_drawn(prepared, tree.getMinInstancesPerNode(), FIT_CELLS).persist()
    try:
        return model.fit(rows)
    finally:
        rows.unpersist()


def fit_prepared(prepared: Prepared, model) -> Fitted:
    """`model` on prepared rows."""
    own = _fit_cells(prepared, model) if prepared.cells else model.fit(prepared.rows)
    fitted, labels = PipelineModel([*prepared.stages, own]), prepared.labels
    # One against the rest has margins only.
    return Fitted(fitted, labels, "rawPrediction" if isinstance(model, OneVsRest) else "probability", *(((1.0,) * len(labels), (0.0,) * len(labels)) if isinstance(model, OneVsRest) else ()))


def fit(df: DataFrame, target: str, numeric: list[str], categorical: list[str], model) -> Fitted:
    """`model` on df, whose classes weigh alike."""
    return fit_prepared(prepare(df, target, numeric, categorical, isinstance(model, LogisticRegression)), model)


def platt(df: DataFrame, margins: Column, truth: Column, classes: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(slopes, intercepts): for each class a sigmoid over its margin (an array has them), fitted to whether truth, a
    number of a class, is that class. Targets are drawn in by the counts of both sides, so that margins that
    part the classes wholly keep a finite slope.

    All sigmoids are one regression: a row stands once for each class and target, in features of its class only.
    """
    long = df.select(truth.cast("int").alias("y"), F.posexplode(margins).alias("k", "s")).select("k", F.col("s").cast("double"), (F.col("y") == F.col("k")).alias("own"))
    sizes = long.groupBy("k").agg(F.count_if("own").alias("pos"), F.count_if(~F.col("own")).alias("neg"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd")).orderBy("k").collect()  # a row for each class
    scale = [(r["mean"], r["sd"] or 1.0) for r in sizes]
    of = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("k"))
    target = F.when(F.col("own"), of([(r["pos"] + 1) / (r["pos"] + 2) for r in sizes])).otherwise(of([1 / (r["neg"] + 2) for r in sizes]))
    z = (F.col("s") - of([m for m, _ in scale])) / of([d for _, d in scale])
    rows = long.select("k", z.alias("z"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("weight")))).alias("t"))
    rows = rows.groupBy("k", "z", "t.label").agg(F.sum("t.weight").alias("weight"))  # trees give few margins
    cells = [F.when(F.col("k") == k, c).otherwise(0.0) for k in range(classes) for c in (F.col("z"), F.lit(1.0))]
    m = LogisticRegression(maxIter=200, tol=1e-9, fitIntercept=False, standardization=False, weightCol="weight").fit(rows.select("label", "weight", array_to_vector(F.array(*cells)).alias("features")))
    c = list(m.coefficients.toArray())
    slopes = [c[2 * k] / scale[k][1] for k in range(classes)]
    return tuple(map(float, slopes)), tuple(float(c[2 * k + 1] - slopes[k] * scale[k][0]) for k in range(classes))


def calibrate(fitted: Fitted, validation: DataFrame, target: str) -> Fitted:
    """fitted with a sigmoid for each class, from rows that it wasn't fitted on; as it is if these have one class only.

    Linear and boosted models have margins, of trees the shares of votes are taken.
    """
    return calibrate_applied(fitted, fitted.applied(validation, [target]), target)


def calibrate_applied(fitted: Fitted, applied: DataFrame, target: str) -> Fitted:
    """`calibrate` from the margins of `applied`, so that the model runs over the rows once."""
    known = applied.filter(F.col(target).isin(fitted.labels))
    if known.select(target).distinct().count() < 2:
        return fitted
    model = fitted.pipeline.stages[-1]
    margins = "probability" if isinstance(model, (DecisionTreeClassificationModel, RandomForestClassificationModel)) else "rawPrediction"
    index = F.array_position(F.array(*[F.lit(x) for x in fitted.labels]), F.col(target)) - 1
    slopes, intercepts = platt(known, vector_to_array(margins), index, len(fitted.labels))
    return replace(fitted, margins=margins, slopes=slopes, intercepts=intercepts)


def log_loss(df: DataFrame, truth: str, probability: str, labels: list[str]) -> float:
    """The mean negative logarithm of the true label's probability."""
    p = F.get(F.col(probability), (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(truth)) - 1).cast("int"))
    return df.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15))))).first()[0]


def cascade(df: DataFrame, detector: Fitted, classifier: Fitted, normal: str = "normal") -> DataFrame:
    """Scores all rows by the detector and, of these, only what it calls an attack by the
    classifier. `confidence` is the probability of the label that was chosen."""
    d = detector.score(df, "detector")
    chosen = lambda prefix: F.array_max(F.col(f"{prefix}_probability"))
    d = d.withColumn("confidence", chosen("detector"))
    attacks = classifier.score(d.filter(F.col("detector_label") != normal), "family")
    attacks = attacks.select(*d.columns, F.col("family_label").alias("attack_class"), F.col("family_probability").alias("scores"))
    quiet = d.filter(F.col("detector_label") == normal).select(*d.columns, F.lit(None).cast("string").alias("attack_class"), F.lit(None).cast("array<double>").alias("scores"))
    names = F.array(*[F.lit(x) for x in classifier.labels])
    return attacks.unionByName(quiet).withColumn("class_scores", F.when(F.col("scores").isNotNull(), F.map_from_arrays(names, F.col("scores")))).drop("scores")
