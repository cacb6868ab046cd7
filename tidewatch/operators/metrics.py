"""Classification metrics as set operations over (truth, predicted) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.distributions import running_counts, wilson

def one():
    """All rows in one window: for tables of a few rows, as results by class or score."""
    return Window.partitionBy(F.lit(0))


def confusion(df: DataFrame, truth: str, predicted: str, keys: list[str] = []) -> DataFrame:
    """Rows (*keys, actual, predicted, n) for every pair of labels seen on either side."""
    n = df.groupBy(*keys, F.col(truth).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    labels = n.select(*keys, F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    left, right = labels.withColumnRenamed("label", "actual"), labels.withColumnRenamed("label", "predicted")
    # The grid is as large as the label set squared, whatever the number of rows.
    grid = left.join(right, keys) if keys else left.crossJoin(right)
    return grid.join(n, [*keys, "actual", "predicted"], "left").na.fill(0, ["n"])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def per_class(matrix: DataFrame, keys: list[str] = []) -> DataFrame:
    """Rows (*keys, label, precision, recall, f1, support, fpr) of a confusion table; 0 for 0/0."""
    both = matrix.select(*keys, F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("x")).select(*keys, "x.*")
    c = both.groupBy(*keys, "label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    total = F.sum("support").over(Window.partitionBy(*keys) if keys else one())
    c = c.withColumn("total", total).withColumn("precision", _ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    p, r, fp = F.col("precision"), F.col("recall"), F.col("predicted") - F.col("tp")
    return c.withColumn("f1", _ratio(2 * p * r, p + r)).withColumn("fpr", _ratio(fp, F.col("total") - F.col("support"))).select(*keys, "label", "precision", "recall", "f1", "support", "fpr", "predicted", "tp")


def summary(classes: DataFrame, keys: list[str] = []) -> DataFrame:
    """One row for each of keys: accuracy, balanced accuracy, macro and weighted averages, macro
    false positive rate, Matthews correlation and the recall of the rarest classes."""
    group = Window.partitionBy(*keys) if keys else one()
    least = F.min(F.when(F.col("support") > 0, F.col("support"))).over(group)
    c = classes.withColumn("rare", F.when(F.col("support") == least, F.col("recall")))
    w = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    s, hit = F.sum("support"), F.sum("tp")
    cov = hit * s - F.sum(F.col("support") * F.col("predicted"))
    norm = F.sqrt((s * s - F.sum(F.col("predicted") * F.col("predicted"))).cast("double")) * F.sqrt((s * s - F.sum(F.col("support") * F.col("support"))).cast("double"))
    return c.groupBy(*keys).agg(
        (hit / s).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), *[F.avg(x).alias(f"macro_{x}") for x in ("precision", "recall", "f1", "fpr")],
        *[w(x).alias(f"weighted_{x}") for x in ("precision", "recall", "f1")], F.when(norm > 0, cov / norm).otherwise(0.0).alias("mcc"), F.avg("rare").alias("rare_recall"),
    )


def precision_recall(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Rows (*keys, score, precision, recall, n_positive), one for each distinct score, falling.

    Scores are counted first, so the running sums go over distinct scores.
    """
    c = df.groupBy(*keys, score).agg(F.count_if(positive).alias("pos"), F.count(F.lit(1)).alias("n"))
    c = running_counts(c, keys, score, ["pos", "n"], falling=True)
    c = c.withColumnsRenamed({"pos_upto": "tp", "n_upto": "said", "pos_all": "n_positive", "n_all": "n_every"})
    mixed = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_every"))
    return c.filter(mixed).select(*keys, score, (F.col("tp") / F.col("said")).alias("precision"), (F.col("tp") / F.col("n_positive")).alias("recall"), "n_positive", (F.col("pos") / F.col("n_positive")).alias("step"))


def average_precision(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Rows (*keys, average_precision): the sum of precision over the steps in recall; null where all
    rows are positive or none is."""
    curve = precision_recall(df, keys, score, positive)
    area = curve.groupBy(*keys).agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"))
    return df.select(*keys).distinct().join(area, keys, "left")


def compacted(curve: DataFrame, keys: list[str], score: str, points: int = 256) -> DataFrame:
    """At most `points` rows (*keys, score, precision, recall) of a curve for each of keys: the thresholds
    at points - 1 even steps, rounded down, from the least to the greatest one, and the closing
    point, precision 1 and recall 0, which has no threshold."""
    c = running_counts(curve.withColumn("one", F.lit(1)), keys, score, ["one"])
    c = c.select(*keys, score, "precision", "recall", (F.col("one_upto") - 1).alias("i"), (F.col("one_all") - 1).alias("last"))
    steps = F.lit(points - 2)
    # The first step that reaches row i, rounded down, must be row i itself.
    step = F.when(F.col("last") > 0, F.ceil(F.col("i") * steps / F.col("last"))).otherwise(0)
    keep = (F.col("last") < points - 1) | (F.floor(step * F.col("last") / steps) == F.col("i"))
    closing = curve.select(*keys).distinct().select(*keys, F.lit(None).cast(dict(curve.dtypes)[score]).alias(score), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return c.filter(keep).drop("i", "last").unionByName(closing)


def evaluation_view(rows: DataFrame, versions: dict[str, str], promoted_seed: int) -> DataFrame:
    """One row for each candidate (stage, model) of predictions (stage, model, seed, part, truth, predicted), parts
    being validation and test: the mean and the range of its validation macro F1 over the seeds, whether it is
    selected by that mean (of equal ones the first name), the version of what was promoted, and of the promoted seed the
    compact metrics of both parts, the confusion and the support of each class in the test part.

    A macro false positive rate is told for the stage binary only; among families it isn't an operating figure.
    """
    keys = ["stage", "model", "seed", "part"]
    matrix = confusion(rows, "truth", "predicted", keys)
    classes = per_class(matrix, keys)
    s = summary(classes, keys)
    runs = s.filter("part = 'validation'").groupBy("stage", "model").agg(F.avg("macro_f1").alias("selection_value"), F.min("macro_f1").alias("least_macro_f1"), F.max("macro_f1").alias("most_macro_f1"), F.count(F.lit(1)).alias("n_seeds"))
    best = Window.partitionBy("stage").orderBy(F.desc(F.round("selection_value", 9)), "model")  # a row for each candidate
    runs = runs.withColumn("selected", F.row_number().over(best) == 1)
    version = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv]) if versions else F.create_map().cast("map<string,string>")
    runs = runs.withColumn("model_version", F.when(F.col("selected"), F.element_at(version, F.col("stage"))).otherwise("evaluation-only"))
    own = s.filter(F.col("seed") == promoted_seed)
    of = lambda part: own.filter(F.col("part") == part).select("stage", "model", *[F.col(c).alias(f"{part}_{c}") for c in ("macro_f1", "weighted_f1", "accuracy", "balanced_accuracy", "mcc")], F.when(F.col("stage") == "binary", F.col("macro_fpr")).alias(f"{part}_false_positive_rate"))
    test = (F.col("seed") == promoted_seed) & (F.col("part") == "test")
    cells = matrix.filter(test).groupBy("stage", "model").agg(F.array_sort(F.collect_list(F.struct("actual", "predicted", "n"))).alias("confusion"))
    support = classes.filter(test).groupBy("stage", "model").agg(F.array_sort(F.collect_list(F.struct("label", "support"))).alias("class_support"))
    out = runs
    for side in (of("validation"), of("test"), cells, support):
        out = out.join(side, ["stage", "model"], "left")
    return out


def threshold_sweep(df: DataFrame, score: str, positive: Column, steps: int = 100) -> DataFrame:
    """Rows (threshold, recall, precision, fpr, alert_rate) for 0, 1/steps, ..., 1, a row being
    called positive from the threshold on.

    A score is counted at the last threshold that it reaches; sums from above give every
    threshold from one pass.
    """
    at = F.least(F.lit(steps), F.floor(F.round(F.col(score) * steps, 9))).cast("int")
    c = df.filter(F.col(score) >= 0).groupBy(at.alias("i")).agg(F.count_if(positive).alias("pos"), F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    c = every.join(c, "i", "left").na.fill(0, ["pos", "n"])
    run = one().orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"tp": F.sum("pos").over(run), "said": F.sum("n").over(run), "p": F.sum("pos").over(one()), "all": F.sum("n").over(one())})
    fp = F.col("said") - F.col("tp")
    return c.select((F.col("i") / steps).alias("threshold"), _ratio(F.col("tp"), F.col("p")).alias("recall"), _ratio(F.col("tp"), F.col("said")).alias("precision"), _ratio(fp, F.col("all") - F.col("p")).alias("fpr"), _ratio(F.col("said"), F.col("all")).alias("alert_rate"))


def binary_extras(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    tp, fp, p, n, s = (F.count_if(c) for c in (truth & said, ~truth & said, truth, ~truth, said))
    r, q = _ratio(tp, p), _ratio(tp, s)
    return df.agg(_ratio(fp, n).alias("normal_fpr"), _ratio(s, F.count(F.lit(1))).alias("alert_rate"), q.alias("attack_precision"), r.alias("attack_recall"), _ratio(2 * q * r, q + r).alias("attack_f1"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows (gate, value, low, high, passed, promoted): metrics (gate, value, support) against
    (gate, bound, at_least, minimum_support); all must pass."""
    j = thresholds.join(metrics, "gate", "left")
    ok = F.when(F.col("at_least"), F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound")) & (F.col("support") >= F.col("minimum_support"))
    low, high = wilson(F.col("value") * F.col("support"), F.col("support"))
    j = j.withColumn("passed", F.coalesce(ok, F.lit(False)))
    return j.select("gate", "value", low.alias("low"), high.alias("high"), "passed", F.bool_and("passed").over(one()).alias("promoted"))
