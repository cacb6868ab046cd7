"""Drift of features and outputs against a reference, many features and cohorts in one pass.

Wide rows are unpivoted once; everything after is grouped by (cohort..., feature).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import distributions as S
from tidewatch.functions.identity import digest_tree
from tidewatch.functions.scratch import staged

OTHER = "__OTHER__"


def long_numeric(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Rows (*keys, feature, x); what isn't finite is left out."""
    wide = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    return wide.unpivot(keys, features, "feature", "x").filter("x is not null and not isnan(x) and abs(x) < double('infinity')")


def long_categorical(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in features]).unpivot(keys, features, "feature", "x").filter("x is not null")


def numeric_reference(long: DataFrame, keys: list[str] = [], bins: int = 20) -> DataFrame:
    """Rows (*keys, feature, n, min, max, q05, q50, q95, edges)."""
    levels = [*(i / bins for i in range(bins + 1)), 0.05, 0.5, 0.95]
    # Counted and written once: ranks are found in several passes over the counts.
    c, by = staged(S.counted(long, [*keys, "feature"], "x"), "counted"), [*keys, "feature"]
    r = c.groupBy(*by).agg(F.sum("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max")).join(S.quantiles(c, by, "x", levels, "all"), by)
    r = r.withColumn("e", F.slice("all", 1, bins + 1)).withColumn("q", F.slice("all", bins + 2, 3))
    e = F.array_sort(F.array_distinct("e"))
    pad = F.greatest(F.abs(F.col("e")[0]) * 1e-9, F.lit(1e-9))
    r = r.withColumn("edges", F.when(F.size(e) == 1, F.array(F.col("e")[0] - pad, F.col("e")[0] + pad)).otherwise(e))
    return r.select(*keys, "feature", "n", "min", "max", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"), "edges")


def histogram(long: DataFrame, reference: DataFrame, keys: list[str] = []) -> DataFrame:
    """Rows (*keys, feature, bin, n) of values or counted values. The reference has one row for each
    feature, of tens of edges. Rows that have a bin and n already are added up."""
    if "bin" in long.columns:
        return long.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))
    binned = S.counted(long, [*keys, "feature"], "x").join(F.broadcast(reference.select("feature", "edges")), "feature")
    return binned.groupBy(*keys, "feature", S.bin_of(F.col("x"), F.col("edges")).alias("bin")).agg(F.sum("n").alias("n"))


def newest(df: DataFrame, keys: list[str], order: list[Column], count: int, salt: Column, parts: int = 64) -> DataFrame:
    """The first `count` rows of each key in an order. Each of `parts` shares of a key, by `salt`, gives its own
    first rows, so that no task sorts all rows of a key."""
    share = F.pmod(F.xxhash64(salt), F.lit(parts))
    some = df.withColumn("__s", share).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(*order))).filter(F.col("__r") <= count)
    return some.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= count).drop("__s", "__r")


#: Leading hex digits of a digest that are counted before a sample is sorted.
SAMPLE_DIGITS = 4


def reference_sample(long: DataFrame, id_col: str, size: int = 2000) -> DataFrame:
    """Rows (feature, x): the `size` rows of each feature whose ids have the least digests."""
    d = long.withColumn("__d", F.md5(F.concat_ws("|", "feature", F.col(id_col).cast("string")))).withColumn("__b", F.substring("__d", 1, SAMPLE_DIGITS))
    # Counts of leading digits tell how far the sample can reach; only rows up to there are sorted.
    sizes = d.groupBy(F.col("feature").alias("__f"), "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = sizes.withColumn("__before", before).filter(F.col("__before") < size).groupBy("__f").agg(F.max("__b").alias("__upto"))
    some = d.join(F.broadcast(reach), (F.col("feature") == F.col("__f")) & (F.col("__b") <= F.col("__upto"))).drop("__f", "__b", "__upto")
    return newest(some, ["feature"], [F.col("__d"), F.col(id_col), F.col("x")], size, F.col("__d")).select("feature", "x")


def histogram_distance(reference: DataFrame, reference_rows: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (*keys, feature, js) of the histograms of rows (*keys, feature, x) over the reference's edges."""
    return binned_distance(reference, histogram(reference_rows, reference), histogram(current, reference, keys), keys)


def binned_distance(reference: DataFrame, ref_hist: DataFrame, cur_hist: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (*keys, feature, js) of histograms (feature, bin, n) and (*keys, feature, bin, n)."""
    ref_hist = ref_hist.withColumnRenamed("n", "n_ref")
    # Every bin of the reference's edges, under- and overflow too, for every group.
    bins = reference.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    grid = cur_hist.select(*keys, "feature").distinct().join(F.broadcast(bins), "feature")
    full = grid.join(F.broadcast(ref_hist), ["feature", "bin"], "left").join(cur_hist, [*keys, "feature", "bin"], "left").na.fill(0, ["n_ref", "n"])
    full = full.withColumn("p", S.smoothed(F.col("n_ref"), *keys, "feature")).withColumn("q", S.smoothed(F.col("n"), *keys, "feature"))
    return full.groupBy(*keys, "feature").agg(S.js_distance(F.col("p"), F.col("q")).alias("js"))


def sample_distance(sample: DataFrame, counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (*keys, feature, ks, p) of counts (*keys, feature, value, n) against a stored sample (feature, value)."""
    # A sample of a fixed size for each feature meets every group.
    groups = counts.select(*keys, "feature").distinct()
    ref_side = groups.join(F.broadcast(sample), "feature").select(*keys, "feature", value, F.lit(1).cast("long").alias("n"), F.lit(0).alias("side"))
    both = ref_side.unionByName(counts.select(*keys, "feature", value, "n", F.lit(1).alias("side")))
    ks = S.ks_statistic(both, [*keys, "feature"], value, "side", "n")
    return ks.withColumn("p", S.kolmogorov_p(F.col("ks"), F.col("n_ref"), F.col("n_cur"))).drop("n_ref", "n_cur")


def numeric_drift(reference: DataFrame, reference_rows: DataFrame, sample: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (*keys, feature, js, ks, p, exceed_rate, ref_median, ref_p95, cur_median, cur_p95)."""
    # Values are counted once; all else is read off the counts.
    counts = S.counted(current, [*keys, "feature"], "x")
    js = histogram_distance(reference, reference_rows, counts, keys)
    ks = sample_distance(sample, counts, keys, "x")
    r = reference.select("feature", "min", "max", F.col("q50").alias("ref_median"), F.col("q95").alias("ref_p95"))
    out = (F.col("x") < F.col("min")) | (F.col("x") > F.col("max"))
    level = counts.join(F.broadcast(r), "feature").groupBy(*keys, "feature").agg((F.sum(F.when(out, F.col("n")).otherwise(0)) / F.sum("n")).alias("exceed_rate"), F.first("ref_median").alias("ref_median"), F.first("ref_p95").alias("ref_p95"))
    level = level.join(S.quantiles(counts, [*keys, "feature"], "x", [0.5, 0.95]), [*keys, "feature"])
    level = level.select(*keys, "feature", "exceed_rate", "ref_median", "ref_p95", F.col("q")[0].alias("cur_median"), F.col("q")[1].alias("cur_p95"))
    return js.join(ks, [*keys, "feature"]).join(level, [*keys, "feature"])


def categorical_drift(vocabulary: DataFrame, current: DataFrame, keys: list[str], top: int = 20) -> DataFrame:
    """Rows (*keys, feature, js, n_unseen, unseen_rate, unseen) of counts (feature, x, n_ref).

    Values out of the vocabulary share one bin; `unseen` lists the commonest of them.
    """
    counted = S.counted(current, [*keys, "feature"], "x")
    joined = counted.join(vocabulary, ["feature", "x"], "left")
    bins = joined.groupBy(*keys, "feature", F.when(F.col("n_ref").isNull(), OTHER).otherwise(F.col("x")).alias("bin")).agg(F.sum("n").alias("n"))
    known = vocabulary.select("feature", F.col("x").alias("bin"), "n_ref")
    every = known.unionByName(known.select("feature").distinct().select("feature", F.lit(OTHER).alias("bin"), F.lit(0).cast("long").alias("n_ref")))
    grid = counted.select(*keys, "feature").distinct().join(every, "feature")
    full = grid.join(bins, [*keys, "feature", "bin"], "left").na.fill(0, ["n"])
    js = full.withColumn("p", S.smoothed(F.col("n_ref"), *keys, "feature")).withColumn("q", S.smoothed(F.col("n"), *keys, "feature")).groupBy(*keys, "feature").agg(S.js_distance(F.col("p"), F.col("q")).alias("js"), F.sum("n").alias("total"))
    new = joined.filter("n_ref is null")
    w = Window.partitionBy(*keys, "feature").orderBy(F.desc("n"), "x")
    listed = new.withColumn("r", F.row_number().over(w)).groupBy(*keys, "feature").agg(F.sum("n").alias("n_unseen"), F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "x", "n")))).alias("l"))
    out = js.join(listed, [*keys, "feature"], "left").withColumn("n_unseen", F.coalesce("n_unseen", F.lit(0)))
    names = F.array_join(F.transform("l", lambda r: F.concat(r["x"], F.lit(":"), r["n"].cast("string"))), ",")
    return out.select(*keys, "feature", "js", "n_unseen", (F.col("n_unseen") / F.col("total")).alias("unseen_rate"), F.coalesce(names, F.lit("")).alias("unseen"))


def judge_features(numeric: DataFrame, categorical: DataFrame, thresholds: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Rows (*keys, feature, kind, js, q, threshold, ratio, drifted): numeric ones need effect and significance."""
    n = S.benjamini_hochberg(numeric, "p", keys, "feature").select(*keys, "feature", F.lit("numeric").alias("kind"), "js", "q")
    c = categorical.select(*keys, "feature", F.lit("categorical").alias("kind"), "js", F.lit(None).cast("double").alias("q"))
    j = n.unionByName(c).join(F.broadcast(thresholds), "feature")
    sure = F.when(F.col("kind") == "numeric", F.col("q") <= alpha).otherwise(True)
    return j.withColumn("ratio", F.col("js") / F.greatest("threshold", F.lit(1e-12))).withColumn("drifted", (F.col("js") > F.col("threshold")) & sure)


def window_status(judged: DataFrame, keys: list[str]) -> DataFrame:
    return judged.groupBy(*keys).agg(F.max("ratio").alias("aggregate_score"), F.count_if("drifted").alias("n_drifted"), F.when(F.bool_or("drifted"), "warning").otherwise("healthy").alias("status"))


LABELS, SCORES = ["detector_labels", "classifier_labels"], ["detector_scores", "classifier_scores"]
#: Classifier scores are judged from so many on; the others from one.
CLASSIFIER_SUPPORT = 200


def output_rows(df: DataFrame, keys: list[str], detector_label: Column, detector_score: Column, classifier_label: Column, classifier_score: Column) -> tuple[DataFrame, DataFrame]:
    """(labels, scores): rows (*keys, feature, x) of what a model put out, in the names of LABELS and SCORES; nulls are left out."""
    o = df.select(*keys, *[c.alias(n) for c, n in zip((detector_label, classifier_label, detector_score, classifier_score), LABELS + SCORES)])
    return long_categorical(o, keys, LABELS), long_numeric(o, keys, SCORES)


def output_references(labels: DataFrame, scores: DataFrame, calibration_labels: DataFrame, calibration_scores: DataFrame, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, numeric reference) of the outputs of a baseline, of which a metric has
    none unless it has a baseline value and `least` values to calibrate its threshold with."""
    enough = lambda c: c.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("feature")
    vocabulary = labels.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n_ref")).join(F.broadcast(enough(calibration_labels)), "feature", "left_semi")
    return vocabulary, numeric_reference(scores).join(F.broadcast(enough(calibration_scores)), "feature", "left_semi")


def output_metrics(vocabulary: DataFrame, reference: DataFrame, reference_scores: DataFrame, labels: DataFrame, scores: DataFrame, thresholds: DataFrame, keys: list[str], rate: float, rate_threshold: float, attack: str = "attack", support: int = CLASSIFIER_SUPPORT) -> DataFrame:
    """Rows (*keys, metric, n, value, threshold, ratio, drifted, status), for each group one for
    each metric: label and score distances from the references, and how far the share of
    `attack` among the detector's labels moved from `rate`. What has no reference, no values
    or too few classifier scores is collecting. Thresholds: rows (feature, threshold).
    Labels may be counted (n), scores counted and binned (bin, n)."""
    weighed = lambda df: df if "n" in df.columns else df.withColumn("n", F.lit(1).cast("long"))
    labels, scores = weighed(labels), weighed(scores)
    counts = labels.select(*keys, "feature", "n").unionByName(scores.select(*keys, "feature", "n")).groupBy(*keys, "feature").agg(F.sum("n").alias("n"))
    known = lambda df, ref: df.join(F.broadcast(ref.select("feature").distinct()), "feature", "left_semi")
    js = categorical_drift(vocabulary, known(labels, vocabulary), keys).select(*keys, "feature", "js")
    js = js.unionByName(histogram_distance(reference, known(reference_scores, reference), known(scores, reference), keys).select(*keys, "feature", "js"))
    groups = labels.select(*keys).distinct().withColumn("feature", F.explode(F.array(*[F.lit(x) for x in LABELS + SCORES])))
    every = groups.join(counts, [*keys, "feature"], "left").join(js, [*keys, "feature"], "left").join(F.broadcast(thresholds), "feature", "left").na.fill(0, ["n"])
    least = F.when(F.col("feature") == SCORES[1], support).otherwise(1)
    every = every.select(*keys, F.col("feature").alias("metric"), "n", F.when(F.col("n") >= least, F.col("js")).alias("value"), "threshold")
    moved = labels.filter(F.col("feature") == LABELS[0]).groupBy(*keys).agg(F.sum("n").alias("n"), F.abs(F.sum(F.when(F.col("x") == attack, F.col("n")).otherwise(0)) / F.sum("n") - rate).alias("value"))
    every = every.unionByName(moved.select(*keys, F.lit("attack_routing_rate").alias("metric"), "n", "value", F.lit(float(rate_threshold)).alias("threshold")))
    every = every.withColumn("ratio", F.col("value") / F.greatest("threshold", F.lit(1e-12))).withColumn("drifted", F.coalesce(F.col("ratio") > 1, F.lit(False)))
    return every.withColumn("status", F.when(F.col("ratio").isNull(), "collecting").when(F.col("drifted"), "warning").otherwise("healthy"))


def output_status(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (*keys, alarm_count, aggregate_score, status) of output_metrics."""
    return metrics.groupBy(*keys).agg(F.count_if("drifted").alias("alarm_count"), F.coalesce(F.max("ratio"), F.lit(0.0)).alias("aggregate_score"), F.when(F.bool_or("drifted"), "warning").otherwise("healthy").alias("status"))


#: Name of a window, days that it reaches back, rows at most, rows at least.
WINDOWS = [("fast", 1, 5_000, 1_000), ("slow", 7, 20_000, 5_000)]


def window_rows(df: DataFrame, cohort: str, ts: str, id_col: str, checks: DataFrame, windows: list[tuple[str, float, int, int]] = WINDOWS) -> DataFrame:
    """df with (window, checked_at, minimum): for every check (checked_at) and window the newest rows of each
    cohort within it, as many as it takes at most. There are few checks and windows."""
    policy = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.lit(float(d)).alias("days"), F.lit(most).alias("maximum"), F.lit(least).alias("minimum")) for n, d, most, least in windows]))
    at = checks.select("checked_at", policy.alias("p")).select("checked_at", "p.*").withColumn("since", F.col("checked_at") - F.make_dt_interval(secs=F.col("days").cast("decimal(12,6)") * 86400))
    held = df.join(F.broadcast(at), (F.col(ts) > F.col("since")) & (F.col(ts) <= F.col("checked_at")))
    # Counts by day tell how far back the newest rows can lie; only rows since then are sorted.
    day = F.date_trunc("day", F.col(ts))
    sizes = held.groupBy(F.col("window").alias("__w"), F.col("checked_at").alias("__at"), F.col(cohort).alias("__c"), "maximum", day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__w", "__at", "__c").orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = sizes.withColumn("__before", before).filter(F.col("__before") < F.col("maximum")).groupBy("__w", "__at", "__c").agg(F.min("__day").alias("__since"))
    on = (F.col("window") == F.col("__w")) & (F.col("checked_at") == F.col("__at")) & F.col(cohort).eqNullSafe(F.col("__c")) & (day >= F.col("__since"))
    held = held.join(F.broadcast(reach), on).drop("__w", "__at", "__c", "__since")
    keys, parts = ["window", "checked_at", cohort], []
    for name, _, most, _ in windows:
        parts.append(newest(held.filter(F.col("window") == name), keys, [F.desc(ts), F.desc(id_col)], most, F.col(id_col)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("since", "days", "maximum")


def health(counts: DataFrame, routes: DataFrame, features: DataFrame, outputs: DataFrame, cohort: str) -> DataFrame:
    """Rows (window, checked_at, cohort, n, score, status): the status ladder of each cohort.

    `counts`: rows (window, checked_at, cohort, n, minimum). `routes`: rows (cohort, reason),
    reason null where a reference is admissible, 'incompatible_source' or 'blocked' otherwise;
    a cohort without a row has no route. `features` and `outputs`: window_status and
    output_status of the same groups. A warning that follows two alarms is critical.
    """
    keys = ["window", "checked_at", cohort]
    f = features.select(*keys, F.col("aggregate_score").alias("f_score"), (F.col("status") == "warning").alias("f_alarm"))
    o = outputs.select(*keys, F.col("aggregate_score").alias("o_score"), (F.col("status") == "warning").alias("o_alarm"))
    every = counts.join(F.broadcast(routes.withColumn("__known", F.lit(True))), cohort, "left").join(f, keys, "left").join(o, keys, "left")
    refused = F.when(F.col("__known").isNull(), "incompatible_source").otherwise(F.col("reason"))
    judged = refused.isNull() & (F.col("n") >= F.col("minimum"))
    alarm = judged & (F.coalesce("f_alarm", F.lit(False)) | F.coalesce("o_alarm", F.lit(False)))
    every = every.withColumn("alarm", alarm).withColumn("score", F.when(judged, F.greatest(F.coalesce("f_score", F.lit(0.0)), F.coalesce("o_score", F.lit(0.0)))))
    critical = escalated(every, "alarm", ["window", cohort], ["checked_at"])
    status = F.coalesce(refused, F.when(F.col("n") < F.col("minimum"), "collecting").when(critical, "critical").when(F.col("alarm"), "warning").otherwise("healthy"))
    return every.select(*keys, "n", "score", status.alias("status"))


def readiness(latest: DataFrame) -> DataFrame:
    """latest (..., status, shadow_mode, deployment_eligible) with `component`: degraded by a critical status of what
    is eligible and not in shadow mode, or where nothing was evaluated."""
    degrades = (F.col("status") == "critical") & ~F.col("shadow_mode") & F.coalesce("deployment_eligible", F.lit(False))
    return latest.withColumn("component", F.when(F.col("status").isNull() | degrades, "degraded").otherwise("ready"))


def admissible(references: DataFrame, version: str, detector: str, classifier: str) -> DataFrame:
    """references (schema_version, content, content_sha256, detector_version, classifier_version,
    n_numeric, n_categorical, ...) with `reason`: the first rule that it breaks, or 'ok'."""
    from .lifecycle import first_reason

    rules = [
        ("unsupported_version", ~F.col("schema_version").eqNullSafe(F.lit(version))),
        ("content_checksum", ~F.sha2(F.col("content").cast("binary"), 256).eqNullSafe(F.col("content_sha256"))),
        ("stale_detector", ~F.col("detector_version").eqNullSafe(F.lit(detector))),
        ("stale_classifier", ~F.col("classifier_version").eqNullSafe(F.lit(classifier))),
        ("no_features", (F.coalesce("n_numeric", F.lit(0)) == 0) | (F.coalesce("n_categorical", F.lit(0)) == 0)),
    ]
    return references.withColumn("reason", first_reason(rules, "ok"))


def escalated(df: DataFrame, alarm: str, keys: list[str], order: list[str], in_a_row: int = 3) -> Column:
    """Whether the row and the in_a_row - 1 before it all have the alarm."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = F.col(alarm)
    for i in range(1, in_a_row):
        out = out & F.coalesce(F.lag(alarm, i).over(w), F.lit(False))
    return out


def _js_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = ((c + 0.5) / (c + 0.5).sum(axis=1, keepdims=True) for c in (a, b))
    m = (p + q) / 2
    return np.sqrt(np.maximum(0, (p * np.log2(p / m) + q * np.log2(q / m)).sum(axis=1) / 2))


def null_thresholds(histograms: DataFrame, window: int, rounds: int = 200, quantile: float = 0.99, seed: int = 42) -> DataFrame:
    """Rows (feature, threshold): how far two disjoint samples of the reference itself get apart.

    The distance depends on bin counts only, so samples are drawn as counts, without
    replacement, from the histogram (feature, bin, n): a few numbers for each feature,
    whatever the number of rows.
    """

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        counts = rows.sort_values("bin")["n"].to_numpy(np.int64)
        size = int(min(window, counts.sum() // 2))
        name = rows["feature"].iloc[0]
        if size < 2:
            return pd.DataFrame({"feature": [name], "threshold": [1.0]})
        rng = np.random.default_rng([seed, *name.encode()])
        method = "marginals"
        a = rng.multivariate_hypergeometric(counts, size, rounds, method=method)
        b = np.stack([rng.multivariate_hypergeometric(counts - x, size, method=method) for x in a])
        return pd.DataFrame({"feature": [name], "threshold": [max(1e-6, float(np.quantile(_js_rows(a, b), quantile)))]})

    return histograms.groupBy("feature").applyInPandas(draw, "feature string, threshold double")


def null_rate_threshold(positive: int, total: int, window: int, rounds: int = 1000, quantile: float = 0.99, seed: int = 42) -> float:
    """The same for the move of a rate."""
    size = min(window, total // 2)
    if size < 1:
        return 1.0
    rng = np.random.default_rng(seed)
    a = rng.hypergeometric(positive, total - positive, size, rounds)
    b = rng.hypergeometric(positive - a, total - positive - (size - a), size)
    return max(1 / size, float(np.quantile(np.abs(a - b) / size, quantile)))


def null_rate_thresholds(counts: DataFrame, key: str, window: int) -> DataFrame:
    """Rows (key, threshold) of counts (key, n, positive), each drawn in a task from two numbers."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        drawn = [null_rate_threshold(int(p), int(n), window) for p, n in zip(rows["positive"], rows["n"])]
        return pd.DataFrame({key: rows[key], "threshold": drawn})

    kind = dict(counts.dtypes)[key]
    return counts.groupBy(key).applyInPandas(draw, f"{key} {kind}, threshold double")


def latest_snapshot(snapshots: DataFrame, filters: dict[str, str], window: str | None = None, deployment: tuple[str, str] | None = None) -> DataFrame:
    """The newest snapshot, at most a row, whose columns have the values of `filters`.

    Without any filter it is the newest that is deployment_eligible; where there is none and `deployment`
    (a column and its value) is given, the newest of that channel.
    """
    own = snapshots if window is None else snapshots.filter(F.col("window") == window)
    wanted = F.lit(True)
    for c, v in filters.items():
        wanted = wanted & (F.col(c) == v)
    if not filters:
        wanted = F.coalesce("deployment_eligible", F.lit(False))
    second = F.col(deployment[0]) == deployment[1] if deployment and deployment[0] not in filters else F.lit(False)
    choice = F.when(wanted, 0).when(second, 1)
    return own.withColumn("__c", choice).filter(F.col("__c").isNotNull()).orderBy("__c", F.desc("checked_at"), "cohort").limit(1).drop("__c")


def judgeable(cohorts: DataFrame, references: DataFrame, key: str, count: str, least: float) -> DataFrame:
    """cohorts with `reason`: that of their reference (key, reason), missing_reference without one,
    not_enough_data where an admissible one meets too few rows or none, else ok."""
    j = cohorts.join(references.select(F.col(key).alias("__k"), F.col("reason").alias("__r")), F.col(key) == F.col("__k"), "left")
    reason = F.when(F.col("__r").isNull(), "missing_reference").when(F.col("__r") != "ok", F.col("__r")).when(F.coalesce(count, F.lit(0)) < least, "not_enough_data").otherwise("ok")
    return j.withColumn("reason", reason).drop("__k", "__r")


class Overlap(ValueError):
    """Rows that a reference is fitted on are held out as well."""


def parts_of_reference(train: DataFrame, held_out: DataFrame, id_col: str) -> DataFrame:
    """Rows (part, n, digest) of both parts, digests being those of their ids in order. Parts that are empty or share
    an id are refused."""
    shared = train.select(id_col).join(held_out.select(id_col), id_col, "left_semi").limit(1).count()
    if shared:
        raise Overlap("the parts of a reference must be disjoint")
    both = train.select(F.lit("fit").alias("part"), id_col).unionByName(held_out.select(F.lit("held_out").alias("part"), id_col))
    parts = digest_tree(both, ["part"], id_col)
    if parts.count() < 2:
        raise ValueError("both parts of a reference need rows")
    return parts.select("part", "n", "digest")


REFERENCE_ROW = ["kind", "feature", "n", "min", "max", "q05", "q50", "q95", "edges", "counts", "threshold"]


def whole_reference(train: DataFrame, held_out: DataFrame, id_col: str, numeric: list[str], categorical: list[str], outputs: tuple[Column, Column, Column, Column], window: int = 5_000, attack: str = "attack") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, samples, parts) of a reference, from the rows that models were fitted on and rows held out from them.

    entries, rows (*REFERENCE_ROW): each numeric and categorical feature of `train` and each output of `held_out`, with
    its histogram or the counts of its vocabulary (one more for what isn't in it) and the threshold that two disjoint
    samples of it keep; and the rate of `attack` among the detector's labels. `outputs`: columns of the detector's label
    and score and the classifier's, as for output_rows; thresholds of outputs are those of the fitted part.
    samples: rows (feature, x). parts: as parts_of_reference, which refuses what isn't disjoint. Numbers that
    aren't finite are refused.
    """
    parts = parts_of_reference(train, held_out, id_col)
    bad = F.lit(False)
    for c in numeric:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
    if train.filter(bad).limit(1).count():
        raise ValueError("a feature of the fitted rows isn't finite")
    null = lambda kind: F.lit(None).cast(kind)
    long = long_numeric(train, [id_col], numeric)
    (labels, scores), (fitted_labels, fitted_scores) = output_rows(held_out, [], *outputs), output_rows(train, [], *outputs)
    thresholds = lambda binned: null_thresholds(binned.select("feature", F.col("bin").cast("string").alias("bin"), "n"), window)

    def numbers(kind: str, values: DataFrame, drawn: DataFrame) -> DataFrame:
        counts = staged(S.counted(values, ["feature"], "x"), "reference-counts")
        ref = staged(numeric_reference(counts), "reference")
        bins = histogram(counts, ref).groupBy("feature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("bin").cast("string").alias("k"), "n")))).alias("counts"))
        entry = ref.join(bins, "feature").join(thresholds(histogram(counts if drawn is values else drawn, ref)), "feature", "left")
        return entry.withColumn("kind", F.lit(kind)).select(*REFERENCE_ROW)

    def words(kind: str, values: DataFrame, drawn: DataFrame) -> DataFrame:
        counts = values.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
        entries = F.array_append(F.array_sort(F.collect_list(F.struct(F.col("x").alias("k"), "n"))), F.struct(F.lit(OTHER).alias("k"), F.lit(0).cast("long").alias("n")))
        of = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.map_from_entries(entries).alias("counts"))
        of = of.join(thresholds(S.counted(drawn, ["feature"], "x").withColumnRenamed("x", "bin")), "feature", "left")
        return of.select(F.lit(kind).alias("kind"), "feature", "n", *[null("double").alias(c) for c in ("min", "max", "q05", "q50", "q95")], null("array<double>").alias("edges"), "counts", "threshold")

    flags = long_categorical(train, [], categorical)
    entries = numbers("numeric", long, long).unionByName(words("categorical", flags, flags)).unionByName(numbers("output_score", scores, fitted_scores)).unionByName(words("output_label", labels, fitted_labels))
    hits = lambda df: df.filter(F.col("feature") == LABELS[0]).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == attack).alias("positive"))
    moved = null_rate_thresholds(hits(fitted_labels), "feature", window)
    rate = hits(labels).join(moved, "feature").select(F.lit("rate").alias("kind"), F.lit("attack_routing_rate").alias("feature"), "n", *[null("double").alias(c) for c in ("min", "max", "q05", "q50", "q95")], null("array<double>").alias("edges"), F.create_map(F.lit(attack), F.col("positive")).alias("counts"), "threshold")
    return staged(entries.unionByName(rate), "reference-entries"), reference_sample(long, id_col), parts
