"""Data-quality gates: row errors, profiles and manifest rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def number(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` as double)")


def sensor_id_ok(c: Column) -> Column:
    """Whether a text names a sensor: 1 to 64 letters, digits, underscores, dots and hyphens, a letter or digit first."""
    return F.coalesce(c.rlike(r"\A[a-zA-Z0-9][a-zA-Z0-9_.-]{0,63}\z"), F.lit(False))


def digest_ok(c: Column) -> Column:
    """Whether a text is a SHA-256 digest: 64 hexadecimal digits."""
    return F.coalesce(c.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit(False))


def row_errors(numeric: list[str], categorical: list[str]) -> Column:
    """Array of codes: what is wrong with a row of text columns."""
    bad = []
    for c in numeric:
        x = number(c)
        bad += [F.when(F.col(c).isNull(), f"missing:{c}").when(F.lower(c).isin("true", "false"), f"boolean:{c}").when(x.isNull(), f"not_numeric:{c}").when(F.isnan(x) | (F.abs(x) == INF), f"not_finite:{c}")]
    bad += [F.when(F.col(c).isNull() | (F.trim(c) == ""), f"blank:{c}") for c in categorical]
    return F.array_compact(F.array(*bad))


def feature_set_errors(names: Column, expected: list[str]) -> Column:
    """Array of codes: what is wrong with the names, in order, of a row's features."""
    want = F.array(*map(F.lit, expected))
    missing, extra = F.array_sort(F.array_except(want, names)), F.array_sort(F.array_except(names, want))
    listed = lambda code, x: F.when(F.size(x) > 0, F.concat(F.lit(f"{code}:"), F.array_join(x, "+")))
    moved = F.when((F.size(missing) == 0) & (F.size(extra) == 0) & (names != want), "misordered")
    return F.array_compact(F.array(listed("missing", missing), listed("extra", extra), moved))


def inference_frame(df: DataFrame, features: list[str], categorical: list[str]) -> DataFrame:
    """df's features in their order, numbers as doubles. Missing or extra columns are an error at once; a
    missing or infinite value, or a blank category, fails the job that reads it."""
    missing, extra = [c for c in features if c not in df.columns], [c for c in df.columns if c not in features]
    if missing or extra:
        raise ValueError(f"missing columns: {missing}; extra columns: {extra}")

    def checked(c: str) -> Column:
        fail = F.raise_error(F.lit(f"{c}: missing, blank or not a finite number"))
        if c in categorical:
            return F.when(F.trim(c) != "", F.col(c)).otherwise(fail.cast("string")).alias(c)
        x = number(c)
        return F.when(~F.isnan(x) & (F.abs(x) < INF), x).otherwise(fail.cast("double")).alias(c)

    return df.select(*map(checked, features))


def columns_profile(df: DataFrame, identifiers: tuple[str, ...] = ("no",), tokens: tuple[str, ...] = ("uuid", "event_id", "row_id")) -> DataFrame:
    """Rows (column, type, missing, candidate): candidate tells an index artefact or identifier, which may leak the label."""
    odd = lambda c: c.startswith("Unnamed:") or c in identifiers or any(t in c.lower() for t in tokens)
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"m{i}").alias("missing"), F.lit(odd(c)).alias("candidate")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def envelope_errors(start: str, end: str, version: str, fingerprint: str, native: str) -> Column:
    bad = [F.when(F.col(end) < F.col(start), "ends_before_start"), F.when((F.col(version) == native) & F.col(fingerprint).isNull(), "fingerprint_missing")]
    return F.array_compact(F.array(*bad))


def quarantined(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with `error_code`, their first error)."""
    marked = df.withColumn("__e", errors)
    return marked.filter(F.size("__e") == 0).drop("__e"), marked.filter(F.size("__e") > 0).withColumn("error_code", F.col("__e")[0]).drop("__e")


def column_issues(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, coercion_failures, missing, infinite), from one pass over text columns."""
    aggs = []
    for c in columns:
        x = number(c)
        aggs += [F.count_if(x.isNull() & F.col(c).isNotNull()).alias(f"{c}__f"), F.count_if(F.col(c).isNull()).alias(f"{c}__m"), F.count_if(F.abs(x) == INF).alias(f"{c}__i")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__f").alias("coercion_failures"), F.col(f"{c}__m").alias("missing"), F.col(f"{c}__i").alias("infinite")) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def profile(df: DataFrame, features: list[str], categorical: list[str]) -> DataFrame:
    """One row: rows, duplicate rows, duplicate feature rows, and values of each categorical, null being one.

    Duplicates are counted over grouped rows, not by one distinct aggregate, so nothing
    is expanded.
    """
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"))
    part = df.groupBy(*features).agg(F.count(F.lit(1)).alias("n")).agg((F.sum("n") - F.count(F.lit(1))).alias("duplicate_feature_rows"))
    card = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"n_{c}") for c in categorical])
    return whole.crossJoin(part).crossJoin(card)


def cell_issues(df: DataFrame, key: list[str], bounds: dict[str, tuple[float, float]], first: int = 50) -> DataFrame:
    """The first cells out of bounds, by row and column, and how many there are in all."""
    long = df.unpivot(key, list(bounds), "feature", "x")
    bad = F.lit(False)
    for i, (c, (lo, hi)) in enumerate(bounds.items()):
        bad = bad | ((F.col("feature") == c) & (F.col("x").isNull() | (F.col("x") < lo) | (F.col("x") > hi)))
    place = F.array_position(F.array(*[F.lit(c) for c in bounds]), F.col("feature"))
    found = long.filter(bad).withColumn("place", place)
    return found.orderBy(*key, "place").limit(first).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("n_issues")))).drop("place")


def manifest_violations(sessions: DataFrame, families: int, min_sessions: int, min_runs: int) -> DataFrame:
    """Rows (rule, subject) that sessions (session_id, family, run, digest, started, ended) break."""
    rule = lambda df, name, c: df.select(F.lit(name).alias("rule"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("subject"))
    twice = lambda c: sessions.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    per = sessions.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("runs"))
    out = rule(sessions.filter("session_id is null or family is null or run is null or digest is null"), "field_missing", "session_id")
    for df, name, c in (
        (twice("session_id"), "session_repeated", "session_id"), (twice("digest"), "digest_repeated", "digest"), (sessions.filter("started is null or ended is null or started >= ended"), "times", "session_id"),
        (per.filter(F.col("n") < min_sessions), "too_few_sessions", "family"), (per.filter(F.col("runs") < min_runs), "too_few_runs", "family"),
        (per.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != families), "families", "n"),
    ):
        out = out.unionByName(rule(df, name, c))
    return out


def label_violations(labels: DataFrame, sessions: DataFrame, domain: list[str]) -> DataFrame:
    """Rows (rule, subject) that labels (label_id, session_id, disposition) break."""
    lost = labels.join(sessions.select("session_id"), "session_id", "left_anti").select(F.lit("unknown_session").alias("rule"), F.col("label_id").cast("string").alias("subject"))
    odd = labels.filter(~F.col("disposition").isin(*domain)).select(F.lit("disposition").alias("rule"), F.col("label_id").cast("string").alias("subject"))
    return lost.unionByName(odd)
