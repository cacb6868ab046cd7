"""Job and alert histories as set-based queries over audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.distributions import counted, running_counts


def latest(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Rows (key, value): the value of the last row of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def ordered_history(df: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Rows (key, name): what happened to each key, as an array in order."""
    rows = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, *columns]))))
    return df.groupBy(key).agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias(name))


def first_reason(reasons: list[tuple[str, Column]], fine: str = "eligible") -> Column:
    """The name of the first condition that holds, `fine` if none does."""
    out = F.lit(fine)
    for name, condition in reversed(reasons):
        out = F.when(condition, name).otherwise(out)
    return out


def split_known(batch: DataFrame, stored: DataFrame, key: str, digest: str, place: str) -> DataFrame:
    """batch with `disposition`: new; duplicate, if the stored row or an earlier one of the
    batch is the same; conflict, if a row of the same key has another digest.

    `place` is a row's place in the batch, no two of one key alike: of equal rows the first is new.
    A key's rows are summed up before they meet, so a key that is sent again and again isn't
    gathered.
    """
    had = stored.select(key, F.col(digest).alias("__had"))
    within = batch.groupBy(key).agg((F.min(digest) != F.max(digest)).alias("__torn"), F.min(place).alias("__first"))
    joined = batch.join(had, key, "left").join(within, key)
    conflict = F.col("__torn") | (F.col("__had") != F.col(digest))
    known = F.col("__had").isNotNull() | (F.col(place) > F.col("__first"))
    return joined.withColumn("disposition", F.when(conflict, "conflict").when(known, "duplicate").otherwise("new")).drop("__had", "__torn", "__first")


def redrive_plan(asked: DataFrame, eligibility: DataFrame, key: str, operator: str, reason: str, dry_run: bool = True) -> DataFrame:
    """Rows (key, eligible, reason) for the ids asked for, once each. Without an operator, a reason
    or ids, or with an id asked for twice, there is no plan; and unless it is a dry run, one
    refused id refuses the whole set."""
    if not operator.strip() or not reason.strip():
        raise ValueError("operator and reason are required")
    n, distinct = asked.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if not n:
        raise ValueError("at least one id is required")
    if distinct < n:
        raise ValueError("ids must be unique")
    plan = asked.select(key).join(eligibility.select(key, "reason"), key, "left").withColumn("reason", F.coalesce("reason", F.lit("not_found")))
    plan = plan.select(key, (F.col("reason") == "eligible").alias("eligible"), "reason")
    if not dry_run and (bad := plan.filter("not eligible").count()):
        raise ValueError(f"{bad} ids are refused, and so is the whole set")
    return plan


#: States of jobs that are still to be done.
ACTIVE = ("queued", "processing", "retrying")


def ingestion_status(jobs: DataFrame, outbox: DataFrame, heartbeats: DataFrame, now: Column, minute: str = "1 minute", fresh: str = "60 seconds") -> DataFrame:
    """One row of counts by state, queue depth, retries, ages and the outbox, over jobs (state,
    attempts, created_at, completed_at), outbox (created_at, published_at) and worker
    heartbeats (at): the worker is ready while a heartbeat is `fresh`, else degraded, or
    blocked while jobs wait."""
    state = lambda x: F.col("state") == x
    active, seconds = F.col("state").isin(*ACTIVE), lambda a: F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(a).cast("timestamp"))
    j = jobs.agg(
        F.count_if(active).alias("queue_depth"), *[F.count_if(state(x)).alias(x) for x in (*ACTIVE, "succeeded", "dead_letter")],
        F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).alias("retries"), F.min(F.when(active, F.col("created_at"))).alias("oldest"),
        F.count_if(state("succeeded") & (F.col("completed_at") >= now - F.expr(f"interval {minute}"))).alias("completed_lately"),
    )
    o = outbox.agg(F.count_if(F.col("published_at").isNull()).alias("outbox_pending"), F.count_if(F.col("published_at").isNotNull()).alias("outbox_published"), F.min(F.when(F.col("published_at").isNull(), F.col("created_at"))).alias("oldest_outbox"))
    h = heartbeats.agg((F.max("at") >= now - F.expr(f"interval {fresh}")).alias("alive"))
    one = j.crossJoin(o).crossJoin(h)  # a row each
    worker = F.when(F.coalesce("alive", F.lit(False)), "ready").when(F.col("queue_depth") == 0, "degraded").otherwise("blocked")
    return one.select(*[c for c in j.columns if c != "oldest"], seconds("oldest").alias("oldest_active_age"), worker.alias("worker"), "outbox_pending", "outbox_published", seconds("oldest_outbox").alias("oldest_outbox_age"), F.when(F.col("outbox_pending") > 0, "degraded").otherwise("ready").alias("outbox"))


def lower_rank_percentiles(df: DataFrame, keys: list[str], values: list[str], levels: dict[str, float]) -> DataFrame:
    """Rows (*keys, <value>_<level>...): the element at rank floor(q * (n - 1)) of the values
    in order, which is the nearest rank from below.

    Equal values are counted first, and running counts by buckets of values find the rank, so neither
    a list nor all values of a key meet in a task.
    """
    long = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "__of", "__x")
    c = running_counts(counted(long, [*keys, "__of"], "__x", "__n"), [*keys, "__of"], "__x", ["__n"])
    at = lambda v, q: (F.col("__of") == v) & (F.col("__n_upto") > F.floor(q * (F.col("__n_all") - 1)))
    kinds = dict(df.dtypes)
    return c.groupBy(*keys).agg(*[F.min(F.when(at(v, q), F.col("__x"))).cast(kinds[v]).alias(f"{v}_{name}") for v in values for name, q in levels.items()])


def routed(df: DataFrame, routes: DataFrame, schema: str, fingerprint: str, plain: str) -> DataFrame:
    """df with (route, error_code): the route of exactly its schema and fingerprint, a null one being equal to null.

    Without a route the schema `plain` allows no such fingerprint, and any other has not approved it.
    `routes`: (schema, fingerprint, route), one row for each pair, joined by both.
    """
    own = routes.select(F.col("schema").alias("__s"), F.col("fingerprint").alias("__f"), "route")
    j = df.join(own, F.col(schema).eqNullSafe(F.col("__s")) & F.col(fingerprint).eqNullSafe(F.col("__f")), "left").drop("__s", "__f")
    why = F.when(F.col(schema) == plain, "fingerprint_not_allowed").otherwise("extractor_not_approved")
    return j.withColumn("error_code", F.when(F.col("route").isNull(), why))


def with_feedback(df: DataFrame, feedback: DataFrame, key: str, state: str, order: list[str], status: str) -> DataFrame:
    """df with its `status` replaced by the newest feedback's state, where there is any, and n_feedback."""
    s = feedback.groupBy(F.col(key).alias("__k")).agg(F.max_by(state, F.struct(*order)).alias("__latest"), F.count(F.lit(1)).alias("__n"))
    j = df.join(s, F.col(key) == F.col("__k"), "left").withColumn(status, F.coalesce("__latest", status))
    return j.withColumn("n_feedback", F.coalesce("__n", F.lit(0))).drop("__k", "__latest", "__n")
