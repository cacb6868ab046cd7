"""Flows from packets: assembly, periods, bulks and the 83 features.

Every step partitions by the flow, so windows, aggregates and the joins of their results
share that partitioning; each step shuffles only the packet columns that it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions import ranges as R
from tidewatch.functions.scratch import staged

#: Fixed values, in microseconds. A gap must be longer than these to part two periods, subflows or bulks.
ACTIVITY_GAP, SUBFLOW_GAP, BULK_GAP, BULK_PACKETS = 5_000_000, 1_000_000, 1_000_000, 4
FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece")
#: The services of well-known ports.
SERVICES = {22: "ssh", 53: "dns", 80: "http", 443: "ssl", 1883: "mqtt"}


def gaps(packets: DataFrame) -> DataFrame:
    """Packets (flow, t, seq, direction, ...) with `iat`, to the packet before in the flow,
    and `dir_iat`, to the one before in its direction."""
    w = Window.partitionBy("flow").orderBy("t", "seq")
    v = Window.partitionBy("flow", "direction").orderBy("t", "seq")
    return packets.withColumn("iat", F.col("t") - F.lag("t").over(w)).withColumn("dir_iat", F.col("t") - F.lag("t").over(v))


def islands(packets: DataFrame, gap: int, group: list[str], name: str) -> DataFrame:
    """packets with the number of the island each is in: a longer gap than `gap` starts another."""
    w = Window.partitionBy(*group).orderBy("t", "seq")
    fresh = (F.col("t") - F.lag("t").over(w) > gap).cast("int")
    return packets.withColumn("__fresh", F.coalesce(fresh, F.lit(0))).withColumn(name, F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def statistics(value: Column, prefix: str) -> list[Column]:
    """The five statistics of a group; 0 where there is nothing."""
    of = {"min": F.min(value), "max": F.max(value), "tot": F.sum(value), "avg": F.avg(value), "std": F.stddev_pop(value)}
    return [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"{prefix}__{s}") for s, c in of.items()]


def periods(packets: DataFrame, gap: int = ACTIVITY_GAP) -> DataFrame:
    """Rows (flow, active__<statistic>..., idle__<statistic>...), in microseconds."""
    runs = islands(packets, gap, ["flow"], "period").groupBy("flow", "period").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    w = Window.partitionBy("flow").orderBy("period")
    runs = runs.withColumn("active", F.col("z") - F.col("a")).withColumn("idle", F.col("a") - F.lag("z").over(w))
    return runs.groupBy("flow").agg(*statistics(F.col("active"), "active"), *statistics(F.col("idle"), "idle"))


def subflows(packets: DataFrame, gap: int = SUBFLOW_GAP) -> DataFrame:
    """Rows (flow, n_subflows, and packets and bytes of each direction for each subflow)."""
    p = islands(packets, gap, ["flow"], "subflow")
    n, fwd = F.max("subflow") + 1, F.col("direction") == 0
    per = lambda c: (c / n).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return p.groupBy("flow").agg(
        n.cast("long").alias("n_subflows"), per(F.count_if(fwd)).alias("fwd_subflow_pkts"), per(F.count_if(~fwd)).alias("bwd_subflow_pkts"),
        per(zero(F.sum(F.when(fwd, F.col("payload"))))).alias("fwd_subflow_bytes"), per(zero(F.sum(F.when(~fwd, F.col("payload"))))).alias("bwd_subflow_bytes"),
    )


def bulks(packets: DataFrame, gap: int = BULK_GAP, least: int = BULK_PACKETS) -> DataFrame:
    """Rows (flow, bytes, packets and bytes a second in bulks of each direction); flows without a bulk are left out."""
    p = islands(packets.filter("payload > 0"), gap, ["flow", "direction"], "bulk")
    runs = p.groupBy("flow", "direction", "bulk").agg(F.count(F.lit(1)).alias("n"), F.sum("payload").alias("bytes"), (F.max("t") - F.min("t")).alias("us")).filter(F.col("n") >= least)
    out = []
    for side, x in (("fwd", 0), ("bwd", 1)):
        own = lambda c, x=x: F.coalesce(F.sum(F.when(F.col("direction") == x, F.col(c))), F.lit(0)).cast("double")
        seconds = own("us") / 1e6
        out += [own("bytes").alias(f"{side}_bulk_bytes"), own("n").alias(f"{side}_bulk_packets"), F.when(seconds > 0, own("bytes") / seconds).otherwise(0.0).alias(f"{side}_bulk_rate")]
    return runs.groupBy("flow").agg(*out)


def service(application: Column, port: Column) -> Column:
    app = F.lower(F.split_part(F.coalesce(application, F.lit("")), F.lit("."), F.lit(1)))
    by_port = F.lit("-")
    for p, name in SERVICES.items():
        by_port = F.when(port == p, name).otherwise(by_port)
    return F.when(app.isin("tls", "ssl"), "ssl").when(~app.isin("", "unknown", "unspecified"), app).otherwise(by_port)


def protocol(number: Column) -> Column:
    return F.when(number == 6, "tcp").when(number == 17, "udp").otherwise(number.cast("string"))


def flow_features(packets: DataFrame, activity_gap: int = ACTIVITY_GAP, subflow_gap: int = SUBFLOW_GAP, bulk_gap: int = BULK_GAP) -> DataFrame:
    """Rows (flow, 83 features in order, dots as __) of packets (flow, t in microseconds,
    seq, direction 0 or 1, payload, ip_size, flags, window, protocol, src_port, dst_port, application)."""
    p = gaps(packets).withColumn("payload", F.greatest("payload", F.lit(0)))
    p = p.withColumn("header", F.greatest(F.col("ip_size") - F.col("payload"), F.lit(0)))
    fwd, bwd, payload = F.col("direction") == 0, F.col("direction") == 1, F.col("payload")
    sides = (("fwd", fwd), ("bwd", bwd))
    when, tcp = F.struct("t", "seq"), F.col("protocol") == 6
    num = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    aggs = [((F.max("t") - F.min("t")) / 1e6).alias("flow_duration")]
    for c, name in (("src_port", "id__orig_p"), ("dst_port", "id__resp_p")):
        aggs.append(num(F.first(c)).alias(name))
    aggs += [protocol(F.first("protocol")).alias("proto"), service(F.first("application"), F.first("dst_port")).alias("service")]
    for side, own in sides:
        aggs += [num(F.count_if(own)).alias(f"{side}_pkts_tot"), num(F.count_if(own & (payload > 0))).alias(f"{side}_data_pkts_tot")]
        h = F.when(own, F.col("header"))
        aggs += [num(F.sum(h)).alias(f"{side}_header_size_tot"), num(F.min(h)).alias(f"{side}_header_size_min"), num(F.max(h)).alias(f"{side}_header_size_max")]
        aggs += [num(F.count_if(own & F.col(x))).alias(f"{side}_{x.upper()}_flag_count") for x in ("psh", "urg")]
        aggs += statistics(F.when(own, payload), f"{side}_pkts_payload") + statistics(F.when(own, F.col("dir_iat")), f"{side}_iat")
        aggs.append(num(F.min_by(F.when(own & tcp, F.col("window")), F.when(own & tcp, when))).alias(f"{side}_init_window_size"))
    aggs += statistics(payload, "flow_pkts_payload") + statistics(F.col("iat"), "flow_iat")
    aggs += [num(F.count_if(F.col(x))).alias(f"flow_{x.upper()}_flag_count") for x in ("fin", "syn", "rst", "ack", "cwr", "ece")]
    aggs.append(num(F.max_by(F.when(fwd & tcp, F.col("window")), F.when(fwd & tcp, when))).alias("fwd_last_window_size"))
    base = p.groupBy("flow").agg(*aggs)
    rate = lambda c: F.when(F.col("flow_duration") > 0, c / F.col("flow_duration")).otherwise(0.0)
    f, b = F.col("fwd_pkts_tot"), F.col("bwd_pkts_tot")
    base = base.withColumns({
        "fwd_pkts_per_sec": rate(f), "bwd_pkts_per_sec": rate(b), "flow_pkts_per_sec": rate(f + b), "down_up_ratio": F.when(f > 0, b / f).otherwise(0.0), "payload_bytes_per_second": rate(F.col("flow_pkts_payload__tot")),
    })
    out = base.join(periods(packets, activity_gap), "flow").join(subflows(p, subflow_gap), "flow").join(bulks(p, bulk_gap), "flow", "left")
    bulk = {c: F.coalesce(c, F.lit(0.0)) for c in schema.COLUMNS if "_bulk_" in c}
    return out.withColumns(bulk).select("flow", *schema.COLUMNS)


def assemble(packets: DataFrame, keys: list[str], idle: int, active: int) -> DataFrame:
    """packets with `flow_no`, the number of the flow within its key: a gap of over `idle`,
    or a packet over `active` after the flow's first one, starts the next.

    Packets are sorted into ranges of like size, whatever the size of a key. Gaps cut a key into
    runs. Where the second rule cuts depends on the cut before, so within runs of over `active`
    every packet gets a link to the first one beyond its time, and what links lead to from a
    run's first packet, by doubling, are the cuts. Packets of one time are in the order of seq.
    """
    p = R.sorted_ranges(packets, [*keys, "t", "seq"], "__id", "packets")
    p = R.previous(p, keys, "__id", "t", "__before")
    p = staged(R.running_sum(p, keys, "__id", (F.col("t") - F.col("__before") > idle).cast("long"), "__run").withColumn("__run", F.coalesce("__run", F.lit(0))), "runs")
    run = [*keys, "__run"]
    spans = p.groupBy(*run).agg(F.min("t").alias("__t0"), F.max("t").alias("__t1"), F.min("__id").alias("id"))
    long_runs = staged(spans.filter(F.col("__t1") - F.col("__t0") > active), "long-runs")
    named = [F.col(c).alias(f"__k{i}") for i, c in enumerate(run)]
    same = F.lit(True)
    for i, c in enumerate(run):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    # A packet, and beside it a probe for the end of its time; a packet of that very time comes first.
    own = p.join(long_runs.select(*named), same, "left_semi").select(*run, "__id", F.explode(F.array(*[F.struct((F.col("t") + F.lit(k * active)).alias("at"), F.lit(k).alias("probe")) for k in (0, 1)])).alias("e"))
    events = R.sorted_ranges(own.select(*run, "__id", "e.at", "e.probe"), [*run, "at", "probe", "__id"], "__place", "ends-of-flows")
    ahead = R.following(events, run, "__place", F.when(F.col("probe") == 0, F.col("__id")), "nxt").filter("probe = 1 and nxt is not null")
    cuts = R.reached(long_runs.select("id"), ahead.select(F.col("__id").alias("id"), "nxt"))
    starts = staged(spans.select("id").unionByName(cuts).distinct().select(F.col("id").alias("__start")), "starts-of-flows")
    marked = p.join(starts, F.col("__id") == F.col("__start"), "left")
    numbered = R.running_sum(staged(marked, "packets-of-flows"), keys, "__id", F.col("__start").isNotNull().cast("long"), "flow_no")
    return numbered.withColumn("flow_no", F.col("flow_no") - 1).select(*packets.columns, "flow_no")


def flow_key() -> list[Column]:
    """The five columns that name a connection whichever end sent a packet: the lesser end first."""
    a, b = F.struct("src_ip", "src_port"), F.struct("dst_ip", "dst_port")
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.col("protocol")]


def violations(features: DataFrame) -> DataFrame:
    """features with `violations`, an array: not finite, negative, or payload that doesn't add up."""
    number = [schema.column(x) for x in schema.NUMERIC]
    bad = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(f"not_finite:{c}")) for c in number]
    bad += [F.when(F.col(c) < 0, F.lit(f"negative:{c}")) for c in number if c.endswith(("_tot", "_count", "__tot", "__min", "__max", "_per_sec", "duration"))]
    sums = F.abs(F.col("fwd_pkts_payload__tot") + F.col("bwd_pkts_payload__tot") - F.col("flow_pkts_payload__tot")) > 1e-6
    return features.withColumn("violations", F.array_compact(F.array(*bad, F.when(sums, F.lit("payload_total")))))


def counter_rates(df: DataFrame, sensor: str, identity: str, ts: str, counters: list[str], keep: int = 36, within_us: int = 120_000_000) -> DataFrame:
    """The last samples of each sensor (at most `keep`, not older than `within_us` before its newest
    one, none from before its identity changed) with <counter>_rate: the change of each counter by
    the second; null on the first sample and where any counter was reset. Samples of one time are one.

    `ts` is in microseconds.
    """
    w = Window.partitionBy(sensor).orderBy(ts)
    d = df.dropDuplicates([sensor, ts]).withColumn("__new", F.coalesce((~F.col(identity).eqNullSafe(F.lag(identity).over(w))).cast("int"), F.lit(1)))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(sensor, "__run").orderBy(ts)
    comparable = F.lag(ts).over(own).isNotNull()
    for c in counters:
        comparable = comparable & (F.col(c) >= F.lag(c).over(own))
    seconds = (F.col(ts) - F.lag(ts).over(own)) / 1e6
    d = d.withColumns({f"{c}_rate": F.when(comparable, (F.col(c) - F.lag(c).over(own)) / seconds) for c in counters})
    back = Window.partitionBy(sensor).orderBy(F.desc(ts))
    d = d.withColumns({"__n": F.row_number().over(back), "__last": F.max(ts).over(Window.partitionBy(sensor)), "__own": F.max("__run").over(Window.partitionBy(sensor))})
    held = (F.col("__n") <= keep) & (F.col("__last") - F.col(ts) <= within_us) & (F.col("__run") == F.col("__own"))
    return d.filter(held).drop("__new", "__run", "__n", "__last", "__own")
