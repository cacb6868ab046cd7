"""Packet sequences over events: a user's events are the packets of a flow, with gaps of hours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions import identity
from tidewatch.operators import flows as W

from .bindings import table
from .registry import query
from tidewatch.functions.scratch import scratch

H = 3_600_000_000
ACTIVITY, SUBFLOW, BULK = 12 * H, 6 * H, 24 * H
R = lambda c, n=6: F.round(c, n)


def packets(spark, d):
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    e = e.withColumn("k", k).withColumn("payload", F.when(k % 5 == 0, 0).otherwise(F.floor("value")).cast("long"))
    return e.select(
        F.col("user_id").alias("flow"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("seq"), F.when(kind.isin("click", "view"), 0).otherwise(1).alias("direction"), "payload",
        (F.col("payload") + 20 + k % 30).alias("ip_size"), (kind == "signup").alias("syn"), (kind == "error").alias("rst"), (k % 2 == 0).alias("psh"), (k % 3 == 0).alias("ack"), (k % 7 == 0).alias("urg"), (k % 11 == 0).alias("cwr"), (k % 13 == 0).alias("ece"), (kind == "purchase").alias("fin"),
        (k * 100).alias("window"), F.when(F.col("user_id") % 3 == 0, 17).otherwise(6).alias("protocol"), (F.col("user_id") + 40_000).alias("src_port"), F.when(F.col("user_id") % 2 == 0, 443).otherwise(9999).alias("dst_port"), F.when(F.col("user_id") % 5 == 0, "Unknown").when(F.col("user_id") % 5 == 1, "HTTP.Sub").alias("application"), "k",
    )


PACKETS = """
packets AS (
  SELECT user_id AS flow, epoch_us(ts) AS t, event_id AS seq, CASE WHEN event_type IN ('click','view') THEN 0 ELSE 1 END AS direction, payload, payload + 20 + k % 30 AS ip_size,
         event_type = 'signup' AS syn, event_type = 'error' AS rst, k % 2 = 0 AS psh, k % 3 = 0 AS ack, k % 7 = 0 AS urg, k % 11 = 0 AS cwr, k % 13 = 0 AS ece, event_type = 'purchase' AS fin,
         k * 100 AS win, CASE WHEN user_id % 3 = 0 THEN 17 ELSE 6 END AS protocol, user_id + 40000 AS src_port, CASE WHEN user_id % 2 = 0 THEN 443 ELSE 9999 END AS dst_port, CASE user_id % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'HTTP.Sub' END AS application, k
  FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 0 ELSE floor(value)::BIGINT END AS payload FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))
),
gapped AS (SELECT *, t - lag(t) OVER (PARTITION BY flow ORDER BY t, seq) AS iat, t - lag(t) OVER (PARTITION BY flow, direction ORDER BY t, seq) AS dir_iat, greatest(ip_size - payload, 0) AS header FROM packets)"""


def _stats(value: str, prefix: str, where: str = "TRUE") -> str:
    return ", ".join(f"coalesce({f}({value}) FILTER (WHERE {where}), 0)::DOUBLE AS {prefix}__{n}" for n, f in (("min", "min"), ("max", "max"), ("tot", "sum"), ("avg", "avg"), ("std", "stddev_pop")))


def _islands(source: str, gap: int, group: str) -> str:
    return f"(SELECT *, sum(fresh) OVER (PARTITION BY {group} ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY {group} ORDER BY t, seq) > {gap})::INT, 0) AS fresh FROM {source}))"


PERIODS = f"runs AS (SELECT flow, island, min(t) AS a, max(t) AS z FROM {_islands('packets', ACTIVITY, 'flow')} GROUP BY 1, 2), spans AS (SELECT flow, z - a AS active, a - lag(z) OVER (PARTITION BY flow ORDER BY island) AS idle FROM runs), periods AS (SELECT flow, {_stats('active', 'active')}, {_stats('idle', 'idle', 'idle IS NOT NULL')} FROM spans GROUP BY flow)"
SUBFLOWS = f"subflows AS (SELECT flow, (max(island) + 1)::BIGINT AS n_subflows, count(*) FILTER (WHERE direction = 0)::DOUBLE / (max(island) + 1) AS fwd_subflow_pkts, count(*) FILTER (WHERE direction = 1)::DOUBLE / (max(island) + 1) AS bwd_subflow_pkts, coalesce(sum(payload) FILTER (WHERE direction = 0), 0)::DOUBLE / (max(island) + 1) AS fwd_subflow_bytes, coalesce(sum(payload) FILTER (WHERE direction = 1), 0)::DOUBLE / (max(island) + 1) AS bwd_subflow_bytes FROM {_islands('packets', SUBFLOW, 'flow')} GROUP BY flow)"
_SIDE = "coalesce(sum(bytes) FILTER (WHERE direction = {x}), 0)::DOUBLE AS {s}_bulk_bytes, coalesce(sum(n) FILTER (WHERE direction = {x}), 0)::DOUBLE AS {s}_bulk_packets, CASE WHEN sum(us) FILTER (WHERE direction = {x}) > 0 THEN sum(bytes) FILTER (WHERE direction = {x}) / ((sum(us) FILTER (WHERE direction = {x}))::DOUBLE / 1e6) ELSE 0 END::DOUBLE AS {s}_bulk_rate"
BULKS = f"bulk_runs AS (SELECT flow, direction, island, count(*) AS n, sum(payload)::BIGINT AS bytes, max(t) - min(t) AS us FROM {_islands('(SELECT * FROM packets WHERE payload > 0)', BULK, 'flow, direction')} GROUP BY 1, 2, 3 HAVING count(*) >= 4), bulks AS (SELECT flow, {_SIDE.format(x=0, s='fwd')}, {_SIDE.format(x=1, s='bwd')} FROM bulk_runs GROUP BY flow)"


def _side(s: str, x: int) -> str:
    own = f"direction = {x}"
    return f"""count(*) FILTER (WHERE {own})::DOUBLE AS {s}_pkts_tot, count(*) FILTER (WHERE {own} AND payload > 0)::DOUBLE AS {s}_data_pkts_tot, coalesce(sum(header) FILTER (WHERE {own}), 0)::DOUBLE AS {s}_header_size_tot, coalesce(min(header) FILTER (WHERE {own}), 0)::DOUBLE AS {s}_header_size_min, coalesce(max(header) FILTER (WHERE {own}), 0)::DOUBLE AS {s}_header_size_max,
  count(*) FILTER (WHERE {own} AND psh)::DOUBLE AS {s}_PSH_flag_count, count(*) FILTER (WHERE {own} AND urg)::DOUBLE AS {s}_URG_flag_count, {_stats('payload', s + '_pkts_payload', own)}, {_stats('dir_iat', s + '_iat', own + ' AND dir_iat IS NOT NULL')}, coalesce(arg_min(win, (t, seq)) FILTER (WHERE {own} AND protocol = 6), 0)::DOUBLE AS {s}_init_window_size"""


BASE = f"""base AS (SELECT flow, (max(t) - min(t)) / 1e6::DOUBLE AS flow_duration, any_value(src_port)::DOUBLE AS id__orig_p, any_value(dst_port)::DOUBLE AS id__resp_p, CASE any_value(protocol) WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' END AS proto,
  CASE WHEN any_value(application) = 'HTTP.Sub' THEN 'http' WHEN any_value(dst_port) = 443 THEN 'ssl' ELSE '-' END AS service, {_side('fwd', 0)}, {_side('bwd', 1)}, {_stats('payload', 'flow_pkts_payload')}, {_stats('iat', 'flow_iat', 'iat IS NOT NULL')},
  {', '.join(f"count(*) FILTER (WHERE {x})::DOUBLE AS flow_{x.upper()}_flag_count" for x in ('fin', 'syn', 'rst', 'ack', 'cwr', 'ece'))}, coalesce(arg_max(win, (t, seq)) FILTER (WHERE direction = 0 AND protocol = 6), 0)::DOUBLE AS fwd_last_window_size FROM gapped GROUP BY flow),
rated AS (SELECT *, CASE WHEN flow_duration > 0 THEN fwd_pkts_tot / flow_duration ELSE 0 END AS fwd_pkts_per_sec, CASE WHEN flow_duration > 0 THEN bwd_pkts_tot / flow_duration ELSE 0 END AS bwd_pkts_per_sec, CASE WHEN flow_duration > 0 THEN (fwd_pkts_tot + bwd_pkts_tot) / flow_duration ELSE 0 END AS flow_pkts_per_sec,
  CASE WHEN fwd_pkts_tot > 0 THEN bwd_pkts_tot / fwd_pkts_tot ELSE 0 END AS down_up_ratio, CASE WHEN flow_duration > 0 THEN flow_pkts_payload__tot / flow_duration ELSE 0 END AS payload_bytes_per_second FROM base)"""
PLACES = lambda c, n: 1 if c.split("__")[0] in ("fwd_iat", "bwd_iat", "flow_iat", "active", "idle") else n  # noqa: E731  microseconds are large
ROUNDED = lambda cols, n: [c if c in ("proto", "service") else F.round(c, PLACES(c, n)).alias(c) for c in cols]
SQL_ROUNDED = lambda cols, n: ", ".join(c if c in ("proto", "service") else f"round({f'coalesce({c}, 0)' if '_bulk_' in c else c}, {PLACES(c, n)}) AS {c}" for c in cols)


@query("wn01_inter_arrivals", f"WITH {PACKETS} SELECT flow, seq, iat::DOUBLE AS iat, dir_iat::DOUBLE AS dir_iat FROM gapped")
def wn01(spark, d):
    return W.gaps(packets(spark, d)).select("flow", "seq", F.col("iat").cast("double").alias("iat"), F.col("dir_iat").cast("double").alias("dir_iat"))


ACTIVE_IDLE = [f"{p}__{s}" for p in ("active", "idle") for s in schema.STATISTICS]


@query("wn02_active_idle", f"WITH {PACKETS}, {PERIODS} SELECT flow, {SQL_ROUNDED(ACTIVE_IDLE, 2)} FROM periods")
def wn02(spark, d):
    return W.periods(packets(spark, d), ACTIVITY).select("flow", *ROUNDED(ACTIVE_IDLE, 2))


SUB = ["fwd_subflow_pkts", "bwd_subflow_pkts", "fwd_subflow_bytes", "bwd_subflow_bytes"]


@query("wn03_subflows", f"WITH {PACKETS}, {SUBFLOWS} SELECT flow, n_subflows, {SQL_ROUNDED(SUB, 6)} FROM subflows")
def wn03(spark, d):
    return W.subflows(packets(spark, d), SUBFLOW).select("flow", "n_subflows", *ROUNDED(SUB, 6))


BULK_COLUMNS = [c for c in schema.COLUMNS if "_bulk_" in c]


@query("wn04_bulks", f"WITH {PACKETS}, {BULKS} SELECT flow, {SQL_ROUNDED(BULK_COLUMNS, 6)} FROM bulks")
def wn04(spark, d):
    return W.bulks(packets(spark, d), BULK).select("flow", *ROUNDED(BULK_COLUMNS, 6))


def _features(spark, d):
    return W.flow_features(packets(spark, d), ACTIVITY, SUBFLOW, BULK)


ALL = f"WITH {PACKETS}, {PERIODS}, {SUBFLOWS}, {BULKS}, {BASE}, features AS (SELECT * FROM rated JOIN periods USING (flow) JOIN subflows USING (flow) LEFT JOIN bulks USING (flow))"


@query("wn05_tcp_windows", f"{ALL} SELECT flow, fwd_init_window_size, bwd_init_window_size, fwd_last_window_size FROM features")
def wn05(spark, d):
    return _features(spark, d).select("flow", "fwd_init_window_size", "bwd_init_window_size", "fwd_last_window_size")


PAYLOADS = [c for c in schema.COLUMNS if "payload__" in c or "_iat__" in c]
COUNTS = [c for c in schema.COLUMNS if "pkts_tot" in c or "per_sec" in c or c in ("down_up_ratio", "flow_duration")]
HEADERS = [c for c in schema.COLUMNS if "header" in c]
FLAGS = [c for c in schema.COLUMNS if "flag_count" in c]
for _name, _cols, _n in (("fx01_statistics", PAYLOADS, 3), ("fx02_rates", COUNTS, 9), ("fx03_headers", HEADERS, 3), ("fx04_flags", FLAGS, 3), ("fx05_service", ["service"], 0), ("fx06_protocol", ["proto"], 0), ("fx07_all_features", list(schema.COLUMNS), 3)):
    query(_name, f"{ALL} SELECT flow, {SQL_ROUNDED(_cols, _n)} FROM features")(lambda spark, d, cols=_cols, n=_n: _features(spark, d).select("flow", *ROUNDED(cols, n)))

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query("fx08_event_ids", f"SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS flow_id FROM (SELECT event_id, sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(concat_ws('|', event_id, user_id, event_type))) AS h FROM events)")
def fx08(spark, d):
    name = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")
    return table(spark, d, "events").select("event_id", identity.uuid5(NAMESPACE, name).alias("flow_id"))


@query("fx09_assembly_idle", f"WITH {PACKETS} SELECT flow, seq, island::BIGINT AS flow_no FROM {_islands('packets', 8 * H, 'flow')}")
def fx09(spark, d):
    return W.assemble(packets(spark, d).select("flow", "t", "seq"), ["flow"], 8 * H, 1 << 60).select("flow", "seq", "flow_no")


def _assembled(idle: int, active: int) -> str:
    return f"""
placed AS (
  SELECT flow, t, seq, row_number() OVER w AS i, coalesce(t - lag(t) OVER w > {idle}, FALSE) AS gap FROM packets WINDOW w AS (PARTITION BY flow ORDER BY t, seq)
),
links AS MATERIALIZED (
  SELECT flow, i, least(min(CASE WHEN gap THEN i END) OVER (PARTITION BY flow ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
                        min(i) OVER (PARTITION BY flow ORDER BY t RANGE BETWEEN {active + 1} FOLLOWING AND UNBOUNDED FOLLOWING)) AS nxt FROM placed
),
starts(flow, i, flow_no) AS (
  SELECT DISTINCT flow, 1::BIGINT, 0::BIGINT FROM placed
  UNION ALL SELECT s.flow, l.nxt, s.flow_no + 1 FROM starts s JOIN links l USING (flow, i) WHERE l.nxt IS NOT NULL
),
assembled AS (SELECT p.flow, p.seq, max(s.flow_no) OVER (PARTITION BY p.flow ORDER BY p.i) AS flow_no FROM placed p LEFT JOIN starts s USING (flow, i))"""


@query("fx09_assembly_active", f"WITH RECURSIVE {PACKETS}, {_assembled(12 * H, 48 * H)} SELECT flow, seq, flow_no FROM assembled")
def fx09_active(spark, d):
    return W.assemble(packets(spark, d).select("flow", "t", "seq"), ["flow"], 12 * H, 48 * H).select("flow", "seq", "flow_no")


@query("fx09_one_key", f"WITH RECURSIVE {PACKETS.replace('user_id AS flow', '0 AS flow', 1)}, {_assembled(2 * H, 12 * H)} SELECT seq, flow_no FROM assembled")
def fx09_one_key(spark, d):
    """All packets under one key: a gap of two hours or half a day ends a flow."""
    p = packets(spark, d).select(F.lit(0).alias("flow"), "t", "seq")
    return W.assemble(p, ["flow"], 2 * H, 12 * H).select("seq", "flow_no")


@query("src05_flows_from_file", f"{ALL} SELECT flow, {SQL_ROUNDED(list(schema.COLUMNS), 3)} FROM features")
def src05_flows(spark, d):
    """All features of flows whose packets were decoded to a file before."""
    path, p = scratch(spark, "decoded"), packets(spark, d)
    p.write.json(path)
    read = spark.read.schema(p.schema).json(path)
    return W.flow_features(read, ACTIVITY, SUBFLOW, BULK).select("flow", *ROUNDED(schema.COLUMNS, 3))


@query("dq07_invariants", f"{ALL} SELECT flow, CASE WHEN abs(fwd_pkts_payload__tot + bwd_pkts_payload__tot - flow_pkts_payload__tot - CASE WHEN flow % 10 = 0 THEN 5 ELSE 0 END) > 1e-6 THEN 'payload_total' ELSE '' END AS violations FROM features")
def dq07(spark, d):
    broken = _features(spark, d).withColumn("flow_pkts_payload__tot", F.col("flow_pkts_payload__tot") + F.when(F.col("flow") % 10 == 0, 5).otherwise(0))
    return W.violations(broken).select("flow", F.array_join("violations", ",").alias("violations"))


@query("dq08_flow_report", f"{ALL} SELECT flow % 7 AS capture_id, count(*) AS flow_count, count(*) FILTER (WHERE flow % 10 = 0) AS failures FROM features GROUP BY 1")
def dq08(spark, d):
    broken = _features(spark, d).withColumn("flow_pkts_payload__tot", F.col("flow_pkts_payload__tot") + F.when(F.col("flow") % 10 == 0, 5).otherwise(0))
    return W.violations(broken).groupBy((F.col("flow") % 7).alias("capture_id")).agg(F.count(F.lit(1)).alias("flow_count"), F.count_if(F.size("violations") > 0).alias("failures"))


@query("ss12_sessions", f"WITH {PACKETS} SELECT flow, count(*) AS n_packets, make_timestamp(min(t)) AS started_at FROM {_islands('packets', 8 * H - 1, 'flow')} GROUP BY flow, island")
def ss12(spark, d):
    p = packets(spark, d).withColumn("ts", F.timestamp_micros("t"))
    s = p.groupBy("flow", F.session_window("ts", "8 hours")).agg(F.count(F.lit(1)).alias("n_packets"))
    return s.select("flow", "n_packets", F.col("session_window.start").cast("timestamp_ntz").alias("started_at"))


COUNTERS = "c AS (SELECT user_id, ts, event_id, sum(json_extract_string(props, '$.k')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT % 500 AS packets FROM events), l AS (SELECT *, packets - lag(packets) OVER w AS dp, (epoch_us(ts) - epoch_us(lag(ts) OVER w))::DOUBLE / 1e6 AS dt, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query("wn09_counter_rates", f"WITH {COUNTERS} SELECT user_id, event_id, round(CASE WHEN dp >= 0 AND dt > 0 THEN dp / dt END, 9) AS rate FROM l WHERE newest <= 36")
def wn09(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("packets", F.sum(F.get_json_object("props", "$.k").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 500)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    dp, dt = F.col("packets") - F.lag("packets").over(w), (us - F.lag(us).over(w)) / 1e6
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    e = e.withColumn("dp", dp).withColumn("dt", dt).withColumn("newest", newest)
    return e.filter("newest <= 36").select("user_id", "event_id", R(F.when((F.col("dp") >= 0) & (F.col("dt") > 0), F.col("dp") / F.col("dt")), 9).alias("rate"))


@query("wn09_live_rates", "WITH c AS (SELECT user_id, epoch_us(ts) AS t, user_id % 3 = 0 AND ts >= TIMESTAMP '2024-01-20' AS identity, sum(json_extract_string(props, '$.k')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT % 500 AS packets FROM events), l AS (SELECT *, lag(t) OVER w AS pt, lag(packets) OVER w AS pp, lag(identity) OVER w AS pi, max(t) OVER (PARTITION BY user_id) AS last, last_value(identity) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS own, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS n FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, t, round(CASE WHEN pi IS NOT DISTINCT FROM identity AND packets >= pp THEN (packets - pp) / ((t - pt) / 1e6::DOUBLE) END, 9) AS packets_rate FROM l WHERE n <= 36 AND last - t <= 864000000000 AND identity = own")
def wn09_live(spark, d):
    """Every third sensor is another one from the 20th on; ten days are kept."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("packets", F.sum(F.get_json_object("props", "$.k").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 500)
    e = e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), ((F.col("user_id") % 3 == 0) & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))).alias("identity"), "packets")
    return W.counter_rates(e, "user_id", "identity", "t", ["packets"], within_us=864_000_000_000).select("user_id", "t", R(F.col("packets_rate"), 9).alias("packets_rate"))


@query("wn13_latest_by_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def wn13(spark, d):
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return table(spark, d, "events").groupBy("user_id").agg(last.alias("x")).select("user_id", "x.event_id", "x.event_type")


@query("wn14_last_in_batch", "SELECT user_id, ts::DATE AS batch, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS packets, coalesce(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click'), 0.0::DOUBLE) AS drops FROM events GROUP BY 1, 2")
def wn14(spark, d):
    at = F.struct("ts", "event_id")
    last = lambda kind: F.max_by(F.when(F.col("event_type") == kind, F.col("value")), F.when(F.col("event_type") == kind, at))
    return table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("batch")).agg(last("view").alias("packets"), F.coalesce(last("click"), F.lit(0.0)).alias("drops"))
