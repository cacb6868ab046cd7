"""Streams: state with timers, files that grow, statuses that change."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import growing
from tidewatch.streaming import flows, state


def rows_of(spark, path):
    return spark.read.parquet(path).collect()


def dropped(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.{name}", "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))
    os.rename(f"{path}/.{name}", f"{path}/{name}")


def at(seconds):
    return f"2024-01-01T00:{seconds // 60:02}:{seconds % 60:02}.000Z"


def test_a_timer_tells_that_a_sensor_is_silent(spark, tmp_path):
    """Nothing more arrives, and the sensor goes offline all the same; a new beat brings it back."""
    (tmp_path / "in").mkdir()
    beats = spark.readStream.schema("sensor string, ts timestamp, packets long").json(str(tmp_path / "in"))
    told = []
    s = state.sensor_presence(beats, "sensor", "ts", "packets", silence_seconds=2)
    q = s.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").foreachBatch(lambda df, n: told.extend(df.filter("changed").collect())).start()
    try:
        dropped(str(tmp_path / "in"), "a.json", [{"sensor": "x", "ts": at(0), "packets": 5}, {"sensor": "x", "ts": at(1), "packets": 2}])
        until = time.time() + 90
        while len(told) < 2 and time.time() < until:
            time.sleep(0.2)
        assert [(r.sensor, r.status, r.packets, r.events_seen) for r in told] == [("x", "online", 5, 1), ("x", "offline", 7, 2)]
        assert told[1]["at"] - told[0]["at"] >= 2_000_000
        dropped(str(tmp_path / "in"), "b.json", [{"sensor": "x", "ts": at(9), "packets": None}])
        while len(told) < 3 and time.time() < until:
            time.sleep(0.2)
        assert (told[2].status, told[2].packets, told[2].events_seen) == ("online", 7, 3)
    finally:
        q.stop()


def plain_presence(beats, silence):
    """Changes of one sensor whose beats come in order."""
    out, last = [], None
    for t in beats:
        if last is not None and t - last > silence:
            out.append((last + silence, "offline"))
            last = None
        if last is None:
            out.append((t, "online"))
        last = t
    return out


def test_silences_between_beats_are_the_same_however_they_are_batched(spark, tmp_path):
    r = random.Random(2)
    beats = sorted((r.randrange(3500), r.choice("ab")) for _ in range(60))
    for batches in (1, 4):
        path, out = str(tmp_path / f"in{batches}"), str(tmp_path / f"out{batches}")
        size = -(-len(beats) // batches)
        for i in range(batches):
            dropped(path, f"{i}.json", [{"sensor": s, "ts": at(t), "packets": 1} for t, s in beats[i * size : (i + 1) * size]])
            stream = spark.readStream.schema("sensor string, ts timestamp, packets long").json(path)
            flows.drain(state.sensor_presence(stream, "sensor", "ts", "packets", 60, delay="0 seconds"), out)
        got = [x for x in rows_of(spark, out) if x.changed]
        start = 1704067200
        for s in "ab":
            own = sorted((x["at"] // 1_000_000 - start, x.status) for x in got if x.sensor == s)
            want = plain_presence([t for t, x in beats if x == s], 60)
            # The last silence is told once the other sensor's beats have moved the clock past it.
            assert own[: len(want)] == want and own[len(want) :] in ([], [(max(t for t, x in beats if x == s) + 60, "offline")])
        last = {x.sensor: x for x in sorted(rows_of(spark, out), key=lambda x: (x.events_seen, x.changed))}
        assert {s: (x.packets, x.events_seen) for s, x in last.items()} == {s: (sum(x == s for _, x in beats),) * 2 for s in "ab"}


def test_only_changes_of_status_are_told_by_cohort_and_window(spark, tmp_path):
    r = random.Random(4)
    rows = [{"cohort": r.choice("xy"), "window": r.choice(["24h", "7d"]), "version": v, "status": r.choice(["ok", "ok", "warning", "critical"])} for v in range(80)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(4):  # each drop repeats some of the one before
        dropped(path, f"{i}.json", rows[max(0, i * 20 - 7) : (i + 1) * 20])
        stream = spark.readStream.schema("cohort string, window string, version long, status string").json(path)
        flows.drain(state.status_changes(stream, ["cohort", "window"], "version", "status"), out)
    want, last = [], {}
    for x in rows:
        k = x["cohort"], x["window"]
        if last.get(k) != x["status"]:
            want.append((*k, x["version"], x["status"]))
        last[k] = x["status"]
    assert sorted((x.cohort, x.window, x.version, x.status) for x in rows_of(spark, out)) == sorted(want)


def drained(spark, pattern, out, split=growing.SPLIT):
    flows.drain(growing.follow_growing(spark, pattern, split), out)
    return [(os.path.basename(r.path), r.value) for r in sorted(rows_of(spark, out), key=lambda r: (r.batch, r.path, r["at"]))]


def test_a_growing_file_gives_whole_lines_once(spark, tmp_path):
    log, out = tmp_path / "eve.json", str(tmp_path / "out")
    log.write_text('{"a":1}\n{"a":2}\n{"a":')
    assert drained(spark, f"{tmp_path}/*.json", out) == [("eve.json", '{"a":1}'), ("eve.json", '{"a":2}')]
    with log.open("a") as f:
        f.write('3}\r\n\n"é')
    (tmp_path / "late.json").write_text("other\n")
    want = [("eve.json", '{"a":1}'), ("eve.json", '{"a":2}'), ("eve.json", '{"a":3}'), ("eve.json", ""), ("late.json", "other")]
    assert drained(spark, f"{tmp_path}/*.json", out) == want
    assert drained(spark, f"{tmp_path}/*.json", out) == want  # nothing new
    log.write_text("cut\n")  # shorter than what was read
    want.append(("eve.json", "cut"))
    assert drained(spark, f"{tmp_path}/*.json", out) == want
    os.rename(log, tmp_path / "eve.json.1")
    log.write_text("another file that is longer than the one before it\n")
    want.append(("eve.json", "another file that is longer than the one before it"))
    assert drained(spark, f"{tmp_path}/*.json", out) == want


def test_a_backlog_is_read_in_parts(spark, tmp_path):
    r = random.Random(6)
    lines = ["x" * r.choice([0, 1, 5, 30, 400]) + str(i) for i in range(300)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n" + "torn")
    assert [v for _, v in drained(spark, f"{tmp_path}/a.log", str(tmp_path / "out"), split=97)] == lines
    reader = growing.GrowingReader(f"{tmp_path}/a.log", 97)
    assert len(reader.partitions({}, reader.latestOffset())) > 100


@pytest.mark.parametrize("text, size, end", [(b"", 0, 0), (b"abc", 3, 0), (b"a\nbc", 4, 2), (b"a\n", 2, 2), (b"a\n" + b"x" * (growing.CHUNK * 2), 2 + growing.CHUNK * 2, 2)])
def test_where_whole_lines_end(tmp_path, text, size, end):
    (tmp_path / "f").write_bytes(text)
    with open(tmp_path / "f", "rb") as f:
        assert growing.whole_lines(f, size) == end


def test_a_batch_of_a_sensor_asks_the_state_store_little():
    import pandas as pd

    calls = []

    class Seen:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        timers = set()

        def getValueState(self, *_):
            return Seen()

        def listTimers(self):
            calls.append("list")
            return list(self.timers)

        def deleteTimer(self, t):
            calls.append("delete")
            self.timers.discard(t)

        def registerTimer(self, t):
            calls.append("register")
            self.timers.add(t)

    p = state.Presence(60_000_000, True, 0)
    p.init(Handle())
    for beats in ([5_000_000, 1_000_000], [9_000_000]):
        list(p.handleInputRows(("a",), iter([pd.DataFrame({"beat": beats, "packets": [1] * len(beats)})]), None))
    assert calls == ["get", "register", "update", "get", "delete", "register", "update"]
    assert Handle.timers == {69_000} and p.seen.value[:4] == (3, 3, 9_000_000, True)
