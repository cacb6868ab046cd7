"""State by key with timers: what sensors count and whether they are heard, and statuses as they change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keep_state_on_disk(spark: SparkSession) -> None:
    """State with timers needs the provider that keeps it in RocksDB; queries started from now on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Presence(StatefulProcessor):
    """What a sensor counted, and when it fell silent. Times are microseconds; see `sensor_presence`."""

    def __init__(self, silence_us: int, by_event_time: bool, ttl_seconds: int) -> None:
        self.silence, self.by_event_time, self.ttl = silence_us, by_event_time, ttl_seconds

    def init(self, handle) -> None:
        self.handle = handle
        # Only timers of arrival time let Spark drop state by age itself.
        ttl = None if self.by_event_time else self.ttl * 1000
        self.seen = handle.getValueState("seen", "packets long, events long, beat long, online boolean, wake long", ttl)

    def _wake(self, at_ms: int, known: bool, before_ms: int | None) -> None:
        """Moves the timer of a key; each call is a round trip to the state store, so what the state tells isn't asked."""
        if before_ms == at_ms:
            return
        # State that arrival time has dropped may have left a timer.
        old = list(self.handle.listTimers()) if not known and not self.by_event_time else [] if before_ms is None else [before_ms]
        for t in old:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = self.seen.get()
        packets, events, last, online, timer = had or (0, 0, -1, False, None)
        at, sent = (np.concatenate(x) for x in zip(*((b["beat"].to_numpy(np.int64), b["packets"].to_numpy(np.int64)) for b in rows)))
        order = np.argsort(at, kind="stable")
        at, total = at[order], packets + sent[order].cumsum()
        count = events + np.arange(1, len(at) + 1)
        before = np.maximum.accumulate(np.append(last, at))[:-1]  # the latest beat until then
        out = []
        if self.by_event_time:
            # A beat that comes after a silence ends it; one from before the latest beat changes no status.
            wakes = (at > before) & ((before < 0) | (at - before > self.silence))
            wakes[0] |= not online and at[0] > last
            for i in np.flatnonzero(wakes):
                if online and before[i] >= 0 and at[i] - before[i] > self.silence:
                    out.append((before[i] + self.silence, "offline", True, *((total[i - 1], count[i - 1]) if i else (packets, events)), before[i]))
                out.append((at[i], "online", True, total[i], count[i], at[i]))
                online = True
        elif not online:
            out.append((timerValues.getCurrentProcessingTimeInMs() * 1000, "online", True, total[0], count[0], max(last, at[0])))
        beat, online = max(last, int(at[-1])), True
        state = (int(total[-1]), int(count[-1]), beat)
        out.append((beat, "online", False, *state))
        wake = -((-beat if self.by_event_time else -timerValues.getCurrentProcessingTimeInMs() * 1000) // 1000) + self.silence // 1000
        self._wake(wake, had is not None, timer)
        self.seen.update((*state, True, wake))
        yield _presence_rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if had := self.seen.get():
            packets, events, beat, online, _ = had
            if online:
                self.seen.update((packets, events, beat, False, None))
                at = beat + self.silence if self.by_event_time else expiredTimerInfo.getExpiryTimeInMs() * 1000
                yield _presence_rows(key, [(at, "offline", True, packets, events, beat)])

    def close(self) -> None:
        pass


def _presence_rows(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    names = ["at", "status", "changed", "packets", "events_seen", "beat"]
    return pd.DataFrame({"sensor": [key[0]] * len(rows)} | dict(zip(names, map(list, zip(*rows)))))


def sensor_presence(stream: DataFrame, sensor: str, beat: str, packets: str, silence_seconds: int = 30, delay: str | None = None, ttl_seconds: int = 7 * 86_400) -> DataFrame:
    """Rows (sensor, at, status, changed, packets, events_seen, beat), times in microseconds: for each batch what a
    sensor has counted until then, and, with `changed`, a row when it comes online or goes offline.

    A sensor goes offline `silence_seconds` after its last beat: a timer says so, whether or not
    another batch comes. Without `delay` the clock is that of arrival, and state goes after `ttl_seconds`
    of silence; such a stream never runs out of batches, so it can't be drained. With it the clock is the watermark, `delay` behind the latest beat: silences
    are those between beats, so a replay gives the same rows; beats from before a sensor's
    latest one are counted and change no status.
    """
    _keep_state_on_disk(stream.sparkSession)
    own = stream.select(F.col(sensor).alias("sensor"), F.col(beat).alias("ts"), F.unix_micros(beat).alias("beat"), F.coalesce(F.col(packets), F.lit(0)).cast("long").alias("packets"))
    if delay:
        own = own.withWatermark("ts", delay)
    kind = own.schema["sensor"].dataType.simpleString()
    processor = Presence(silence_seconds * 1_000_000, delay is not None, ttl_seconds)
    out = f"sensor {kind}, at long, status string, changed boolean, packets long, events_seen long, beat long"
    return own.groupBy("sensor").transformWithStateInPandas(processor, out, "append", "eventTime" if delay else "processingTime")


class Changes(StatefulProcessor):
    """The last version and status of a key; see `status_changes`."""

    def __init__(self, keys: list[str], ttl_seconds: int | None) -> None:
        self.keys, self.ttl = keys, ttl_seconds

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "version long, status string", self.ttl and self.ttl * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, status = self.last.get() if self.last.exists() else (None, None)
        batch = pd.concat(list(rows))
        if version is not None:
            batch = batch[batch["version"] > version]
        batch = batch.sort_values(["version", "status"]).drop_duplicates("version", keep="last")
        if len(batch):
            before = batch["status"].shift()
            before.iloc[0] = status
            out = batch.loc[batch["status"] != before, ["version", "status"]]
            self.last.update((int(batch["version"].iloc[-1]), batch["status"].iloc[-1]))
            for i, k in enumerate(self.keys):
                out.insert(i, k, key[i])
            if len(out):
                yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from ()

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame, keys: list[str], version: str, status: str, ttl_seconds: int | None = None) -> DataFrame:
    """Rows (*keys, version, status): the rows whose status isn't that of their key's version before.

    A version that isn't above the last one seen, one that is sent again or comes late, is passed over,
    so a repeated batch tells nothing twice. State is the last status of each key, for `ttl_seconds` if given.
    """
    _keep_state_on_disk(stream.sparkSession)
    own = stream.select(*keys, F.col(version).cast("long").alias("version"), F.col(status).alias("status"))
    fields = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)
    return own.groupBy(*keys).transformWithStateInPandas(Changes(keys, ttl_seconds), f"{fields}, version long, status string", "append", "processingTime" if ttl_seconds else "none")
