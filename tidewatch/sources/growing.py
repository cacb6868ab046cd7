"""A streaming source that follows files while they grow, by byte offsets.

Only whole lines are read: a last line without its end waits until the rest is written. A
file that was cut short, or replaced by another one, is read from its start. Each batch is a
range of bytes of each file, so a repeated batch reads the same lines again and no others.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file's beginning by which it is known again, read at once, and read by a task.
HEAD, CHUNK, SPLIT = 1024, 1 << 20, 64 << 20
SCHEMA = "path string, at long, value string"


def whole_lines(f, size: int) -> int:
    """Where the last whole line of the first `size` bytes ends, searched from their end."""
    end = size
    while end > 0:
        start = max(0, end - CHUNK)
        f.seek(start)
        found = f.read(end - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return 0


def head(path: str, length: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(length))


@dataclass
class Lines(InputPartition):
    path: str
    start: int
    end: int
    first: bool  # whether `start` is where a line starts for certain


class GrowingReader(DataSourceStreamReader):
    def __init__(self, pattern: str, split: int) -> None:
        self.pattern, self.split = pattern, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            with open(path, "rb") as f:
                stat = os.fstat(f.fileno())
                known = min(HEAD, stat.st_size)
                out[path] = {"file": stat.st_ino, "at": whole_lines(f, stat.st_size), "known": known, "head": head(path, known)}
        return out

    def _goes_on(self, path: str, was: dict | None, now: dict) -> bool:
        """Whether a file is the one that was read before, and no shorter."""
        return was is not None and was["file"] == now["file"] and was["at"] <= now["at"] and head(path, was["known"]) == was["head"]

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        out = []
        for path, now in end.items():
            at = start[path]["at"] if self._goes_on(path, start.get(path), now) else 0
            out += [Lines(path, a, min(a + self.split, now["at"]), a == at) for a in range(at, now["at"], self.split)]
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        """The lines that start within the range of bytes."""
        rows: list[tuple[str, int, str]] = []
        size = 0
        with open(partition.path, "rb") as f:
            at = partition.start
            if not partition.first:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the rest of a line that started before
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    break  # the file was cut meanwhile
                rows.append((partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                at, size = at + len(line), size + len(line)
                if size >= CHUNK:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    path, at, value = zip(*rows)
    return pa.RecordBatch.from_pydict({"path": pa.array(path), "at": pa.array(at, pa.int64()), "value": pa.array(value)})


class GrowingFiles(DataSource):
    """Format growing_files: rows (path, at, value), the lines of all files that match option `path`."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("split", SPLIT)))


def follow_growing(spark: SparkSession, pattern: str, split: int = SPLIT) -> DataFrame:
    """A stream of the lines of files that match a glob pattern, on a file system that the driver and all
    executors have mounted. A file that doesn't exist yet is followed once it does; one that has gone is
    forgotten. A backlog is read in parts of `split` bytes, each by a task."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", pattern).option("split", split).load()
