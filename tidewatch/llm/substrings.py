"""Operator 9: repeated byte windows, by a depth-limited radix sort of suffixes.

Suffixes are grouped only through their first `window` bytes, by most-significant-digit
passes; equal groups are exactly the repeated windows. The digits are hashes of these
bytes: which group comes first doesn't matter, only which suffixes are equal. After each
pass a group that lies in one document is done, and so is a suffix whose equal in a
smaller document is known; only the rest goes on to the next pass.

* The first digit of a window is the least hash of the k-byte strings in it. Windows
  that start next to each other mostly share it, so a run of them is one row. The second
  digit is a hash of all bytes that the run spans. Rows with both digits equal hold the
  same windows: all but those of the smallest document are covered as a whole.
* What is left are runs that share the first digit but not the second with another
  document (the edges of repeated passages). They meet again by the first digit, with the
  bytes that they span, and their windows are told apart by the third digit, 128 bits of
  hash of the window's own bytes. Only a group too large for one buffer sends its windows
  on by the third digit.

Rows that meet an equal of a smaller document in their own batch are settled before the
shuffle, and settled neighbours are one row, so a passage in very many documents sends
one row for each batch and a copied document hardly any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attached, row_key, staged, table
from .hashing import BASE, PIECE, mixed, powers, running_sums, utf8

WINDOW, KMER = 50, 16
SECOND = np.uint64(0xD6E8FEB86659FD93)
#: A position holds the first window's start and, in its last RUN bits, how many windows follow one another.
RUN = 16
BATCH_BYTES = 8 << 20
#: Most bytes of positions to be broadcast.
WIDE = 64 << 20
#: Runs whose windows are compared at a time.
BUFFER_ROWS = 16_384
NAMES = ["a", "c", "o", "rk", "pos", "settled"]
SCHEMA = "a long, c long, o long, rk long, pos long, settled boolean"


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values that follow one another."""
    out, size = h, 1
    while 2 * size <= w:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: len(out) - (w - size)], out[w - size :]) if size < w else out


def runs(b: np.ndarray, at: np.ndarray, window: int = WINDOW, k: int = KMER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first digit, second digit, document, start in it, windows) of all runs of windows
    of the documents b[at[i]:at[i + 1]]."""
    for a in range(0, len(b), PIECE):
        x = b[a : a + PIECE + window - 1]
        n = len(x) - window + 1
        if n <= 0:
            break
        sums, back = running_sums(x), powers(_inverse(BASE), len(x))
        low = _least(mixed((sums[k:] - sums[:-k]) * back[: len(x) - k + 1]), window - k + 1)
        whole = np.ones(n, bool)  # windows that don't run over a document's end
        ends = at[(at > a) & (at < a + n + window)] - a
        cross = (ends[:, None] - np.arange(1, window)[None, :]).ravel()
        whole[cross[(cross >= 0) & (cross < n)]] = False
        head = whole.copy()
        head[1:] &= (low[1:] != low[:-1]) | ~whole[:-1]
        start = np.flatnonzero(head)
        if not len(start):
            continue
        # A run ends before the next head or the next window that is not whole.
        stop = np.flatnonzero(np.append(head | ~whole, True))
        count = stop[np.searchsorted(stop, start, side="right")] - start
        most = (1 << RUN) - 1
        if (count > most).any():
            parts = -(-count // most)
            first = np.repeat(np.cumsum(parts) - parts, parts)
            j = np.arange(parts.sum()) - first
            start, count = np.repeat(start, parts) + j * most, np.minimum(np.repeat(count, parts) - j * most, most)
        end = start + count + window - 1
        second = mixed((sums[end] - sums[start]) * back[start] ^ count.astype(np.uint64))
        doc = np.searchsorted(at, start + a, side="right") - 1
        yield low[start], second, doc, start + a - at[doc], count


def _by_bytes(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(np.diff(utf8(rows.column("text"))[1]))
    a = 0
    while a < rows.num_rows:
        e = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH_BYTES)))
        yield rows.slice(a, e - a)
        a = e


def _longs(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy(zero_copy_only=False) for c in names]


def _merged(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows (doc, start, count), in order, with those that follow one another made one."""
    if not len(doc):
        return doc, start, count
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])))
    total = np.add.reduceat(count, first)
    most = (1 << RUN) - 1
    parts = -(-total // most)
    j = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(doc[first], parts), np.repeat(start[first], parts) + j * most, np.minimum(np.repeat(total, parts) - j * most, most)


def _first_digits(window: int, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in _by_bytes(batch):
                b, at = utf8(rows.column("text"))
                found = [*runs(b, at, window, k)]
                if not found:
                    continue
                a, c, doc, start, count = (np.concatenate(x) for x in zip(*found))
                o, rk = _longs(rows, "o", "rk")
                order = np.lexsort((o[doc], c, a))
                sa, sc, so = a[order], c[order], o[doc][order]
                new = np.append(True, (sa[1:] != sa[:-1]) | (sc[1:] != sc[:-1]))
                settled = np.zeros(len(a), bool)
                settled[order] = so > so[new][np.cumsum(new) - 1]
                # What is settled only travels with the rest; it is dealt out evenly.
                sd, ss, sn = _merged(doc[settled], start[settled], count[settled])
                a = np.concatenate([a[~settled], mixed(o[sd].astype(np.uint64) ^ mixed(ss.astype(np.uint64)))])
                c = np.concatenate([c[~settled], np.zeros(len(sd), np.uint64)])
                doc = np.concatenate([doc[~settled], sd])
                pos = np.concatenate([start[~settled] << RUN | count[~settled], ss << RUN | sn])
                done = np.arange(len(a)) >= len(a) - len(sd)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (a.view(np.int64), c.view(np.int64), o[doc], rk[doc], pos, done))], NAMES)

    return run


def _judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA, sorted by (a, c, o): those that are settled, having an equal (a, c) in a
    smaller document, and as not settled those whose a is in use with several c.

    Of the group that a batch ends in only the rows of its first c are held back, until
    another c shows up.
    """
    names = NAMES[2:]
    held, held_multi = [np.zeros(0, np.int64)] * 5, False
    for rows in it:
        done = rows.column("settled").to_numpy(zero_copy_only=False)
        own = _longs(rows, "a", "c", "o", "rk", "pos")
        if done.any():
            yield pa.RecordBatch.from_arrays([*(pa.array(x[done]) for x in own[2:]), pa.array(np.ones(int(done.sum()), bool))], names)
            own = [x[~done] for x in own]
        if not len(own[0]):
            continue
        known = len(held[0])
        a, c, o, rk, pos = (np.concatenate([x, y]) for x, y in zip(held, own))
        new_a = np.append(True, a[1:] != a[:-1])
        new = new_a | np.append(True, c[1:] != c[:-1])
        group = np.cumsum(new_a) - 1
        multi = (np.bincount(group, new) > 1)[group]
        if known and held_multi:
            multi[group == 0] = True
        settled = o > o[new][np.cumsum(new) - 1]
        fresh = np.arange(len(a)) >= (known if held_multi else 0)
        fresh_settled = np.arange(len(a)) >= known
        out = settled & fresh_settled | ~settled & multi & fresh
        yield pa.RecordBatch.from_arrays([*(pa.array(x[out]) for x in (o, rk, pos)), pa.array(settled[out])], names)
        held_multi = bool(multi[-1])
        keep = np.flatnonzero(new)[-1:] if held_multi else np.flatnonzero((group == group[-1]) & ~settled)
        held = [x[keep] for x in (a, c, o, rk, pos)]


def _spans(window: int, k: int):
    """Rows (o, rk, text, at) to a row for each run `at`: its first digit, its place and the bytes it spans."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            o, rk = _longs(rows, "o", "rk")
            for i in range(rows.num_rows):
                text = rows.column("text")[i].as_py().encode()
                at = np.unique(rows.column("at")[i].values.to_numpy(zero_copy_only=False))
                start, end = at >> RUN, (at >> RUN) + (at & ((1 << RUN) - 1)) + window - 1
                first = np.empty(len(at), np.uint64)
                for j in range(0, len(at), 256):  # a stretch of runs at a time
                    base, top = int(start[j]), int(start[j : j + 256].max()) + window
                    x = np.frombuffer(text[base:top], np.uint8)
                    sums = running_sums(x)
                    h = mixed((sums[k:] - sums[:-k]) * powers(_inverse(BASE), len(x))[: len(x) - k + 1])
                    first[j : j + 256] = _least(h, window - k + 1)[start[j : j + 256] - base]
                spans = [text[a:e] for a, e in zip(start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.full(len(at), o[i])), pa.array(np.full(len(at), rk[i])), pa.array(at), pa.array(spans, pa.binary())], ["a", "o", "rk", "pos", "span"])

    return run


def _third_digits(window: int, limit: int):
    """Runs with their bytes, sorted by the first digit, to rows of SCHEMA: ranges of windows
    that are settled, and of groups over `limit` runs those that aren't, to be told apart further on."""

    def judged(a: np.ndarray, o: np.ndarray, rk: np.ndarray, pos: np.ndarray, spans: pa.Array, torn: np.ndarray) -> pa.RecordBatch:
        x, at = utf8(spans)
        n = np.diff(at) - window + 1
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s, h = at[row] + within, []
        for m in (BASE, SECOND):
            sums = running_sums(x, m)
            h.append(mixed((sums[s + window] - sums[s]) * powers(_inverse(m), len(x))[s]))
        order = np.lexsort((o[row], h[1], h[0]))
        new = np.append(True, (h[0][order][1:] != h[0][order][:-1]) | (h[1][order][1:] != h[1][order][:-1]))
        so = o[row][order]
        settled = np.zeros(len(s), bool)
        settled[order] = so > so[new][np.cumsum(new) - 1]
        r, first, count = _merged(row[settled], ((pos >> RUN)[row] + within)[settled], np.ones(int(settled.sum()), np.int64))
        rest = np.flatnonzero(~settled & torn[row])
        # Windows with equal bytes have equal first digits, so no other group can settle them.
        zero = np.zeros(len(r), np.int64)
        cols = (
            np.concatenate([zero, h[0][rest].view(np.int64)]), np.concatenate([zero, h[1][rest].view(np.int64)]), np.concatenate([o[r], o[row[rest]]]), np.concatenate([rk[r], rk[row[rest]]]),
            np.concatenate([first << RUN | count, ((pos >> RUN)[row[rest]] + within[rest]) << RUN | 1]), np.arange(len(r) + len(rest)) < len(r),
        )
        return pa.RecordBatch.from_arrays([*map(pa.array, cols)], NAMES)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, torn = [], 0, None

        def flush(upto: int | None):
            """Judges the rows before `upto` (all, if None); the rest is held."""
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            cut = t.num_rows if upto is None else upto
            own = t.slice(0, cut)
            a, o, rk, pos = (own.column(c).to_numpy() for c in ("a", "o", "rk", "pos"))
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
            if cut:
                column = own.column("span")
                spans = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
                yield judged(a, o, rk, pos, spans.chunk(0) if isinstance(spans, pa.ChunkedArray) else spans, a == torn if torn is not None else np.zeros(cut, bool))

        for rows in it:
            if not rows.num_rows:
                continue
            held.append(rows)
            size += rows.num_rows
            if size >= limit:
                a = np.concatenate([x.column("a").to_numpy(zero_copy_only=False) for x in held])
                cut = int(np.searchsorted(a, a[-1]))
                if not cut:  # one group fills the buffer
                    torn = a[-1]
                    yield from flush(None)
                else:
                    yield from flush(cut)
        if held:
            yield from flush(None)

    return run


def _covered(window: int):
    """Rows (po, prk, at) with the ranges of windows `at` made byte intervals that don't touch: starts, then ends."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            out = []
            for at in rows.column("at"):
                p = np.sort(at.values.to_numpy(zero_copy_only=False))
                s, e = p >> RUN, np.maximum.accumulate((p >> RUN) + (p & ((1 << RUN) - 1)) + window - 1)
                new = np.append(True, s[1:] > e[:-1])
                out.append(np.concatenate([s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]]))
            yield pa.RecordBatch.from_arrays([rows.column("po"), rows.column("prk"), pa.array(out, pa.list_(pa.int64()))], ["po", "prk", "at"])

    return run


def _cut_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in it:
        out = []
        for i in range(rows.num_rows):
            b, at = rows.column("text")[i].as_py().encode(), rows.column("at")[i]
            ends = at.values.to_numpy(zero_copy_only=False).tolist() if at.is_valid else []
            starts, ends = ends[: len(ends) // 2], ends[len(ends) // 2 :]
            kept = b"".join(b[p:q] for p, q in zip([0, *ends], [*starts, len(b)]))
            out.append((len(b), len(b) - len(kept), len(starts), kept))
        n, removed, spans, kept = zip(*out) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = KMER, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """Rows (id_col, n_bytes, n_removed, n_spans, kept_sha256, kept), one for each row of docs.

    Each byte is removed that a `window`-byte string covers which also starts in a
    document of a smaller id; `kept` holds the other bytes. Null or empty text, or one
    shorter than the window: nothing is removed. A null id comes after all others.
    Repeated rows, and rows that share an id, are one document: they never remove
    anything from each other, and equal rows get equal results. Ids must be whole
    numbers. Other columns are ignored. No rows: no rows.
    """
    last = (1 << 63) - 1
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("o"))
    n, ids = base.agg(F.count(F.lit(1)), F.count_distinct("o")).first()
    # Rows that share an id are told apart by their texts; else the key stays empty and weighs nothing.
    base = base.withColumn("rk", row_key("o", "text") if ids < n else F.lit(0).cast("long"))
    order = ["a", "c", "o"]
    digits = base.select("o", "rk", "text").mapInArrow(_first_digits(window, k), SCHEMA)
    judged = digits.repartition(F.col("a")).sortWithinPartitions(*order).mapInArrow(_judged, "o long, rk long, pos long, settled boolean")
    judged = staged(judged, "settled")
    grouped = lambda df: df.groupBy(F.col("o").alias("po"), F.col("rk").alias("prk")).agg(F.collect_set("pos").alias("at"))
    same = (F.col("o") == F.col("po")) & (F.col("rk") == F.col("prk"))
    room = lambda df: 48 + 8 * int((df.agg(F.avg(F.size("at"))).first()[0] or 0) + 1)
    open_ = staged(grouped(judged.filter("not settled")), "open")
    some = attached(base.select("o", "rk", "text"), open_, same, "inner", room(open_), WIDE)
    if ids < n:  # one of several equal rows stands for all
        some = some.dropDuplicates(["o", "rk"])
    spans = some.select("o", "rk", "text", "at").mapInArrow(_spans(window, k), "a long, o long, rk long, pos long, span binary")
    edges = staged(spans.repartition(F.col("a")).sortWithinPartitions("a", "o").mapInArrow(_third_digits(window, buffer_rows), SCHEMA), "edges")
    rest = edges.filter("not settled").repartition(F.col("a")).sortWithinPartitions(*order).mapInArrow(_judged, "o long, rk long, pos long, settled boolean")
    ranges = judged.filter("settled").select("o", "rk", "pos").unionByName(edges.filter("settled").select("o", "rk", "pos")).unionByName(rest.filter("settled").select("o", "rk", "pos"))
    gone = staged(grouped(ranges).mapInArrow(_covered(window), "po long, prk long, at array<long>"), "gone")
    out = attached(base, gone, same, "left", room(gone), WIDE).select("id", "text", "at")
    kinds = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return out.mapInArrow(_cut_out, kinds).withColumnRenamed("id", id_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
