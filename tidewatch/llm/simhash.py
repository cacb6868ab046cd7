"""Operator 1: near-duplicates by SimHash, compared bit-sliced.

Fingerprints within a radius of r bits agree on at least PIECES - r of PIECES pieces of
their bits, so all that agree on some such choice of pieces are compared and no link is
lost. Rows of one key are compared with bit planes stored vertically: a machine word
holds one bit of 64 fingerprints, carry-save counters count the differing planes of 64
pairs at once, and a block whose pairs all exceed the radius is abandoned before its
remaining planes.

Equal fingerprints are one row from the start. A key with many rows is dealt into parts,
and every two of its parts meet in a task of their own. Tasks return the edges of a
spanning forest of what they found, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .components import components

BITS, RADIUS, PIECES, SHINGLE = 64, 3, 5, 3
#: Fingerprints of a part of a key; groups up to SMALL are compared many at a time.
PART, SMALL = 4096, 48


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a UTF-8 text; 0 if it has no words."""
    import xxhash

    words = text.lower().split()  # of bytes: only A-Z, only the six ASCII white space characters
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    counts, part = np.zeros(BITS, np.int64), 1 << 16
    for at in range(0, len(hashes), part):
        own = np.array(hashes[at : at + part], "<u8")
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in it:
        fps = np.array([fingerprint(t.as_py()) for t in rows.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(fps)], ["id", "fp"])


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(BITS, words): bit i of word j of plane b is bit b of fingerprint 64 j + i."""
    bits = np.zeros((-(-len(fps) // 64) * 64, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def beyond(differing, shape: tuple[int, ...], radius: int = RADIUS) -> np.ndarray:
    """A mask, in words of 64 lanes, of the lanes that differ in over `radius` planes.

    `differing(b, alive)` gives plane b of the differences of the rows `alive` of shape.
    The counters start so that they overflow at radius + 1. Rows all of whose lanes have
    overflowed are abandoned.
    """
    bits = radius.bit_length()
    counters = [np.full(shape, -((((1 << bits) - 1 - radius) >> k) & 1), np.int64).view(np.uint64) for k in range(bits)]
    over, out, alive = np.zeros(shape, np.uint64), np.full(shape, ~np.uint64(0)), np.arange(shape[0])
    for b in range(BITS):
        carry = differing(b, alive)
        for c in counters:
            carry, c[...] = c & carry, c ^ carry
        over |= carry
        if b % 8 == 7 and b < BITS - 1:
            open_ = ~(over == ~np.uint64(0)).reshape(len(alive), -1).all(axis=1)
            if not open_.all():
                counters, over, alive = [c[open_] for c in counters], over[open_], alive[open_]
                if not len(alive):
                    return out
    out[alive] = over
    return out


def _small(g: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges within short runs of equal g: each row against its d-th successor, for all d."""
    d, left, right = 1, [], []
    while d < len(g) and (same := np.flatnonzero(g[d:] == g[:-d])).size:
        planes = bit_planes(fp[same] ^ fp[same + d])[:, :, None]
        near = ~beyond(lambda b, alive: planes[b][alive], planes.shape[1:])
        hit = same[np.unpackbits(near.view(np.uint8), bitorder="little")[: len(same)] > 0]
        left.append(hit)
        right.append(hit + d)
        d += 1
    if not left:
        return
    i, j = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(g))
    while True:  # to the least row reachable
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            break
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
    moved = np.flatnonzero(label != np.arange(len(g)))
    yield fp[moved], fp[label[moved]]


def _large(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges within one group: each row against the planes of the whole group."""
    planes, rows = bit_planes(fp), []
    for at in range(0, len(fp), 512):
        q = fp[at : at + 512]

        def differing(b: int, alive: np.ndarray, q=q) -> np.ndarray:
            bit = -((q[alive] >> np.uint64(b)) & np.uint64(1)).astype(np.int64)
            return planes[b][None, :] ^ bit.view(np.uint64)[:, None]

        rows.append(~beyond(differing, (len(q), planes.shape[1])))
    near = np.concatenate(rows)
    lanes = lambda words: np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[: len(fp)])
    seen = np.zeros(planes.shape[1], np.uint64)
    for start in range(len(fp)):
        if seen[start >> 6] >> np.uint64(start & 63) & np.uint64(1):
            continue
        reached, frontier = np.zeros_like(seen), np.array([start])
        while len(frontier):
            new = np.bitwise_or.reduce(near[frontier], axis=0) & ~reached
            reached |= new
            frontier = lanes(new)
        seen |= reached
        others = lanes(reached)
        others = others[others != start]
        if len(others):
            yield fp[others], np.full(len(others), fp[start])


def _links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, fp), sorted by g, to edges (a, b)."""

    def compared(g: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(at, len(g)))
        small = np.repeat(sizes <= SMALL, sizes)
        found = [*_small(g[small], fp[small])]
        for a, n in zip(at[sizes > SMALL], sizes[sizes > SMALL]):
            found += _large(fp[a : a + n])
        for a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    gs, fs = [], []
    for rows in it:
        g, fp = rows.column("g").to_numpy(zero_copy_only=False), rows.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(g):
            continue
        gs.append(g)
        fs.append(fp)
        if g[0] != g[-1]:  # all but the last group are whole
            g, fp = np.concatenate(gs), np.concatenate(fs)
            cut = np.searchsorted(g, g[-1])
            yield from compared(g[:cut], fp[:cut])
            gs, fs = [g[cut:]], [fp[cut:]]
    if gs:
        yield from compared(np.concatenate(gs), np.concatenate(fs))


def _masks(radius: int, pieces: int) -> list[int]:
    cuts = [BITS * i // pieces for i in range(pieces + 1)]
    piece = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(piece, pieces - radius)]


def links(fingerprints: DataFrame, radius: int = RADIUS, pieces: int = PIECES, part: int = PART) -> DataFrame:
    """Edges (a, b) that join all fingerprints (a table of distinct `fp`) within `radius` bits."""
    keys = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(radius, pieces))]
    keyed = fingerprints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, ["t", "key"]).withColumn("parts", F.ceil(F.col("n") / part)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
    celled = keyed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # Two cells of the same number would be compared as one, which adds work but no links.
    celled = celled.select(F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp")
    return celled.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, pieces: int = PIECES) -> DataFrame:
    """Rows (id_col, fp, component_id), one for each row of docs: its fingerprint and the
    smallest id that links of at most `radius` bits reach, its own included.

    Null or empty text, or one without words: fingerprint 0, linked like any other. Null
    ids are kept and never the smallest; a component of nothing else has a null id.
    Repeated rows share a component. Other columns are ignored. No rows: no rows.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    fps = staged(base.mapInArrow(_fingerprints, f"id {id_type}, fp long"), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    comps = staged(components(staged(links(distinct.select("fp"), radius, pieces), "links")), "components")
    linked = distinct.join(comps, distinct["fp"] == comps["node"])
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    classes = distinct.join(comps.join(smallest, "root").select("node", "smallest"), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    # Written first, so that adaptive execution can split a fingerprint that very many rows share.
    return fps.join(staged(classes, "classes"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
