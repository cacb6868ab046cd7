"""Documents alike by the exact Jaccard similarity of their word shingles, for the pipeline.

1. Candidates are found by SimHash, as op1 has it: the class of like fingerprints is a key of
   each distinct set of shingles. Its three bits are too few for a similarity of 0.8, so each
   set has BANDS keys of ROWS MinHash values more. A pair of similarity s shares none of
   these with probability (1 - s ** ROWS) ** BANDS: 7e-6 at 0.8.
2. Sets that share keys, directly or through others, are a group; a large group is dealt
   into parts, and every two of its parts meet in a task of their own.
3. There each pair that shares a key and isn't linked already is compared exactly, set
   against set, and only pairs of at least the similarity asked for are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import attached, row_key, staged
from .components import components
from .hashing import mixed, shingles, words
from .substrings import _by_bytes

SHINGLE, SIMILARITY, ROWS, BANDS, PART = 5, 0.8, 5, 30, 2048
FACTORS = np.random.default_rng(5).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): of each text the sorted hashes of its distinct k-word shingles. A
    text of fewer words has one shingle, all of them; one without words has none."""
    h, t = words(column)
    s, first = shingles(h, t, k)
    doc, n = [t[first]], np.bincount(t, minlength=len(column))
    s = [s]
    for m in range(1, k):
        if (n == m).any():
            own = (n == m)[t]
            x, at = shingles(h[own], t[own], m)
            s.append(mixed(x + np.uint64(m)))
            doc.append(t[own][at])
    s, doc = np.concatenate(s), np.concatenate(doc)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.append(True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1]))[: len(s)]
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(column) + 1))


def band_keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of the sets s[at[i]:at[i + 1]], none of them empty."""
    out = np.zeros((len(at) - 1, BANDS), np.uint64)
    for b, row in enumerate(FACTORS):
        for f in row:
            out[:, b] = mixed(out[:, b] ^ np.minimum.reduceat(s * f, at[:-1]))
    return out


def _digests(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each set a hash; 0 of the empty one."""
    sums = np.append(np.uint64(0), np.cumsum(mixed(s), dtype=np.uint64))
    n = np.diff(at).astype(np.uint64)
    return np.where(n > 0, mixed((sums[at[1:]] - sums[at[:-1]]) ^ n), np.uint64(0))


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.ascontiguousarray(flat).view(np.int64)))


def _keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for rows in _by_bytes(batch):
            s, at = shingle_sets(rows.column("text"))
            full = np.flatnonzero(np.diff(at))
            keys = band_keys(s, np.append(at[full], len(s))) if len(full) else np.zeros((0, BANDS), np.uint64)
            ends = np.append(0, np.cumsum(np.where(np.diff(at) > 0, BANDS, 0)))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("rk"), pa.array(_digests(s, at).view(np.int64)), _lists(keys.ravel(), ends)], ["id", "rk", "node", "keys"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for rows in _by_bytes(batch):
            s, at = shingle_sets(rows.column("text"))
            yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("root"), rows.column("parts"), rows.column("keys"), _lists(s, at)], ["node", "root", "parts", "keys", "shingles"])


def alike(keys: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Of each set the number of the least one that links reach: pairs that share a key and
    are of at least `similarity`."""
    n, label, size = len(sets), np.arange(len(sets)), np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.append(0, np.cumsum(size))
    held = np.zeros(flat.max() + 1, bool)
    order = np.argsort(keys, axis=0, kind="stable")
    ranked = np.take_along_axis(keys, order, axis=0)
    lo, hi = (np.stack([np.searchsorted(ranked[:, b], keys[:, b], side=x) for b in range(keys.shape[1])], 1) for x in ("left", "right"))
    for i in range(n - 1):
        near = [order[a:e, b] for b, (a, e) in enumerate(zip(lo[i].tolist(), hi[i].tolist())) if e - a > 1]
        if not near:
            continue
        j = np.unique(np.concatenate(near))
        j = j[(j > i) & (label[j] != label[i])]
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9]
        if not len(j):
            continue
        own = flat[at[i] : at[i + 1]]
        held[own] = True
        where = np.repeat(at[j] - np.append(0, np.cumsum(size[j])[:-1]), size[j]) + np.arange(size[j].sum())
        common = np.add.reduceat(held[flat[where]].astype(np.int64), np.append(0, np.cumsum(size[j])[:-1]))
        held[own] = False
        hit = j[common >= similarity * (size[i] + size[j] - common) - 1e-9]
        if len(hit):
            joined = np.unique(label[np.append(hit, i)])
            label[np.isin(label, joined)] = joined[0]
    return label


def _links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, node, keys, shingles), sorted by g, to edges (a, b)."""
    cell, held = None, []

    def whole() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            nodes = np.array([x[0] for x in held])
            label = alike(np.stack([x[1] for x in held]), [x[2] for x in held])
            moved = np.flatnonzero(label != np.arange(len(held)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])

    for rows in it:
        keys, sets = rows.column("keys"), rows.column("shingles")
        for i, (g, node) in enumerate(zip(rows.column("g").to_pylist(), rows.column("node").to_pylist())):
            if g != cell:
                yield from whole()
                cell, held = g, []
            # Copies, so that no batch is kept for one row.
            held.append((node, *(c[i].values.to_numpy(zero_copy_only=False).copy() for c in (keys, sets))))
    yield from whole()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """Rows (id_col, component_id), one for each row of docs: the smallest id that links of
    documents reach whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Words are parted by ASCII white space, with A-Z in lower case. Texts without words are
    alike. Null ids are kept and never the smallest; a component of nothing else has a null
    id. Other columns are ignored. No rows: no rows.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = staged(base.mapInArrow(_keyed, f"id {id_type}, rk long, node long, keys array<long>"), "band-keys")
    distinct = staged(keyed.groupBy("node").agg(F.min("id").alias("first"), F.min("rk").alias("rk"), F.first("keys").alias("keys")), "distinct-sets")
    # One text of each set; rows that share an id and a text give the same fingerprint.
    one = attached(base, distinct.select("node", F.col("rk").alias("nrk")), F.col("rk") == F.col("nrk"), "inner", 32).select("node", "text")
    classes = simhash.near_duplicates(one, "node").groupBy("node").agg(F.min("component_id").alias("class"))
    with_class = F.when(F.size("keys") > 0, F.concat("keys", F.array("class"))).otherwise(F.col("keys"))
    distinct = staged(distinct.join(classes, "node", "left").select("node", "first", "rk", with_class.alias("keys")), "distinct-keys")
    banded = distinct.select("node", F.posexplode("keys").alias("band", "key"))
    least = banded.groupBy("band", "key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = staged(components(staged(banded.join(least, ["band", "key"]).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "shared-keys")), "key-groups")
    sized = groups.join(groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts")), "root")
    members = staged(sized.join(distinct, "node").select("node", "root", "parts", "keys", F.col("rk").alias("mrk")), "members")
    # One text of each set, however many rows share an id and a text.
    texts = attached(base, members, F.col("rk") == F.col("mrk"), "inner", 72 + 8 * BANDS).select("node", "root", "parts", "keys", "text").dropDuplicates(["node"])
    sets = texts.mapInArrow(_sets, "node long, root long, parts long, keys array<long>, shingles array<long>").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    celled = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    celled = celled.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "node", "keys", "shingles")
    links = staged(celled.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(_links, "a long, b long"), "set-links")
    comps = staged(components(links), "set-components")
    linked = distinct.select("node", "first").join(comps, "node")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    classes = distinct.select("node", "first").join(comps.join(smallest, "root").select("node", "smallest"), "node", "left").select("node", F.coalesce("smallest", "first").alias("component_id"))
    # Written first, so that adaptive execution can split a set that very many rows share.
    return keyed.select("id", "node").join(staged(classes, "set-classes"), "node").select(F.col("id").alias(id_col), "component_id")
