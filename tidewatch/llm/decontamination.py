"""Operator 2: benchmark items inside documents, by size-partitioned MinHash containment.

Items are partitioned by the number of their shingles. An item's sketch is its s least
shingle hashes, where its partition's upper size u sets s = floor((1 - t) u) + 1: of any
s of its shingles, one at least is in every document that holds a share t of them. So a
document is looked up by its shingles' hashes, whatever its length, and no document that
should be found is missed, which banded signatures can't promise for short items inside
long documents. Candidates are verified by exact shingle containment, on the words.

Documents are scanned where they lie. The sketches are sent to all tasks if their counted
size allows it; else the documents' hashes up to the greatest of all sketches are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, attached, row_key, staged, table
from .hashing import shingles, words

SHINGLE, CONTAINMENT = 5, 0.8


def _hashes(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text; a text of fewer than k words is one shingle."""
    h, t = words(column)
    s, first = shingles(h, t, k)
    owner, at = t[first], np.searchsorted(t, np.arange(len(column) + 1))
    cuts = np.searchsorted(owner, np.arange(len(column) + 1))
    for i in range(len(column)):
        own = s[cuts[i] : cuts[i + 1]]
        if not len(own) and (n := at[i + 1] - at[i]):
            own = shingles(h[at[i] : at[i + 1]], t[at[i] : at[i + 1]], int(n))[0]
        yield np.unique(own)


def _sketches(k: int, t: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            for i, h in enumerate(_hashes(rows.column("text"), k)):
                if len(h):
                    part = int(len(h)).bit_length()
                    upper = (1 << part) - 1
                    own = h[: min(len(h), int((1 - t) * upper + 1e-9) + 1)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([rows.column("item").slice(i, 1).take(pa.array(np.zeros(len(own), np.int64))), pa.array(np.full(len(own), part, np.int32)), pa.array(own)], ["item", "part", "h"])

    return run


def _look_up(k: int, wanted, ceiling: int):
    """Rows (id, rk, h): the distinct hashes of each document that are in `wanted`, or at most `ceiling` if that is None."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        if known is not None:
            seen = np.zeros(1 << 16, bool)
            seen[(known >> np.uint64(48)).astype(np.int64)] = True
        for rows in it:
            ids, found = [], []
            for i, h in enumerate(_hashes(rows.column("text"), k)):
                if known is None:
                    h = h[h <= np.uint64(ceiling)]
                else:
                    h = h[seen[(h >> np.uint64(48)).astype(np.int64)]]
                    at = np.searchsorted(known, h)
                    h = h[known[np.minimum(at, len(known) - 1)] == h] if len(known) else h[:0]
                ids.append(np.full(len(h), i))
                found.append(h)
            take = pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("id").take(take), rows.column("rk").take(take), pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], ["id", "rk", "h"])

    return run


def exact_shingles(text: str, k: int = SHINGLE) -> set[bytes]:
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _verify(k: int, t: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for rows in it:
            total, shared = [], []
            for rk, text, item in zip(rows.column("rk").to_pylist(), rows.column("text"), rows.column("item_text")):
                if rk != last:
                    last, own = rk, exact_shingles(text.as_py(), k)
                want = exact_shingles(item.as_py(), k)
                total.append(len(want))
                shared.append(len(want & own))
            keep = pa.array(np.flatnonzero(np.array(shared, float) >= t * np.array(total, float) - 1e-9))
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in (rows.column("id"), rows.column("item_id"), pa.array(total, pa.int64()), pa.array(shared, pa.int64()))], ["id", "item_id", "n_shingles", "n_shared"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE, t: float = CONTAINMENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (id_col, item_col, n_shingles, n_shared, containment): the pairs of a document
    and an item of whose distinct k-word shingles it holds a share of at least t.

    Words are parted by ASCII white space, with A-Z in lower case. Null or empty texts,
    or texts without words, are in no pair. An item of fewer than k words is one shingle,
    and is found in documents of just these words. Null ids are kept. Equal rows, of
    documents or items, give one pair; an id with several texts gives one for each that
    holds the item. Other columns are ignored. Either table empty: no rows.
    """
    spark = docs.sparkSession
    kind = lambda df, c: df.select(c).schema[0].dataType.simpleString()
    base = docs.filter(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("rk", row_key("id", "text"))
    own = items.filter(F.length(item_text_col) > 0).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).withColumn("item", row_key("item_id", "item_text"))
    own = staged(own.dropDuplicates(["item", "item_id"]), "items")
    sketches = staged(own.select("item", F.col("item_text").alias("text")).mapInArrow(_sketches(k, t), "item long, part int, h long"), "sketches")
    if 8 * sketches.count() <= broadcast_bytes:
        known = np.unique(sketches.select("h").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64))
        hits = base.mapInArrow(_look_up(k, spark.sparkContext.broadcast(known), 0), f"id {kind(docs, id_col)}, rk long, h long")
    else:
        # As unsigned numbers: a hash with its first bit set is above all others.
        top = sketches.agg(F.max(F.col("h").bitwiseXOR(F.lit(-(1 << 63))))).first()[0]
        hits = base.mapInArrow(_look_up(k, None, (top ^ -(1 << 63)) & ((1 << 64) - 1)), f"id {kind(docs, id_col)}, rk long, h long")
    pairs = hits.join(sketches.select("h", "item"), "h").select("id", "rk", "item").distinct()
    pairs = staged(pairs.join(own, "item").select(F.col("id").alias("pid"), F.col("rk").alias("prk"), "item_id", "item_text"), "candidates")
    # Equal rows of documents are one document here.
    room = 64 + int(pairs.agg(F.avg(F.octet_length("item_text"))).first()[0] or 0) + 1
    held = attached(base, pairs, F.col("id").eqNullSafe(F.col("pid")) & (F.col("rk") == F.col("prk")), "inner", room)
    found = held.select("id", "rk", "text", "item_id", "item_text").mapInArrow(_verify(k, t), f"id {kind(docs, id_col)}, item_id {kind(items, item_col)}, n_shingles long, n_shared long").distinct()
    return found.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = """
WITH texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
s AS (SELECT DISTINCT kind, id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS s FROM w WHERE len(w) > 0),
n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE kind = 1 GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.s = i.s AND d.kind = 0 AND i.kind = 1 GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8::DOUBLE * n_shingles - 1e-9
"""
