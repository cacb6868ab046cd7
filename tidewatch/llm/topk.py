"""Operator 3: exact top-k search by block-at-a-time pruning.

Dimensions are terms and components their impacts. The rows of a shard are put in an
order that brings like vectors together and cut into ranges, the blocks; each has the
greatest and the least impact of every term. For a query, the sum over its terms of the
best a block could give bounds all scores in the block. Each query takes the blocks in
the order of their bounds, scores a whole block through its forward index, and ends
where the bound falls below its k-th score.

A shard's vectors are read once, and the queries stream past them: what is shuffled is
the vectors, and the queries once for each shard. Shards grow with the table once there
are MANY_SHARDS, up to MAX_ROWS vectors; then their number grows. Every shard gives at
most k rows for each query.

How much is skipped depends on the vectors: those in clusters are skipped in most blocks,
those spread evenly over all directions in none, as some vector of each block could be near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

SHARD_ROWS, MANY_SHARDS, MAX_ROWS, BLOCK, QUERY_ROWS = 4096, 1024, 1 << 18, 64, 512
#: Whole numbers below this are exact in float64.
EXACT = 1 << 53


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), dim)


class Blocks:
    """Forward indexes and term bounds of the vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK):
        v = vectors.astype(np.float64)
        pivots = v[:: max(1, len(v) // 64)]
        order = np.lexsort((ids, np.argmax(v @ pivots.T, axis=1)))
        self.ids, self.v, self.raw = ids[order], v[order], vectors[order]
        self.cuts = np.arange(0, len(v), block)
        self.most, self.least = (f.reduceat(self.v, self.cuts, axis=0) for f in (np.maximum, np.minimum))
        self.ends = np.append(self.cuts[1:], len(v))
        self.scored = 0  # pairs of a query and a vector
        self.peak = max((abs(int(x)) for x in (vectors.min(), vectors.max())), default=0) if vectors.size else 0

    def top(self, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, ids, filled), each (queries, k), in order."""
        n, dim = queries.shape
        peak = max((abs(int(x)) for x in (queries.min(), queries.max())), default=0) if queries.size else 0
        if dim * self.peak * peak >= EXACT:  # beyond float64: in Python's whole numbers, without bounds
            scores = np.clip(queries.astype(object) @ self.raw.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)
            return self._merge(scores[:, :0], np.zeros((n, 0), np.int64), np.zeros((n, 0), bool), scores, np.broadcast_to(self.ids, scores.shape), self.ids[None, :] != qids[:, None], k)
        q = queries.astype(np.float64)
        bounds = np.maximum(q, 0) @ self.most.T + np.minimum(q, 0) @ self.least.T
        turn = np.argsort(-bounds, axis=1, kind="stable")
        best, ids, filled = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        open_ = np.arange(n)
        for r in range(len(self.cuts)):
            block = turn[open_, r]
            # A bound that equals the k-th score may still hide a smaller id.
            go = ~filled[open_, -1] | (bounds[open_, block] >= best[open_, -1])
            open_, block = open_[go], block[go]
            if not len(open_):
                break
            for b in np.unique(block):
                rows = open_[block == b]
                a, e = self.cuts[b], self.ends[b]
                self.scored += len(rows) * int(e - a)
                scores = (q[rows] @ self.v[a:e].T).astype(np.int64)
                own = np.broadcast_to(self.ids[a:e], scores.shape)
                best[rows], ids[rows], filled[rows] = self._merge(best[rows], ids[rows], filled[rows], scores, own, own != qids[rows, None], k)
        return best, ids, filled

    @staticmethod
    def _merge(best, ids, filled, scores, more, valid, k):
        s, i, f = np.concatenate([best, scores], 1), np.concatenate([ids, more], 1), np.concatenate([filled, valid], 1)
        order = np.lexsort((i, -s.astype(np.float64) if abs(s).max(initial=0) < EXACT else ~s, ~f), axis=1)[:, :k]
        pad = max(0, k - order.shape[1])
        return tuple(np.pad(np.take_along_axis(x, order, 1), ((0, 0), (0, pad))) for x in (s, i, f))


def _search(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, dim, is_query, id, v), sorted so that a shard's vectors precede its queries."""
        key, held, blocks = None, [], None
        for rows in it:
            shard, dims, asks = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "dim", "is_query"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dims) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, e in zip([0, *cuts], [*cuts, len(shard)]):
                if a == e:
                    continue
                own, dim = rows.slice(a, e - a), int(dims[a])
                ids, v = own.column("id").to_numpy(zero_copy_only=False), _matrix(own.column("v"), dim)
                if (shard[a], dim) != key:
                    key, held, blocks = (shard[a], dim), [], None
                if not asks[a]:
                    held.append((ids, v))
                    continue
                if blocks is None and held:
                    blocks, held = Blocks(*(np.concatenate(x) for x in zip(*held))), []
                for at in range(0, len(ids) if blocks else 0, QUERY_ROWS):
                    q = ids[at : at + QUERY_ROWS]
                    scores, found, filled = blocks.top(q, v[at : at + QUERY_ROWS], k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, k)[filled.ravel()]), pa.array(found.ravel()[filled.ravel()]), pa.array(scores.ravel()[filled.ravel()])], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row (id, v) of whole-number vectors
    for which the condition `is_query` holds, the k highest inner products with the rows
    of other ids, ties to the smaller id; all of them, if fewer.

    Null ids or vectors, and vectors with null components, take no part. Vectors are
    scored only against those of their own length. Equal rows are one row; an id with
    several vectors is a candidate, or a query, with each of them, and its best score
    counts. Scores are exact, and end at the limits of a long. No rows: no rows.
    """
    sound = vectors.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    sound = staged(sound.select(F.col("id").cast("long"), F.col("v").cast("array<long>"), F.size("v").alias("dim")).distinct(), "vectors")
    n = sound.count()
    shards = max(1, min(MANY_SHARDS, -(-n // shard_rows)), -(-n // MAX_ROWS))
    held = sound.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "dim", F.lit(False).alias("is_query"), "id", "v")
    asks = sound.filter(is_query).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "dim", F.lit(True).alias("is_query"), "id", "v")
    dealt = held.unionByName(asks).repartition(F.col("shard")).sortWithinPartitions("shard", "dim", "is_query")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = raw.filter(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return top_k(finite.select("id", F.transform("e", lambda x: F.floor(x * 256)).alias("v")), F.col("id") % 50 == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
