"""Operator 13: a Merkle manifest of a dataset, built as a postorder append log.

The rows of a tree are ranked and cut into aligned blocks of 2**LEVELS leaves. A builder
takes one block and writes its nodes in the order in which they are completed: a leaf,
then every parent that it completes. Where a node lies in that log follows from the
sizes of the subtrees before it (`position`), so neither builder nor reader keeps
pointers: a proof reads its siblings at computed offsets. The tops of the blocks are
the leaves of the next tier, whose logs are built and read in the same way, and the
roots of all trees are the leaves of a last one.

A builder holds one block, whatever the size of a tree; ranks are offsets within
sorted ranges added to counts of the ranges before. Texts are hashed where they are
read and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import attached, crc32_sql, staged, table

#: A block has 2**LEVELS leaves at most; a digest is HEX bytes of text.
LEVELS, HEX = 10, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: bytes) -> bytes:
    return hashlib.sha256(b"".join(inputs)).hexdigest().encode()


def position(n: int, h: int, j: int) -> int:
    """Where node j of level h lies in the postorder log of a tree of n leaves.

    Before the parents that leaf i completes lie the 2i - popcount(i) nodes that the
    leaves before it have completed, and the leaf itself. A node that the last leaf
    leaves short of its children is written after all others, level by level.
    """
    if (j + 1) << h <= n:
        last = ((j + 1) << h) - 1
        return 2 * last - last.bit_count() + h
    even = (n & -n).bit_length() - 1  # levels whose nodes all have their children
    return 2 * n - n.bit_count() + h - even - 1


def height(leaves: int, tree: int, levels: int) -> int:
    """Levels over the leaves of a block: up to one node, or all of a block's in a tree of several blocks."""
    return levels if tree > 1 << levels else (leaves - 1).bit_length()


def built(leaves: list[bytes], top: int) -> bytes:
    """The log of a block: its nodes up to level `top` as they are completed."""
    log, n = bytearray(), len(leaves)
    at = lambda p: bytes(log[HEX * p : HEX * (p + 1)])
    for i, leaf in enumerate(leaves):
        log += leaf
        h = 0
        while i >> h & 1 and h < top:
            right = len(log) // HEX - 1
            log += digest(at(right - (2 << h) + 1), at(right))
            h += 1
    for h in range(top):
        if n & (2 << h) - 1:  # the last node of the next level lacks leaves
            j = n >> h + 1 << 1
            log += digest(*[at(position(n, h, c)) for c in (j, j + 1) if c << h < n])
    return bytes(log)


def siblings(log: bytes, n: int, i: int, top: int) -> list[str]:
    """The siblings of leaf i by level, each after the side it lies on: L, R, or nothing where there is none."""
    out = []
    for h in range(top):
        j = (i >> h) ^ 1
        p = HEX * position(n, h, j) if j << h < n else -1
        out.append("" if p < 0 else ("R" if j & 1 else "L") + log[p : p + HEX].decode())
    return out


def folded(leaf: bytes, path: list[str]) -> bytes:
    """The root that a leaf and its siblings give."""
    for s in path:
        other = s[1:].encode()
        leaf = digest(other, leaf) if s[:1] == "L" else digest(leaf, other)
    return leaf


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with idx, the rank of a row (from 0) in its tree k by `order`, and n, the rows of the tree.

    Rows are sorted within ranges of (k, *order); equal rows may lie in several. A row's rank
    is its place in its range, taken from the first of its tree there, and the rows of the
    tree in the ranges before.
    """
    ranged = df.withColumn("__salt", F.rand(13)).repartitionByRange("k", *order, "__salt").sortWithinPartitions("k", *order, "__salt").drop("__salt")
    ranged = staged(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "merkle-ranges")
    counts = ranged.groupBy("k", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    tree = Window.partitionBy("k")
    before = F.coalesce(F.sum("__rows").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("k").alias("__k"), F.col("__part").alias("__p"), (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(tree).alias("n"))
    joined = attached(ranged, staged(counts, "merkle-counts"), (F.col("k") == F.col("__k")) & (F.col("__part") == F.col("__p")), "inner", 1 << 10)
    return joined.withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__k", "__p", "__shift")


def _builder(levels: int, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """A function of the rows (k, block, n, idx, id, leaf, claimed) of one block that gives its segment of the log."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        leaves = [x.encode() for x in rows["leaf"].to_pylist()]
        log = built(leaves, height(len(leaves), rows["n"][0].as_py(), levels))
        claimed = "".join(rows["claimed"].to_pylist())
        own = {"k": rows["k"][0].as_py(), "block": rows["block"][0].as_py(), "n": rows["n"][0].as_py(), "ids": rows["id"].to_pylist(), "log": log, "claimed": claimed.encode(), "top": log[-HEX:].decode()}
        return pa.Table.from_pylist([own], schema=schema)

    return build


def segments(rows: DataFrame, levels: int) -> DataFrame:
    """The log of each tree of rows (k, n, idx, id, leaf, claimed), one segment for each block."""
    kind = rows.schema["id"].dataType.simpleString()
    out = StructType.fromDDL(f"k string, block long, n long, ids array<{kind}>, log binary, claimed binary, top string")
    blocks = rows.withColumn("block", F.shiftright("idx", levels))
    return staged(blocks.groupBy("k", "block").applyInArrow(_builder(levels, to_arrow_schema(out)), out), "merkle-log")


def _paths(levels: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (tree, child, rest, root): for each leaf of a segment its siblings up to the root."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                s = {c: b.column(c)[r].as_py() for c in b.schema.names}
                n = len(s["ids"])
                top = height(n, s["n"], levels)
                rest = [siblings(s["log"], n, i, top) + s["path"] for i in range(n)]
                columns = ([s["k"]] * n, s["ids"], rest, [s["root"]] * n)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def paths(log: DataFrame, levels: int) -> DataFrame:
    """Rows (tree, child, rest, root) of the leaves of rooted segments, whose ids are the children."""
    kind = log.schema["ids"].dataType.elementType.simpleString()
    out = StructType.fromDDL(f"tree string, child {kind}, rest array<string>, root string")
    return staged(log.select("k", "n", "ids", "log", "path", "root").mapInArrow(_paths(levels, to_arrow_schema(out)), out), "merkle-paths")


def rooted(log: DataFrame, levels: int) -> DataFrame:
    """Segments with root, the root of their tree, and path, the siblings from their top to it."""
    alone = log.filter(F.col("n") <= 1 << levels).withColumn("path", F.array().cast("array<string>")).withColumn("root", F.col("top"))
    many = log.filter(F.col("n") > 1 << levels)
    if many.isEmpty():
        return alone
    blocks = F.shiftright(F.col("n") - 1, levels) + 1
    tops = many.select("k", blocks.alias("n"), F.col("block").alias("idx"), F.col("block").alias("id"), F.col("top").alias("leaf"), F.lit("").alias("claimed"))
    above = paths(rooted(segments(tops, levels), levels), levels).withColumnRenamed("rest", "path")
    return alone.unionByName(many.join(above, (F.col("k") == F.col("tree")) & (F.col("block") == F.col("child"))).drop("tree", "child"))


def _proofs(levels: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each leaf of a segment: its proof, and the root that the claimed leaf folds to."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                s = {c: b.column(c)[r].as_py() for c in b.schema.names}
                n, log = len(s["ids"]), s["log"]
                top, out = height(n, s["n"], levels), []
                for i in range(n):
                    leaf = log[HEX * (p := position(n, 0, i)) : HEX * (p + 1)]
                    path = siblings(log, n, i, top) + s["path"]
                    got = folded(s["claimed"][HEX * i : HEX * (i + 1)], path).decode()
                    out.append((s["ids"][i], leaf.decode(), s["subroot"], s["root"], path, got, got == s["root"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def leaf_of(values: list[Column]) -> Column:
    """sha256 over the values, each as its length in UTF-8 bytes, a colon and itself; a null as -."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS, claims: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Rows (id_col, leaf, subroot, root, proof, folded_root, verified), one for each row of docs.

    A row is a leaf, the digest of its `fields`. Each value of tree_col has a tree over its
    leaves by id, and the roots of these trees, by that value (null first, by bytes), have one
    over them. `proof` lists a leaf's siblings from its tree's lowest level to the last root,
    each after L or R, the side that it lies on, and an empty text for a node that stands
    alone. `claims` gives columns other values: what they make of a leaf is folded with the
    proof, and verified tells whether it gives the root. The logs are written as `merkle-log-*`
    to the shared folder.

    Nulls: a null field is hashed as -, a null id comes first, a null in tree_col has a tree of
    its own. Empty texts are values of no bytes, texts may be of any length. Repeated rows are
    leaves each; ties of an id are in the order of their digests. Other columns are ignored,
    whatever their names. No rows: no rows.
    """
    own = {c: docs[c] for c in fields}
    tree = docs[tree_col].cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), tree), F.lit("")).alias("k"),
        docs[id_col].alias("id"),
        leaf_of(list(own.values())).alias("leaf"),
        (leaf_of(list({**own, **claims}.values())) if claims else F.lit(None).cast("string")).alias("claimed"),
    ).withColumn("claimed", F.coalesce("claimed", "leaf"))
    log = rooted(segments(numbered(leaves, ["id", "leaf"]), levels), levels).withColumnRenamed("root", "subroot")
    log = staged(log, "merkle-trees")
    roots = log.filter("block = 0").select(F.lit("").alias("k"), F.col("k").alias("id"), F.col("subroot").alias("leaf"), F.lit("").alias("claimed"))
    ends = paths(rooted(segments(numbered(roots, ["id"]), levels), levels), levels).drop("tree")
    log = attached(log, ends, F.col("k") == F.col("child"), "inner", 1 << 12).withColumn("path", F.concat("path", "rest"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = StructType.fromDDL(f"id {kind}, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean")
    proofs = log.select("n", "ids", "log", "claimed", "path", "subroot", "root").mapInArrow(_proofs(levels, to_arrow_schema(out)), out)
    return proofs.withColumnRenamed("id", id_col)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    rows = manifest(docs, claims={"n_chars": F.when(tampered, docs["n_chars"] + 1).otherwise(docs["n_chars"])})
    hashed = F.sha2(F.array_join(F.transform("proof", lambda s: F.substring(s, 2, HEX)), "").cast("binary"), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", hashed.alias("proof_sha256"), "folded_root", "verified")


_ENCODED = "coalesce(strlen(({0})::VARCHAR)::VARCHAR || ':' || ({0})::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_ENCODED.format(c) for c in FIELDS) + ")"
_SIDES = "coalesce(list(CASE WHEN s.idx IS NULL THEN '' WHEN s.idx % 2 = 0 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY l.lv) FILTER (WHERE l.lv IS NOT NULL), [])"
_STEP = "CASE WHEN s[1] = 'L' THEN sha256(s[2:] || a) WHEN s[1] = 'R' THEN sha256(a || s[2:]) ELSE sha256(a) END"
OP13_SQL = f"""
WITH RECURSIVE damaged AS (SELECT *, {crc32_sql("doc_id::VARCHAR")} % 7 = 0 AS hit FROM documents),
leaves AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, {_LEAF.replace("(n_chars)", "(n_chars + CASE WHEN hit THEN 1 ELSE 0 END)")} AS claimed FROM damaged
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
nodes(lang, lv, idx, h) AS (
  SELECT lang, 0, idx, leaf FROM placed
  UNION ALL
  SELECT lang, lv + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM nodes) WHERE c > 1 GROUP BY lang, lv + 1, idx // 2
),
subroots AS (SELECT lang, arg_max(h, lv) AS subroot, max(lv) AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM nodes GROUP BY lang),
uppers(lv, idx, h) AS (
  SELECT 0, idx, subroot FROM subroots
  UNION ALL
  SELECT lv + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS c FROM uppers) WHERE c > 1 GROUP BY lv + 1, idx // 2
),
ends AS (SELECT arg_max(h, lv) AS root, max(lv) AS top FROM uppers),
low AS (
  SELECT p.lang, p.idx, {_SIDES} AS path
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang LEFT JOIN range(64) l(lv) ON l.lv < r.top
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lv = l.lv AND s.idx = xor(p.idx >> l.lv, 1) GROUP BY ALL
),
high AS (
  SELECT r.lang, r.subroot, e.root, {_SIDES} AS path
  FROM subroots r CROSS JOIN ends e LEFT JOIN range(64) l(lv) ON l.lv < e.top
  LEFT JOIN uppers s ON s.lv = l.lv AND s.idx = xor(r.idx >> l.lv, 1) GROUP BY ALL
),
proofs AS (
  SELECT doc_id, leaf, claimed, subroot, root, list_concat(low.path, high.path) AS path FROM placed p
  JOIN low ON p.lang IS NOT DISTINCT FROM low.lang AND p.idx = low.idx JOIN high ON p.lang IS NOT DISTINCT FROM high.lang
),
folds AS (SELECT *, list_reduce(list_prepend(claimed, path), lambda a, s: {_STEP}) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(list_prepend('', path), lambda s: s[2:]), 'string_agg', '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM folds
"""
