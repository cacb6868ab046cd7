"""Operator 4: drop lines that several documents share, all but in their first document.

Lines are exploded and normalised, their keys hashed, the distinct documents of each
hash counted, and every document is reassembled from its other lines by position.
Only DataFrame functions are used.

The text of a document crosses the network once, beside the positions that it loses;
what is shuffled for each line is a hash, an id and a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, ascii_lower, row_key, staged, table


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Rows (id_col, n_lines, n_dropped, kept_text, others), one for each row of docs, with its
    other columns in the struct others.

    A line's key is the line stripped at both ends and with A-Z in lower case. A key
    of at least `min_chars` code points that at least `min_docs` documents hold loses
    all its lines except those in the smallest id that holds it.

    Null or empty text: one empty line, which stays. A null id is a document of its
    own that comes after all others. Repeated rows: equal rows get equal results, and
    rows with one id but several texts count as one document. Ties don't arise: a line
    stays wherever the smallest id holds it, repeats included. Other columns are
    carried, whatever their names. No rows: no rows.
    """
    others = F.struct(F.lit(0).alias("__none"), *[docs[c] for c in docs.columns if c not in (id_col, text_col)])
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), others.alias("others")).withColumn("rk", row_key("id", "text"))
    keyed = (
        base.select("id", "rk", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("id", "rk", "pos", ascii_lower(F.btrim("line", F.lit(WS))).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "rk", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"))
    )
    if min_docs == 2:
        # Two documents hold a key if its least and greatest ids differ: no list of ids is needed.
        shared = F.col("first").isNotNull() & ((F.col("first") < F.col("last")) | F.col("nameless"))
        held = keyed.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.bool_or(F.col("id").isNull()).alias("nameless"))
    else:
        shared = F.col("n") >= min_docs
        held = keyed.select("h", "id").distinct().groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Written first: with shuffles of its own on both sides, the join of a key of very many
    # lines can be split by adaptive execution.
    shared_keys = staged(held.filter(shared).select("h", "first"), "shared-lines")
    lost = keyed.join(shared_keys, "h").filter((F.col("id") > F.col("first")) | F.col("id").isNull() & F.col("first").isNotNull())
    lost = lost.groupBy(F.col("id").alias("lid"), F.col("rk").alias("lrk")).agg(F.collect_set("pos").alias("gone"))
    both = base.join(lost, F.col("id").eqNullSafe(F.col("lid")) & (F.col("rk") == F.col("lrk")), "left")
    both = both.select("id", "text", "others", "gone", _lines(F.col("text")).alias("lines")).withColumn("n_lines", F.size("lines").cast("long"))
    kept_at = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept_at, lambda i: F.get(F.col("lines"), i)), "\n"))
    return both.select(F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"), "others")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, l AS line, translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
shared AS (SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT doc_id, pos, line, coalesce(doc_id > first, FALSE) AS gone FROM lines LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
