"""A pipeline over `documents`: what is toxic, repeated or a leak goes, the rest is mixed.

Every stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, line_dedup, mixing, near_copies, toxicity
from tidewatch.llm.common import attached, row_key, staged, table


def _private(docs: DataFrame) -> DataFrame:
    """docs as one struct and what the stages need beside it, so that no name of a column can clash."""
    return docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), row_key("doc_id", "text").alias("rk"))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the ids of a table (gone)."""
    gone = staged(ids.distinct(), "gone")
    return attached(_private(docs), gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti", 48).select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic, with all their columns.

    It learns from labels of `docs` only. Null or empty texts are scored as texts without
    words, null ids are scored and never learnt from, repeated rows stay or go together.
    No labels: all stay. No documents: no rows.
    """
    scored = toxicity.scored_documents(docs, table(spark, sf_dir, "labels"), toxicity.categories())
    return scored.filter(~F.col("toxic")).select("doc.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id has too; n_chars follows.

    A null text becomes the empty one. Rows that share an id are one document and lose
    nothing to each other; a null id comes after all others. No documents: no rows.
    """
    kept = line_dedup.line_dedup(docs)
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[values.get(c, F.col("others").getField(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of like five-word shingles (Jaccard 0.8), once.

    Documents without an id stay unless one with an id is like them. Null and empty texts
    are alike, as they have no words. Of rows that share an id the one of the least hash
    of id and text stays. No documents: no rows.
    """
    groups = staged(near_copies.near_copies(docs), "groups")
    kept = _without(docs, groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")))
    n, ids = groups.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if ids == n:
        return kept
    # Rows that share an id: the first of them by text.
    one = _private(kept).dropDuplicates(["id", "rk"])
    least = one.filter("id is not null").groupBy(F.col("id").alias("lid")).agg(F.min("rk").alias("lrk"))
    return one.join(least, F.col("id") == F.col("lid"), "left").filter("lid is null or rk = lrk").select("doc.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none. An id goes with all its rows once one of them holds
    an item, and so do all rows without an id. No benchmark: all stay. No documents: no rows.
    """
    found = decontamination.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc_id").alias("gone")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; its columns are those of op5.

    One row for each row of docs, repeated ones too; null and empty texts have no words
    and are never taken; a null source is a source of its own. The mix itself, word
    ranges of documents in the order of slots, is written as mix-pieces to the shared
    folder. No documents: no rows.
    """
    return mixing.mix(docs)[0]


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Fingerprints and classifiers are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
