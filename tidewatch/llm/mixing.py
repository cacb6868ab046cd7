"""Operator 5: mix sources to target weights by a low-discrepancy schedule.

The documents of a source, shuffled by a hash of their ids, form one line of words,
which is cut into blocks of equal length, at least LEAST_BLOCKS unless it has fewer words.
A source's quota is the words of its target; it has as many slots as blocks hold these
words, and the last of them takes only the words that are left. Slot i of the schedule is
the golden-ratio point i * phi mod 1; the cumulative quotas of the sources say whose slot
it is; the slots of a source are ranked, and rank r takes its block r mod (number of
blocks), so that a source is repeated only after it was used up. Slots that the points
leave a source short of, one of a few quotas mostly, come after the points, in the order
of points too. Every prefix of the schedule is therefore mixed to the target weights
within a few blocks, and the whole of it gives every source its target.

No source is ever gathered in one task: positions in a line and ranks of slots are
running sums, taken within buckets of a source and added to the sums of the buckets
before. Texts are read once, for their number of words, and never shuffled.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import ranges

from .common import WORD, attached, staged, table

#: The points in whole numbers below 2**62, each once before any twice: multiples of 2**62 over the golden ratio.
HALF = 31
TURN = 1 << 2 * HALF
STEP = (isqrt(5 << 4 * HALF) - TURN) // 2 | 1
#: Words in a block at most, blocks of a source at least; the documents of a source are dealt into 16 ** HEX_DIGITS buckets.
BLOCK_WORDS, LEAST_BLOCKS, HEX_DIGITS, SLOTS_IN_CHUNK = 128, 64, 3, 1 << 16
ROUNDS = 3


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over the rows of its group before it, in the order of (bucket, *order).

    The sums within buckets need the rows of one bucket together, and those of whole
    buckets one row for each.
    """
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    whole = whole.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    return df.withColumn("__in", F.sum(value).over(inner) - value).join(whole, [*group, bucket]).withColumn(name, F.col("__in") + F.col("__before")).drop("__in", "__before")


def block_of(word: Column) -> Column:
    """The block that holds a word of a source's line of l words in n blocks, the first l mod n of which have a word more."""
    more, short = F.expr("l % n"), F.expr("l div n")
    return F.when(word < more * (short + 1), F.floor(word / (short + 1))).otherwise(more + F.floor((word - more * (short + 1)) / F.greatest(short, F.lit(1))))


def block_start(block: Column) -> Column:
    return block * F.expr("l div n") + F.least(block, F.expr("l % n"))


def source_targets(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each source of (source, size): its number s by code point (null last),
    size l, target, blocks n, quota q of slots, of which lo to hi (exclusive) of all are its own, and
    rest, the words of its line that are taken once more than the line as a whole.

    Weights 1, 2, 3, repeating, share all words; a target stops at ROUNDS times the
    source's size. With the sources in order of the share at which they stop, the first
    k stop if, and only if, the rest still get a smaller share each than they can give;
    so the level is read off running sums. One row for each source is all that is sorted.
    """
    every = Window.partitionBy(F.lit(0))
    s = sizes.groupBy("source").agg(F.sum("size").alias("l"))
    s = s.withColumn("s", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", (F.col("s") - 1) % 3 + 1).withColumn("cap", F.col("l") * ROUNDS).withColumn("all", F.sum("l").over(every))
    by = every.orderBy(F.col("cap") / F.col("w"), "s")
    s = s.withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    fits = F.col("left") * F.col("w") <= F.col("cap") * F.col("open")
    s = s.withColumn("level", F.max(F.when(fits, F.col("left") / F.col("open"))).over(every))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("w")))
    s = s.withColumn("n", F.greatest(F.ceil(F.col("l") / block_words), F.least(F.col("l"), F.lit(LEAST_BLOCKS))).cast("long"))
    s = s.withColumn("words", F.floor(F.col("target") + 0.5)).withColumn("rest", F.when(F.col("l") > 0, F.expr("words % l")).otherwise(0))
    whole = F.when(F.col("l") > 0, F.expr("words div l") * F.col("n")).otherwise(0)
    s = s.withColumn("q", whole + F.when(F.col("rest") > 0, block_of(F.col("rest") - 1) + 1).otherwise(0))
    s = s.withColumn("hi", F.sum("q").over(every.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.select("source", "s", "l", "target", "n", "q", "rest", (F.col("hi") - F.col("q")).alias("lo"), "hi")


def point(slot: Column) -> Column:
    """slot * STEP mod TURN, for slots below TURN, by halves that no product overflows."""
    half = 1 << HALF
    hi, lo = F.shiftright(slot, HALF), slot.bitwiseAND(F.lit(half - 1))
    cross = (hi * (STEP % half) + lo * (STEP // half)) % half
    return (lo * (STEP % half) + cross * half) % TURN


def schedule(sources: DataFrame) -> DataFrame:
    """Rows (slot, s, block, upto) of the mix, from the staged table of source_targets. A slot takes its block up
    to word `upto` of the source's line, or all of it where that is null. Slots rise in the order of the mix."""
    spark = sources.sparkSession
    total = sources.agg(F.max("hi")).first()[0] or 0
    # Some slots more than quotas, as a source may come a few short; ranks beyond a quota go.
    slots = total + total // 50 + 64 if total else 0
    x = F.least(F.floor(point(F.col("id")).cast("double") * F.lit(total) / F.lit(float(TURN))), F.lit(total - 1))
    points = spark.range(slots).select(x.alias("at"), F.lit(1).alias("kind"), F.col("id").alias("slot"), F.lit(None).cast("int").alias("owner"))
    ends = sources.filter("q > 0").select(F.col("hi").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("slot"), F.col("s").cast("int").alias("owner"))
    # The owner of a point is the source whose quotas end next.
    lined = ranges.sorted_ranges(points.unionByName(ends), ["at", "kind", "slot"], "place", "mix-points")
    owned = ranges.following(lined, [], "place", F.col("owner"), "s").filter("kind = 1").select("slot", "s").withColumn("chunk", F.expr(f"slot div {SLOTS_IN_CHUNK}"))
    quotas = sources.filter("q > 0").select(F.col("s").cast("int").alias("s"), "l", "n", "q", "rest", "lo")
    own = quotas.select(F.col("s").alias("own"), "q")
    ranked = attached(running(owned, ["s"], "chunk", ["slot"], F.lit(1), "rank"), staged(own, "mix-quotas"), F.col("s") == F.col("own"), "inner", 16)
    ranked = staged(ranked.filter("rank < q").select("slot", "s", "rank"), "mix-ranks")
    had = ranked.groupBy("s").agg(F.count(F.lit(1)).alias("had"))
    short = quotas.join(had, "s", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < q")
    late = short.select("s", "lo", F.explode(F.sequence(F.col("had"), F.col("q") - 1)).alias("rank")).select((F.lit(slots) + point(F.col("lo") + F.col("rank"))).alias("slot"), "s", "rank")
    every = ranked.unionByName(late).withColumnRenamed("s", "of")
    placed = attached(every, staged(quotas.drop("lo"), "mix-blocks"), F.col("of") == F.col("s"), "inner", 48)
    upto = F.when((F.col("rank") == F.col("q") - 1) & (F.col("rest") > 0), F.col("rest"))
    return placed.select("slot", "s", (F.col("rank") % F.col("n")).alias("block"), upto.alias("upto"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): rows (id_col, size, source_size, target, taken), one for each
    row of docs, and the mix itself, rows (slot, id_col, first, last): words first to
    last (exclusive) of a document, in the order of slots.

    Null text: no words. Null source: the last source. Null ids are kept, and hashed as
    an empty string. Repeated rows stand in the line one after the other, each with its
    own share. Ties don't arise otherwise: a line is in the order of the md5 of the id,
    then the id, then the size. Documents without words are never taken. Other columns
    are ignored. No rows, or no words at all: targets and taken words are 0.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = staged(base, "mix-sizes")
    sources = staged(source_targets(base.select("source", "size"), block_words), "mix-sources")
    # Source names are taken to be at most a kilobyte on average.
    placed = attached(base, sources.select(F.col("source").alias("name"), "s", "l", "target", "n"), F.col("source").eqNullSafe(F.col("name")), "inner", 1 << 10)
    placed = placed.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.substring("h", 1, HEX_DIGITS))
    placed = staged(running(placed, ["s"], "bucket", ["h", "id", "size"], F.col("size"), "a").select("id", "size", "s", "l", "target", "n", "a"), "mix-placed")
    parts = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(block_of(F.col("a")), block_of(F.col("a") + F.col("size") - 1))))
    parts = parts.select("s", "id", "a", "block", (F.greatest("a", block_start(F.col("block"))) - F.col("a")).alias("first"), (F.least(F.col("a") + F.col("size"), block_start(F.col("block") + 1)) - F.col("a")).alias("last"))
    # The mix is written, as it is what a reader of it wants besides the counts.
    taken_to = F.least("last", F.coalesce(F.col("upto") - F.col("a"), F.col("last")))
    pieces = parts.join(schedule(sources), ["s", "block"]).select("slot", "s", "a", "id", "first", taken_to.alias("last"))
    pieces = staged(pieces.filter("last > first"), "mix-pieces")
    # (s, a) names a row that has words: no two of them start at the same word of a line.
    taken = pieces.groupBy("s", "a").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    worded = placed.filter("size > 0").join(taken, ["s", "a"], "left").select("id", "size", "l", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    wordless = placed.filter("size = 0").select("id", "size", "l", "target", F.lit(0).cast("long").alias("taken"))
    out = worded.unionByName(wordless).select(F.col("id").alias(id_col), "size", F.col("l").alias("source_size"), "target", "taken")
    return out, pieces.select("slot", F.col("id").alias(id_col), "first", "last")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0]


OP5_SQL = f"""
WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS l, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM base GROUP BY source),
s2 AS (SELECT *, (s - 1) % 3 + 1 AS w, l * {ROUNDS} AS cap, sum(l) OVER ()::BIGINT AS total FROM s1),
s3 AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open FROM s2),
s4 AS (SELECT *, least(cap::DOUBLE, coalesce(max(CASE WHEN rest * w <= cap * open THEN rest::DOUBLE / open::DOUBLE END) OVER (), 0.0::DOUBLE) * w) AS target FROM s3),
s5 AS (SELECT source, s, l, target, floor(target + 0.5)::BIGINT AS words FROM s4),
placed AS (SELECT b.doc_id, b.size, l, target, words, sum(size) OVER (PARTITION BY s ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size AS a FROM base b JOIN s5 ON b.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, l AS source_size, target, CASE WHEN l > 0 THEN words // l * size + greatest(0, least(size, words % l - a)) ELSE 0 END AS taken FROM placed
"""
