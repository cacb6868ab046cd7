"""Operator 6: token counts of whole texts, huge ones by overlapping chunks.

A huge text is cut into chunks that overlap, which are encoded in different tasks. Two
neighbours are spliced at a boundary between pre-tokens that both have in their overlap.
Such a boundary is proven to be one of the whole text's:

* The left neighbour's boundaries are the whole text's (by induction from the start of
  the text), save near its end, where it can't see what follows; the last MARGIN
  characters are left out, which is more than any special string and any look-ahead
  of the pattern.
* From a boundary on, the pattern looks only ahead, so what the right neighbour has from
  there on is what the whole text has, whatever it had before.

Token boundaries within a pre-token prove nothing and are not used. If an overlap holds
no common boundary (say, within one huge word), the text is done again with four times
the overlap; in the end the overlap spans the text, which is then one chunk.

Texts are counted by stretches: white space and the characters up to the next white
space. Byte-level BPE never joins characters across such a cut, in whatever text it
stands, so a stretch has the same tokens everywhere and each task encodes it once.
Offsets are taken only of the stretches in the overlaps.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key, staged, table

CHUNK_CHARS, OVERLAP, MARGIN = 16_384, 512, 64
BATCH_TEXTS = 64
#: Counts that a task keeps, of stretches of so many characters at most.
KEPT_COUNTS, KEPT_CHARS = 1 << 18, 48
#: White space by any definition but these four; a stretch goes on beyond it.
OTHER_SPACES = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
OTHER_SPACE = re.compile(f"[{OTHER_SPACES}]")
STRETCH = re.compile("[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
LONG_STRETCH = re.compile(f"[ \n\r\t]*(?:[^ \n\r\t{OTHER_SPACES}]+|[{OTHER_SPACES}][ \n\r\t]*)+|[ \n\r\t]+")


def stretches(text: str) -> list[str]:
    """The text in parts, cut where a white space follows something that is none."""
    return (LONG_STRETCH if OTHER_SPACE.search(text) else STRETCH).findall(text)


def separable(vocabulary: str) -> bool:
    """Whether a tokenizer's file says that it counts stretches by themselves: byte-level
    BPE with the usual pattern, as the text stands, and no white space in special strings."""
    own = json.loads(vocabulary)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    added = own.get("added_tokens") or []
    return (
        own.get("normalizer") is None
        and own.get("post_processor") is None
        and {k: (own.get("pre_tokenizer") or {}).get(k) for k in plain} == plain
        and own["model"].get("type") == "BPE"
        and not own["model"].get("dropout")
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) or OTHER_SPACE.search(x["content"]) for x in added)
    )


class Counter:
    """Token counts by one tokenizer file, with the counts of short stretches kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps the cores busy
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        with open(path, encoding="utf-8") as f:
            self.separable = separable(f.read())
        self.kept: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for at in range(0, len(texts), 1024) for e in self.encoder.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False)]

    def of_parts(self, parts: list[list[str]]) -> list[list[int]]:
        """The tokens of each of lists of stretches."""
        if len(self.kept) > KEPT_COUNTS:
            self.kept = {}
        new = [x for x in set().union(*parts) if x not in self.kept]
        found = dict(zip(new, self.encoded(new)))
        short = {x: n for x, n in found.items() if len(x) <= KEPT_CHARS}
        self.kept.update(short)
        count = self.kept.__getitem__ if len(short) == len(found) else lambda x: found[x] if x in found else self.kept[x]
        return [[*map(count, x)] for x in parts]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.separable:
            return self.encoded(texts)
        return [*map(sum, self.of_parts([stretches(x) for x in texts]))]

    def bounds(self, text: str) -> list[tuple[int, int]]:
        """(offset, tokens before it) of the boundaries between pre-tokens of a text, by the encoder."""
        e = self.encoder.encode(text, add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        return [(offsets[j][0], j) for j in range(len(words)) if not j or words[j] != words[j - 1]]

    def chunk(self, text: str, overlap: int, step: int) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
        """(tokens, boundaries before `overlap`, boundaries from `step` on) of a chunk."""
        if not self.separable:
            e = self.encoder.encode(text, add_special_tokens=False)
            found = self.bounds(text)
            return len(e), [x for x in found if x[0] < overlap], [x for x in found if x[0] >= step]
        parts = stretches(text)
        ends = [0, *accumulate(map(len, parts))]
        before = [0, *accumulate(self.of_parts([parts])[0])]
        # Both overlaps, each widened to whole stretches.
        last = bisect_right(ends, overlap - 1)
        head = self.bounds(text[: ends[min(last, len(parts))]])
        first = max(0, bisect_right(ends, step) - 1)
        tail = [(ends[first] + p, before[first] + j) for p, j in self.bounds(text[ends[first] :])]
        return before[-1], [x for x in head if x[0] < overlap], [x for x in tail if x[0] >= step]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _batches(rows: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    for at in range(0, rows.num_rows, BATCH_TEXTS):
        yield at, rows.column(column).slice(at, BATCH_TEXTS).to_pylist()


def _whole(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _counter(path)
        for rows in it:
            counts = [n for _, texts in _batches(rows, "text") for n in t.counts(texts)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def _cut(step: int, overlap: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            for i in range(rows.num_rows):
                text = rows.column("text")[i].as_py()
                n = max(1, -(-(len(text) - overlap) // step))
                for k in range(n):
                    piece = text[k * step : (k + 1) * step + overlap] if k < n - 1 else text[k * step :]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("id").slice(i, 1), rows.column("rk").slice(i, 1), pa.array([k], pa.int64()), pa.array([k == n - 1]), pa.array([piece], pa.large_string() if rows.schema.field("text").type == pa.large_string() else pa.string())],
                        ["id", "rk", "no", "last", "text"],
                    )

    return run


def _chunks(path: str, step: int, overlap: int):
    """For each chunk: its tokens, and in both overlaps the boundaries (as offsets in the
    overlap) and the chunk's tokens before each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _counter(path)
        for rows in it:
            n, head, head_n, tail, tail_n = [], [], [], [], []
            for text, last in zip(rows.column("text"), rows.column("last").to_pylist()):
                text = text.as_py()
                # The next chunk starts `step` characters after this one.
                tokens, first, final = t.chunk(text, overlap, step)
                final = [] if last else [(p - step, j) for p, j in final if p < len(text) - MARGIN]
                n.append(tokens)
                head.append([p for p, _ in first])
                head_n.append([j for _, j in first])
                tail.append([p for p, _ in final])
                tail_n.append([j for _, j in final])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (head, head_n, tail, tail_n)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "rk", "no", "last")), pa.array(n, pa.int64()), *lists], ["id", "rk", "no", "last", "n", "head", "head_n", "tail", "tail_n"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens), one for each row of docs.

    `vocabulary` is a tokenizer file that all executors can open; it is used without
    begin, end or padding tokens, and special strings inside texts count as the library
    counts them by default. It must split texts by a pattern that looks only ahead, as
    byte-level BPE does. Null or empty text: no tokens. Null ids are kept. Repeated rows
    are each returned. Texts of any length are read whole; one over chunk_chars + overlap
    characters is spread over tasks. Other columns are ignored. No rows: no rows.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    limit = chunk_chars + overlap
    whole = base.filter(F.length("text") <= limit).mapInArrow(_whole(vocabulary), f"id {id_type}, n_bytes long, n_tokens long")
    huge = base.filter(F.length("text") > limit).withColumn("rk", row_key("id", "text"))
    # Equal rows are done once.
    huge = staged(huge.groupBy("id", "rk", "n_bytes").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "tokens-huge")
    done, todo, step = [], huge, chunk_chars
    while True:
        cut = todo.select("id", "rk", "text").mapInArrow(_cut(step, overlap), f"id {id_type}, rk long, no long, last boolean, text string").repartition(F.col("rk"), F.col("no"))
        encoded = cut.mapInArrow(_chunks(vocabulary, step, overlap), f"id {id_type}, rk long, no long, last boolean, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")
        w = Window.partitionBy("id", "rk").orderBy("no")
        both = encoded.withColumn("next", F.lead(F.struct("head", "head_n")).over(w))
        both = both.withColumn("at", F.get(F.array_intersect("tail", F.col("next.head")), F.lit(0)))
        pick = lambda pos, val: F.get(val, F.array_position(pos, F.col("at")).cast("int") - 1)
        # Up to the splice the left neighbour's tokens count; of the right one's, those before it don't.
        tokens = F.when(F.col("last"), F.col("n")).otherwise(pick(F.col("tail"), F.col("tail_n")) - pick(F.col("next.head"), F.col("next.head_n")))
        spliced = staged(both.groupBy("id", "rk").agg(F.sum(tokens).alias("n_tokens"), F.bool_and(F.col("last") | F.col("at").isNotNull()).alias("whole")), "tokens-spliced")
        done.append(spliced.filter("whole"))
        if spliced.filter("not whole").isEmpty():
            break
        overlap *= 4
        step = max(step, 4 * overlap)
        same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["rk"] == b["rk"])
        again = spliced.filter("not whole").select("id", "rk")
        todo = staged(huge.join(again, same(huge, again), "left_semi"), "tokens-again")
    counts = done[0]
    for x in done[1:]:
        counts = counts.unionByName(x)
    counts = counts.select(F.col("id").alias("cid"), F.col("rk").alias("crk"), "n_tokens")
    pieced = huge.drop("text").join(counts, F.col("id").eqNullSafe(F.col("cid")) & (F.col("rk") == F.col("crk")))
    pieced = pieced.select("id", "n_bytes", "n_tokens", F.explode(F.expr("sequence(1L, copies)")))
    return whole.unionByName(pieced.drop("col")).withColumnRenamed("id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
