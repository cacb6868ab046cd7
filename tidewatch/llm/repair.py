"""Operator 12: repair the structure of conversations by generalised LR parsing.

A conversation is read against the grammar of roles

    C -> (nothing) | B        B -> H user assistant | B user assistant        H -> (nothing) | system

Each row may be kept, given another role or deleted, and a row may be inserted anywhere,
at a weight for each. All ways that are still open are held in one graph-structured
stack: a node is a stack top over the node below, ways that meet in an equal top over
the same node become one, the cheaper, or at one cost the one whose edits come first in
ASCII order. Because prefixes of equal cost and rows can't be prefixes of each other,
the order of two prefixes is that of all their continuations, and merging loses nothing.

A task reads the rows of a conversation in order and holds the open ways and the rows
whose edit isn't settled yet: those after the last edit on which all open ways agree.
A way that costs SPREAD more than another, the most that it takes to get from one stack
to any other, is closed.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import attached, crc32_sql, staged, table

#: What edits cost, and what a row that breaks off costs unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Two inserted rows lead from any stack to any other.
SPREAD = 2 * INSERT
ROLES = {"u": "user", "a": "assistant"}
#: Rows between two looks at what is settled.
SETTLE = 64

# The LR automaton. Stacks are pairs (state, stack below); a reduction follows at once where a state allows nothing else.
SHIFT = {("0", "s"): "s", ("0", "u"): None, ("H", "u"): "Hu", ("Hu", "a"): "Hua", ("B", "u"): "Bu", ("Bu", "a"): "Bua"}
REDUCE = {"s": ("H", 1), "Hua": ("B", 3), "Bua": ("B", 3)}
BOTTOM = ("0", None)
ACCEPTED = ("0", "B")


@functools.cache
def shifted(stack: tuple, symbol: str) -> tuple | None:
    """The stack after a symbol and the reductions that follow, or None if the grammar has no such continuation."""
    if (stack[0], symbol) not in SHIFT:
        return None
    if stack == BOTTOM and symbol == "u":
        stack = ("H", stack)  # H -> (nothing), as a user comes
    stack = (SHIFT[stack[0], symbol], stack)
    while stack[0] in REDUCE:
        left, length = REDUCE[stack[0]]
        for _ in range(length):
            stack = stack[1]
        stack = (left, stack)
    return stack


class Ways:
    """The open ways to read a conversation's rows so far: for each stack the least (cost, audit)."""

    def __init__(self) -> None:
        self.open: dict[tuple, tuple[int, str]] = {BOTTOM: (0, "")}
        self._insert()

    def _insert(self) -> None:
        """Adds what inserted rows reach, until nothing gets cheaper."""
        todo = list(self.open)
        while todo:
            stack = todo.pop()
            cost, audit = self.open[stack]
            for symbol in ROLES:
                if (nxt := shifted(stack, symbol)) and (way := (cost + INSERT, audit + "I")) < self.open.get(nxt, (1 << 62, "")):
                    self.open[nxt] = way
                    todo.append(nxt)

    def read(self, initial: str, fault: str | None) -> None:
        """Goes on over a row: deleted always, kept or given another role unless it is blank or repeated."""
        after: dict[tuple, tuple[int, str]] = {}

        def offer(stack, cost, audit):
            if stack and (cost, audit) < after.get(stack, (1 << 62, "")):
                after[stack] = (cost, audit)

        for stack, (cost, audit) in self.open.items():
            offer(stack, cost + DELETE, audit + "D")
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                offer(shifted(stack, initial), cost + more, audit + "K")
                for symbol in ROLES:
                    offer(shifted(stack, symbol), cost + REROLE + more, audit + "R")
        least = min(cost for cost, _ in after.values())
        self.open = {stack: way for stack, way in after.items() if way[0] <= least + SPREAD}
        self._insert()

    def settled(self) -> str:
        """Takes off the edits on which all open ways agree."""
        same = os.path.commonprefix([audit for _, audit in self.open.values()])
        self.open = {stack: (cost, audit[len(same) :]) for stack, (cost, audit) in self.open.items()}
        return same

    def best(self) -> tuple[int, str]:
        return min(way for stack, way in self.open.items() if stack[0] in ACCEPTED)


EDITS = "place long, edit string, role string, text string, turn long, initial string, fault string, cost long"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Rows, and characters of text, in a batch that a task hands on.
BATCH_ROWS, BATCH_CHARS = 2048, 8 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda r: 0) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += size(row)
        if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _repaired(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (conv_id, turn, role, text, fault, later), sorted by conversation and in its order, to rows of EDITS."""

    def edits(conv, rows):
        ways, waiting, stack, place, last = Ways(), [], BOTTOM, 0, None

        def apply(audit):
            nonlocal stack, place, waiting
            used = 0
            for edit in audit:
                cost = 0
                if edit == "I":
                    symbol = next(x for x in ROLES if shifted(stack, x))
                    stack, row = shifted(stack, symbol), (ROLES[symbol], "", None, None, None)
                    cost = INSERT
                else:
                    role, text, turn, initial, fault = waiting[used]
                    used += 1
                    if edit == "D":
                        cost = DELETE
                    else:
                        symbol = initial if edit == "K" else next(x for x in ROLES if shifted(stack, x))
                        role = role if edit == "K" else ROLES[symbol]
                        stack, cost = shifted(stack, symbol), (edit == "R") * REROLE + (fault == "truncated") * TRUNCATED
                    row = (role, text, turn, initial, fault)
                yield (conv, place, edit, *row, cost)
                place += 1
            waiting = waiting[used:]

        for n, (_, turn, role, text, fault, later) in enumerate(rows, 1):
            this = (turn, role, text)
            if fault != "blank" and (later or this == last):
                fault = "duplicate"
            last = this
            ways.read(role[:1], fault)
            waiting.append((role, text, turn, role[:1], fault))
            if n % SETTLE == 0:
                yield from apply(ways.settled())
        yield from apply(ways.best()[1])

    def run(batches):
        every = (row for conv, rows in groupby(_rows(batches), key=lambda r: r[0]) for row in edits(conv, rows))
        yield from _batches(every, schema, lambda row: len(row[4]))

    return run


INK = r"[^\x20\x09-\x0D]"


def repair(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, place, edit, role, text, turn, initial, fault, cost): the edits that repair each conversation.

    edit is K (kept), R (given another role), D (deleted) or I (inserted); the repaired conversation
    is the rows that aren't D, by place. role and text are those after the edit, turn, initial and
    fault (blank, duplicate, truncated or null) those of the row before it. The rows of a conversation
    lie in one partition, in order; a later step that needs this must not deal them anew.

    Rows are in the order of turn (nulls first), role, text. A null conversation is one of its own;
    null roles and texts are one space. Repeated rows are duplicates, all but the first. Texts may be
    of any length. Other columns are ignored, whatever their names. No rows: no rows.
    """
    spaced = lambda c: F.coalesce(convs[c].cast("string"), F.lit(" "))
    rows = convs.select(convs[conv_col].alias("conv"), convs[turn_col].cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))
    said = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.withColumn("h", said)
    ink = F.col("text").rlike(INK)
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~ink, "blank").when(~ends, "truncated")
    # Only what is said more than once in a conversation is joined: few rows.
    firsts = rows.filter(ink).groupBy(F.col("conv").alias("c"), F.col("h").alias("hc")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("turn").isNull()).alias("unplaced"), F.min("turn").alias("first"))
    firsts = staged(firsts.filter("n > 1").drop("n"), "repeated-turns")
    joined = attached(rows, firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("hc")), "left", 64)
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("first"))), F.lit(False))
    joined = joined.select("conv", "turn", "role", "text", fault.alias("fault"), later.alias("later"))
    dealt = joined.repartition(F.col("conv")).sortWithinPartitions("conv", "turn", "role", "text")
    out = StructType.fromDDL(f"conv_id {convs.schema[conv_col].dataType.simpleString()}, {EDITS}")
    return dealt.mapInArrow(_repaired(to_arrow_schema(out)), out)


PAIRS = ("su", "ua", "au")


def _reported(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edits, clustered by conversation and in order, to one row for each conversation."""

    def report(conv, rows):
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        sha, lines, audit, cost, illegal, before = hashlib.sha256(), 0, bytearray(), 0, 0, None
        least = most = None
        turns = 0
        for _, _, edit, role, text, turn, initial, fault, spent in rows:
            audit += edit.encode()
            cost += spent
            if fault:
                counts[fault] += 1
            if edit != "I":
                illegal += before is not None and before + initial not in PAIRS
                before = initial
                if turn is not None and turn != most:
                    least, most, turns = turn if least is None else least, turn, turns + 1
            if edit != "D":
                sha.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
                lines += 1
        gaps = most - least + 1 - turns if turns else 0
        return (conv, gaps, *counts.values(), illegal, cost, audit.decode(), sha.hexdigest())

    def run(batches):
        yield from _batches((report(conv, rows) for conv, rows in groupby(_rows(batches), key=lambda r: r[0])), schema)

    return run


def reported(edits: DataFrame) -> DataFrame:
    """One row for each conversation of what `repair` returned, as it returned it."""
    out = StructType.fromDDL(f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, {REPORT}")
    return edits.mapInArrow(_reported(to_arrow_schema(out)), out)


def damaged(convs: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with a known share of faults, by the crc32 of conv_id:turn."""
    spaced = lambda c: F.coalesce(convs[c].cast("string"), F.lit(" "))
    what = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), what.alias("what")).filter("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times: Column = F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    every = convs.select(F.col("conv_id").alias("c")).distinct()
    found = every.join(reported(repair(damaged(convs))), F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("c").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


_BLANK = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
_CUT = r"NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z')"
OP12_SQL = f"""
WITH RECURSIVE spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS what FROM conversations
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
  FROM spaced WHERE what <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (
  SELECT *, {_BLANK} AS blank, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, NOT blank AND NOT duplicate AND {_CUT} AS truncated,
         left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed
),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
),
moves(st, edit, ini, nxt, price, role) AS (VALUES
  ('0', 'D', NULL, '0', {DELETE}, NULL), ('H', 'D', NULL, 'H', {DELETE}, NULL), ('U', 'D', NULL, 'U', {DELETE}, NULL), ('B', 'D', NULL, 'B', {DELETE}, NULL),
  ('0', 'K', 's', 'H', 0, NULL), ('0', 'K', 'u', 'U', 0, NULL), ('H', 'K', 'u', 'U', 0, NULL), ('B', 'K', 'u', 'U', 0, NULL), ('U', 'K', 'a', 'B', 0, NULL),
  ('0', 'R', NULL, 'U', {REROLE}, 'user'), ('H', 'R', NULL, 'U', {REROLE}, 'user'), ('B', 'R', NULL, 'U', {REROLE}, 'user'), ('U', 'R', NULL, 'B', {REROLE}, 'assistant')
),
inserts(st, nxt, price, edits, lines) AS (
  SELECT * FROM (VALUES ('0', '0', 0, '', []::VARCHAR[]), ('H', 'H', 0, '', []::VARCHAR[]), ('U', 'U', 0, '', []::VARCHAR[]), ('B', 'B', 0, '', []::VARCHAR[]),
  ('0', 'U', {INSERT}, 'I', ['user:']), ('H', 'U', {INSERT}, 'I', ['user:']), ('B', 'U', {INSERT}, 'I', ['user:']), ('U', 'B', {INSERT}, 'I', ['assistant:']),
  ('0', 'B', {2 * INSERT}, 'II', ['user:', 'assistant:']), ('H', 'B', {2 * INSERT}, 'II', ['user:', 'assistant:']))
),
ways(conv_id, i, st, cost, audit, lines) AS (
  SELECT c.conv_id, 0, s.nxt, s.price, s.edits, s.lines FROM counts c CROSS JOIN inserts s WHERE s.st = '0'
  UNION ALL
  SELECT conv_id, i, nxt, cost, audit, lines FROM (
    SELECT w.conv_id, w.i + 1 AS i, s.nxt, w.cost + m.price + s.price + CASE WHEN m.edit <> 'D' AND j.truncated THEN {TRUNCATED} ELSE 0 END AS cost, w.audit || m.edit || s.edits AS audit,
           list_concat(list_concat(w.lines, CASE WHEN m.edit = 'D' THEN []::VARCHAR[] ELSE [coalesce(m.role, j.role) || ':' || j.text] END), s.lines) AS lines
    FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
    JOIN moves m ON m.st = w.st AND (m.ini IS NULL OR m.ini = j.ini) AND (m.edit = 'D' OR NOT (j.blank OR j.duplicate)) JOIN inserts s ON s.st = m.nxt
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, nxt ORDER BY cost, audit) = 1
),
best AS (
  SELECT w.conv_id, min(w.cost) AS cost, arg_min(w.audit, (w.cost, w.audit)) AS audit, arg_min(w.lines, (w.cost, w.audit)) AS lines
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i WHERE st IN ('0', 'B') GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
