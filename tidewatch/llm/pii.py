"""Operator 7: personal data, found by regular expressions and confirmed by checksums.

Patterns propose spans; validators (part ranges, Luhn, mod 97, digit counts) confirm
them; words near a span move its score. Only DataFrame functions are used. Spark's
regular expressions give matches without offsets, so each pattern is also used to split
the text: matches and the gaps between them alternate, and running sums of their lengths
in code points are the offsets. Context is read off the ends of gaps, not off the text
by offset, which would be read from its start for every match.

The patterns are written so that no text can make them slow: every repetition is
possessive where that cannot change the match, and a pattern that fails within a run of
its own characters isn't tried again from the middle of that run. `\\G` lets a search go
on where the previous match ended, as leftmost matches that don't overlap ask for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kind, pattern, a literal that a text must hold to be searched (None: any).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Added by the method: international bank account numbers, hyphened national numbers, and keys, tokens and
#: passwords, which are long runs of letters and digits after a word that says so.
IBAN = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"[A-Za-z0-9+/_-]{16,}+={0,2}"

#: What a span scores before and after its checks. An added span is reported from REPORT on.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "national": 0.4, "secret": 0.4}
CONTEXT_GAIN, REPORT, CONTEXT_CHARS = 0.3, 0.7, 40
CONTEXT = {
    "email": "mail|contact|write", "ip": r"\bip\b|address|host|server", "card": "card|credit|visa|payment", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta", "national": "ssn|social|security|insurance|national",
    "secret": "token|secret|passw|pwd|credential|bearer|(api|access|private|auth)[ _-]?key",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national", "secret")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2).cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(at, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10: the first four move to the end, letters count from 10."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # The digits without leading zeros: three at most, and as a number 255 at most.
        part = lambda p: F.regexp_replace(p, r"^0++(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & luhn(F.substring(_digits(m), 1, 19))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(m, F.lit(" "), F.lit("")))
    if kind == "secret":
        return m.rlike("[0-9].*[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


#: Characters that a match has at least, by kind: so many matches lie within the characters before another one.
LEAST = {"email": 5, "ip": 7, "card": 2, "phone": 4, "iban": 12, "national": 11, "secret": 16}
_PAIR = "array<struct<g:int,tail:string,m:string,n:int>>"


def _pairs(text: Column, pattern: str, needed: str | None) -> Column:
    """For each match in turn (g, tail, m, n): the length and the end of the gap before it, the match and its length."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    tail = lambda c: F.right(c, F.lit(CONTEXT_CHARS))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), tail(g).alias("tail"), m.alias("m"), F.length(m).alias("n")))
    searched = text.contains(needed) if needed else text.rlike(pattern)
    return F.when(searched, pairs).otherwise(F.array().cast(_PAIR))


def _starts(pairs: Column) -> Column:
    """Where the gap before each match starts. Sums are taken within blocks of as many matches as there are
    blocks, and of whole blocks, so a text of very many matches isn't slower for each."""
    block = F.greatest(F.ceil(F.sqrt(F.size(pairs))), F.lit(1)).cast("int")
    blocks = F.when(F.size(pairs) > 0, F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    own = lambda k: F.slice(pairs, k * block + 1, block)
    nothing = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    sums = F.transform(blocks, lambda k: F.aggregate(own(k), F.lit(0), lambda a, p: a + p["g"] + p["n"]))
    firsts = F.aggregate(sums, nothing(F.lit(0)), step, lambda a: a["out"])
    return F.flatten(F.zip_with(blocks, firsts, lambda k, at: F.aggregate(own(k), nothing(at), lambda a, p: step(a, p["g"] + p["n"]), lambda a: a["out"])))


def _spans(kind: str, pairs: Column, starts: Column) -> Column:
    """Array of (kind, start, end, score), in order of start, of the matches that are confirmed."""
    back = -(-CONTEXT_CHARS // LEAST[kind])

    def near(p, i):
        before = F.transform(F.slice(pairs, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back))), lambda q: F.concat(q["tail"], q["m"]))
        return F.lower(F.right(F.concat(F.array_join(before, ""), p["tail"]), F.lit(CONTEXT_CHARS)))

    def judged(p, i):
        score = F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(near(p, i).rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0))
        start = (F.get(starts, i) + p["g"]).cast("long")
        return F.when(_valid(kind, p["m"]), F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + p["n"]).alias("end"), score.alias("score")))

    return F.filter(F.transform(pairs, judged), lambda s: s.isNotNull())


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, spans), one for each row of docs, spans an array of (kind, start, end, score).

    Base kinds (email, ip, card, phone) hold every match that its validator confirms,
    whatever its score; the added kinds (iban, national, secret) only spans of a score of
    at least REPORT, so a national number or a secret needs a context word before it.
    A secret has a letter and two digits at least. Offsets count code points.

    Null or empty text: no spans. Null ids and repeated rows are kept as they are; each
    row is judged by itself. Spans of several kinds may cover the same characters. Other
    columns are ignored. No rows: no rows. A text may be of any length.
    """
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    patterns = {"email": (EMAIL, "@"), "ip": (IP, None), "card": (CARD, None), "phone": (PHONE, "+"), "iban": (IBAN, None), "national": (NATIONAL, None), "secret": (SECRET, None)}
    # Columns of their own, so that each is computed once.
    base = base.select("__id", *[_pairs(F.col("__t"), p, needed).alias(k) for k, (p, needed) in patterns.items()])
    base = base.withColumns({f"{k}_at": _starts(F.col(k)) for k in patterns})
    found = {k: _spans(k, F.col(k), F.col(f"{k}_at")) for k in BASE + ADDED}
    strong = [F.filter(x, lambda s: s["score"] >= REPORT) if k in ADDED else x for k, x in found.items()]
    return base.select(F.col("__id").alias(id_col), reduce(F.concat, strong).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    shown = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"),
    )


def _sql_kind(kind: str, pattern: str, valid: str) -> str:
    return f"""
{kind}_raw AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM docs),
{kind}_at AS (
  SELECT doc_id, t, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS start, length(m) AS n
  FROM (SELECT doc_id, t, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM {kind}_raw WHERE len(ms) > 0)
),
{kind} AS (SELECT doc_id, '{kind}' AS kind, start::BIGINT AS s, (start + n)::BIGINT AS e FROM {kind}_at WHERE {valid})"""


_D = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN (len({_D}) - i) % 2 = 0 THEN {_D}[i]::INT ELSE {_D}[i]::INT * 2 - CASE WHEN {_D}[i]::INT > 4 THEN 9 ELSE 0 END END FOR i IN range(1, len({_D}) + 1)]) % 10 = 0"
_I = "replace(m, ' ', '')"
_IBAN_DIGITS = f"list_aggregate([CASE WHEN c >= 'A' THEN (ascii(c) - 55)::VARCHAR ELSE c END FOR c IN string_split(substr({_I}, 5) || substr({_I}, 1, 4), '')], 'string_agg', '')"
_REDUCE = "list_reduce([x::BIGINT FOR x IN string_split({}, '')], lambda a, b: (a * 10 + b) % 97) = 1"
_NEAR = "lower(substr(t, (greatest(start - 40, 0) + 1)::BIGINT, least(start, 40)::BIGINT))"

OP7_SQL = (
    "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),"
    + ",".join(
        [
            _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
            _sql_kind("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and([p::HUGEINT <= 255 FOR p IN string_split(m, '.')])"),
            _sql_kind("card", r"[0-9](?:[\x20-]?[0-9])+", f"len({_D}) BETWEEN 13 AND 19 AND {_LUHN}"),
            _sql_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_D}) BETWEEN 9 AND 15"),
            _sql_kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", f"len({_I}) BETWEEN 15 AND 34 AND {_REDUCE.format(_IBAN_DIGITS)}"),
            _sql_kind("national", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", f"regexp_matches({_NEAR}, 'ssn|social|security|insurance|national')"),
            _sql_kind("secret", r"[A-Za-z0-9+/_-]{16,}={0,2}", f"regexp_matches(m, '[0-9].*[0-9]') AND regexp_matches(m, '[A-Za-z]') AND regexp_matches({_NEAR}, '{CONTEXT['secret']}')"),
        ]
    )
    + """,
found AS (SELECT *, 1 AS o FROM email UNION ALL SELECT *, 2 FROM ip UNION ALL SELECT *, 3 FROM card UNION ALL SELECT *, 4 FROM phone UNION ALL SELECT *, 5 FROM iban UNION ALL SELECT *, 6 FROM national
          UNION ALL SELECT *, 7 FROM secret)
SELECT d.doc_id, count(*) FILTER (WHERE o = 1) AS n_email, count(*) FILTER (WHERE o = 2) AS n_ip, count(*) FILTER (WHERE o = 3) AS n_card, count(*) FILTER (WHERE o = 4) AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (WHERE o <= 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (WHERE kind IS NOT NULL), '') AS spans,
       count(kind) AS n_spans
FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""
)
