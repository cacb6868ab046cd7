import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, mixing, pii

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, min_chars=10, min_docs=2):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(float("inf") if d is None else d)
    out = []
    for d, t in rows:
        own, lines = float("inf") if d is None else d, (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or min(held[key(x)]) == own]
        out.append((-1 if d is None else d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(docs, min_docs):
    line = "The Same Line É"
    rows = [(5, f"a\n {line}\t\nshort\nshort"), (2, f"x\n{line.translate(LOWER)}\n{line}\nshort"), (9, line), (None, f"{line}\nown line of nobody"), (None, f"other\n{line}"), (3, None), (4, ""), (7, "\n\n"), (9, line), (9, f"two texts\n{line}"), (11, "Éxactly ten"), (12, "éxactly ten"), (13, "0123456789"), (14, "012345678"), (15, "012345678"), (16, "0123456789\r"), (17, "\n".join(["many lines here"] * 5000 + [line]))]
    got = line_dedup.line_dedup(docs([(*r, "s") for r in rows]), min_docs=min_docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_lines(rows, min_docs=min_docs)
    assert line_dedup.line_dedup(docs([])).count() == 0


def test_mixing(docs):
    r = random.Random(7)
    rows = [(i, " ".join(["w"] * r.randrange(0, 900)), r.choice(["a", "a", "a", "a", "b", None, "c", "É"])) for i in range(700)]
    rows += [(None, "x y z", "a"), (3, rows[3][1], rows[3][2]), (800, None, "b"), (801, "", "b"), (802, "w " * 60_000, "b"), (803, "\n\t", "empty")]
    taken, pieces = mixing.mix(docs(rows))
    got = taken.collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(g["size"] for g in got) == sorted(size(t) for _, t, _ in rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while True:  # shares, with the excess shared again
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weights[s] for s in open_}
    by_size = {sizes[s]: s for s in names}
    total = dict.fromkeys(names, 0)
    for g in got:
        s = by_size[g.source_size]
        assert g.target == pytest.approx(target[s]) and 0 <= g.taken <= 3 * g["size"]
        total[s] += g.taken
    for s in names:
        assert total[s] == pytest.approx(target[s], abs=0.02 * target[s] + 4 * mixing.BLOCK_WORDS)
    assert sum(p["last"] - p["first"] for p in pieces.collect()) == sum(total.values())
    again = mixing.mix(docs(rows[::-1]))[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # Every part of the schedule is mixed alike.
    sources = mixing.staged(mixing.source_targets(docs(rows).selectExpr("source", "length(text) - length(replace(text, ' ', '')) as size").na.fill(0)), "t")
    slots = [x.s for x in mixing.schedule(sources).orderBy("slot").collect()]
    for s in set(slots):
        want = slots.count(s) / len(slots)
        for k in range(0, len(slots) - 200, 200):
            assert abs(slots[k : k + 200].count(s) / 200 - want) < 0.05
    assert mixing.mix(docs([]))[0].count() == 0 and mixing.mix(docs([(1, None, "a")]))[0].first().taken == 0


def test_small_sources_get_their_targets(docs):
    """Thousands of sources of a few words, and some large ones: each within a word of its target."""
    r = random.Random(17)
    rows = [(i, " ".join(["w"] * r.randrange(1, 40)), f"s{i % 3000:04}") for i in range(9000)] + [(9000 + i, "w " * 5000, f"t{i % 3}") for i in range(12)]
    taken, _ = mixing.mix(docs(rows))
    got = taken.collect()
    assert len(got) == len(rows)
    size, target, total = {}, {}, {}
    source = {d: s for d, _, s in rows}
    for g in got:
        s = source[g.doc_id]
        size[s], target[s], total[s] = g.source_size, g.target, total.get(s, 0) + g.taken
        assert g.taken <= 3 * g["size"]
    assert all(abs(total[s] - target[s]) <= 0.5 for s in target)
    assert sum(total.values()) == pytest.approx(sum(size.values()), rel=0.01)


def test_points_of_far_slots(spark):
    """However far the schedule goes, a source of a small quota gets its slots."""
    far = [0, 1, 2, (1 << 31) - 1, 1 << 31, 50_000_000_000, (1 << 45) + 12345]
    got = spark.createDataFrame([(x,) for x in far], "id long").select(mixing.point(F.col("id")).alias("p")).collect()
    assert [x.p for x in got] == [x * mixing.STEP % mixing.TURN for x in far]
    start = 50_000_000_000
    near = sorted(x.p for x in spark.range(start, start + 4096).select(mixing.point(F.col("id")).alias("p")).collect())
    gaps = [b - a for a, b in zip(near, near[1:])]
    assert len(set(near)) == 4096 and max(gaps) < 4 * mixing.TURN // 4096


def test_a_text_of_very_many_matches(docs):
    """Context and offsets of two hundred thousand addresses in one text, in seconds."""
    n = 200_000
    text = "mail " + " ".join(f"u{i}@example.org" for i in range(n)) + " call +1 212 555 0100"
    began = time.perf_counter()
    row = pii.personal_data(docs([(1, text, "s")])).select(F.size("spans").alias("n"), F.element_at("spans", n).alias("last"), F.element_at("spans", 1).alias("first"), F.element_at("spans", -1).alias("phone")).first()
    assert time.perf_counter() - began < 60
    assert row.n == n + 1 and text[row["last"]["start"] : row["last"]["end"]] == f"u{n - 1}@example.org"
    assert row.first.score == 1.0 and row["last"]["score"] == 0.9 and row.phone.kind == "phone" and row.phone.score == 1.0


def luhn_ok(x):
    d = [int(c) for c in x][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def brute_base(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn_ok(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]


def test_personal_data(docs):
    r = random.Random(11)
    bits = ["a@b.co", "x.y+z@mail-1.example.com", "a@b", "é@b.c.d", "@", "a@b.c_x@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713000003", "1", "12", "+1 (212) 555-0100", "+12", "+49 30 123456--", "++44 20 7946 0958.", " ", ".", "-", "é", "\n", "card ", "00000000000000000000", "日本"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", "x"]) for _ in range(r.randrange(1, 25))) for _ in range(400)]
    texts += [None, "", "\U0001f600 a@b.co"]
    got = {x.doc_id: x.spans for x in pii.personal_data(docs([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind in pii.BASE] == brute_base(t or ""), t and t[:200]
    assert pii.personal_data(docs([])).count() == 0


def test_long_runs_are_not_slow(docs):
    n = 100_000
    texts = ["a" * n, "a." * n + "@", "a@" + "b." * n, "1" * n, "1." * n, "1 " * n, "+1" + "-" * n, "+1" * (n // 5)]
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans] for x in pii.personal_data(docs([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: [] for i in range(8)} | {2: [("email", 0, 2 * n + 1)], 4: [("ip", 8 * i, 8 * i + 7) for i in range(n // 4)]}


def test_added_kinds_and_scores(docs):
    rows = [(1, "IBAN: GB82 WEST 1234 5698 7654 32 please", "s"), (2, "GB82 WEST 1234 5698 7654 33", "s"), (3, "my ssn is 078-05-1120", "s"), (4, "part 078-05-1120", "s"), (5, "mail me at a@b.co", "s"), (6, "DE89370400440532013000", "s"), (None, "x@y.zz", "s")]
    got = {x.doc_id: [(s.kind, round(s.score, 2)) for s in x.spans] for x in pii.personal_data(docs(rows)).collect()}
    assert ("iban", 1.0) in got[1] and not [k for k, _ in got[2] if k == "iban"] and got[3] == [("national", 0.7)] and got[4] == []
    assert got[5] == [("email", 1.0)] and ("iban", 0.9) in got[6] and got[None] == [("email", 0.9)]


def test_secrets_need_a_context_word(docs):
    key = "9f86d081884c7d65"
    rows = [(1, f'token = "{key}"', "s"), (2, f"password={key}\n", "s"), (3, f"commit {key}", "s"), (4, "the secret wordwithoutanydigits stays", "s"), (5, "password=short1", "s"), (6, "token 4111111111111111", "s"), (7, f"API_KEY: {key}== x", "s"), (8, f"é token:{key}", "s")]
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans if s.kind == "secret"] for x in pii.personal_data(docs(rows)).collect()}
    assert got == {1: [("secret", 9, 25)], 2: [("secret", 9, 25)], 3: [], 4: [], 5: [], 6: [], 7: [("secret", 9, 27)], 8: [("secret", 8, 24)]}


def test_planted_personal_data_is_found(spark):
    """Of documents with an address, number or secret in its usual form, nine in ten at least; of documents without a digit, none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {x.doc_id: len(x.spans) for x in pii.personal_data(docs).collect()}
    planted = re.compile(r"[a-z]+\.\d\d@mail\d\.example|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{2,3}(\.\d{2,3}){3}\b|(token = \"|password=)[0-9a-f]{18}", re.I)
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    has = [i for i, t in texts.items() if planted.search(t)]
    assert len(has) > 20 and sum(found[i] > 0 for i in has) >= 0.9 * len(has)
    assert not any(found[i] for i, t in texts.items() if not re.search("[0-9]", t))


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
