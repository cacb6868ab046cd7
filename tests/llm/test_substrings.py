import hashlib
import random

import pytest

from tidewatch.llm import hashing, substrings


def brute(rows, w=50):
    held = {}
    for d, t in rows:
        b = (t or "").encode()
        d = float("inf") if d is None else d
        for i in range(len(b) - w + 1):
            held[b[i : i + w]] = min(d, held.get(b[i : i + w], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - w + 1):
            if held[b[i : i + w]] < (float("inf") if d is None else d):
                gone[i : i + w] = [True] * w
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((-1 if d is None else d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def cases():
    r = random.Random(4)
    line = lambda n: "".join(r.choice("abc é\n") for _ in range(n))
    p, q = line(70), line(60)
    rows = [(5, line(100) + p + line(80)), (3, line(30) + p[5:] + q), (9, q[4:] + p + q + p), (2, None), (1, ""), (8, "short"), (4, "a" * 400), (6, "b" + "a" * 130 + "c"), (10, "ab" * 90), (11, "ab" * 70 + p)]
    rows += [(12, p[:49]), (13, p[:50]), (14, p[1:51] + "x" + p[:50]), (None, line(10) + p), (15, line(3000) + "x" * 300 + q), (16, q + line(2000))]
    return rows + [(20 + i, line(20) + p[i : i + 55] + line(15)) for i in range(14)]


@pytest.mark.parametrize(("twice", "buffer_rows"), [(False, 1), (False, 30), (True, 1 << 14)])
def test_against_brute_force(docs, spark, twice, buffer_rows, monkeypatch):
    rows = cases() + (cases()[:4] + [(5, "another " + cases()[2][1])] if twice else [])
    if not twice:
        monkeypatch.setattr(substrings, "BATCH_BYTES", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if buffer_rows == 1 else 10_000)
    got = substrings.repeated_substrings(docs([(*r, "s") for r in rows]), buffer_rows=buffer_rows).drop("kept").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute(rows)


def test_no_rows(docs):
    assert substrings.repeated_substrings(docs([])).count() == 0


def test_texts_beyond_a_piece_and_runs_of_one_letter(docs):
    """Texts over hashing.PIECE bytes, and more windows of one kind than a run of positions holds."""
    r = random.Random(7)
    line = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    p = line(120)
    long = line(hashing.PIECE - 40) + p + line(5000)
    rows = [(3, "x" + p + "y"), (5, long), (7, long[1000:2000] + p), (8, "z" * 200_000), (2, "z" * 60 + "q"), (9, "q" + "z" * 70_000 + p[:60])]
    got = substrings.repeated_substrings(docs([(*x, "s") for x in rows])).drop("kept").collect()
    assert sorted(tuple(x) for x in got) == brute(rows)
