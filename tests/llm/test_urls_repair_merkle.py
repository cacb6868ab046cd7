import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle, repair, url_filter

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# URLs


def test_parts_and_rules_of_urls(spark):
    """Against the rules as a regular expression or a loop says them."""
    urls = [
        None, "", "no scheme/x", "http://", "HTTP://A.Example.NET/en/x", "http://example.net", "http://example.net?q=/en/", "https://xexample.net/en/", "x://net/", "x://org/fr/#a", "x://b.org/FR/",
        "x://a.example.com/de/1?y#z", "x://a.example.com#/de/", "a://b://c/d", "x://É.example.net/en/é", "x://example.org/fr", "x://.net/", "x://example.net./en/", "x://" + "long" * 9000 + ".net/" + "p/" * 9000,
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, n string")
    got = {r.page_id: r for r in url_filter.judged(pages, spark.createDataFrame([], "text string")).collect()}
    assert len(got) == len(urls) * 2
    for i, u in enumerate(urls * 2):
        _, found, rest = (u or "").partition("://")
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0] if found else ""
        host = "".join(c.lower() if c.isascii() else c for c in host) if found else ""
        fits = [(len(r), r, v) for r, v in url_filter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        want = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want[1:])
    assert url_filter.judged(pages.limit(0), pages.select(F.col("url").alias("text"))).count() == 0


def test_splits_are_the_most_probable_ones():
    r = random.Random(3)
    for _ in range(300):
        run = "".join(r.choice("abc") for _ in range(r.randrange(1, 9)))
        words = {run[i:j]: r.choice([1, 3, 50]) for i in range(len(run)) for j in range(i + 1, len(run) + 1) if r.random() < 0.3}
        total = 1000
        at = [(s, n, words[run[s : s + n]]) for s in range(len(run)) for n in range(1, len(run) - s + 1) if run[s : s + n] in words]
        got = url_filter.best_split(run, *zip(*at), total) if at else url_filter.best_split(run, (), (), (), total)
        price = lambda w: max(math.log(words[w] / (total + 10)) if w in words else -math.inf, math.log(10 / (total + 10)) - len(w) * math.log(10))
        every = [[run[a:b] for a, b in itertools.pairwise((0, *cut, len(run)))] for k in range(len(run)) for cut in itertools.combinations(range(1, len(run)), k)]
        assert "".join(got) == run
        assert sum(map(price, got)) == pytest.approx(max(sum(map(price, x)) for x in every))
    assert url_filter.best_split("qqq", (), (), (), 0) == ["qqq"]


def test_what_unwanted_names_share_is_learnt(spark):
    r = random.Random(5)
    clean = ["green", "garden", "river", "stone", "music", "house", "paper", "light"]
    hosts = [f"{''.join(r.sample(clean, 2))}.example" for _ in range(300)]
    hosts += [f"{x}.example" for x in ["casino-win"] * 9 + ["cheap-pills"] * 9 + ["free-bets"] * 9]
    hidden = ["wincheap.example", "cheapwinfree.example"]
    spared = ["gardenmusic.example", "unheardof.example", "riverriver.example", ""]
    urls = [f"https://{h}/a/{i}" for i, h in enumerate(hosts + hidden + spared)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    texts = spark.createDataFrame([(" ".join(clean * 50),), ("the The THE a b garden",), (None,), ("",)], "text string")
    got = {r.host: r.verdict for r in url_filter.judged(pages, texts).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"casino-win.example", "cheap-pills.example", "free-bets.example", *hidden}
    labels = spark.createDataFrame([(u, "stone" in u) for u in urls], "url string, blocked boolean")
    got = {r.host: r.verdict for r in url_filter.judged(pages, texts, labels=labels).collect()}
    assert all((got[h] == "block") == ("stone" in h) for h in hosts)
    assert url_filter.runs_of(F.lit("a")) is not None
    long_run = "cheap" * 200
    got = spark.createDataFrame([(f"--É{long_run}9Z",)], "x string").select(url_filter.runs_of(F.col("x")).alias("r")).first().r
    assert "".join(got) == f"É{long_run}z" and max(map(len, got)) == url_filter.PIECE


def test_url_query_splits_hosts_from_verdicts(spark):
    rows = url_filter.op11_url_filter(spark, SF).collect()
    con = duckdb.connect()
    want = con.execute(
        f"""SELECT page_id, coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
        CASE WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM '{SF}/pages.parquet'"""
    ).fetchall()
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.host, r.path, r.rule)) for r in rows)
    unwanted = {"spam", "farm", "cheap", "pills", "casino", "win", "free", "bets", "adult", "track", "ads"}
    for r in (r for r in rows if not r.rule):
        assert (r.verdict == "block") == bool(unwanted & set(re.split("[-.]", r.host)))


# Conversations


def initials_ok(x):
    return re.fullmatch("(s?(ua)+)?", x) is not None


def cheapest(rows):
    """(cost, audit) by trying every edit of every row, with up to two rows inserted at each place."""
    best = (10**9, "")
    gaps = ["", "u", "a", "ua", "au"]
    options = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, f in rows]
    for edits in itertools.product(*options):
        floor = sum({"D": 2, "K": 0}.get(e, 1) + 5 * (e != "D" and f == "truncated") for e, (_, f) in zip(edits, rows))
        if floor > best[0]:
            continue
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost = floor + 5 * sum(map(len, ins))
            if cost > best[0]:
                continue
            word = ins[0] + "".join(("" if e == "D" else r if e == "K" else e[1]) + i for e, (r, _), i in zip(edits, rows, ins[1:]))
            if initials_ok(word):
                best = min(best, (cost, "I" * len(ins[0]) + "".join(e[0] + "I" * len(i) for e, i in zip(edits, ins[1:]))))
    return best


def test_repairs_are_the_cheapest():
    r = random.Random(9)
    for _ in range(250):
        rows = [(r.choice("suaat"), r.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(r.randrange(0, 5))]
        ways = repair.Ways()
        for initial, fault in rows:
            ways.read(initial, fault)
        assert ways.best() == cheapest(rows), rows


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) by a table over the roles expected next."""
    seen, judged = set(), []
    ink = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t)
    for turn, role, text in rows:
        fault = "blank" if not ink(text) else "duplicate" if (role, text) in seen else "truncated" if ink(text)[-1] not in ".!?" else None
        seen.add((role, text))
        judged.append((turn, role, text, fault))
    moves = {("0", "s"): "H", ("0", "u"): "U", ("H", "u"): "U", ("U", "a"): "B", ("B", "u"): "U"}
    names = {"u": "user", "a": "assistant"}

    def inserted(ways):
        for _ in range(3):
            for st, (cost, audit, lines) in list(ways.items()):
                for x, name in names.items():
                    if nxt := moves.get((st, x)):
                        ways[nxt] = min(ways.get(nxt, (10**9,)), (cost + 5, audit + "I", lines + (f"{name}:",)))
        return ways

    ways = inserted({"0": (0, "", ())})
    for _, role, text, fault in judged:
        after = {}
        for st, (cost, audit, lines) in ways.items():
            tries = [(st, cost + 2, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                tries.append((moves.get((st, role[:1])), cost + more, audit + "K", lines + (f"{role}:{text}",)))
                tries += [(moves.get((st, x)), cost + more + 1, audit + "R", lines + (f"{name}:{text}",)) for x, name in names.items()]
            for nxt, *way in tries:
                if nxt:
                    after[nxt] = min(after.get(nxt, (10**9,)), tuple(way))
        ways = inserted(after)
    cost, audit, lines = min(w for st, w in ways.items() if st in "0B")
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda f: sum(x[3] == f for x in judged)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha("\n".join(lines)))


CONVS = "conv_id long, turn long, role string, text string, conv string, place string"


def reports(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CONVS)
    return {r[0]: tuple(r)[1:] for r in repair.reported(repair.repair(df)).collect()}


def test_odd_conversations(spark):
    r = random.Random(13)
    texts = ["Yes.", "No", "Why? ", "", " \t\n", "Stop!\n", "é", ".", "One. two", None]
    rows = [(r.choice([1, 2, 3, 4, None]), r.choice([0, 1, 2, 3, 7, None]), r.choice(["user", "assistant", "system", "tool", "", None, "ursula"]), r.choice(texts)) for _ in range(120)]
    rows += [(9, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(2000)] + [(10, i, "tool", "x" * 200_000 + ("." if i else "")) for i in range(3)]
    rows += [(11, i, "user", f"Same {i}." if i % 7 else "") for i in range(700)] + [(12, 5, "user", "Same.")] * 300
    got = reports(spark, rows)
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append((rest[0], *(" " if x is None else x for x in rest[1:])))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())
    assert got == {c: plain_repair(sorted(x, key=order)) for c, x in by.items()}
    assert reports(spark, []) == {}
    edits = repair.repair(spark.createDataFrame([(*x, "", "") for x in rows[120:2120]], CONVS)).collect()
    assert [e.place for e in edits] == list(range(2000)) and {e.edit for e in edits} == {"K"}


def test_damage(spark):
    rows = [(c, t, "system" if not t else ("user", "assistant")[t % 2], f"Text {c} {t}. Is it?") for c in range(60) for t in range(6)] + [(None, None, None, None), (70, None, "user", "A."), (71, 0, "user", "B.")]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text)
        want += [row] * {0: 0, 3: 2}.get(what, 1)
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in got)


# Manifest


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    return [(("R" if i >> h ^ 1 > i >> h else "L") + level[i >> h ^ 1]) if i >> h ^ 1 < len(level) else "" for h, level in enumerate(levels[:-1])]


def test_positions_in_the_log():
    for n in range(1, 140):
        levels = plain_tree([sha(str(i)) for i in range(n)])
        log = merkle.built([x.encode() for x in levels[0]], len(levels) - 1)
        assert len(log) == merkle.HEX * sum(map(len, levels)) and merkle.height(n, n, 8) == len(levels) - 1
        for h, level in enumerate(levels):
            for j, x in enumerate(level):
                p = merkle.HEX * merkle.position(n, h, j)
                assert log[p : p + merkle.HEX].decode() == x
        for i in range(n):
            assert merkle.siblings(log, n, i, len(levels) - 1) == plain_path(levels, i)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest(spark, levels):
    r = random.Random(21)
    rows = [(r.choice([None, r.randrange(500)]) if i % 9 == 0 else i, r.choice(["a", "", None, "ß" * 5, "x" * 100_000]), r.choice(["s", None]), r.choice(["en", "de", "en", "en", None, "", "é"]), r.choice([None, i]), "k") for i in range(330)]
    rows += [rows[5]] * 40 + [(7, "t", "s", "one", 3, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, k string").withColumn("idx", F.lit("clash"))
    got = merkle.manifest(docs, claims={"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, levels=levels).collect()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, s, g, n: sha(*map(part, (d, s, g, n, t)))
    trees = {}
    for d, t, s, g, n, _ in rows:
        claimed = leaf(d, t, s, g, n + 1) if d is not None and n is not None and d % 3 == 0 else leaf(d, t, s, g, n)
        trees.setdefault(g, []).append((d is not None, d or 0, leaf(d, t, s, g, n), claimed))
    langs = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: plain_tree([x[2] for x in sorted(trees[g])]) for g in langs}
    top = plain_tree([built[g][-1][0] for g in langs])
    want = []
    for k, g in enumerate(langs):
        for i, (named, d, own, claimed) in enumerate(sorted(trees[g])):
            path = plain_path(built[g], i) + plain_path(top, k)
            fold = claimed
            for s in path:
                fold = sha(s[1:], fold) if s[:1] == "L" else sha(fold, s[1:])
            want.append((d if named else None, own, built[g][-1][0], top[-1][0], path, fold, fold == top[-1][0]))
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in got)
    assert {x.verified for x in got} == {True, False}


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    assert merkle.manifest(docs).count() == 0
