import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import components, simhash, token_counts, topk

R = random.Random(5)
WORDS = ["ab", "cde", "É", "f", "ghij", "klm", "no", "pq", "xyz", "Über"]


def text(n):
    return " ".join(R.choice(WORDS) + str(R.randrange(50)) for _ in range(n))


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(ids))]


def test_fingerprint_and_components(docs):
    base = text(400)
    near = [base.replace(base.split()[k], "zz", 1) for k in (7, 90, 300)]
    rows = [(9, base, "a"), (3, near[0], "a"), (12, near[1], "a"), (4, near[2], "a"), (7, None, "a"), (8, "", None), (2, " \t\n", "b"), (5, "One", "b"), (6, "one", "b"), (None, "one", "b"), (None, "lonely words here now", "b"), (9, base, "a"), (11, "a b É", "c"), (13, text(30_000), "c")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs(rows)).collect())
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    comp = brute_components([r[0] for r in rows], fps)
    assert got == sorted((r[0] is None, r[0] or 0, f, c) for r, f, c in zip(rows, fps, comp))
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("part", [64, 4096])
def test_links_lose_nothing(spark, part):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 150, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds[:20].tolist():  # groups of neighbours, one of them large
        for _ in range(300 if s == seeds[0] else 6):
            x = s
            for b in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    comps = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components.components(simhash.links(df, part=part)).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, set()).add(f)
    got = {}
    for f in fps:
        got.setdefault(comps.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_long_paths_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (700, 701), (700, 701)], "a long, b long")
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert roots == {i: 0 for i in range(201)} | {700: 700, 701: 700}
    assert components.components(edges.limit(0)).count() == 0


def test_token_counts_of_chunks_equal_whole_texts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [None, "", "short's text", "x" * 9000, " " * 4000 + "word" + " " * 3000, text(4000), "a<|endoftext|>b" * 700, "<|endoftext|>" * 900, "\n\n é  ü" * 2000, "don't  we'll  !!<|endof" * 600, "日本語" * 3000, " 12 345" * 900]
    rows = [(i, x, "s") for i, x in enumerate(texts)] + [(5, texts[5], "s"), (None, texts[8], "s")]
    got = token_counts.token_counts(docs(rows), path, chunk_chars=700, overlap=100).collect()
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(docs([]), path).count() == 0


def test_stretches_count_as_in_their_text():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    c = token_counts.Counter(path)
    assert c.separable
    assert not token_counts.Counter(public_tokenizers.path("word_bpe_49k.json")).separable
    rng = np.random.default_rng(4)
    bits = ["a", "B", "'s", "'ll", "12", "!", "é", "日", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u180e", "\u2003", "\u200b", "\u3000", "\ufeff", "<|endoftext|>", "<|end", "_", "\x00", "🙂", "ा"]
    texts = ["".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 60))) for _ in range(3000)]
    assert c.counts(texts) == c.encoded(texts)
    assert all("".join(token_counts.stretches(x)) == x for x in texts)
    for x in texts[:500]:
        n, head, tail = c.chunk(x, 9, 15)
        bounds = c.bounds(x)
        assert n == len(c.encoder.encode(x, add_special_tokens=False))
        assert head == [b for b in bounds if b[0] < 9] and tail == [b for b in bounds if b[0] >= 15]


def brute_top(rows, k):
    out = []
    for q, a in rows:
        if q % 50 == 0:
            s = sorted({(-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q and len(b) == len(a)})[:k]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 1 << 24])
def test_top_k(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) * size for x in rng.integers(-40, 40, 6)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, [1, 2]), (2001, [3, 4]), (2050, [])]
    odd = [(None, [1] * 6), (2002, None), (2003, [1, None])]
    df = spark.createDataFrame(rows + odd + rows[:3], "id long, v array<long>")
    got = sorted(tuple(r) for r in top_k_rows(df))
    assert got == brute_top(rows, 5)
    assert top_k_rows(df.limit(0)) == []


def test_blocks_of_clustered_vectors_are_skipped():
    """Of vectors in 40 clusters a query scores a quarter at most, and finds the same."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 100, (40, 16))
    v = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 5, (8000, 16))).astype(np.int64)
    ids = np.arange(8000)
    blocks = topk.Blocks(ids, v)
    q = np.flatnonzero(ids % 50 == 0)
    scores, found, filled = blocks.top(q, v[q], 5)
    want = v[q] @ v.T
    want[np.arange(len(q)), q] = -(1 << 40)
    assert filled.all() and (scores == -np.sort(-want, axis=1)[:, :5]).all()
    assert blocks.scored <= 0.25 * len(q) * len(v)


def test_vectors_that_are_not_finite_take_no_part(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.25]), (1, [0.501, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (50, [-0.001, 0.999]), (100, [-inf, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if i in (0, 1, 50)}
    got = topk.op3_topk(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(list(v.items()), 5)


def top_k_rows(df):
    return topk.top_k(df, F.col("id") % 50 == 0, shard_rows=100).collect()
