import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import near_copies

from .test_leaks_toxicity_pipeline import shingles


def brute_groups(rows, similarity=0.8):
    """Of each row the smallest id of its component by exact Jaccard of five-word shingles."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or len(a & b) >= similarity * len(a | b) - 1e-9 and a | b:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(rows))]


def edited():
    """Texts with 1 to 6 words in a hundred exchanged, so on both sides of 0.8."""
    r, rows = random.Random(4), []
    for _ in range(40):
        base = [f"w{r.randrange(900)}" for _ in range(r.randrange(40, 300))]
        for _ in range(4):
            own = base[:]
            for k in r.sample(range(len(own)), max(1, len(own) * r.randrange(1, 7) // 100)):
                own[k] = f"x{r.randrange(900)}"
            rows.append((len(rows), " ".join(own).title()))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (None, rows[0][1]), (3, rows[3][1]), (None, "lonely words here now and then")]


@pytest.mark.parametrize("part", [8, 4096])
def test_components_are_those_of_exact_jaccard(docs, part):
    rows = edited()
    got = near_copies.near_copies(docs([(*x, "s") for x in rows]), part=part).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, got)) == sorted(key((d, c)) for (d, _), c in zip(rows, brute_groups(rows)))
    assert near_copies.near_copies(docs([])).count() == 0


def test_stage_drops_copies_of_jaccard_0_8(docs, spark):
    rows = edited()
    got = corpus_pipeline.drop_near_duplicates(spark, docs([(*x, "s") for x in rows]), "").select("doc_id").collect()
    assert sorted(r[0] for r in got if r[0] is not None) == sorted({d for (d, _), c in zip(rows, brute_groups(rows)) if d is not None and d == c})


def test_sets_are_those_of_the_words():
    texts = ["A b c d e f A b c d e", "", "a B", "a b c d e", "x " * 50]
    _, at = near_copies.shingle_sets(pa.array(texts))
    assert (at[1:] - at[:-1]).tolist() == [len(shingles(t)) for t in texts]


def test_simhash_finds_candidates_and_jaccard_decides(docs, monkeypatch):
    """The classes of op1's operator are a key of the sets, whatever they hold: here all are one class."""
    rows, asked = edited(), []
    own = near_copies.simhash.near_duplicates

    def one_class(df, id_col):
        asked.append(id_col)
        return own(df, id_col).withColumn("component_id", F.lit(7).cast("long"))

    monkeypatch.setattr(near_copies.simhash, "near_duplicates", one_class)
    got = near_copies.near_copies(docs([(*x, "s") for x in rows])).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert asked == ["node"]
    assert sorted(map(key, got)) == sorted(key((d, c)) for (d, _), c in zip(rows, brute_groups(rows)))
