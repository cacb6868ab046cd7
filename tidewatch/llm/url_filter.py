"""Operator 11: judge URLs by rules, and by the words that their names are made of.

A rule is a host and the beginning of a path; it fits its host and all hosts below it,
and the longest rule that fits decides. Where none does, a multinomial naive Bayes
model over the words of host and path decides. Names are often words written together,
so every run of letters is split by Viterbi search under a unigram model: the split
whose words are most probable, a run that isn't a known word paying for each letter.

Words are counted over a whole corpus and over the parts of hyphenated host names.
Candidate words of a run are found by joining its substrings with those counts, so no
vocabulary is held in a task. The model learns from labels, or, where there are none,
from URLs that name what isn't wanted outright (SEEDS); what else such URLs have in
common is what it adds. A URL's score is a sum over its runs, so each distinct run is
scored once, whatever the number of URLs that hold it. Scores are whole numbers, so their
sums don't depend on the order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, attached, staged, table

#: (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that name unwanted sites outright.
SEEDS = ("adult", "porn", "xxx", "sex", "casino", "poker", "betting", "bets", "gambling", "pills", "viagra", "spam", "malware", "phishing", "ads", "torrent")
#: Letters of a word at most; letters of a run that are split at once.
WORD_LETTERS, PIECE = 24, 256
#: Words, in the proportions of all classes, that each class is taken to have had beside its own; units of a score.
PRIOR_WORDS, UNIT = 1.0, 1 << 20
NOT_LETTERS = r"[^\p{L}]+"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first ://, up to / ? # or the end, A-Z in lower case; then up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(urls: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame) -> DataFrame:
    """Distinct (host, path) with rule and rule_verdict, the longest rule that fits or null.

    Rules are (host and path, verdict), as pairs or as rows (rule, verdict). A host is joined with rules
    by itself and by the hosts above it; the rules of one host are held in a row. Of rules of one
    length the greater text decides, then the greater verdict.
    """
    rules = rules if isinstance(rules, DataFrame) else urls.sparkSession.createDataFrame(list(rules), "rule string, verdict string")
    slash = F.instr("rule", "/")
    rules = rules.filter(slash > 0).select(F.substr("rule", F.lit(1), slash - 1).alias("rule_host"), F.substr("rule", slash).alias("rule_path"), "rule", "verdict")
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").distinct().select(F.col("host").alias("h"), F.explode(above).alias("above"))
    fits = attached(hosts, staged(rules, "rules"), F.col("above") == F.col("rule_host"), "inner", 1 << 12)
    fits = staged(fits.groupBy("h").agg(F.collect_set(F.struct("rule", "rule_path", "verdict")).alias("rules")), "rules-of-hosts")
    fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    joined = attached(urls, fits, F.col("host") == F.col("h"), "left", 1 << 12)
    return joined.select(*urls.columns, best["rule"].alias("rule"), best["verdict"].alias("rule_verdict"))


def runs_of(c: Column) -> Column:
    """The runs of letters of a text, A-Z in lower case; a longer one than PIECE in pieces."""
    pieces = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.length(r) - 1) / PIECE).cast("int")), lambda i: F.substr(r, i * PIECE + 1, F.lit(PIECE)))
    runs = F.filter(F.split(F.translate(c, UPPER, LOWER), NOT_LETTERS), lambda r: F.length(r) > 0)
    return F.flatten(F.transform(runs, pieces))


def word_counts(texts: DataFrame, text_col: str, hosts: DataFrame) -> DataFrame:
    """Rows (w, c): how often a word of at most WORD_LETTERS letters occurs in the texts, or as a part of
    a hyphenated label of the distinct hosts."""
    said = texts.select(F.explode(F.split(ascii_lower(F.col(text_col)), NOT_LETTERS)).alias("w"))
    hyphenated = F.filter(F.split("host", "\\."), lambda x: x.contains("-"))
    named = hosts.select(F.explode(F.flatten(F.transform(hyphenated, runs_of))).alias("w"))
    short = F.length("w").between(1, WORD_LETTERS)
    return said.filter(short).unionByName(named.filter(short)).groupBy("w").agg(F.count(F.lit(1)).alias("c"))


def best_split(run: str, starts: Iterable[int], lengths: Iterable[int], counts: Iterable[int], total: int) -> list[str]:
    """The most probable split of a run, given the known words in it (where, letters, count) of `total` counted ones.

    A known word has the probability c / (total + 10), an unknown one of n letters 10 / (total + 10) / 10**n.
    Of equally probable splits one of fewer words is taken.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for s, n, c in zip(starts, lengths, counts):
        ends.setdefault(s + n, []).append((s, math.log(c / (total + 10))))
    whole, letter = math.log(10 / (total + 10)), math.log(10)
    best = [(0.0, 0, 0)] + [(-math.inf, 0, 0)] * len(run)  # (score, words less, start of the last word)
    unknown = (-math.inf, 0, 0)  # the best way to be within an unknown word here
    for i in range(1, len(run) + 1):
        score, words, _ = best[i - 1]
        unknown = max((unknown[0] - letter, unknown[1], unknown[2]), (score + whole - letter, words - 1, i - 1))
        best[i] = max([unknown, *((best[s][0] + p, best[s][1] - 1, s) for s, p in ends.get(i, ()))])
    out, i = [], len(run)
    while i:
        out.append(run[best[i][2] : i])
        i = best[i][2]
    return out[::-1]


def splits(runs: DataFrame, words: DataFrame, seeds: Iterable[str]) -> DataFrame:
    """Rows (run, words, seeded) of distinct runs: the words of each, and whether a seed is among them."""
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, starts: pd.Series, lengths: pd.Series, counts: pd.Series) -> pd.Series:
        none = ()
        return pd.Series([best_split(r, none if s is None else s, none if n is None else n, none if c is None else c, total) for r, s, n, c in zip(run, starts, lengths, counts)])

    size = F.length("run")
    within = F.transform(F.sequence(F.lit(0), size - 1), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(WORD_LETTERS), size - s)), lambda n: F.struct(s.alias("s"), n.alias("n"), F.substr(F.col("run"), s + 1, n).alias("w"))))
    candidates = runs.select("run", F.inline(F.flatten(within)))
    known = candidates.join(words, "w").groupBy("run").agg(F.collect_list(F.struct("s", "n", "c")).alias("known"))
    split_up = runs.join(known, "run", "left").select("run", split("run", F.col("known.s"), F.col("known.n"), F.col("known.c")).alias("words"))
    return staged(split_up.withColumn("seeded", F.arrays_overlap("words", F.array(*map(F.lit, seeds)))), "run-words")


def naive_bayes(counted: DataFrame, split: DataFrame) -> DataFrame:
    """Rows (kind, run, weight): what a run adds to a URL's score, the log odds of its words for the class blocked.

    `counted` has for each (kind, run) its occurrences in both classes. A class's words are smoothed by
    PRIOR_WORDS words in the proportions of both, so that a word that is rare everywhere speaks for neither.
    """
    words = counted.join(split, "run").select("kind", "run", "bad", "good", F.explode("words").alias("word"))
    model = staged(words.groupBy("kind", "word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "url-words")
    bad, good = model.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    share = (F.col("bad") + F.col("good")) * F.lit(PRIOR_WORDS / max(1, bad + good))
    odds = F.log((F.col("bad") + share) / F.lit(bad + PRIOR_WORDS)) - F.log((F.col("good") + share) / F.lit(good + PRIOR_WORDS))
    model = model.select("kind", "word", F.round(odds * UNIT).cast("long").alias("weight"))
    return words.select("kind", "run", "word").join(model, ["kind", "word"]).groupBy("kind", "run").agg(F.sum("weight").alias("weight"))


def judged(pages: DataFrame, texts: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame = RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "text", seeds: Iterable[str] = SEEDS) -> DataFrame:
    """Rows (id_col, host, path, rule, verdict, score), one for each row of pages.

    `texts` gives the counts of words. `labels`, rows (url, blocked), are what the model learns from;
    without them every URL is an example, blocked if one of its words is a seed. verdict is the rule's, or
    else block if the score, in log odds, is above 0; without an example that is blocked nothing else is.

    A null URL, or one without ://, has an empty host and path, as has an empty one; it is judged by the share
    of blocked examples alone. Runs of over PIECE letters are split in pieces, so URLs may be of any length.
    Repeated rows and ties get equal verdicts. Other columns are ignored, whatever their names. Null texts
    have no words. No rows: no rows.
    """
    host, path = parts(pages[url_col])
    base = staged(pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path")), "urls-of-pages")
    urls = staged(base.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    every = lambda kind, c: F.transform(runs_of(F.col(c)), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("run")))
    runs = staged(urls.select("host", "path", "n", F.inline(F.concat(every("host", "host"), every("path", "path")))), "runs-of-urls")
    words = staged(word_counts(texts, text_col, urls.select("host").distinct()), "words")
    split = splits(runs.select("run").distinct(), words, seeds)

    if labels is None:
        seeded = attached(runs, split.filter("seeded").select(F.col("run").alias("seed_run")), F.col("run") == F.col("seed_run"), "left", 4 * PIECE)
        examples = seeded.groupBy("host", "path", "n").agg(F.bool_or(F.col("seed_run").isNotNull()).alias("blocked"))
    else:
        host, path = parts(labels["url"])
        examples = labels.select(host.alias("host"), path.alias("path"), F.col("blocked").cast("boolean").alias("blocked")).groupBy("host", "path", "blocked").agg(F.count(F.lit(1)).alias("n"))
    examples = staged(examples, "url-examples")
    bad, good = examples.agg(F.coalesce(F.sum(F.when(F.col("blocked"), F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("blocked"), F.col("n"))), F.lit(0))).first()
    learnt = runs.select("host", "path", "kind", "run").join(examples.withColumnRenamed("n", "times"), ["host", "path"])
    counted = learnt.groupBy("kind", "run").agg(F.sum(F.when(F.col("blocked"), F.col("times")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("blocked"), 0).otherwise(F.col("times"))).alias("good"))
    weights = staged(naive_bayes(staged(counted, "run-counts"), split).select(F.col("kind").alias("of"), F.col("run").alias("weighed"), "weight"), "run-weights")

    prior = round(math.log((bad + PRIOR_WORDS) / (good + PRIOR_WORDS)) * UNIT)
    scores = attached(runs, weights, (F.col("kind") == F.col("of")) & (F.col("run") == F.col("weighed")), "inner", 4 * PIECE)
    scores = scores.groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    score = F.coalesce("weight", F.lit(0)) + F.lit(prior)
    verdict = F.coalesce("rule_verdict", F.when((score > 0) & F.lit(bad > 0), "block").otherwise("allow"))
    known = ruled(urls.select("host", "path"), rules).join(scores, ["host", "path"], "left")
    known = staged(known.select(F.col("host").alias("h"), F.col("path").alias("p"), "rule", verdict.alias("verdict"), (score / UNIT).alias("score")), "judged-urls")
    out = attached(base, known, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "inner", 1 << 12)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
