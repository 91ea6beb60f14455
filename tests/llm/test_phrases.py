"""Collocations against plain counters and the oracle."""

import random
import re
from collections import Counter

import pytest
from conftest import SF
from oracle import matches

from filingspark.llm import phrases as module
from filingspark.llm import queries
from filingspark.llm.phrases import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    known = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in known.items():
        longer = [b for (x, q), b in known.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in sorted({r[0] for r in out}):
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_counters(spark, monkeypatch, seed):
    monkeypatch.setattr(module, "PACK", 120)
    monkeypatch.setattr(module, "FEW", 300_000 if seed else 3)
    rng = random.Random(seed)
    words = ["a", "B", "the", "é", "x\x00", "zü", "中", "b"]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\r\n", ",", " "]) for _ in range(rng.randrange(25)))
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    rows += [(None, "en"), ("", None), (" \t ", "fr"), ("...", "fr"), ("the a b the a b\xa0the " * 30, "en")] + [("one two three four five six", "de")] * 5
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, n int").repartition(3)
    got = sorted(tuple(r) for r in phrases(df, least=4, longest=5, top=40).collect())
    assert got == plain(rows, 4, 5, 40) and len(got) > 40


def test_ties_empty_and_large_numbers(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases(df).count() == 0
    tie = spark.createDataFrame([("b c. a b. c d", "x")] * 3, "text string, lang string")
    assert [(r.rank, r.phrase) for r in phrases(tie, least=3).orderBy("rank").collect()] == [(r[1], r[2]) for r in plain([("b c. a b. c d", "x")] * 3, 3, 5, 9)]
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(10**13, 10**14, 10**13, 10**13 + 1)], "a long, n long, l long, r long")
    whole = module._integer
    over = F.lit(1000).cast("decimal(4,0)") * whole(F.col("a")) * whole(F.col("n"))
    assert big.select(F.call_function("div", over, whole(F.col("l")) * whole(F.col("r")))).first()[0] == 1000 * 10**27 // (10**13 * (10**13 + 1))


def test_query_equals_oracle(spark):
    matches(spark, SF, queries.op13_phrases, queries.ORACLE_SQL["op13_phrases"])


def test_frequent_phrases_are_spelled_once(spark, monkeypatch):
    monkeypatch.setattr(module, "PACK", 60)
    rows = [("one two three four. five six", "en")] * 120 + [("one two", "fr")] * 90 + [("one two", "es")] * 80
    packs = module.written(module._packs(spark.createDataFrame(rows, "text string, lang string").repartition(4), "text", "lang"), "packs")
    assert packs.count() > 8
    named = module._named(packs, module._marked(packs, 60))
    # Rows that packs spell: as many as phrases, not one for each pack that holds them.
    assert sorted((r.lang, r.phrase, r.f) for r in named.collect()) == [("en", "five six", 120), ("en", "one two", 120), ("en", "three four", 120), ("en", "two three", 120), ("es", "one two", 80), ("fr", "one two", 90)]
    assert module._kept_named(packs, named, 2, True).isEmpty()


@pytest.mark.parametrize("bits", [2, 7])
def test_phrases_of_one_mark(spark, monkeypatch, bits):
    marks = module._marks
    monkeypatch.setattr(module, "_marks", lambda *a: marks(*a) % (1 << bits))
    monkeypatch.setattr(module, "PACK", 50)
    rng = random.Random(bits)
    rows = [(" ".join(rng.choice("a b c d e".split()) for _ in range(12)), rng.choice(["en", "de"])) for _ in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in phrases(df, least=5, longest=4, top=40).collect()) == plain(rows, 5, 4, 40)
