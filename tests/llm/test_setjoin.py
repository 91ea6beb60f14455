"""Signature trees against brute force over all pairs of sets."""

import random
import re

import numpy as np
import pytest
from conftest import SF

from filingspark.llm import queries, setjoin
from filingspark.llm.setjoin import jaccard_components

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain(rows, k=4, share=85):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, **kw).collect()), key=repr)


def corpus(seed, n=130):
    """Texts with copies that change a few words, shared passages and short ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    rows = []
    for _ in range(n):
        kind = rng.random()
        if rows and kind < 0.55:
            w = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        elif kind < 0.7:
            text = " ".join(rng.choices(words, k=rng.randrange(20))) + " " + passage
        else:
            text = " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 4, 5, 40, 90, 150])))
        rows.append([0, text])
    rows += [[0, None], [0, ""], [0, " \t"], [0, "One Two"], [0, "one two"], [0, "one  two"], [0, "one two"]]
    ids = rng.sample(range(2**60, 2**60 + 10 * len(rows)), len(rows))
    rows = [(i if rng.random() < 0.95 else None, t) for i, (_, t) in zip(ids, rows, strict=True)]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(setjoin, "BLOCK", 6 if seed else 2048)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n int, s string").repartition(3)
    want = plain(rows)
    assert got(df) == want
    assert len({c for _, n, c in want if n}) < len({t for _, t in rows})


def test_hot_group_and_other_parameters(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 32)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):  # copies of one text, many of them less alike than the least share
        w = list(base)
        for _ in range(rng.choice([0, 1, 3, 4])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, DOCS)
    assert got(df) == plain(rows)
    assert got(df, shingle=5, share=80) == plain(rows, 5, 80)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(200):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.6 else None
        found = rng.integers(0, 2**63, rng.integers(3, 300)).astype("u8") if base is None else np.array(base, "u8")
        swap = rng.integers(0, 1 + len(found) // 9) if base is not None else 0
        found[:swap] = rng.integers(0, 2**63, swap).astype("u8")
        sets.append(np.unique(found).tolist())
    arrays = [np.array(s, "u8") for s in sets]
    ids, n = np.arange(len(sets)), np.array([len(s) for s in sets])
    raw = [setjoin.bitmap(a).tobytes() for a in arrays]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j]))}
    i, j, score = setjoin.candidates(n, raw, ids, 85)
    every = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert alike <= every and len(every) == len(i) < 3000
    few = {(x, y) for k in range(0, len(sets), 8) for x, y, _ in setjoin._of_few(n[k : k + 8].tolist(), raw[k : k + 8], ids[k : k + 8].tolist(), 85)}
    assert few == {(x % 8, y % 8) for x, y in every if x // 8 == y // 8}
    chosen, label = setjoin.spanning(i, j, score, ids)
    forest = setjoin.Forest()
    for k in chosen.tolist():
        assert forest.root(int(i[k])) != forest.root(int(j[k]))
        forest.link(int(i[k]), int(j[k]))
    assert all(forest.root(a) == forest.root(b) and label[a] == label[b] for a, b in every)


def test_empty_and_blank(spark):
    assert got(spark.createDataFrame([], DOCS)) == []
    assert got(spark.createDataFrame([(1, None), (2, ""), (None, " ")], DOCS)) == plain([(1, None), (2, ""), (None, " ")])


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op12_setjoin(spark, SF).collect()), key=repr) == plain(rows)


def test_counts_lose_no_pair():
    rng = np.random.default_rng(7)
    sets = []
    for k in range(160):
        base = np.array(sets[rng.integers(len(sets))], "u8") if sets and k % 2 else rng.integers(0, 2**63, rng.integers(1, 900)).astype("u8")
        swap = rng.integers(0, 1 + len(base) // 9)
        base[:swap] = rng.integers(0, 2**63, swap).astype("u8")
        sets.append(np.unique(base).tolist())
    # Counts that are full hide what is beyond 255; the second has a few others besides.
    sets += [(np.arange(4_000, dtype="u8") << np.uint64(20)).tolist(), (np.arange(4_100, dtype="u8") << np.uint64(20)).tolist()]
    arrays, n = [np.array(s, "u8") for s in sets], [len(s) for s in sets]
    told = [setjoin.counts(a).tobytes() for a in arrays]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j]))}
    found = set(zip(*(x.tolist() for x in setjoin.candidates(np.array(n), told, np.arange(len(sets)), 85, few=True)[:2]), strict=True))
    assert alike <= found and len(found) < 4 * len(alike) and len(alike) > 40
    assert sum(map(len, told)) * 4 <= sum(setjoin.bitmap(a).nbytes for a in arrays)


@pytest.mark.parametrize("links", [3, 1 << 17])
def test_links_are_joined_in_few_tasks(spark, monkeypatch, links):
    monkeypatch.setattr(setjoin, "LINKS", links)
    rng = random.Random(links)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    df = lambda rows: spark.createDataFrame(rows, "a long, b long").repartition(5)
    roots = setjoin._joined(df(edges[20:]), setjoin._joined(df(edges[:20]), None))
    assert roots.rdd.getNumPartitions() == 1 or links == 3
    want = list(range(60))
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {r.node: r.root for r in roots.collect()} == {k: w for k, w in enumerate(want) if k != w}
