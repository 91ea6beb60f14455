"""The pipeline's near dedup against brute force over five-word shingles."""

import random

import corpus_pipeline


def jaccard(x, y):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def groups(texts):
    """The smallest place of the group of each text."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def test_planted_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3_000)]
    line = " ".join(rng.choices(vocabulary, k=40))
    texts = []
    for n in (12, 60, 60, 300, 300, 900):
        base = rng.choices(vocabulary, k=n)
        texts.append(" ".join(base))
        for k in range(1, 8):
            # Runs of new words in the middle and at the end: similarities on both sides of 0.8.
            cut = max(1, n * k // 50)
            at = rng.randrange(n - cut)
            texts.append(" ".join(base[:at] + rng.choices(vocabulary, k=cut) + base[at + cut :]))
            texts.append(" ".join(base + rng.choices(vocabulary, k=n * k // 25)))
    texts += [line + " " + " ".join(rng.choices(vocabulary, k=n)) for n in (3, 9, 12, 20, 60, 90)]
    texts += ["a b c", "a b c", "a b d"]
    near = [s for i in range(len(texts)) for j in range(i) if 0.8 <= (s := jaccard(texts[i], texts[j])) < 1]
    assert sum(s < 0.85 for s in near) > 3 and sum(s < 0.95 for s in near) > 10
    df = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    kept = sorted(int(r.doc_id) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert kept == sorted(set(groups(texts)))


def test_rows_without_ids(spark):
    rows = [(None, f"{x} text with some words of its own {x}") for x in "abcde"] + [(None, None), ("7", ""), ("1", "same id one two three"), ("1", "same id but another text here"), ("1", "same id one two three")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    kept = sorted((r.doc_id or "", r.text or "") for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert kept == sorted([("", t) for _, t in rows[:5]] + [("7", ""), rows[7], rows[8]])
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_alike_sets_share_a_prefix():
    import numpy as np

    from filingspark.llm.setjoin import prefix

    rng, tried = np.random.default_rng(3), 0
    classes = rng.integers(0, 9, 1 << 18).astype("u1")
    for n in [*range(4, 40), 64, 150, 400, 1_500]:
        for _ in range(20):
            pool = rng.integers(0, 2**63, size=3 * n).astype("u8")
            lost = int(rng.integers(0, n // 5 + 1))
            more = int((n - lost) / 0.8 - n)  # as many new ones as 0.8 allows
            if more < 0 or lost + more == 0:
                continue
            a, b = pool[:n], np.concatenate([pool[lost:n], pool[n : n + more]])
            tried += 1
            assert len(np.intersect1d(prefix(np.unique(a), classes, 80), prefix(np.unique(b), classes, 80))), (n, lost, more)
    assert tried > 300


def test_clashing_columns_and_repeats(spark):
    text = "one two three four five six"
    rows = [(1, text, "en", "b", {"k": 1}), (1, text, "en", "a", {"k": 2}), (2, text + " seven", "de", "c", None), (3, "other words of this text here", "fr", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _key string, m map<string,int>")
    for part in (df, df.repartition(3), df.orderBy("_key")):
        kept = {r.doc_id: r for r in corpus_pipeline.near_dedup(spark, part, "").collect()}
        assert set(kept) == {1, 2, 3} and kept[1]._key == corpus_pipeline.near_dedup(spark, df, "").where("doc_id = 1").first()._key
        assert kept[3].asDict() == df.where("doc_id = 3").first().asDict()


def test_hot_keys_and_blocks_change_nothing(spark, monkeypatch):
    from filingspark.llm import jaccard as near
    from filingspark.llm import setjoin

    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for i in range(40):  # copies alike to the base, not to each other
        w = list(base)
        for at in rng.sample(range(0, 120, 8), 2):
            w[at] = f"x{i}-{at}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    df = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    for name, value in (("BLOCK", 3), ("PARTNERS", 2)):
        monkeypatch.setattr(setjoin, name, value)
    kept = sorted(int(r.doc_id) for r in near.deduplicate(df).collect())
    assert kept == sorted(set(groups(texts)))


def test_counts_of_full_classes_hide_no_pair():
    import numpy as np

    from filingspark.llm import setjoin

    # Hashes that agree in six bits: one set's counts are twice as many classes as the other's, and all full.
    a = np.arange(1_024, dtype="u8") * np.uint64(64)
    found = [a, a[:-1]]
    raw = [setjoin.counts(f).tobytes() for f in found]
    assert len(raw[0]) == 2 * len(raw[1])
    i, j, _ = setjoin.candidates(np.array([len(f) for f in found]), raw, np.array([0, 1]), 80, few=True)
    assert (i.tolist(), j.tolist()) == ([0], [1])
