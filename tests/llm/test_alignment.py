"""Cross-tokenizer alignment against plain loops over the tokens of both libraries."""

import hashlib
import random
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from filingspark.llm import alignment, queries

DOCS = "doc_id long, text string"


def spelled(text):
    """Tokens of both sides as (id, start, end), or none."""
    (code_a, bytes_a), (code_b, bytes_b) = alignment._coder_a(alignment.MODEL_A), alignment._coder_b(alignment.MODEL_B)
    if not text:
        return [], []
    whole, out = (" " + text).encode(), []
    for ids, table in ((slow(text), bytes_a), (code_b([text])[0], bytes_b)):
        at, tokens = 0, []
        for k in ids:
            tokens.append((k, at, at + len(table[k])))
            at += len(table[k])
        if b"".join(table[k] for k in ids) != whole:
            return [], []
        out.append(tokens)
    return tuple(out)


def slow(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(alignment.MODEL_A)
    t.encode_special_tokens = True
    return t.encode(" " + text, add_special_tokens=False).ids


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    coded = [spelled(t) for t in texts]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in coded]
    counts = Counter(p for doc in links for p in doc)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for (a, b), doc in zip(coded, links, strict=True):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        inside = lambda side, lo, hi: ",".join(str(t[0]) for t in side if lo <= t[1] < hi)
        groups = ";".join(f"{inside(a, lo, hi)}|{inside(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        out.append((len(a), len(b), len(cuts), len(doc), sum(counts[p] == most[p[1]] for p in doc), sum(counts[p] for p in doc), groups))
    return out


TEXTS = [None, "", " ", "a", "  a\tb  \n😀 ﬁ́ x ", "=" * 90 + "x" * 50 + " " * 40 + "中文" * 20, "\x00  ²é.", "<|endoftext|> <unk> <s> </s>", "one▁two", "one two", "one two", "Zukeitpf teach ch, iepf den.\r\nTeer"]


def test_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 60)
    monkeypatch.setattr(alignment, "BATCH", 20)
    rows = [(2**60 + i if i % 3 else None, t, i, "own", {"k": i}, None if i % 2 else i, "old") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, DOCS + ", i int, batch string, m map<string,int>, c long, n_best string")
    got = sorted(alignment.count_links(alignment.align(df)).collect(), key=lambda r: r.i)
    assert len(got) == len(rows)
    for r, row, want in zip(got, rows, plain(TEXTS), strict=True):
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == want
        assert (r.doc_id, r.text, r.batch, r.m, r.c) == (row[0], row[1], "own", {"k": row[2]}, row[5])


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_alignment(spark, SF).collect()}
    assert len(got) == len(docs)
    short = [d for d in docs if len(d.text or "") < 3000]
    every = {d.doc_id: w for d, w in zip(docs, plain_counts(docs), strict=True)}
    for d in short:
        r = got[d.doc_id]
        assert r.asDict() == every[d.doc_id] | {"doc_id": d.doc_id}


def plain_counts(docs):
    """As ``plain``, with links found by walking both sides, for longer texts."""
    coded = [spelled(d.text) for d in docs]
    found = []
    for a, b in coded:
        i = j = 0
        links = []
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            i, j = i + (a[i][2] <= b[j][2]), j + (b[j][2] <= a[i][2])
        found.append(links)
    counts = Counter(p for doc in found for p in doc)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for (a, b), doc in zip(coded, found, strict=True):
        ends_b = {y[2] for y in b}
        cuts = [x[2] for x in a if x[2] in ends_b]
        groups, i, j = [], 0, 0
        for hi in cuts:
            mine, other = [], []
            while i < len(a) and a[i][2] <= hi:
                mine.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= hi:
                other.append(str(b[j][0]))
                j += 1
            groups.append(",".join(mine) + "|" + ",".join(other))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield {"n_a": len(a), "n_b": len(b), "n_groups": len(cuts), "n_links": len(doc), "n_best": sum(counts[p] == most[p[1]] for p in doc), "count_sum": sum(counts[p] for p in doc), "groups_sha256": digest}


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert alignment.count_links(alignment.align(df)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], DOCS)
    assert [(r.n_a, r.n_links, r.n_best, r.count_sum, r.groups) for r in alignment.count_links(alignment.align(blank)).collect()] == [(0, 0, 0, 0, "")] * 2


def test_fast_coder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(alignment.MODEL_A)
    t.encode_special_tokens = True
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x250)]
    texts = [f"{c} {c}{c}a {c}'s1{c}" for c in letters] + ["".join(rng.choices(letters + [" ", "\n", "'s", "the"] * 40, k=80)) for _ in range(400)]
    texts += ["x" * 5000, " " * 5000, "ñ" * 2100 + "中文 ٣ ꙮ"]
    assert alignment._coder_a(alignment.MODEL_A)[0](texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(3))
def test_terminals_are_common_ends(seed):
    import numpy as np

    rng = random.Random(seed)
    cut = lambda p: np.array([k for k in range(1, 300) if rng.random() < p] + [300])
    a, b = cut(0.3), cut(0.4)
    last, common = alignment.terminals(a, b), sorted(set(a) & set(b))
    ends = [*a, *b]
    for k, e in enumerate(ends):
        assert ends[last[k]] == next(c for c in common if c >= e) and last[k] >= len(a)
    assert len(alignment.terminals(a[:0], b[:0])) == 0


def test_extra_types(spark):
    df = spark.createDataFrame([(None, "one two")], DOCS).withColumn("t", F.current_timestamp()).withColumn("d", F.lit("1.50").cast("decimal(9,2)")).withColumn("links", F.lit(1))
    r = alignment.count_links(alignment.align(df)).select("doc_id", "t", "d", "n_links").first()
    assert r.doc_id is None and str(r.d) == "1.50" and r.n_links == 2
