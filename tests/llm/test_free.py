"""SentencePiece, SimHash, WARC, language ID, top-k and licenses against brute force."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from oracle import matches
from pyspark.sql import functions as F

from filingspark.llm import langid, licenses, queries, sentencepiece, simhash, topk, warc

DOCS = "doc_id long, text string"


def test_sentencepiece_equals_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0").collect()]
    rows += [(-1, None), (-2, ""), (-3, "  a\tb  \n😀 ﬁ́ x "), (-4, "=" * 200 + "x" * 100 + " " * 90 + "中文" * 50), (-5, "\x00  ²."), (-5, "\x00  ²."), (-6, "<unk> <s> </s>")]
    df = spark.createDataFrame(rows, DOCS).withColumn("g", F.lit(1)).withColumn("unit", F.lit("clash"))
    library = sentencepiece._model(sentencepiece.MODEL)
    got = sentencepiece.decode(sentencepiece.encode(df, restored_col="restored")).collect()
    assert len(got) == len(rows) and got[0].unit == "clash"
    for r in got:
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == library.encode(r.text) and r.decoded == r.text and r.restored
    assert sentencepiece.encode(df.limit(0)).count() == 0


def test_sentencepiece_clashing_columns_and_packs(spark, monkeypatch):
    monkeypatch.setattr(sentencepiece, "PACK_ROWS", 3)
    texts = ["one two", None, "", "two  three", " x ", "one two", "y" * 70, "▁ a ▁", "one two"]
    rows = [(i, t, "own", "kept", [1], "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string, _text string, c0 array<int>, restored string").repartition(2)
    got = {r.doc_id: r for r in sentencepiece.encode(df, restored_col="restored").collect()}
    library = sentencepiece._model(sentencepiece.MODEL)
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        assert got[i].ids == (None if t is None else library.encode(t)) and got[i]._text == "kept" and got[i].c0 == [1] and got[i].text == t
        assert got[i].restored == (t is None or "▁" not in t)
    with pytest.raises(RuntimeError):
        sentencepiece._Units(sentencepiece._coder(sentencepiece.MODEL), "merges")["lost"]


def test_viterbi_fold_is_best_path(spark):
    known, _ = sentencepiece.vocabulary()
    score = {p: s for p, _, s in known}
    units = sorted({u for t in ("the market rose sharply", "Zukeitpf ach éôç 123") for u in sentencepiece.units(t)})
    df = spark.createDataFrame([(u,) for u in units], "unit string").repartition(2, "unit")
    got = {r.unit: r.ranks for r in sentencepiece.segment(df, sentencepiece.pieces(spark), longest=16, fold="viterbi", scores=[s for _, _, s in known]).collect()}
    # Units too long for a mask, as encode folds them.
    rng = random.Random(2)
    long = ["".join(rng.choices("abceinorst", k=n)) for n in (61, 81, 200, 500)] + ["=" * 90, "é中" * 60]
    rank = {p: r for r, (p, _, _) in enumerate(known)}
    got |= {u: sentencepiece.best_path_long(u, rank, [s for _, _, s in known], 16) for u in long}
    whole = sentencepiece.encode(spark.createDataFrame([(i, u) for i, u in enumerate(long)], DOCS), fold="viterbi", restored_col="ok")
    ids = {known[r][1] for u in long for r in got[u] if r < len(known)}
    assert all(r.ok and any(i in ids for i in r.ids) for r in whole.collect())
    units += long
    for u in units:
        best = [0.0] + [None] * len(u)
        for stop in range(1, len(u) + 1):
            for start in range(max(0, stop - 16), stop):
                s = score.get(u[start:stop], -1e30 if stop - start == 1 else None)
                if s is not None and best[start] is not None and (best[stop] is None or best[start] + s > best[stop]):
                    best[stop] = best[start] + s
        assert sum(known[r][2] if r < len(known) else -1e30 for r in got[u]) == pytest.approx(best[-1])


def components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_golay_decoder():
    d = simhash.decoder()
    index = np.arange(4096, dtype="u4")
    words = np.zeros(4096, "u4")
    for bit in range(12):
        words ^= np.where(index >> bit & 1, np.uint32(simhash.GENERATOR << bit), np.uint32(0)).astype("u4")
    assert np.bitwise_count(words[1:]).min() == 7
    assert np.bitwise_count(np.arange(1 << 23, dtype="u4") ^ words[d]).max() == 3


def test_links_of_planted_fingerprints(spark):
    random.seed(11)
    fps = set()
    for _ in range(40):
        f = random.getrandbits(64)
        for k in range(7):
            g = f
            for b in random.sample(range(64), k):
                g ^= 1 << b
            fps.add(g)
            f = g if random.random() < 0.3 else f
    want = components(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for block in (4096, 3):
        roots = {r.node & (1 << 64) - 1: r.root for r in simhash.components(simhash.links(df, block=block)).collect()}
        mine = {f: roots.get(f, signed(f)) for f in fps}
        assert len({(mine[f], want[f]) for f in fps}) == len(set(want.values())) == len(set(mine.values()))


def test_near_duplicates(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "ONEÉ two"), (900, None), (None, "one two")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], DOCS + ", component_id string")
    got = simhash.near_duplicates(df).collect()
    fps = {f: None for f in (simhash.fingerprint(t) for _, t in rows)}
    want = components(list(fps))
    first = {}
    for d, t in rows:
        r = want[simhash.fingerprint(t)]
        if d is not None:
            first[r] = min(first.get(r, d), d)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got)) == sorted((d is None, d or 0, first[want[simhash.fingerprint(t)]]) for d, t in rows)
    kept = [r.doc_id for r in simhash.deduplicate(df).collect()]
    assert sorted(kept) == sorted(set(first.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0


def test_deduplicate_keeps_a_row_of_each_component(spark):
    texts = [f"{x} " + " ".join(f"{x}{k}" for k in range(40)) for x in "pqrstu"]
    rows = [(None, t) for t in texts[:4]] + [(5, texts[4]), (5, texts[5]), (5, texts[5]), (7, texts[0]), (8, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.deduplicate(df).collect()))
    assert kept == sorted([(0, t) for t in texts[1:4]] + [(7, texts[0]), (5, texts[4]), (5, texts[5])])


def test_fingerprint_by_definition():
    import xxhash

    text = "A b\tC d E"
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c d", "b c d e")]
    assert simhash.fingerprint(text) == h[0] & h[1]
    assert simhash.fingerprint("x") == xxhash.xxh64_intdigest(b"x", 42) and simhash.fingerprint(None) == 0


def test_warc_round_trip(spark):
    rows = [(3, "http://www.b.org/x#f", "same"), (1, "http://a.org:80/Y", "same"), (2, None, None), (4, "http://a.org/z\r\nEvil: 1", ""), (5, "u", "WARC/1.1\r\n\r\n" * 3), (6, "u", "é" * 50_000), (None, "n", "solo"), (7, "http://a.org/Y", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive(df).collect()
    first = {}
    for p, _, html in sorted(rows, key=lambda r: r[0] or 1e9):
        first.setdefault(html or "", p)
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "") for p, _, h in rows if p == r.page_id)
        leads = first[html] == r.page_id
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(html.encode()), digest, "response" if leads else "revisit", None if leads else first[html])
    keys = [(r.urlkey, r.ts) for r in got]
    assert keys == sorted(keys)
    assert warc.archive(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.archive(df, min_bytes=10_000_000).collect()} == {"response"}


def test_warc_repeated_and_missing_ids(spark):
    rows = [(None, "u0", "p"), (1, "u2", "p"), (1, "u1", "p"), (1, "u1", "p"), (2, "u3", "p"), (None, "n1", "q"), (None, "n1", "q"), (None, "n2", "q"), (9, "z", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive(df).collect()
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in got) == Counter([
        (None, "u0", "revisit", 1), (1, "u1", "response", None), (1, "u1", "revisit", 1), (1, "u2", "revisit", 1), (2, "u3", "revisit", 1),
        (None, "n1", "response", None), (None, "n1", "revisit", None), (None, "n2", "revisit", None), (9, "z", "response", None),
    ])


def test_warc_order_over_many_runs(spark, monkeypatch):
    """Several files a run each, ranges of more rows than a frame that leaves them."""
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 40)
    monkeypatch.setattr(warc, "OUT_ROWS", 7)
    random.seed(3)
    rows = [(i, f"http://h{random.randrange(5)}.org/{random.randrange(9)}", f"page {i % 170}") for i in range(400)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    keys = [(warc.url_key(r.url), r.ts, r.page_id) for r in got]
    assert keys == sorted(keys) and sorted(r.page_id for r in got) == list(range(400)) and len({r.run for r in got}) > 9
    assert all((r.record_type, r.refers_to) == (("response", None) if r.page_id < 170 else ("revisit", r.page_id % 170)) for r in got)
    urls = dict((p, u) for p, u, _ in rows)
    assert all(r.urlkey == warc.url_key(urls[r.page_id]) and r.ts.startswith("2020-01-01T00:0") for r in got)


def test_loser_tree():
    random.seed(4)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(((f"{random.randint(0, 9)}", "t", random.randint(0, 5), "", "", 0, "", None, f"r{j}", i) for i in range(random.randint(0, 20))), key=warc._order) for j in range(k)]
        assert list(map(warc._order, warc.merged(runs))) == sorted(map(warc._order, (x for r in runs for x in r)))


def test_language_of_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "n_chars")
    got = queries.op6_langid(spark, "/root/testdata/sf0.01").join(d, "doc_id").where("held_out and n_chars >= 200")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a >= 0.98 and 0 <= r.lo <= r.hi <= 1


def test_language_edges(spark):
    train = spark.createDataFrame([("the quick brown fox " * 20, "en"), ("der schnelle braune fuchs " * 20, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.train(train)
    assert set(model) == {"de", "en"}
    df = spark.createDataFrame([(1, None, 0.5), (2, "123 !!", 0.5), (3, "quick brown fox", 0.5), (4, "schnelle fuchs" * 9000, 0.5)], "doc_id long, text string, margin double")
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "en", "de"] and got[1].score == 0 and not got[1].accepted
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}
    assert langid.train(train.limit(0)) == {}


def test_language_sample_is_of_distinct_texts(spark):
    texts = {lang: [f"{lang} {w} text" for w in ("one", "two", "three", "four", "five", "six")] for lang in ("aa", "bb", "cc", "dd")}
    rows = [(t, lang) for lang, some in texts.items() for t in some for _ in range(50)] + [(t, lang) for lang in texts for t in [None, "12"] * 300]
    df = spark.createDataFrame(rows, "text string, lang string")
    for k in (2, 400):
        taught = langid.train(df, docs_per_lang=k)
        assert [sum(t in taught[lang].decode() for t in some) for lang, some in texts.items()] == [min(k, 6)] * 4


def test_topk_matches_sql(spark):
    matches(spark, SF, queries.op7_topk, queries.ORACLE_SQL["op7_topk"])


def test_topk_edges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=5) * (1 + i % 7)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [float("inf")] * 5), (2004, [1.0]), (None, [1.0] * 5), (2005, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit("clash"))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, seeds=16, bands=4, block_rows=20, query_rows=3)
    vectors = {i: np.floor(256 * np.array(v + [0.0] * (5 - len(v)), "f4").astype("f8")) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in vectors if i % 50 == 0):
        best = sorted(((-int(vectors[q] @ c), i) for i, c in vectors.items() if i != q))[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = topk.top_k(df.where("vec_id in (50, 51)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(50, 1, 51)]


def test_topk_of_huge_components(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2] and got[0].score == 2**63 - 1


def test_alignment_covers_edits():
    ready = licenses.prepared()
    mit = licenses.TEMPLATES["MIT"][1]
    noisy = "intro words " + mit.replace("software", "softwares").replace("copies", "copies indeed", 1) + " trailing words"
    ((name, coverage, start, end),) = licenses.scan(noisy, ready)
    assert name == "MIT" and coverage > 0.9 and noisy[start:].startswith("Permission") and noisy[:end].endswith("SOFTWARE")
    assert licenses.scan("the license of any person is under this and that permission", ready) == []
    a = licenses.align(list("abcxdef"), list("abcydef"))
    assert a == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]


def test_licenses(spark):
    texts = [None, "", "x " * 20000 + "Released under the MIT License.", "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", "RELEASED UNDER THE MIT LICENSE", "plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("places", F.lit(2))
    got = {r.doc_id: r for r in licenses.find_licenses(df).collect()}
    assert [got[i].license for i in range(6)] == [None, None, "MIT", "CC-BY-NC-4.0", "MIT", None] and got[3].n_licenses == 2
    assert got[0].coverage == 0.0 and got[0].license_spans == "" and licenses.find_licenses(df.limit(0)).count() == 0


def test_adjacent_licenses():
    ready = licenses.prepared()
    for line, name in ((licenses.TEMPLATES["Apache-2.0"][0], "Apache-2.0"), (licenses.TEMPLATES["MIT"][1], "MIT"), (licenses.TEMPLATES["ISC"][0], "ISC")):
        for between in ("\n", "\nx ", "\nfile a b\n"):
            text = "x y " + between.join([line] * 7) + " z"
            spans = licenses.scan(text, ready)
            assert [(n, c, text[a:b] in (line, line.rstrip("."))) for n, c, a, b in spans] == [(name, 1.0, True)] * 7, (name, between)


def test_licenses_without_their_rarest_words():
    ready = licenses.prepared()
    name, words, *_ = next(r for r in ready if r[0] == "MIT" and len(r[1]) > 50)
    spread = Counter(w for _, ws, *_ in ready for w in set(ws))
    lost = set(sorted(set(words), key=lambda w: (spread[w], -len(w), w))[:3])
    ((found, coverage, _, _),) = licenses.scan(" ".join("other" if w in lost else w for w in words), ready)
    assert found == name and coverage >= 0.8


def test_licenses_and_their_neighbours():
    ready = licenses.prepared()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            found = licenses.scan(f"Words before. {t.replace('*', '')} And words behind.", ready)
            assert [(n, c) for n, c, _, _ in found] == [(name, 1.0)], (name, t[:40], found)
    for other in ("Licensed under CC BY 5.0", "licensed under the GNU Lesser Public License", "Licensed under the Apache License, Version 3.0", "Released under the WTF License"):
        assert licenses.scan(other, ready) == [], other
    bsd4 = licenses.TEMPLATES["BSD-3-Clause"][2].replace("*", "")
    assert [n for n, *_ in licenses.scan(bsd4.replace("Neither", "No part of"), ready)] == ["BSD-2-Clause"]


def test_alignment_against_brute_force():
    """Words that occur once in both align along a longest increasing subsequence."""
    rng = random.Random(6)
    for n in (1, 5, 30, 200):
        for _ in range(10):
            a = [f"w{i}" for i in range(n)]
            b = rng.sample(a, n)
            at = {w: i for i, w in enumerate(b)}
            best = [1] * n
            for i in range(n):
                best[i] = 1 + max((best[j] for j in range(i) if at[a[j]] < at[a[i]]), default=0)
            found = licenses._longest_increasing([(i, at[w]) for i, w in enumerate(a)])
            assert len(found) == max(best) and all(x < y for x, y in zip(found, found[1:]))
            mixed = [w for w in a if rng.random() < 0.7] + ["z"] * rng.randrange(3)
            pairs = licenses.align(mixed, a)
            assert all(mixed[x] == a[y] for x, y in pairs) and len(pairs) == len([w for w in mixed if w != "z"])
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_licenses_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "x", 5, "y"), (1, "Released under the MIT License.", "x", 5, "y")], "doc_id int, text string, license string, n_licenses int, other string")
    got = licenses.find_licenses(df).collect()
    assert [(r.license, r.n_licenses, r.other) for r in got] == [("MIT", 1, "y")] * 2


def test_predictions_against_recomputed_sizes(spark):
    import zstandard as zstd

    rng = random.Random(4)
    vocab = {"aa": ["der", "und", "ist", "nicht", "haus"], "bb": ["the", "and", "is", "not", "house"], "cc": ["le", "et", "est", "pas", "maison"]}
    model = {k: (" ".join(rng.choices(v, k=200))).encode() for k, v in vocab.items()}
    texts = [" ".join(rng.choices(v, k=n)) for v in vocab.values() for n in (1, 5, 80, 900)] + ["und the le", "und the le", "", None, "12 34", "Ü" * 7_000]
    df = spark.createDataFrame([(i, t, "own", 9) for i, t in enumerate(texts)], "doc_id int, text string, score string, other int")
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    for i, t in enumerate(texts):
        data, sizes = langid.letters(t).encode(), []
        for lang, content in sorted(model.items()):
            pack = zstd.ZstdCompressor(level=langid.LEVEL, dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(pack.compress(data[k : k + langid.CHUNK_BYTES])) for k in range(0, len(data), langid.CHUNK_BYTES)), lang))
        sizes.sort()
        want = (sizes[0][1], 1 - sizes[0][0] / sizes[1][0]) if data else ("und", 0.0)
        assert (got[i].lang_pred, got[i].score) == (want[0], pytest.approx(want[1])) and got[i].other == 9, i
    assert langid.predict(df.limit(0), model).count() == 0


def test_large_ids_beside_nulls(spark):
    big = 2**60 + 1
    rows = [(big, "the report of the year and the market", "c"), (None, None, None), (None, "und der Bericht des Jahres", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, scanned string").withColumn("d", F.lit("1.50").cast("decimal(9,2)")).withColumn("m", F.create_map(F.lit("k"), "doc_id"))
    known = langid.train(spark.createDataFrame([("the market and the year", "en"), ("der Bericht und das Jahr", "de")], "text string, lang string"))
    for out in (langid.predict(df.withColumn("judged", F.lit(1)), known), licenses.find_licenses(df)):
        got = {r.doc_id for r in out.collect()}
        assert got == {big, None} and out.count() == 3 and "scanned" in out.columns
        assert {str(r.d) for r in out.collect()} == {"1.50"} and {r.m["k"] for r in out.collect()} == {big, None}
    pages = spark.createDataFrame([(big, "http://a.b/x", "one"), (big + 1, "http://a.b/y", "one"), (None, "http://a.b/z", None)], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    assert (big, "response", None) in got and (big + 1, "revisit", big) in got and None in {p for p, _, _ in got}
