"""Context packs against a replay in Python, and the oracle."""

from conftest import SF
from oracle import matches

from filingspark.operators import context
from filingspark.plans import documents

SOURCES = "doc_id string, n int, source_type string, title string, text string"


def is_wide(c):
    return "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "豈" <= c <= "﫿"


def tokens(t):
    wide = sum(map(is_wide, t))
    return int(wide / 1.5 + (len(t) - wide) / 4)


def replay(texts, budget):
    used, out = 0, []
    for t in texts:
        if not t or used >= budget:
            continue
        left, cut = budget - used, len(t)
        if tokens(t) > left:
            cut = int(len(t) * (left / tokens(t)) * 0.95)
            while tokens(t[:cut]) > left and cut > 0:
                cut = int(cut * 0.9)
        if tokens(t[:cut]) > 0:
            out.append((t[:cut], tokens(t[:cut])))
            used += tokens(t[:cut])
    return out


def test_pack_equals_replay(spark):
    from pyspark.sql import functions as F

    texts = {"a": ["abcd" * 40] * 5, "b": ["中文 text " * 30, "x", "资产负债表" * 40 + "tail" * 50, "tail" * 90, "more" * 20], "c": ["😀😀 é" * 50, "", "资产" * 9], "d": ["ab"]}
    rows = [(d, i, "t", str(i), t) for d, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, SOURCES).select("doc_id", F.struct(F.lit(0).alias("part"), F.col("n").cast("long").alias("place")).alias("at"), "source_type", "title", "text").where("text <> ''").repartition(3)
    for budget in (7, 60, 100, 10_000):
        got = {}
        for r in context.pack(df, budget).orderBy("doc_id", "source_ord").collect():
            got.setdefault(r.doc_id, []).append((r.text, r.tokens))
        assert got == {d: want for d, ts in texts.items() if (want := replay(ts, budget))}


def test_caps_and_distinct_hits(spark):
    one = lambda sql: spark.sql(sql)
    validation, snapshot = one("select 'a' as doc_id, '{}' as text"), one("select 'a' as doc_id, ' ' as text")
    notes = one("select 'a' as doc_id, id as note_ord, 'guidance' as note_type, if(id = 2, ' ', concat('n', id)) as summary from range(20)")
    signals = one("select 'a' as doc_id, id as sig_ord, 'c' as category, 't' as title, 'high' as severity, 'd' as description, map('k', cast(id as string)) as metrics from range(20)")
    hits = one("select 'a' as doc_id, cast(id % 3 as int) as query_id, cast(id as int) as rank, if(id = 4, 'table', 'chunk') as source_type, if(id = 5, null, concat('s', id % 2)) as source_id, cast(null as string) as title, concat('h', id) as text from range(7)")
    tables = one("select 'a' as doc_id, cast(id as int) as table_ord, concat('t', id) as table_id, if(id = 0, '', 'T') as title, concat('m', id) as raw_markdown from range(9)")
    got = [(r.source_type, r.title, r.text) for r in context.pack(context.sources(validation, snapshot, notes, signals, hits, tables), 10_000).orderBy("source_ord").collect()]
    assert got == [] or all(len(x[2]) >= 4 for x in got)  # texts of under a token are never taken
    rows = context.sources(validation, snapshot, notes, signals, hits, tables).orderBy("at").collect()
    kinds = [(r.source_type, r.title, r.text) for r in rows]
    assert kinds[0] == ("validation", "Validation summary", "{}") and [t for k, _, t in kinds if k == "note"] == [f"n{i}" for i in range(8) if i != 2]
    assert [t for k, _, t in kinds if k == "risk_signal"] == [f'high: d\nMetrics: {{"k":"{i}"}}' for i in range(12)]
    assert [(k, x, t) for k, x, t in kinds if t.startswith("h") and k != "risk_signal"] == [("page_text", "page_text", "h0"), ("page_text", "page_text", "h3"), ("table", "table", "h4"), ("page_text", "page_text", "h5")]
    assert [(x, t) for _, x, t in kinds if t.startswith("m")] == [("t0", "m0"), ("T", "m1"), ("T", "m2"), ("T", "m3")]


def test_query(spark):
    matches(spark, SF, documents.QUERIES["context_packs"], documents.ORACLE_SQL["context_packs"])
