import corpus_pipeline
from conftest import SF

from filingspark.llm import pii, simhash


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns, name
        kept[name] = docs.collect()
    ids = [r.doc_id for r in kept["near dedup"]]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in kept["quality rules"]}
    prints = [simhash.fingerprint(r.text) for r in kept["near dedup"]]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    again = pii.find_pii(spark.createDataFrame(kept["pii"], docs.schema)).where("size(pii_spans) > 0").count()
    assert again == 0 and len(kept["pii"]) == len(ids)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("not restored").count() == 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_near_dedup_has_no_stage_without_effect():
    import inspect

    from filingspark.llm import jaccard, setjoin

    assert not hasattr(jaccard, "of_fingerprints") and "seeds" not in inspect.signature(setjoin.linked).parameters
