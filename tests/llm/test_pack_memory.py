"""What a pack of SentencePiece's takes of a Python worker."""

from pathlib import Path

import psutil
from pyspark.sql import functions as F

from filingspark.llm import sentencepiece


def _most_mb() -> dict[int, int]:
    """The most memory that each Python worker below this process has had."""
    found = {}
    for p in psutil.Process().children(recursive=True):
        try:
            if "pyspark.daemon" in " ".join(p.cmdline()):
                found[p.pid] = next(int(x.split()[1]) >> 10 for x in Path(f"/proc/{p.pid}/status").read_text().splitlines() if x.startswith("VmHWM"))
        except (psutil.Error, OSError):
            pass
    return found


def test_a_full_pack_is_not_held_many_times_over(spark):
    some = F.transform(F.sequence(F.lit(1), F.lit(1300)), lambda k: F.concat(F.lit("w"), F.chr(F.lit(97).cast("long") + (k * 7 + F.col("id")) % 26), F.lit("1 ")))
    docs = spark.range(0, 6_000, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(some, "").alias("text"))
    before = _most_mb()
    coded = sentencepiece.encode(docs, restored_col="restored")
    got = coded.agg(F.count("*"), F.sum(F.length("text")), F.sum(F.size("ids")), F.min("restored")).first()
    assert got[:2] == (6_000, 6_000 * 1300 * 4) and got[3]
    library = sentencepiece._model(sentencepiece.MODEL)
    assert got[2] == sum(n * len(library.encode(t)) for t, n in ((r.text, r.n) for r in docs.groupBy("text").agg(F.count("*").alias("n")).collect()))
    # 31 MB of texts; libraries and tables take some 150 MB of a worker, mapped files included.
    assert max(mb for pid, mb in _most_mb().items() if mb > before.get(pid, 0)) < 450
