"""Phrase collocations by the stripes pattern.

A stripe is what follows a prefix: a counter of next words, by (lang, prefix). The
stripes of longer phrases come from those of shorter ones, length by length: a
phrase can be frequent only if its first and its last words, one less each, are.
Packs of texts (words as numbers, of bounded size) count stripes on their own; rows
of equal prefix and next word are added up elementwise, each stripe split by next
word, so that what follows a common word never meets in one place; frequent entries
go back to the packs, which then keep only the places where a longer phrase can begin.
Words are listed by each pack, longer phrases are counted by marks and spelled by one of
the packs that hold them; a pack that has another phrase of such a mark says so.

The merged stripes hold all that scores need: an entry is a phrase's count and its
prefix's extension, the first level's entries are the words' counts and their sum
the total, and the greatest entry of a stripe, with that of the mirrored stripe
(by the last words), is the most frequent phrase one word longer. A phrase lies in
a longer one of the same count only if it lies in such a one.

Defined cases: texts are lower-cased A to Z and cut at ``[.,;:!?\\x0A-\\x0D]``, words are
``[^\\x20\\x09]+``; null and empty texts have no words; a null lang is ``und``; overlapping
occurrences and repeated rows count each; texts are read whole; a phrase with less
than ``least`` occurrences is nobody's candidate; ties of cuts go to the shortest
first part, ties of rank to the greater count, then to the phrase's bytes; other
columns are ignored; empty tables give empty results. Products are decimals of 38
digits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable, scratch, small_side, written
from .shingles import _mixed

LEAST = 100
LONGEST = 5
TOP = 2_000
#: Words, with marks between pieces, of a pack.
PACK = 500_000
SALTS = 64
#: Packs of one such number may all spell a phrase that is theirs to spell.
SPELLERS = 1 << 16
#: Frequent phrases of a length that are sent to every task.
FEW = 300_000
_MARK = b"\xff"  # no byte of UTF-8
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _MARK * 10)
#: A pack: its words or its frequent phrases, how often each occurs (words only), and
#: where they begin, in order, -1 for nothing.
_STATE = "pack long, lang string, known array<string>, n array<long>, places binary"


def _frozen(places: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(3).compress(places.astype("<i4").tobytes())


def _thawed(places: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(places), "<i4")


def _row(pack: int, lang: str, known: list, n: np.ndarray, places: np.ndarray):
    import pyarrow as pa

    lists = [pa.array([known], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64()))]
    return [pa.array([pack], pa.int64()), pa.array([lang]), *lists, pa.array([_frozen(places)], pa.binary())]


class _Reader:
    """Texts of a task to packs of one lang each."""

    def __init__(self):
        self.open: dict[str, tuple[defaultdict, list]] = {}
        self.held = 0

    def add(self, lang: str, text: str) -> None:
        numbers, parts = self.open.setdefault(lang, (defaultdict(count().__next__), []))
        words = text.encode("utf-8", "surrogatepass").translate(_PLAIN).replace(_MARK, b" \xff ").split()
        words.append(_MARK)
        parts.append(np.fromiter(map(numbers.__getitem__, words), "i4", len(words)))
        self.held += len(words)

    def packs(self) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]:
        for lang, (numbers, parts) in self.open.items():
            places, words = np.concatenate(parts), list(numbers)
            # The mark between pieces is no word: its places become -1, the others move up.
            at = numbers[_MARK]
            del words[at]
            places = np.where(places == at, -1, places - (places > at))
            yield lang, [w.decode("utf-8", "replace") for w in words], np.bincount(places[places >= 0], minlength=len(words)), places
        self.open, self.held = {}, 0


def _packs(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")).where("text <> ''")

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        reader = _Reader()

        def done() -> Iterator:
            for lang, words, n, places in reader.packs():
                columns = _row(int.from_bytes(os.urandom(7)), lang, words, n, places)
                yield pa.RecordBatch.from_arrays(columns, ["pack", "lang", "known", "n", "places"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader.add(lang, text)
                if reader.held >= PACK:
                    yield from done()
        yield from done()

    return texts.mapInArrow(run, _STATE)


def _pairs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs of what follows each other, their counts, where, number of each): a phrase
    one word longer is one of these, with the word that the second adds to the first."""
    first, then = places[:-1], places[1:]
    both = (first >= 0) & (then >= 0)
    pairs, number, n = np.unique(first[both].astype("i8") << 32 | then[both], return_inverse=True, return_counts=True)
    return pairs, n, both, number


def _spelled(known: list[str], pairs: np.ndarray) -> list[str]:
    ends = [k.rpartition(" ")[2] for k in known]
    return [f"{known[p >> 32]} {ends[p & 0xFFFFFFFF]}" for p in pairs.tolist()]


def _marks(lang: str, known: list[str], pairs: np.ndarray) -> np.ndarray:
    """A number of 48 bits for each phrase, the same in every pack: it tells which
    phrases need not be spelled, so that two of one number do no harm."""
    from xxhash import xxh64_intdigest

    of_lang = xxh64_intdigest(lang)
    whole = np.fromiter((xxh64_intdigest(k) for k in known), "u8", len(known))
    last = np.fromiter((xxh64_intdigest(k.rpartition(" ")[2], of_lang) for k in known), "u8", len(known))
    return (_mixed(whole[pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + last[pairs & 0xFFFFFFFF]) >> np.uint64(16)).astype("i8")


def _stripes(packs: DataFrame, words: int, few: DataFrame | None) -> DataFrame:
    """(pack, lang, k, phrase, n): what the packs hold of phrases of so many words, or of
    those of the ``few`` marks."""
    if words == 1:
        entries = packs.select("pack", "lang", F.posexplode(F.arrays_zip("known", "n")).alias("k", "e"))
        return entries.select("pack", "lang", "k", F.col("e.known").alias("phrase"), F.col("e.n").alias("n"))

    sent = packs.sparkSession.sparkContext.broadcast(None if few is None else few.select("mark").toPandas()["mark"].to_numpy("i8"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for pack, lang, known, places in zip(*(batch.column(c) for c in ("pack", "lang", "known", "places")), strict=True):
                pairs, n, _, _ = _pairs(_thawed(places.as_py()))
                names, often = known.as_py(), sent.value
                at = np.arange(len(pairs)) if often is None else np.flatnonzero(np.isin(_marks(lang.as_py(), names, pairs), often))
                for lo in range(0, len(at), 50_000):
                    k = at[lo : lo + 50_000]
                    columns = [pa.array(np.full(len(k), pack.as_py())), pa.array([lang.as_py()] * len(k)), pa.array(k.astype("i4")), pa.array(_spelled(names, pairs[k])), pa.array(n[k])]
                    yield pa.RecordBatch.from_arrays(columns, ["pack", "lang", "k", "phrase", "n"])

    return packs.select("pack", "lang", "known", "places").mapInArrow(run, "pack long, lang string, k int, phrase string, n long")


def _marked(packs: DataFrame, least: int) -> DataFrame | None:
    """(mark, f, speller): the frequent marks of the phrases one word longer, and the least
    number of a pack that has them; None if they are many."""
    def marked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for pack, lang, known, places in zip(*(batch.column(c) for c in ("pack", "lang", "known", "places")), strict=True):
                pairs, n, _, _ = _pairs(_thawed(places.as_py()))
                marks = _marks(lang.as_py(), known.as_py(), pairs)
                speller = np.full(len(pairs), pack.as_py() % SPELLERS, "i4")
                for lo in range(0, len(pairs), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000]) for x in (marks, n, speller)], ["mark", "n", "speller"])

    of_mark = packs.select("pack", "lang", "known", "places").mapInArrow(marked, "mark long, n long, speller int").groupBy("mark").agg(F.sum("n").alias("f"), F.min("speller").alias("speller"))
    frequent = durable(of_mark.where(F.col("f") >= least))
    return frequent if frequent.limit(FEW + 1).count() <= FEW else None


def _named(packs: DataFrame, few: DataFrame) -> DataFrame | None:
    """(mark, lang, phrase, f): the phrases of the ``few`` marks, each spelled by one of its
    packs; None if two of them have one mark."""
    told = few.select("mark", "speller").toPandas().sort_values("mark")
    sent = packs.sparkSession.sparkContext.broadcast((told["mark"].to_numpy("i8"), told["speller"].to_numpy("i4")))

    def spell(batches: Iterator) -> Iterator:
        import pyarrow as pa

        often, spellers = sent.value
        for batch in batches:
            for pack, lang, known, places in zip(*(batch.column(c) for c in ("pack", "lang", "known", "places")), strict=True):
                mine = often[spellers == pack.as_py() % SPELLERS]
                if not len(mine):
                    continue
                pairs, _, _, _ = _pairs(_thawed(places.as_py()))
                names = known.as_py()
                marks = _marks(lang.as_py(), names, pairs)
                at = np.flatnonzero(np.isin(marks, mine))
                yield pa.RecordBatch.from_arrays([pa.array(marks[at]), pa.array([lang.as_py()] * len(at), pa.string()), pa.array(_spelled(names, pairs[at]), pa.string())], ["mark", "lang", "phrase"])

    spelled = packs.select("pack", "lang", "known", "places").mapInArrow(spell, "mark long, lang string, phrase string").distinct()
    named = durable(spelled.join(few.select("mark", "f"), "mark"))
    return named if named.count() == len(told) else None


def _shortened(pack: int, lang: str, known, places: bytes, words: int, keep):
    """A pack with those phrases of so many words that ``keep`` picks from their spelling
    or, if it is an array, by number; None if none is left."""
    places = _thawed(places)
    if words == 1:
        total, at, spell = len(known), places, lambda k: known.take(k).to_pylist()
    else:
        found = _pairs(places)
        pairs = found[0]
        total, at = len(pairs), _places(found)
        names = known.to_pylist()
        spell = lambda k: _spelled(names, pairs[k])
    if callable(keep):
        every = spell(np.arange(total))
        keep = np.flatnonzero(np.fromiter(map(keep, every), bool, total))
        spelled = [every[k] for k in keep.tolist()]
    else:
        keep = np.sort(keep)
        spelled = spell(keep)
    return _moved(pack, lang, spelled, total, at, keep) if len(keep) else None


def _places(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of the pair that begins at each place, -1 for none."""
    _, _, both, number = found
    at = np.full(len(both), -1, "i4")
    at[both] = number
    return at


def _moved(pack: int, lang: str, spelled: list[str], total: int, at: np.ndarray, keep: np.ndarray):
    """A pack of the phrases ``keep``, in order, of ``total`` ones that begin at ``at``."""
    moved = np.full(total + 1, -1, "i4")  # the last place is that of -1
    moved[keep] = np.arange(len(keep))
    out = moved[at]
    # Of a run without a phrase one place is enough.
    out = out[np.append(True, (out[1:] >= 0) | (out[:-1] >= 0))] if len(out) else out
    return _row(pack, lang, spelled, np.zeros(0, "i8"), out)


_NAMES = ["pack", "lang", "known", "n", "places"]


def _kept_few(packs: DataFrame, frequent: DataFrame, words: int) -> DataFrame:
    """The packs with the frequent phrases (lang, phrase), which are few, in place of the
    shorter ones, and the places where they begin."""
    often: dict[str, set] = {}
    for lang, phrase in zip(*(frequent.select("lang", "phrase").toPandas()[c] for c in ("lang", "phrase")), strict=True):
        often.setdefault(lang, set()).add(phrase)
    sent = packs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for pack, lang, known, places in zip(*(batch.column(c) for c in ("pack", "lang", "known", "places")), strict=True):
                row = _shortened(pack.as_py(), lang.as_py(), known.values, places.as_py(), words, sent.value.get(lang.as_py(), set()).__contains__)
                if row:
                    yield pa.RecordBatch.from_arrays(row, _NAMES)

    return packs.mapInArrow(run, _STATE)


def _kept_named(packs: DataFrame, named: DataFrame, words: int, last: bool) -> DataFrame:
    """The packs with the phrases (mark, lang, phrase) of so many words, which are few, in
    place of the shorter ones; none if it is the ``last`` length. A pack that has another
    phrase of such a mark says so by a row without a number."""
    told = named.select("mark", "lang", "phrase").toPandas().sort_values("mark")
    sent = packs.sparkSession.sparkContext.broadcast((told["mark"].to_numpy("i8"), told["lang"].tolist(), told["phrase"].tolist()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        often, langs, phrases = sent.value
        for batch in batches:
            for pack, lang, known, places in zip(*(batch.column(c) for c in ("pack", "lang", "known", "places")), strict=True):
                lang, names, thawed = lang.as_py(), known.as_py(), _thawed(places.as_py())
                found = _pairs(thawed)
                marks = _marks(lang, names, found[0])
                at = np.searchsorted(often, marks)
                at[at == len(often)] = 0
                keep = np.flatnonzero(often[at] == marks) if len(often) else np.zeros(0, "i8")
                spelled = _spelled(names, found[0][keep])
                if any(langs[k] != lang or phrases[k] != phrase for k, phrase in zip(at[keep].tolist(), spelled, strict=True)):
                    yield pa.RecordBatch.from_arrays(_row(None, lang, [], np.zeros(0, "i8"), np.zeros(0, "i4")), _NAMES)
                elif len(keep) and not last:
                    yield pa.RecordBatch.from_arrays(_moved(pack.as_py(), lang, spelled, len(found[0]), _places(found), keep), _NAMES)

    return packs.mapInArrow(run, _STATE)


def _kept(packs: DataFrame, told: DataFrame, words: int) -> DataFrame:
    """The same, where packs are told which of their phrases (asked, k) are frequent."""

    def run(mine, known):
        import pyarrow as pa

        row = None
        if mine.num_rows and known.num_rows:
            values = [mine.column(c)[0] for c in ("pack", "lang", "known", "places")]
            row = _shortened(values[0].as_py(), values[1].as_py(), values[2].values, values[3].as_py(), words, known.column("k").to_numpy())
        return pa.table(row or [pa.array([], t) for t in (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())], _NAMES)

    return packs.groupBy("pack").cogroup(told.groupBy("asked")).applyInArrow(run, _STATE)


def _first(phrase: Column, k: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def _integer(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``top`` phrases of 2 to
    ``longest`` words that occur ``least`` times or more; a is a phrase's count, n the
    lang's words, l and r the counts of its two parts at the cut of the lowest score
    floor(1000 * a * n / (l * r)). Phrases within a longer one of the same count go."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "packs")
    packs = written(_packs(docs, text_col, lang_col), "packs", folder)
    totals = packs.select("lang", F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    totals = durable(totals)
    levels = []
    for words in range(1, longest + 1):
        # Most phrases are rare and drop by a mark of theirs, before any is spelled; what is
        # left is spelled once for all packs. Where two phrases have one mark, each pack spells
        # what is left, and all phrases where too many marks are frequent for a broadcast.
        few = _marked(packs, least) if words > 1 else None
        named = _named(packs, few) if few is not None else None
        if named is not None:
            before, folder = folder, scratch(spark, "packs")
            left = written(_kept_named(packs, named, words, words == longest), "packs", folder)
            if left.where("pack is null").isEmpty():
                levels.append(named.select("lang", "phrase", "f").withColumn("words", F.lit(words)))
                packs = left
                discard(spark, before)
                continue
            discard(spark, folder)
            folder = before
        entries = _stripes(packs, words, few)
        merged = entries.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        levels.append(durable(merged).withColumn("words", F.lit(words)))
        if words < longest:
            # Frequent entries go to every task while they are few, else packs and entries meet by phrase.
            if levels[-1].limit(FEW + 1).count() <= FEW:
                left = _kept_few(packs, levels[-1], words)
            else:
                told = entries.join(levels[-1].select("lang", "phrase"), ["lang", "phrase"], "left_semi").select(F.col("pack").alias("asked"), "k")
                left = _kept(packs, told, words)
            before, folder = folder, scratch(spark, "packs")
            packs = written(left, "packs", folder)
            discard(spark, before)
    known = reduce(DataFrame.unionByName, levels)
    candidates = known.where("words > 1")
    # The greatest entry of a stripe and of its mirror: the prefix's and the suffix's longest count.
    rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    parts = F.array(_first(F.col("phrase"), F.col("words") - 1), rest)
    within = candidates.where("words > 2").select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(within, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("f"), F.lit(True)))
    # Both parts of every cut ask for their counts, and the cuts meet again by phrase.
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    head = _first(F.col("phrase"), F.col("cut"))
    tail = F.expr("substring(phrase, length(substring_index(phrase, ' ', cut)) + 2)")
    asked = cuts.select("lang", "phrase", "a", "cut", F.posexplode(F.array(head, tail)).alias("side", "part"))
    told = asked.join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = told.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    sides = sides.join(small_side(totals, 100_000), "lang")
    over = F.lit(1000).cast("decimal(4,0)") * _integer(F.col("a")) * _integer(F.col("n"))
    scored = sides.withColumn("score", F.call_function("div", over, _integer(F.col("l")) * _integer(F.col("r"))))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "n", "b.score", "b.l", "b.r")
    # Ranked in salts first: a lang may have any number of phrases.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
