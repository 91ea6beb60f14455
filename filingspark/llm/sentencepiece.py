"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece crosses (spaces with a run of letters, or
with a run of other characters). Each distinct unit is segmented once: its
substrings up to the longest piece are exploded, equi-joined to the piece table
(whose size the vocabulary fixes), the matches are grouped by unit as the edges
of its lattice, and Spark's higher-order ``aggregate`` folds them to pieces:

* ``viterbi``: the path of the greatest sum of scores, for unigram models, whose
  scores are log-probabilities;
* ``merges``: the edge of the greatest score that joins two neighbouring symbols,
  leftmost first, until there is none, for BPE models, whose scores are merge
  ranks: sums of ranks would prefer many short pieces to what the model means.

Characters without a piece become byte pieces. Texts travel in compressed packs
of bounded size; each pack asks for its distinct units and gets their pieces
back, so that neither tokens nor the dictionary, both growing with the corpus,
meet in one place. Units of more than ``LONGEST_UNIT`` characters (runs without a
space mostly) are folded where they occur, by the same rules: a mask of ends must
fit a long, and arrays grow too slowly for them.

The dealt method is the Viterbi fold. The given model is a BPE model, for which
it finds the best path of ranks, not the model's pieces; so ``merges`` is the
default, a departure that the README states.

Defined cases: null text has no ids (null array, decodes to null); empty text
has none; a space mark in a text decodes to a space, as it does in the library;
repeated rows get a row each; other columns are kept, those named like a result
(``ids``, the restored column) are replaced by it; an empty table gives an empty
result; texts and units may be of any length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import let, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PACK_ROWS = 20_000
PACK_BYTES = 1 << 25
PACK_LEVEL = 6
#: Rows of a column, and bytes of texts, that are Python objects at once.
STEP_ROWS = 256
STEP_BYTES = 1 << 21
#: Units up to this length go through the lattice; a mask of ends fits a long.
LONGEST_UNIT = 60
UNKNOWN = (1 << 31) - 1
#: Beside a character's code point, a rank that stands for the character.
SINGLE = 1 << 30
UNKNOWN_SCORE = -1e30
_BITS = 6
_MASK = (1 << _BITS) - 1
_MARKS = frozenset(".,;:!?\"')\n-")
_UNITS = rf"{SPACE}*[\p{{L}}\p{{M}}]+|{SPACE}*[^\p{{L}}\p{{M}}{SPACE}]+|{SPACE}+"


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def vocabulary(path: str = MODEL) -> tuple[list[tuple[str, int, float]], int]:
    """(piece, id, score) of the pieces that match text, best score first, and the
    id of byte 0."""
    m = _model(path)
    plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
    plain.sort(key=lambda i: (-m.get_score(i), i))
    return [(m.id_to_piece(i), i, m.get_score(i)) for i in plain], m.piece_to_id("<0x00>")


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(_UNITS).findall


def units(text: str) -> list[str]:
    """The units of a text, after the model's normalisation: a space in front,
    spaces as the space mark, nothing else changed."""
    return _splitter()(SPACE + text.replace(" ", SPACE)) if text else []


def check_units(path: str = MODEL) -> None:
    """Fails for a vocabulary with pieces that units would cut."""
    crossing = [p for p, _, _ in vocabulary(path)[0] if len(_splitter()(p)) != 1]
    if crossing:
        raise ValueError(f"pieces cross units: {crossing[:5]}")


def pieces(spark: SparkSession, path: str = MODEL) -> DataFrame:
    """The piece table: (piece, rank by score)."""
    rows = pd.DataFrame([(p, r) for r, (p, _, _) in enumerate(vocabulary(path)[0])], columns=["piece", "rank"])
    return spark.createDataFrame(rows, "piece string, rank int")


def _field(edge: Column, shift: int) -> Column:
    return F.call_function("shiftright", edge, F.lit(shift)).bitwiseAND(F.lit(_MASK)).cast("int")


def _start(edge: Column) -> Column:
    return _field(edge, _BITS)


def _stop(edge: Column) -> Column:
    return _field(edge, 0)


def _rank(edge: Column) -> Column:
    return F.call_function("shiftright", edge, F.lit(2 * _BITS))


def _ones(below: Column) -> Column:
    """A mask of the bits under ``below``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), below) - F.lit(1)


def _viterbi(edges: Column, n: Column, scores: Column) -> Column:
    """Edges of the path with the greatest sum of scores (by rank)."""
    by_stop = F.sort_array(F.transform(edges, lambda e: F.struct(_stop(e).alias("stop"), _start(e).alias("start"), e.alias("e"))))
    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("path")))

    def step(best, e):
        start, at = F.get(best, e["start"]), F.size(best) - 1
        worth = F.coalesce(F.get(scores, _rank(e["e"]).cast("int")), F.lit(UNKNOWN_SCORE))
        reached = F.struct((start["score"] + worth).alias("score"), F.concat(start["path"], F.array(e["e"])).alias("path"))
        better = F.when((e["stop"] > at) | (reached["score"] > F.get(best, at)["score"]), reached).otherwise(F.get(best, at))
        return F.concat(F.slice(best, 1, F.least(e["stop"], F.size(best))), F.array(better))

    return F.aggregate(by_stop, zero, step, lambda best: F.get(best, n)["path"])


def _merges(edges: Column, unit: Column, n: Column) -> Column:
    """Symbols (start << 32 | rank) left when the best edge over two neighbouring
    ones is taken until there is none, from edges of two characters or more; single
    characters stand as ``SINGLE`` and their code point. A bit mask holds the
    symbols' ends; edges sort best first."""

    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    between = lambda e: bit(_stop(e)) - bit(_start(e) + 1)  # the mask of the ends inside an edge
    ends = lambda e: bit(_stop(e)).bitwiseOR(bit(_start(e)))

    def merged(ranked):
        zero = F.struct(_ones(n + 1).alias("mask"), ranked.alias("left"))

        def step(acc, _):
            # One end lies inside: two neighbouring symbols. The best such edge comes first.
            best = F.get(F.filter(acc["left"], lambda e: F.bit_count(acc["mask"].bitwiseAND(e["inner"])) == 1), F.lit(0))["inner"]

            def after(mask):  # edges stay while both ends stand and some lie inside
                able = lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"]) & (mask.bitwiseAND(e["inner"]) != 0)
                return F.struct(mask.alias("mask"), F.filter(acc["left"], able).alias("left"))

            taken = let(F.coalesce(best, F.lit(0).cast("long")), lambda inner: F.when(inner == 0, F.struct(acc["mask"].alias("mask"), F.slice(acc["left"], 1, 0).alias("left"))).otherwise(let(acc["mask"] - acc["mask"].bitwiseAND(inner), after)))
            return F.when(F.size(acc["left"]) == 0, acc).otherwise(taken)

        return F.aggregate(F.sequence(F.lit(2), n), zero, step, lambda acc: acc["mask"])

    def chosen(r):
        def symbols(mask):
            stands = lambda x: (mask.bitwiseAND(x["inner"]) == 0) & (mask.bitwiseAND(x["ends"]) == x["ends"])
            alone = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(3)) == 3)
            code = lambda i: F.ascii(F.substring(unit, i + 1, F.lit(1))).cast("long") + SINGLE
            return F.concat(F.transform(F.filter(r, stands), lambda x: _symbol(x["e"])), F.transform(alone, lambda i: i.cast("long") * (1 << 32) + code(i)))

        return let(F.when(F.size(r) == 0, _ones(n + 1)).otherwise(merged(r)), symbols)

    return let(F.transform(F.sort_array(edges), lambda e: F.struct(between(e).alias("inner"), ends(e).alias("ends"), e.alias("e"))), chosen)


def _symbol(edge: Column) -> Column:
    return _start(edge).cast("long") * (1 << 32) + _rank(edge)


def segment(distinct: DataFrame, vocab: DataFrame, *, longest: int, fold: str = "merges", scores: list[float] | None = None) -> DataFrame:
    """``distinct`` (unit), partitioned by unit, with ranks: the ranks of its pieces
    in order. A single character is ``SINGLE`` and its code point where pieces
    merge, or ``UNKNOWN`` on a best path if it has no piece; a unit in which no
    two characters merge has no row."""
    text = F.col("unit")
    n = F.length(text)
    # Scores need single characters as edges, so that every unit has a path; merges begin with them.
    least = 2 if fold == "merges" else 1
    # Conditions are on what is exploded: one on the unit alone would reach below the
    # exchange of the units, and the two uses of it would no longer be one.
    starts = distinct.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    ends = F.sequence(F.least(F.col("start") + least, n), F.least(F.col("start") + longest, n))
    stops = starts.select("*", F.explode(ends).alias("stop")).where(F.col("stop") - F.col("start") >= least)
    subs = stops.withColumn("piece", F.substring(text, F.col("start") + 1, F.col("stop") - F.col("start")))
    met = subs.join(F.broadcast(vocab), "piece", "inner" if least == 2 else "left").where("rank is not null or stop = start + 1")
    rank = F.coalesce(F.col("rank"), F.lit(UNKNOWN)).cast("long")
    # An edge is one long that sorts by rank and start: rank, start, stop.
    edge = (rank * (1 << 2 * _BITS)) + (F.col("start") * (1 << _BITS)) + F.col("stop")
    # Rows that sort by a number first sort faster.
    lattice = met.select(F.xxhash64("unit").alias("h"), "unit", edge.alias("e")).groupBy("h", "unit").agg(F.collect_list("e").alias("edges"))
    if fold == "merges":
        symbols = let(F.struct("edges", "unit", n.alias("n")), lambda x: _merges(x["edges"], x["unit"], x["n"]))
    else:
        symbols = let(F.struct("edges", n.alias("n")), lambda x: F.transform(_viterbi(x["edges"], x["n"], F.lit(scores)), _symbol))
    return lattice.select("unit", F.transform(F.sort_array(symbols), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("ranks"))


def merge_long(unit: str, ranks: dict[str, int]) -> list[int]:
    """Ranks of a unit's pieces by merging, for units too long for a mask."""
    n = len(unit)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    queue = [(ranks[unit[i : i + 2]], i, i + 2) for i in range(n - 1) if unit[i : i + 2] in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop or not alive[j]:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := ranks.get(unit[x : end[y]])) is not None:
                heapq.heappush(queue, (r, x, end[y]))
    return [ranks.get(unit[i : end[i]], UNKNOWN) for i in range(n) if alive[i]]


def best_path_long(unit: str, ranks: dict[str, int], scores: list[float], longest: int) -> list[int]:
    """Ranks along the path of the greatest sum of scores, for units too long for
    a mask; of equal sums that with the longer last piece counts."""
    best, back = [0.0], [0]
    for stop in range(1, len(unit) + 1):
        top, at = -np.inf, stop - 1
        for start in range(max(0, stop - longest), stop):
            r = ranks.get(unit[start:stop])
            if r is None and start < stop - 1:
                continue
            if (worth := best[start] + (UNKNOWN_SCORE if r is None else scores[r])) > top:
                top, at = worth, start
        best.append(top)
        back.append(at)
    out, stop = [], len(unit)
    while stop:
        out.append(ranks.get(unit[back[stop] : stop], UNKNOWN))
        stop = back[stop]
    return out[::-1]


class _Coder:
    """Ids of units from ranks, and texts of ids; one per model and process."""

    def __init__(self, path: str):
        import pyarrow as pa

        known, byte_zero = vocabulary(path)
        self.ranks = {p: r for r, (p, _, _) in enumerate(known)}
        self.scores = [s for _, _, s in known]
        self.longest = max(len(p) for p, _, _ in known)
        self.id_array = np.array([i for _, i, _ in known], "<i4")
        self.byte_zero = byte_zero
        #: Ids of single characters by code point; -1 without a piece.
        self.id_of_char = np.full(0x110000, -1, "<i4")
        for p, i, _ in known:
            if len(p) == 1:
                self.id_of_char[ord(p)] = i
        self.piece: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for p, i, _ in known}
        self.piece |= {byte_zero + b: bytes([b]) for b in range(256)}
        self.table = pa.array([self.piece.get(i, b"") for i in range(max(self.piece) + 1)], pa.large_binary())

    def ids(self, unit: str, ranks) -> bytes:
        """Packed ids of a unit; characters without a piece become their bytes."""
        out, at = [], 0
        for r in ranks:
            if r >= SINGLE and (r == UNKNOWN or self.id_of_char[ord(unit[at])] < 0):
                out += [self.byte_zero + b for b in unit[at].encode("utf-8", "surrogatepass")]
                at += 1
            elif r >= SINGLE:
                out.append(int(self.id_of_char[ord(unit[at])]))
                at += 1
            else:
                out.append(int(self.id_array[r]))
                at += len(self.piece[out[-1]].decode())
        return np.array(out, "<i4").tobytes()

    def folded(self, unit: str, fold: str) -> bytes:
        return self.ids(unit, merge_long(unit, self.ranks) if fold == "merges" else best_path_long(unit, self.ranks, self.scores, self.longest))

    def texts(self, ids, ends: np.ndarray) -> Iterator[bytes]:
        """The texts of packed ids, cut behind each of ``ends``."""
        import pyarrow as pa

        joined = self.table.take(pa.array(ids))
        at = np.frombuffer(joined.buffers()[1], "<i8", len(joined) + 1, 8 * joined.offset)[ends]
        data = memoryview(joined.buffers()[2] or b"")
        # The space in front belongs to the encoding, not to the text.
        return (bytes(data[a + 1 : b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


class _Units(dict):
    """Packed ids by unit. Those too long for the lattice are folded when first
    met; every other one must have been answered."""

    def __init__(self, coder: _Coder, fold: str):
        super().__init__()
        self.coder, self.fold = coder, fold

    def learn(self, answers) -> None:
        """Takes in answered units (unit, ranks); no ranks are single characters."""
        bare = answers.column("ranks").is_null()
        for unit in answers.column("unit").filter(bare).to_pylist():
            self[unit] = self.coder.ids(unit, [SINGLE] * len(unit))
        answers = answers.filter(answers.column("ranks").is_valid()).combine_chunks()
        if not answers.num_rows:
            return
        units_, ranks = answers.column("unit").to_pylist(), answers.column("ranks").combine_chunks()
        flat, ends = ranks.values.to_numpy(), ranks.offsets.to_numpy()
        single = (flat >= SINGLE) & (flat != UNKNOWN)
        ids = np.where(single, self.coder.id_of_char[np.where(single, flat - SINGLE, 0)], self.coder.id_array[np.where(flat < SINGLE, flat, 0)])
        known = (flat != UNKNOWN) & (ids >= 0)
        ids = ids.astype("<i4").tobytes()
        at = (4 * ends).tolist()
        self.update({u: ids[a:b] for u, a, b in zip(units_, at[:-1], at[1:], strict=True)})
        for row in np.unique(np.searchsorted(ends, np.flatnonzero(~known), side="right") - 1):
            self[units_[row]] = self.coder.ids(units_[row], flat[ends[row] : ends[row + 1]].tolist())

    def __missing__(self, unit: str) -> bytes:
        if len(unit) <= LONGEST_UNIT:
            raise RuntimeError(f"no answer for a unit of {len(unit)} characters")
        found = self[unit] = self.coder.folded(unit, self.fold)
        return found


class _Words(dict):
    """Packed ids by what stands between spaces."""

    def __init__(self, known: _Units):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> bytes:
        found = self.known[SPACE + word] if word.isalpha() else b"".join(map(self.known.__getitem__, _word_units(word)))
        self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _plain(text):
            return b"".join(map(self.__getitem__, text.split(" ")))
        return b"".join(map(self.known.__getitem__, units(text)))


def _plain(text: str) -> bool:
    """Whether the units of a text are those of its words, one by one."""
    return "  " not in text and SPACE not in text


def _word_units(word: str) -> list[str]:
    """The units of a word and the space in front; letters, and letters with one
    mark behind them, need no pattern."""
    if word.isalpha():
        return [SPACE + word]
    if word[-1:] in _MARKS and word[:-1].isalpha():
        return [SPACE + word[:-1], word[-1]]
    return _splitter()(SPACE + word)


def _units_of(texts) -> set[str]:
    seen: set[str] = set()
    words: set[str] = set()
    for text in texts:
        if text and _plain(text):
            words.update(text.split(" "))
        else:
            seen.update(units(text or ""))
    for word in words:
        seen.update(_word_units(word))
    return seen


@lru_cache(maxsize=2)
def _coder(path: str) -> _Coder:
    return _Coder(path)


def _frozen(rows) -> bytes:
    """An Arrow batch or table as one compressed stream."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", PACK_LEVEL))) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def _values(column) -> Iterator:
    """The values of a column; only a few are Python objects at once."""
    for lo in range(0, len(column), STEP_ROWS):
        yield from column.slice(lo, STEP_ROWS).to_pylist()


def _steps(table, at: int) -> Iterator:
    """A table in slices of some ``STEP_BYTES`` of texts each, those of column ``at``."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(table.column(at)), 0).to_numpy(), dtype="i8")
    cuts = [0, *(np.flatnonzero(np.diff(ends // STEP_BYTES)) + 1).tolist(), table.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield table.slice(lo, hi - lo)


def _packs(batches: Iterator, own: list[str]) -> Iterator:
    """(number, table): bounded packs of rows, numbered by their content, so that
    every pass over the table numbers them alike."""
    import pyarrow as pa
    import xxhash

    def numbered(parts):
        table, digest = pa.Table.from_batches(parts), xxhash.xxh64()
        for name in table.column_names:
            for value in _values(table.column(name)):
                digest.update(b"\0" if value is None else value.encode("utf-8", "surrogatepass") if isinstance(value, str) else repr(value).encode())
        return digest.intdigest() - (1 << 63), table.select(own)

    parts, rows, held = [], 0, 0
    for batch in batches:
        at, sizes = 0, batch.column(0).to_pylist()
        batch = batch.select(batch.schema.names[1:])
        for k, size in enumerate(sizes):
            if rows + k - at and (rows + k - at >= PACK_ROWS or held + size > PACK_BYTES):
                yield numbered([*parts, batch.slice(at, k - at)])
                parts, rows, held, at = [], 0, 0, k
            held += size + 1
        if len(sizes) > at:
            parts.append(batch.slice(at))
            rows += len(sizes) - at
    if parts:
        yield numbered(parts)


def encode(docs: DataFrame, text_col: str = "text", *, model: str = MODEL, fold: str = "merges", restored_col: str | None = None) -> DataFrame:
    """``docs`` with ids, the piece ids of the text column, and where a name is
    given for it, whether decoding them gives the text back."""
    import pyarrow as pa

    check_units(model)
    spark = docs.sparkSession
    docs = without(docs, *({"ids", restored_col} - {text_col}))
    known, _ = vocabulary(model)
    longest = max(len(p) for p, _, _ in known)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = list(docs.columns)
    at = own.index(text_col)
    # Arrow columns go by place: a table may have a column of any name.
    sized = docs.select(F.coalesce(F.octet_length(text_col), F.lit(0)).alias("_bytes"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)])
    places = [f"c{k}" for k in range(len(own))]

    def asked(batches: Iterator) -> Iterator:
        """The distinct units of every pack."""
        for g, pack in _packs(batches, places):
            found = [u for u in _units_of(_values(pack.column(at))) if len(u) <= LONGEST_UNIT]
            for lo in range(0, len(found), 50_000):
                part = found[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(np.full(len(part), g), pa.int64())], ["unit", "g"])

    def packed(batches: Iterator) -> Iterator:
        """Every pack as one compressed row."""
        for g, pack in _packs(batches, places):
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([_frozen(pack)], pa.binary())], ["g", "payload"])

    # More partitions than usual: a unit's lattice is some thirty times its row.
    wanted = sized.mapInArrow(asked, "unit string, g long").where("unit is not null and g is not null").repartition(parts, "unit")
    # The filter keeps the column, so that both uses of the units read one exchange.
    distinct = wanted.groupBy("unit").agg(F.min("g").alias("g")).where("g is not null").select("unit")
    done = segment(distinct, pieces(spark, model), longest=longest, fold=fold, scores=[s for _, _, s in known] if fold == "viterbi" else None)
    # Only now do units meet those who ask, so that one in every pack is one row while it is cut.
    dealt = wanted.join(done.hint("shuffle_hash"), "unit", "left").select("g", "unit", "ranks").sortWithinPartitions("g")

    def gathered(batches: Iterator) -> Iterator:
        """What a partition answers, as one compressed row for each pack."""
        held, of = [], None
        for batch in batches:
            g = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and g[a] != of:
                    yield answered(of, held)
                    held = []
                of = int(g[a])
                held.append(batch.slice(a, b - a).select(["unit", "ranks"]))
        if held:
            yield answered(of, held)

    def answered(g: int, held: list):
        rows = pa.Table.from_batches(held).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([_frozen(rows)], pa.binary())], ["g", "answers"])

    answers = dealt.mapInArrow(gathered, "g long, answers binary")
    payloads = sized.mapInArrow(packed, "g long, payload binary")

    def apply(payloads, answers):
        coder = _coder(model)
        known_units = _Units(coder, fold)
        for frozen in answers.column("answers"):
            known_units.learn(pa.ipc.open_stream(frozen.as_buffer()).read_all())
        words, tables = _Words(known_units), []

        def coded(table):
            texts = table.column(at).to_pylist()
            ids = [b"" if t is None else words.ids(t) for t in texts]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids])
            values = np.frombuffer(b"".join(ids), "<i4")
            none = pa.array([t is None for t in texts], pa.bool_())
            columns = [*table.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=none)]
            if restored_col:
                back = coder.texts(values, ends)
                columns.append(pa.array([t is None or b == t.encode("utf-8", "surrogatepass") for b, t in zip(back, texts, strict=True)]))
            return pa.Table.from_arrays(columns, names=out_names)

        for payload in payloads.column("payload"):
            # A pack whole would be its texts, ids and decoded texts in memory many times over.
            tables += map(coded, _steps(pa.ipc.open_stream(payload.as_buffer()).read_all(), at))
        return pa.concat_tables(tables) if tables else target.empty_table()

    out_names = [*places, "ids", *(["restored"] if restored_col else [])]
    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)) + ", ids array<int>"
    schema += ", restored boolean" if restored_col else ""
    target = to_arrow_schema(T._parse_datatype_string(schema))
    out = payloads.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(apply, schema)
    return out.toDF(*own, "ids", *([restored_col] if restored_col else []))


def decode(encoded: DataFrame, out_col: str = "decoded", *, model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its ids."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        coder = _coder(model)

        def of(x):
            return None if x is None else next(coder.texts(np.asarray(x, "<i4"), np.array([0, len(x)]))).decode("utf-8", "replace")

        return ids.map(of)

    return encoded.withColumn(out_col, text("ids"))
