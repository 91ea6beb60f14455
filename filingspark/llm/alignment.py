"""Alignment of two tokenizers' tokens of the same text, by pointer jumping.

A text is encoded by a byte-level BPE (A) and a SentencePiece model (B), and both
token sequences are laid over the text's bytes. Tokens that overlap hang together:
every token points to the farthest-right token that it overlaps, a token of B whose
end is also an end of A to itself. Replacing pointers by their pointers' pointers
doubles their reach, until every token points to the last token of its group; all
texts of a chunk of a batch jump at once.

``align`` gives a document's groups, and its links: pairs of tokens, one of A and
one of B, whose byte ranges overlap. ``count_links`` counts the pairs of ids over
the whole corpus and gives each document what its links amount to. Documents travel
in batches of bounded size, and a batch asks for each of its pairs once, so a pair
that is in every text is as many rows as there are batches, which a join may split.

Defined cases: null and empty texts, and texts whose tokens do not spell the text
(B takes its space mark for a space) have no tokens, no groups and zeros; texts are
read whole; repeated rows get a row each, and count each; of ties for the highest
count all are best; other columns are kept, those named like a result are replaced;
empty tables give empty results. Sums of counts are 64-bit numbers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import without, written

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text aligned at once.
CHUNK = 1 << 20
#: Distinct pairs of documents of a batch, one document more at most.
BATCH = 1_000_000
RESULTS = "n_a long, n_b long, n_groups long, n_links long, groups string, links struct<batch: long, pairs: array<long>, times: array<long>>"
#: Texts that two implementations of the same BPE might part differently (letters
#: that one Unicode version has), or where one takes quadratic time.
_RARE = re.compile(r"[^\x00-ɏ]|\S{2000}|\s{2000}")


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones
    stand for themselves, the others for characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _coder_a(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """(texts to ids, bytes by id) of the byte-level BPE."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, vocab = _byte_alphabet(), model["vocab"]
    spelled = [b""] * slow.get_vocab_size()
    for token, k in vocab.items():
        if all(c in alphabet for c in token):
            spelled[k] = bytes(alphabet[c] for c in token)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    # Where ids are ranks of merges, the same model runs some four times as fast.
    fast = None
    if all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merges)):
        ranks = {s: k for k, s in enumerate(spelled[: 256 + len(merges)])}
        # The pattern of byte-level BPEs, a fixed value.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(texts: list[str]) -> list[list[int]]:
        rare = [fast is None or _RARE.search(t) is not None for t in texts]
        slowly = iter(slow.encode_batch_fast([t for t, r in zip(texts, rare, strict=True) if r], add_special_tokens=False))
        return [next(slowly).ids if r else fast(t) for t, r in zip(texts, rare, strict=True)]

    return encode, spelled


@lru_cache(maxsize=4)
def _coder_b(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """(texts to ids, bytes by id) of the SentencePiece model, which adds a space."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [bytes([int(p[3:5], 16)]) if m.is_byte(k) else p.replace("▁", " ").encode() for k in range(m.get_piece_size()) for p in (m.id_to_piece(k),)]
    return lambda texts: m.encode(texts, num_threads=1), spelled


@lru_cache(maxsize=4)
def _printed(n_a: int, n_b: int) -> np.ndarray:
    """Ids as text with what follows them: a comma or a bar for A; a comma, a
    semicolon or nothing for B."""
    parts = [f"{k}{end}" for n, ends in ((n_a, ",|"), (n_b, (",", ";", ""))) for end in ends for k in range(n)]
    return np.array(parts, object)


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For each token of A, then of B, the number of its group's last token: tokens
    are given by their ends, and both sequences end at the same byte."""
    n = len(end_a)
    to_b, to_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    own = np.arange(n, n + len(end_b))
    pointer = np.concatenate([n + to_b, np.where(end_a[to_a] == end_b, own, to_a)]) if n else own
    while True:
        beyond = pointer[pointer]
        if (beyond == pointer).all():
            return pointer
        pointer = beyond


def _aligned(texts: list[str], a_path: str, b_path: str) -> tuple:
    """(n_a, n_b, n_groups, n_links, groups, pairs, times, offsets of pairs) of texts."""
    (code_a, spelled_a), (code_b, spelled_b) = _coder_a(a_path), _coder_b(b_path)
    ids_a, ids_b = code_a([" " + t for t in texts]), code_b(texts)
    for k, t in enumerate(texts):
        whole = (" " + t).encode()
        if not t or b"".join(map(spelled_a.__getitem__, ids_a[k])) != whole or b"".join(map(spelled_b.__getitem__, ids_b[k])) != whole:
            ids_a[k] = ids_b[k] = []
    n_a, n_b = np.array([len(x) for x in ids_a], "i8"), np.array([len(x) for x in ids_b], "i8")
    flat = lambda ids, n: np.fromiter((x for y in ids for x in y), "i8", int(n.sum()))
    a, b = flat(ids_a, n_a), flat(ids_b, n_b)
    docs = np.arange(len(texts))
    doc_a, doc_b = np.repeat(docs, n_a), np.repeat(docs, n_b)
    # Both sequences spell the same bytes, so the texts of a chunk lie end to end.
    end_a = np.cumsum(np.array([len(s) for s in spelled_a], "i8")[a])
    end_b = np.cumsum(np.array([len(s) for s in spelled_b], "i8")[b])
    last = terminals(end_a, end_b)
    heads = np.unique(last[len(a) :])
    group = np.searchsorted(heads, last)
    of_a, of_b = group[: len(a)], group[len(a) :]
    n_groups = np.bincount(doc_b[heads - len(a)], minlength=len(docs))
    # Groups as text: A's ids, a bar, B's ids, a semicolon before the next group.
    closes_a = np.append(of_a[1:] != of_a[:-1], True)[: len(a)]
    closes_b = np.append(of_b[1:] != of_b[:-1], True)[: len(b)].astype("i8")
    closes_b[np.cumsum(n_b)[n_b > 0] - 1] = 2
    size_a, size_b = len(spelled_a), len(spelled_b)
    code = np.concatenate([a + size_a * closes_a, 2 * size_a + b + size_b * closes_b])
    order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
    shown = _printed(size_a, size_b)[code[order]].tolist()
    stops = np.cumsum(n_a + n_b).tolist()
    groups = ["".join(shown[lo:hi]) for lo, hi in zip([0, *stops[:-1]], stops, strict=True)]
    # The range between two neighbouring ends is one link.
    cuts = np.unique(np.concatenate([end_a, end_b]))
    at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
    width = size_b.bit_length()
    pair = a[at_a] << width | b[at_b]
    in_doc = doc_a[at_a]
    n_links = np.bincount(in_doc, minlength=len(docs))
    span = (size_a << width).bit_length()
    found, times = np.unique(in_doc << span | pair, return_counts=True)
    offsets = np.searchsorted(found >> span, np.arange(len(docs) + 1))
    found &= (1 << span) - 1
    pairs = found >> width << 32 | found & (1 << width) - 1
    return n_a, n_b, n_groups, n_links, groups, pairs, times, offsets


def align(docs: DataFrame, text_col: str = "text", a_path: str = MODEL_A, b_path: str = MODEL_B) -> DataFrame:
    """``docs`` with the numbers of tokens, groups and links, ``groups`` as text
    (``a1,a2|b1;a3|b2,b3``: ids of A and of B by group, in order), and ``links`` for
    ``count_links``: the distinct pairs (id of A * 2**32 + id of B) and their times."""
    fields = T._parse_datatype_string(RESULTS)
    kept = without(docs, *[n for n in fields.names if n != text_col])
    schema = T.StructType(kept.schema.fields + fields.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        target = to_arrow_schema(schema)
        batch, held = int.from_bytes(os.urandom(7)), 0
        for rows in batches:
            texts = [t or "" for t in rows.column(rows.schema.get_field_index(text_col)).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= CHUNK):
                    size += len(texts[stop])
                    stop += 1
                n_a, n_b, n_groups, n_links, groups, pairs, times, offsets = _aligned(texts[at:stop], a_path, b_path)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64())) for x in (pairs, times)]
                links = pa.StructArray.from_arrays([pa.array(np.full(stop - at, batch)), *lists], fields=list(target.field("links").type))
                numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
                columns = [c.cast(f.type) for c, f in zip(rows.slice(at, stop - at).columns, target, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, *numbers, pa.array(groups, pa.string()), links], schema=target)
                at, held = stop, held + len(pairs)
                if held >= BATCH:
                    batch, held = int.from_bytes(os.urandom(7)), 0

    return kept.mapInArrow(run, schema)


def count_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` rows with, in place of ``links``: n_best, the links whose count is
    the highest of their id of B, and count_sum, the sum of the links' counts; the
    count of a pair is how many links of all rows hold it."""
    fields = T._parse_datatype_string("n_best long, count_sum long")
    rows = written(without(aligned, *fields.names), "aligned")
    kept = without(rows, "links")
    schema = T.StructType(kept.schema.fields + fields.fields)
    seen = rows.select(F.explode(F.arrays_zip("links.pairs", "links.times")).alias("l")).groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("n"))
    # A window holds the pairs of one id of B: as many as A has ids at most.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = seen.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))
    asked = rows.select(F.col("links.batch").alias("batch"), F.explode("links.pairs").alias("pair")).distinct()
    answers = asked.join(counts, "pair").select("batch", "pair", "n", "best")
    at, places = rows.columns.index("links"), [rows.columns.index(c) for c in kept.columns]

    def fold(mine, told):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        target = to_arrow_schema(schema)
        pairs, times = (pa.concat_arrays([c.field(f) for c in mine.column(at).chunks]) for f in ("pairs", "times"))
        offsets = np.append(0, np.cumsum(pa.compute.list_value_length(pairs).to_numpy()))
        pair, time = pairs.flatten().to_numpy(), times.flatten().to_numpy()
        known, n = told.column("pair").to_numpy(), told.column("n").to_numpy()
        order = np.argsort(known)
        found = order[np.searchsorted(known, pair, sorter=order)] if len(pair) else order[:0]
        best = told.column("best").to_numpy()[found]
        total = lambda x: np.diff(np.append(0, np.cumsum(x))[offsets])
        numbers = [pa.array(total(time * best), pa.int64()), pa.array(total(time * n[found]), pa.int64())]
        return pa.Table.from_arrays([*[mine.column(p).cast(target.field(k).type) for k, p in enumerate(places)], *numbers], schema=target)

    return rows.groupBy(F.col("links.batch")).cogroup(answers.groupBy("batch")).applyInArrow(fold, schema)
