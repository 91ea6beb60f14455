"""Personal data (native): patterns propose, checksums confirm, context scores.

For every kind a regular expression proposes leftmost non-overlapping spans; a
validator confirms them (octets of an address, Luhn for cards, digit counts for
phones, mod 97 for IBANs) and failing matches are dropped without a retry.
A span's score is its kind's base score, raised if a context word stands within
``CONTEXT_CHARS`` of it. The base kinds (email, ip, card, phone) are always
reported; the added kinds (iban, ssn) only from ``ADDED_SCORE`` on.

Patterns use possessive loops and look-behinds where greedy matching gives the
same spans, so that long runs cost linear time and no stack.

Defined cases: null text counts as empty, without spans; offsets are code
points, ends exclusive; kinds may overlap each other; redaction joins
overlapping spans and writes the first one's kind; repeated rows count each; other
columns are kept, an input column named like the spans is replaced by them (never by
``redact``); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused

CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2
ADDED_SCORE = 0.5
BASE_KINDS = ("email", "ip", "card", "phone")
#: Characters of an IBAN by its country, so that a match ends where the IBAN does.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a kind's pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "iban": "", "ssn": "-"}
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|cuenta|compte)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    """Remainder of an IBAN whose first four characters moved to its end."""
    moved = F.concat(F.substr(x, F.lit(5)), F.left(x, F.lit(4)))

    def step(s):
        def fold(acc, i):
            code = F.ascii(F.substr(s, i, F.lit(1)))
            return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), fold)

    return let(moved, step)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.try_cast("double") <= 255)
    if kind == "card":
        return let(_digits(x), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "iban":
        return let(F.replace(x, F.lit(" "), F.lit("")), lambda c: F.length(c).between(15, 34) & (_mod97(c) == 1))
    return F.lit(True)


def _proposed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>>: the matches between the pieces of a split."""

    def placed(s):
        empty = F.array().cast("array<struct<start:int,end:int,found:string>>")

        def step(acc, m):
            start = acc["at"] + F.length(F.get(s["pieces"], F.size(acc["out"])))
            end = start + F.length(m)
            span = F.struct(start.alias("start"), end.alias("end"), m.alias("found"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(s["found"], zero, step, lambda acc: acc["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, let(F.struct(m.alias("found"), F.split(text, pattern, -1).alias("pieces")), placed)))


def _spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed spans of a kind."""

    def scored(s):
        around = F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, s["end"] - s["start"] + 2 * CONTEXT_CHARS)
        bonus = F.when(around.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (F.lit(BASE_SCORE[kind]) + bonus).alias("score"))

    spans = F.transform(F.filter(_proposed(text, PATTERNS[kind]), lambda s: _valid(kind, s["found"])), scored)
    if kind not in BASE_KINDS:
        spans = F.filter(spans, lambda s: s["score"] >= ADDED_SCORE)
    tried = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]{2}" if kind == "iban" else "[0-9]")
    return F.coalesce(F.when(tried, spans), F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """``docs`` with ``spans_col``: kind by kind in order, then by start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(spans_col, F.concat(*[_spans(text, kind) for kind in PATTERNS]))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, where
    there is such a column, follows the text."""
    spans = unused(docs, "pii_spans")
    found = find_pii(docs, text_col, spans).withColumn(spans, F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"]))))
    text = F.col(text_col)

    def step(acc, s):
        start, end, kind = s["start"], s["end"], s["kind"]
        piece = F.concat(F.substring(text, acc["at"] + 1, start - acc["at"]), F.lit("["), F.upper(kind), F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], end).alias("at"),
            F.when(start >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))
    out = found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
