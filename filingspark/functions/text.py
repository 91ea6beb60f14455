"""Text rules of filings (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a statement, in the order in which kinds are tried.
STATEMENT_WORDS = {
    "income": ("利润表", "损益表", "income statement", "profit and loss", "statement of operations", "营业收入", "revenue", "net income", "净利润"),
    "balance": ("资产负债表", "balance sheet", "statement of financial position", "资产总计", "total assets", "负债合计", "total liabilities"),
    "cashflow": ("现金流量表", "cash flow statement", "statement of cash flows", "cash flow", "经营活动", "operating activities", "投资活动", "investing activities"),
}
# Audit words in the order in which they are tried; the milder ones.
AUDIT_WORDS = ("保留意见", "无法表示意见", "否定意见", "强调事项", "qualified opinion", "adverse opinion", "disclaimer of opinion", "going concern", "material uncertainty")
AUDIT_MEDIUM = ("强调事项", "going concern", "material uncertainty")
# The patterns of headings, company suffixes and file name noise define what is found.
HEADING = r"^(\d+\.|[IVX]+\.|[A-Z][A-Za-z\s]{2,}|[一二三四五六七八九十]+[、.]|（[一二三四五六七八九十]+）|第[一二三四五六七八九十\d]+[章节篇部分条])"
COMPANY_SUFFIX = r"(?i)\b(Inc\.|Corporation|Corp\.|Company|Co\.|Limited|Ltd\.|Holdings|Group|PLC|S\.A\.)(?=$|[\s,])"
FILENAME_NOISE = r"(?i)\b(FY\d{2,4}|FY|Q[1-4]|\d{2,4}|annual|quarterly|report|financial|statements|consolidated)\b"
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]"
SAFE_ID = r"^[a-zA-Z0-9_\-]+$"


def contains_any(text: Column, needles) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | text.contains(n)
    return found


def statement_type(title: Column, head: Column) -> Column:
    """Kind of statement by a table's title, else by its first rows' text."""

    def kind(t):
        out = F.lit(None).cast("string")
        for name, needles in reversed(STATEMENT_WORDS.items()):
            out = F.when(contains_any(F.lower(t), needles), name).otherwise(out)
        return out

    return F.coalesce(kind(F.coalesce(title, F.lit(""))), kind(F.coalesce(head, F.lit(""))))


def first_word(text: Column, needles) -> Column:
    """The first of ``needles``, in their order, that a text holds."""
    return F.coalesce(*[F.when(text.contains(n), F.lit(n)) for n in needles])


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def is_heading(line: Column) -> Column:
    return F.trim(line).rlike(HEADING)


def is_sparse_page(text: Column, n_images: Column) -> Column:
    """A page of images with next to no text, for character recognition."""
    return (F.length(stripped(F.coalesce(text, F.lit("")))) < 20) & (n_images > 0)


def safe_id(x: Column) -> Column:
    return x.rlike(SAFE_ID)


def safe_filename(x: Column) -> Column:
    return F.left(F.regexp_replace(x, r"[^\w.\-]", "_"), F.lit(128))


def quote(text: Column) -> Column:
    """First line of a text, at most 200 characters."""
    return F.left(F.split(stripped(text), "\n")[0], F.lit(200))


def label_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), "[ -]", "_")


def estimated_tokens(text: Column) -> Column:
    """CJK characters count two thirds of a token, others a quarter."""
    other = F.length(F.regexp_replace(text, CJK, ""))
    return ((F.length(text) - other) / 1.5 + other / 4).cast("int")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def runs(text: Column) -> Column:
    """A text as runs of CJK and other characters: array of (n, wide)."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s){CJK}+|{CJK.replace('[', '[^', 1)}+"), F.lit(0))
    return F.transform(parts, lambda r: F.struct(F.length(r).alias("n"), r.rlike(CJK).alias("wide")))


def run_tokens(runs: Column, chars: Column) -> Column:
    """Estimated tokens of the first ``chars`` characters of a text, by its runs."""
    zero = F.struct(F.lit(0).alias("left"), F.lit(0).alias("wide")).withField("left", chars.cast("int"))
    wide = F.aggregate(
        runs, zero, lambda acc, r: F.struct((acc["left"] - F.least(acc["left"], r["n"])).alias("left"), (acc["wide"] + F.when(r["wide"], F.least(acc["left"], r["n"])).otherwise(0)).alias("wide")), lambda acc: acc["wide"]
    )
    return let(wide, lambda w: (w / 1.5 + (chars - w) / 4).cast("int"))


def fitting(runs: Column, limit: Column) -> Column:
    """Characters that fit into ``limit`` tokens: all, or else a cut in proportion, less
    a twentieth, made a tenth shorter until it fits."""
    size = F.aggregate(runs, F.lit(0), lambda acc, r: acc + r["n"])

    def cut(n, total):
        first = F.floor(n * (limit / total) * 0.95).cast("int")
        steps = F.sequence(F.lit(0), F.ceil(F.log(n + 1) / 0.1).cast("int"))
        return F.aggregate(steps, first, lambda c, _: F.when(run_tokens(runs, c) <= limit, c).otherwise(F.floor(c * 0.9).cast("int")))

    return let(size, lambda n: let(run_tokens(runs, n), lambda total: F.when(limit <= 0, 0).when(total <= limit, n).otherwise(cut(n, total))))


def truncated(text: Column, max_tokens) -> Column:
    """The text if it fits, else what ``fitting`` leaves of it; empty if nothing fits."""
    limit = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    return F.left(text, let(runs(text), lambda r: fitting(r, limit)))


def split_prompt(text: Column, max_tokens: int, overlap_tokens: int = 100) -> Column:
    """Parts of about ``max_tokens``, each beginning ``overlap_tokens`` before the
    last's end; a text that fits is one part."""
    per_token = F.length(text) / F.greatest(estimated_tokens(text), F.lit(1))
    size = F.greatest(F.floor(per_token * max_tokens * 0.95).cast("int"), F.lit(1))
    step = F.greatest(size - F.floor(per_token * overlap_tokens).cast("int"), F.lit(1))
    # The part that reaches the end is the last.
    last = F.greatest(F.ceil((F.length(text) - size) / step).cast("int"), F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * step + 1, size))
    return F.when(estimated_tokens(text) <= max_tokens, F.array(text)).otherwise(parts)


def overlapping_parts(text: Column, size: int, overlap: int) -> Column:
    """Slices of ``size`` characters, each beginning ``overlap`` before the last's end."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    parts = F.transform(starts, lambda s: F.substring(text, s + 1, size))
    return F.filter(parts, lambda p: F.trim(p) != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.array_remove(F.split(F.lower(text), r"(?U)\W+"), "")


def company(text: Column, filename: Column) -> Column:
    """First of 30 non-empty lines with a company suffix, else the file's name."""
    lines = F.slice(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 30)
    cleaned = F.transform(lines, lambda x: F.regexp_replace(x, r"^[ :\t]+|[ :\t]+$", ""))
    named = F.get(F.filter(cleaned, lambda x: (F.length(x) <= 80) & x.rlike(COMPANY_SUFFIX)), 0)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", ""), "[_-]", " ")
    spoken = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(stem, FILENAME_NOISE, " "), r"\s+", " ")))
    return F.coalesce(named, F.nullif(spoken, F.lit("")))


def report_type(text: Column, filename: Column) -> Column:
    u = F.upper(F.concat(text, F.lit("\n"), filename))
    return (
        F.when(contains_any(u, ("FORM 10-K", "ANNUAL REPORT")), "Annual Report")
        .when(contains_any(u, ("FORM 10-Q", "QUARTERLY REPORT")), "Quarterly Report")
        .when(u.contains("CONDENSED CONSOLIDATED") & u.contains("STATEMENT"), "Condensed Consolidated Financial Statements")
        .when(u.contains("CONSOLIDATED") & u.contains("FINANCIAL") & u.contains("STATEMENT"), "Consolidated Financial Statements")
        .when(u.contains("FINANCIAL") & u.contains("STATEMENT"), "Financial Statements")
    )


def is_a_share(ticker: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(ticker)), r"\.(SH|SZ|SS)$", "").rlike("^[0-9]{6}$")


def exchange_ticker(ticker: Column) -> Column:
    """Six digits with the exchange's suffix: SH from 6, else SZ."""
    t = F.upper(F.trim(ticker))
    digits = F.regexp_replace(t, r"\D", "")
    return F.when(t.rlike(r"\.(SH|SZ)$"), t).when(digits.startswith("6"), F.concat(digits, F.lit(".SH"))).otherwise(F.concat(digits, F.lit(".SZ")))


def conclusion(markdown: Column) -> Column:
    """The conclusion or summary section of a report, else its first 600 characters."""
    section = F.regexp_extract(markdown, r"(?is)(?:^|\n)#+[^\n]*(?:conclusion|summary)[^\n]*\n(.*?)(?=\n#|\z)", 1)
    return F.coalesce(F.nullif(F.trim(section), F.lit("")), F.left(markdown, F.lit(600)))


def json_candidate(text: Column) -> Column:
    """JSON inside model text: the text, a fenced block, the outermost object or list."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    tried = [text, fence, F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1)]
    container = [F.when(stripped(t).rlike(r"^[\[{]") & F.call_function("try_parse_json", t).isNotNull(), stripped(t)) for t in tried]
    return F.coalesce(*container)
