"""What a draft quotes, cites and names: blocks, quotations, candidates, exhibits, forms, urls.

Blocks and candidates depend on the order of lines and of what was accepted before, so that they are Arrow functions over
whole texts; everything after them is column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from attestia.functions import text as T

# What begins a block of its own; the pairs of quotation marks; a heading within a quoted block.
BLOCK_START = re.compile(r"(#{1,6}\s|[-*+]\s|\d+[.)]\s|\||>)")
MARKS = [('"', '"'), ("“", "”"), ("«", "»")]
INNER_MARKS = [('"', '"'), ("«", "»"), ("“", "”")]
CALLOUT = re.compile(r"(?:^|\s)#{1,6}\s")
# What shows that a long quotation is telemetry, code or a label, not a source.
NOISE = re.compile(r"\bmax_tokens\b|\btool_use\b|\bexit \d|\bHTTP \d|Exhibit\s|Screenshot|\.py\b|\.md\b|\.json\b|https?://|%TEMP%|\$\{|\bTODO\b|\bFIXME\b", re.I)
QUOTED = re.compile(r"[«\"“‘]((?:[^«»\"“”‘’\n]|\n(?!\s*\n)){55,700})[»\"”’]")
QUOTED_LINE = re.compile(r"(?m)^[ \t]*>\s?(.{55,})$")
QUOTED_LINES = re.compile(r"(?m)^[ \t]*>[^\n]*(?:\n[ \t]*>[^\n]*)*")
# Letters of exhibit series; what looks like an exhibit and is a form or visa; series of documents.
SERIES = tuple("ABCDEFGHJKLMPVWX")
NOT_EXHIBIT = ["G-28", "G-325", "G-884", "G-1055", "G-1145", "G-1450", "F-1", "F-2", "F-3", "H-1", "H-1b", "H-2", "J-1", "J-2", "L-1", "L-1a", "L-1b"]
DOC_SERIES = ["M", "W"]
FORM = r"((?:I|G|N|ETA)[-–—]?\p{Nd}{2,5}[A-Z]?)"
URL = rf"(?i)https?://[^<>\"')\]}},;{T.SPACE[1:-1]}]+"


def _kind(line: str) -> str:
    return {">": "q", "|": "t"}.get(line[:1], "p") if line else ""


def blocks(text: str | None) -> list[tuple[str, str]]:
    """(kind, text) of a draft's paragraphs: q quoted, t table row, p prose. Lines of one kind are one block, but for
    table rows, and for prose where a heading, list item or number begins."""
    out: list[tuple[str, list[str]]] = []
    last = ""
    for line in map(str.strip, (text or "").splitlines()):
        kind = _kind(line)
        if kind:
            body = line.lstrip("> ").strip() if kind == "q" else line
            if kind == last != "t" and not (kind == "p" and BLOCK_START.match(line)):
                out[-1][1].append(body)
            else:
                out.append((kind, [body]))
        last = kind
    return [(kind, " ".join(lines)) for kind, lines in out]


def spans(text: str | None, least: int) -> list[str]:
    """What stands in quotation marks in each block, and quoted blocks; a quoted block with spans of its own is these, and
    one with a heading is a call-out, which is no quotation."""
    between = lambda pairs, n, s: [m for a, b in pairs for m in re.findall(rf"{a}([^{b}\n]{{{n},}}){b}", s)]
    out: list[str] = []
    for kind, body in blocks(text):
        out += between(MARKS, least, body)
        if kind == "q" and len(body) >= least and not CALLOUT.search(body):
            out += between(INNER_MARKS, 20, body) or [body]
    return out


def quotations(c: Column, least: int = 45, drop_cyrillic: bool = True) -> Column:
    """Array of a draft's quotations, cleaned, the first of each kept, in order. Null is an empty draft."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spans(t, least))

    clean = F.transform(found(F.coalesce(c, F.lit(""))), lambda q: T.strip(T.strip_markdown(q)))
    long_ = F.filter(clean, lambda q: F.char_length(q) >= least)
    kept = F.filter(long_, lambda q: ~T.mostly_cyrillic(q)) if drop_cyrillic else long_
    keyed = F.transform(kept, lambda q: F.struct(q.alias("q"), F.lower(T.normalise(q)).alias("k")))
    none = F.array().cast("array<struct<q:string,k:string>>")
    first = F.aggregate(keyed, none, lambda held, x: F.when(F.exists(held, lambda y: y["k"] == x["k"]), held).otherwise(F.array_append(held, x)))
    return F.transform(first, lambda x: x["q"])


def block_array(c: Column) -> Column:
    """Array of (kind, text), as ``blocks``."""

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "text": b} for k, b in blocks(t)])

    return found(F.coalesce(c, F.lit("")))


def pick(text: str | None, least: int = 55, latin: float = 0.75) -> list[str]:
    """Long quoted spans that may be sources: quoted paragraphs, quoted lines, then quotation marks; one that holds an
    accepted one, or is in one, is left out."""
    paragraphs = (" ".join(re.sub(r"^[ \t]*>\s?", "", line) for line in m.splitlines()) for m in QUOTED_LINES.findall(text or ""))
    kept: list[str] = []
    for raw in (*paragraphs, *QUOTED_LINE.findall(text or ""), *QUOTED.findall(text or "")):
        q = " ".join(raw.split())
        letters = [x for x in q if x.isalpha()]
        enough = letters and sum(map(str.isascii, letters)) >= latin * len(letters)
        if len(q) >= least and enough and not NOISE.search(q) and not any(q in s or s in q for s in kept):
            kept.append(q)
    return kept


def candidates(c: Column, least: int = 55, latin: float = 0.75) -> Column:
    """Array of ``pick``."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pick(t, least, latin))

    return found(F.coalesce(c, F.lit("")))


def bank_quotes(c: Column) -> Column:
    """Array of a bank's quoted blocks, one normalised string in lower case for each."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?md)^(?:>[^\n]*\n?)+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda q: F.lower(T.normalise(T.strip_markdown(q)))), lambda q: q != ""))


def canon(series: Column, number: Column, suffix: Column) -> Column:
    """An exhibit's name: upper-case letter, number without leading zeros, lower-case suffix."""
    bare = F.ltrim(number, F.lit("0"))
    return F.concat(F.upper(series), F.lit("-"), F.when(bare == "", "0").otherwise(bare), F.lower(suffix))


def id_pattern(series: tuple[str, ...]) -> str:
    letters = "|".join(sorted(series, key=len, reverse=True))
    return rf"(?iu)(?<![A-Za-z])(?:Exhibit{T.SPACE}+)?({letters}){T.SPACE}*[-–—]{T.SPACE}*0*(\p{{Nd}}{{1,4}})([a-zA-Z]?\p{{Nd}}?)(?![-–—\p{{Nd}}])"


def file_pattern(series: tuple[str, ...]) -> str:
    letters = "|".join(sorted(series, key=len, reverse=True))
    return rf"(?iu)^(?:Exhibit{T.SPACE}+)?({letters}){T.SPACE}*[-–—]?{T.SPACE}*0*(\p{{Nd}}{{1,4}})([a-zA-Z]?\p{{Nd}}?)(?![0-9])"


K_SERIES = rf"(?iu)(?<![A-Za-z])K{T.SPACE}*[-–—]?{T.SPACE}*0*(\p{{Nd}}{{1,4}})([a-zA-Z]?)(?![-–—\p{{Nd}}])"


def _is_exhibit(e: Column) -> Column:
    return ~e.isin(NOT_EXHIBIT) & ~F.substring_index(e, "-", 1).isin(DOC_SERIES)


def exhibits(c: Column, series: tuple[str, ...] = SERIES) -> Column:
    """Array of the distinct exhibits that a text names; K is also read without a hyphen."""
    text, p = F.coalesce(c, F.lit("")), id_pattern(series)
    named = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: canon(*(F.regexp_extract(m, p, k) for k in (1, 2, 3))))
    found = F.filter(named, _is_exhibit)
    if "K" in series:
        k = F.transform(F.regexp_extract_all(text, F.lit(K_SERIES), F.lit(0)), lambda m: canon(F.lit("K"), F.regexp_extract(m, K_SERIES, 1), F.regexp_extract(m, K_SERIES, 2)))
        found = F.concat(found, k)
    return F.array_distinct(found)


def exhibit_of_file(name: Column, series: tuple[str, ...] = SERIES) -> Column:
    """The exhibit that a file's name stands for: at its start, else anywhere in its first 50 characters; else null."""
    lenient, strict = file_pattern(series), id_pattern(series)
    head = F.substring(name, 1, 50)
    of = lambda s, p: F.when(s.rlike(p), canon(*(F.regexp_extract(s, p, k) for k in (1, 2, 3))))
    return F.coalesce(of(name, lenient), of(head, strict))


def canon_form(c: Column) -> Column:
    """A form's name in upper case, with a hyphen after its letters."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[–—]", "-"), r"^([A-Z]{1,3})(\p{Nd})", "$1-$2")


def forms(c: Column) -> Column:
    """Array of the distinct forms that a text names."""
    p = rf"(?iu)Forms?{T.SPACE}+{FORM}"
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(1)), canon_form))


def form_of_file(name: Column) -> Column:
    found = F.regexp_extract(name, rf"(?iu)^{FORM}", 1)
    return F.when(found != "", canon_form(found))


def urls(c: Column) -> Column:
    """Array of the urls of a text, without trailing points and brackets, the first of each in any case."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,)")))
    return F.filter(found, lambda u, i: F.array_position(F.transform(found, F.lower), F.lower(u)) == i + 1)
