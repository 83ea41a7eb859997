"""Text functions as Column expressions: the same on sources and on quotations."""

from __future__ import annotations

import html
import html.entities
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters folded before comparison, each to the one below it; then those dropped.
FOLD_FROM = "“”«»„‘’‚–—−    "
FOLD_TO = "\"\"\"\"\"'''---    "
DROPPED = "﻿​‌‍"
#: White space as a regex class: ASCII's, the separators U+001C to U+001F, and Unicode's.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
WORD = r"[\p{L}\p{N}_]"
ELLIPSIS = rf"\.{SPACE}?\.{SPACE}?\.|…"
TAIL_ELLIPSIS = rf"(?:{ELLIPSIS}){SPACE}*[»\"'”)\]]*{SPACE}*\z"
PAGE_MARK = rf"\[\[Page{SPACE}+(?:{WORD}|[.-])+\]\]"
# A link; a mark of text left out (asterisks apart, next to no word or asterisk); tags that a brief asks for.
LINK = r"\[([^\]\n]{1,200})\]\((?:https?:|/|#)[^)\n]*\)"
OMISSION = r"(?<![*\p{L}\p{N}_])\*(?:[ \t\u00A0\u2007\u202F\r\n]+\*){1,8}(?![*\p{L}\p{N}_])"
TAGS = r"(?iu)\[(?:OPENED|SNIPPET|MEMORY|RETRIEVED|UNVERIFIED|ОТКРЫЛ|СНИППЕТ|ПАМЯТЬ|sic|so in original|так в источнике)\]"


def _sub(c: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip_invisibles(c: Column) -> Column:
    """Without soft hyphens, a line end after one included, and without zero-width characters."""
    return F.translate(_sub(c, ("­[ \\t]*\\r?\\n[ \\t]*", ""), ("­", "")), DROPPED, "")


def normalise(c: Column) -> Column:
    """Typography folded, page marks and invisibles out, line-end hyphens joined, white space collapsed. Null is empty."""
    folded = F.replace(F.translate(F.coalesce(c, F.lit("")), FOLD_FROM + DROPPED, FOLD_TO), F.lit("…"), F.lit("..."))
    marked = _sub(folded, (PAGE_MARK, " "))
    return collapse(_sub(strip_invisibles(marked), (rf"({WORD})-[ \t]*\r?\n[ \t]*", "$1-")))


def alnum(c: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))


def dehyph(c: Column) -> Column:
    """Hyphens between word characters healed, first those before white space."""
    return _sub(F.coalesce(c, F.lit("")), (rf"({WORD})-{SPACE}+({WORD})", "$1$2"), (rf"({WORD})-({WORD})", "$1$2"))


def strip_scrape(c: Column) -> Column:
    """Sources: footnote links of two kinds out, other links as their text."""
    return _sub(
        F.coalesce(c, F.lit("")), (rf"(?i){SPACE}*\[.{{0,24}}?\]\([^)]*#footnote[^)]*\)", ""),
        (rf"{SPACE}*\[(?:\*\*|\\)*\[?\p{{Nd}}{{1,3}}\]?(?:\*\*|\\)*\]\([^)]*\)", ""), (rf"(?i){SPACE}*\[link\]\([^)]*\)", ""), (LINK, "$1"),
    )


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def _unwrapped(c: Column) -> Column:
    """One layer of quotation marks off: both, an opening one alone, or a closing one alone that is no straight one."""
    return F.regexp_replace(strip(c), r"(?s)\A(?:[\"«“„](.+)[\"»”]|[\"«“„](..+)|(..+)[»”])\z", "$1$2$3")


def strip_markdown(c: Column) -> Column:
    """A quotation without links, emphasis, tags, quote marks of lines, and up to four layers of quotation marks. Marks of
    text left out stay as they are: they are cut out, the rest is cleaned around a placeholder, and they return."""
    c = F.coalesce(c, F.lit(""))
    marks, hole = F.regexp_extract_all(c, F.lit(OMISSION), F.lit(0)), "\x00"
    clean = _sub(F.array_join(F.split(c, OMISSION, -1), hole), (LINK, "$1"), (r"\*\*|__|\*|`", ""), (rf"{SPACE}*" + TAGS[5:], ""), (rf"(?md)^{SPACE}*>{SPACE}?", ""))
    for _ in range(4):
        clean = _unwrapped(clean)
    pieces = F.split(strip(clean), hole, -1)
    return F.array_join(F.zip_with(pieces, marks, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


#: Everything that a quotation passes through before it is compared; ``verify`` calls it itself.
prepare_quote = strip_markdown


def clean_markdown(c: Column) -> Column:
    """A Markdown source: footnote links as spaces, other links as their text, brackets without backslashes."""
    footnote, link = r"\[\\?\[[^\]]*\\?\]\]\([^)]*\)", r"\[([^\]\n]*)\]\([^)\n]*\)"
    return _sub(F.coalesce(c, F.lit("")), (footnote, " "), (link, "$1"), (r"\\([\[\]])", "$1"))


def strip_page_marks(c: Column) -> Column:
    return _sub(F.coalesce(c, F.lit("")), (PAGE_MARK, " "))


def ellipsis_parts(c: Column, least: int = 25) -> Column:
    """The parts between ellipses, edges stripped, of at least so many characters."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ELLIPSIS, -1), lambda p: F.btrim(p, F.lit(" .,;:-—")))
    return F.filter(parts, lambda p: F.char_length(p) >= least)


def _share(c: Column, kept: str) -> Column:
    letters = F.regexp_replace(F.coalesce(c, F.lit("")), r"\P{L}", "")
    n = F.char_length(letters)
    return F.when(n > 0, F.char_length(F.regexp_replace(letters, kept, "")) / n).otherwise(F.lit(0.0))


def latin_share(c: Column) -> Column:
    """ASCII letters among all letters; 0 without letters."""
    return _share(c, "[^A-Za-z]")


def mostly_cyrillic(c: Column, threshold: float = 0.4) -> Column:
    return _share(c, "[^Ѐ-ӿ]") > threshold


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def _closed(m: re.Match) -> str:
    return html.unescape(m[0]) if m[1].startswith("#") else html.entities.html5.get(m[1] + ";", m[0])


@F.pandas_udf(StringType())
def _unescaped_closed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: re.sub(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", _closed, t), na_action="ignore")


def html_text(c: Column, entities: bool = True, closed: bool = False) -> Column:
    """Without script and style bodies; tags as spaces; entities as their characters, in Python where a text has any. HTML
    knows some without their semicolon; with closed, these stay as they are."""
    text = _sub(F.coalesce(c, F.lit("")), (r"(?is)<(script|style)[^>]*>.*?</\1>", " "), (r"<[^>]+>", " "))
    return F.coalesce((_unescaped_closed if closed else _unescaped)(F.when(F.contains(text, F.lit("&")), text)), text) if entities else text


def host(url: Column) -> Column:
    """In lower case, without user, port, brackets and final dots; also of urls without a scheme; empty without a host."""
    whole = strip(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(whole, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    name = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    bare = F.when(name.startswith("["), F.regexp_extract(name, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(name, r"^([^:]*)", 1))
    return F.rtrim(F.lower(bare), F.lit("."))


def alpha_tokens(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]+"))


def sentences(c: Column, least: int = 40) -> Column:
    """Cut after a full stop, semicolon or colon before a capital or an opening bracket; long ones alone."""
    cut = F.split(c, rf"(?<=[.;:]){SPACE}+(?=[A-Z(])", -1)
    return F.filter(F.transform(cut, collapse), lambda s: F.char_length(s) >= least)


def samples(c: Column, words: int = 6, most: int = 9) -> Column:
    """Shingles at an even stride, at most so many."""
    tokens = F.split(collapse(c), " ")
    n = F.size(tokens) - words + 1
    step = F.greatest(F.lit(1), F.floor(n / most).cast("int"))
    starts = F.when(n > 0, F.slice(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i % step == 0), 1, most))
    return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, words), " ")), F.array().cast("array<string>"))
