"""The seventeen verdicts: their order in reports, class, mark and labels, as a table and as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The verdicts in report order, each with its class and mark.
VERDICTS = {
    "TRUNCATED_CONDITION": ("DANGEROUS", "!!"), "TRUNCATED_OPENING": ("DANGEROUS", "!!"), "OPERATOR": ("DANGEROUS", "!!"), "SPLICED": ("DANGEROUS", "!!"),
    "FOUND_ELSEWHERE": ("DANGEROUS", "!!"), "SUPERSEDED_EDITION": ("DANGEROUS", "!!"), "ELLIPSIS_HIDES": ("DANGEROUS", "! "), "NOT_FOUND": ("DANGEROUS", "! "),
    "NO_SOURCE_ON_DISK": ("UNCHECKABLE", "? "), "PARTIAL": ("DANGEROUS", "! "), "ALTERED": ("DANGEROUS", "! "), "SCATTERED": ("DANGEROUS", "  "),
    "WRONG_SPEAKER": ("CLEAN", "~ "), "PUNCTUATION": ("CLEAN", "  "), "TYPESETTING": ("CLEAN", "~ "), "ASSEMBLED": ("CLEAN", "  "), "VERIFIED": ("CLEAN", "OK"),
}
#: What each verdict tells its reader.
MEANINGS = {
    "TRUNCATED_CONDITION": "the source goes on with a clause that limits these words", "TRUNCATED_OPENING": "a negation stands just before these words",
    "OPERATOR": "a word that carries the sentence was changed", "SPLICED": "the parts exist, but in no one document in this order",
    "FOUND_ELSEWHERE": "the words are real, but not at the address beside them", "SUPERSEDED_EDITION": "the words are in an edition that a newer one replaces",
    "ELLIPSIS_HIDES": "what was left out narrows the rule", "NOT_FOUND": "these words are nowhere in the corpus",
    "NO_SOURCE_ON_DISK": "the cited source is not in the corpus; nothing was checked", "PARTIAL": "some of the words are there, others are not",
    "ALTERED": "it begins as the source does and ends otherwise", "SCATTERED": "every sentence is there, but they do not stand together",
    "WRONG_SPEAKER": "the source recites someone else here", "PUNCTUATION": "the same words with other punctuation", "TYPESETTING": "the copy in the corpus is broken by a line end",
    "ASSEMBLED": "parts in order, and nothing that matters was left out", "VERIFIED": "word for word",
}
# The verdicts that an address may still turn, and those that show a provision as safe in one place.
ADDRESS_CLEAN = ("VERIFIED", "PUNCTUATION", "TYPESETTING", "ASSEMBLED", "SCATTERED")
#: The order of an audit of answers, which knows fewer verdicts; others come last.
AUDIT_ORDER = [v for v in VERDICTS if v not in ("FOUND_ELSEWHERE", "SUPERSEDED_EDITION", "NO_SOURCE_ON_DISK")]


def table(spark: SparkSession) -> DataFrame:
    """(verdict, rank, class, mark, label, meaning) of all verdicts."""
    rows = [(v, k, c, m, v.replace("_", " ").lower(), MEANINGS[v]) for k, (v, (c, m)) in enumerate(VERDICTS.items())]
    return spark.createDataFrame(rows, "verdict string, rank int, class string, mark string, label string, meaning string")


def _mapped(verdict: Column, values: dict, default) -> Column:
    return reduce(lambda c, x: F.when(verdict == x[0], F.lit(x[1])).otherwise(c), values.items(), F.lit(default))


def class_of(verdict: Column) -> Column:
    return _mapped(verdict, {v: c for v, (c, _) in VERDICTS.items()}, None)


def rank_of(verdict: Column, order: list[str] | None = None) -> Column:
    """Place in the order, 99 for a verdict that it does not hold."""
    return _mapped(verdict, {v: k for k, v in enumerate(order or list(VERDICTS))}, 99)


def is_in(verdict: Column, class_: str) -> Column:
    return verdict.isin([v for v, (c, _) in VERDICTS.items() if c == class_])
