"""Damaged quotations, to test the verifier: each mutation changes the first place it fits, or gives nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions import text as T

# Modals that a negation is put behind; clauses that are cut off; words and their tame synonyms.
MODAL = r"(?<!{0})(?iu:shall|may|must|will|does|do|is|are)(?!{0})(?!{1}+(?iu:not))"
CUT = rf",{T.SPACE}*(?iu:but|except|unless|provided|however)(?!{T.WORD})"
SYNONYMS = [
    (" apply ", " request "), (" prior to ", " before "), (" alien ", " applicant "), (" pursuant to ", " according to "), (" upon ", " on "), (" shall ", " will "),
    (" must ", " has to "), (" may not ", " cannot "),
]
TAIL = " in accordance with applicable law"
#: Word characters of engines that know ASCII's alone, as RE2 does: to them a modal may stand behind an accented letter.
ASCII_WORD = "[0-9A-Za-z_]"
# The verdicts that count as caught, where not every dangerous one does.
CAUGHT = {"cut-condition": ["TRUNCATED_CONDITION", "TRUNCATED_OPENING"], "splice": ["SPLICED", "ELLIPSIS_HIDES", "ALTERED", "FOUND_ELSEWHERE"]}


def _swap(text: Column, old: str, new: str) -> Column:
    """The first old as new; null where there is none."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.char_length(text))))


def mutant(text: Column, kind: str, word: str = T.WORD) -> Column:
    """The damaged text; null where the mutation does not apply. word is what a modal may not be next to."""
    if kind == "insert-operator":
        modal = MODAL.format(word, T.SPACE)
        return F.when(text.rlike(modal), F.regexp_replace(text, rf"(?s)\A(.*?{modal})", "$1 not"))
    if kind == "drop-negation":
        return _swap(text, " not ", " ")
    if kind == "digit":
        digit = F.regexp_extract(text, "[0-9]", 0)
        other = F.when(digit != "", ((F.when(digit != "", digit).cast("int") + 5) % 10).cast("string"))
        at = F.instr(text, digit)
        return F.when(digit != "", F.concat(F.substring(text, F.lit(1), at - 1), other, F.substring(text, at + 1, F.char_length(text))))
    if kind == "tail":
        words = F.split(T.collapse(text), " ")
        return F.when(F.size(words) >= 16, F.concat(F.array_join(F.slice(words, F.lit(1), F.size(words) - 6), " "), F.lit(TAIL)))
    if kind == "cut-condition":
        head = F.regexp_extract(text, rf"(?s)\A(.{{45,}}?){CUT}", 1)
        return F.when(head != "", F.rtrim(head, F.lit(" ,;")))
    if kind == "synonym":
        return F.coalesce(*[_swap(text, a, b) for a, b in SYNONYMS])
    raise ValueError(kind)


KINDS = ("insert-operator", "drop-negation", "digit", "tail", "cut-condition", "synonym")


def apply(rows: DataFrame, id_col: str, text_col: str, kind: str, word: str = T.WORD) -> DataFrame:
    """(id_col, mutant) of the rows that the mutation applies to."""
    return rows.select(id_col, mutant(F.col(text_col), kind, word).alias("mutant")).where("mutant IS NOT NULL")


def base(verified: DataFrame, text_col: str, doc_col: str) -> DataFrame:
    """Quotations fit for damage: found in a document, of 60 to 420 characters and 12 words or more, without an ellipsis."""
    text = F.col(text_col)
    length = F.char_length(text)
    fit = F.col(doc_col).isNotNull() & length.between(60, 420) & (F.size(F.split(T.collapse(text), " ")) >= 12) & ~F.contains(text, F.lit("...")) & ~F.contains(text, F.lit("…"))
    return verified.where(fit)


def bank(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(base_id, mutation, mutant) of all mutations that apply; a mutant that normalises to its base is none."""
    made = F.array(*[F.struct(F.lit(k).alias("mutation"), mutant(F.col(text_col), k).alias("mutant")) for k in KINDS])
    flat = rows.select(F.col(id_col).alias("base_id"), F.col(text_col).alias("__base"), F.explode(made).alias("x")).where("x.mutant IS NOT NULL")
    same = F.lower(T.normalise(F.col("x.mutant"))) == F.lower(T.normalise(F.col("__base")))
    return flat.where(~same).select("base_id", "x.mutation", "x.mutant")


def splices(rows: DataFrame, id_col: str, text_col: str, doc_col: str, series_col: str | None = None) -> DataFrame:
    """(base_id, mutation, mutant): each quotation joined by an ellipsis with the first of its next five that is from
    another document. Order is by id, within each value of series_col; without one, all rows are one series."""
    window = Window.partitionBy(*([series_col] if series_col else [F.lit(0)])).orderBy(id_col)
    following = [F.struct(F.lead(text_col, k).over(window).alias("text"), F.lead(doc_col, k).over(window).alias("doc")) for k in range(1, 6)]
    other = F.get(F.filter(F.array(*following), lambda x: x["doc"].isNotNull() & (x["doc"] != F.col(doc_col))), F.lit(0))
    found = rows.withColumn("__next", other).where("__next IS NOT NULL")
    return found.select(F.col(id_col).alias("base_id"), F.lit("splice").alias("mutation"), F.concat(F.col(text_col), F.lit(" ... "), F.col("__next.text")).alias("mutant"))


def caught(mutation: Column, verdict: Column, dangerous: list[str]) -> Column:
    """Whether a verdict counts for a mutation."""
    return reduce(lambda c, x: F.when(mutation == x[0], verdict.isin(x[1])).otherwise(c), CAUGHT.items(), verdict.isin(dangerous))


def report(judged: DataFrame, dangerous: list[str]) -> DataFrame:
    """(mutation, applicable, caught, missed, rate, examples) of judged mutants (mutation, mutant, verdict); examples are
    the first three missed ones by text. A row for all mutations together has a null mutation."""
    hit = caught(F.col("mutation"), F.col("verdict"), dangerous)
    rows = judged.withColumn("__hit", hit)
    first = Window.partitionBy("mutation").orderBy("mutant")
    shown = rows.where(~F.col("__hit")).withColumn("__rank", F.row_number().over(first)).where("__rank <= 3")
    shown = shown.groupBy("mutation").agg(F.sort_array(F.collect_list(F.struct("mutant", "verdict"))).alias("examples"))
    counted = rows.rollup("mutation").agg(F.count("*").alias("applicable"), F.count_if("__hit").alias("caught"), F.count_if(~F.col("__hit")).alias("missed"))
    counted = counted.withColumn("rate", F.round(100 * F.col("caught") / F.col("applicable"), 1))
    return counted.join(F.broadcast(shown), "mutation", "left")
