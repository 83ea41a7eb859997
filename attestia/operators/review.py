"""Answers of reviewers: whether they are whole, what they cite, how far their quotations can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.functions import extract as X
from attestia.functions import text as T
from attestia.operators import provenance
from attestia.plans import verdicts, verify

# Codes of failures and of faults of quality, and the code that tells of the instrument alone.
FAILURES = [
    "BINARY_NOT_FOUND", "TIMED_OUT", "EMPTY_ANSWER", "NO_END_MARKER", "TOO_SHORT", "TRANSPORT_ERROR", "KEY_NOT_SET", "MODEL_NOT_SET", "HTTP_ERROR", "POLICY_REFUSAL",
]
QUALITY = {"lookalike": "GOV_LOOKALIKE_CITED", "snapshot": "DATED_EDITION_CITED", "nonauthoritative": "COMMENTARY_CITED"}
INSTRUMENT_ONLY = ["NO_TELEMETRY"]
# How an answer declines; how a question leads; when a text must be asked for whole, and how that is done.
REFUSAL = (
    r"(?iu)\b(?:i (?:can'?t|cannot|am unable to|won'?t) (?:help|assist|provide|continue|comply)|i'?m (?:not able|unable) to (?:help|assist|provide)"
    r"|(?:this|that) (?:request|content) violates|against my (?:guidelines|policies)|i must decline)\b"
)
ANCHORS = {
    "invites yes or no": r"(?iu)\bis there (?:a|an|any) .{0,60}\b(rule|requirement|provision|exception)\b",
    "false dichotomy": rf"(?iu)\b(?:does|do|is|are|has|have) .{{0,80}}\?{T.SPACE}*(?:Or only|Or just|Or is it)",
    "asks for agreement": r"(?iu)\bam I right that\b|\bis it true that\b|\bconfirm that\b",
    "quotation supports one answer": rf"[«\"“][^»\"”]{{20,}}[»\"”]{T.SPACE}*[-—]{T.SPACE}*(?:what does|is this|does this)",
    "rhetorical framing": r"(?iu)\breally\b.{0,20}\?|\bactually\b.{0,20}\?",
}
IN_FULL = r"(?iu)all (?:of the )?(?:paragraphs|subsections|text) .{0,30}in full|quote the (?:entire|whole) (?:section|provision|paragraph)|ЦЕЛИКОМ|все абзацы"
HANDS_A_TEXT = (
    rf"(?iu)\b\p{{Nd}}+{T.SPACE}*(?:U\.?S\.?C\.?|C\.?F\.?R\.?)\b|§|\bMatter of [A-Z]|\bsections?{T.SPACE}+\p{{Nd}}+[\p{{L}}\p{{N}}_.\-()]*|[«\"“][^»\"”]{{25,}}[»\"”]"
)


def anchor_warnings(brief: Column) -> Column:
    """Array of what is wrong with a brief: questions that lead, and a legal text that is handed over without asking for
    the whole of it."""
    text = F.coalesce(brief, F.lit(""))
    tests = [F.when(text.rlike(p), F.lit(name)) for name, p in ANCHORS.items()]
    tests.append(F.when(text.rlike(HANDS_A_TEXT) & ~text.rlike(IN_FULL), F.lit("not asked in full")))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def failures(text: Column, marker: Column, floor: int) -> Column:
    """Array of an answer's failures: empty, without its end mark, too short, or a refusal in place of a review (a refusal
    in an answer of twice the floor is a caveat)."""
    t = T.strip(F.coalesce(text, F.lit("")))
    n = F.char_length(t)
    empty = n == 0
    found = F.array(
        F.when(empty, "EMPTY_ANSWER"), F.when(~empty & (F.coalesce(marker, F.lit("")) != "") & ~t.endswith(F.coalesce(marker, F.lit(""))), "NO_END_MARKER"),
        F.when(~empty & (n < floor), "TOO_SHORT"), F.when(~empty & t.rlike(REFUSAL) & (n < 2 * floor), "POLICY_REFUSAL"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def answer_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def grounding(answers: DataFrame, key: str, text_col: str, primary: list[str], secondary: list[str], snapshot: list[str]) -> DataFrame:
    """(key, urls, and one count for each class of url): what an answer cites, each url once. An answer without urls has a
    row of zeros."""
    cited = answers.select(key, F.explode_outer(X.urls(F.col(text_col))).alias("url"))
    classed = cited.withColumn("class", F.when(F.col("url").isNotNull(), provenance.classify(F.col("url"), primary, secondary, snapshot)))
    counts = [F.count_if(F.col("class") == c).alias(c) for c in provenance.CLASSES]
    return classed.groupBy(key).agg(F.count("url").alias("urls"), *counts)


def unknown_hosts(answers: DataFrame, text_col: str, primary: list[str], secondary: list[str], snapshot: list[str], most: int = 25) -> DataFrame:
    """(host, more): the first hosts by name that no list knows, and how many there are beyond them."""
    cited = answers.select(F.explode(X.urls(F.col(text_col))).alias("url"))
    other = cited.where(provenance.classify(F.col("url"), primary, secondary, snapshot) == "other").select(T.host(F.col("url")).alias("host")).distinct()
    total = other.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return other.orderBy("host").limit(most).crossJoin(F.broadcast(total))  # one row


def triage(answers: DataFrame, key: str, text_col: str, failures_: Column, quality: Column, grounds: DataFrame) -> DataFrame:
    """(key, verdict, quality): FAILED with a failure; DIRTY with a fault of quality that is the answer's own; else OK.

    quality is what is known beforehand; the classes of the cited urls, and that there are none, add to it.
    """
    rows = answers.select(key, F.col(text_col).alias("__text"), failures_.alias("__failures"), quality.alias("__quality")).join(grounds, key, "left")
    cited = [F.when(F.col(c) > 0, F.lit(code)) for c, code in QUALITY.items()]
    bare = F.when((F.coalesce("urls", F.lit(0)) == 0) & (T.strip(F.coalesce("__text", F.lit(""))) != ""), F.lit("NO_URLS_CITED"))
    codes = F.concat(F.coalesce("__quality", F.array().cast("array<string>")), F.filter(F.array(*cited, bare), lambda x: x.isNotNull()))
    own = F.size(F.filter(codes, lambda x: ~x.isin(INSTRUMENT_ONLY))) > 0
    verdict = F.when(F.size(F.coalesce("__failures", F.array().cast("array<string>"))) > 0, "FAILED").when(own, "DIRTY").otherwise("OK")
    return rows.select(key, verdict.alias("verdict"), codes.alias("quality"))


def channels(registry: DataFrame, only: list[str] = (), skip: list[str] = ()) -> DataFrame:
    """The channels (name, enabled) that a round asks: enabled ones, or those named, without those skipped; names that begin
    with an underscore are comments."""
    named = ~F.col("name").startswith("_") & ~F.col("name").isin(list(skip))
    return registry.where(named & (F.col("name").isin(list(only)) if only else F.coalesce(F.col("enabled"), F.lit(True))))


def audit_answers(answers: DataFrame, key: str, text_col: str, docs: DataFrame, doc_id: str, doc_text: str, least: int = 45) -> DataFrame:
    """(answer, quote, verdict, class, doc_ord, detail, audit_rank): every quotation of every answer against the corpus."""
    said = answers.select(F.col(key).alias("answer"), F.explode(X.quotations(F.col(text_col), least)).alias("quote"))
    asked = said.withColumn("__id", F.struct("answer", "quote"))
    found = verify.check(asked, docs, "__id", "quote", doc_id, doc_text)
    rank = verdicts.rank_of(F.col("verdict"), verdicts.AUDIT_ORDER)
    return found.select("q.answer", "q.quote", "verdict", "class", "doc_ord", "detail", rank.alias("audit_rank"))


def reviewer_totals(audited: DataFrame) -> DataFrame:
    """(answer, total, clean, note): none clean asks for a look at the corpus; over 30 % flagged, for one at each of them."""
    clean = F.count_if(F.col("class") == "CLEAN")
    rows = audited.groupBy("answer").agg(F.count("*").alias("total"), clean.alias("clean"))
    note = F.when(F.col("clean") == 0, "check the corpus first").when(F.col("total") - F.col("clean") > 0.3 * F.col("total"), "read every flagged one").otherwise("")
    return rows.withColumn("note", note)


def analytics(triaged: DataFrame, grounds: DataFrame, key: str) -> DataFrame:
    """One row for each answer: its verdict, faults and what it cites."""
    return triaged.join(grounds, key, "left")


def any_code(codes: Column, wanted: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.array_contains(codes, c) for c in wanted], F.lit(False))
