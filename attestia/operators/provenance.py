"""Where a text comes from: failed downloads, our own output, classes of urls, and the trust that these carry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.functions.text import SPACE as S
from attestia.functions.text import host, strip

#: The stamp that our reports carry in their first 400 characters.
STAMP = "ATTESTIA-TOOL-OUTPUT"
# Names of files that are someone's work on sources, not sources.
DERIVED = (
    r"ANALYSIS|SUMMARY|DIGEST|NOTES?|OUTLINE|CHECKLIST|STRATEG|MEMO|BRIEF|REVIEW|DRAFT|REPORT|OUR-|РАЗБОР|АНАЛИЗ|ВЫПИСКА|СВОДКА|ЗАМЕТ|конспект|ЧЕК-ЛИСТ"
    r"|СТРАТЕГИ|ПРОВЕРКА|ИТОГ|отч[её]т|бриф|рецензи|наш[аи]?-"
)
# What a failed download says, in a text small enough to be one, and where it is nearly all the text says.
FAILED = (
    rf"(?iu)(?:\b40[0-9]{S}+(?:not{S}+found|forbidden|bad{S}+request|unauthorized)\b|\b50[0-9]{S}+(?:internal{S}+server{S}+error|service{S}+unavailable|bad{S}+gateway)\b"
    rf"|\bthe{S}+requested{S}+(?:url|page|resource)\b[^.]{{0,80}}?\b(?:was{S}+)?not{S}+(?:be{S}+)?found\b|\byou{S}+(?:do{S}+not|don't){S}+have{S}+permission{S}+to{S}+(?:access|view|open|see)\b"
    rf"|\benable{S}+javascript\b|\bjavascript{S}+is{S}+(?:required|disabled)\b|\bjust{S}+a{S}+moment\b|\bchecking{S}+your{S}+browser\b|\bverify{S}+you{S}+are{S}+(?:a{S}+)?human\b"
    rf"|\bare{S}+you{S}+a{S}+robot\b|\bunusual{S}+traffic\b|\brate{S}*limit{S}+exceeded\b|\bloading{S}+document\b|\bplease{S}+wait{S}+while\b|\bthis{S}+page{S}+has{S}+moved\b)"
)
AMBIGUOUS = rf"(?iu)\b(?:access{S}+denied|permission{S}+denied|page{S}+not{S}+found|not{S}+found|forbidden|unauthorized)\b"
SMALL, TINY = 4000, 60
# Labels that official hosts alone should wear.
OFFICIAL = ["gov", "mil", "govt", "gouv", "gob", "govuk"]
# The trust of each class, and the lists that a download is judged by.
TRUST = {"primary": ("OFFICIAL", 3), "snapshot": ("OFFICIAL BUT DATED", 2), "nonauthoritative": ("SECONDARY", 1), "unknown": ("UNKNOWN", 0), "lookalike": ("REFUSED", -1)}
FETCH_SNAPSHOT = ("/annual/", "govinfo.gov/content/pkg/cfr-")
FETCH_SECONDARY = ("law.cornell.edu", "justia.com", "courtlistener.com", "casetext.com")
CLASSES = ["primary", "snapshot", "lookalike", "nonauthoritative", "other"]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def placeholder(text: Column) -> Column:
    """A failed download: a phrase of one in a text of at most 4,000 characters, two different ones in a longer text, or
    an ambiguous phrase in at most 60 characters."""
    t = strip(F.coalesce(text, F.lit("")))
    hits = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(FAILED), F.lit(0)), F.lower))
    n = F.char_length(t)
    return ((n <= SMALL) & t.rlike(FAILED)) | ((n > SMALL) & (F.size(hits) >= 2)) | ((n <= TINY) & t.rlike(AMBIGUOUS))


def stamped(text: Column, stamps: tuple[str, ...] = (STAMP,)) -> Column:
    head = F.substring(F.coalesce(text, F.lit("")), 1, 400)
    return any_of([F.contains(head, F.lit(s)) for s in stamps])


def audit(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, bucket): empty, placeholder, short (indexed all the same) or indexed."""
    n = F.char_length(strip(F.coalesce(F.col(text_col), F.lit(""))))
    bucket = F.when(n == 0, "empty").when(placeholder(F.col(text_col)), "placeholder").when(n < 200, "short").otherwise("indexed")
    return docs.select(id_col, bucket.alias("bucket"))


def _entry(e: str) -> str:
    return e.lower().strip().lstrip(".")


def under(host_: Column, domain: str) -> Column:
    """The domain itself or a name under it, at a label's bound."""
    e = _entry(domain)
    return (host_ == e) | host_.endswith("." + e) if e else F.lit(False)


def path(url: Column) -> Column:
    """The path of a lower-cased url, without query and fragment; that of a url without a scheme is what follows its name."""
    rest = F.regexp_replace(strip(F.coalesce(url, F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def agencies(primary: list[str]) -> list[str]:
    """The first labels of official domains with more than one label, of three letters or more."""
    names = [e.removeprefix("www.") for e in map(_entry, primary)]
    return sorted({n.split(".")[0] for n in names if "." in n and len(n.split(".")[0]) > 2} - {*OFFICIAL, "www"})


def lookalike(host_: Column, primary: list[str]) -> Column:
    """An official label, or an official body's name, as a whole part of a host that is not official."""
    parts = F.concat(F.split(host_, r"[.\-]", -1), F.split(host_, r"\.", -1))
    worn = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in [*OFFICIAL, *agencies(primary)]]))
    return (host_ != "") & ~any_of([under(host_, p) for p in primary]) & worn


def _fits(host_: Column, path_: Column, entry: str) -> Column:
    """A host, or a host and a part of the path behind it."""
    name, slash, rest = _entry(entry).partition("/")
    return under(host_, name) & F.contains(path_, F.lit("/" + rest)) if slash else under(host_, name)


def classify(url: Column, primary: list[str], secondary: list[str], snapshot: list[str] = ()) -> Column:
    """lookalike, snapshot, primary, nonauthoritative or other, asked in this order.

    A snapshot's entry that names a host stands for itself; one that does not (``/annual/``, ``?date=``) only qualifies a
    url of a host that is primary or secondary.
    """
    low = F.lower(strip(F.coalesce(url, F.lit(""))))
    h, p = host(low), path(low)
    is_primary, is_secondary = any_of([under(h, e) for e in primary]), any_of([_fits(h, p, e) for e in secondary])
    dated = []
    for e in map(str.strip, map(str.lower, snapshot)):
        if e and "." in e.split("/")[0]:
            dated.append(_fits(h, p, e))
        elif e:
            dated.append((is_primary | is_secondary) & F.contains(low, F.lit(e)))
    return F.when(lookalike(h, primary), "lookalike").when(any_of(dated), "snapshot").when(is_primary, "primary").when(is_secondary, "nonauthoritative").otherwise("other")


def trust(url: Column, primary: list[str]) -> Column:
    """The class of a download's url, by the lists for downloads; what is in none of them is unknown."""
    found = classify(url, primary, list(FETCH_SECONDARY), list(FETCH_SNAPSHOT))
    return F.when(found == "other", "unknown").otherwise(found)


def trust_rank(level: Column) -> Column:
    return reduce(lambda c, x: F.when(level == x[0], F.lit(x[1][1])).otherwise(c), TRUST.items(), F.lit(0))


def trust_label(level: Column) -> Column:
    return reduce(lambda c, x: F.when(level == x[0], F.lit(x[1][0])).otherwise(c), TRUST.items(), F.lit("UNKNOWN"))


def worse(one: Column, other: Column) -> Column:
    """The lower of two levels of trust; the first where they are equal."""
    return F.when(trust_rank(one) <= trust_rank(other), one).otherwise(other)


def fetch_decision(url: Column, final_url: Column, status: Column, body: Column, primary: list[str], allow_unknown: bool = False) -> Column:
    """What becomes of a landed download: keep, or why not: a lookalike before or after redirects, an unknown host, an error
    status, no body, or a body that is a failed download."""
    first, last = trust(url, primary), trust(F.coalesce(final_url, url), primary)
    refused = F.when((first == "lookalike") | (last == "lookalike"), "refused: lookalike")
    if not allow_unknown:
        refused = refused.when((first == "unknown") | (last == "unknown"), "refused: unknown host")
    text = F.coalesce(body, F.lit(""))
    return refused.when(status != 200, "rejected: status").when(strip(text) == "", "rejected: empty").when(placeholder(text), "rejected: placeholder").otherwise("keep")


def file_name(url: Column, content_type: Column) -> Column:
    """A name that keeps its extension, as that chooses the reader; the query goes into the stem."""
    types = {"application/pdf": ".pdf", "text/html": ".html", "text/plain": ".txt", "application/xml": ".xml", "text/xml": ".xml", "application/json": ".json"}
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    by_type = reduce(lambda c, x: F.when(kind == x[0], F.lit(x[1])).otherwise(c), types.items(), F.lit(".txt"))
    last = F.regexp_extract(path(url), r"([^/]*)/*$", 1)
    last = F.when(F.regexp_extract(path(url), r"([^/]*)$", 1) != "", last).otherwise(F.coalesce(F.nullif(host(url), F.lit("")), F.lit("download")))
    ext = F.regexp_extract(last, r"[^.](\.[^.]*)$", 1)
    stem = F.when(ext != "", F.expr("true")).otherwise(F.lit(False))
    stem = F.when(stem, F.substring(last, F.lit(1), F.char_length(last) - F.char_length(ext))).otherwise(last)
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    stem = F.concat(stem, F.when(query != "", F.concat(F.lit("-"), F.substring(safe(query), 1, 60))).otherwise(""))
    clean = F.coalesce(F.nullif(F.btrim(safe(stem), F.lit("-")), F.lit("")), F.lit("download"))
    return F.substring(F.concat(F.substring(clean, 1, 110), F.when(ext != "", ext).otherwise(by_type)), 1, 120)
