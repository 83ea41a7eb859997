"""The library of sources: intake, editions, the bank of quotations and its queue, the index against the disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions import extract as X
from attestia.functions import text as T
from attestia.operators import provenance, reconcile
from attestia.plans import verdicts

#: Quotations of a turn that are checked, and lines that a log keeps.
PER_TURN, LOG_LINES = 40, 200
# Characters below which a quotation is in no bank, and a file proves nothing.
LEAST_BANKED, LEAST_PROOF = 40, 2000


def intake(inbox: DataFrame, registry: DataFrame, primary: list[str]) -> DataFrame:
    """inbox with key, trust, status, revision and supersedes: what becomes of each landed file.

    inbox: (name, text, sha256, url, claimed_trust, model_in_path, keys), keys an array of arrays of strings, the smallest
    of which files the source; registry: (key, path, sha256, revision), the latest edition of each key. In this order:
    REFUSED where a model stood in the path, NO ADDRESS, UNREADABLE (under 200 characters), REFUSED for a lookalike host,
    ALREADY HAVE (the same bytes), REVISION (numbered, the former one is kept), else added. Trust is the worse of what was
    claimed and what the url shows now. Several files of one key in an inbox: the first by name goes first, the others are
    LATER, for the next intake.
    """
    key = F.array_join(F.array_min("keys"), "|")
    shown = F.when(F.coalesce(F.col("url"), F.lit("")) != "", provenance.trust(F.col("url"), primary)).otherwise(F.lit("unknown"))
    level = provenance.worse(shown, F.coalesce(F.col("claimed_trust"), F.lit("unknown")))
    known = registry.select(F.col("key").alias("__key"), F.col("path").alias("__path"), F.col("sha256").alias("__sha"), F.col("revision").alias("__rev"))
    rows = inbox.withColumns({"key": key, "trust": level}).join(known, F.col("key") == F.col("__key"), "left")
    short = F.char_length(T.strip(F.coalesce(F.col("text"), F.lit("")))) < 200
    status = (
        F.when(F.coalesce(F.col("model_in_path"), F.lit(False)), "REFUSED").when(F.col("key").isNull(), "NO ADDRESS").when(short, "UNREADABLE").when(F.col("trust") == "lookalike", "REFUSED")
        .when(F.col("__sha") == F.col("sha256"), "ALREADY HAVE").when(F.col("__path").isNotNull(), "REVISION").otherwise("added")
    )
    rows = rows.withColumn("status", status)
    taken = F.col("status").isin("REVISION", "added")
    turn = F.row_number().over(Window.partitionBy("key", taken).orderBy("name"))
    rows = rows.withColumn("__turn", F.when(taken, turn)).withColumn("status", F.when(F.col("__turn") > 1, "LATER").otherwise(F.col("status")))
    fresh = F.col("status").isin("REVISION", "added")
    return rows.select(
        *inbox.columns, "key", "trust", provenance.trust_label(F.col("trust")).alias("trust_label"), "status",
        F.when(fresh, F.coalesce(F.col("__rev"), F.lit(0)) + 1).alias("revision"), F.when(F.col("status") == "REVISION", F.col("__path")).alias("supersedes"),
    )


def register(registry: DataFrame, taken: DataFrame) -> DataFrame:
    """All editions: the register with what an intake took, each a row of its own; (key, path, sha256, revision, supersedes,
    url, trust)."""
    columns = ["key", "path", "sha256", "revision", "supersedes", "url", "trust"]
    new = taken.where(F.col("status").isin("REVISION", "added"))
    stem = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1)
    ext = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    path = F.when(F.col("status") == "REVISION", F.concat(stem, F.lit("__rev"), F.col("revision").cast("string"), ext)).otherwise(F.col("name"))
    return registry.select(*columns).unionByName(new.withColumn("path", path).select(*columns))


def latest(registry: DataFrame) -> DataFrame:
    """The edition in force of each key."""
    return registry.groupBy("key").agg(F.max_by(F.struct(*[c for c in registry.columns if c != "key"]), "revision").alias("x")).select("key", "x.*")


def still_there(quote: Column, text: Column) -> Column:
    """Whether a normalised text still has a quotation: whole, or its two or more ellipsis parts of 25 characters, each
    after the one before."""
    n, t = T.normalise(T.prepare_quote(quote)), text
    parts = T.ellipsis_parts(n, 25)

    def after(at: Column, part: Column) -> Column:
        """The place behind a part that is not before at; 0 once one is missing."""
        found = F.call_function("locate", part, t, at)
        return F.when((at > 0) & (found > 0), found + F.char_length(part)).otherwise(F.lit(0))

    end = F.aggregate(parts, F.lit(1), after)
    return F.contains(t, n) | ((F.size(parts) >= 2) & (end > 0))


def bank_impact(bank: DataFrame, editions: DataFrame) -> DataFrame:
    """(key, quote, there): every banked quotation (key, quote) against the new edition (key, text) of its source."""
    rows = bank.select("key", "quote").join(editions.select("key", T.normalise(F.col("text")).alias("__t")), "key")
    return rows.select("key", "quote", still_there(F.col("quote"), F.col("__t")).alias("there"))


def bank_key(quote: Column) -> Column:
    return F.lower(T.normalise(T.strip_markdown(quote)))


def in_bank(quotes: DataFrame, quote_col: str, bank: DataFrame, bank_text: str) -> DataFrame:
    """quotes with banked: of 40 characters or more, and equal to a quoted block of the bank, both normalised."""
    held = bank.select(F.explode(X.bank_quotes(F.col(bank_text))).alias("__key")).distinct().withColumn("__held", F.lit(True))
    rows = quotes.withColumn("__quote", bank_key(F.col(quote_col))).join(held, F.col("__quote") == F.col("__key"), "left")
    return rows.withColumn("banked", F.coalesce(F.col("__held"), F.lit(False)) & (F.char_length("__quote") >= LEAST_BANKED)).drop("__quote", "__key", "__held")


def unbanked(quotes: DataFrame, bank: DataFrame, key: Column, bank_key_: Column) -> DataFrame:
    """The rows of quotes whose key is not in the bank; a null key is in no bank."""
    return quotes.withColumn("__key", key).join(bank.select(bank_key_.alias("__key")), "__key", "left_anti").drop("__key")


def queue_mark(verdict: Column) -> Column:
    """How much an entry of the queue asks for: ok, ask, gone or wrong."""
    return F.when(verdicts.is_in(verdict, "CLEAN"), "ok").when(verdicts.is_in(verdict, "UNCHECKABLE"), "ask").when(verdict.isin("NOT_FOUND", "ERROR"), "gone").otherwise("wrong")


def queue(fresh: DataFrame, turn: str, order: str, cap: int = PER_TURN) -> DataFrame:
    """fresh with queued and dropped: the first cap rows of a turn are queued, and each row tells how many of its turn are
    not."""
    rank = F.row_number().over(Window.partitionBy(turn).orderBy(order))
    n = F.count("*").over(Window.partitionBy(turn))
    return fresh.withColumn("queued", rank <= cap).withColumn("dropped", F.greatest(n - cap, F.lit(0)))


def queue_status(text: Column) -> Column:
    """struct(open, done, items) of a queue kept as Markdown check boxes."""
    items = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?md)^{T.SPACE}*-{T.SPACE}*\[ \]{T.SPACE}*(.{{0,110}})"), F.lit(1))
    done = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"(?md)^{T.SPACE}*-{T.SPACE}*\[[xX]\]"))
    return F.struct(F.size(items).alias("open"), done.alias("done"), items.alias("items"))


def bank_status(bank: DataFrame, text_col: str, queues: DataFrame, queue_col: str) -> DataFrame:
    """One row: quotations banked, and items of the queues that are open and done."""
    n = bank.select(F.explode(X.bank_quotes(F.col(text_col))).alias("k")).agg(F.count_distinct("k").alias("banked"))
    of = queues.select(queue_status(F.col(queue_col)).alias("x")).agg(F.coalesce(F.sum("x.open"), F.lit(0)).alias("open"), F.coalesce(F.sum("x.done"), F.lit(0)).alias("done"))
    return n.crossJoin(of)  # one row each


def entry(fields: dict[str, Column]) -> Column:
    """An entry of the bank as Markdown; an empty field says that it is to do."""
    told = {"quote": "> ", "address": "- address: ", "on_disk": "- on disk: ", "recheck": "- how to check it again: ", "not_proved": "- what it does not prove: ", "used_in": "- used in: "}
    value = lambda name: F.coalesce(F.nullif(T.strip(fields[name]), F.lit("")), F.lit("TO DO")) if name in fields else F.lit("TO DO")
    return F.concat_ws("\n", *[F.concat(F.lit(lead), value(name)) for name, lead in told.items()])


def recent(log: DataFrame, order: str, most: int = LOG_LINES) -> DataFrame:
    """The last lines of a log."""
    return log.orderBy(F.desc(order)).limit(most)


def index_entries(index: DataFrame, text_col: str) -> DataFrame:
    """(file): every file cell of an index kept as a Markdown table, in lower case."""
    cells = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\|[ \t]*`([^`]+)`[ \t]*\|"), F.lit(1))
    return index.select(F.explode(F.transform(cells, lambda c: F.lower(F.trim(c)))).alias("file")).distinct()


def add_entry(text: Column, row: Column) -> Column:
    """An index with a row put in after its last table row; null where it has no table, as the row would never show."""
    lines = F.split(text, "\n", -1)
    is_row = lambda x: F.ltrim(x).startswith("|") & F.rtrim(x).endswith("|")
    last = F.array_max(F.transform(lines, lambda x, i: F.when(is_row(x), i + 1)))
    return F.when(last.isNotNull(), F.array_join(F.concat(F.slice(lines, F.lit(1), last), F.array(row), F.slice(lines, last + 1, F.size(lines))), "\n"))


def orphans(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(file, status): files (name) that no index (file) lists, unindexed, and entries without a file, missing; by names in
    lower case; text copies beside a source need no entry."""
    base = F.lower(F.regexp_extract("file", r"([^/\\]*)$", 1))
    here = files.select(F.lower("name").alias("file")).where(~F.col("file").endswith(".text.md"))
    status = reconcile.reconcile(listed.select(base.alias("file")), here, "file")
    named = F.when(F.col("status") == "file_no_cite", "unindexed").when(F.col("status") == "cited_no_file", "missing")
    return status.select("file", named.alias("status")).where("status IS NOT NULL")


def prove(text: Column, party: Column, subject: Column) -> Column:
    """struct(proved, reasons): whether a file is the document that it should be. Every name that is asked for must be in
    it, it must have 2,000 characters, and where nothing was asked nothing is proved."""
    low = F.lower(F.coalesce(text, F.lit("")))
    asked = lambda c: F.coalesce(c, F.lit("")) != ""
    has = lambda c: F.contains(low, F.lower(c))
    faults = F.array(
        F.when(asked(party) & ~has(party), "party absent"), F.when(asked(subject) & ~has(subject), "subject absent"),
        F.when(F.char_length(T.strip(low)) < LEAST_PROOF, "suspiciously short"), F.when(~asked(party) & ~asked(subject), "nothing was asked"),
    )
    reasons = F.filter(faults, lambda x: x.isNotNull())
    return F.struct((F.size(reasons) == 0).alias("proved"), reasons.alias("reasons"))


def current(files: DataFrame, copies: DataFrame, version: int) -> DataFrame:
    """files (path, modificationTime) with current: whether their text copy (path, modificationTime, version) is no older
    than they are and was made by this version of the reader."""
    made = copies.select("path", F.col("modificationTime").alias("__made"), F.col("version").alias("__version"))
    rows = files.join(made, "path", "left")
    fresh = (F.col("__made") >= F.col("modificationTime")) & (F.col("__version") == version)
    return rows.withColumn("current", F.coalesce(fresh, F.lit(False))).drop("__made", "__version")


def watched(path: Column, watch: list[str], ignore: list[str], bank: str) -> Column:
    """Whether the guard looks at a file: an ignored folder wins over a watched one; the bank is always watched."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    under = lambda folders: provenance.any_of([(low == f.lower().rstrip("/")) | low.startswith(f.lower().rstrip("/") + "/") for f in folders])
    return ~under(ignore) & (under(watch) | (low == bank.lower()))
