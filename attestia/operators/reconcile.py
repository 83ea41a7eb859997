"""References against what is there: full outer joins, gaps, agreement, differences of editions, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions import extract as X
from attestia.functions import text as T
from attestia.store import keep

# Extensions of exhibits, marks of unfinished work in names, the number of a part, names of widgets without
# content, and the form that is never read.
DOCUMENTS = [
    ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".jpg", ".jpeg", ".png", ".gif", ".tif", ".tiff", ".bmp", ".webp", ".md", ".txt", ".rtf", ".odt",
    ".html", ".htm",
]
ACTION = r"(?iu)(FIXME|TODO|ИСПРАВИТЬ|ОБНОВИТЬ|СДЕЛАТЬ|ПРОВЕРИТЬ|DRAFT|ЧЕРНОВИК)"
PART = r"[-_](\p{Nd}{1,2})(?:\P{Nd}|$)"
WIDGET = r"(?iu)barcode|PDF417"
STRUCTURE = r"(?iu)^form1\[\p{Nd}+\](\.#(subform|pageSet|area)\[\p{Nd}+\])*$"
NEVER_READ = r"(?iu)g-?1450"


def reconcile(cited: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, status): matched, cited_no_file or file_no_cite, one row for each distinct key; null keys take no part."""
    a = cited.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__cited", F.lit(True))
    b = present.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__present", F.lit(True))
    status = F.when(F.col("__cited").isNull(), "file_no_cite").when(F.col("__present").isNull(), "cited_no_file").otherwise("matched")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def numbering_gaps(items: DataFrame, series: str, number: str) -> DataFrame:
    """(series, missing): numbers from 1 to a series' highest that it lacks. Each number knows the one before it in its
    series, so that only the gaps are spelled out; no series is gathered in a row."""
    seen = items.select(series, F.col(number).alias("__n")).where("__n > 0").distinct()
    before = F.coalesce(F.lag("__n").over(Window.partitionBy(series).orderBy("__n")), F.lit(0))
    open_ = seen.withColumn("__before", before).where("__n > __before + 1")
    return open_.select(series, F.explode(F.sequence(F.col("__before") + 1, F.col("__n") - 1)).alias("missing"))


def agreement(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """Two readings of the same fields, one row: all fields, shared, those that differ where both have a value, those of
    one side alone, and the share of the shared that agree, in per cent. Widgets without content take no part."""
    a, b = (x.select(key, F.coalesce(F.trim(value), F.lit("")).alias(n)) for x, n in ((one, "__a"), (two, "__b")))
    both = a.join(b, key, "full_outer").where(~noise_widget(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    lone = F.col("__a").isNull() | F.col("__b").isNull()
    differ, shared = F.count_if(~lone & (F.col("__a") != F.col("__b"))), F.count_if(~lone)
    return both.agg(
        F.count("*").alias("fields"), shared.alias("shared"), differ.alias("divergent"), F.count_if(lone).alias("one_side"),
        F.round(100 * (1 - differ / F.greatest(shared, F.lit(1))), 1).alias("agreement"),
    )


def divergences(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """(key, one, two) of the fields that both have with different values."""
    both = one.select(key, F.col(value).alias("one")).join(two.select(key, F.col(value).alias("two")), key)
    return both.where(F.coalesce(F.trim("one"), F.lit("")) != F.coalesce(F.trim("two"), F.lit("")))


def noise_widget(name: Column) -> Column:
    return name.rlike(WIDGET) | name.rlike(STRUCTURE)


def widget_value(value: Column) -> Column:
    """A field as text: a ticked box is [X], an unticked one empty."""
    text = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "^/", "")
    return F.when(F.lower(text) == "true", "[X]").when(F.lower(text).isin("false", "off"), "").otherwise(text)


def widgets(fields: DataFrame) -> DataFrame:
    """(file, total, filled, blank) of form fields (file, page, y, x, name, value); widgets without content, and the form
    that holds card data, take no part."""
    rows = fields.where(~noise_widget(F.col("name")) & ~F.col("file").rlike(NEVER_READ))
    filled = F.count_if(F.trim(F.coalesce("value", F.lit(""))) != "")
    return rows.groupBy("file").agg(F.count("*").alias("total"), filled.alias("filled"), (F.count("*") - filled).alias("blank"))


def reading_order(fields: DataFrame) -> DataFrame:
    return fields.orderBy("file", "page", F.round("y", 1), F.round("x", 1), "name")


def copies_differ(fields: DataFrame) -> DataFrame:
    """(form, name, copies, values): fields of several copies (form, file, name, value) of a form that are not the same in
    all of them; a field that a copy lacks differs. values: (file, value) of the copies that have it."""
    named = fields.groupBy("form", "name", "file").agg(F.max(F.trim(F.coalesce("value", F.lit("")))).alias("value"))
    copies = fields.groupBy("form").agg(F.count_distinct("file").alias("copies"))
    found = named.groupBy("form", "name").agg(F.count("*").alias("__n"), F.count_distinct("value").alias("__values"), F.sort_array(F.collect_list(F.struct("file", "value"))).alias("values"))
    both = found.join(F.broadcast(copies), "form").where((F.col("copies") > 1) & ((F.col("__n") < F.col("copies")) | (F.col("__values") > 1)))
    return both.select("form", "name", "copies", "values")


def duplicates(items: DataFrame, key: str, is_part: Column) -> DataFrame:
    """(key, n): keys of several items that are not all parts."""
    counted = items.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(is_part).alias("__parts"))
    return counted.where("n > 1 AND NOT __parts").select(key, "n")


def exhibit_files(files: DataFrame, series: tuple[str, ...] = X.SERIES) -> DataFrame:
    """(path, name, exhibit, problem, action, part) of files (path, name, ext): the exhibit that a name stands for, and what
    is wrong with it: NO-ID, NOT-EXHIBIT; action: the name tells of unfinished work."""
    found = X.exhibit_of_file(F.col("name"), series)
    barred = found.isin(X.NOT_EXHIBIT) | F.substring_index(found, "-", 1).isin(X.DOC_SERIES)
    problem = F.when(found.isNull(), "NO-ID").when(barred, "NOT-EXHIBIT")
    rows = files.where(F.col("ext").isin(DOCUMENTS)).select("path", "name", found.alias("exhibit"), problem.alias("problem"))
    return rows.withColumn("action", F.col("problem").isNull() & F.col("name").rlike(ACTION)).withColumn("part", F.col("name").rlike(PART))


def form_files(files: DataFrame) -> DataFrame:
    """(path, name, form, problem): the form that a file's name begins with, else NO-FORM-ID."""
    found = X.form_of_file(F.col("name"))
    return files.select("path", "name", found.alias("form"), F.when(found.isNull(), "NO-FORM-ID").alias("problem"))


def reconcile_documents(documents: DataFrame, files: DataFrame, form_dir: DataFrame | None = None, series: tuple[str, ...] = X.SERIES) -> DataFrame:
    """(kind, id, status, cited_in, files): exhibits, and forms if there are any, that documents (name, text) name, against
    files (path, name, ext). Zero documents are no finding but an error: a check of nothing finds no fault.
    """
    read = documents.where(F.coalesce(T.strip(F.col("text")), F.lit("")) != "")
    if read.isEmpty():
        raise ValueError("no documents were read: no references means nothing was checked")

    def one(kind: str, named: Column, present: DataFrame, column: str) -> DataFrame:
        cited = read.select("name", F.explode(named).alias("id")).distinct()
        there = present.where(F.col("problem").isNull()).select(F.col(column).alias("id"), F.col("name").alias("file"))
        status = reconcile(cited, there, "id")
        who = cited.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("cited_in"))
        where = there.groupBy("id").agg(F.sort_array(F.collect_set("file")).alias("files"))
        return status.join(who, "id", "left").join(where, "id", "left").select(F.lit(kind).alias("kind"), "id", "status", "cited_in", "files")

    out = one("exhibit", X.exhibits(F.col("text"), series), exhibit_files(files, series), "exhibit")
    return out if form_dir is None else out.unionByName(one("form", X.forms(F.col("text")), form_files(form_dir), "form"))


def exhibit_order(rows: DataFrame, id_col: str) -> DataFrame:
    """By series, number and name."""
    number = F.regexp_replace(F.substring_index(id_col, "-", -1), r"\P{Nd}", "").try_cast("int")
    return rows.orderBy(F.substring_index(id_col, "-", 1), F.coalesce(number, F.lit(0)), id_col)


def sentences(c: Column) -> Column:
    """Sentences of a text for comparison: normalised, cut after a full stop, semicolon or colon, of over 10 characters and
    more than one word."""
    cut = F.transform(F.split(T.normalise(c), rf"(?<=[.;:]){T.SPACE}+", -1), T.strip)
    return F.filter(cut, lambda s: (F.char_length(s) > 10) & F.contains(s, F.lit(" ")))


def revisions(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gone, added, kept, similarity, moved) of two editions of each key that both have.

    Sentences are compared as sets by their hashes; moved counts the places at which the sequences of the shared sentences,
    repeats included, differ. Texts stay where they are: what meets are (key, hash, side) rows, summed before the shuffle,
    and the two sequences of hashes.
    """

    def hashed(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(key, F.transform(sentences(F.col(text)), lambda s: F.xxhash64(s)).alias(side))

    both = hashed(old, "__old").join(hashed(new, "__new"), key)
    a, b = F.col("__old"), F.col("__new")
    kept, whole = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    stay = lambda x, y: F.filter(x, lambda s: F.array_contains(y, s))
    pairs = F.zip_with(stay(a, b), stay(b, a), lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), 1).otherwise(0))
    moved = F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)
    return both.select(
        key, F.size(F.array_except(a, b)).alias("gone"), F.size(F.array_except(b, a)).alias("added"), kept.alias("kept"),
        (kept / F.greatest(whole, F.lit(1))).alias("similarity"), moved.alias("moved"),
    )


def revision_sentences(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status, sentence): the sentences that are gone and those that are added."""
    flat = lambda rows: rows.select(key, F.explode(F.array_distinct(sentences(F.col(text)))).alias("sentence"))
    a, b = flat(old), flat(new)
    gone = a.join(b, [key, "sentence"], "left_anti").withColumn("status", F.lit("gone"))
    return gone.unionByName(b.join(a, [key, "sentence"], "left_anti").withColumn("status", F.lit("added"))).select(key, "status", "sentence")


def superseded(registry: DataFrame) -> DataFrame:
    """(path): every file that a newer edition replaces, directly or over others. registry: (path, supersedes).

    Chains are followed by joins that double their reach, so that a chain of n takes about log n rounds; circles end.
    """
    steps = keep(registry.select("path", "supersedes").where("supersedes IS NOT NULL AND path IS NOT NULL").distinct(), "steps")
    found, before = steps, -1
    while (now := found.count()) != before:
        before = now
        further = found.alias("a").join(found.alias("b"), F.col("a.supersedes") == F.col("b.path")).select(F.col("a.path").alias("path"), F.col("b.supersedes").alias("supersedes"))
        found = keep(found.union(further).distinct(), "steps")
    direct = registry.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("path"))
    return found.select(F.col("supersedes").alias("path")).union(direct).distinct()
