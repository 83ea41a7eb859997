"""A whole check: drafts against sources, with addresses, grid, mixed provisions, and the report's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions import extract as X
from attestia.functions import text as T
from attestia.operators import provenance
from attestia.plans import citations, verdicts, verify
from attestia.store import keep

TIERS = ["A", "B", "C", "D"]


def tiered(drafts: DataFrame, tier: Column, body: str = "body", stamps: tuple[str, ...] = (provenance.STAMP,)) -> DataFrame:
    """drafts with tier; what bears our stamp is tier D, wherever it lies."""
    return drafts.withColumn("tier", F.when(provenance.stamped(F.col(body), stamps), "D").otherwise(tier))


def only(drafts: DataFrame, part: str = "", tiers: list[str] | None = None) -> DataFrame:
    """The drafts whose path holds part, in any case, of the tiers given."""
    rows = drafts.where(F.contains(F.lower("file"), F.lit(part.lower()))) if part else drafts
    return rows.where(F.col("tier").isin(tiers)) if tiers else rows


def sites(drafts: DataFrame, packs: citations.Packs, least: int = 45, drop_cyrillic: bool = False) -> DataFrame:
    """(key, quote, tier, file, near, far, legal, far_legal): every quotation of drafts (tier, file, body), each once a
    draft, with the citations around its first place there. key is the quotation in lower case."""
    said = keep(drafts.select("tier", "file", "body", X.quotations(F.col("body"), least, drop_cyrillic).alias("quotes")), "drafts")
    flat = said.select("tier", "file", F.explode(citations.rings(packs)("body", "quotes")).alias("x"))
    return flat.select(F.lower(T.strip(F.col("x.quote"))).alias("key"), "tier", "file", "x.*")


def distinct(sites_: DataFrame) -> DataFrame:
    """(k, key, quote, tier, n_sites, sites, near, far, legal, far_legal): each quotation once, its tier the best of its
    sites, with its sites in order of file and the union of their citations."""
    site = F.struct("file", "tier", "near", "far")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    rows = sites_.groupBy("key").agg(
        F.min_by("quote", F.struct("tier", "file")).alias("quote"), F.min("tier").alias("tier"), F.count("*").alias("n_sites"),
        F.sort_array(F.collect_list(site)).alias("sites"), *[every(c) for c in ("near", "far", "legal", "far_legal")],
    )
    return keep(rows.withColumn("k", F.monotonically_increasing_id()), "quotes")


def miss_kind(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(k, kind) of quotations that are nowhere (k, far_legal): evidentiary without a legal citation around; on disk if the
    corpus has one of these citations in its text; else absent, a gap of the library."""
    cites = rows.select("k", F.explode("far_legal").alias("cite"))
    asked = keep(cites.select("cite").distinct().withColumn("c", F.monotonically_increasing_id()), "cites")
    needles = asked.select(F.col("c").alias("k"), F.lit("first").alias("role"), F.lit(0).alias("ord"), F.lit("t").alias("idx"), F.col("cite").alias("needle")).where("cite <> ''")
    found = list(verify.located(needles, corpus, cap=1))
    none = rows.sparkSession.createDataFrame([], "c long")
    there = (verify.union(found).select(F.col("k").alias("c")).distinct() if found else none).withColumn("__there", F.lit(True))
    held = cites.join(asked, "cite").join(there, "c", "left").groupBy("k").agg(F.max(F.coalesce("__there", F.lit(False))).alias("there"))
    kind = F.when(F.size("far_legal") == 0, "evidentiary").when(F.coalesce("there", F.lit(False)), "on disk").otherwise("absent")
    return rows.join(held, "k", "left").select("k", kind.alias("kind"))


def check_drafts(
    drafts: DataFrame, sources: DataFrame, packs: citations.Packs, least: int = 45, drop_cyrillic: bool = False, superseded: str | None = None, block: int = verify.BLOCK
) -> DataFrame:
    """One row for each distinct quotation of drafts (tier, file, body) against sources (doc_ord, path, text): k, quote,
    tier, n_sites, sites, near, far, verdict, class, rank, doc_ord, path, detail, kind, address.

    kind is empty but for NOT_FOUND. Sources without rows are refused, as a check against nothing accuses everyone.
    """
    if sources.isEmpty():
        raise ValueError("the corpus is empty: nothing can be checked against it")
    prepared = verify.prepare(sources, "doc_ord", "text", superseded)
    paths = sources.select("doc_ord", "path")
    corpus = verify.stored(prepared.join(paths, "doc_ord"))
    rows = distinct(sites(drafts, packs, least, drop_cyrillic))
    asked = verify.asked(rows, "k", "quote")
    judged = verify.check_stored(asked, corpus, block).withColumnRenamed("q", "k")
    told = judged.join(asked.select(F.col("q").alias("k"), "n"), "k").join(rows.select("k", F.col("legal").alias("cites")), "k")
    folded = keep(citations.fold(told.select("k", "n", "cites", "verdict", "doc_ord", "detail"), corpus, packs), "folded")
    missed = rows.join(folded.where("verdict = 'NOT_FOUND'").select("k"), "k", "left_semi").select("k", "far_legal")
    kinds = miss_kind(missed, corpus)
    out = rows.join(folded, "k").join(kinds, "k", "left").join(paths, "doc_ord", "left")
    return out.select(
        "k", "quote", "tier", "n_sites", "sites", "near", "far", "verdict", "class", verdicts.rank_of(F.col("verdict")).alias("rank"), "doc_ord", "path", "detail",
        F.coalesce("kind", F.lit("")).alias("kind"), "address",
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Worst first, then by the number of sites, then by the quotation."""
    return rows.orderBy("rank", F.desc("n_sites"), F.lower("quote"))


def grid(rows: DataFrame) -> DataFrame:
    """(verdict, rank, A, B, C, D, total): every verdict, also those without a quotation, and a last row for all."""
    counted = rows.groupBy("verdict").pivot("tier", TIERS).count()
    every = verdicts.table(rows.sparkSession).select("verdict", "rank").join(F.broadcast(counted), "verdict", "left").na.fill(0, TIERS)
    every = every.withColumn("total", sum((F.col(t) for t in TIERS), F.lit(0)))
    whole = every.agg(*[F.sum(c).alias(c) for c in [*TIERS, "total"]]).select(F.lit("total").alias("verdict"), F.lit(99).alias("rank"), *TIERS, "total")
    return every.unionByName(whole)


def asks(rows: DataFrame) -> DataFrame:
    """One row: dangerous and unchecked quotations of the tiers that are filed or lead to filings."""
    filed = F.col("tier").isin("A", "B")
    return rows.agg(F.count_if(filed & (F.col("class") == "DANGEROUS")).alias("needs_human"), F.count_if(filed & (F.col("class") == "UNCHECKABLE")).alias("not_checked"))


def address_counts(rows: DataFrame) -> DataFrame:
    return rows.where("address IS NOT NULL").groupBy(F.col("address.status").alias("status")).agg(F.count("*").alias("n"))


def mixed_provisions(rows: DataFrame, packs: citations.Packs) -> DataFrame:
    """(provision, clean, flagged): provisions that drafts quote both right and wrong, by the addresses beside them."""
    keyed = rows.select("verdict", "class", F.explode(citations.cite_keys(packs)("near")).alias("key"))
    clean = F.count_if(F.col("verdict").isin(*verdicts.ADDRESS_CLEAN))
    flagged = F.count_if((F.col("class") == "DANGEROUS") & ~F.col("verdict").isin(*verdicts.ADDRESS_CLEAN))
    both = keyed.groupBy("key").agg(clean.alias("clean"), flagged.alias("flagged")).where("clean > 0 AND flagged > 0")
    return both.select(citations.key_label(packs)("key").alias("provision"), "clean", "flagged").orderBy(F.desc("flagged"), "provision")


def write(rows: DataFrame, folder: str, packs: citations.Packs) -> str:
    """The report: all rows as JSON under folder/result, the sections worth reading as Markdown under folder/REPORT.md.

    The Markdown has the grid, mixed provisions, and at most 60 quotations of each verdict that asks for a reader; what is
    beyond them is counted. Only these come to the driver.
    """
    ordered(rows).write.mode("overwrite").json(f"{folder}/result")
    lines = [f"<!-- {provenance.STAMP} -->", "# Quotations against sources", "", "| verdict | " + " | ".join(TIERS) + " | total |", "|-" * 6 + "|"]
    lines += [f"| {r['verdict']} | " + " | ".join(str(r[t]) for t in TIERS) + f" | {r['total']} |" for r in grid(rows).orderBy("rank").collect() if r["total"] or r["verdict"] == "total"]
    lines += ["", *[f"* {r['provision']} is quoted right {r['clean']} times and wrong {r['flagged']} times" for r in mixed_provisions(rows, packs).limit(60).collect()]]
    place = F.row_number().over(Window.partitionBy("verdict").orderBy(F.desc("n_sites"), F.lower("quote")))
    shown = rows.where(~F.col("verdict").isin("VERIFIED", "ASSEMBLED")).withColumn("__at", place).withColumn("__all", F.count("*").over(Window.partitionBy("verdict")))
    last = None
    for r in shown.where("__at <= 60").orderBy("rank", "__at").select("verdict", "quote", "path", "detail", "kind", "n_sites", "__all").collect():
        if r["verdict"] != last:
            last = r["verdict"]
            lines += ["", f"## {last}: {r['__all']}", "", verdicts.MEANINGS[last], ""]
        lines.append(f"> {r['quote'][:400]}\n\n{r['path'] or 'nowhere'}; {r['n_sites']} sites; {r['detail']}{' ' + r['kind'] if r['kind'] else ''}\n")
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/REPORT.md")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()
    return f"{folder}/REPORT.md"


def exit_code(rows: DataFrame, strict: bool) -> int:
    """0; in strict mode 1 with a dangerous quotation in what is filed, else 4 with one that was not checked."""
    told = asks(rows).first()
    return (1 if told["needs_human"] else 4 if told["not_checked"] else 0) if strict else 0
