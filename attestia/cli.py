"""The command line: a thin layer over the engine. Exit codes: 0 well; check --strict 1 and 4; gate 2 and 3; exhibits 1 and 2."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia import config
from attestia.functions import text as T
from attestia.operators import gate, library, mutate, provenance, reconcile, review
from attestia.plans import citations, report, verdicts, verify
from attestia.sources import files
from attestia.store import keep, replace


def sources(spark: SparkSession, c: config.Config) -> DataFrame:
    """(doc_ord, path, text, superseded) of the sources that are indexed; a missing reader is an error."""
    found = files.walk(spark, [c.path(p) for p in c.sources], skip_dirs=tuple(c.skip_dirs))
    audited = files.audit(files.corpus_text(files.require_read(files.read_any(found))))
    return files.ordered(audited.where("indexed").select("path", "text")).withColumn("superseded", F.col("path").isin(sorted(superseded_paths(spark, c))))


def superseded_paths(spark: SparkSession, c: config.Config) -> set[str]:
    path = c.path(c.registry)
    if not os.path.isfile(path):
        return set()
    with open(path, encoding="utf-8") as f:
        rows = [(e.get("path"), e.get("supersedes")) for e in json.load(f).values()]
    return {r.path for r in reconcile.superseded(spark.createDataFrame(rows, "path string, supersedes string")).collect()}


def drafts(spark: SparkSession, c: config.Config, part: str = "", tiers: list[str] | None = None) -> DataFrame:
    """(tier, file, body) of the drafts of all tiers."""
    frames = []
    for d in c.drafts:
        read = files.require_read(files.read_any(files.walk(spark, [c.path(d["path"])], files.DRAFTS, tuple(c.skip_dirs))))
        frames.append(report.tiered(read.select(F.col("path").alias("file"), F.col("text").alias("body")), F.lit(d["tier"])))
    return report.only(verify.union(frames), part, tiers)


def _show(df: DataFrame, most: int = 60) -> None:
    df.show(most, truncate=120)


def check(spark, c, a) -> int:
    packs = citations.load(c.citation_packs)
    rows = report.check_drafts(drafts(spark, c, a.only, a.tiers), sources(spark, c), packs, c.min_quote_length, c.drop_cyrillic_quotes, "superseded").cache()
    _show(report.grid(rows).orderBy("rank"))
    _show(report.address_counts(rows))
    if a.report:
        print(report.write(rows, a.report, packs))
    return report.exit_code(rows, a.strict)


def quote(spark, c, a) -> int:
    asked, docs = spark.createDataFrame([(0, a.text)], "q long, s string"), sources(spark, c)
    found = verify.check(asked, docs, "q", "s", "doc_ord", "text", superseded_col="superseded").first()
    print(found.verdict, "-", verdicts.MEANINGS[found.verdict], found.detail)
    _show(verify.neighbours(asked, docs, "q", "s", "doc_ord", "text"))
    return 0 if found.verdict == "VERIFIED" else 1


def gate_(spark, c, a) -> int:
    rows = files.read_any(files.walk(spark, a.paths, files.EXTENSIONS)).select("path", "text")
    _show(gate.findings(rows, "path", "text", tuple(c.surnames)))
    told = gate.gate(rows, "path", "text", a.allow_pii, tuple(c.surnames)).first()
    print(f"code {told['code']}: {told['secrets']} files with secrets, {told['personal']} with personal data; {told['surnames']} surnames were looked for")
    return told["code"]


def mutate_(spark, c, a) -> int:
    docs = sources(spark, c)
    rows = report.check_drafts(drafts(spark, c), docs, citations.load(c.citation_packs), c.min_quote_length, c.drop_cyrillic_quotes, "superseded")
    base = mutate.base(rows.where("class = 'CLEAN'").select("k", "quote", "doc_ord"), "quote", "doc_ord").orderBy("k").limit(a.limit)
    made = mutate.bank(base, "k", "quote").unionByName(mutate.splices(base, "k", "quote", "doc_ord")).withColumn("id", F.struct("base_id", "mutation", "mutant"))
    judged = verify.check(made, docs, "id", "mutant", "doc_ord", "text").select("q.mutation", "q.mutant", "verdict")
    _show(mutate.report(judged, [v for v, (x, _) in verdicts.VERDICTS.items() if x == "DANGEROUS"]))
    return 0


def bank(spark, c, a) -> int:
    text = lambda p: spark.read.text(c.path(p), wholetext=True) if os.path.isfile(c.path(p)) else spark.createDataFrame([], "value string")
    _show(library.bank_status(text(c.bank), "value", text(c.queue), "value"))
    return 0


def library_(spark, c, a) -> int:
    index = spark.read.text(c.path(c.library_index), wholetext=True)
    _show(library.orphans(files.walk(spark, [c.path(p) for p in c.sources]), library.index_entries(index, "value")))
    return 0


def review_(spark, c, a) -> int:
    answers = files.read_any(files.walk(spark, a.paths, (".md", ".txt"))).select(F.col("name").alias("answer"), "text").cache()
    audited = review.audit_answers(answers, "answer", "text", sources(spark, c), "doc_ord", "text", c.min_quote_length).cache()
    _show(review.reviewer_totals(audited))
    _show(audited.where("class <> 'CLEAN'").orderBy("audit_rank"), 40)
    primary = [".gov", ".mil", *citations.load(c.citation_packs).domains]
    grounds = review.grounding(answers, "answer", "text", primary, list(provenance.FETCH_SECONDARY), list(provenance.FETCH_SNAPSHOT))
    _show(review.triage(answers, "answer", "text", review.failures(F.col("text"), F.lit(a.marker), a.floor), F.array().cast("array<string>"), grounds))
    return 0


def exhibits(spark, c, a) -> int:
    documents = files.read_any(files.walk(spark, a.documents, files.DRAFTS)).select("name", "text")
    try:
        rows = reconcile.reconcile_documents(documents, files.walk(spark, a.exhibits, tuple(reconcile.DOCUMENTS)), files.walk(spark, a.forms, (".pdf",)) if a.forms else None).cache()
    except ValueError as e:
        print(e)
        return 2
    _show(reconcile.exhibit_order(rows, "id"))
    return 1 if rows.where("status = 'cited_no_file'").count() else 0


def intake(spark, c, a) -> int:
    """Landed files against the register, which is a Parquet table; 3 with a refused file, 4 with one that has no address."""
    packs_, keys = citations.load(c.citation_packs), "key string, path string, sha256 string, revision int, supersedes string, url string, trust string"
    register = c.path(a.register)
    held = spark.read.parquet(register) if os.path.exists(register) else spark.createDataFrame([], keys)
    landed = files.inbox(spark, a.inbox)
    found = F.transform(citations.cite_positions(packs_)(F.coalesce(F.lit(a.address), "address")), lambda x: x["cite"])
    cited = keep(landed.withColumn("__cites", found), "inbox")
    taken = keep(library.intake(cited.withColumn("keys", citations.cite_keys(packs_)("__cites")), library.latest(held), packs_.domains), "intake")
    replace(library.register(held, taken), register)
    _show(taken.select("name", "key", "status", "revision", "trust_label"))
    seen = {r["status"] for r in taken.select("status").distinct().collect()}
    return 3 if "REFUSED" in seen else 4 if seen & {"NO ADDRESS", "UNREADABLE"} else 0


def dump_forms(spark, c, a) -> int:
    there = [e for e, has in files.engines().items() if has]
    if not there:
        print("no PDF engine is installed: no form was read")
        return 2
    found = files.walk(spark, a.paths, (".pdf",)).where(~F.col("name").rlike(reconcile.NEVER_READ))
    fields = [files.form_fields(found, e).cache() for e in there]
    _show(reconcile.widgets(fields[0]))
    _show(reconcile.reading_order(fields[0]))
    if len(fields) == 2:
        keyed = [f.withColumn("key", F.concat_ws(" ", "file", "name")) for f in fields]
        _show(reconcile.agreement(*keyed, "key", "value"))
    return 0


def brief(spark, c, a) -> int:
    _show(spark.read.text(a.paths, wholetext=True).select(F.explode(review.anchor_warnings(F.col("value"))).alias("warning")))
    return 0


def packs(spark, c, a) -> int:
    print("\n".join(citations.available()))
    return 0


def doctor(spark, c, a) -> int:
    print({"readers": files.engines(), "missing": c.missing(), "packs": citations.load(c.citation_packs).ids})
    found = files.walk(spark, [c.path(p) for p in c.sources], skip_dirs=tuple(c.skip_dirs))
    _show(files.advice(files.audit(files.corpus_text(files.read_any(found)))))
    return 0


def sidecar(spark, c, a) -> int:
    print(files.cached(files.walk(spark, [c.path(p) for p in c.sources], skip_dirs=tuple(c.skip_dirs)), a.cache).where(F.char_length(T.strip("text")) > 0).count(), "texts")
    return 0


def close(spark, c, a) -> int:
    """Whether a round may close: no open items in the queue, no source without an entry."""
    bank(spark, c, a)
    open_ = spark.read.text(c.path(c.queue), wholetext=True).select(library.queue_status(F.col("value")).alias("x")).agg(F.sum("x.open")).first()[0] if os.path.isfile(c.path(c.queue)) else 0
    return 1 if open_ else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("attestia", description=__doc__)
    p.add_argument("--config", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, run: sub.add_parser(name).set_defaults(run=run) or sub.choices[name]
    x = add("check", check)
    x.add_argument("--only", default="")
    x.add_argument("--tiers", nargs="*")
    x.add_argument("--strict", action="store_true")
    x.add_argument("--report")
    add("quote", quote).add_argument("text")
    x = add("gate", gate_)
    x.add_argument("paths", nargs="+")
    x.add_argument("--allow-pii", action="store_true")
    add("mutate", mutate_).add_argument("--limit", type=int, default=60)
    x = add("review", review_)
    x.add_argument("paths", nargs="+")
    x.add_argument("--marker", default="")
    x.add_argument("--floor", type=int, default=800)
    x = add("check-exhibits", exhibits)
    x.add_argument("documents", nargs="+")
    x.add_argument("--exhibits", nargs="+", required=True)
    x.add_argument("--forms", nargs="*")
    add("brief", brief).add_argument("paths", nargs="+")
    add("dump-forms", dump_forms).add_argument("paths", nargs="+")
    x = add("intake", intake)
    x.add_argument("inbox")
    x.add_argument("--register", default="law/register.parquet")
    x.add_argument("--address")
    add("sidecar", sidecar).add_argument("--cache", required=True)
    for name, run in (("bank", bank), ("library", library_), ("packs", packs), ("doctor", doctor), ("close", close)):
        add(name, run)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    return a.run(spark or SparkSession.builder.appName("attestia").getOrCreate(), config.load(a.config), a)


if __name__ == "__main__":
    raise SystemExit(main())
