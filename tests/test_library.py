"""Sources as files, provenance, intake, editions, the bank, answers, mutations, streams."""

import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from attestia.operators import library, mutate, provenance, reconcile, review
from attestia.plans import verdicts
from attestia.sources import files
from attestia.streaming import events
from tests.test_drafts import on

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body, note=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{"".join(f"<w:p><w:r><w:t>{b}</w:t></w:r></w:p>" for b in body)}</w:body></w:document>')
        z.writestr("word/footnotes.xml", f"<w:footnotes><w:t>{note}</w:t></w:footnotes>")
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("law")
    long_ = "The rule of the harbour is kept by all who come to it. " * 6
    contents = {
        "a.txt": long_.encode(), "b.html": f"<style>x</style><p>&sect; 12&amp;13 {long_}</p>".encode(), "c.md": f"see [one](http://x) \\[2\\] [[Page 3]] {long_}".encode(), "d.docx": docx([long_], "a note"),
        "e.pdf": b"%PDF-1.4 nothing", "f.txt": b"", "g.txt": b"A short clause.", "h.txt": b"404 Not Found", "OUR-notes.txt": long_.encode(), "~$a.txt": b"lock", "i.bin": b"x", "j.txt": b"caf\xe9 " + long_.encode(),
        "k.txt": b"ATTESTIA-TOOL-OUTPUT " + long_.encode(), "sub/l.txt": long_.encode(), "sub/.hidden/m.txt": long_.encode(), "archive/n.txt": long_.encode(), "o.docx": b"no zip", "p.doc": b"old",
    }
    for name, content in contents.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_files(spark, folder):
    found = files.walk(spark, [folder, folder + "/sub", folder + "/none"], skip_dirs=("archive",))
    names = sorted(r["name"] for r in found.select("name").collect())
    assert names == sorted(["a.txt", "b.html", "c.md", "d.docx", "e.pdf", "f.txt", "g.txt", "h.txt", "OUR-notes.txt", "j.txt", "k.txt", "l.txt", "o.docx", "p.doc"])
    read = {r["name"]: r for r in files.read_any(found).collect()}
    assert "§ 12&13" in read["b.html"].text and "style" not in read["b.html"].text and read["c.md"].text.startswith("see one [2]") and "Page" not in read["c.md"].text
    assert "a note" in read["d.docx"].text and read["d.docx"].text.startswith("The rule") and read["j.txt"].text.startswith("caf�")
    assert read["o.docx"].status == "unreadable" and read["p.doc"].status == "unreadable" and read["o.docx"].text is None
    buckets = {r["name"]: r.bucket for r in files.audit(files.corpus_text(files.read_any(found))).collect()}
    assert buckets["OUR-notes.txt"] == buckets["k.txt"] == "derived" and buckets["f.txt"] == "empty" and buckets["g.txt"] == "short" and buckets["h.txt"] == "placeholder" and buckets["a.txt"] == "indexed"
    assert {r.bucket: r.files for r in files.advice(files.audit(files.read_any(found))).collect()}["derived"] == 2
    order = [(r.doc_ord, r["name"]) for r in files.ordered(found).orderBy("doc_ord").select("doc_ord", "name").collect()]
    assert order[0][0] == 1 and len({k for k, _ in order}) == 14
    if not any(files.engines().values()):
        assert read["e.pdf"].status == "missing_reader"
        with pytest.raises(Exception, match="not read"):
            files.require_read(files.read_any(found)).select("status").collect()
    assert files.walk(spark, [folder + "/none"]).count() == 0


def test_cache(spark, folder, tmp_path):
    found = files.walk(spark, [folder]).where("name IN ('a.txt', 'g.txt', 'c.md')")
    for _ in range(2):
        assert sorted(r["name"] for r in files.cached(found, str(tmp_path / "cache")).select("name").collect()) == ["a.txt", "c.md", "g.txt"]
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_choice_of_extractions():
    good = "word " * 200
    split = "wo rd " * 200
    assert files.chosen("x", good) == (good, "dead") and files.chosen(good, "") == (good, "") and files.chosen(good[:400], good) == (good[:400][:0] or good, "truncated")
    assert files.chosen(good, good[:400]) == (good, "") and files.chosen(split, good) == (good, "split words") and files.chosen(good, good) == (good, "")


def test_text_layers(spark):
    frame = spark.createDataFrame([("x" * 300, 1, False), ("x" * 300, 40, False), ("x", 1, False), ("x", 1, True), (None, None, None)], "t string, p int, f boolean")
    assert [r[0] for r in frame.select(files.no_text_layer(F.col("t"), F.col("p"), F.col("f"))).collect()] == [False, True, True, False, True]
    assert files.docx_light(docx(["one", "two"])) == "one two" and files.docx_light(b"no") == ""
    assert files.form_values({"a": {"/V": "/Yes", "/FT": "/Btn"}, "b": {"/V": "/Off"}, "c": {"/FT": "/Sig", "/V": "x"}, "d": {"/V": " 12 "}, "e": {}}) == "[FORM FIELDS: 2 filled]\na = Yes\nd = 12"


def test_placeholders(spark):
    law = "The applicant was denied access to the record and now says that access denied in this way breaks the rule of a fair hearing. "
    cases = {
        "Just a moment... checking your browser": True, law + "Please enable JavaScript.": True, law * 60 + "Please enable JavaScript.": False, law * 60 + "enable javascript; just a moment": True,
        "Access denied": True, law: False, "The requested URL /x was not found on this server": True, "Section 404 of the act is repealed.": False, None: False, "": False,
    }
    assert on(spark, cases, provenance.placeholder) == list(cases.values())


def test_urls(spark):
    primary, secondary, dated = [".gov", "uscis.gov"], ["law.cornell.edu/uscode"], ["/annual/", "govinfo.gov/content/pkg/cfr-", "?date="]
    cases = {
        "https://www.uscis.gov/x": "primary", "https://uscis.gov.ru/x": "lookalike", "http://uscis.com": "lookalike", "https://a-gov.us/": "lookalike", "https://www.milano.it/": "other", "https://law.cornell.edu/uscode/8": "nonauthoritative",
        "https://law.cornell.edu/blog": "other", "https://x.gov/annual/8": "snapshot", "https://evil.test/annual/8": "other", "https://www.govinfo.gov/content/pkg/CFR-2020": "snapshot", "https://x.gov/a?date=2020": "snapshot",
        "https://www.uscis.gov@evil.test/": "other", "HTTPS://WWW.USCIS.GOV.:443/": "primary", "uscis.gov/forms": "primary", "https://evil.test/?ref=law.cornell.edu/uscode": "other", None: "other", "": "other",
    }
    assert on(spark, cases, lambda c: provenance.classify(c, primary, secondary, dated)) == list(cases.values())
    assert on(spark, ["https://justia.com/x", "https://ecfr.gov/x", "http://a.test", None], lambda c: provenance.trust(c, ["ecfr.gov"])) == ["nonauthoritative", "primary", "unknown", "unknown"]


def test_downloads(spark):
    rows = [("https://ecfr.gov/a", None, 200, "text"), ("https://ecfr.gov/a", "https://ecfr.gov.evil.test", 200, "text"), ("https://a.test/", None, 200, "text"), ("https://ecfr.gov/a", None, 404, "x"), ("https://ecfr.gov/a", None, 200, " "), ("https://ecfr.gov/a", None, 200, "404 not found")]
    frame = spark.createDataFrame(rows, "u string, f string, s int, b string")
    told = [r[0] for r in frame.select(provenance.fetch_decision(F.col("u"), F.col("f"), F.col("s"), F.col("b"), ["ecfr.gov"])).collect()]
    assert told == ["keep", "refused: lookalike", "refused: unknown host", "rejected: status", "rejected: empty", "rejected: placeholder"]
    names = spark.createDataFrame([("https://x.gov/t/title-8.xml?part=245", None), ("https://x.gov/dir/page", "text/html; charset=x"), ("https://x.gov", None), ("https://x.gov/a b.pdf", None)], "u string, c string")
    assert [r[0] for r in names.select(provenance.file_name(F.col("u"), F.col("c"))).collect()] == ["title-8-part-245.xml", "page.html", "x.gov", "a-b.pdf"]


def test_revisions(spark):
    old = [(1, "One rule is here. Two rules are there. A third one stands."), (2, "Section 4 is kept. The fee is due."), (3, "The same text is here. It has two parts."), (4, None), (5, "gone")]
    new = [(1, "Two rules are there. One rule is here. A third one stands."), (2, "Section 4 is repealed. The fee is due."), (3, "The same\ntext is here.  It has two parts."), (4, "Words that are new."), (6, "x")]
    frame = lambda rows: spark.createDataFrame(rows, "k long, t string")
    found = {r.k: (r.gone, r.added, r.kept, r.moved) for r in reconcile.revisions(frame(old), frame(new), "k", "t").collect()}
    assert found == {1: (0, 0, 3, 2), 2: (1, 1, 1, 0), 3: (0, 0, 2, 0), 4: (0, 1, 0, 0)}
    told = sorted((r.k, r.status, r.sentence) for r in reconcile.revision_sentences(frame(old), frame(new), "k", "t").where("k = 2").collect())
    assert told == [(2, "added", "Section 4 is repealed."), (2, "gone", "Section 4 is kept.")]


def test_superseded_chains_and_circles(spark):
    rows = [("c", "b"), ("b", "a"), ("a", None), ("x", "y"), ("y", "x"), ("n", "gone"), (None, "lost")]
    found = {r.path for r in reconcile.superseded(spark.createDataFrame(rows, "path string, supersedes string")).collect()}
    assert found == {"a", "b", "x", "y", "gone", "lost"}


def test_register(spark):
    registry = spark.createDataFrame([("k", "k.txt", "s1", 1, None, "u", "primary")], "key string, path string, sha256 string, revision int, supersedes string, url string, trust string")
    inbox = spark.createDataFrame([("k.txt", "w " * 200, "s2", "", None, False, [["k"]])], "name string, text string, sha256 string, url string, claimed_trust string, model_in_path boolean, keys array<array<string>>")
    taken = library.intake(inbox, library.latest(registry), [])
    row = taken.first()
    assert (row.status, row.revision, row.supersedes, row.trust_label) == ("REVISION", 2, "k.txt", "UNKNOWN")
    whole = library.register(registry, taken)
    assert sorted(r.path for r in whole.collect()) == ["k.txt", "k__rev2.txt"] and library.latest(whole).first().revision == 2


def test_bank(spark):
    quote = "The director may approve a petition that is filed by any employer"
    bank = spark.createDataFrame([(f"# one\n> «{quote}»\n\n- [ ] open it\n- [x] done\n> a second\n> quotation in two lines\n",)], "md string")
    quotes = spark.createDataFrame([(1, f"**{quote}**"), (2, quote[:50]), (3, "a second quotation"), (4, None)], "k long, s string")
    assert {r.k: r.banked for r in library.in_bank(quotes, "s", bank, "md").collect()} == {1: True, 2: False, 3: False, 4: False}
    assert tuple(library.bank_status(bank, "md", bank, "md").first()) == (2, 1, 1)
    editions = spark.createDataFrame([("k", quote + ", but only in May. It then lasts for a year in all of the districts.")], "key string, text string")
    held = spark.createDataFrame([("k", quote), ("k", "The director may approve a petition ... lasts for a year in all of the districts"), ("k", "lasts for a year in all of the districts ... The director may approve a petition"), ("k", "words that are gone by now")], "key string, quote string")
    there = {r.quote: r.there for r in library.bank_impact(held, editions).collect()}
    assert [there[r.quote] for r in held.collect()] == [True, True, False, False]
    entry = spark.range(1).select(library.entry({"quote": F.lit("x"), "address": F.lit(" ")})).first()[0]
    assert entry.startswith("> x\n- address: TO DO") and on(spark, ["VERIFIED", "NOT_FOUND", "NO_SOURCE_ON_DISK", "SPLICED"], library.queue_mark) == ["ok", "gone", "ask", "wrong"]


def test_index(spark):
    md = "# Index\n| what | file |\n|---|---|\n| a | `x/One.txt` |\n\nprose"
    assert on(spark, [md, "no table"], lambda c: library.add_entry(c, F.lit("| b | `two.txt` |"))) == [md.replace("`x/One.txt` |", "`x/One.txt` |\n| b | `two.txt` |"), None]
    index = library.index_entries(spark.createDataFrame([(md,)], "md string"), "md")
    disk = spark.createDataFrame([("ONE.txt",), ("new.pdf",), ("new.text.md",)], "name string")
    assert sorted(map(tuple, library.orphans(disk, index).collect())) == [("new.pdf", "unindexed")]
    assert [r[0].proved for r in spark.createDataFrame([("x" * 3000 + " Smith v. Jones", "Smith", None), ("short Smith", "Smith", None), ("x" * 3000, None, None)], "t string, p string, s string").select(library.prove(F.col("t"), F.col("p"), F.col("s"))).collect()] == [True, False, False]
    assert on(spark, ["case/a.md", "case/archive/a.md", "other.md", "BANK.md"], lambda c: library.watched(c, ["case"], ["case/archive"], "bank.md")) == [True, False, False, True]


def test_current(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", t), ("b", t), ("c", t), ("d", t)], "path string, modificationTime timestamp")
    copies = spark.createDataFrame([("a", t, 2), ("b", t, 1), ("c", t - dt.timedelta(1), 2)], "path string, modificationTime timestamp, version int")
    assert {r.path: r.current for r in library.current(rows, copies, 2).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_answers(spark):
    texts = ["ok " * 200 + "END", "", "I cannot help with that. END", "ok " * 200, None, "i must decline " + "x " * 400 + "END"]
    told = on(spark, texts, lambda c: review.failures(c, F.lit("END"), 200))
    assert told == [[], ["EMPTY_ANSWER"], ["TOO_SHORT", "POLICY_REFUSAL"], ["NO_END_MARKER"], ["EMPTY_ANSWER"], []]
    answers = spark.createDataFrame([(1, "see https://a.gov.ru/x"), (2, "see https://x.gov/y"), (3, "nothing")], "k long, t string")
    grounds = review.grounding(answers, "k", "t", [".gov"], [], [])
    got = {r.k: (r.verdict, r.quality) for r in review.triage(answers, "k", "t", F.array().cast("array<string>"), F.array(F.lit("NO_TELEMETRY")), grounds).collect()}
    assert got == {1: ("DIRTY", ["NO_TELEMETRY", "GOV_LOOKALIKE_CITED"]), 2: ("OK", ["NO_TELEMETRY"]), 3: ("DIRTY", ["NO_TELEMETRY", "NO_URLS_CITED"])}
    hosts = spark.createDataFrame([("https://b.test https://a.test https://x.gov https://a.test/2",)], "t string")
    assert [tuple(r) for r in review.unknown_hosts(hosts, "t", [".gov"], [], [], 1).collect()] == [("a.test", 1)]
    registry = spark.createDataFrame([("_doc", True), ("one", True), ("two", None), ("off", False)], "name string, enabled boolean")
    assert sorted(r.name for r in review.channels(registry, skip=["two"]).collect()) == ["one"] and [r.name for r in review.channels(registry, only=["off"]).collect()] == ["off"]


def test_audit(spark):
    docs = spark.createDataFrame([(1, "The director may approve a petition that is filed by any employer in due time.")], "id long, text string")
    answers = spark.createDataFrame([("good", 'It says "The director may approve a petition that is filed by any employer in due time."'), ("bad", 'It says "the moon is made of a fine old cheese, as all the sailors know well"')], "who string, text string")
    audited = review.audit_answers(answers, "who", "text", docs, "id", "text").cache()
    assert {(r.answer, r.verdict) for r in audited.collect()} == {("good", "VERIFIED"), ("bad", "NOT_FOUND")}
    assert {r.answer: r.note for r in review.reviewer_totals(audited).collect()} == {"good": "", "bad": "check the corpus first"}


def test_anchors(spark):
    briefs = ["Is there any such requirement here?", "Does it hold? Or only in May?", "Quote the whole section 8 CFR 214.1.", "Explain 8 CFR 214.1.", "Is that really so?", None]
    assert on(spark, briefs, review.anchor_warnings) == [["invites yes or no"], ["false dichotomy"], [], ["not asked in full"], ["rhetorical framing"], []]


def test_transcripts(spark, tmp_path):
    lines = [
        '{"type": "assistant", "message": {"content": [{"type": "text", "text": "before"}, {"type": "tool_use"}]}}', '{"type": "user", "message": {"content": []}}',
        '{"type": "assistant", "isSidechain": true, "message": {"content": [{"type": "text", "text": "side"}]}}', '{"type": "assistant", "message": {"content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]}}', "no json",
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    found = files.last_answers(files.transcript_events(spark, str(tmp_path / "t.jsonl")), "file", "line").collect()
    assert [r.text for r in found] == ["one\ntwo"]


def test_mutants(spark):
    q = "The officer shall approve any petition that is filed in due form within 30 days prior to the end, except where the fee is not paid in full"
    of = lambda kind: on(spark, [q], lambda c: mutate.mutant(c, kind))[0]
    assert of("insert-operator").startswith("The officer shall not approve") and of("drop-negation").endswith("fee is paid in full") and "within 80 days" in of("digit")
    assert of("tail").endswith("in accordance with applicable law") and of("cut-condition").endswith("prior to the end") and " before the end" in of("synonym")
    assert on(spark, ["it shall not go; it is filed", "x", None], lambda c: mutate.mutant(c, "insert-operator")) == ["it shall not go; it is not filed", None, None]
    rows = spark.createDataFrame([(1, q, 1), (2, q.replace("30", "31"), 1), (3, q.replace("30", "32"), 2), (4, "short one", 2), (5, q + " ... more", 2), (6, q, None)], "id long, t string, doc long")
    base = mutate.base(rows, "t", "doc")
    assert sorted(r.id for r in base.collect()) == [1, 2, 3]
    spliced = {r.base_id: r.mutant for r in mutate.splices(base, "id", "t", "doc").collect()}
    assert spliced.keys() == {1, 2} and all(" ... " in m and "32 days" in m for m in spliced.values())
    assert {r.mutation for r in mutate.bank(base, "id", "t").collect()} == set(mutate.KINDS)
    dangerous = [v for v, (c, _) in verdicts.VERDICTS.items() if c == "DANGEROUS"]
    judged = spark.createDataFrame([("digit", "a", "OPERATOR"), ("digit", "b", "VERIFIED"), ("cut-condition", "c", "OPERATOR"), ("splice", "d", "SPLICED")], "mutation string, mutant string, verdict string")
    got = {r.mutation: (r.applicable, r.caught, r.missed, r.rate) for r in mutate.report(judged, dangerous).collect()}
    assert got == {"digit": (2, 1, 1, 50.0), "cut-condition": (1, 0, 1, 0.0), "splice": (1, 1, 0, 100.0), None: (4, 2, 2, 50.0)}


HOUR = 3600


def test_suppression():
    assert events.raised([0, HOUR, 11 * HOUR, 12 * HOUR, 13 * HOUR, 30 * HOUR], None) == ([True, False, False, True, False, True], 30 * HOUR)
    assert events.raised([], 5.0) == ([], 5.0) and events.raised([10.0], 5.0) == ([False], 5.0)


def test_suppression_of_a_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    batches = [[("f", "q", start), ("f", "q", start + dt.timedelta(hours=11)), ("f", "r", start)], [("f", "q", start + dt.timedelta(hours=12)), ("f", "q", start + dt.timedelta(hours=13)), ("f", "r", start + dt.timedelta(hours=1))]]
    schema = "file string, quote string, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    every = spark.createDataFrame(batches[0] + batches[1], schema).withColumn("id", F.monotonically_increasing_id())
    want = sorted((r.quote, r.ts) for r in events.suppress(every, ["file", "quote"], "ts", "id").collect())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = events.suppress_stream(stream, ["file", "quote"], "ts").writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.quote, r.ts) for r in spark.table("alarms").collect()) == want == [("q", start), ("q", start + dt.timedelta(hours=12)), ("r", start)]


def test_arrivals(spark, tmp_path):
    spark.createDataFrame([("a.txt", 1), ("b.txt", 2)], "name string, n int").write.parquet(str(tmp_path / "inbox"))
    stream = spark.readStream.schema("name string, n int").parquet(str(tmp_path / "inbox"))
    run = events.arrivals(stream, lambda batch: batch.where("n > 1"), str(tmp_path / "register"), str(tmp_path / "c"))
    run.processAllAvailable()
    run.stop()
    assert [r.name for r in spark.read.parquet(str(tmp_path / "register")).collect()] == ["b.txt"]
    queue = events.queue_turns(stream, lambda batch: library.queue(batch, "n", "name"), str(tmp_path / "queue"), str(tmp_path / "c2"))
    queue.processAllAvailable()
    queue.stop()
    assert spark.read.parquet(str(tmp_path / "queue")).where("queued").count() == 2


def test_modal_behind_an_accented_letter(spark):
    q = "the ciónñdo is here"
    assert on(spark, [q], lambda c: mutate.mutant(c, "insert-operator")) == ["the ciónñdo is not here"]
    assert on(spark, [q], lambda c: mutate.mutant(c, "insert-operator", mutate.ASCII_WORD)) == ["the ciónñdo not is here"]
