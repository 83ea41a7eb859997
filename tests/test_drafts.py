"""What drafts quote and cite: normalisation, Markdown, blocks, quotations, packs, addresses, whole reports."""

import json

import pytest
from pyspark.sql import functions as F

from attestia.functions import extract as X
from attestia.functions import text as T
from attestia.plans import citations, report, verify

SOFT, NBSP = "­", " "


def on(spark, values, make):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, s string")
    return [r[1] for r in sorted(frame.select("k", make(F.col("s")).alias("x")).collect())]


def test_normalise(spark):
    cases = {
        "“a” ‘b’ – c": "\"a\" 'b' - c", "pre- and post-audit": "pre- and post-audit", "inad-\n  missible": "inad-missible", f"ap{SOFT}\npli{SOFT}cant": "applicant", "a…b": "a...b", f"a{NBSP}\t b ": "a b",
        "one [[Page 45.12-a]] two": "one two", "x​y﻿": "xy", None: "", "": "", " \n": "",
    }
    assert on(spark, cases, T.normalise) == list(cases.values())


def test_dehyph_and_alnum(spark):
    assert on(spark, ["inadmis- sibility", "re-entry", "a-b-c", "pre- and"], T.dehyph) == ["inadmissibility", "reentry", "ab-c", "preand"]
    assert on(spark, ["É, x_2: ß", None], T.alnum) == ["éx2ß", ""]


def test_strip_markdown(spark):
    cases = {
        "**bold** and __this__ `x`": "bold and this x", '> "quoted"': "quoted", "«a» ": "a", "a closing»": "a closing", '"straight only at the end"': "straight only at the end", 'ends with "': 'ends with "',
        "see [the rule](https://x.test/a) now": "see the rule now", "words [OPENED] [sic]": "words", "prescribe (* * *) and then": "prescribe (* * *) and then", "**a** **b**": "a b",
        f"left *{NBSP}*{NBSP}* out": f"left *{NBSP}*{NBSP}* out", "* * * * at first": "* * * * at first", "„«deep»": "deep", None: "", "": "",
    }
    assert on(spark, cases, T.strip_markdown) == list(cases.values())
    again = on(spark, list(cases.values()), T.strip_markdown)
    assert again == list(cases.values())


def test_blocks():
    draft = "# Head\nline one\nline two\n\n> quoted\n> more\n| a | b |\n| c | d |\n- item\n1. first\nprose\n>"
    assert X.blocks(draft) == [("p", "# Head line one line two"), ("q", "quoted more"), ("t", "| a | b |"), ("t", "| c | d |"), ("p", "- item"), ("p", "1. first prose"), ("q", "")]
    assert X.blocks(None) == X.blocks("") == []


def test_quotations(spark):
    long_ = "the officer may approve the form of any person who pays the fee"
    other = "no person shall be kept from the hall for want of a written paper"
    drafts = [
        f'It says "{long_}" and\nalso «{other}».', "> " + long_.replace(" the form", "\n> the form"), f"> «{long_}» · «{other}»", f"> ## Rules: {long_} and so on", f"> # Box\n> it holds \"{other}\" here", f'| "{long_}" | "{other}" |',
        f"\"{long_}\" and again “{long_.upper()}”", '"too short to count"', f'"{"слово " * 12}"', None, f'> {long_} - "{other}"',
    ]
    got = on(spark, drafts, X.quotations)
    assert got == [[long_, other], [long_], [long_, other], [], [other], [long_, other], [long_], [], [], [], [other]]
    assert on(spark, drafts[8:9], lambda c: X.quotations(c, drop_cyrillic=False)) == [[("слово " * 12).strip()]]


def test_candidates():
    law = "the director may at any time approve a petition that is filed in due form"
    assert X.pick(f"> {law}\n\nand \"{law}\"") == [law]
    assert X.pick("> " + law.replace(" a petition", "\n> a petition") + "\n") == [law]
    assert X.pick('"the model was given max_tokens and then it ended with exit 1 on line 12"') == [] and X.pick(None) == []
    assert X.pick('"это длинная строка на другом языке, в которой почти нет латинских букв вовсе"') == []


def test_exhibits_and_forms(spark):
    texts = ["Exhibit A-007b and a - 12, not G-28 or H-1b; K12 and X-1-2; M-4", "Form I-485, forms n400 and Form ETA–9089", None]
    assert on(spark, texts, X.exhibits) == [["A-7b", "A-12", "K-12"], [], []]
    assert on(spark, texts, X.forms) == [[], ["I-485", "N-400", "ETA-9089"], []]
    assert on(spark, ["A12 letter.pdf", "scan Exhibit B-3.pdf", "notes.md"], X.exhibit_of_file) == ["A-12", "B-3", None]


def test_urls(spark):
    assert on(spark, ["see https://a.test/x), HTTPS://A.test/x. and http://b.test/y,", None], X.urls) == [["https://a.test/x", "http://b.test/y"], []]


PACKS = citations.load(citations.available())


def test_every_shape_finds_its_sample():
    for spec in PACKS.specs:
        own = citations.Packs([spec])
        for shape in spec["shapes"]:
            if "sample" in shape:
                assert own.find(shape["sample"]) and own.keys(own.find(shape["sample"])), shape["sample"]
    assert PACKS.ids == ["us-federal", "us-immigration", "us-tax"] and "uscis.gov" in PACKS.domains
    with pytest.raises(ValueError, match="us-federal"):
        citations.load(["nothing"])


@pytest.mark.parametrize("cite,key", [
    ("8 CFR 214.2(f)(6)", ("cfr", "8", "214")), ("INA § 245(k)", ("usc", "8", "1255")), ("8 U.S.C. § 1255(k)", ("usc", "8", "1255")), ("INA 999", ("ina", "999")), ("I.R.C. § 162(a)", ("usc", "26", "162")),
    ("Treas. Reg. § 1.162-4", ("cfr", "26", "1")), ("Matter of Blas", ("matter", "blas")), ("7 USCIS-PM B.8", ("pm", "7", "b", "8")), ("Pub. L. No. 107-56", ("publaw", "107", "56")),
])
def test_keys(cite, key):
    assert key in PACKS.keys([cite])


def test_positions_labels_and_hints():
    assert PACKS.positions("by 8  CFR 214.1 and 8 CFR 214.1")[0] == ("8 CFR 214.1", 3) and PACKS.find("8 CFR 214.1, 8 CFR 214.1") == ["8 CFR 214.1"]
    assert PACKS.keys(["15 F.3d 12"]) == [] and PACKS.label(("cfr", "8", "214")) == "8 CFR part 214" and PACKS.label(("odd", "1")) == "odd 1"
    assert PACKS.is_primary("8 CFR 214") and not PACKS.is_primary("a letter")


@pytest.mark.parametrize("name,key,holds", [
    ("8CFR-part-214-ecfr.xml", ("cfr", "8", "214"), True), ("8cfr_214.xml", ("cfr", "8", "214"), True), ("8 CFR 214.2.xml", ("cfr", "8", "214"), True), ("8CFR-1245.2-EOIR.xml", ("cfr", "8", "245"), False),
    ("8cfr-part-245a-ecfr.xml", ("cfr", "8", "245"), False), ("8USC-1255-uscode.xml", ("usc", "8", "255"), False), ("part214-title8.txt", ("cfr", "8", "214"), True), ("notes.txt", ("cfr", "8", "214"), False),
])
def test_file_names(name, key, holds):
    assert PACKS.holds(key, citations.Source(f"/law/{name}", "")) is holds


def test_file_bodies():
    part = citations.Source("x.txt", "214.1 one 214.2 two 214.3 three")
    assert PACKS.holds(("cfr", "8", "214"), part) and not PACKS.holds(("cfr", "8", "214"), citations.Source("x.txt", "as 214.1 says"))
    chapter = citations.Source("chapter-8.txt", "Volume 7 - Part A - Chapter 8")
    assert not PACKS.holds(("pm", "7", "b", "8"), chapter) and PACKS.holds(("pm", "7", "a", "8"), chapter)


def test_rings():
    quote = "the text that is quoted here, as 9 FAM 302.8 says, at length"
    draft = "far 8 CFR 1.1 " + "x " * 100 + f"near 8 CFR 214.2 \"{quote}\" and 8 U.S.C. § 1255 " + "y " * 100 + "26 U.S.C. § 61"
    near, far = citations.window(draft, quote, PACKS)
    assert near == ["8 CFR 214.2", "8 U.S.C. § 1255"] and "9 FAM 302.8" in far and "8 CFR 1.1" in far
    assert citations.window("nothing", quote, PACKS) == ([], [])


SOURCES = [
    (1, "law/8cfr-part-214.txt", "214.1 Each person who is admitted shall keep the terms of the stay and shall leave on or before the day that is written in the book."),
    (2, "law/8cfr-part-245.txt", "245.1 A person may apply for the change of the terms of a stay at the office of the district in which the person lives and works."),
    (3, "law/8cfr-part-103.txt", "103.2 Every form is to be signed by the person who hands it in, and the fee is to be paid in full at the same desk on that day."),
]


def reports(spark, bodies, sources=SOURCES):
    drafts = spark.createDataFrame([("A", f"d{k}.md", b) for k, b in enumerate(bodies)], "tier string, file string, body string")
    return report.check_drafts(drafts, spark.createDataFrame(sources, "doc_ord long, path string, text string"), PACKS)


def test_addresses(spark):
    one, two, three = (s[2].split(" ", 1)[1] for s in SOURCES)
    bodies = [
        f'"{one}" 8 CFR 214.1', f'"{one}" 8 CFR 245.1 is cited', f'"{two}" and no address', '"no person has ever put these words into any rule of the district office" 8 CFR 999.1',
        '"no man has ever put those words into any rule of the northern office here" 8 CFR 103.2', f'"{three}" 8 CFR 777.2', '"nobody wrote these words in a letter to the harbour office of that year"',
    ]
    found = {r.quote[:20] + r.sites[0]["file"]: r for r in reports(spark, bodies).collect()}
    told = sorted((r.sites[0]["file"] if r.n_sites == 1 else "both", r.verdict, r.address and r.address.status, r.kind) for r in found.values())
    assert told == sorted([
        ("both", "VERIFIED", "MATCHED", ""), ("d2.md", "VERIFIED", "NO_NEARBY_CITATION", ""), ("d3.md", "NO_SOURCE_ON_DISK", "ADDRESS_NOT_IN_CORPUS", ""), ("d4.md", "NOT_FOUND", "MISMATCH", "absent"),
        ("d5.md", "VERIFIED", "ADDRESS_NOT_IN_CORPUS", ""), ("d6.md", "NOT_FOUND", None, "evidentiary"),
    ])


def test_found_elsewhere_and_repaired(spark):
    one = SOURCES[0][2].split(" ", 1)[1]
    elsewhere = reports(spark, [f'"{one}" 8 CFR 245.1']).first()
    assert elsewhere.verdict == "FOUND_ELSEWHERE" and elsewhere["class"] == "DANGEROUS" and elsewhere.address.expected == ["law/8cfr-part-245.txt"]
    copy = [*SOURCES[:1], (2, SOURCES[1][1], SOURCES[1][2] + " " + one), SOURCES[2]]
    mended = reports(spark, [f'"{one}" 8 CFR 245.1'], copy).first()
    assert mended.verdict == "VERIFIED" and mended.doc_ord == 2 and mended.address.matched == "after binding"


def test_mixed_provisions_grid_and_files(spark, tmp_path):
    one = SOURCES[0][2].split(" ", 1)[1]
    rows = reports(spark, [f'"{one}" 8 CFR 214.1', f'"{one.replace("shall keep", "shall not keep")}" 8 CFR 214.1', f'"{one}" 8 CFR 214.1']).cache()
    assert [tuple(r) for r in report.mixed_provisions(rows, PACKS).collect()] == [("8 CFR part 214", 1, 1)]
    assert [(r.verdict, r.n_sites) for r in report.ordered(rows).collect()] == [("OPERATOR", 1), ("VERIFIED", 2)]
    assert tuple(report.asks(rows).first()) == (1, 0) and report.exit_code(rows, True) == 1 and report.exit_code(rows, False) == 0
    assert {r.status: r.n for r in report.address_counts(rows).collect()} == {"MATCHED": 2}
    path = report.write(rows, str(tmp_path / "out"), PACKS)
    told = open(path, encoding="utf-8").read()
    assert "OPERATOR: 1" in told and "8 CFR part 214 is quoted right 1 times and wrong 1 times" in told and spark.read.json(str(tmp_path / "out/result")).count() == 2


def test_no_sources_is_an_error(spark):
    with pytest.raises(ValueError, match="empty"):
        reports(spark, ["x"], [(1, "a", "b")][:0])


def test_tiers(spark):
    frame = spark.createDataFrame([("a.md", "x"), ("b.md", "ATTESTIA-TOOL-OUTPUT y"), ("c.md", None)], "file string, body string")
    rows = report.tiered(frame, F.lit("B"))
    assert [r.tier for r in rows.orderBy("file").collect()] == ["B", "D", "B"] and report.only(rows, "A.M", ["B"]).count() == 1


def test_packs_are_json_a_user_may_add(tmp_path):
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"id": "own", "shapes": [{"regex": r"\bRule (\d+)", "address": {"kind": "rule", "groups": [1], "label": "Rule %s", "file_match": [{"where": "body", "all": ["rule {g1}"]}]}}]}))
    own = citations.load([str(path)])
    assert own.keys(own.find("by Rule 12")) == [("rule", "12")] and own.holds(("rule", "12"), citations.Source("a", "the Rule 12 text")) and own.label(("rule", "12")) == "Rule 12"


def test_no_places_of_nothing(spark):
    corpus = verify.stored(verify.prepare(spark.createDataFrame([(1, "x")], "id long, text string"), "id", "text"))
    assert list(verify.located(spark.createDataFrame([], "k long, role string, ord int, idx string, needle string"), corpus)) == []


def test_html_entities_without_semicolon(spark):
    page = "<p>a &amp; b &amp;copy; &quot;c&quot; &copy; &nosuch; &notit; &#167; &am &amp"
    assert on(spark, [page, None], lambda c: T.html_text(c, closed=True)) == [' a & b &copy; "c" © &nosuch; &notit; § &am &amp', ""]
    assert on(spark, [page], T.html_text) == [' a & b &copy; "c" © &nosuch; ¬it; § &am &']
