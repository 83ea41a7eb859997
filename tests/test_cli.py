"""The commands over a small matter."""

import json

import pytest

from attestia import cli, config

RULE = "Each person who is admitted shall keep the terms of the stay and shall leave on or before the day that is written in the book."


@pytest.fixture(scope="module")
def matter(tmp_path_factory):
    root = tmp_path_factory.mktemp("matter")
    for folder in ("law", "case", "out"):
        (root / folder).mkdir()
    (root / "law/8cfr-part-214.txt").write_text("214.1 " + RULE + " It ends there.")
    (root / "law/INDEX.md").write_text("| what | file |\n|---|---|\n| rule | `gone.txt` |\n")
    (root / "case/memo.md").write_text(f'As "{RULE}" 8 CFR 214.1 says, and Exhibit A-1 shows.\n\n> {RULE.replace("shall leave", "shall not leave")}\n')
    (root / "case/QUOTE-BANK.md").write_text(f"> {RULE}\n")
    (root / "case/QUOTE-QUEUE.md").write_text("- [ ] one\n- [x] two\n")
    (root / "out/A-1 letter.pdf").write_bytes(b"x")
    (root / "out/answer.md").write_text(f'It says "{RULE}", see https://www.ecfr.gov/x')
    (root / "out/secret.txt").write_text("password: hunter2hunter2hunter2")
    (root / "attestia.json").write_text(json.dumps({"_note": "x", "drafts": [{"tier": "A", "path": "case"}], "surnames": ["Li"]}))
    return root


def run(spark, matter, *args):
    return cli.main(["--config", str(matter), *map(str, args)], spark)


def test_commands(spark, matter, capsys):
    assert run(spark, matter, "check", "--strict", "--report", matter / "report") == 1 and "OPERATOR: 1" in (matter / "report/REPORT.md").read_text()
    assert run(spark, matter, "check") == 0 and run(spark, matter, "check", "--strict", "--tiers", "C") == 0
    assert run(spark, matter, "quote", RULE) == 0 and run(spark, matter, "quote", "words that are nowhere at all") == 1
    assert run(spark, matter, "gate", matter / "out/secret.txt") == 2 and run(spark, matter, "gate", matter / "out/answer.md") == 0
    assert run(spark, matter, "check-exhibits", matter / "case", "--exhibits", matter / "out") == 0 and run(spark, matter, "check-exhibits", matter / "nothing", "--exhibits", matter / "out") == 2
    assert run(spark, matter, "review", matter / "out/answer.md") == 0 and run(spark, matter, "mutate") == 0 and run(spark, matter, "library") == 0
    assert run(spark, matter, "bank") == run(spark, matter, "packs") == run(spark, matter, "doctor") == 0 and run(spark, matter, "close") == 1
    assert run(spark, matter, "brief", matter / "out/answer.md") == 0 and run(spark, matter, "sidecar", "--cache", matter / "cache") == 0
    said = capsys.readouterr().out
    assert "us-immigration" in said and "missing" in said and "1 surnames" in said


def test_intake(spark, matter, tmp_path):
    (tmp_path / "new.txt").write_text("245.1 " + "A person may apply for the change of the terms of a stay at the office. " * 8)
    (tmp_path / "new.txt.meta.json").write_text(json.dumps({"url": "https://www.ecfr.gov/x", "trust": "primary", "address": "8 CFR 245.1"}))
    register = tmp_path / "register.parquet"
    assert run(spark, matter, "intake", tmp_path, "--register", register) == 0
    rows = spark.read.parquet(str(register)).collect()
    assert [(r.key, r.path, r.revision, r.trust) for r in rows] == [("cfr|8|245", "new.txt", 1, "primary")]
    assert run(spark, matter, "intake", tmp_path, "--register", register) == 0 and spark.read.parquet(str(register)).count() == 1
    (tmp_path / "new.txt").write_text("245.1 " + "A person may not apply for the change of the terms of a stay at the office. " * 8)
    assert run(spark, matter, "intake", tmp_path, "--register", register) == 0
    assert sorted((r.path, r.revision) for r in spark.read.parquet(str(register)).collect()) == [("new.txt", 1), ("new__rev2.txt", 2)]
    (tmp_path / "new.txt.meta.json").unlink()
    assert run(spark, matter, "intake", tmp_path, "--register", register) == 4


def test_forms_without_an_engine(spark, matter):
    from attestia.sources import files

    if not any(files.engines().values()):
        assert run(spark, matter, "dump-forms", matter / "out") == 2
        with pytest.raises(ModuleNotFoundError, match="no form was read"):
            files.form_fields(files.walk(spark, [str(matter / "out")], (".pdf",)), "pypdf")
    assert [files._value(v) for v in ("/Off", True, None, "/Yes", 3)] == ["", "[X]", "", "Yes", "3"]


def test_settings(tmp_path, matter):
    assert config.load(str(matter / "case")).surnames == ["Li"] and config.load(str(matter)).missing() == []
    assert config.Config().citation_packs == ["us-federal"] and config.load(str(tmp_path)).root == str(tmp_path)
    (tmp_path / "attestia.json").write_text('{"unheard": 1}')
    with pytest.raises(ValueError, match="unheard"):
        config.load(str(tmp_path))
