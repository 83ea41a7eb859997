"""Every query with SQL gives what DuckDB gives, on the smallest tables; the others hold to a rule of their own."""

import re
from pathlib import Path

import duckdb
import pytest

from attestia.operators import gate
from attestia.plans import queries, registry  # noqa: F401

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_like_duckdb(spark, db, name):
    ours = rows(registry.QUERIES[name](spark, DATA).toPandas())
    assert ours and ours == rows(db.execute(registry.ORACLE[name]).df())


def test_those_without_sql_are_few():
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"verdict_counts", "report_grid", "scrub_docs", "mutation_report"}


def test_verdict_counts_are_all_passages(spark, db):
    found = registry.QUERIES["verdict_counts"](spark, DATA).collect()
    assert sum(r.n for r in found) == db.execute("SELECT count(*) FROM benchmark").fetchone()[0]
    exact = db.execute("SELECT count(DISTINCT item_id) FROM benchmark b JOIN documents d ON contains(d.text, b.text)").fetchone()[0]
    assert sum(r.n for r in found if r.verdict in ("VERIFIED", "TRUNCATED_CONDITION", "TRUNCATED_OPENING", "WRONG_SPEAKER")) >= exact


def test_report_grid_is_whole(spark, db):
    found = {r.verdict: r for r in registry.QUERIES["report_grid"](spark, DATA).collect()}
    assert len(found) == 18 and found["total"].total == db.execute("SELECT count(DISTINCT lower(substr(text, 1, 110))) FROM benchmark").fetchone()[0]
    assert found["total"].total == sum(r.total for v, r in found.items() if v != "total") and all(r.total == r.A + r.B + r.C + r.D for r in found.values())


def test_mutation_report_adds_up(spark):
    found = {r.mutation: r for r in registry.QUERIES["mutation_report"](spark, DATA).collect()}
    whole = found.pop(None)
    assert whole.applicable == sum(r.applicable for r in found.values()) and whole.applicable == whole.caught + whole.missed and found["tail"].missed == 0


def test_scrub_like_python(spark, db):
    """Python's own regular expressions, from the same shapes, on the whole table."""
    space = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    patterns = []
    for severity, kind, p in gate.detectors():
        p = p.replace(gate.S, f"[{re.escape(space)}]").replace(r"\p{Nd}", r"\d").replace(r"\p{L}\p{N}_", r"\w").replace("(?iu)", "(?i)").replace("(?iu:", "(?i:").replace(f"[.#[{re.escape(space)}]]", f"[.#{re.escape(space)}]")
        patterns.append((re.compile(p), f"[REDACTED:{kind}]" if severity == "SECRET" else f"[{kind}]"))
    want = {}
    for k, text in db.execute("SELECT doc_id, text FROM documents").fetchall():
        for p, mark in patterns:
            text = p.sub(mark, text or "")
        want[k] = text
    found = {r.doc_id: r.text for r in registry.QUERIES["scrub_docs"](spark, DATA).collect()}
    assert found == want and sum(t.count("[EMAIL]") for t in found.values()) > 0
