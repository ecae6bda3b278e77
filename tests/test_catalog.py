import pathlib

import __spark_entry__ as entry

SRC = pathlib.Path(__file__).resolve().parents[1] / "flockpoint"


def test_tables_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 85


def test_no_unsafe_calls():
    text = "\n".join(p.read_text() for p in SRC.rglob("*.py"))
    assert "localCheckpoint" not in text and "crossJoin" not in text


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n"] for r in rows) == 200
