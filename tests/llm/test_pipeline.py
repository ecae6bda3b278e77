import re
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from flockpoint.llm.queries import components_sql, line_dedup_sql, sql_table
from flockpoint.session import cut

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "conversations"]


def duck(sql, docs=None):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    if docs is not None:
        con.register("given", docs.toPandas())
    return con.sql(sql).fetchall()


@pytest.mark.parametrize("name", sorted(sql_table()))
def test_queries_equal_their_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(sql_table()[name])
    assert set(want.columns) == set(got.columns)
    columns = sorted(got.columns)
    rows = lambda records: sorted(map(str, records))
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want.select(", ".join(columns)).fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, SF))
        assert docs.columns == columns
        seen[name] = before, docs
    before, after = seen["language_id"]
    assert after.count() <= before.count() and after.filter("lang is null").isEmpty()
    before, after = seen["line_dedup"]
    want = duck(f"with {line_dedup_sql('given')} select doc_id, text from cleaned", before)
    assert sorted(want) == sorted((r["doc_id"], r["text"]) for r in after.collect())
    before, after = seen["near_dedup"]
    want = duck(f"with recursive {components_sql('given', 5, 80)} select doc_id from comps where doc_id = component_id", before)
    assert sorted(r[0] for r in want) == sorted(r["doc_id"] for r in after.collect())
    before, after = seen["mix"]
    words, sizes, took = (lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))), defaultdict(list), defaultdict(int)
    for r in before.collect():
        sizes[r["source"]].append(words(r["text"]))
    for r in after.collect():
        took[r["source"]] += words(r["text"])
    for s, n in sizes.items():
        assert took[s] <= 2 * sum(n) + max(n)
    assert abs(sum(took.values()) - 1.5 * sum(map(sum, sizes.values()))) <= sum(max(n) for n in sizes.values()) / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert sum(r["piece"] == 0 for r in packed) == docs.count()


def test_run_goes_through_all_stages(spark):
    rows = entry.queries()["pipeline"](spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = rows.groupBy("sequence_id").sum("length").toDF("s", "n")
    assert full.filter("n > 2048").isEmpty() and full.count() > 10


def test_stages_take_edges(spark, edge, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge.select(columns), empty.select(columns)):
        for _, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, SF))
        docs.count()
