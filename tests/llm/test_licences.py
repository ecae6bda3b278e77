import random
import textwrap

import pytest

from flockpoint.llm.licences import TEMPLATES, fit, licence_hits, sample_paragraphs


@pytest.fixture(scope="module")
def scanner(spark):
    rng = random.Random(5)
    vocabulary = ["version", "public", "the", "of", "work", "license", "terms", "all", "general"] + ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    texts = ["\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(3, 20))) for _ in range(5)) for _ in range(100)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    return fit(sample_paragraphs(docs, documents=1000))


def test_templates_among_other_lines(spark, scanner):
    rows, want = [], {}
    for i, (family, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts):
        case = (str, str.upper, str.lower)[i % 3]
        rows.append((i, f"some words before\n\n{case(t)} more words\nand after it"))
        want[i] = family
    got = {r["doc_id"]: [(h["paragraph"], h["family"]) for h in r["hits"]] for r in licence_hits(spark.createDataFrame(rows, "doc_id int, text string"), scanner).collect()}
    right = sum(got[i] == [(2, f)] for i, f in want.items())
    assert right >= 0.95 * len(want), [(i, want[i], got[i]) for i in want if got[i] != [(2, want[i])]]


@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_notices(spark, scanner, mark):
    notices = [(f, t) for f, ts in TEMPLATES.items() for t in ts if len(t.split()) >= 15]
    rows = []
    for i, (_, t) in enumerate(notices):
        lines = textwrap.wrap(t, 50)
        assert len(lines) > 1
        rows.append((i, "some words before\n\n" + "\n".join(mark + x for x in lines) + "\n\nand after it"))
    got = {r["doc_id"]: {h["family"] for h in r["hits"]} for r in licence_hits(spark.createDataFrame(rows, "doc_id int, text string"), scanner).collect()}
    assert [(f, got[i]) for i, (f, _) in enumerate(notices) if f not in got[i]] == []


def test_near_misses_are_unknown(spark, scanner):
    texts = ["the general public may work under any terms", "we have a license to drive", "version 2.0 of the work", "MIT is a school", "free of charge"]
    out = licence_hits(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), scanner)
    assert [r["hits"] for r in out.collect()] == [[]] * len(texts)


def test_planted_lines(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    names = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    got = {r["doc_id"]: r["families"].split(",") for r in entry.queries()["op7_licences"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for family, line in names.items():
            assert (line in r["text"].split("\n")) == (family in got[r["doc_id"]]), r["doc_id"]


def test_edges(spark, scanner, edge, empty):
    assert [len(r["hits"]) for r in licence_hits(edge, scanner).collect()] == [0] * edge.count()
    assert licence_hits(empty, scanner).count() == 0
    assert fit(sample_paragraphs(empty), copies=2, rounds=5).temperature > 0
