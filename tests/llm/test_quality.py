import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flockpoint.llm import quality
from flockpoint.llm.textbytes import Texts


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    size, m = 1 << quality.BITS, 3
    machine = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 4)), rng.normal(size=m), rng.normal(size=(m, 4)), np.zeros(m), np.ones(m))
    bucket, x, bounds = quality.hashed_words(Texts(pa.array(["a b c a", "", "d é"])))
    dense = rng.normal(size=(3, m))
    got = machine.logits(bucket, x, bounds, dense)
    for r in range(3):
        rows = slice(bounds[r], bounds[r + 1])
        w = np.concatenate([machine.w[bucket[rows]], machine.wd])
        v = np.concatenate([machine.v[bucket[rows]], machine.vd])
        f = np.concatenate([x[rows], dense[r]])
        pairs = sum(v[i] @ v[j] * f[i] * f[j] for i in range(len(f)) for j in range(i))
        assert abs(got[r] - (0.3 + w @ f + pairs)) < 1e-9


def test_learns_an_interaction():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=(3000, 2))
    y = (raw[:, 0] * raw[:, 1] > 0).astype(float)  # no single number tells
    none = (np.zeros(0, np.int64), np.zeros(0))
    machine = quality.fit([none] * 2400, raw[:2400], y[:2400], rounds=20)
    bounds = np.zeros(601, np.int64)
    z = machine.logits(*none, bounds, machine.dense(raw[2400:]))
    assert ((z > 0) == y[2400:]).mean() > 0.9


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    out = entry.queries()["op6_quality"](spark, sf).filter("held_out")
    row = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").selectExpr("avg(cast(predicted = quality as int)) a", "count(*) n").first()
    assert row["n"] > 40 and row["a"] > 0.9


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, 1), (8, None), (None, 1), (1, 0)], "doc_id long, quality int")
    sample = quality.labelled_sample(edge.select("doc_id", "text", "n_chars"), labels, "quality", rows=1000)
    assert {r["doc_id"]: r["y"] for r in sample.select("doc_id", "y").collect()} == {1: 0, 4: 0, 7: 1}
    model = quality.train(sample, metadata=("n_chars",))
    out = quality.score(edge, model, metadata=("n_chars",)).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert quality.score(empty, model, metadata=("n_chars",)).count() == 0
    assert quality.train(sample.filter(F.lit(False))) is None
    assert {r["score"] for r in quality.score(edge, None).collect()} == {0.5}


def test_repeated_ids_are_one_row_of_the_sample(spark):
    docs = spark.range(20_000).selectExpr("id % 20 as doc_id", "concat('text ', id % 60) as text", "id as n_chars")
    labels = spark.range(20).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = quality.labelled_sample(docs, labels, "quality", rows=100).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(20)) and all(r["y"] == r["doc_id"] % 2 for r in got)
