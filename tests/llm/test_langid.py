import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from flockpoint.llm.langid import sample_by_label, Model, identify, tagged, train, windows


def plain_bits(text, training, order):
    """Prediction by partial matching, byte by byte, with dictionaries."""
    seen = defaultdict(Counter)
    for t in training:
        data = b"\n" * order + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[data[i - k : i]][data[i]] += 1
    data, total = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(data)):
        gone = set()
        for k in range(order, -1, -1):
            here = {c: n for c, n in seen.get(data[i - k : i], {}).items() if c not in gone}
            if not here:
                continue
            weight = sum(here.values()) + len(here)
            if data[i] in here:
                total += math.log2(weight / here[data[i]])
                break
            total += math.log2(weight / len(here))
            gone |= set(here)
        else:
            total += math.log2(256 - len(seen[b""]))
    return total


def model_of(training, order):
    grams = {}
    for lang, texts in training.items():
        w, first, length = windows(pa.array(texts), order)
        got = np.concatenate([w[a : a + n] for a, n in zip(first, length, strict=True)])
        keys, n = np.unique(got.astype(np.uint64), return_counts=True)
        grams[lang] = keys, n.astype(float)
    return Model.of(order, grams)


def test_code_lengths_are_exact():
    rng = random.Random(1)
    training = {"x": ["abracadabra abra", "cadabra"], "y": ["banana bandana", "ananas é"]}
    texts = ["abra", "", "banana", "zzz", "é ab"] + ["".join(rng.choices("abcnrd zé", k=rng.randint(1, 30))) for _ in range(40)]
    for order in (1, 2, 3):
        got = model_of(training, order).code_lengths(pa.array(texts))
        for i, t in enumerate(texts):
            for j, lang in enumerate(training):
                assert abs(got[i, j] - plain_bits(t, training[lang], order)) < 1e-3, (order, t, lang)


def test_edges_and_columns(spark, edge, empty):
    model = train(edge.select("text", "lang"), docs_per_language=100)
    out = identify(edge, model).collect()
    assert len(out) == edge.count()
    pred = [(r["doc_id"], r["lang_pred"]) for r in out]
    assert {p for i, p in pred if i in (2, 3, 5, 6)} == {"und"} and (4, "en") in pred and (7, "fr") in pred
    assert all(0 <= r["score"] <= 1 for r in out)
    assert tagged(edge, model).columns == [c for c in edge.columns if c != "score"] + ["lang_pred", "score", "bits_per_byte"]
    assert identify(empty, model).count() == 0
    nothing = train(empty.select("text", "lang"))
    assert {r["lang_pred"] for r in identify(edge, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    out = entry.queries()["op1_language_id"](spark, sf).filter("held_out")
    truth = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "lang")
    rows = out.join(truth, "doc_id").selectExpr("avg(cast(lang = lang_pred as int)) a", "count(*) n").first()
    assert rows["n"] > 100 and rows["a"] > 0.98


def test_a_language_of_many_copies_is_learned(spark):
    rows = [("en", f"the {i} of and") for i in range(50)] + [("xx", f"text number {i}") for i in range(5)] * 4000
    df = spark.createDataFrame(rows, "lang string, text string")
    few = [tuple(r) for r in sample_by_label(df, "lang", 2000, "text").collect()]
    assert len(few) == len(set(few)) == 55 and sum(lang == "xx" for lang, _ in few) == 5
