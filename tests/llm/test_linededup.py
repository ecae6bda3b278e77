import hashlib
import random
from collections import defaultdict

from flockpoint.llm.linededup import drop_boilerplate


def plain(rows, ratio):
    filled = lambda line: line.strip(" \t\x0b\x0c\r") != ""
    own = lambda text: {x for x in text.split("\n") if filled(x)}
    kind = lambda text: tuple(sorted(hashlib.md5(x.encode()).hexdigest() for x in own(text))[:2])
    pages, on = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        if text is not None:
            pages[host].add(text)
    for host, texts in pages.items():
        for t in texts:
            for line in own(t):
                on[host, line].add(t)
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines, kinds = text.split("\n"), {kind(t) for t in pages[host]}
        over = lambda x: len(on[host, x]) >= 2 and len({kind(t) for t in on[host, x]}) > ratio * len(kinds)
        gone = [filled(x) and over(x) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return out


def test_against_plain_python(spark):
    rng = random.Random(9)
    common = ["home | about", "copyright", " ", "menu é"]
    rows = []
    for i in range(300):
        lines = [f"own line {rng.randint(0, 400)} of page" for _ in range(rng.randint(0, 6))]
        lines += [x for x in common if rng.random() < 0.4]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    rows += [(1000 + i, "copied page\nwith lines", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = [tuple(r) for r in drop_boilerplate(df).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=str) == sorted(plain(rows, 0.1), key=str) and sum(r[3] for r in got) > 50


def test_small_hosts_and_short_pages(spark):
    rows = [(i, f"text {i} a\ntext {i} b\nfooter", "four") for i in range(4)]
    menu = "\n".join(f"menu {j}" for j in range(6))
    rows += [(100 + i, f"{menu}\nown {i}", "fifty") for i in range(50)]
    rows += [(200, "only page\nof its host", "one"), (201, "only page\nof its host", "one")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r["text"] for r in drop_boilerplate(df).collect()}
    assert all(got[i] == f"text {i} a\ntext {i} b" for i in range(4)) and all(got[100 + i] == f"own {i}" for i in range(50))
    assert got[200] == got[201] == "only page\nof its host"


def test_near_copies_are_left_to_document_dedup(spark):
    rng = random.Random(3)
    base = [f"sentence {j} of the copied page" for j in range(20)]
    rows = []
    for i in range(60):  # a fifth of the host
        lines = list(base)
        lines[rng.randint(0, 19)] = f"edited {i}"
        rows.append((i, "\n".join(["footer", *lines]), "a"))
    rows += [(100 + i, "\n".join(["footer", *(f"line {i} {j}" for j in range(20))]), "a") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r for r in drop_boilerplate(df).collect()}
    assert all(r["n_dropped"] == 1 and "footer" not in r["text"] for r in got.values())


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a\nb", "s")], "doc_id int, text string, source string")
    plan = drop_boilerplate(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_edges(spark, edge, empty):
    clash = edge.withColumnRenamed("n", "left").withColumnRenamed("id", "boiler").withColumnRenamed("size", "host")
    assert drop_boilerplate(clash).select("left", "boiler", "host").distinct().count() == clash.select("left", "boiler", "host").distinct().count()
    out = drop_boilerplate(edge)
    assert set(out.columns) == {*edge.columns, "n_lines", "n_dropped"}
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    assert sorted(map(key, out.collect())) == sorted(map(key, edge.collect()))
    assert drop_boilerplate(empty).count() == 0
