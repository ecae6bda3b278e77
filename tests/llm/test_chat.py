import random

from flockpoint.llm.chat import digests, format_trees, message_chains, paths, turns_of

NODES = "tree long, id long, parent long, role string, text string, score double"


def test_best_paths_of_random_trees(spark):
    rng = random.Random(8)
    nodes = []
    for tree in range(12):
        for k in range(rng.randint(1, 40)):
            parent = None if k == 0 else tree * 100 + rng.randrange(max(0, k - 3), k)
            nodes.append((tree, tree * 100 + k, parent, "user", f"t{k}", float(rng.randint(0, 9))))
    df = spark.createDataFrame(nodes, NODES)
    by = {n[1]: n for n in nodes}

    def up(i):
        return ([] if by[i][2] is None else up(by[i][2])) + [i]

    want = set()
    inner = {n[2] for n in nodes}
    for tree in range(12):
        leaves = [n[1] for n in nodes if n[0] == tree and n[1] not in inner]
        leaves.sort(key=lambda i: (-sum(by[x][5] for x in up(i)), i))
        for rank, leaf in enumerate(leaves[:3], 1):
            want |= {(tree, leaf, rank, x, d) for d, x in enumerate(up(leaf), 1)}
    assert {tuple(r) for r in paths(df, 3).select("tree", "leaf", "rank", "id", "depth").collect()} == want


def test_texts_come_back(spark):
    rng = random.Random(6)
    bits = ["### ", "assistant", ": ", "</turn>", "\n", "\\", "\\h", "#", "<", "é", "\U0001f600", "", "user", "\\b\\l"]
    rows = [(c, t, rng.choice(["user", "assistant", "a: b#", None]), "".join(rng.choices(bits, k=6))) for c in range(30) for t in range(rng.randint(1, 20))]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    for r in format_trees(message_chains(df)).collect():
        want = [(x[2] or "", x[3]) for x in rows if x[0] == r["tree"]]
        told = turns_of(r["formatted"])
        assert [t[:2] for t in told] == want and r["n_turns"] == len(want)
        assert [(s["begin"], s["end"]) for s in r["loss_spans"]] == [t[2:] for t in told if t[0] == "assistant"]


def test_edges(spark):
    schema = "conv_id long, turn int, role string, text string, size int, tree string"
    rows = [(1, 1, "user", None, 1, "x"), (1, 1, "user", None, 1, "x"), (1, None, "assistant", "first", None, None), (None, 0, "assistant", "", 0, ""), (2, 0, "assistant", "long " * 50_000, 0, "")]
    out = {r["tree"]: r for r in digests(format_trees(message_chains(spark.createDataFrame(rows, schema)))).collect()}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 3, None: 1, 2: 1}
    assert out[1]["loss_chars"] == 5 and out[2]["loss_chars"] == 250_000
    assert digests(format_trees(message_chains(spark.createDataFrame([], schema)))).count() == 0
    orphan = spark.createDataFrame([(1, 5, 99, None, "a", None), (1, 6, 5, "assistant", "b", 1.0)], NODES)
    assert [r["n_turns"] for r in format_trees(orphan).collect()] == [2]


def test_cycles_and_repeated_ids_end(spark):
    schema = "tree long, id long, parent long, role string, text string, score double"
    rows = [(1, 5, 6, "user", "a", 1.0), (1, 6, 5, "assistant", "b", 1.0), (1, 7, 6, "user", "c", 1.0), (2, 8, 8, "user", "self", None), (3, 9, None, "user", "x", 0.0), (3, 9, None, "user", "w", 0.0), (3, 10, 9, "assistant", "y", 0.0)]
    told = {r["tree"]: [t[1] for t in turns_of(r["formatted"])] for r in format_trees(spark.createDataFrame(rows, schema)).collect()}
    assert told == {1: ["a", "b", "c"], 2: ["self"], 3: ["w", "y"]}
