"""Hubs, searches from both ends and numbering, against plain versions; how work is dealt."""

import random

from pyspark.sql import functions as F

from kgweave.operators import context as X
from kgweave.operators import graph_build as B
from kgweave.operators import graph_ops as G


def graph(rng, n, m):
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


def plain_paths(edges, a, most):
    near = {}
    for x, y in edges:
        if x != y:
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
    level, seen = {a: a}, {a: (0, a)}
    for h in range(1, most + 1):
        nxt = {}
        for node, path in level.items():
            for y in near.get(node, ()):
                if y not in seen:
                    nxt[y] = min(nxt.get(y, f"{path}>{y}"), f"{path}>{y}")
        level = nxt
        seen |= {k: (h, p) for k, p in nxt.items()}
    return seen


def test_paths_from_both_ends(spark):
    rng = random.Random(101)
    for n, m, size in ((60, 70, 3), (40, 50, 10**6), (200, 260, 4)):
        edges = [*graph(rng, n, m), ("n1", "n10"), ("n1", "n100"), ("n1>", "n10")]
        df = spark.createDataFrame(edges, "source string, target string")
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(40)] + [("n1", "n1"), ("nowhere", "n1")]
        ask = spark.createDataFrame(pairs, "from_id string, to_id string")
        adjacency = G.Adjacency(df, size)
        for most in (1, 3, 4, 5):
            found, report = G.search_paths(df, ask, most, adjacency)
            want = {(a, b, *plain_paths(edges, a, most)[b]) for a, b in pairs if a != b and b in plain_paths(edges, a, most)}
            assert {tuple(r) for r in found.collect()} == want
            assert len(report) <= most and all(side in ("from", "to") and rows >= 0 for side, _, rows in report)


def test_search_from_both_ends_stays_narrow(spark):
    edges = [("a", f"x{i}") for i in range(30)] + [(f"x{i}", f"y{i}_{j}") for i in range(30) for j in range(30)] + [("x0", "z"), ("z", "b")]
    found, report = G.search_paths(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([("a", "b")], "from_id string, to_id string"))
    assert tuple(found.first()) == ("a", "b", 3, "a>x0>z>b")
    assert sum(rows for _, _, rows in report) < 50  # one-sided, the third level alone has 900


def test_a_hub_is_in_many_tasks(spark):
    hub = spark.range(200_000).select(F.lit("hub").alias("source"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("target"))
    adjacency = G.Adjacency(hub, 5_000)
    sizes = [r["count"] for r in adjacency.edges.where("src = 'hub'").groupBy("block").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 1.2 * sorted(sizes)[20]
    seeds = spark.createDataFrame([(1, "hub"), (2, "n7")], "question_id int, node string")
    counts = dict(map(tuple, G.neighbourhood(hub, seeds, 2, adjacency).groupBy("question_id").count().collect()))
    assert counts == {1: 200_001, 2: 200_001}
    lines = hub.select(F.lit(1).alias("k"), F.col("target").alias("line"))
    r = X.first_lines(lines, ["k"], 3).first()
    assert (r.n_lines, r.text) == (200_000, "n0\nn1\nn10")


def test_bounded_lists_choose_before_they_shuffle(spark, capsys):
    lines = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("line"))
    X.first_lines(lines, ["k"], 5).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    types = spark.createDataFrame([("gene", f"g{i:03d}") for i in range(40)] + [("drug", "d")], "type string, label string")
    assert {r.type: r.line for r in X.type_lines(types).collect()} == {"drug": "  - drug: 1 (d)", "gene": "  - gene: 40 (" + ", ".join(f"g{i:03d}" for i in range(12)) + ", …)"}


def test_numbering(spark):
    rng = random.Random(102)
    rows = [(rng.choice("ab"), f"P{rng.randrange(10**6):07d}") for _ in range(3000)]
    got = B.numbered(spark.createDataFrame(rows, "t string, label string").repartition(5), ["t", "label"], parts=7).collect()
    assert [(r.t, r.label) for r in sorted(got, key=lambda r: r.place)] == sorted(rows)
    assert sorted(r.place for r in got) == list(range(1, 3001))
    assert B.numbered(spark.createDataFrame([], "t string, label string"), ["t"]).count() == 0


def test_second_hop_once_for_many_focus_nodes(spark):
    """Edges between surroundings stand once for all focus nodes of a mask, and the packets are those of each node alone."""
    n = 70  # two masks
    nodes = spark.createDataFrame([(f"g{i:03d}", f"G{i:03d}", "gene") for i in range(n)] + [(f"d{i}", f"D{i}", "drug") for i in range(5)], "id string, label string, type string")
    nodes = nodes.select("*", *[F.lit(None).cast("string").alias(c) for c in ("fullName", "chromosome", "atc")], F.lit(None).cast("array<struct<rsid:string>>").alias("members"))
    pairs = [(f"d{j}", f"g{i:03d}") for i in range(n) for j in range(5) if (i + j) % 3]
    edges = spark.createDataFrame([(f"e{k}", a, b, "affects_response_to", None, None, None, None, [str(k % 9)]) for k, (a, b) in enumerate(pairs)], "id string, source string, target string, type string, level string, role string, critical boolean, count long, pmids array<string>")
    focus = spark.createDataFrame([(i, f"g{i:03d}") for i in range(n)], "question_id long, node string")
    far = X.second_hop(nodes, edges, G.neighbourhood(edges, focus.select(F.col("node").alias("question_id"), "node"), 2).select(F.col("question_id").alias("seed"), "node"), X._numbered(focus.select("node")))
    assert far.count() <= 2 * len(pairs)
    whole = {r["node"]: r for r in X.node_context(nodes, edges, focus, 2, most=7).collect()}
    counted = {r["node"]: r for r in X.node_context(nodes, edges, focus, 2, most=7, cite="count").collect()}
    for node, r in whole.items():
        mine = {d for d, g in pairs if g == node}
        near = {g for d, g in pairs if d in mine} | mine
        want = sorted(f"  - {d.upper()} affects response to {g.upper()}" for d, g in pairs if d in near and g in near and g != node)
        assert r["n_second"] == len(want) and r["text"].endswith("Second-hop context:\n" + "\n".join(want[:7]))
        assert counted[node]["n_pmids"] == len(r["pmids"]) and counted[node]["text"] == r["text"]
