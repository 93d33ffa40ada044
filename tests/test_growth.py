"""Rows that cannot matter are left out before they are joined, merged or shuffled, and nothing is built that is not read."""

import random

from pyspark.sql import functions as F

from kgweave.operators import context as X
from kgweave.operators import graph_build as B
from kgweave.operators import graph_ops as G
from kgweave.plans import QUERIES, graph, sets

DATA = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def test_edges_of_other_nodes_are_not_merged(spark):
    plan = optimized(QUERIES["ctx_node"](spark, DATA))
    steps = "".join(k for line in plan for k, word in (("m", "Aggregate [_h"), ("s", "Join LeftSemi"), ("o", "Join Inner, (l_orderkey")) if word in line)
    assert steps and steps.replace("mmso", "").replace("mso", "") == ""  # rows are left out above the joins and below the merges


def test_merged_around_is_merged_and_filtered(spark):
    rng = random.Random(5)
    rows = [(f"d{rng.randrange(9)}", f"g{rng.randrange(9)}", "t", rng.choice(("1A", "3", "")), rng.choice("xyz"), rng.random() < 0.3, 1, f"{i:04}") for i in range(400)]
    e = spark.createDataFrame(rows, "source string, target string, type string, level string, role string, critical boolean, n long, ord string")
    nodes = spark.createDataFrame([(1, "g1"), (2, "d3"), (3, "g1"), (4, "none")], "question_id long, node string")
    keys = ["source", "target", "type"]
    merged = B.merge_edges(e, keys)
    want = merged.join(nodes, merged.source == nodes.node).union(merged.join(nodes, merged.target == nodes.node))
    got = B.merged_around(e, nodes, keys).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_edges_on_no_path_are_not_merged(spark):
    edges = spark.createDataFrame([("a", "b", True, "3"), ("b", "c", False, "3"), ("x", "y", True, "1A")], "source string, target string, critical boolean, level string")
    paths = spark.createDataFrame([("a", "b", 1, "a>b"), ("c", "b", 1, "c>b")], "from_id string, to_id string, hops int, path string")
    found = G.critical_paths(paths, edges)
    assert [(r.from_id, r.critical) for r in found.collect()] == [("a", True), ("c", False)]
    assert any("LeftSemi" in line for line in optimized(found))


def test_one_step_from_few_seeds_needs_no_adjacency(spark, monkeypatch):
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "c", "a"), ("3", "b", "c"), ("4", "a", "a"), ("5", "c", "d")], "id string, source string, target string")
    seeds = spark.createDataFrame([(1, "a"), (2, "d"), (2, "c"), (3, "none")], "question_id long, node string")
    want = sorted(map(tuple, G.neighbourhood(edges, seeds, 1, G.Adjacency(edges)).select("question_id", "node", "hop").collect()))

    def build(*_):
        raise AssertionError("an adjacency was built")

    monkeypatch.setattr(G, "Adjacency", build)
    assert sorted(map(tuple, G.neighbourhood(edges, seeds, 1).select("question_id", "node", "hop").collect())) == want


def test_few_edges_are_found_without_a_shuffle_of_all(spark, monkeypatch):
    nodes = spark.createDataFrame([("a", "A", "gene"), ("b", "B", "drug")], "id string, label string, type string")
    edges = spark.createDataFrame([("1", "b", "a", "t", "3", None, None, None, None), ("2", "b", "b", "t", None, None, None, None, None)], "id string, source string, target string, type string, level string, role string, critical boolean, gene string, pmids array<string>")
    plans = []
    monkeypatch.setattr(X, "cut", lambda df, name: (plans.append((name, "\n".join(optimized(df)))), df)[1])
    focus = edges.groupBy("type").agg(F.min("id").alias("edge_id")).select(F.lit(1).cast("long").alias("question_id"), "edge_id")
    assert X.edge_context(nodes, edges, focus).first().n_lines == 1
    assert any("edge_id" in line and "strategy=broadcast" in line for name, plan in plans if name == "focus" for line in plan.split("\n"))


def test_the_reduced_graph_needs_no_whole_one(spark, monkeypatch):
    def build(*_):
        raise AssertionError("the whole graph was built")

    for module, names in ((graph, ("_FACTS", "_NODES", "_EDGES")), (sets, ("_LEFT", "_REDUCED"))):
        for name in names:
            monkeypatch.setattr(module, name, {})
    for module, name in ((graph, "graph"), (graph, "graph_nodes"), (B, "reduced_graph")):
        monkeypatch.setattr(module, name, build)
    assert QUERIES["kg_reduced_nodes"](spark, DATA).count() > 0
    assert QUERIES["kg_reduced_edges"](spark, DATA).count() > 0
