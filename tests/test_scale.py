"""What keeps steps from growing faster than their input: nothing is built that is not read, few rows are not met by a shuffle."""

import pytest
from pyspark.sql import functions as F

from kgweave.operators import context as X
from kgweave.operators import graph_build as B
from kgweave.operators import graph_ops as G
from kgweave.plans import QUERIES, graph

DATA = "/root/testdata/sf0.001"
NODES = "id string, label string, type string, gene string, level string, members array<struct<rsid:string,level:string,role:string,chemical:string>>"
EDGES = "id string, source string, target string, type string, level string, critical boolean, pmids array<string>"


@pytest.fixture
def plain_joins(spark):
    """No join is broadcast unless the code says so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def small_graph(spark):
    nodes = [("g", "G", "gene", None, None, None), ("c", "G variants (1)", "variant_cluster", "G", "1A", [("rs1", "1A", "r", "D1")])] + [(f"d{i:02}", f"D{i:02}", "drug", None, None, None) for i in range(40)]
    edges = [("e", "g", "c", "has_variant", "1A", None, None)] + [(f"e{i:02}", f"d{i:02}", "g", "affects_response_to", "3", False, None) for i in range(40)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def shuffled_joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


@pytest.mark.parametrize("name", ["kg_nodes", "kg_index", "kg_entity_pairs"])
def test_nodes_need_no_edges(spark, monkeypatch, name):
    def build(*_):
        raise AssertionError("edges were built")

    monkeypatch.setattr(B, "build_edges", build)
    for held in (graph._FACTS, graph._NODES, graph._EDGES):
        monkeypatch.setattr(graph, next(k for k, v in vars(graph).items() if v is held), {})
    assert QUERIES[name](spark, DATA).count() > 0


def test_edges_do_not_depend_on_relations_of_other_names(spark):
    relations = spark.createDataFrame([("G1", "Gene", "nobody", "Chemical", "associated", "7")], "entity1 string, type1 string, entity2 string, type2 string, association string, pmids string")
    facts = spark.createDataFrame([("rs1", "G1", "Efficacy", "3", "d", "", 1)], "variant string, gene string, type string, level string, chemicals string, phenotypes string, ord int")
    edges = B.build_edges(*B.read_facts(facts), B.class_table(spark), relations).collect()
    assert sorted((e.source, e.target, e.pmids) for e in edges) == [("drug_d", "gene_g1", None), ("gene_g1", "vcluster_gene_g1", None)]


def test_members_take_the_place_of_clusters_without_a_shuffle_of_edges(small_graph, plain_joins):
    nodes, edges = G.expand_graph(*small_graph)
    assert shuffled_joins(nodes) == shuffled_joins(edges) == 0
    assert nodes.where("type = 'variant_cluster'").first().id == "c__rs1" and edges.count() == 41


def test_whole_edges_meet_only_the_nodes_that_are_left(small_graph, plain_joins):
    nodes, edges = G.apply_filters(*small_graph, most=3)
    assert shuffled_joins(edges) == 0
    assert sorted(r.id for r in nodes.collect()) == ["c", "d00", "g"] and sorted(r.id for r in edges.collect()) == ["e", "e00"]
    for ids, n in zip(G.hidden_elements(*small_graph, most=3), (39, 39), strict=True):
        assert shuffled_joins(ids) == 0 and ids.count() == n


def test_seed_view_is_not_shuffled(spark, small_graph, plain_joins):
    nodes, edges = small_graph
    drugs = nodes.withColumn("id", F.regexp_replace("id", "^d", "drug_d"))
    ends = edges.withColumn("source", F.regexp_replace("source", "^d", "drug_d"))
    classes = spark.createDataFrame([("A", "d01"), ("B", "d02")], "class string, member string")
    kept, inner = B.seed_graph(drugs, ends, classes, ("A",))
    assert shuffled_joins(kept) == shuffled_joins(inner) == 0
    assert sorted(r.id for r in kept.collect()) == ["c", "drug_d01", "g"] and sorted(r.id for r in inner.collect()) == ["e", "e01"]


def test_first_lines_of_a_view(small_graph):
    nodes, edges = small_graph
    near = X.edges_of_first_lines(nodes, edges, 5)
    assert sorted(r.source for r in near.collect()) == ["d00", "d01", "d02", "d03", "d04"]
    assert X.edges_of_first_lines(nodes.where("id <> 'g'"), edges, 5).count() == 41
    assert X.visible_context(nodes, edges, most=5).first().text == X.visible_context(nodes, near, most=5).first().text


@pytest.mark.parametrize("prefix", ["D", "D!", "D0"])
def test_a_label_that_another_begins_with(spark, prefix):
    nodes = spark.createDataFrame([("a", "D", "drug"), ("b", prefix, "drug"), ("g", "G", "gene")], "id string, label string, type string")
    edges = spark.createDataFrame([("1", "a", "g", "zz", "", False, None), ("2", "b", "g", "aa", "", False, None), ("3", "b", "g", "zzz", "", False, None)], EDGES)
    lines = lambda e, most: [r for r in X.visible_context(nodes, e, most=most).first().text.split("\n") if "--" in r or " G" in r]
    assert lines(edges, 1)[-1] == sorted(lines(edges, None)[-3:])[0]


def test_held_facts(spark):
    rows = spark.createDataFrame([(str(i % 500), "1A" if i % 2 else "4") for i in range(1000)], "variant string, level string")
    held = B.holdout(rows, ["variant", "level"])
    found = sorted(B.held_facts(rows, held, ["variant", "level"]).collect())
    keys = {r.row_key for r in held.collect()}
    assert len(keys) == 75 and found == sorted(r for r in rows.collect() if f"{r.variant}|{r.level}" in keys)
    assert B.held_facts(rows, held.limit(0), ["variant", "level"]).count() == 0
