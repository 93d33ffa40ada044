"""The graph of a handful of facts, worked out by hand, and what is read from it."""

import pytest
from pyspark.sql import functions as F

from kgweave.operators import context as X
from kgweave.operators import graph_build as B
from kgweave.operators import graph_ops as G

FACTS = [
    ("rs1, rs2", "g1;G2", "Toxicity", "1A", '"Sevoflurane, drug b"', '"Fever, Rash"', 1),
    ("rs1", "G1", "Efficacy", "3", "sevoflurane", "Fever", 2),
    ("rs3", "G1", "Dosage", "", "drug b", "", 3),
    ("rs9", "", "Dosage", "1A", "drug b", "", 4),
    ("rs9", "G9", "Dosage", "1A", "", "", 5),
    (None, "G9", "Dosage", "1A", "x", "", 6),
]
RELATIONS = [("g1", "Gene", "Sevoflurane", "Chemical", "Associated", "30; 4;;30", 1), ("SEVOFLURANE", "Chemical", "G1", "Gene", "associated", "5", 2), ("G1", "Gene", "G1", "Gene", "associated", "6", 3), ("G1", "Gene", "unknown", "Chemical", "associated", "7", 4), ("G2", "Gene", "drug b", "Chemical", "ambiguous", "8", 5), ("G2", "gene", "drug b", "Chemical", "associated", "9", 6)]


@pytest.fixture(scope="module")
def graph(spark):
    facts = spark.createDataFrame(FACTS, "variant string, gene string, type string, level string, chemicals string, phenotypes string, ord int")
    relations = spark.createDataFrame(RELATIONS, "entity1 string, type1 string, entity2 string, type2 string, association string, pmids string, ord int")
    genes = B.dimension(spark.createDataFrame([("g1", "old", "PA0", "no", 1), ("G1 ", "Gene One", "PA1", "YES", 2)], "Symbol string, Name string, id string, vip string, ord int"), "Symbol", {"fullName": "Name", "pharmgkb_id": "id", "chromosome": "id"}, {"is_vip": "vip"}, upper=True)
    rows = [("Other", '"sevoflurane, Alias"', "D0", 1), ("Sevoflurane", "", "D1", 2), ("More", "alias", "D2", 3)]
    drugs = B.named_drugs(spark.createDataFrame(rows, "name string, aliases string, id string, ord int"), "name", "aliases", {"pharmgkb_id": "id", "atc": "id", "top_level": "aliases"})
    phens = B.dimension(spark.createDataFrame([("fever", "PH1", "x", 1)], "Name string, id string, xref string, ord int"), "Name", {"pharmgkb_id": "id", "xref": "xref"})
    assert {r.key: r.pharmgkb_id for r in drugs.collect()} == {"other": "D0", "sevoflurane": "D1", "alias": "D0", "more": "D2"}
    return B.build_graph(facts, genes, drugs, phens, B.class_table(spark), relations)


def test_nodes(graph):
    nodes = {r.id: r for r in graph[0].collect()}
    assert len(nodes) == 2 + 2 + 2 + 8 + 2
    assert (nodes["gene_g1"].fullName, nodes["gene_g1"].is_vip, nodes["gene_g1"].pharmgkb_id) == ("Gene One", True, "PA1")
    assert (nodes["gene_g2"].fullName, nodes["gene_g2"].is_vip, nodes["gene_g2"].chromosome) == ("G2", False, "")
    assert (nodes["drug_sevoflurane"].label, nodes["drug_sevoflurane"].pharmgkb_id, nodes["drug_drug_b"].pharmgkb_id) == ("Sevoflurane", "D1", "")
    assert nodes["class_statins"].description == "Drug class: Statins"
    cluster = nodes["vcluster_gene_g1"]
    assert (cluster.label, cluster.level) == ("G1 variants (3)", "1A")
    assert [(m.rsid, m.level, m.chemical) for m in cluster.members] == [("rs1", "1A", "Sevoflurane"), ("rs2", "1A", "Sevoflurane"), ("rs3", "", "drug b")]


def test_edges(graph):
    edges = {(r.source, r.target, r.type): r for r in graph[1].collect()}
    assert len(edges) == graph[1].count() == 4 + 2 + 1 + 4 + 1 + 2 + 4
    one = edges["drug_sevoflurane", "gene_g1", "linked_to_risk"]
    assert (one.level, one.role, one.critical, one.pmids) == ("1A", "Toxicity", True, ["30", "4", "5"])
    assert edges["drug_sevoflurane", "gene_g1", "affects_response_to"].pmids == ["30", "4", "5"]
    assert edges["drug_sevoflurane", "class_volatile_anesthetics", "belongs_to_class"].critical is None
    assert edges["drug_drug_b", "phen_fever", "can_trigger"].gene == "G1,G2"
    assert edges["gene_g1", "phen_fever", "associated_with"].level == "3"
    assert edges["gene_g1", "vcluster_gene_g1", "has_variant"]["count"] == 3
    assert edges["vcluster_gene_g2", "phen_rash", "linked_to_risk"].critical is True


def test_seed_and_filters(graph, spark):
    nodes, edges = B.seed_graph(*graph, B.class_table(spark))
    assert {r.id for r in nodes.collect()} == {"drug_sevoflurane", "class_volatile_anesthetics", "class_depolarizing_neuromuscular_blockers", "gene_g1", "gene_g2", "phen_fever", "phen_rash", "vcluster_gene_g1", "vcluster_gene_g2"}
    assert edges.where("source = 'drug_drug_b' OR target = 'drug_drug_b'").count() == 0
    kept, left = G.apply_filters(*graph, node_types=["gene", "drug"], levels=["1A"], most=3)
    assert kept.count() == 3 and {r.type for r in left.collect()} <= {"linked_to_risk", "affects_response_to"}
    gone = G.hidden_elements(*graph, node_types=["gene", "drug"], levels=["1A"], most=3)
    assert [gone[0].count() + kept.count(), gone[1].count() + left.count()] == [graph[0].count(), graph[1].count()]
    seeds = spark.createDataFrame([(1, "drug_sevoflurane"), (2, "nothing")], "question_id long, node string")
    assert {r.id for r in G.seed_expansion(*graph, seeds, float("nan"))[0].collect()} == {"drug_sevoflurane"}
    assert G.seed_expansion(*graph, seeds, 9, most=4)[0].count() == 4
    more, wide = G.expand_graph(*graph)
    assert more.where("type = 'variant_cluster'").count() == 5 and wide.where("type = 'has_variant'").count() == 5
    assert wide.where(F.col("source").startswith("vcluster")).count() == 0


def test_packets_and_retrieval(graph, spark):
    nodes, edges = graph
    asked = spark.createDataFrame([(1, "gene_g1"), (2, "none")], "question_id long, node string")
    packet = X.node_context(nodes, edges, asked, 2).collect()
    assert len(packet) == 1 and packet[0].text.startswith('Focus node: G1 (gene, "Gene One")\n  chromosome: PA1\n\nNeighbouring relationships:\n')
    assert "  - Sevoflurane (drug) is linked to risk of G1 (gene) [evidence 1A, Toxicity, CRITICAL]" in packet[0].text
    questions = spark.createDataFrame([(1, "Is sevoflurane risky for rash?", None, ["gene_g1", "gene_g2"]), (2, "why so?", "gene_g2", None), (3, "why?", None, ["gene_g1"])], "question_id long, question string, focus string, visible array<string>")
    index = nodes.select("id", "label", "type", F.coalesce("fullName", F.lit("")).alias("alt"), F.lit(1).alias("ord"))
    got = {r.question_id: r for r in X.retrieve(questions, index, nodes, edges).collect()}
    assert [e.label for e in got[1].entities] == ["Rash", "Sevoflurane"] or [e.label for e in got[1].entities] == ["Sevoflurane", "Rash"]
    assert got[1].n_paths == 1 and "SHORTEST REASONING PATHS (1):" in got[1].context_text and "(1 hop, CRITICAL):" in got[1].context_text
    assert got[1].context_text.endswith("USER CONTEXT: 2 nodes currently visible on the canvas.")
    assert [(e.label, e.term, e.rank) for e in got[2].entities] == [("G2", "(currently selected)", 0)]
    assert got[3].context_text == "QUESTION: why?\n\nENTITY LINKING: no specific graph entities matched the question.\n\nCurrently visible to the user: G1"
    assert got[1].citations == ["30", "4", "5"]
    arms = X.arm_contexts(questions, seed=(nodes, edges), retrieved=X.retrieve(questions, index, nodes, edges))
    assert {(r.question_id, r.arm) for r in arms.collect()} == {(q, a) for q in (1, 2, 3) for a in ("A0", "A2", "A3")}
