"""What is written for one step is gone before the next."""

from pyspark.sql import functions as F

from kgweave.operators import graph_build as B
from kgweave.plans import graph as P
from kgweave.sources import shared

DATA = "/root/testdata/sf0.001"


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle")}


def test_files_of_a_cut_tables_shuffles_are_gone(spark):
    before = shuffle_files(spark)
    rows = spark.range(10_000).select((F.col("id") % 100).alias("k"), "id")
    out = shared.cut(rows.repartition(3, "id").join(rows.groupBy("k").count().hint("merge"), "k"), "rows")
    assert shuffle_files(spark) <= before
    assert out.count() == 10_000
    assert spark.conf.get(shared.CLEAN_UP, None) is None


def test_edges_are_folded_one_kind_after_another_and_the_facts_then_go(spark, monkeypatch):
    held = []
    write = shared._write

    def watched(df, path, codec):
        write(df, path, codec)
        held.append((path.split("/")[-2].split("-")[0], len([1 for p in shared._WRITTEN.values() if "/folded-" in p])))

    for table in ("_FACTS", "_NODES", "_EDGES"):
        monkeypatch.setattr(P, table, {})
    monkeypatch.setattr(shared, "_write", watched)
    nodes, edges = P.graph(spark, DATA)
    assert P._FACTS == {}
    assert sum(name == "edges" for name, _ in held) == 6 and max(n for _, n in held) <= 1
    assert nodes.count() and edges.select("id").distinct().count() == edges.count()


def test_pmids_of_phenotypes_are_attached(spark):
    facts = spark.createDataFrame([("rs1", "G", "Efficacy", "3", "d", "Pain", "1"), ("rs2", "G", "Toxicity", "1A", "d", "Pain", "2")], "variant string, gene string, type string, level string, chemicals string, phenotypes string, ord string")
    relations = spark.createDataFrame([("G", "Gene", "Pain", "Disease", "associated", "7"), ("d", "Chemical", "Pain", "Disease", "associated", "8"), ("d", "Chemical", "G", "Gene", "associated", "9")], "entity1 string, type1 string, entity2 string, type2 string, association string, pmids string")
    edges = B.build_edges(*B.read_facts(facts), B.class_table(spark), relations, spend=True).collect()
    found = {r.type: r.pmids for r in edges if r.pmids}
    assert found["associated_with"] == ["7"] and found["can_trigger"] == ["8"] and found["affects_response_to"] == ["9"]
