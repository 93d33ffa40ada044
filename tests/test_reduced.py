"""The graph without held-out facts, made from the whole one, against a full build."""

import random

from pyspark.sql import functions as F

from kgweave.functions.columns import row_key
from kgweave.operators import graph_build as B

COLUMNS = ["variant", "gene", "type", "level", "chemicals", "phenotypes"]


def test_equals_a_full_build(spark):
    rng = random.Random(131)
    rows = []
    for i in range(300):
        k = rng.randrange(60)  # small worlds, so that most of the graph is untouched
        genes = rng.choice((f"g{k}", f"g{k},G{k + 100}", f"G{k}; g{k + 1}"))
        chems = ", ".join(f"d{k}_{rng.randrange(3)}" for _ in range(rng.choice((1, 1, 2))))
        phens = ", ".join(f"p{k}_{rng.randrange(3)}" for _ in range(rng.choice((0, 1, 2))))
        variants = ", ".join(f"rs{k}_{rng.randrange(4)}" for _ in range(rng.choice((1, 2))))
        rows.append((variants, genes, rng.choice(("Toxicity", "Efficacy", "Dosage")), rng.choice(("1A", "1B", "2A", "3", "")), rng.choice((chems, f'"{chems}"')), phens, f"{i:05d}"))
    rows.append(("rs1", "", "Toxicity", "1A", "d1", "", "09999"))
    facts = spark.createDataFrame(rows, [*COLUMNS, "ord"])
    none = lambda *c: spark.createDataFrame([], ", ".join(f"{x} string" for x in c))
    dims = (
        spark.createDataFrame([(f"G{k}", f"gene {k}", f"PA{k}", "chr1", True) for k in range(0, 60, 2)], "key string, fullName string, pharmgkb_id string, chromosome string, is_vip boolean"),
        spark.createDataFrame([(f"d{k}_1", f"D{k}", f"PD{k}", "atc", "1A") for k in range(60)], "key string, name string, pharmgkb_id string, atc string, top_level string"),
        none("key", "pharmgkb_id", "xref"),
    )
    classes = spark.createDataFrame([("one", "D1_1"), ("one", "d2_0"), ("two", "d3_2"), ("empty", "nothing")], "class string, member string")
    relations = spark.createDataFrame([(f"g{k}", "Gene", f"d{k}_{j}", "Chemical", "associated", f"{k}{j}; 77") for k in range(60) for j in range(3)], "entity1 string, type1 string, entity2 string, type2 string, association string, pmids string")
    held = facts.where("ord % 29 = 3 AND level <> ''").select(row_key(*[F.col(c) for c in COLUMNS]).alias("row_key")).distinct()
    left = B.exclude(facts, held, COLUMNS)
    whole = B.build_graph(facts, *dims, classes, relations)
    want = B.build_graph(left.select(*COLUMNS, "ord"), *dims, classes, relations)
    nodes, edges, again = B.reduced_graph(*whole, facts, held, COLUMNS, *dims, classes, relations)
    flat = lambda df: sorted(map(repr, df.collect()))
    assert flat(edges) == flat(want[1].select(*edges.columns))
    assert flat(nodes) == flat(want[0].select(*nodes.columns))
    assert flat(whole[1]) != flat(want[1])
    assert 0 < again.count() < 0.5 * facts.count()
    same = B.reduced_graph(*whole, facts, held.limit(0), COLUMNS, *dims, classes, relations)
    assert flat(same[1]) == flat(whole[1]) and flat(same[0]) == flat(whole[0]) and same[2].count() == 0
