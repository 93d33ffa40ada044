from kgweave.operators.graph_ops import Filters


def test_defaults_and_steps():
    f = Filters()
    assert (f.most, f.collapse_variants, f.node_types, f.edge_types, f.levels) == (80, True, None, None, None)
    assert [Filters(most=n).most for n in (-5, 0, 20, 24, 25, 83, 296, 300, 9999)] == [20, 20, 20, 20, 30, 80, 300, 300, 300]


def test_a_view_with_members_shown(spark):
    nodes = spark.createDataFrame([("g", "G", "gene", None, None, None), ("c", "C", "variant_cluster", "G", "1A", [("rs1", "1A", "r", "d"), ("rs2", "3", "r", "d")])], "id string, label string, type string, gene string, level string, members array<struct<rsid:string,level:string,role:string,chemical:string>>")
    edges = spark.createDataFrame([("e", "g", "c", "has_variant", "1A")], "id string, source string, target string, type string, level string")
    shown = Filters(collapse_variants=False, levels=("1A",)).apply(nodes, edges)
    assert sorted(r.id for r in shown[0].collect()) == ["c__rs1", "c__rs2", "g"] and sorted(r.target for r in shown[1].collect()) == ["c__rs1"]
    assert sorted(r.id for r in Filters().apply(nodes, edges)[0].collect()) == ["c", "g"]
