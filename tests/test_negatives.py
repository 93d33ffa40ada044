"""Questions about pairs without an association are drawn from all such relations."""

import hashlib

from kgweave.operators import questions as Q
from kgweave.plans import ORACLES


def test_negatives_beyond_the_first_thousands_are_drawn(spark):
    rows = [(f"d{i}", "Chemical", f"g{i}", "Gene", "not associated", "1", f"{i:06}") for i in range(7_000)]
    relations = spark.createDataFrame(rows, "entity1 string, type1 string, entity2 string, type2 string, association string, pmids string, ord string")
    keys = sorted((f"NEG|d{i}|G{i}" for i in range(7_000)), key=lambda k: hashlib.md5(f"7|S6|{k}".encode()).hexdigest())
    assert [r.source_row_hash for r in Q.negative(relations, 25).orderBy("id").collect()] == keys[:25]
    assert any(int(k.split("|d")[1].split("|")[0]) >= 5_000 for k in keys[:25])
    assert Q.negative_pairs(relations).count() == 7_000


def test_sql_of_all_questions_has_no_cut():
    assert "LIMIT 5000" not in ORACLES["gen_questions"]
