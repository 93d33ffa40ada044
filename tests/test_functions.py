import math
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgweave.functions import columns as C
from kgweave.operators import evaluation as E


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("wins", "losses", "p"), [(91, 95, 0.8259676274872411), (52, 135, 1.080415195969925e-09), (0, 0, 1.0), (3, 0, 0.25)])
def test_sign_test(spark, wins, losses, p):
    assert value(spark, C.sign_test(F.lit(wins), F.lit(losses))) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize(("k", "n", "lo", "hi"), [(91, 186, 0.41835469042077966, 0.5605751121093298), (52, 187, 0.21881623167356806, 0.3462681105243594), (0, 0, 0.0, 1.0)])
def test_wilson(spark, k, n, lo, hi):
    a, b = C.wilson(F.lit(k), F.lit(n))
    assert (value(spark, a), value(spark, b)) == (pytest.approx(lo), pytest.approx(hi))


def test_slug_split_key(spark):
    assert value(spark, C.slug(F.lit("gene"), F.lit(""), F.lit("HLA-B*57:01 x "))) == "gene_hla-b_57:01_x"
    assert value(spark, C.split_cell(F.lit(" a, ,b,, c "))) == ["a", "b", "c"]
    assert value(spark, C.row_key(F.lit("rs7294"), F.lit(" VKORC1"), F.lit("Dosage"), F.lit("1B"), F.lit("warfarin"), F.lit(None))) == "rs7294|VKORC1|Dosage|1B|warfarin|"


def test_render_edge(spark):
    e = C.render_edge(F.lit("desflurane"), F.lit("RYR1"), F.lit("linked_to_risk"), F.lit("1A"), F.lit("Toxicity"), F.lit(True), F.lit(0))
    assert value(spark, e) == "desflurane --is linked to risk of[L1A, Toxicity, CRITICAL]--> RYR1"
    e = C.render_edge(F.lit("RYR1"), F.lit("RYR1 variants (37)"), F.lit("has_variant"), F.lit("1A"), F.lit(""), F.lit(False), F.lit(37))
    assert value(spark, e) == "RYR1 --has variant cluster[L1A, 37 variants]--> RYR1 variants (37)"


def test_fold_keeps_substring_rule(spark):
    assert value(spark, C.fold_distinct(F.array(*map(F.lit, ("CYP2C19", "CYP2C", "", "VKORC1"))), ", ")) == "CYP2C19, VKORC1"


def test_verdicts(spark):
    rows = spark.createDataFrame([("A",), ("b because",), ("ANSWER B",), ("tie\nmore",), ("?",), (None,)], "t string")
    assert [r[0] for r in rows.select(E.parse_verdict(F.col("t"))).collect()] == ["A", "B", "A", "TIE", "TIE", "TIE"]
    assert [r[0] for r in rows.select(E.parse_verdict(F.col("t"), strict=True)).collect()] == ["A", "TIE", "TIE", "TIE", "TIE", "TIE"]


def test_levels_and_json(spark):
    cases = [
        ("level 1A for x", 'so {"a": {"b": 1}} end {"c": 2}', ["1A"], '{"a": {"b": 1}}'), ("3 apples", "none {", [], None), (None, None, [], None), ("L 2b, l3 and L-4", '```json\n{"k": 1}\n```', ["2B", "3", "4"], '{"k": 1}'),
        ("Evidence: 4, then far away from any of it there is a 3", "{bad} {}", ["4"], None), ("LEVEL=2a", "} {}", ["2A"], None), ("evidence3", '{"s": "}"}', [], None),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], "t string, j string").coalesce(1)
    got = rows.select(E.claimed_levels("t"), E.tolerant_json("j")).collect()
    assert [list(r[0]) for r in got] == [c[2] for c in cases]
    assert [r[1] for r in got] == [c[3] for c in cases]


def test_answers(spark):
    assert value(spark, C.extract_pmids(F.lit("pmid 1234567, [7654321], PMID:1234567 [12345] pubmed/2222222 XPMID 3333333"))) == ["1234567", "7654321"]
    assert value(spark, C.normalize_answer(F.lit(" * a [pmid 12]\n2) **b**\n\n \nc PMID: 34x PMID:5 "))) == "a (cite 12)\nb\n\nc PMID: 34x (cite 5)"
    text = F.lit("Takes CYP2C9*1x, cyp2d6 and St John's wort.")
    assert [value(spark, C.mentions(text, F.lit(e))) for e in ("CYP2C9*1", "CYP2D6", "st john's", "john", "cyp2", "", "a\\Eb")] == [False, True, True, True, False, False, False]
    assert value(spark, C.render_edge(F.lit("a"), F.lit("b"), F.lit("belongs_to_class"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("boolean"), F.lit(None).cast("long"))) == "a --belongs to drug class--> b"


@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_lcs_ratio(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    want = 2 * t[-1][-1] / (len(a) + len(b)) if a or b else 1.0
    assert C.lcs_ratio_of(a, b) == pytest.approx(want)


def test_latest_success(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, False), (1, 4, True), (2, 1, True), (2, 2, True)], "k int, o int, bad boolean")
    got = E.latest_success(rows, ["k"], F.col("bad"), ["o"]).collect()
    assert sorted((r.k, r.o) for r in got) == [(1, 3), (2, 1)]


def test_link_fuzzy_against_all_pairs(spark):
    from kgweave.operators.retrieval import link_fuzzy

    rng = random.Random(4)
    labels = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    question = " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(12))
    alias = [rng.choice(labels) + rng.choice("ab") for _ in labels]
    index = spark.createDataFrame([(str(i), x, f"{y}, {y[::-1]}", i) for i, (x, y) in enumerate(zip(labels, alias, strict=True))], "id string, label string, alt string, ord int")
    nodes = spark.createDataFrame([(str(i),) for i in range(50)], "id string")
    got = {(r.id, round(r.score, 9), r.term, r.rank) for r in link_fuzzy(spark.createDataFrame([(1, question)], "question_id long, question string"), index, nodes=nodes, most=7).collect()}
    terms = question.split()
    grams = list(dict.fromkeys(" ".join(terms[i : i + n]) for n in (3, 2, 1) for i in range(len(terms) - n + 1)))
    names = [(x, i) for i, (a, b) in enumerate(zip(labels, alias, strict=True)) for x in (a, b, b[::-1])]
    best: dict[int, tuple[float, str]] = {}
    for t in grams:
        if " " not in t and len(t) < 4:
            continue
        for d, _, i in sorted((round(1 - C.lcs_ratio_of(t, x), 9), place, i) for place, (x, i) in enumerate(names))[:3]:
            score = round(d - (0.05 if " " in t else 0.0), 9)
            if i < 50 and score <= 0.18 and (i not in best or score < best[i][0]):
                best[i] = (score, t) if i not in best else (score, t)
    first = {i: n for n, i in enumerate(best)}
    want = sorted(best, key=lambda i: (best[i][0], first[i]))[:7]
    assert got == {(str(i), best[i][0], best[i][1], n + 1) for n, i in enumerate(want)}



def test_sign_test_of_many_decisions(spark):
    """Against logarithms of gamma; a term for each decision, or one for each pair, would not end."""
    C.register(spark)
    for wins, losses in ((200_000, 201_000), (120, 150), (300, 290), (0, 5), (3_000_000, 1)):
        n, k = wins + losses, min(wins, losses)
        first = max(0, k - 20_000)  # terms below are nothing
        want = min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(first, k + 1)))
        got = spark.range(1).select(F.expr(f"sign_test_p({wins}, {losses})").alias("a"), C.sign_test(F.lit(wins).cast("long"), F.lit(losses).cast("long")).alias("b")).first()
        assert abs(got["a"] - want) < 1e-8 and abs(got["b"] - want) < 1e-8


def test_slug_of_plain_and_odd_names(spark):
    """The short way for plain names gives what replacing gives, at the edges of what is plain."""
    names = ["P1", "", "_", "__a", "a__", "_a_b_", "a\n", "a b", "\n", "Brand#11", "ä", "A-b:c.d", "-", "a_\n", None, " x ", "a\r\n_"]
    plain = lambda x: re.sub("[^A-Za-z0-9_:.-]+", "_", x).strip("_").lower()
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", C.slug(F.col("n")).alias("s"), C.slug(F.lit("gene"), F.col("n")).alias("g")).collect()
    for r in rows:
        n = r["n"] or ""
        assert r["s"] == plain(n) and r["g"] == plain("gene_" + n if n else "gene")
