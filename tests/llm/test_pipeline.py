"""Each stage against a plain version of it, on rows with nulls, empty and long texts, repeats, shared ids and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from kgweave.llm import secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `_k1` string, `_row` string, size string, stays string"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    words = [f"word{i}" for i in range(300)]
    out = [(None, "no id one two three four five six"), (None, "no id one two three four five six"), (5, "unique text of five with words enough"), (5, "p q r s t u v w x y z"), (3, "p q r s t u v w x y z"), (7, None), (7, None), (8, ""), (None, None)]
    for i in range(40):
        t = [rng.choice(words) for _ in range(rng.choice((4, 30, 60)))]
        out.append((100 + i, " ".join(t)))
        if i % 3 == 0:
            t[-1] = "changed"
            out.append((200 + i, " ".join(t)))
        if i % 5 == 0:
            out.append((100 + i, " ".join(t).upper()))
        if i % 8 == 0:
            out.append(out[-1])
    out.append((900, " ".join(rng.choice(words) for _ in range(60_000))))
    out.append((901, out[-1][1] + " end"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 8 else None, 0, "a", "b", "c", "d") for i, t in rows], COLUMNS).repartition(3)


def test_near_duplicates(spark, docs, rows):
    out = P.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()), key=repr)
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top[a], top[b]
                top = [min(x, y) if t in (x, y) else t for t in top]
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(("alone", i) if not sets[i] else top[i], []).append(r)
    assert len(got) == len(groups)
    for g in groups.values():
        least = min(g, key=lambda r: (r[0] is None, r[0] or 0))[0]
        kept = [r for r in g if r in got and r[0] == least]
        assert kept, g
    assert (5, "unique text of five with words enough") in got and (3, "p q r s t u v w x y z") in got and (5, "p q r s t u v w x y z") not in got
    assert got.count((None, "no id one two three four five six")) == 1 and got.count((7, None)) == 2


def test_decontamination(spark, docs, rows, tmp_path):
    item = next(t for i, t in rows if 100 <= (i or 0) < 200 and len(t.split()) >= 30)
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    w = item.lower().split()
    wins = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    hit = lambda t: any(tuple(x[i : i + 10]) in wins for x in [(t or "").lower().split()] for i in range(len(x) - 9))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted((r for r in rows if not hit(r[1])), key=repr)
    items.limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert P.drop_contaminated(spark, docs, f"{tmp_path}/none").count() == len(rows)


def test_redaction_and_mixture(spark, docs, rows):
    marked = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" password = Abcdef123456Zz"))).otherwise(F.col("text")))
    out = P.redact_secrets(spark, marked, "")
    assert out.columns == docs.columns and out.count() == len(rows)
    owners = {r.source for r in marked.where("text LIKE '%password%'").select("source").distinct().collect()}
    live = len(owners) < secrets.MIN_OWNERS
    assert (out.where("text LIKE '%[secret]%'").count() > 0) == live
    assert out.where("n_chars <> length(text)").count() == 0 and out.where("text IS NULL AND n_chars IS NOT NULL").count() == 0
    mixed = P.mix_sources(spark, docs, "")
    assert mixed.columns == [*docs.columns, "_copies", "_copy"]
    per = {(r.doc_id, r.text): (r.n, r.c) for r in mixed.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.max("_copies").alias("c")).collect()}
    assert all(n == c * rows.count(k) for k, (n, c) in per.items())


def test_whole_run(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows if i], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    assert [name for name, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.where("text IS NULL OR text = ''").count() == 0
    assert out.groupBy("doc_id", "text", "_copy").count().where("count > 1").count() == 0


def test_empty(spark, docs, tmp_path):
    none = docs.limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
