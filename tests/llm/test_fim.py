"""Fill-in-middle against a plain version: cuts, forms, arrangements and the texts restored from them."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kgweave.llm import fim


def plain(doc_id, text, how=fim.Fim()):
    t = text or ""
    h = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[j : j + 8], 16) for j in (0, 8, 16, 24)]
    x, y = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, s, m = how.prefix, how.suffix, how.middle
    form = "plain" if not t or any(k in t for k in (p, s, m)) or h[2] % 100 >= how.rate else "spm" if h[3] % 100 < how.spm else "psm"
    out = {"plain": t, "psm": p + t[:x] + s + t[y:] + m + t[x:y], "spm": s + t[y:] + p + t[:x] + m + t[x:y]}[form]
    return doc_id, len(t), form, *((None, None) if form == "plain" else (x, y)), out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(41)
    parts = ["a", "\U0001f642", "\u00e9", "\n", "\r\n", "\0", "<", "P", "<P", "P>", ">", " ", "\U0001f1e9\U0001f1ea"]
    sizes = (0, 1, 2, 5, fim.BLOCK - 1, fim.BLOCK, fim.BLOCK + 1, 2 * fim.BLOCK, 900)
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.choice(sizes)))) for i in range(300)]
    return [*texts, (None, "x" * 300), (None, None), (1, None), (2, ""), (3, "same"), (3, "same"), (7, "\U0001f642a" * 150_000), (8, "a<S>b"), (-9, "minus" * 40)]


def test_contract(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, n, form, x, None if x is None else y - x, sha(out), sha(t or "")) for (_, t), (i, n, form, x, y, out) in zip(rows, [plain(*r) for r in rows], strict=True)]
    got = sorted(map(tuple, fim.op11_fim(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_other_sentinels_and_rates_round_trip(spark, rows):
    how = fim.Fim(seed=5, rate=100, spm=50, prefix="|pre", suffix="|suf", middle="|mid")
    df = spark.createDataFrame([(i, t, "own", "kept") for i, t in rows], "doc_id long, text string, _n string, _p string")
    out = fim.transform(df, how)
    assert out.columns == ["doc_id", "text", "_p", *fim.OWN]
    got = out.select("doc_id", "_n", "_form", "_first", "_second", "_out", "text", "_p", fim.restored(F.col("_out"), F.col("_form"), how).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((plain(*r, how) for r in rows), key=repr)
    assert all(r.back == (r.text or "") and r._p == "kept" for r in got)


def test_empty_table_and_bad_sentinels(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "[S]", "<M>"), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Fim(1, 90, 20, *marks)


def test_nothing_is_shuffled_and_no_python_runs(spark, rows, capsys):
    fim.transform(spark.createDataFrame(rows, "doc_id long, text string")).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
