"""Counts, measures and bands of the fertility rules against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

from kgweave.llm import fertility as f
from kgweave.llm.tokens import Encoder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    t = text or ""
    w = WORDS.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    twice = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def plain_measures(text, bpe, pieces):
    w = WORDS.findall(text or "")
    tokens = Counter(t for x in w for t in bpe.encode_ordinary(" " + x))
    parts = [p for x in w for p in pieces.encode(x)]
    n, chars = tokens.total(), sum(map(len, w))
    entropy = -sum(c / n * math.log2(c / n) for c in tokens.values()) if n else 0.0
    return n, chars / max(n, 1), chars / max(len(parts), 1), sum(map(pieces.is_byte, parts)) / max(len(parts), 1), entropy


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(61)
    parts = ["alpha", "beta", "gamma", "delta,", "\u00fcber", "\u6f22\u5b57", "\u0416\u0443\u043a", "#tag", "<b>", "\U0001f642", "a\u00a0b", "\u2003", "don't", "\x1c", "\U00012000\U00012001", "x" * 300, "<|endoftext|>"]
    seps = [" ", "\n", "\t", "  ", "\r\n", "\x0b", "\n\n", " \n"]
    make = lambda n: "".join(rng.choice(parts[: rng.choice((3, 6, 17))]) + rng.choice(seps) for _ in range(n))
    out = [(i, make(rng.choice((0, 1, 7, 8, 9, 30, 80))), rng.choice(("en", "de", None, ""))) for i in range(250)]
    line = "one two three four five six seven eight nine\n"
    out += [(300, line * 4, "en"), (301, line + line, "en"), (302, "same same " * 5, "en"), (303, "\n \n\t\n", "en"), (304, None, None), (None, "no id", None), (305, "", "de"), (306, make(30_000), "en"), (306, "twin", "en"), (306, "twin", "en")]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("fertility")
    spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, lang string, _group string, n_words int").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_counts_and_measures(spark, rows, folder, monkeypatch):
    monkeypatch.setattr(f, "CHUNK", 3000)  # several chunks a batch
    bpe, pieces = Encoder(open(f.RANKS, "rb").read()).bpe, sentencepiece.SentencePieceProcessor(model_file=f.PIECES)
    got = f.op12_fertility(spark, folder).collect()
    flat = lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_tokens, *(round(r[m.name], 9) for m in f.MEASURES))
    want = [(i, *plain_counts(t), *(round(x, 9) for x in plain_measures(t, bpe, pieces))) for i, t, _ in rows]
    assert sorted(map(flat, got), key=repr) == sorted(want, key=repr)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_scripts():
    texts = {"latin": "caf\u00e9 123", "han": "\u6f22\u5b57 a", "cyrillic": "\u0416\u0443\u043a", "greek": "\u03b1\u03b2", "hangul": "\ud55c\uae00", "none": "123 \U0001f642", "arabic": "\u0628\u0627"}
    assert {k: f.script_of(t.encode()) for k, t in texts.items()} == {k: k for k in texts}


def test_bands_are_fences_around_quartiles(spark):
    rng = random.Random(62)
    rows = []
    for group, centre in (("en", 4.0), ("de", 3.0), ("rare", 9.0)):
        for _ in range(400 if group != "rare" else f.LEAST_DOCS - 1):
            rows.append((group, 100, 0, 130, rng.gauss(centre, 0.2), rng.gauss(centre - 1, 0.2), 0.0, rng.gauss(5, 0.1)))
    rows += [("en", 100, 0, 130, 1.2, 3.0, 0.0, 5.0), ("en", 100, 0, 130, 4.0, 3.0, 0.4, 5.0), ("en", 100, 0, 130, 4.0, 3.0, 0.0, 0.9), ("en", 5, 0, 7, 4.0, 3.0, 0.0, 5.0), ("en", 100, 31, 130, 4.0, 3.0, 0.0, 5.0), ("one", 100, 0, 4000, 0.1, 0.1, 1.0, 0.1)]
    names = [m.name for m in f.MEASURES]
    df = spark.createDataFrame(rows, ["_group", "n_words", "n_repeat_words", "n_tokens", *names])
    got = f.judged(df).collect()
    reject = {}
    for k in ("en", "de", None):
        values = [r for r in rows if (k is None or r[0] == k) and r[1] >= 20 and 100 * r[2] <= 30 * r[1] and r[3] == 130]
        for j, m in enumerate(f.MEASURES):
            x = sorted(round(r[4 + j] / m.step) for r in values)
            q1, q3 = x[-(-len(x) // 4) - 1] * m.step, x[-(-3 * len(x) // 4) - 1] * m.step
            reach = max(f.REACH * (q3 - q1), m.slack)
            reject[k, m.name] = lambda v, lo=q1 - reach, hi=q3 + reach, m=m: (m.low and v < lo) or (m.high and v > hi)
    for r in got:
        out = [] if r.n_tokens == 4000 else [n for n in names if reject[r._group if r._group in ("en", "de") else None, n](r[n])]
        assert r.rejected_by == ",".join(out)
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and not out)
    assert sum(r._group == "en" and r.rejected_by != "" for r in got) >= 3


def test_empty_table_and_long_text(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert f.op12_fertility(spark, str(tmp_path)).count() == 0
    long = none.sparkSession.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("many words of one text "), 100_000).alias("text"), F.lit("en").alias("lang"))
    r = f.measured(long).first()
    assert (r.n_words, r.n_repeat_words) == (500_000, 500_000)


def test_junk_is_rejected_and_clean_text_kept(spark):
    docs = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in f.op12_fertility(spark, docs).collect()}
    labels = spark.read.parquet(f"{docs}/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    bad = [got[r.doc_id] for r in labels if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.6 * len(bad)
