"""What the queries return against plain versions: op1 limits, op2, op5 in crowds, op8, op10; and the oracles in SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from kgweave.llm import hnsw, licenses, ngram_join, quality, queries, secrets, tokens

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_secrets(spark, tmp_path):
    rng = random.Random(31)
    values = ["".join(rng.choice("abcXYZ0189+/_-=") for _ in range(n)) for n in (11, 12, 24, 30, 40)] + ["0123456789abcdef", "AKIA" + "Q1" * 8, "deadbeef" * 3]
    heads = ['password = "', "Api-Key:", "api_key=", "TOKEN  : '", "x ", "", "é "]
    rows = [(i % 90, f"o{rng.randint(0, 5)}", "".join(rng.choice((rng.choice(heads) + rng.choice(values), " plain ", "\n", "ü.")) for _ in range(rng.randint(0, 120)))) for i in range(100)] + [(500, None, None), (501, "o1", "")]
    rows += [(600 + i, "o1", f"{i} word {'Z9' * 15} end") for i in range(secrets.MIN_REPOS)] + [(700, "o2", f"one {'Y8' * 15}"), (701, "o2", f"one {'Y8' * 15}")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 12, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 18, 0), ("hex", re.compile("[0-9a-f]+"), 16, 0)]
    found = []
    for i, o, t in rows:
        base = [(m.start(), n, m.end(), k, m.group(g)) for n, (k, p, least, g) in enumerate(kinds) for m in p.finditer(t or "") if len(m.group(g)) >= least]
        more = [(m.start(), 3, m.end(), "owned", m.group()) for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}", t or "")]
        more = [s for s in more if re.search("[0-9]", s[4]) and re.search("[A-Za-z]", s[4]) and not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        found.append((i, o, t, sorted(base), more))
    owners, repos = {}, {}
    for _, o, t, base, more in found:
        for s in base + more:
            owners.setdefault(s[4], set()).add(o)
            repos.setdefault(s[4], set()).add((o, t))
    joined = lambda spans: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(spans))
    live = lambda s: len(owners[s[4]]) < secrets.MIN_OWNERS and len(repos[s[4]]) < secrets.MIN_REPOS
    want = []
    for i, _, _, base, more in found:
        spans = base + [s for s in more if live(s)]
        want.append((i, *[sum(s[3] == k for s in base) for k in ("assign", "access", "hex")], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), sum(map(live, spans)), sum(not live(s) for s in spans)))
    assert sorted(map(tuple, secrets.op8_secrets(spark, str(tmp_path)).collect())) == sorted(want)
    assert sum("owned" in w[5] for w in want) > 10


def test_licenses(spark):
    rng = random.Random(32)
    parts = "under the MIT license|Apache License, Version 2.0|CC BY-NC|cc by nc sa 4.0|GNU General Public License version 3 or any later version|lesser|mit|license|version 2|bsd 3 clause license|the|Creative Commons Attribution NonCommercial 4.0 International|all rights reserved|é".split("|")
    texts = [rng.choice((" ", ", ", "\n", "-")).join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", " ".join(parts * 400)]
    rules = licenses.signatures()
    scanner = licenses.Scanner(rules)
    compiled = [(r, r.compiled()) for r in rules]
    base = [("under the mit license".split(), "mit"), ("apache license version 2".split(), "apache-2"), ("cc by nc".split(), "cc-by-nc")]
    want = []
    for i, t in enumerate(texts):
        low = (t or "").encode().translate(licenses.ASCII_LOWER)
        every = [(m.start(), m.end(), r.priority, n, r) for n, (r, p) in enumerate(compiled) if r.keyword.encode() in low for m in p.finditer(low)]
        if len(every) < 2000:
            inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and (b[2] > a[2] or (b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or (b[:2] == a[:2] and b[3] < a[3]))))
            kept = [a for a in every if not any(inside(a, b) for b in every)]
            assert [(a[0], a[1], a[4].label) for a in sorted(kept, key=lambda a: (a[0], -a[1], -a[2], a[3]))] == [(s, e, r.label) for s, e, r in scanner.detections(low)]
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low.decode())
        places = sorted((j, label) for phrase, label in base for j in range(len(w) - len(phrase) + 1) if w[j : j + len(phrase)] == phrase)
        want.append((i, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places}))))
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in out] == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)


def test_token_counts(spark, tmp_path):
    rng = random.Random(33)
    texts = [" ".join(rng.choice(("call", "+49 30 123456", "10.0.0.25", "naïve", "don't", "x\n\n y", "12345678")) for _ in range(rng.randint(0, 90))) for _ in range(40)] + [None, "", "0 1 2 3 4 5 6 7 " * 3000, "same", "same"]
    spark.createDataFrame([(i % 41, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    encoder = tokens.Encoder(open(tokens.VOCABULARY, "rb").read())
    n = lambda t: len(encoder.bpe.encode_ordinary(t))
    want = [(i % 41, n(t or ""), len(re.findall(tokens.NUMBERS, t or "")), n(re.sub(tokens.NUMBERS, "<number>", t or ""))) for i, t in enumerate(texts)]
    got = tokens.op2_token_counts(spark, str(tmp_path)).select("doc_id", "n_tokens", "n_edits", "n_tokens_edited").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_crowds_and_salts(spark, monkeypatch):
    rng = random.Random(34)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(90):
        t = list(base[i % 3])
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            t[rng.randrange(60)] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(t)))
    sets = [frozenset(zip(*[t.split()[j:] for j in range(3)], strict=False)) for _, t in rows]
    top = list(range(90))
    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and top[a] != top[b]:
                x, y = top[a], top[b]
                top = [min(x, y) if t in (x, y) else t for t in top]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "MANY", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "TASK_DOCS", 25)  # several salts
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, 3, 90)[0].collect()}
    assert got == dict(enumerate(top))


def test_quality_is_repeatable_and_its_limits_are_quantiles(spark):
    rng = random.Random(35)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(50)), rng.choice(("en", None))) for i in range(80)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    one, two = (sorted(map(tuple, quality.judged(docs.repartition(n), labels).select("doc_id", "_q_mid", "_q_limit", "_q_keep").collect())) for n in (1, 5))
    assert one == two
    losses = spark.createDataFrame([("en", 100, float(x)) for x in rng.sample(range(1000), 200)], "_q_name string, _q_bytes long, _q_loss double")
    mid, limit = next((r._q_mid, r._q_limit) for r in quality.limits(losses).collect() if r._q_lang == "en")
    values = sorted(r._q_loss / 100 for r in losses.collect())
    assert mid == pytest.approx(values[99])
    assert limit == pytest.approx((values[195] * 100 + quality.PRIOR * mid) / (100 + quality.PRIOR), abs=1e-4)


def test_beam_reaches_its_target():
    rng = np.random.default_rng(36)
    x = rng.normal(size=(1500, 48)).astype(np.float32)
    order, layers = hnsw.build(x, np.arange(len(x)))
    x = x[order]
    ef = hnsw.width(hnsw.lengthened(x), layers, np.arange(len(x)), 21)
    q = rng.normal(size=(60, 48)).astype(np.float32)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    found = hnsw.search(hnsw.lengthened(x), layers, q, ef) if ef else hnsw.scan(x, q, 20)
    assert sum(len(set(a) & set(b[b >= 0][:20])) for a, b in zip(want, found, strict=True)) >= 0.9 * want.size
    assert (hnsw.scan(x, q, 20) == want).mean() > 0.99
