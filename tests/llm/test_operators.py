import hashlib
import random
import re
from base64 import b32encode
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.llm import decontaminate, hnsw, licenses, mixing, ngram_join, quality, secrets, tokens, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, found string"
HEX = "0123456789abcdef0123"
ROWS = [
    (1, "The quick brown fox token = \"abcDEF123456\" jumps", "en", "s1", 1, "x"), (1, "The quick brown fox token = \"abcDEF123456\" jumps", "en", "s1", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "s1", 0, "y"),
    (None, f"hex {HEX} end", "en", "s2", 5, "z"), (4, f"hex {HEX} and AKIAABCDEFGHIJKLMN", "fr", "s3", 5, "z"), (5, f"again {HEX} Under the MIT--license, Apache License, version 2", "fr", "s4", 5, "z"), (6, "wörd " * 3000, "de", "s1", 5, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


def test_secrets(docs):
    got = {(r.doc_id, r.spans): r for r in secrets.secret_report(docs).select("doc_id", secrets._joined(F.col("base")).alias("spans"), "found").collect()}
    for doc_id, text, *_ in ROWS:
        want = []
        for order, (kind, p, least) in enumerate((("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16))):
            for m in re.finditer(p, text or ""):
                if len(m.group(2) if kind == "assign" else m.group()) >= least:
                    want.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
        assert (doc_id, ",".join(w[2] for w in sorted(want))) in got
    live = {s.vhash: s.live for r in got.values() for s in r.found}
    assert live[hashlib.sha256(HEX.encode()).hexdigest()] is False  # three owners
    assert live[hashlib.sha256(b"abcDEF123456").hexdigest()] is True
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert out.count() == len(ROWS)
    assert out.where(F.contains("text", F.lit("abcDEF123456"))).count() == 0
    assert out.where(F.contains("text", F.lit(HEX))).count() == 3


def test_contamination(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((14, 10, 3, 1, 25))] + [(9, None), (10, "--")]
    rows = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if i % 2:
            item = rng.choice(items[:5])[1].split()
            t[5:5] = item[rng.randint(0, 2) :]
        rows.append((i % 50, " , ".join(t).upper() if i % 3 else " ".join(t)))
    rows += [(None, items[0][1]), (70, None), (71, "")]
    got = decontaminate.phrase_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = got.select("_row.doc_id", "n_words", decontaminate.covered(F.col("matches")).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"])))).alias("items"), F.transform("near", lambda m: m["start"]).alias("near"))
    want = []
    counts = Counter(w for _, t in rows for w in re.findall(r"[a-z0-9]+", (t or "").lower()))
    wins = [(i, tuple(w[j : j + 10])) for i, t in items for w in [re.findall(r"[a-z0-9]+", (t or "").lower())] if w for j in range(max(1, len(w) - 9))]
    for doc_id, text in rows:
        w = re.findall(r"[a-z0-9]+", (text or "").lower())
        hit, found = set(), set()
        for i, win in wins:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(i)
        near = []
        for win in {x for _, x in wins if len(x) == 10}:
            held = sorted((counts[t], o, t) for o, t in enumerate(win) if counts[t])
            if len(held) < 8:
                continue
            place = lambda t, at: any(0 <= p < len(w) and w[p] == t for p in range(at - 3, at + 4))  # noqa: B023, E731
            for p, t in enumerate(w):
                s = p - held[0][1]
                if t == held[0][2] and s >= -3 and place(held[1][2], s + held[1][1]) and sum(place(x, s + o) for o, x in enumerate(win)) >= 8:
                    near.append(s)
        want.append((doc_id, len(w), len(hit), sorted(found), sorted(near)))
    assert sum(len(x[4]) for x in want) > sum(1 for x in want if x[2])
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.hit, r["items"], r.near) for r in got.collect()))) == sorted(map(repr, want))


def test_contamination_of_changed_passages(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(40)]
    changed = {"dropped": item[:13] + item[14:], "inserted": [*item[:21], "new", *item[21:]], "replaced": [*item[:7], "other", *item[8:17], "other", *item[18:]], "other": [rng.choice(words) for _ in range(40)]}
    docs = spark.createDataFrame([(i, name, " ".join(t)) for i, (name, t) in enumerate(changed.items())], "doc_id long, name string, text string")
    items = spark.createDataFrame([("x-1", " ".join(item)), ("empty", ""), (None, None)], "item_id string, text string")
    got = {r.name: [list(m["items"]) for m in r.near] for r in decontaminate.phrase_matches(docs, items).select("_row.name", "near").collect()}
    assert got["other"] == []
    assert all(got[k] and {i for m in got[k] for i in m} == {"x-1"} for k in ("dropped", "inserted", "replaced"))


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[5].n_base, got[5].base_labels, got[5].first_word, got[5].last_word) == (2, "apache-2,mit", 2, 6)
    assert (got[2].n_words, got[2].labels, got[2].score) == (0, "", 0.0)
    assert got[6].n_words == 3000
    s = licenses.Scanner(licenses.signatures())
    assert len(licenses.signatures()) > 200
    assert s.scan(b"Creative Commons Attribution-ShareAlike 4.0 International")[5] == "cc-by-sa-4.0"
    assert s.scan(b"GNU Lesser General Public License version 2.1")[5].split(",")[0] == "lgpl-2.1"
    assert s.scan("ünder the mit licenseé".encode())[1] == 0


def test_urls(spark):
    rows = [(1, "http://WWW.Example.NET/en/x"), (2, "https://a.net/en/"), (3, "x"), (4, None), (5, "http://foo?bar.net/"), (6, "http://example.com/de/a"), (6, "http://example.com/de/a"), (7, "http://b.org/login?x=1"), (8, "http://casino.b.org/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df).collect())
    assert [g[:3] for g in got][:5] == [(1, "www.example.net", "/en/x"), (2, "a.net", "/en/"), (3, "", ""), (4, "", ""), (5, "foo", "")]
    assert [g[3:] for g in got] == [("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.com/de/", "block"), ("example.com/de/", "block"), (None, "block"), (None, "block")]


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/%0A", "<p>é</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "x\r\n\r\ny" * 999), (None, "http://b", "z"), (2, "http://a/%0A", "<p>é</p>")]
    uri = f"file://{tmp_path}/w"
    (tmp_path / "w").mkdir()
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), uri, roll_bytes=300, shards=2)
    back = warc.read_warc(manifest, uri, payloads=True).collect()
    assert len(back) == len(rows)
    digest = lambda t: b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((r.page_id or 0, r.url or "", r.payload_digest, r.payload_bytes) for r in back) == sorted((i or 0, u or "", digest(h), len((h or "").encode())) for i, u, h in rows)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in back) == [(0, "response", 0), (1, "revisit", 2), (2, "response", 0), (2, "revisit", 2), (3, "revisit", 4), (4, "response", 0), (5, "response", 0)]
    assert {r.html for r in back if r.page_id == 5} == {rows[4][2]}


def test_mixture(docs):
    a, b = (sorted(map(repr, mixing.poisson_mix(docs, total=400_000.0).select("doc_id", "_copy", "_copies").collect())) for _ in range(2))
    assert a == b
    rates = {r._src: (r.size, r.rate) for r in mixing.source_rates(docs, {"s1": 3.0, "s2": 1.0}, total=1000.0).collect()}
    assert rates["s1"][0] * rates["s1"][1] == pytest.approx(750)
    assert rates["s3"][1] == 0
    assert rates[None] == (0.0, 0.0)


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 99)}" for _ in range(n)] for n in (2, 9, 40, 130)]
    rows = [(1000, None), (1001, ""), (None, "a b c d"), (1002, "W1 w2"), (1003, "w1  w2")]
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 5)}"
        rows.append((i, " ".join(t)))
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    top = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and top[a] > top[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    top[a] = top[b]
    out, _ = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    got = {r.doc_id: (r.n, r.component_id) for r in out.collect()}
    assert got.pop(None) == (2, None)
    assert got == {i: (len(sets[i]), top[i]) for i in ids}


def test_all_links(spark, monkeypatch):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 999)}" for _ in range(n)] for n in (90, 120)]
    rows = [(500, None), (None, " ".join(base[0]))]
    for i in range(60):
        t = list(base[i % 2])
        t[rng.randrange(len(t))] = f"x{i % 40}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, rows[2][1]) for i in range(3)]
    shingles = lambda t: frozenset(zip(*[(t or "").split()[j:] for j in range(3)], strict=False))
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 90 * len(a | b)
    links = {frozenset((a, b)) for _, a in sets for _, b in sets if a != b and near(a, b)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 7):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        out, found = ngram_join.jaccard_components(df, 3, 90)
        text_of = dict(rows)
        name = {r.rid: shingles(text_of[r.doc_id]) for r in out.where("rid IS NOT NULL").collect()}
        got = [frozenset((name[r.a], name[r.b])) for r in found.collect()]
        assert len(got) == len(set(got))
        assert set(got) == links
        counts = {r.doc_id: r.n_links for r in ngram_join.jaccard_links(df, 3, 90).collect()}
        assert counts.pop(None) is None
        assert counts == {i: sum(near(a, b) for j, b in sets if j != i) for i, a in sets}


def test_token_trees():
    rng = random.Random(6)
    encoder = tokens.Encoder(open(tokens.VOCABULARY, "rb").read())
    for size in (0, 1, 30, 2500, 30_000):
        text = "".join(rng.choice("aab  bc '\n\t.,12sé'll ") for _ in range(size))
        tree = tokens.SegmentTree(*encoder.pieces(text))
        for _ in range(25):
            start = rng.randint(0, len(text))
            put = "".join(rng.choice("ab '\n1") for _ in range(rng.choice((0, 3, 40, 900))))
            text, again = tokens.edit(tree, encoder, text, start, min(len(text), start + rng.choice((0, 5, 30, 1500))), put)
            assert tree.flat() == encoder.pieces(text)
            assert again <= 3 * len(put) + 60
            assert tree.chars[1] == len(text)
        assert tree.total == len(encoder.bpe.encode_ordinary(text))


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    x[200:260] = x[200]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] + [1.0] * 11), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict[int, list] = {}
    for r in hnsw.nearest(df, df.where("vec_id % 20 = 0"), shard=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    full = x.astype(np.float64)
    found = 0
    for q, hits in got.items():
        score = full @ full[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-round(score[i], 9), i))[:20]
        found += len(set(best) & {h[0] for h in hits})
        assert len(hits) == 20
        assert all(s == pytest.approx(score[i]) for i, s in hits)
    assert len(got) == 35
    assert found >= 0.97 * 700


def test_quality(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice(("the", "house", "green", "was", "seen", "tree")) for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(100, "zq%% XW!! " * 60, "en"), (101, None, "en"), (102, "", None), (103, good[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r._q_keep for r in quality.judged(docs, labels).collect()}
    assert [keep[i] for i in (100, 101, 102, 103)] == [False, False, False, True]
    assert all(keep[i] for i in range(60))
    model = quality.train(docs.where("doc_id < 40"), order=3)
    one, four = (quality.scored(docs, *quality.save(model, n), order=3).orderBy("doc_id").select("_q_loss").collect() for n in (1, 4))
    assert [r[0] for r in one] == pytest.approx([r[0] for r in four])
    # brute force: interpolated modified Kneser-Ney by dictionaries
    grams = [{} for _ in range(4)]
    for t in good[:40]:
        b = b"\0\0" + t.encode()
        for i in range(2, len(b)):
            grams[3][b[i - 2 : i + 1]] = grams[3].get(b[i - 2 : i + 1], 0) + 1
    for n in (2, 1):
        for g in grams[n + 1]:
            grams[n][g[1:]] = grams[n].get(g[1:], 0) + 1
    d = {n: quality.discounts(*(sum(c == i for c in grams[n].values()) for i in (1, 2, 3, 4))) for n in (1, 2, 3)}
    cut = lambda n, c: d[n][min(c, 3) - 1]

    def p(h, w):
        n = len(h) + 1
        own = {g[-1:]: c for g, c in grams[n].items() if g[:-1] == h}
        lower = p(h[1:], w) if h else 1 / 256
        total = sum(own.values())
        return lower if not total else (max(own.get(w, 0) - (cut(n, own[w]) if w in own else 0), 0) + sum(cut(n, c) for c in own.values()) * lower) / total

    for i, text in ((0, good[0][:80]), (1, "zebra %% house")):
        b = b"\0\0" + text.encode()
        want = -sum(np.log(p(b[j - 2 : j], b[j : j + 1])) for j in range(2, len(b)))
        got = quality.scored(spark.createDataFrame([(i, text)], "i int, text string"), *quality.save(model), order=3).first()._q_loss
        assert got == pytest.approx(want)


def test_quality_limits_hold_on_unseen_text(spark):
    rng = random.Random(10)
    letters = {"en": "abcdefgh", "de": "ijklmnop"}
    words = {lang: ["".join(rng.choice(x) for _ in range(rng.randint(2, 9))) for _ in range(3000)] for lang, x in letters.items()}
    rows = [(i, " ".join(words[lang][int(3000 * rng.random() ** 2)] for _ in range(60)), lang) for i, lang in enumerate(("en", "de") * 200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    for lang in letters:
        lost = sum(not r._q_keep for r in out if r.doc_id >= 200 and r.lang == lang)
        assert lost <= 8  # of 100; 2 are expected


def test_empty_tables(docs, spark):
    none = docs.where("1 = 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert secrets.redact(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert mixing.poisson_mix(none).count() == 0
    assert quality.judged(none, labels).count() == 0
    assert decontaminate.phrase_matches(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert ngram_join.jaccard_components(none)[0].count() == 0
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert hnsw.nearest(*[spark.createDataFrame([], "vec_id long, embedding array<float>")] * 2).count() == 0
