"""The quality stage against a plain model of dictionaries; shards; empty tables of the operators."""

import math
import random

import pytest
import xxhash

import corpus_pipeline as P
from kgweave.llm import fim, ngram_join, quality, tokens, warc


class Plain:
    """Interpolated modified Kneser-Ney over bytes, by dictionaries."""

    def __init__(self, texts, order):
        self.order, grams = order, [{} for _ in range(order + 1)]
        for t in texts:
            b = bytes(order - 1) + t.encode()
            for i in range(order - 1, len(b)):
                g = b[i - order + 1 : i + 1]
                grams[order][g] = grams[order].get(g, 0) + 1
        for n in range(order - 1, 0, -1):
            for g in grams[n + 1]:
                grams[n][g[1:]] = grams[n].get(g[1:], 0) + 1
        self.grams = grams
        self.d = [None] + [quality.discounts(*(sum(c == i for c in grams[n].values()) for i in (1, 2, 3, 4))) for n in range(1, order + 1)]
        self.contexts = [{} for _ in range(order + 1)]
        for n in range(1, order + 1):
            for g, c in grams[n].items():
                total, back = self.contexts[n].get(g[:-1], (0, 0.0))
                self.contexts[n][g[:-1]] = total + c, back + self.d[n][min(c, 3) - 1]

    def p(self, gram):
        n = len(gram)
        lower = self.p(gram[1:]) if n > 1 else 1 / 256
        total, back = self.contexts[n].get(gram[:-1], (0, 0.0))
        if not total:
            return lower
        c = self.grams[n].get(gram, 0)
        return (c - self.d[n][min(c, 3) - 1] if c else 0) / total + back / total * lower

    def loss(self, text):
        b = bytes(self.order - 1) + text.encode()
        return -sum(math.log(self.p(b[i - self.order + 1 : i + 1])) for i in range(self.order - 1, len(b)))


def quantile(values, share):
    return sorted(values)[math.ceil(len(values) * share) - 1]


def test_stage_against_a_plain_model(spark, tmp_path):
    rng = random.Random(121)
    words = {lang: ["".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(40)] for lang, a in (("en", "abcdefg"), ("de", "hijkäö"))}
    make = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.randint(4, 40)))
    rows = [(i, make(lang), lang) for i in range(60) for lang in [rng.choice(("en", "de"))]]
    rows += [(100 + i, "".join(rng.choice("qrst%!") for _ in range(90)), "en") for i in range(8)] + [(200, None, "en"), (201, "", "de"), (202, rows[0][1], None), (None, rows[1][1], "en"), (203, rows[2][1], "xx"), (0, "second text of the same id", "en")]
    labels = [(i, 1, 0) for i in range(40)] + [(40, 1, 1), (41, 0, 0), (42, 1, 0), (42, 0, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, size string").repartition(3)
    out = P.keep_quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = [tuple(r)[:3] for r in out.collect()]
    trusted = [r for r in rows if r[0] is not None and r[0] < 40 and r[1]]
    fold = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() % quality.FOLDS  # noqa: E731  # two folds: signed or not, the last bit is the same
    losses = []
    for f in range(quality.FOLDS):
        model = Plain([r[1] for r in trusted if fold(r[1]) != f], quality.ORDER)
        losses += [(r[2], len(r[1].encode()), model.loss(r[1])) for r in trusted if fold(r[1]) == f]
    bins = lambda x: round(x * quality.BINS) / quality.BINS
    limits = {}
    for lang in ("en", "de", None):
        own = [(n, x) for name, n, x in losses if lang is None or name == lang]
        mid = quantile([bins(x / n) for n, x in own], 0.5)
        limits[lang] = mid, quantile([bins((x + quality.PRIOR * mid) / (n + quality.PRIOR)) for n, x in own], quality.KEPT)
    model, sure = Plain([r[1] for r in trusted], quality.ORDER), 0
    for r in rows:
        if not r[1]:
            assert r not in kept
            continue
        n, (mid, limit) = len(r[1].encode()), limits.get(r[2], limits[None])
        score = (model.loss(r[1]) + quality.PRIOR * mid) / (n + quality.PRIOR)
        if abs(score - limit) > 3e-4:
            assert (r in kept) == (score < limit), r
            sure += 1
    assert sure > 0.9 * len(rows) - 3 and not any(100 <= (r[0] or 0) < 108 for r in kept)


def test_shards_of_longer_contexts_agree(spark):
    rng = random.Random(122)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(("the", "house", "green", "über", "tree")) for _ in range(40))) for i in range(40)] + [(90, None), (91, ""), (92, "unseen %% words"), (93, "\0\0a")], "doc_id long, text string")
    model = quality.train(docs.where("doc_id < 30"), order=6)
    one, five = (sorted((r.doc_id, round(r._q_loss, 6), r._q_bytes) for r in quality.scored(docs, *quality.save(model, n), order=6).collect()) for n in (1, 5))
    assert one == five and len(one) == 44


@pytest.mark.parametrize("chunk", [50, 10**6])
def test_texts_are_scored_in_blocks(spark, monkeypatch, chunk):
    docs = spark.createDataFrame([(i, "abc " * (i % 40)) for i in range(90)], "doc_id long, text string")
    model = quality.save(quality.train(docs, order=4))
    monkeypatch.setattr(quality, "CHUNK", chunk)
    got = {r.doc_id: (round(r._q_loss, 6), r._q_bytes) for r in quality.scored(docs, *model, order=4).collect()}
    assert len(got) == 90 and all(got[i] == got[i + 40] and got[i][1] == 4 * i for i in range(40))


def test_empty_tables_of_others(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert tokens.count_tokens(none, tokens.VOCABULARY).count() == 0
    assert ngram_join.jaccard_links(none, 3, 90).count() == 0
    assert fim.transform(none).count() == 0
    (tmp_path / "w").mkdir()
    uri = f"file://{tmp_path}/w"
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), uri), uri).count() == 0
