"""Extra columns of any name, those that operators use inside among them, and the tables' other hard cases."""

import pytest
from pyspark.sql import functions as F

from kgweave.llm import decontaminate, hnsw, licenses, mixing, ngram_join, quality, secrets, tokens, url_rules, warc

#: Names that operators use for columns of their own.
NAMES = """size rate mean last draws cdf w n p s h t u v x y a b c0 c1 c2 _src _from _name _content _order _u _copy _copies _row _hit _u_s _u_p _u_url host path rule verdict
pattern_rule token subject anchor _live _k1 _k2 _o _t _d _key _other stays copies order comp component_id rid used base found extra vhash n_owners live kind start end
_q_lang _q_limit _q_bytes _q_loss _q_mid _q_keep _q_name _q_id _q_of _n_before _n_tokens _n_pieces _n_again _n_edits _text _lengths _counts win term items item places near matches n_words
digest first shared page_id2 dim shard block part k1 k2 ef ids tokens toks sig label labels""".split()
ROWS = [(1, "one two three four five six token = abcDEF123456 seven", "en", "s1"), (1, "another text of the same id", "en", "s1"), (2, None, None, None), (3, "", "de", "s1"), (None, "no id at all here", "en", None), (1, "another text of the same id", "en", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(2)
    return df.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def unchanged(out, docs, replaced=()):
    names = [c for c in docs.columns if c not in replaced]
    assert out.select(*names).columns == names
    for r in out.select(*[n for n in NAMES if n not in replaced]).distinct().collect():
        assert r.asDict() == {n: f"own {n}" for n in NAMES if n not in replaced}


def test_mixture(docs):
    out = mixing.poisson_mix(docs, total=4000.0)
    unchanged(out, docs, ("_copy", "_copies"))
    assert out.count() > 0


def test_url_rules(docs):
    df = docs.withColumn("url", F.lit("http://a.net/x"))
    out = url_rules.judge_urls(df)
    unchanged(out, df, ("host", "path", "rule", "verdict", "pattern_rule"))
    assert {tuple(r) for r in out.select("host", "path", "rule", "verdict").collect()} == {("a.net", "/x", "net/", "block")}
    assert out.count() == len(ROWS)


def test_rule_table(spark, docs):
    df = docs.withColumn("url", F.lit("http://a.net/x"))
    rules = url_rules.rule_table(spark, url_rules.SITE_RULES + url_rules.PATTERN_RULES)
    assert sorted(map(repr, url_rules.judge_urls(df, rules).collect())) == sorted(map(repr, url_rules.judge_urls(df).collect()))


def test_redaction(docs):
    out = secrets.redact(docs)
    unchanged(out, docs)
    assert out.count() == len(ROWS)
    assert out.where(F.contains("text", F.lit("[secret]"))).count() == 1
    assert secrets.secret_report(docs).count() == len(ROWS)


def test_quality(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.judged(docs, labels)
    unchanged(out, docs, quality.OWN)
    assert out.count() == len(ROWS)
    kept = quality.kept(docs, labels)
    unchanged(kept, docs)
    assert kept.columns == docs.columns


def test_token_counts(docs):
    out = tokens.count_tokens(docs, tokens.VOCABULARY)
    state = tokens.STATE.replace(" string", "").replace(" long", "").replace(" array<int>", "").split(", ")
    unchanged(out, docs, state)
    again = tokens.count_tokens(out, tokens.VOCABULARY, "text", None, "_lengths", "_counts")
    assert sorted(map(repr, again.select("doc_id", *state[:5]).collect())) == sorted(map(repr, out.select("doc_id", *state[:5]).collect()))


def test_survivors(docs):
    out = ngram_join.survivors(docs)
    unchanged(out, docs)
    assert sorted(((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()), key=repr) == sorted({r[:2] for r in ROWS}, key=repr)


def test_contamination(docs, spark):
    items = spark.createDataFrame([("a", "another text of the same id"), ("b", None)], "item_id string, text string").withColumns({n: F.lit(1) for n in NAMES})
    out = decontaminate.phrase_matches(docs, items)
    assert sorted((r.doc_id or 0, r.hits) for r in out.select("_row.doc_id", F.size("matches").alias("hits")).collect()) == [(0, 0), (1, 0), (1, 1), (1, 1), (2, 0), (3, 0)]


def test_licenses_and_warc(docs, tmp_path):
    assert licenses.scan_licenses(docs).count() == len(ROWS)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.col("text").alias("html"), *NAMES)
    (tmp_path / "w").mkdir()
    uri = f"file://{tmp_path}/w"
    assert warc.read_warc(warc.write_warc(pages, uri), uri).count() == len(ROWS)


def test_neighbours(docs):
    df = docs.withColumn("vec_id", F.monotonically_increasing_id()).withColumn("embedding", F.array(F.lit(1.0), F.rand(1)))
    df = df.select(F.xxhash64("vec_id").alias("vec_id"), "embedding", *NAMES)
    assert hnsw.nearest(df, df, k=3).groupBy("query_id").count().where("count = 3").count() == len(ROWS)
