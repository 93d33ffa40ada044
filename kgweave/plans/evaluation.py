"""Grading, judging and summaries. Bindings name each case of a text; oracles state what must come of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions import columns as C
from kgweave.operators import evaluation as E
from kgweave.plans.bindings import FACTS, bound, plain
from kgweave.plans.registry import query

NO = "lpad(CAST(event_id AS VARCHAR(20)), 6, '0')"
ID = "CAST(event_id AS VARCHAR(20))"
GRADED_Q = f"""SELECT 'q' || {ID} AS id, 'S' || CAST(1 + CAST(floor(event_id / 10) AS BIGINT) % 8 AS VARCHAR(9)) AS stratum, 'P' || CAST(event_id % 50 AS VARCHAR(9)) AS drug, '1' || {NO} AS pmid, CASE event_id % 3 WHEN 0 THEN '2b' WHEN 1 THEN '1A' ELSE '' END AS level FROM {{events}}"""
GRADED_A = f"""SELECT CASE WHEN event_id % 11 = 0 THEN 'z' ELSE 'q' END || {ID} AS question_id, 'A' || CAST(event_id % 4 AS VARCHAR(9)) AS arm, CASE event_id % 10 WHEN 0 THEN 'The drug p' || CAST(event_id % 50 AS VARCHAR(9)) || ' and cyp2c9*1x.'
  WHEN 1 THEN 'cites [1' || {NO} || '], PMID:2' || {NO} || ' and pmid 1' || {NO} || ' but not pubmed/3' || {NO} WHEN 2 THEN 'Level: 2b evidence; L 3 too, dose 4 mg of evidence' WHEN 3 THEN 'I do not have that. There are no entries.' WHEN 4 THEN 'No, not associated.'
  WHEN 5 THEN '' WHEN 6 THEN 'x' WHEN 7 THEN 'Fine answer about CYP2C9*1.' WHEN 8 THEN 'level 1a' END AS answer, CASE event_id % 10 WHEN 6 THEN 'timeout' END AS error, CAST(event_id % 100 AS INTEGER) AS context_chars, CAST(event_id AS BIGINT) AS duration_ms FROM {{events}}"""
OK = "k IN (0, 1, 2, 3, 4, 7, 8)"
SCORES_SQL = f"""SELECT 'q' || e AS question_id, stratum, 'A' || (event_id % 4) AS arm, CAST(CASE k WHEN 0 THEN 25 + length(CAST(event_id % 50 AS VARCHAR)) WHEN 1 THEN 70 WHEN 2 THEN 50 WHEN 3 THEN 41 WHEN 4 THEN 19 WHEN 6 THEN 1 WHEN 7 THEN 27 WHEN 8 THEN 8 ELSE 0 END AS INTEGER) AS answer_chars, CAST(event_id % 100 AS INTEGER) AS context_chars,
  CAST(event_id AS BIGINT) AS duration_ms, CASE k WHEN 6 THEN 'timeout' END AS error, CAST(CASE WHEN k IN (0, 7) THEN 0.5 WHEN {OK} THEN 0.0 END AS DOUBLE) AS entity_recall, CASE WHEN k = 0 THEN 'P' || (event_id % 50) WHEN k = 7 THEN 'CYP2C9*1' WHEN {OK} THEN '' END AS mentioned,
  CASE WHEN k = 0 THEN 'CYP2C9*1' WHEN k = 7 THEN 'P' || (event_id % 50) WHEN {OK} THEN 'P' || (event_id % 50) || ',CYP2C9*1' END AS missed, CASE WHEN k = 1 THEN '1' || lpad(e, 6, '0') || ',2' || lpad(e, 6, '0') WHEN {OK} THEN '' END AS cited,
  CAST(CASE WHEN k = 1 THEN 0.5 END AS DOUBLE) AS pmid_exists_rate, CAST(CASE WHEN stratum = 'S4' THEN CASE WHEN k = 1 THEN 0.5 WHEN {OK} THEN 0.0 END END AS DOUBLE) AS pmid_correct_rate,
  CAST(CASE WHEN stratum = 'S2' AND event_id % 3 < 2 THEN CASE k WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN 1 ELSE 0 END WHEN 8 THEN CASE event_id % 3 WHEN 1 THEN 1 ELSE 0 END END END AS INTEGER) AS evidence_level_match,
  CASE WHEN stratum = 'S2' AND event_id % 3 < 2 THEN CASE WHEN k = 2 THEN '2B,3,4' WHEN k = 8 THEN '1A' WHEN {OK} THEN '' END END AS levels,
  CAST(CASE WHEN {OK} THEN CASE stratum WHEN 'S7' THEN CASE WHEN k = 3 THEN 1 ELSE 0 END WHEN 'S6' THEN CASE WHEN k IN (3, 4) THEN 1 ELSE 0 END END END AS INTEGER) AS refusal_correct
FROM (SELECT event_id, CAST(event_id AS VARCHAR) AS e, event_id % 10 AS k, 'S' || (1 + CAST(floor(event_id / 10) AS BIGINT) % 8) AS stratum FROM events WHERE event_id % 11 <> 0)"""


def scores(s: SparkSession, d: str) -> DataFrame:
    q = bound(s, d, GRADED_Q)
    gold = F.struct(F.array("drug", F.lit("CYP2C9*1")).alias("entities"), F.array("pmid").alias("pmids"), F.col("level").alias("evidence_level"))
    return E.grade(bound(s, d, GRADED_A), q.select("id", "stratum", gold.alias("gold")), q.select("pmid"))


@query("grade_scores", f"SELECT * EXCLUDE (answer_chars) FROM ({SCORES_SQL})")
def grade_scores(s: SparkSession, d: str) -> DataFrame:
    joined = {n: F.array_join(c, ",").alias(n) for n, c in (("mentioned", "entities_mentioned"), ("missed", "entities_missed"), ("cited", "pmids_cited"), ("levels", "evidence_levels_claimed"))}
    return scores(s, d).select(
        "question_id", "stratum", "arm", "context_chars", "duration_ms", "error", "entity_recall", joined["mentioned"], joined["missed"], joined["cited"], "pmid_exists_rate", "pmid_correct_rate", "evidence_level_match", joined["levels"], "refusal_correct",
    )


@query("score_headline", f"""WITH s AS ({SCORES_SQL}) SELECT arm, count(s.question_id) AS n_answers, count(s.error) AS n_errors, round(coalesce(avg(duration_ms) / 1000, 0), 6) AS duration_s_mean, round(avg(entity_recall), 6) AS entity_recall_mean, round(avg(pmid_exists_rate), 6) AS pmid_exists_rate_mean,
  count(*) FILTER (WHERE cited <> '') AS n_with_citations FROM unnest(['A0', 'A1', 'A2', 'A3', 'A9']) AS u(arm) LEFT JOIN s USING (arm) GROUP BY arm""")  # fmt: skip
def score_headline(s: SparkSession, d: str) -> DataFrame:
    out = E.score_headline(scores(s, d), ("A0", "A1", "A2", "A3", "A9")).drop("answer_chars_mean")
    return out.withColumns({c: F.round(c, 6) for c in ("duration_s_mean", "entity_recall_mean", "pmid_exists_rate_mean")})


METRICS = ("entity_recall", "pmid_exists_rate", "evidence_level_match", "pmid_correct_rate", "refusal_correct")


@query("score_grid", f"WITH s AS ({SCORES_SQL}) SELECT stratum, arm, count(s.question_id) AS n, count(s.error) AS errors, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM (SELECT 'S' || i AS stratum, 'A' || j AS arm FROM range(1, 9) AS a(i), range(0, 4) AS b(j)) LEFT JOIN s USING (stratum, arm) GROUP BY stratum, arm")
def score_grid(s: SparkSession, d: str) -> DataFrame:
    return E.score_grid(scores(s, d)).withColumns({m: F.round(m, 6) for m in METRICS})


@query("grade_entities", r"""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS t, unnest([split_part(text, ' ', 2), 'the', 'warfarin']) AS g, unnest([1, 2, 3]) AS o FROM conversations WHERE role = 'assistant'),
m AS (SELECT *, g <> '' AND regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(g) || '($|[^\p{L}\p{N}_])') AS hit FROM a WHERE regexp_full_match(coalesce(g, ''), '[\p{L}\p{N}_](.*[\p{L}\p{N}_])?') OR g = '')
SELECT conv_id, turn, coalesce(string_agg(g, ',' ORDER BY o) FILTER (WHERE hit), '') AS mentioned, count(*) FILTER (WHERE hit) / count(*) AS recall FROM m GROUP BY conv_id, turn""")  # fmt: skip
def grade_entities(s: SparkSession, d: str) -> DataFrame:
    # boundaries of entities that begin or end with a mark differ between the two engines' patterns, so those are no gold here
    a = bound(s, d, "SELECT conv_id, turn, text, array(split_part(text, ' ', 2), 'the', 'warfarin') AS gold FROM {conversations} WHERE role = 'assistant'")
    kept = a.withColumn("gold", F.filter("gold", lambda g: F.regexp_like(F.coalesce(g, F.lit("")), F.lit(r"^([\p{L}\p{N}_](.*[\p{L}\p{N}_])?)?$"))))
    return E.entity_recall(kept).select("conv_id", "turn", F.array_join("mentioned", ",").alias("mentioned"), "recall")


CITED = "SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 3 = 0 THEN 'no source, pubmed/1234567, [12345]' ELSE 'see PMID: ' || lpad(CAST(o_orderkey AS VARCHAR(20)), 7, '0') || ' and [' || lpad(CAST(o_orderkey + 1 AS VARCHAR(20)), 7, '0') || ']' END AS text FROM {orders}"
KNOWN = "SELECT lpad(CAST(o_orderkey AS VARCHAR(20)), 7, '0') AS pmid FROM {orders} WHERE o_orderstatus = 'F'"


@query("grade_pmids", """WITH k AS (SELECT o_orderkey AS x FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT o_orderkey AS question_id, o_orderkey % 3 > 0 AS has, CAST(o_orderkey IN (SELECT x FROM k) AS INTEGER) + CAST(o_orderkey + 1 IN (SELECT x FROM k) AS INTEGER) AS n FROM orders)
SELECT question_id, CAST(CASE WHEN has THEN 2 ELSE 0 END AS BIGINT) AS cited, CAST(CASE WHEN has THEN n ELSE 0 END AS BIGINT) AS found, CASE WHEN has THEN n / 2 END AS exists_rate FROM c""")  # fmt: skip
def grade_pmids(s: SparkSession, d: str) -> DataFrame:
    return E.citation_rates(bound(s, d, CITED), bound(s, d, KNOWN))


SPOKEN = "SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'I DO not have it. ' WHEN 1 THEN 'There is No Evidence. ' WHEN 2 THEN 'insufficient, no evidence' WHEN 3 THEN 'Answer: no, it is Not Associated' ELSE 'No documented link; not in this graph' END AS text FROM {conversations}"


@query("grade_refusal", "SELECT conv_id, turn, turn % 5 IN (0, 1, 4) AS refused, turn % 5 IN (3, 4) AS negative FROM conversations")
def grade_refusal(s: SparkSession, d: str) -> DataFrame:
    return E.refusals(bound(s, d, SPOKEN)).select("conv_id", "turn", "refused", "negative")


@query("grade_levels", f"WITH facts AS ({plain(FACTS)}) SELECT ord, level AS levels FROM facts")
def grade_levels(s: SparkSession, d: str) -> DataFrame:
    f = bound(s, d, FACTS).select("ord", F.concat(F.lit("rated as level "), "level", F.lit(" for "), "chemical").alias("text"))
    return f.select("ord", F.array_join(E.claimed_levels("text"), ",").alias("levels"))


REPLIES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Here: {{"a": {{"b": 1}}}} done {{"c": 2}}' WHEN 1 THEN '```json' || chr(10) || '{{"k": 5}}' || chr(10) || '```' WHEN 2 THEN 'no braces' WHEN 3 THEN '{{bad}} {{"a": 1}}' WHEN 4 THEN '{{"open": 1' ELSE 'Here: ' || props || ' done' END AS text FROM {events}"""


@query("json_extract", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"a": {"b": 1}}' WHEN 1 THEN '{"k": 5}' WHEN 5 THEN props END AS json FROM events""")
def json_extract(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, REPLIES).select("event_id", E.tolerant_json("text").alias("json"))


CLAIMED = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok {{"claims": [{{"id": "c1", "text": "t", "made_by": ["A", "C"], "supported": "true"}}, {{"id": "c2", "text": "u", "made_by": ["B"], "supported": "FALSE"}}]}}' WHEN 1 THEN '{{"claims": 5}}' WHEN 2 THEN '{{"x": [1]}}' ELSE 'nothing' END AS text FROM {events}"""


@query("claims_parse", "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'claims-not-list' WHEN 0 THEN NULL ELSE 'no-json' END AS error, CAST(CASE event_id % 4 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS n_claims, CASE event_id % 4 WHEN 0 THEN 'AC|B' ELSE '' END AS made_by FROM events")
def claims_parse(s: SparkSession, d: str) -> DataFrame:
    return E.parse_claims(bound(s, d, CLAIMED)).select("event_id", "error", F.size("claims").alias("n_claims"), F.array_join(F.transform("claims", lambda c: F.array_join(c["made_by"], "")), "|").alias("made_by"))


VERDICTS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN chr(10) || ' b because' || chr(10) || 'x' WHEN 2 THEN 'ANSWER B' WHEN 3 THEN 'Tie' || chr(10) || ' both fine ' WHEN 4 THEN 'unclear' END AS text FROM {events}"


@query("judge_parse", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'A' ELSE 'TIE' END AS pick, CASE event_id % 6 WHEN 0 THEN 'A3' WHEN 1 THEN 'A1' WHEN 2 THEN 'A3' ELSE 'TIE' END AS winner, CASE event_id % 6 WHEN 0 THEN 'A' ELSE 'TIE' END AS strict, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'b because' || chr(10) || 'x' WHEN 2 THEN 'ANSWER B' WHEN 3 THEN 'both fine' WHEN 4 THEN 'unclear' ELSE '' END AS reason FROM events")
def judge_parse(s: SparkSession, d: str) -> DataFrame:
    v = bound(s, d, VERDICTS).withColumn("pick", E.parse_verdict(F.col("text")))
    return v.select("event_id", "pick", E.unblind(F.col("pick"), F.lit("A3"), F.lit("A1")).alias("winner"), E.parse_verdict(F.col("text"), strict=True).alias("strict"), E.verdict_reason(F.col("text")).alias("reason"))


MARKED = "SELECT conv_id, turn, ' 1. first **bold** [PMID: 123]' || chr(10) || '- second [pmid:456]' || chr(10) || chr(10) || ' ' || chr(10) || '• third PMID 789 __x__' || chr(10) || '12) fourth' || chr(10) || 'para' || chr(10) || ' ' || chr(10) || chr(10) || 'by ' || role || chr(10) AS text FROM {conversations}"


@query("judge_normalize", "SELECT conv_id, turn, 'first bold (cite 123)' || chr(10) || 'second (cite 456)' || chr(10) || 'third (cite 789) x' || chr(10) || 'fourth' || chr(10) || 'para' || chr(10) || chr(10) || 'by ' || role AS text FROM conversations")
def judge_normalize(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, MARKED).select("conv_id", "turn", C.normalize_answer(F.col("text")).alias("text"))


LOGGED = "SELECT 'u' || CAST(user_id AS VARCHAR(20)) AS question_id, 'A' || CAST(event_id % 4 AS VARCHAR(9)) AS arm, '**' || event_type || '** [PMID: ' || CAST(event_id AS VARCHAR(20)) || ']' AS answer, CASE WHEN event_type = 'error' THEN 'failed' END AS error, event_id FROM {events}"
LATEST = f"latest AS (SELECT question_id, arm, event_id, regexp_extract(answer, '[a-z]+') || ' (cite ' || event_id || ')' AS shown FROM ({plain(LOGGED)}) WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY question_id, arm ORDER BY event_id DESC) = 1), asked AS (SELECT DISTINCT 'u' || user_id AS question_id FROM events)"


def latest(s: SparkSession, d: str) -> DataFrame:
    log = bound(s, d, LOGGED)
    return E.latest_success(log, ["question_id", "arm"], F.col("error").isNotNull(), ["event_id"]).where("error IS NULL")


@query("judge_tasks", f"""WITH {LATEST}, t AS (SELECT question_id, p AS pair, x.arm AS xa, x.shown AS xs, y.arm AS ya, y.shown AS ys, substr(md5('42|' || question_id || '|' || p), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') AS sw, split_part(p, '_vs_', 1) AS wx, split_part(p, '_vs_', 2) AS wy
  FROM asked, unnest(['A3_vs_A1', 'A3_vs_A0']) AS u(p) LEFT JOIN latest x ON x.question_id = asked.question_id AND x.arm = split_part(p, '_vs_', 1) LEFT JOIN latest y ON y.question_id = asked.question_id AND y.arm = split_part(p, '_vs_', 2)),
r AS (SELECT *, CASE WHEN xa IS NULL THEN wx WHEN ya IS NULL THEN wy END AS miss FROM t)
SELECT question_id, pair, CASE WHEN miss IS NULL THEN CASE WHEN sw THEN ya ELSE xa END END AS a_arm, CASE WHEN miss IS NULL THEN CASE WHEN sw THEN xa ELSE ya END END AS b_arm, CASE WHEN miss IS NULL THEN CASE WHEN sw THEN ys ELSE xs END END AS shown_a, CASE WHEN miss IS NULL THEN CASE WHEN sw THEN xs ELSE ys END END AS shown_b,
  'missing answer for (''' || question_id || ''', ''' || miss || ''')' AS error FROM r""".replace("SELECT question_id, p AS pair", "SELECT asked.question_id, p AS pair").replace("md5('42|' || question_id", "md5('42|' || asked.question_id"))  # fmt: skip
def judge_tasks(s: SparkSession, d: str) -> DataFrame:
    asked = bound(s, d, "SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR(20)) AS id, '' AS question FROM {events}")
    return E.judge_tasks(asked, latest(s, d)).drop("question")


@query("judge_labels", f"WITH {LATEST}, o AS (SELECT question_id, list(arm ORDER BY md5('42|' || question_id || '|' || arm), arm) AS a FROM latest GROUP BY question_id) SELECT question_id, 'A=' || a[1] || ' B=' || a[2] || ' C=' || a[3] || ' D=' || a[4] AS labels FROM o WHERE len(a) = 4")
def judge_labels(s: SparkSession, d: str) -> DataFrame:
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("label_to_arm")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return E.blind_labels(latest(s, d)).select("question_id", pairs.alias("labels"))


DECIDED = f"SELECT 'q' || {ID} AS question_id, CASE WHEN event_id % 2 = 0 THEN 'A3_vs_A1' ELSE 'A3_vs_A0' END AS pair, CASE WHEN CAST(floor(event_id / 2) AS BIGINT) % 5 < 3 THEN 'A3' WHEN CAST(floor(event_id / 2) AS BIGINT) % 5 = 3 THEN 'A1' ELSE 'TIE' END AS winner, CASE WHEN event_id % 13 = 0 THEN 'failed' END AS error FROM {{events}}"
STRATA_SQL = "'S' || (1 + CAST(floor(event_id / 10) AS BIGINT) % 8)"


@query("hypotheses", f"""WITH j AS (SELECT winner, {STRATA_SQL.replace('event_id', 'CAST(substr(question_id, 2) AS BIGINT)')} AS stratum FROM ({plain(DECIDED)}) WHERE pair = 'A3_vs_A1' AND error IS NULL), w AS (SELECT count(*) FILTER (WHERE winner = 'A3') AS w, count(*) FILTER (WHERE winner = 'A1') AS l FROM j), w3 AS (SELECT count(*) FILTER (WHERE winner = 'A3') AS w, count(*) FILTER (WHERE winner = 'A1') AS l FROM j WHERE stratum = 'S3'),
p AS (SELECT w / (w + l) AS rate, least(1, 2 * (SELECT sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2))) FROM unnest(range(0, least(w, l) + 1)) AS u(i))) AS p FROM w), s AS ({SCORES_SQL}),
r AS (SELECT avg(entity_recall) FILTER (WHERE arm = 'A0') AS a, avg(entity_recall) FILTER (WHERE arm = 'A3') AS b FROM s WHERE stratum = 'S1')
SELECT 'H1' AS hypothesis, round(rate, 6) AS value, rate > 0.55 AND p < 0.05 AS supported FROM p UNION ALL SELECT 'H2', round(w / (w + l), 6), w / (w + l) >= 0.6 FROM w3 UNION ALL SELECT 'H3', round(CASE WHEN a > 0 AND b > 0 THEN abs(a - b) END, 6), coalesce(a > 0 AND b > 0 AND abs(a - b) <= 0.05, false) FROM r""")  # fmt: skip
def hypotheses(s: SparkSession, d: str) -> DataFrame:
    q = bound(s, d, GRADED_Q).select("id", "stratum")
    return E.verdicts(bound(s, d, DECIDED), q, scores(s, d)).withColumn("value", F.round("value", 6))


@query("pairwise_by_question", f"""WITH j AS (SELECT pair, winner, {STRATA_SQL.replace('event_id', 'CAST(substr(question_id, 2) AS BIGINT)')} AS stratum FROM ({plain(DECIDED)}) WHERE error IS NULL)
SELECT stratum, pair, count(*) AS n, count(*) FILTER (WHERE winner = 'A3') AS wins, count(*) FILTER (WHERE winner NOT IN ('A3', 'TIE')) AS losses, count(*) FILTER (WHERE winner = 'TIE') AS ties FROM j GROUP BY ALL""")  # fmt: skip
def pairwise_by_question(s: SparkSession, d: str) -> DataFrame:
    q = bound(s, d, GRADED_Q).select("id", "stratum")
    return E.pairwise(E.with_stratum(bound(s, d, DECIDED).where("error IS NULL"), q), ["stratum", "pair"], "A3").select("stratum", "pair", "n", "wins", "losses", "ties")


SEGMENTS = "SELECT d.doc_id AS question_id, map('X', source, 'Y', 'src0') AS label_to_arm, CASE WHEN d.doc_id % 7 = 0 THEN array() ELSE array(named_struct('made_by', array('X', 'unknown'), 'supported', CASE WHEN toxic = 1 THEN 'False' WHEN quality = 1 THEN 'TRUE' ELSE 'maybe' END), named_struct('made_by', array('X', 'Y'), 'supported', 'unverifiable')) END AS claims FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"


@query("claims_hallucination", """WITH d AS (SELECT d.doc_id, source, CASE WHEN toxic = 1 THEN 'false' WHEN quality = 1 THEN 'true' ELSE 'other' END AS s FROM documents d JOIN labels USING (doc_id) WHERE d.doc_id % 7 <> 0), c AS (SELECT source AS arm, s FROM d UNION ALL SELECT source, 'other' FROM d UNION ALL SELECT 'src0', 'other' FROM d),
a AS (SELECT 'src' || i AS arm FROM range(0, 3) AS u(i) UNION ALL SELECT 'none')
SELECT arm, count(s) AS claims, count(*) FILTER (WHERE s = 'true') AS supported, count(*) FILTER (WHERE s = 'false') AS unsupported, count(*) FILTER (WHERE s = 'other') AS unverifiable, (SELECT count(*) FROM d) AS questions_covered,
  CASE WHEN count(s) > 0 THEN round(count(*) FILTER (WHERE s = 'false') / count(s), 6) END AS hallucination_rate, CASE WHEN count(s) > 0 THEN round(count(*) FILTER (WHERE s = 'true') / count(s), 6) END AS support_rate FROM a LEFT JOIN c USING (arm) GROUP BY arm""")  # fmt: skip
def claims_hallucination(s: SparkSession, d: str) -> DataFrame:
    out = E.hallucination(bound(s, d, SEGMENTS), ("src0", "src1", "src2", "none"))
    return out.withColumns({c: F.round(c, 6) for c in ("hallucination_rate", "support_rate")})


@query("results_document", f"""WITH facts AS ({plain(FACTS)}), h AS (SELECT '{{"level":"' || level || '","n":' || count(*) || '}}' AS r FROM facts GROUP BY level), t AS (SELECT '{{"event_type":"' || event_type || '","n":' || count(*) || '}}' AS r FROM events GROUP BY event_type)
SELECT '{{"events": [' || (SELECT string_agg(r, ', ' ORDER BY r) FROM t) || '], "evidence": [' || (SELECT string_agg(r, ', ' ORDER BY r) FROM h) || ']}}' AS document""")  # fmt: skip
def results_document(s: SparkSession, d: str) -> DataFrame:
    per = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n"))
    return E.summary_document(evidence=per(bound(s, d, FACTS), "level"), events=per(bound(s, d, "SELECT event_type FROM {events}"), "event_type"))


@query("format_values", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN printf('%.1f%%', 100 * (event_id % 7 / 7)) ELSE '—' END AS share, CASE WHEN event_id % 7 > 0 THEN printf('%.1f', event_id / 7) ELSE '—' END AS number, CAST(event_id AS VARCHAR) AS whole FROM events")
def format_values(s: SparkSession, d: str) -> DataFrame:
    e = bound(s, d, "SELECT event_id FROM {events}")
    some = lambda c: F.when(F.col("event_id") % 7 > 0, c)
    return e.select("event_id", C.format_percent(some(F.col("event_id") % 7 / 7)).alias("share"), C.format_number(some(F.col("event_id") / 7)).alias("number"), C.format_number(F.col("event_id"), whole=True).alias("whole"))


@query("sql_helpers", """WITH g AS (SELECT event_type AS t, count(*) FILTER (WHERE user_id % 3 = 0) AS k, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, k / n AS r FROM g)
SELECT lower(trim(regexp_replace('Type ' || t || '!', '[^A-Za-z0-9_:.-]+', '_', 'g'), '_')) AS slug, round(greatest(0, (r + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(r * (1 - r) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS lo, round(least(1, (r + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(r * (1 - r) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS hi,
  round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM unnest(range(0, least(k, n - k) + 1)) AS u(i))), 6) AS p, CAST(CASE t WHEN 'view' THEN 0.75 WHEN 'click' THEN 0.444444 END AS DOUBLE) AS ratio FROM w""")  # fmt: skip
def sql_helpers(s: SparkSession, d: str) -> DataFrame:
    C.register(s)
    bound(s, d, "SELECT event_type AS t, count_if(user_id % 3 = 0) AS k, count(*) AS n FROM {events} GROUP BY event_type").createOrReplaceTempView("kgweave_helpers")
    return s.sql("""SELECT slug('Type ' || t || '!') AS slug, round(wilson_lo(k, n), 6) AS lo, round(wilson_hi(k, n), 6) AS hi, round(sign_test_p(k, n - k), 6) AS p,
      CASE WHEN t IN ('view', 'click') THEN round(lcs_ratio(t, 'vice'), 6) END AS ratio FROM kgweave_helpers""")
