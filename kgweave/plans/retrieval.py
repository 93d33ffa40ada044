"""Linking by similarity, chunks, question-driven retrieval over the whole graph, and the arms' contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.operators import context as X
from kgweave.operators import follow_up as FU
from kgweave.operators import graph_build as B
from kgweave.operators import retrieval as R
from kgweave.plans.bindings import RAW_FACTS, RAW_RELATIONS, bound, plain
from kgweave.plans.graph import FLAT, GRAPH_CTE, RANK, SEED_CTE, TYPE_LINES, VERB, adjacency, built_from, graph, kg_index, seed
from kgweave.plans.queries import QUESTIONS, dense
from kgweave.plans.registry import ORACLES, query
from kgweave.sources.shared import cut

# written out on their own, not taken from the engine's constants
# Fixed values.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "of", "to", "for", "in", "on", "at", "by", "with", "from", "and", "or",
    "but", "if", "then", "than", "so", "as", "it", "this", "that", "these", "those", "what", "which", "who", "whom", "whose", "where", "when", "why",
    "how", "does", "do", "did", "can", "could", "should", "would", "will", "have", "has", "had", "i", "you", "we", "they", "he", "she", "me", "us",
    "them", "him", "her", "between", "about", "into", "through", "during", "before", "after", "above", "below", "tell", "explain", "show", "list",
    "give", "find", "say", "see", "look", "describe", "any", "some", "all", "most", "more", "less", "very", "patient", "class", "gene", "drug",
    "phenotype", "variant", "carry", "carries", "carrying", "pharmacogenomic", "association", "associations", "reference", "references", "cite",
    "citation", "clinical", "evidence", "guideline", "guidelines", "level", "interaction", "interactions",
)
STOP = "', '".join(STOP_WORDS)
LINK_INDEX = """SELECT 'd' || CAST(min(doc_id) AS VARCHAR(20)) AS id, lower(split_part(text, ' ', 2)) AS label, min(lower(split_part(text, ' ', 3))) || '; ' || max(lower(split_part(text, ' ', 4))) AS alt, min(doc_id) AS ord
FROM {documents} WHERE split_part(text, ' ', 2) <> '' GROUP BY lower(split_part(text, ' ', 2))"""


def terms_sql(questions: str, stop: str = STOP) -> str:
    return f"""tok AS (SELECT question_id, list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND w NOT IN ('{stop}')) AS w FROM ({questions})),
gram AS (SELECT question_id, array_to_string(w[i:i + n - 1], ' ') AS term, min((3 - n) * 1000000 + i) AS pos FROM tok, unnest([3, 2, 1]) AS a(n), unnest(range(1, len(w) - n + 2)) AS b(i) GROUP BY ALL),
term AS (SELECT * FROM gram WHERE contains(term, ' ') OR length(term) >= 4 OR regexp_matches(term, '[0-9]'))"""


def choices_sql(index: str) -> str:
    parts = "list_filter(list_transform(regexp_split_to_array(coalesce(alt, ''), '[,;]'), lambda x: trim(x)), lambda x: x <> '')"
    return f"""ix AS ({index}), choice AS (SELECT id, lower(label) AS choice, ord, 0 AS p FROM ix WHERE label <> '' UNION ALL SELECT id, lower(a[i]), ord, i FROM (SELECT id, ord, {parts} AS a FROM ix), unnest(range(1, len(a) + 1)) AS u(i))"""


def similar_sql(left: str, right: str, worst: float) -> str:
    """pair(a, b, d): dynamic programming over lists; pairs that edit distance rules out are left out before."""
    size = "(length(a) + length(b))"
    bytes_ = f"CASE WHEN strlen(a) = length(a) AND strlen(b) = length(b) THEN {worst} ELSE {2 * worst} END"
    row = "list_transform(range(1, len(cb) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN cb[k] = x[1] THEN CASE WHEN k > 1 THEN acc[k - 1] ELSE 0 END + 1 ELSE acc[k] END)))"
    return f"""near_ AS (SELECT a, b, list_transform(string_split(a, ''), lambda c: [CAST(unicode(c) AS BIGINT)]) AS ca, list_transform(string_split(b, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS cb FROM (SELECT DISTINCT term AS a FROM {left}) l, (SELECT DISTINCT choice AS b FROM {right}) r
  WHERE 1 - 2.0 * least(length(a), length(b)) / {size} <= {worst} + 1e-9 AND levenshtein(a, b) <= ({bytes_}) * {size} + 1e-9),
pair AS (SELECT * FROM (SELECT a, b, 1 - 2.0 * list_max(list_reduce(list_prepend(list_transform(cb, lambda c: CAST(0 AS BIGINT)), ca), lambda acc, x: {row})) / {size} AS d FROM near_) WHERE d <= {worst} + 1e-9)"""


def link_sql(questions: str, index: str, stop: str = STOP) -> str:
    return f"""{terms_sql(questions, stop)}, {choices_sql(index)}, {similar_sql('term', 'choice', 0.23)},
best AS (SELECT a AS term, id, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), ord, p, id) AS r FROM pair JOIN choice ON choice = b QUALIFY r <= 3),
scored AS (SELECT * FROM (SELECT *, round(d - CASE WHEN contains(term, ' ') THEN 0.05 ELSE 0 END, 9) AS score FROM best) WHERE score <= 0.18),
linked AS (SELECT question_id, id, arg_min(term, score * 1e12 + pos) AS term, min(score) AS score, min(pos * 10 + r) AS f FROM term JOIN scored USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, f, id) AS rank FROM linked QUALIFY rank <= 6)"""


@query("link_fuzzy", f"WITH {link_sql(plain(QUESTIONS), plain(LINK_INDEX))} SELECT question_id, id, term, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked")
def link_fuzzy(s: SparkSession, d: str) -> DataFrame:
    return R.link_fuzzy(bound(s, d, QUESTIONS), bound(s, d, LINK_INDEX)).select("question_id", "id", "term", F.round("score", 6).alias("score"), "rank")


TYPED = "SELECT DISTINCT lower(split_part(text, ' ', 3)) AS query FROM {benchmark}"


@query("search_autocomplete", f"""WITH term AS (SELECT DISTINCT trim(query) AS term FROM ({plain(TYPED)}) WHERE trim(query) <> ''), {choices_sql(plain(LINK_INDEX))}, {similar_sql('term', 'choice', 0.35)},
hit AS (SELECT a AS query, id, min(d) AS score, min(ord * 100 + p) AS o FROM pair JOIN choice ON choice = b GROUP BY ALL)
SELECT query, hit.id, label, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9), o, hit.id) AS INTEGER) AS rank FROM hit JOIN ix ON ix.id = hit.id QUALIFY rank <= 12""")  # fmt: skip
def search_autocomplete(s: SparkSession, d: str) -> DataFrame:
    found = R.autocomplete(bound(s, d, LINK_INDEX), bound(s, d, TYPED))
    return found.select("query", "id", "label", F.round("score", 6).alias("score"), "rank")


HELD_KEYS = ["variant", "gene", "type", "level", "chemicals", "phenotypes"]
CHUNK_SQL = f"""raw_c AS ({plain(RAW_FACTS)}), raw_r AS ({plain(RAW_RELATIONS)}), row_keys AS (SELECT DISTINCT {" || '|' || ".join(f'trim({c})' for c in HELD_KEYS)} AS k FROM raw_c WHERE level IN ('1A', '1B', '2A', '2B')),
held AS (SELECT k FROM row_keys QUALIFY row_number() OVER (ORDER BY md5('42|' || k), k) <= round_even((SELECT count(*) FROM row_keys) * 0.30, 0)),
ids AS (SELECT *, list_filter(list_transform(regexp_split_to_array(pmids, '[,;]'), lambda x: trim(x)), lambda x: x <> '')[1:10] AS ps FROM raw_r WHERE lower(trim(association)) = 'associated'),
chunk AS (SELECT 'clinicalVariants' AS source, 'PharmGKB clinical variant — gene: ' || gene || '; variant(s): ' || variant || '; type: ' || type || '; evidence level: ' || level || '; chemicals: ' || chemicals || CASE WHEN phenotypes <> '' THEN '; phenotype(s): ' || phenotypes ELSE '' END AS text, gene, level, CAST(NULL AS VARCHAR) AS entity1, CAST(NULL AS VARCHAR) AS pmids
  FROM raw_c WHERE level IN ('1A', '1B', '2A', '2B') AND {" || '|' || ".join(f'trim({c})' for c in HELD_KEYS)} NOT IN (SELECT k FROM held)
UNION ALL SELECT * FROM (SELECT 'relationships', 'PharmGKB relationship: ' || entity1 || ' (' || type1 || ') — ' || entity2 || ' (' || type2 || '); PMIDs: ' || array_to_string(ps, ', '), NULL, NULL, entity1, array_to_string(ps, ';') FROM ids ORDER BY ord LIMIT 20000))"""


def chunks(s: SparkSession, d: str) -> DataFrame:
    f = bound(s, d, RAW_FACTS)
    return R.corpus(B.exclude(f, B.holdout(f, HELD_KEYS), HELD_KEYS), bound(s, d, RAW_RELATIONS))


@query("rag_chunks", f"WITH {CHUNK_SQL} SELECT source, text, gene, level, entity1, pmids FROM chunk")
def rag_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).select("source", "text", "gene", "level", "entity1", F.array_join("pmids", ";").alias("pmids"))


# question-driven retrieval

ASKED = """SELECT CAST(n_nationkey AS BIGINT) AS question_id, CASE WHEN n_nationkey = 24 THEN 'why?' ELSE 'Is ' || lower(n_name) || ' linked with P' || CAST(100 + n_nationkey AS VARCHAR(9)) || ' or p1' || CAST(70 + n_nationkey AS VARCHAR(9)) || '?' END AS question,
  CASE WHEN n_nationkey % 5 = 0 THEN 'gene_s1' END AS focus, n_nationkey % 8 AS seen FROM {nation}"""
INDEXED = "SELECT id, label, coalesce(fullName, '') AS alt, row_number() OVER (ORDER BY type, lower(label), id) AS ord FROM n"
LINE = "al || ' --' || verb || CASE WHEN len(tags) > 0 THEN '[' || array_to_string(tags, ', ') || ']' ELSE '' END || '--> ' || bl"
PATH_LEVELS = "r0 AS (SELECT DISTINCT from_id AS root, from_id AS node, from_id AS path FROM prs)" + "".join(
    f", r{i} AS (SELECT root, dst AS node, min(path || '>' || dst) AS path FROM r{i - 1} JOIN sym ON src = node WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT root, node FROM r{j}' for j in range(i))}) o WHERE o.root = r{i - 1}.root AND o.node = dst) GROUP BY root, dst)" for i in range(1, 5)
)
RETRIEVE_SQL = f"""WITH {GRAPH_CTE}, asked AS ({plain(ASKED)}), {link_sql('SELECT question_id, question FROM asked', INDEXED)},
ent0 AS (SELECT question_id, id, term, rank FROM ranked UNION ALL SELECT question_id, focus, '(currently selected)', 0 FROM asked a WHERE focus IS NOT NULL AND (question_id, focus) NOT IN (SELECT (question_id, id) FROM ranked)),
ent AS (SELECT ent0.*, n.label, n.type FROM ent0 JOIN n USING (id)),
en AS (SELECT e.*, a.label AS al, b.label AS bl, {VERB.replace('CASE type', 'CASE e.type')} AS verb, list_filter(['L' || nullif(e.level, ''), nullif(role, ''), CASE WHEN critical THEN 'CRITICAL' END, CASE WHEN count > 0 THEN count || ' variants' END], lambda t: t IS NOT NULL) AS tags FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target),
sym AS (SELECT source AS src, target AS dst FROM e UNION SELECT target, source FROM e),
near AS (SELECT question_id, ent.id AS node, rank, en.id AS edge, pmids, '  - ' || {LINE} AS line FROM ent JOIN en ON ent.id IN (source, target)),
near_t AS (SELECT question_id, node, string_agg(line, chr(10) ORDER BY line) AS t FROM (SELECT *, row_number() OVER (PARTITION BY question_id, node ORDER BY line) AS r FROM near) WHERE r <= 60 GROUP BY ALL),
heads AS (SELECT ent.question_id, count(*) AS n_entities, string_agg('  • ' || label || ' (' || type || ') — matched "' || term || '"', chr(10) ORDER BY rank) AS el, string_agg('DIRECT NEIGHBOURHOOD OF ' || label || ':' || coalesce(chr(10) || t, '') || chr(10), chr(10) ORDER BY rank) AS nl FROM ent LEFT JOIN near_t ON near_t.question_id = ent.question_id AND node = ent.id GROUP BY ent.question_id),
prs AS (SELECT a.question_id, a.rank AS i, b.rank AS j, a.id AS from_id, b.id AS to_id FROM ent a JOIN ent b ON a.question_id = b.question_id AND a.rank < b.rank), {PATH_LEVELS},
pth AS (SELECT DISTINCT from_id, to_id, f.hops, f.path FROM prs JOIN ({' UNION ALL '.join(f'SELECT root, node, {i} AS hops, path FROM r{i}' for i in range(1, 5))}) f ON root = from_id AND node = to_id),
stp AS (SELECT from_id, to_id, hops, i AS step, string_split(path, '>')[i] AS x, string_split(path, '>')[i + 1] AS y FROM pth, unnest(range(1, hops + 1)) AS u(i)),
drawn AS (SELECT from_id, to_id, hops, step, x, y, en.*, {LINE} AS line FROM stp JOIN en ON least(source, target) = least(x, y) AND greatest(source, target) = greatest(x, y)
  QUALIFY row_number() OVER (PARTITION BY from_id, to_id, step ORDER BY coalesce(NOT critical, true), {RANK}, type, id) = 1),
told AS (SELECT from_id, to_id, hops, bool_or(coalesce(critical, false) OR coalesce(level IN ('1A', '1B'), false)) AS critical, string_agg('    ' || line, chr(10) ORDER BY step) AS ls FROM drawn GROUP BY ALL),
pl AS (SELECT question_id, count(*) AS n_paths, string_agg('  ' || a.label || ' → ' || b.label || ' (' || hops || ' hop' || CASE WHEN hops > 1 THEN 's' ELSE '' END || CASE WHEN critical THEN ', CRITICAL' ELSE '' END || '):' || chr(10) || ls, chr(10) ORDER BY NOT critical, hops, i, j) AS t
  FROM prs JOIN told USING (from_id, to_id) JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id GROUP BY question_id),
on_path AS (SELECT question_id, i, j, d.* FROM prs JOIN drawn d USING (from_id, to_id)),
cited AS (SELECT question_id, p, min(o) AS o FROM (SELECT question_id, '1' || lpad(CAST(rank AS VARCHAR), 3, '0') || '000' || line || chr(1) || lpad(CAST(k AS VARCHAR), 3, '0') AS o, pmids[k] AS p FROM near, unnest(range(1, len(pmids) + 1)) AS u(k)
  UNION ALL SELECT question_id, '2' || lpad(CAST(i AS VARCHAR), 3, '0') || lpad(CAST(j AS VARCHAR), 3, '0') || lpad(CAST(step AS VARCHAR), 4, '0') || chr(1) || lpad(CAST(k AS VARCHAR), 3, '0'), pmids[k] FROM on_path, unnest(range(1, len(pmids) + 1)) AS u(k)) GROUP BY ALL),
pm_q AS (SELECT question_id, count(*) AS n_pmids, array_to_string(list(p ORDER BY o)[1:12], ',') AS citations FROM cited GROUP BY question_id),
hood AS (SELECT DISTINCT id AS sd, id AS node FROM ent UNION SELECT id, dst FROM ent JOIN sym ON src = id),
sub_n AS (SELECT question_id, node FROM ent JOIN hood ON sd = id UNION SELECT question_id, x FROM on_path UNION SELECT question_id, y FROM on_path),
in_e AS (SELECT h1.sd, e.id FROM e JOIN hood h1 ON h1.node = source JOIN hood h2 ON h2.node = target AND h2.sd = h1.sd), sub_e AS (SELECT question_id, in_e.id FROM ent JOIN in_e ON sd = ent.id UNION SELECT question_id, id FROM on_path)
SELECT question_id, coalesce(n_paths, 0) AS n_paths, coalesce(n_pmids, 0) AS n_pmids, coalesce(citations, '') AS citations, coalesce((SELECT count(*) FROM sub_n s WHERE s.question_id = a.question_id), 0) AS subgraph_nodes, coalesce((SELECT count(*) FROM sub_e s WHERE s.question_id = a.question_id), 0) AS subgraph_edges,
  'QUESTION: ' || question || chr(10) || chr(10) || CASE WHEN n_entities IS NULL THEN 'ENTITY LINKING: no specific graph entities matched the question.' || chr(10) ELSE 'ENTITIES IDENTIFIED IN QUESTION:' || chr(10) || el || chr(10) || chr(10) || nl
    || CASE WHEN n_paths > 0 THEN chr(10) || 'SHORTEST REASONING PATHS (' || n_paths || '):' || chr(10) || pl.t || chr(10) WHEN n_entities > 1 THEN chr(10) || 'No path of ≤4 hops found between the mentioned entities.' || chr(10) ELSE '' END || CASE WHEN focus IS NOT NULL THEN chr(10) || 'USER CONTEXT: currently selected = S1 (gene).' ELSE '' END END
    || CASE WHEN seen = 0 THEN '' WHEN n_entities IS NULL THEN chr(10) || 'Currently visible to the user: ' || array_to_string(['P1', 'P2', 'P3', 'P4', 'P5', 'P6', 'P7'][1:seen], ', ') ELSE chr(10) || 'USER CONTEXT: ' || seen || ' nodes currently visible on the canvas.' END AS context_text
FROM asked a LEFT JOIN heads USING (question_id) LEFT JOIN pl USING (question_id) LEFT JOIN pm_q USING (question_id)"""


def asked(s: SparkSession, d: str) -> DataFrame:
    q = bound(s, d, ASKED)
    seen = F.transform(F.sequence(F.lit(1), F.greatest("seen", F.lit(1))), lambda i: F.concat(F.lit("drug_p"), i.cast("string")))
    return q.select("question_id", "question", "focus", F.when(F.col("seen") > 0, seen).otherwise(F.array().cast("array<string>")).alias("visible"))


_RETRIEVED: dict[tuple[str, str, str], DataFrame] = {}


def retrieved(s: SparkSession, d: str) -> DataFrame:
    """Retrieval for the questions, written once in a session for the tables as they are."""
    key = built_from(s, d)
    if key not in _RETRIEVED:
        nodes, edges = graph(s, d)
        _RETRIEVED[key] = cut(X.retrieve(asked(s, d), kg_index(s, d).withColumnRenamed("place", "ord"), nodes, edges, adjacency=adjacency(s, d)), "retrieved")
    return _RETRIEVED[key]


@query("retrieve_question", RETRIEVE_SQL)
def retrieve_question(s: SparkSession, d: str) -> DataFrame:
    return retrieved(s, d).select("question_id", "n_paths", F.size("pmids").cast("long").alias("n_pmids"), F.array_join("citations", ",").alias("citations"), "subgraph_nodes", "subgraph_edges", "context_text")


# follow-up runs; words written out on their own. Fixed values.
FOLLOW_UP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "of", "to", "for", "in", "on", "at", "by", "with", "from", "and", "or", "but", "if", "then",
    "than", "so", "as", "it", "this", "that", "these", "those", "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "does", "do",
    "did", "can", "could", "should", "would", "will", "have", "has", "had", "between", "about", "into", "through", "pharmacogenomic", "association",
    "associations", "reference", "references", "cite", "citation", "clinical", "evidence", "guideline", "guidelines", "level", "interaction",
    "interactions", "carry", "carries", "carrying", "patient", "class", "gene", "drug", "phenotype", "variant",
)
FOLLOWED = """SELECT 'F' || CAST(n_nationkey AS VARCHAR(20)) AS id, CASE n_nationkey % 3 WHEN 0 THEN 'NEG' WHEN 1 THEN 'EDGE' ELSE 'OOD' END AS pattern,
  CASE WHEN n_nationkey = 24 THEN 'Could it be?' ELSE 'Tell me all about ' || lower(n_name) || ' and P' || CAST(90 + n_nationkey AS VARCHAR(20)) || ' between s' || CAST(1 + n_nationkey % 9 AS VARCHAR(20)) || ' patients' END AS question FROM {nation}"""
FOLLOW_LINE = "'  - ' || al || ' --' || verb || CASE WHEN len(tags) > 0 THEN '[' || array_to_string(tags, ', ') || ']' ELSE '' END || '--> ' || bl"
FOLLOW_SQL = f"""WITH {GRAPH_CTE}, f AS ({plain(FOLLOWED)}), {link_sql('SELECT id AS question_id, question FROM f', INDEXED, "', '".join(FOLLOW_UP_WORDS))},
ent AS (SELECT question_id, rank, ranked.id, term, n.label, n.type FROM ranked JOIN n USING (id)),
en AS (SELECT e.*, a.label AS al, b.label AS bl, {VERB.replace('CASE type', 'CASE e.type')} AS verb, list_filter(['L' || nullif(e.level, ''), CASE WHEN critical THEN 'CRITICAL' END], lambda t: t IS NOT NULL) AS tags FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target),
near AS (SELECT node, string_agg(line, chr(10) ORDER BY line) AS t FROM (SELECT d.id AS node, {FOLLOW_LINE} AS line FROM (SELECT DISTINCT id FROM ent) d JOIN en ON d.id IN (source, target) QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY line) <= 60) GROUP BY node),
told AS (SELECT question_id, string_agg(label, '|' ORDER BY rank) AS entities, string_agg('  • ' || label || ' (' || type || ') — matched "' || term || '"', chr(10) ORDER BY rank) AS el, string_agg('DIRECT NEIGHBOURHOOD OF ' || label || ':' || coalesce(chr(10) || t, '') || chr(10), chr(10) ORDER BY rank) AS nl FROM ent LEFT JOIN near ON node = id GROUP BY question_id),
a3 AS (SELECT f.id AS question_id, pattern, coalesce(entities, '') AS entities, 'QUESTION: ' || question || chr(10) || chr(10) || coalesce('ENTITIES IDENTIFIED IN QUESTION:' || chr(10) || el || chr(10) || chr(10) || nl, 'ENTITY LINKING: no specific graph entities matched the question.') AS context FROM f LEFT JOIN told ON question_id = f.id)
SELECT question_id, pattern, 'A3' AS arm, entities, context, CAST(length(context) AS INTEGER) AS context_chars FROM a3
UNION ALL SELECT id, pattern, 'A0', '', '(No retrieved context provided. Answer from your own knowledge if confident; otherwise say so.)', NULL FROM f"""


def followed(s: SparkSession, d: str) -> DataFrame:
    return FU.contexts(bound(s, d, FOLLOWED), kg_index(s, d).withColumnRenamed("place", "ord"), *graph(s, d))


@query("follow_up_contexts", FOLLOW_SQL)
def follow_up_contexts(s: SparkSession, d: str) -> DataFrame:
    return followed(s, d).select("question_id", "pattern", "arm", F.array_join("entities", "|").alias("entities"), "context", "context_chars")


TURNED = "substr(md5('42|' || question_id || '|' || pair), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7')"


@query("follow_up_pairs", f"""WITH a AS (SELECT question_id, pattern, arm, md5(context) AS answer FROM ({FOLLOW_SQL})), p AS (SELECT question_id, pattern, 'A3_vs_A0' AS pair, max(answer) FILTER (WHERE arm = 'A3') AS x, max(answer) FILTER (WHERE arm = 'A0') AS y FROM a GROUP BY ALL)
SELECT question_id, pattern, pair, CASE WHEN {TURNED} THEN 'A0' ELSE 'A3' END AS shown_a_arm, CASE WHEN {TURNED} THEN 'A3' ELSE 'A0' END AS shown_b_arm, CASE WHEN {TURNED} THEN y ELSE x END AS answer_a, CASE WHEN {TURNED} THEN x ELSE y END AS answer_b FROM p""")
def follow_up_pairs(s: SparkSession, d: str) -> DataFrame:
    """The contexts' digests stand for answers; pairs with A1, which has none here, are left out."""
    return FU.judging(bound(s, d, FOLLOWED), followed(s, d).select("question_id", "arm", F.md5("context").alias("answer")))


CHAT = "'Graph context (the only facts you may use):' || chr(10) || '---' || chr(10) || context_text || chr(10) || '---' || chr(10) || chr(10) || 'User question: ' || question"


@query("retrieve_slim", f"WITH r AS ({RETRIEVE_SQL}) SELECT question_id, CAST(n_paths AS INTEGER) AS n_paths, subgraph_nodes, subgraph_edges, CAST(length({CHAT}) AS INTEGER) AS chars FROM r JOIN ({plain(ASKED)}) USING (question_id)")
def retrieve_slim(s: SparkSession, d: str) -> DataFrame:
    return X.slim(retrieved(s, d)).select("question_id", F.coalesce(F.size("paths"), F.lit(0)).alias("n_paths"), "subgraph_nodes", "subgraph_edges", "chars")


@query("arm_contexts", f"""WITH q AS ({plain(QUESTIONS)}), a0 AS (SELECT question_id, 'A0' AS arm, '(No retrieved context provided. Answer from your own knowledge if confident; otherwise say so.)' AS context FROM q),
a2 AS (WITH {SEED_CTE}, en AS (SELECT e.*, a.label AS al, b.label AS bl, {VERB.replace('CASE type', 'CASE e.type')} AS verb FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target), sn AS (SELECT * FROM n WHERE id IN (SELECT id FROM keep)), {TYPE_LINES.format('sn')}, ls AS (SELECT {FLAT} AS line FROM en WHERE source IN (SELECT id FROM keep) AND target IN (SELECT id FROM keep))
  SELECT question_id, 'A2', 'VISIBLE GRAPH (anesthesia seed subgraph):' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY line) FROM tl) || chr(10) || chr(10) || 'Relationships:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY line) FROM ls) FROM q),
u AS (SELECT * FROM a0 UNION ALL SELECT * FROM a2) SELECT question_id, arm, md5(context) AS context_md5, md5('Context:' || chr(10) || '---' || chr(10) || context || chr(10) || '---' || chr(10) || chr(10) || 'User question: ' || question) AS prompt_md5, CAST(length(context) AS INTEGER) AS context_chars FROM u JOIN q USING (question_id)""")  # fmt: skip
def arm_contexts(s: SparkSession, d: str) -> DataFrame:
    out = X.arm_contexts(bound(s, d, QUESTIONS), ("A0", "A2"), seed=seed(s, d))
    return out.select("question_id", "arm", F.md5("context").alias("context_md5"), F.md5("prompt").alias("prompt_md5"), "context_chars")


@query("arm_graph", f"WITH r AS ({RETRIEVE_SQL}) SELECT question_id, 'A3' AS arm, md5('Context:' || chr(10) || '---' || chr(10) || context_text || chr(10) || '---' || chr(10) || chr(10) || 'User question: ' || question) AS prompt_md5, CAST(length(context_text) AS INTEGER) AS context_chars FROM r JOIN ({plain(ASKED)}) USING (question_id)")
def arm_graph(s: SparkSession, d: str) -> DataFrame:
    return X.arm_contexts(asked(s, d), ("A3",), retrieved=retrieved(s, d)).select("question_id", "arm", F.md5("prompt").alias("prompt_md5"), "context_chars")


TEXTS = "SELECT doc_id, text FROM {documents}"


@query("arm_hybrid", f"""WITH r AS ({ORACLES['rag_rrf']}) SELECT item_id AS question_id, 'A1' AS arm, 'RETRIEVED EVIDENCE (top-8 by hybrid BM25 + dense search):' || coalesce(chr(10) || string_agg('  [' || rank || '] ' || d.text, chr(10) ORDER BY rank), '') AS context
FROM benchmark b LEFT JOIN r ON r.question_id = item_id LEFT JOIN documents d USING (doc_id) GROUP BY item_id""")  # fmt: skip
def arm_hybrid(s: SparkSession, d: str) -> DataFrame:
    docs, questions = bound(s, d, TEXTS), bound(s, d, QUESTIONS)
    ranked = R.fuse([R.bm25(docs, questions, okapi=False), dense(s, d)])
    return X.arm_contexts(questions, ("A1",), ranked=ranked, chunks=docs).select("question_id", "arm", "context")
