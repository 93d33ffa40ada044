"""Queries over the driver's tables and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgweave.constants import HIGH_EVIDENCE, NEGATIVE_CUES, REFUSAL_CUES, STOPWORDS
from kgweave.functions import columns as C
from kgweave.operators import evaluation as E
from kgweave.operators import graph_build as B
from kgweave.operators import graph_ops as G
from kgweave.operators import retrieval as R
from kgweave.plans.bindings import FACTS, RELATIONS, bound, plain
from kgweave.plans.registry import query
from kgweave.streaming.limiter import limit_batch

RANK = "CASE level WHEN '1A' THEN 1 WHEN '1B' THEN 2 WHEN '2A' THEN 3 WHEN '2B' THEN 4 WHEN '3' THEN 5 WHEN '4' THEN 6 ELSE 99 END"
CRITICAL = "(contains(role, 'Toxicity') AND level IN ('1A', '1B'))"
FACTS_CTE = f"facts AS ({plain(FACTS)})"
EVENTS_CTE = f"events_ AS (SELECT 'drug:' || chemical AS source, 'gene:' || gene AS target, CASE WHEN {CRITICAL} THEN 'linked_to_risk' ELSE 'affects_response_to' END AS type, level, role, {CRITICAL} AS critical, ord FROM facts)"
EDGES_CTE = f"""{FACTS_CTE}, {EVENTS_CTE}, per_role AS (SELECT source, target, type, role, min(ord) AS o FROM events_ GROUP BY ALL),
roles AS (SELECT source, target, type, string_agg(role, ',' ORDER BY o) AS role FROM per_role GROUP BY ALL),
edges AS (SELECT source, target, type, arg_min(level, CAST({RANK} AS VARCHAR) || ord) AS level, bool_or(critical) AS critical, count(*) AS n FROM events_ GROUP BY ALL),
merged AS (SELECT source, target, type, level, critical, n, roles.role FROM edges JOIN roles USING (source, target, type))"""
WHOLE_CTE = f"{FACTS_CTE}, pairs_ AS (SELECT DISTINCT 'drug:' || chemical AS source, 'gene:' || gene AS target FROM facts), sym AS (SELECT source AS src, target AS dst FROM pairs_ UNION SELECT target, source FROM pairs_)"


def facts(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, FACTS)


def merged(s: SparkSession, d: str) -> DataFrame:
    return B.merge_edges(B.fact_edges(facts(s, d)), ["source", "target", "type"])


def whole(s: SparkSession, d: str) -> DataFrame:
    """All pairs of a drug and a gene that any fact joins."""
    return B.fact_edges(facts(s, d)).select("source", "target").distinct()


def seeds(s: SparkSession) -> DataFrame:
    return s.range(1, 6).select(F.col("id").alias("question_id"), F.concat(F.lit("gene:S"), F.col("id").cast("string")).alias("node"))


SEEDS_CTE = "seeds AS (SELECT CAST(i AS BIGINT) AS question_id, 'gene:S' || i AS node FROM range(1, 6) AS u(i))"

# graph construction


@query("kg_slug_nodes", f"""WITH {FACTS_CTE}, rows_ AS (SELECT 'drug' AS kind, chemical AS label, level, ord FROM facts UNION ALL SELECT 'gene', gene, level, ord FROM facts UNION ALL SELECT 'phenotype', phenotype, level, ord FROM facts),
ids AS (SELECT lower(trim(regexp_replace(kind || '_' || label, '[^A-Za-z0-9_:.-]+', '_', 'g'), '_')) AS id, * FROM rows_)
SELECT id, arg_min(label, ord) AS label, arg_min(kind, ord) AS kind, arg_min(level, ord) AS level FROM ids GROUP BY id""")  # fmt: skip
def kg_slug_nodes(s: SparkSession, d: str) -> DataFrame:
    f = facts(s, d)
    rows = None
    for kind, c in (("drug", "chemical"), ("gene", "gene"), ("phenotype", "phenotype")):
        part = f.select(B.node_id(kind, F.col(c)).alias("id"), F.col(c).alias("label"), F.lit(kind).alias("kind"), "level", "ord")
        rows = part if rows is None else rows.unionByName(part)
    return B.merge_nodes(rows, "id", ["label", "kind", "level"], "ord")


@query("kg_edges_merged", f"WITH {EDGES_CTE} SELECT source, target, type, level, role, critical, n FROM merged")
def kg_edges_merged(s: SparkSession, d: str) -> DataFrame:
    return merged(s, d).select("source", "target", "type", "level", "role", "critical", "n")


@query("kg_phenotype_edges", f"""WITH {FACTS_CTE}, e AS (SELECT CASE WHEN {CRITICAL} THEN 'drug:' || chemical ELSE 'gene:' || gene END AS source, 'phenotype:' || phenotype AS target, CASE WHEN {CRITICAL} THEN 'can_trigger' ELSE 'associated_with' END AS type, level, ord FROM facts)
SELECT source, target, type, arg_min(level, CAST({RANK} AS VARCHAR) || ord) AS level, count(*) AS n FROM e GROUP BY source, target, type""")  # fmt: skip
def kg_phenotype_edges(s: SparkSession, d: str) -> DataFrame:
    return B.merge_edges(B.phenotype_edges(facts(s, d)), ["source", "target", "type"]).select("source", "target", "type", "level", "n")


@query("kg_fact_expansion", "SELECT 'S' || s_suppkey AS gene_name, trim(s_name) AS chemical, CAST(0 AS INTEGER) AS c_ord FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'P' || s_suppkey, CAST(1 AS INTEGER) FROM supplier")
def kg_fact_expansion(s: SparkSession, d: str) -> DataFrame:
    rows = bound(s, d, "SELECT 'S' || CAST(s_suppkey AS VARCHAR(20)) || ', ' AS gene, s_name || ' , ,P' || CAST(s_suppkey AS VARCHAR(20)) AS chemicals, '' AS phenotypes FROM {supplier}")
    return B.expand_facts(rows).select("gene_name", "chemical", F.col("c_ord").cast("int").alias("c_ord"))


@query("kg_class_edges", f"WITH {FACTS_CTE} SELECT DISTINCT 'drug:' || chemical AS source, 'class:' || p_brand AS target FROM facts JOIN part ON chemical = 'P' || p_partkey")
def kg_class_edges(s: SparkSession, d: str) -> DataFrame:
    classes = bound(s, d, "SELECT 'P' || CAST(p_partkey AS VARCHAR(20)) AS chemical, p_brand AS drug_class FROM {part}")
    return B.class_edges(facts(s, d), classes)


MEMBERS_CTE = f"{FACTS_CTE}, members AS (SELECT gene, variant, arg_min({{'level': level, 'role': role, 'chemical': chemical, 'phenotype': phenotype, 'ord': ord}}, CAST({RANK} AS VARCHAR) || ord) AS b, min(ord) AS first FROM facts GROUP BY gene, variant), flat AS (SELECT gene, variant, first, b.level AS level, b.role AS role, b.chemical AS chemical, b.phenotype AS phenotype, b.ord AS ord FROM members)"


@query("kg_clusters", f"WITH {MEMBERS_CTE} SELECT gene, gene || ' variants (' || count(*) || ')' AS label, count(*) AS n, arg_min(level, {RANK}) AS level, string_agg(variant || ':' || level, ',' ORDER BY first) AS members FROM flat GROUP BY gene")
def kg_clusters(s: SparkSession, d: str) -> DataFrame:
    c = B.clusters(B.cluster_members(facts(s, d)))
    return c.select("gene", "label", "n", "level", F.array_join(F.transform("members", lambda m: F.concat(m["variant"], F.lit(":"), m["level"])), ",").alias("members"))


@query("kg_cluster_critical", f"WITH {MEMBERS_CTE} SELECT DISTINCT gene, phenotype FROM flat WHERE {CRITICAL} AND phenotype <> ''")
def kg_cluster_critical(s: SparkSession, d: str) -> DataFrame:
    return B.critical_phenotypes(B.cluster_members(facts(s, d)))


@query("kg_pmid_attach", f"""WITH {EDGES_CTE}, rel AS ({plain(RELATIONS)}), ids AS (SELECT DISTINCT least(entity1, entity2) AS lo, greatest(entity1, entity2) AS hi, trim(p) AS pmid FROM rel, unnest(string_split(pmids, ';')) AS u(p) WHERE association = 'associated'),
sets AS (SELECT lo, hi, array_to_string(list_sort(list(pmid))[1:25], ';') AS pmids FROM ids GROUP BY lo, hi)
SELECT source, target, type, pmids FROM merged LEFT JOIN sets ON lo = least(source, target) AND hi = greatest(source, target)""")  # fmt: skip
def kg_pmid_attach(s: SparkSession, d: str) -> DataFrame:
    edges = B.fact_edges(facts(s, d)).select("source", "target", "type").distinct()  # of merged edges the keys alone are read
    out = B.attach_pmids(edges, B.pmid_sets(bound(s, d, RELATIONS)))
    return out.select("source", "target", "type", F.array_join("pmids", ";").alias("pmids"))


@query("kg_seed_view", f"WITH {EDGES_CTE}, b AS (SELECT source AS a, target AS b FROM merged UNION ALL SELECT target, source FROM merged) SELECT a AS node FROM b WHERE a IN ('gene:S1', 'gene:S2', 'gene:S3') UNION SELECT b FROM b WHERE a IN ('gene:S1', 'gene:S2', 'gene:S3')")
def kg_seed_view(s: SparkSession, d: str) -> DataFrame:
    return B.seed_nodes(merged(s, d), seeds(s).where("question_id <= 3").select("node"))


@query("kg_search_index", "SELECT 'drug_p' || p_partkey AS id, p_name AS label, 'drug' AS type, p_brand AS alt FROM part UNION ALL SELECT 'gene_s' || s_suppkey, s_name, 'gene', '' FROM supplier")
def kg_search_index(s: SparkSession, d: str) -> DataFrame:
    return B.search_index(bound(s, d, "SELECT 'drug_p' || CAST(p_partkey AS VARCHAR(20)) AS id, p_name AS label, 'drug' AS type, p_brand AS alt FROM {part} UNION ALL SELECT 'gene_s' || CAST(s_suppkey AS VARCHAR(20)), s_name, 'gene', '' FROM {supplier}"))


@query("alias_dimension", """WITH p AS (SELECT lower(trim(p_name)) AS name, 'P' || p_partkey AS target, 0 AS kind, -p_partkey AS o FROM part UNION ALL SELECT lower(trim(a)), 'P' || p_partkey, 1, p_partkey FROM part, unnest([p_brand, p_type, upper(p_name)]) AS u(a)),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind, o, target) AS r FROM p WHERE name <> '') SELECT name, target FROM r WHERE r = 1""")  # fmt: skip
def alias_dimension(s: SparkSession, d: str) -> DataFrame:
    return B.alias_dimension(bound(s, d, "SELECT p_name AS name, p_brand || ', ' || p_type || ',' || upper(p_name) AS aliases, 'P' || CAST(p_partkey AS VARCHAR(20)) AS target, p_partkey AS ord FROM {part}"))


KEY = ["variant", "gene", "role", "level", "chemical", "phenotype"]
HELD_CTE = f"{FACTS_CTE}, keyed AS (SELECT DISTINCT {' || chr(124) || '.join(KEY)} AS row_key FROM facts WHERE level IN ('1A', '1B', '2A', '2B')), ranked AS (SELECT row_key, row_number() OVER (ORDER BY md5('42|' || row_key), row_key) AS r FROM keyed), held AS (SELECT row_key FROM ranked WHERE r <= round_even((SELECT count(*) FROM keyed) * 0.30, 0))"


@query("heldout_split", f"WITH {HELD_CTE} SELECT row_key FROM held")
def heldout_split(s: SparkSession, d: str) -> DataFrame:
    return B.holdout(facts(s, d), KEY)


@query("heldout_exclude", f"WITH {HELD_CTE} SELECT level, count(*) AS n FROM facts WHERE {' || chr(124) || '.join(KEY)} NOT IN (SELECT row_key FROM held) GROUP BY level")
def heldout_exclude(s: SparkSession, d: str) -> DataFrame:
    f = facts(s, d)
    return B.exclude(f, B.holdout(f, KEY), KEY).groupBy("level").agg(F.count("*").alias("n"))


@query("evidence_hist", f"WITH {FACTS_CTE} SELECT CASE WHEN level = '4' THEN '(none)' ELSE level END AS level, count(*) AS n FROM facts GROUP BY ALL")
def evidence_hist(s: SparkSession, d: str) -> DataFrame:
    return facts(s, d).select(F.coalesce(F.nullif(F.when(F.col("level") == "4", "").otherwise(F.col("level")), F.lit("")), F.lit("(none)")).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


# graph operators


@query("g_degree", f"WITH {EDGES_CTE} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM merged UNION ALL SELECT target FROM merged) GROUP BY node")
def g_degree(s: SparkSession, d: str) -> DataFrame:
    return G.degrees(merged(s, d))


TOP_CTE = f"{EDGES_CTE}, deg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM merged UNION ALL SELECT target FROM merged) GROUP BY node), top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 300)"


@query("g_topn_filter", f"WITH {TOP_CTE} SELECT source, target, type, n FROM merged WHERE source IN (SELECT node FROM top) AND target IN (SELECT node FROM top)")
def g_topn_filter(s: SparkSession, d: str) -> DataFrame:
    return G.top_nodes(merged(s, d), 300)[1].select("source", "target", "type", "n")


@query("g_filter_levels", f"WITH {EDGES_CTE} SELECT source, target, level FROM merged WHERE type = 'affects_response_to' AND level IN ('1A', '2A')")
def g_filter_levels(s: SparkSession, d: str) -> DataFrame:
    return G.filter_edges(merged(s, d), ["affects_response_to"], ["1A", "2A"]).select("source", "target", "level")


@query("g_hidden", f"WITH {EDGES_CTE}, v AS (SELECT * FROM merged WHERE type = 'linked_to_risk') SELECT DISTINCT node FROM (SELECT source AS node FROM merged UNION SELECT target FROM merged) WHERE node NOT IN (SELECT source FROM v UNION SELECT target FROM v)")
def g_hidden(s: SparkSession, d: str) -> DataFrame:
    return G.hidden(merged(s, d), ["linked_to_risk"])


WALK = "h0 AS (SELECT question_id, node FROM seeds), h1 AS (SELECT DISTINCT question_id, dst AS node FROM h0 JOIN sym ON src = node EXCEPT SELECT * FROM h0), h2 AS (SELECT DISTINCT question_id, dst AS node FROM h1 JOIN sym ON src = node EXCEPT SELECT * FROM h1 EXCEPT SELECT * FROM h0)"


@query("g_neighbourhood_2", f"WITH {WHOLE_CTE}, {SEEDS_CTE}, {WALK} SELECT *, CAST(0 AS INTEGER) AS hop FROM h0 UNION ALL SELECT *, CAST(1 AS INTEGER) FROM h1 UNION ALL SELECT *, CAST(2 AS INTEGER) FROM h2")
def g_neighbourhood_2(s: SparkSession, d: str) -> DataFrame:
    return G.neighbourhood(whole(s, d), seeds(s), 2)


@query("g_induced_1", f"WITH {WHOLE_CTE}, {SEEDS_CTE}, {WALK}, k AS (SELECT * FROM h0 UNION SELECT * FROM h1) SELECT a.question_id, source, target FROM pairs_ JOIN k a ON a.node = source JOIN k b ON b.node = target AND b.question_id = a.question_id")
def g_induced_1(s: SparkSession, d: str) -> DataFrame:
    e = whole(s, d)
    return G.induced(e, G.neighbourhood(e, seeds(s), 1)).select("question_id", "source", "target")


PATHS_CTE = "roots AS (SELECT node AS root FROM seeds), r0 AS (SELECT root, root AS node, root AS path FROM roots)" + "".join(
    f", r{i} AS (SELECT root, dst AS node, min(path || '>' || dst) AS path FROM r{i - 1} JOIN sym ON src = node WHERE (root, dst) NOT IN ({' UNION ALL '.join(f'SELECT (root, node) FROM r{j}' for j in range(i))}) GROUP BY root, dst)" for i in range(1, 5)
) + ", found AS (" + " UNION ALL ".join(f"SELECT root, node, CAST({i} AS INTEGER) AS hops, path FROM r{i}" for i in range(1, 5)) + ")"


def pairs(s: SparkSession) -> DataFrame:
    return s.range(1, 6).select(F.concat(F.lit("gene:S"), F.col("id").cast("string")).alias("from_id"), F.explode(F.array(*[F.lit(f"gene:S{i}") for i in range(1, 31)])).alias("to_id"))


PAIRS = "SELECT root AS from_id, node AS to_id, hops, path FROM found WHERE node IN (SELECT 'gene:S' || i FROM range(1, 31) AS u(i))"


@query("g_shortest_paths", f"WITH {WHOLE_CTE}, {SEEDS_CTE}, {PATHS_CTE} {PAIRS}")
def g_shortest_paths(s: SparkSession, d: str) -> DataFrame:
    return G.shortest_paths(whole(s, d), pairs(s))


@query("g_critical_paths", f"""WITH {WHOLE_CTE}, {SEEDS_CTE}, {PATHS_CTE}, p AS ({PAIRS}), strong AS (SELECT 'drug:' || chemical AS a, 'gene:' || gene AS b, bool_or({CRITICAL} OR level IN ('1A', '1B')) AS c FROM facts GROUP BY ALL),
steps AS (SELECT from_id, to_id, hops, string_split(path, '>')[i] AS x, string_split(path, '>')[i + 1] AS y FROM p, unnest(range(1, hops + 1)) AS u(i)),
flags AS (SELECT from_id, to_id, hops, bool_or(c) AS critical FROM steps JOIN strong ON least(x, y) = a AND greatest(x, y) = b GROUP BY ALL)
SELECT from_id, to_id, hops, critical, CAST(row_number() OVER (PARTITION BY from_id ORDER BY critical DESC, hops, to_id) AS INTEGER) AS place FROM flags""")  # fmt: skip
def g_critical_paths(s: SparkSession, d: str) -> DataFrame:
    found = G.critical_paths(G.shortest_paths(whole(s, d), pairs(s)), B.fact_edges(facts(s, d)))
    place = F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("critical"), "hops", "to_id"))
    return found.select("from_id", "to_id", "hops", "critical", place.alias("place"))


@query("g_expand_clusters", f"WITH {MEMBERS_CTE} SELECT 'gene:' || gene AS source, 'variant:' || variant AS target, level FROM flat")
def g_expand_clusters(s: SparkSession, d: str) -> DataFrame:
    return G.expand_clusters(B.clusters(B.cluster_members(facts(s, d))))[1].select("source", "target", "level")


LINE = "regexp_replace(source, '^[a-z]+:', '') || ' --' || CASE type WHEN 'linked_to_risk' THEN 'is linked to risk of' ELSE 'affects response to' END || '[L' || level || ', ' || role || CASE WHEN critical THEN ', CRITICAL' ELSE '' END || ', ' || n || ' variants]--> ' || regexp_replace(target, '^[a-z]+:', '')"


@query("ctx_node", f"WITH {EDGES_CTE}, {SEEDS_CTE}, l AS (SELECT question_id, {LINE} AS line FROM merged JOIN seeds ON node IN (source, target)), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY line) AS r, count(*) OVER (PARTITION BY question_id) AS n_lines FROM l) SELECT question_id, string_agg(line, chr(10) ORDER BY line) AS context, max(n_lines) AS n_lines FROM r WHERE r <= 60 GROUP BY question_id")
def ctx_node(s: SparkSession, d: str) -> DataFrame:
    touched = B.merged_around(B.fact_edges(facts(s, d)), seeds(s), ["source", "target", "type"])
    return R.packet(R.edge_lines(touched).select("question_id", "line"))


@query("ctx_visible", f"WITH {EDGES_CTE}, nodes AS (SELECT DISTINCT split_part(node, ':', 1) AS type, node AS label FROM (SELECT source AS node FROM merged UNION SELECT target FROM merged)), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY label) AS r FROM nodes) SELECT type, count(*) AS n, string_agg(label, ', ' ORDER BY label) FILTER (WHERE r <= 12) AS sample FROM r GROUP BY type")
def ctx_visible(s: SparkSession, d: str) -> DataFrame:
    return R.histogram(G.degrees(merged(s, d)).select(F.split_part("node", F.lit(":"), F.lit(1)).alias("type"), F.col("node").alias("label")))


# linking and retrieval

QUESTIONS = "SELECT item_id AS question_id, text AS question FROM {benchmark}"
STOP = ", ".join(f"'{w}'" for w in sorted(set(STOPWORDS)))


@query("link_ngrams", f"""WITH t AS (SELECT item_id AS question_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP})) AS w FROM benchmark)
SELECT DISTINCT question_id, array_to_string(w[i:i + n - 1], ' ') AS term FROM t, unnest([1, 2, 3]) AS a(n), unnest(range(1, len(w) - n + 2)) AS b(i)""")  # fmt: skip
def link_ngrams(s: SparkSession, d: str) -> DataFrame:
    return R.question_ngrams(bound(s, d, QUESTIONS)).select("question_id", "term")


INDEX = "SELECT DISTINCT lower(split_part(text, ' ', 2)) AS id, lower(split_part(text, ' ', 2)) AS label FROM {documents} WHERE split_part(text, ' ', 2) <> ''"


#: Second words, and pieces of texts that can begin with a blank or a mark.
LABELS = INDEX + " UNION SELECT DISTINCT 'piece ' || lower(substr(text, 6, 5)) AS id, lower(substr(text, 6, 5)) AS label FROM {documents}"


@query("link_substring", f"WITH i AS ({plain(LABELS)}) SELECT item_id AS question_id, id, label FROM benchmark JOIN i ON length(label) >= 3 AND contains(lower(text), lower(label))")
def link_substring(s: SparkSession, d: str) -> DataFrame:
    return R.link_substring(bound(s, d, QUESTIONS), bound(s, d, LABELS))


BM25_CTE = r"""qt AS (SELECT question_id, term, count(*) AS times FROM (SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL),
dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM dt),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
BM25_TAIL = "sc AS (SELECT question_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT a FROM st)))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) GROUP BY ALL), bm AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"
RATIO = "((SELECT n FROM st) - df + 0.5) / (df + 0.5)"
OKAPI = f"raw AS (SELECT term, ln({RATIO}) AS raw FROM df), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"


@query("rag_bm25", f"WITH {BM25_CTE}, idf AS (SELECT term, ln(1 + {RATIO}) AS idf FROM df), {BM25_TAIL} SELECT question_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 20")
def rag_bm25(s: SparkSession, d: str) -> DataFrame:
    docs = bound(s, d, "SELECT doc_id, text FROM {documents}")
    return R.bm25(docs, bound(s, d, QUESTIONS), okapi=False).select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("rag_bm25_okapi", f"WITH {BM25_CTE}, {OKAPI}, {BM25_TAIL} SELECT question_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 20")
def rag_bm25_okapi(s: SparkSession, d: str) -> DataFrame:
    docs = bound(s, d, "SELECT doc_id, text FROM {documents}")
    return R.bm25(docs, bound(s, d, QUESTIONS)).select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


DENSE_CTE = "ds AS (SELECT b.item_id AS question_id, v.vec_id AS doc_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v), de AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ds)"


def dense(s: SparkSession, d: str) -> DataFrame:
    queries = bound(s, d, "SELECT b.item_id AS question_id, e.embedding AS q FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id")
    return R.dense(bound(s, d, "SELECT vec_id AS doc_id, embedding AS v FROM {embeddings}"), queries)


@query("rag_dense", f"WITH {DENSE_CTE} SELECT question_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM de WHERE rank <= 20")
def rag_dense(s: SparkSession, d: str) -> DataFrame:
    return dense(s, d).select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("rag_rrf", f"WITH {BM25_CTE}, idf AS (SELECT term, ln(1 + {RATIO}) AS idf FROM df), {BM25_TAIL}, {DENSE_CTE}, u AS (SELECT question_id, doc_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT question_id, doc_id, rank FROM de WHERE rank <= 20), f AS (SELECT question_id, doc_id, sum(1.0 / (59 + rank)) AS score FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) SELECT question_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def rag_rrf(s: SparkSession, d: str) -> DataFrame:
    docs = bound(s, d, "SELECT doc_id, text FROM {documents}")
    fused = R.fuse([R.bm25(docs, bound(s, d, QUESTIONS), okapi=False), dense(s, d)])
    return fused.select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# question sets, grading, judging


@query("dedupe_latest_success", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, CASE WHEN event_type = 'error' THEN epoch_us(ts) ELSE -epoch_us(ts) END, CASE WHEN event_type = 'error' THEN event_id ELSE -event_id END) AS r FROM events) SELECT user_id, event_id, event_type FROM r WHERE r = 1")
def dedupe_latest_success(s: SparkSession, d: str) -> DataFrame:
    log = bound(s, d, "SELECT * FROM {events}")
    return E.latest_success(log, ["user_id"], F.col("event_type") == "error", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("resume_remaining", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0 AND user_id IS NOT NULL)")
def resume_remaining(s: SparkSession, d: str) -> DataFrame:
    log = bound(s, d, "SELECT user_id, event_id FROM {events}")
    return E.remaining(log.select("user_id").distinct(), log, ["user_id"], F.col("event_id") % 97 != 0)


@query("judge_swap", "SELECT event_id, substr(md5('11|' || event_id || '|' || event_type), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') AS swapped FROM events")
def judge_swap(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, "SELECT event_id, event_type FROM {events}").select("event_id", E.swap(11, F.col("event_id"), F.col("event_type")).alias("swapped"))


VERDICTS = "SELECT event_id, event_type, user_id, CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN ' b because' WHEN 2 THEN 'ANSWER B' WHEN 3 THEN 'Tie' ELSE 'unclear' END AS text FROM {events}"


RUBRIC = "SELECT event_id, event_type AS arm, CASE WHEN event_id % 7 = 0 THEN 'none' ELSE 'F=' || CAST(1 + event_id % 5 AS VARCHAR(9)) || ' C=' || CAST(1 + event_id % 3 AS VARCHAR(9)) || ' CS=' || CAST(1 + event_id % 4 AS VARCHAR(9)) END AS text FROM {events}"


@query("rubric_parse", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN CAST(1 + event_id % 5 AS INTEGER) END AS f, CASE WHEN event_id % 7 > 0 THEN CAST(1 + event_id % 3 AS INTEGER) END AS c, CASE WHEN event_id % 7 > 0 THEN CAST(1 + event_id % 4 AS INTEGER) END AS cs FROM events")
def rubric_parse(s: SparkSession, d: str) -> DataFrame:
    f, c, cs = E.parse_rubric(F.col("text"))
    return bound(s, d, RUBRIC).select("event_id", f.alias("f"), c.alias("c"), cs.alias("cs"))


@query("rubric_summary", "SELECT event_type AS arm, count(f) AS n, round(avg(f), 6) AS mean, round(1.96 * coalesce(stddev_samp(f), 0) / sqrt(count(f)), 6) AS half FROM (SELECT event_type, CASE WHEN event_id % 7 > 0 THEN 1 + event_id % 5 END AS f FROM events) GROUP BY ALL")
def rubric_summary(s: SparkSession, d: str) -> DataFrame:
    rows = bound(s, d, RUBRIC).select("arm", E.parse_rubric(F.col("text"))[0].alias("f"))
    return E.mean_interval(rows, ["arm"], "f").select("arm", "n", F.round("mean", 6).alias("mean"), F.round("half", 6).alias("half"))


def _pair_sql(keys: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""WITH j AS (SELECT event_type AS stratum, CASE WHEN user_id % 2 = 0 THEN 'x' ELSE 'y' END AS pair, CASE event_id % 5 WHEN 0 THEN 'A3' WHEN 1 THEN 'A1' WHEN 2 THEN 'A3' ELSE 'TIE' END AS winner FROM events),
s AS (SELECT {lead}count(*) AS n, count(*) FILTER (WHERE winner = 'A3') AS wins, count(*) FILTER (WHERE winner = 'A1') AS losses, count(*) FILTER (WHERE winner = 'TIE') AS ties FROM j WHERE winner IS NOT NULL {group}),
p AS (SELECT *, wins + losses AS m, wins / (wins + losses) AS rate FROM s),
t AS (SELECT *, least(1, 2 * (SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))) FROM unnest(range(0, least(wins, losses) + 1)) AS u(i))) AS p FROM p)
SELECT {lead}n, wins, losses, ties, round(rate, 6) AS rate, round(greatest(0, (rate + 1.96 * 1.96 / (2 * m)) / (1 + 1.96 * 1.96 / m) - 1.96 * sqrt(rate * (1 - rate) / m + 1.96 * 1.96 / (4 * m * m)) / (1 + 1.96 * 1.96 / m)), 6) AS lo,
  round(least(1, (rate + 1.96 * 1.96 / (2 * m)) / (1 + 1.96 * 1.96 / m) + 1.96 * sqrt(rate * (1 - rate) / m + 1.96 * 1.96 / (4 * m * m)) / (1 + 1.96 * 1.96 / m)), 6) AS hi, round(p, 6) AS p,
  CASE WHEN p >= 0.05 THEN 'no difference' WHEN rate > 0.5 THEN 'better' ELSE 'worse' END AS verdict FROM t"""


def _judgments(s: SparkSession, d: str) -> DataFrame:
    v = bound(s, d, VERDICTS).select(F.col("event_type").alias("stratum"), F.when(F.col("user_id") % 2 == 0, "x").otherwise("y").alias("pair"), E.parse_verdict(F.col("text")).alias("pick"))
    return v.withColumn("winner", E.unblind(F.col("pick"), F.lit("A3"), F.lit("A1")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("rate", "lo", "hi", "p")})


@query("pairwise_summary", _pair_sql("pair"))
def pairwise_summary(s: SparkSession, d: str) -> DataFrame:
    return _rounded(E.pairwise(_judgments(s, d), ["pair"], "A3"))


@query("pairwise_stratum", _pair_sql("stratum, pair"))
def pairwise_stratum(s: SparkSession, d: str) -> DataFrame:
    return _rounded(E.pairwise(_judgments(s, d), ["stratum", "pair"], "A3"))


@query("arm_headline", "SELECT event_type AS arm, count(*) AS n, count(*) FILTER (WHERE value IS NULL OR value < 5) AS n_errors, round(avg(value), 6) AS mean_value, round(avg(length(props)), 6) AS mean_chars FROM events GROUP BY ALL")
def arm_headline(s: SparkSession, d: str) -> DataFrame:
    rows = bound(s, d, "SELECT event_type AS arm, value, length(props) AS chars FROM {events}")
    out = E.headline(rows, ["value", "chars"], F.col("value").isNull() | (F.col("value") < 5))
    return out.select("arm", "n", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.round("mean_value", 6).alias("mean_value"), F.round("mean_chars", 6).alias("mean_chars"))


@query("stratum_grid", "WITH g AS (SELECT s, a FROM unnest(['0', '1', '2', '9']) AS x(s), unnest(['view', 'click', 'none']) AS y(a)), v AS (SELECT CAST(user_id % 3 AS VARCHAR) AS s, event_type AS a, count(*) AS n, avg(value) AS m FROM events GROUP BY ALL) SELECT g.s AS stratum, g.a AS arm, coalesce(n, 0) AS n, round(m, 6) AS mean FROM g LEFT JOIN v ON v.s = g.s AND v.a = g.a")
def stratum_grid(s: SparkSession, d: str) -> DataFrame:
    scores = bound(s, d, "SELECT CAST(user_id % 3 AS VARCHAR(9)) AS stratum, event_type AS arm, value FROM {events}")
    strata, arms = s.createDataFrame([(x,) for x in ("0", "1", "2", "9")], "stratum string"), s.createDataFrame([(x,) for x in ("view", "click", "none")], "arm string")
    return E.grid(scores, strata, arms, "value").withColumn("mean", F.round("mean", 6))


@query("arms_complete", "SELECT user_id, count(DISTINCT event_type) AS members FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 5")
def arms_complete(s: SparkSession, d: str) -> DataFrame:
    return E.complete(bound(s, d, "SELECT user_id, event_type FROM {events}"), "user_id", "event_type", 5)


@query("context_size", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(floor(length(text) / 3.7 + 0.5) AS BIGINT) AS tokens FROM documents")
def context_size(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM {documents}").withColumn("tokens", C.estimate_tokens(F.col("chars")))


@query("rate_limiter", "WITH w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, epoch_us(ts)) + row_number() OVER (PARTITION BY user_id, epoch_us(ts) ORDER BY event_id) AS n_window FROM events) SELECT event_id, CAST(n_window AS BIGINT) AS n_window, n_window > 2 AS rejected FROM w")
def rate_limiter(s: SparkSession, d: str) -> DataFrame:
    return limit_batch(bound(s, d, "SELECT event_id, user_id, ts FROM {events}"), "user_id", "ts", 36_000, 2, "event_id").select("event_id", "n_window", "rejected")
