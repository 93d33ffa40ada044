"""The driver's tables in the engine's shapes. The same text runs in Spark and, with plain names, in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "lineitem", "orders", "customer", "nation", "part", "supplier", "events", "documents", "benchmark", "embeddings", "conversations", "labels")

ORD = "lpad(CAST({0}.l_orderkey AS VARCHAR(20)), 12, '0') || lpad(CAST({0}.l_linenumber AS VARCHAR(20)), 3, '0') || lpad(CAST({0}.l_partkey AS VARCHAR(20)), 12, '0') || lpad(CAST({0}.l_suppkey AS VARCHAR(20)), 12, '0')".format("l")

FACTS = f"""SELECT 'rs' || CAST(l.l_orderkey AS VARCHAR(20)) AS variant, 'S' || CAST(l.l_suppkey AS VARCHAR(20)) AS gene, 'P' || CAST(l.l_partkey AS VARCHAR(20)) AS chemical, n.n_name AS phenotype,
  CASE l.l_returnflag WHEN 'R' THEN 'Toxicity' WHEN 'A' THEN 'Efficacy' ELSE 'Dosage' END AS role,
  CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN '1A' WHEN '2' THEN '1B' WHEN '3' THEN CASE l.l_linestatus WHEN 'F' THEN '2A' ELSE '2B' END WHEN '4' THEN '3' ELSE '4' END AS level,
  {ORD} AS ord, l.l_quantity AS quantity, l.l_suppkey AS suppkey
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey"""

RELATIONS = """SELECT 'drug:P' || CAST(l_partkey AS VARCHAR(20)) AS entity1, 'gene:S' || CAST(l_suppkey AS VARCHAR(20)) AS entity2,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'not associated' WHEN l_returnflag = 'N' THEN 'ambiguous' ELSE 'associated' END AS association,
  CAST(l_orderkey AS VARCHAR(20)) || ';' || CAST(l_orderkey + l_linenumber AS VARCHAR(20)) AS pmids FROM {lineitem}"""

LEVEL = "CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN '1A' WHEN '2' THEN '1B' WHEN '3' THEN CASE l.l_linestatus WHEN 'F' THEN '2A' ELSE '2B' END WHEN '4' THEN '3' ELSE '4' END"

#: Facts as raw cells: lists of variants, genes, chemicals and phenotypes, quotes, lower case and empty cells among them.
RAW_FACTS = f"""SELECT 'rs' || CAST(l.l_orderkey AS VARCHAR(20)) || CASE WHEN l.l_linenumber = 2 THEN ', rs' || CAST(l.l_orderkey + 1 AS VARCHAR(20)) ELSE '' END AS variant,
  'S' || CAST(l.l_suppkey AS VARCHAR(20)) || CASE WHEN l.l_linenumber = 3 THEN '; s' || CAST(1 + l.l_suppkey % 7 AS VARCHAR(20)) ELSE '' END AS gene,
  CASE l.l_returnflag WHEN 'R' THEN 'Toxicity' WHEN 'A' THEN 'Efficacy' ELSE 'Dosage' END AS type, {LEVEL} AS level,
  CASE WHEN l.l_linenumber = 4 THEN '"P' || CAST(l.l_partkey AS VARCHAR(20)) || ', P' || CAST(1 + l.l_partkey % 50 AS VARCHAR(20)) || '"' ELSE 'P' || CAST(l.l_partkey AS VARCHAR(20)) END AS chemicals,
  CASE WHEN l.l_linenumber = 5 THEN '' WHEN l.l_linenumber = 6 THEN n.n_name || ', PH ' || CAST(l.l_orderkey % 5 AS VARCHAR(20)) ELSE n.n_name END AS phenotypes, {ORD} AS ord
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey"""

#: Relations as raw cells: either order of the two entities, types that are no node, three associations.
RAW_RELATIONS = f"""SELECT CASE WHEN l.l_orderkey % 2 = 0 THEN 'P' || CAST(l.l_partkey AS VARCHAR(20)) ELSE 's' || CAST(l.l_suppkey AS VARCHAR(20)) END AS entity1, CASE WHEN l.l_orderkey % 2 = 0 THEN 'Chemical' ELSE 'Gene' END AS type1,
  CASE WHEN l.l_orderkey % 2 = 0 THEN 's' || CAST(l.l_suppkey AS VARCHAR(20)) ELSE 'P' || CAST(l.l_partkey AS VARCHAR(20)) END AS entity2,
  CASE WHEN l.l_linenumber = 7 THEN 'Variant' WHEN l.l_orderkey % 2 = 0 THEN 'Gene' ELSE 'Chemical' END AS type2,
  CASE WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'O' THEN 'not associated' WHEN l.l_returnflag = 'N' THEN 'Ambiguous' ELSE ' Associated' END AS association,
  CAST(l.l_orderkey AS VARCHAR(20)) || '; ' || CAST(l.l_orderkey + l.l_linenumber AS VARCHAR(20)) || CASE WHEN l.l_linenumber = 3 THEN ',' || CAST(l.l_orderkey + 9 AS VARCHAR(20)) ELSE '' END AS pmids, {ORD} AS ord FROM {{lineitem}} l"""

#: Reference tables; every fifth gene has a symbol of no fact, so that facts without attributes occur.
RAW_GENES = """SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'X' WHEN s_suppkey % 2 = 0 THEN 'S' ELSE ' s' END || CAST(s_suppkey AS VARCHAR(20)) AS Symbol, s_name AS full_name, 'PA' || CAST(s_suppkey AS VARCHAR(20)) AS accession,
  'chr' || CAST(s_nationkey AS VARCHAR(20)) AS chromosome, CASE WHEN s_acctbal > 5000 THEN ' Yes' ELSE 'no' END AS vip, s_suppkey AS ord FROM {supplier}"""
RAW_DRUGS = """SELECT 'P' || CAST(p_partkey AS VARCHAR(20)) AS label, '"' || p_name || ', p' || CAST(p_partkey + 1 AS VARCHAR(20)) || '"' AS aliases, 'PAD' || CAST(p_partkey AS VARCHAR(20)) AS accession, p_type AS atc,
  CASE WHEN p_size > 25 THEN '1A' ELSE '' END AS top_level, p_partkey AS ord FROM {part}"""
RAW_PHENOTYPES = "SELECT n_name AS label, 'PAN' || CAST(n_nationkey AS VARCHAR(20)) AS accession, r_name AS xref, n_nationkey AS ord FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"
CLASSES = "SELECT p_brand AS class, 'p' || CAST(p_partkey AS VARCHAR(20)) AS member FROM {part}"


def bound(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES if "{" + n + "}" in text}
    return spark.sql(text, **used)


def plain(text: str) -> str:
    return text.format(**{n: n for n in NAMES})
