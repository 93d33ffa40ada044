"""Readers and writers with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.sources.versioned import Pinned, Versions

NODES = "id string, label string, type string, fullName string, pharmgkb_id string, chromosome string, is_vip boolean, atc string, top_level string, gene string, level string, xref string, description string, members array<struct<rsid string, level string, role string, chemical string>>"
EDGES = "id string, source string, target string, type string, level string, role string, critical boolean, count bigint, gene string, pmids array<string>"
ANSWERS = "arm string, question_id string, answer string, duration_ms bigint, cost_usd double, error string, context_chars bigint"
JUDGMENTS = "question_id string, pair string, a_arm string, b_arm string, pick string, target_pick string, reason string, duration_ms bigint, cost_usd double, error string"
SEGMENTS = "question_id string, label_to_arm map<string,string>, claims array<struct<id string, text string, made_by array<string>, supported string>>, duration_ms bigint, cost_usd double, error string"


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings, by header position; cells of any length; null cells empty."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(sep="\t", header=True, quote='"', maxCharsPerColumn=-1, enforceSchema=True).csv(path).fillna("")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep="\t", header=True).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_key of a file with one key a line; empty lines are passed over."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("row_key")).distinct()


MALFORMED = "_malformed"


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Records of a table (or stream) of JSON lines in column ``value``, with MALFORMED: the line where it is no object of
    the schema, else null. Blank lines are passed over."""
    fields = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(MALFORMED, T.StringType())])
    record = F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED})
    held = lines.where(F.trim("value") != "").select("value", record.alias("r"))
    # a line that is JSON but no object has no corrupt part
    bad = F.when(F.col("r").isNull() | ~F.rlike(F.col("value"), F.lit(r"^\s*\{")), F.col("value")).otherwise(F.col("r")[MALFORMED])
    return held.select(*[F.col("r")[f.name].alias(f.name) for f in fields.fields[:-1]], bad.alias(MALFORMED))


def read_jsonl(spark: SparkSession, path: str, schema: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines, and the malformed lines (column ``line``), which a plain reader would take for empty records."""
    found = parsed((spark.readStream if stream else spark.read).text(path), schema)
    return found.where(F.col(MALFORMED).isNull()).drop(MALFORMED), found.where(F.col(MALFORMED).isNotNull()).select(F.col(MALFORMED).alias("line"))


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append once; a log that streams append to, and that survives a lost driver, is in kgweave.streaming.log."""
    df.write.mode("append").json(path)


def write_lines(df: DataFrame, path: str, column: str = "row_key") -> None:
    """One value a line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_holdout(facts: DataFrame, keys: DataFrame, key_columns: list[str], path: str) -> None:
    """The held-out rows as a table and their keys as lines."""
    from kgweave.operators.graph_build import held_facts

    write_tsv(held_facts(facts, keys, key_columns).select(*key_columns), f"{path}/heldout_variants")
    write_lines(keys, f"{path}/heldout_variant_hashes")


ARTEFACTS = ("nodes", "edges", "seed_nodes", "seed_edges", "search_index")


def write_graph(path: str, suffix: str = "", **tables: DataFrame) -> int:
    """Publish the artefacts of a graph build (ARTEFACTS) as one version of the set at ``path``; the suffix keeps a reduced
    build beside the full one. Returns the version."""
    held = {f"{name}{suffix}": tables[name] for name in ARTEFACTS if name in tables}
    return Versions(next(iter(held.values())).sparkSession, path).publish(held)


def read_graph(spark: SparkSession, path: str, suffix: str = "", seed: bool = False, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a written graph, or of its seed view: both of one version, the newest by default."""
    store, head = Versions(spark, path), "seed_" if seed else ""
    version = store.latest() if version is None else version
    return store.read(f"{head}nodes{suffix}", version), store.read(f"{head}edges{suffix}", version)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a graph kept as one JSON document, ``{"nodes": [...], "edges": [...]}``."""
    fields = [T.StructField(n, T.ArrayType(T._parse_datatype_string(d))) for n, d in (("nodes", NODES), ("edges", EDGES))]
    whole = spark.read.schema(T.StructType(fields)).option("multiLine", True).json(path)
    return whole.selectExpr("inline(nodes)"), whole.selectExpr("inline(edges)")


_GRAPHS: dict[tuple[str, str], Pinned] = {}


def cached_graph(spark: SparkSession, path: str, suffix: str = "") -> tuple[DataFrame, DataFrame]:
    """read_graph, kept in memory by the session until a newer version is published; the older one is then let go."""
    held = _GRAPHS.setdefault((spark.sparkContext.applicationId, path), Pinned(Versions(spark, path)))
    held.refresh()
    return held.table(f"nodes{suffix}"), held.table(f"edges{suffix}")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes when one of the files or folders does: their sizes and times of change."""
    out = []
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            out.append(f"{p}:{fs.getContentSummary(at).getLength()}:{fs.getFileStatus(at).getModificationTime()}")
    return "|".join(out)


_INDEXES: dict[str, DataFrame] = {}


def set_search_index(spark: SparkSession, index: DataFrame) -> None:
    """The session's search index, also the view ``search_index``."""
    _INDEXES[spark.sparkContext.applicationId] = index
    index.createOrReplaceTempView("search_index")


def has_search_index(spark: SparkSession) -> bool:
    return spark.sparkContext.applicationId in _INDEXES


def get_search_index(spark: SparkSession) -> DataFrame:
    if not has_search_index(spark):
        raise LookupError("no search index has been set in this session")
    return _INDEXES[spark.sparkContext.applicationId]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written only where it is not there as a whole (its _SUCCESS mark)."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def corpus_pmids(relations: DataFrame, cell: str = "pmids") -> DataFrame:
    """pmid: distinct digit tokens of the cells, split at comma or semicolon."""
    return relations.select(F.explode(F.transform(F.split(cell, "[,;]"), lambda x: F.trim(x))).alias("pmid")).where(F.col("pmid").rlike("^[0-9]+$")).distinct()
