"""The corpus pipeline: five stages over documents, each written as Parquet and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm import decontaminate, mixing, ngram_join, quality, secrets
from kgweave.llm.base import cut, drop_cut, quoted, table

#: Near duplicates: words of a shingle and percent of similarity.
SHINGLE_WORDS, SIMILARITY = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, trained on the documents that ``labels`` trusts.

    Null and empty texts have no perplexity and go; a null language takes the limits of all; repeated rows stay or go
    together; with no trusted text every text stays; an empty table gives an empty one.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of smallest doc_id, a null doc_id last.

    Rows are judged by content, so rows that share a doc_id but not a text are separate documents; of rows alike in
    both one stays. Texts without words are nobody's duplicate and stay.
    """
    return ngram_join.survivors(docs, SHINGLE_WORDS, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands, neither word by word nor as a proximity match.

    Null and empty texts, and all documents where the benchmark is empty, stay; repeated rows stay or go together.
    """
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, one for one, with live-looking secrets replaced in their texts and n_chars counted anew.

    Null and empty texts pass as they are (n_chars of a null text is null); repeated rows get the same text.
    """
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(quoted(c)) for c in docs.columns]) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents repeated by their source's rate, in global random order, with ``_copy`` and ``_copies``.

    A null source is one of its own; null and empty texts are repeated like others of their source, unless it has no
    text at all; rows of one doc_id are repeated equally often; an empty table gives an empty one.
    """
    return mixing.poisson_mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: The first two stages cannot be expressed in SQL (a trained model; components over verified links).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and deleted when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_cut(before)
        before = docs
    return docs
