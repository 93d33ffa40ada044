"""Mixing sources to target weights: Poisson replication and a global shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.base import cut, quoted, row_of, small, table, unpacked

SEED = 11
#: Largest mean of one draw; a larger rate is the sum of several draws.
DRAW = 400


def unit_hash(*parts: Column) -> Column:
    """[0, 1) from 52 bits of md5 of the parts joined by ``|`` (null: empty)."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, source: str = "source", text: str = "text", power: float = 0.5, total: float | None = None) -> DataFrame:
    """_src, size (code points of text), rate: how often a document of the source is wanted on average.

    weights: target shares by source (others get 0); None: shares proportional to size ** power. total: size of the
    mixture in code points, by default that of the input. A null source is a source of its own. Without documents there
    is no row.
    """
    sizes = docs.select(F.col(quoted(source)).alias("_src"), F.length(F.col(quoted(text))).alias("n")).groupBy("_src").agg(F.sum(F.coalesce("n", F.lit(0))).cast("double").alias("size"))
    if weights is None:
        wanted = sizes.withColumn("w", F.when(F.col("size") > 0, F.pow("size", F.lit(power))).otherwise(0.0))
    else:
        rows = [(k, float(v)) for k, v in weights.items()]
        named = docs.sparkSession.createDataFrame(rows, "_name string, w double")
        wanted = sizes.join(small(named, len(rows), 100_000), F.col("_src") == F.col("_name"), "left").drop("_name").fillna(0.0, ["w"])
    wanted = cut(wanted, "sizes")  # a row a source; texts are read once for it
    sums = wanted.agg(F.sum("w").alias("all_w"), F.sum("size").alias("all_size")).first()
    all_w, all_size = sums["all_w"] or 1.0, sums["all_size"] or 0.0
    return wanted.withColumn("rate", F.when(F.col("size") > 0, F.col("w") / all_w * float(all_size if total is None else total) / F.col("size")).otherwise(0.0)).select("_src", "size", "rate")


def with_cdf(rates: DataFrame) -> DataFrame:
    """rates with draws and cdf: P(N <= 0), P(N <= 1), ... of one draw, until the tail is below double precision."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW).cast("int"))
    mean = F.col("rate") / F.col("draws")
    last = F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 20).cast("int")
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.col("last")),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c")),
        lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * F.col("mean") / k)).alias("c")),
        lambda a: a["c"],
    )
    return rates.withColumn("draws", draws).withColumn("mean", mean).withColumn("last", last).withColumn("cdf", cdf)


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, source: str = "source", text: str = "text", doc_id: str = "doc_id", power: float = 0.5, total: float | None = None) -> DataFrame:
    """``docs`` with each row repeated by a Poisson number whose mean is its source's rate, plus ``_copy`` (from 1) and ``_copies``, in a global random order.

    The number inverts the Poisson distribution at a hash of seed and doc_id (of the text where doc_id is null), so it
    is the same on every run and after every retry; rows with one doc_id get one number. The order is that of a hash of
    seed, doc_id, copy and text over all rows, whatever the number of partitions. Documents of a source of rate 0 (no
    weight, or no text) do not occur; a null or empty text in another source is repeated like any row. An empty table
    gives an empty one. Columns of ``docs`` keep their names; only ``_copy`` and ``_copies`` are replaced.
    """
    rates = cut(with_cdf(source_rates(docs, weights, source, text, power, total)), "rates")
    rates = small(rates, rates.count(), 100_000)
    own = ("_copy", "_copies")
    name = F.coalesce(F.col(quoted(doc_id)).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(quoted(text)), F.lit("")))))
    packed = docs.select(row_of(docs, *own).alias("_row"), F.col(quoted(source)).alias("_from"), name.alias("_name"), F.xxhash64(quoted(text)).alias("_content"))
    drawn = packed.join(rates, F.col("_from").eqNullSafe(F.col("_src")), "inner")
    one = lambda j: F.size(F.filter("cdf", lambda c: c <= unit_hash(F.lit(seed), F.col("_name"), j)))
    several = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda a, j: a + one(j))
    single = F.size(F.filter("cdf", lambda c: c <= F.col("_u")))
    drawn = drawn.withColumn("_u", unit_hash(F.lit(seed), F.col("_name"), F.lit(1)))
    counted = drawn.withColumn("_copies", F.when(F.col("draws") == 1, single).otherwise(several)).where(F.col("_copies") > 0)
    copies = counted.select("_row", "_copies", "_name", "_content", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    keyed = copies.select(F.xxhash64(F.lit(seed), "_name", "_copy", "_content").alias("_order"), "_row", "_copy", "_copies")
    # the hash is uniform, so partitions are equal ranges of it: no sample of the rows is needed to order them all
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionById(n, (F.shiftrightunsigned(F.col("_order"), 33).bitwiseXOR(F.lit(1 << 30)) * n / F.lit(1 << 31)).cast("int")).sortWithinPartitions("_order")
    return ranged.select(*unpacked(docs, "_row", *own), "_copies", "_copy")


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents in global random order, sources at the square root of their sizes; a null source is one of its own,
    null and empty texts are repeated like others of their source, repeated rows alike; otherwise as in poisson_mix."""
    mixed = poisson_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("_copy").cast("long").alias("copy"), F.col("_copies").cast("long").alias("copies"), "text")


OP7_SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0 END AS w FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN w / (SELECT sum(w) FROM w) * (SELECT sum(size) FROM w) / size ELSE 0 END AS rate FROM w),
terms AS (SELECT source, k, exp(-rate + k * ln(greatest(rate, 1e-300)) - lgamma(k + 1)) AS p FROM rates, unnest(range(0, 200)) AS u(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT d.doc_id, d.source, d.text, ('0x' || substr(md5('{SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), 't' || md5(coalesce(d.text, ''))) || '|1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT doc_id, d.source, text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS copies FROM drawn d)
SELECT doc_id, source, CAST(i AS BIGINT) AS copy, CAST(copies AS BIGINT) AS copies, text FROM counted, unnest(range(1, copies + 1)) AS u(i)"""
