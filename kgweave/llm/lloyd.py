"""Centroid clustering: Lloyd's rounds over whole numbers, kept as persisted assignments and global sums that only change by deltas."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.base import lean, new_folder, quoted, shared_dir, small, table

#: Clusters, rounds, components of a vector and the scale of whole numbers in the query.
CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: Vectors of one bucket of the persisted tables.
BUCKET_ROWS = 500_000
#: Scaled components saturate here, so that a squared distance over up to 2 ** 7 components fits in 64 bits.
MOST = 1 << 27


class Persisted:
    """A table in the shared folder, bucketed by ``row``: tables of as many buckets are joined on it without a shuffle."""

    def __init__(self, df: DataFrame, buckets: int, what: str):
        self.spark = df.sparkSession
        self.name, self.path = f"lloyd_{what}_{uuid.uuid4().hex}", new_folder(self.spark, f"lloyd-{what}") + "/t"
        df.write.format("parquet").bucketBy(buckets, "row").option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, dim: int, scale: int) -> DataFrame:
    """vec_id, v: of vectors with exactly ``dim`` components, none null or not finite, each component floor(scale * x)."""
    x = F.col(quoted(embedding))
    fits = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    number = lambda c: F.least(F.greatest(F.floor(c.cast("double") * F.lit(float(scale)) + F.lit(0.0)), F.lit(-MOST)), F.lit(MOST)).cast("int")
    return vectors.where(F.coalesce(fits, F.lit(False))).select(F.col(quoted(vec_id)).alias("vec_id"), F.transform(x, number).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The k vectors of smallest hash of seed and vec_id, ties by components: k rows at most reach the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), dim)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def assign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """New owners and squared distances; ``owner`` -1: none yet.

    A vector whose owner's centroid stands where it stood needs the changed centroids only, for nothing else came
    nearer; one whose owner's centroid moved is compared with all.
    """
    stale = (owner < 0) | np.isin(owner, changed)
    best, at = np.where(stale, np.iinfo(np.int64).max, distance), np.where(stale, len(centroids), owner)
    for k, c in enumerate(centroids):
        own = np.arange(len(v)) if k in changed else np.flatnonzero(stale)
        if len(own):
            d = squared(v[own], c)
            better = (d < best[own]) | ((d == best[own]) & (k < at[own]))
            best[own[better]], at[own[better]] = d[better], k
    return at.astype(np.int32), best


def transfers(v: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """Of each cluster that vectors of a batch left or joined: signed count and signed sums."""
    moved = np.flatnonzero(before != after)
    out = []
    for k in np.unique(np.concatenate((before[moved], after[moved]))).tolist():
        if k >= 0:
            came, went = moved[after[moved] == k], moved[before[moved] == k]
            out.append({"cluster": k, "n": len(came) - len(went), "sums": (v[came].sum(axis=0) - v[went].sum(axis=0)).tolist()})
    return out


ASSIGNED = "row long, owner int, distance long, transfers array<struct<cluster:int,n:long,sums:array<long>>>"


def assigned(vectors: DataFrame, before: DataFrame | None, centroids: np.ndarray, changed: list[int]) -> DataFrame:
    """ASSIGNED of all vectors, the last row of each batch with the batch's transfers. ``before``: the assignments so far."""
    dim = centroids.shape[1]
    if before is None:
        held = vectors.select("row", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    else:  # both sides are bucketed by row; the assignments, a few bytes a vector, are the side that is hashed
        held = vectors.join(before.select("row", "owner", "distance").hint("shuffle_hash"), "row").select("row", "v", "owner", "distance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
                old = b.column(2).to_numpy()
                owner, distance = assign(v, old, b.column(3).to_numpy(), centroids, changed)
                sent = pa.array([None] * (b.num_rows - 1) + [transfers(v, old, owner)], kind)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(owner), pa.array(distance), sent], ["row", "owner", "distance", "transfers"])

    return held.mapInArrow(lean(run), ASSIGNED)


def moved_sums(assignments: DataFrame) -> list[tuple[int, int, int, int]]:
    """(cluster, component, signed sum, signed count) over all transfers: clusters times components rows."""
    each = assignments.where("transfers IS NOT NULL").select(F.explode("transfers").alias("t")).select("t.cluster", "t.n", F.posexplode("t.sums").alias("i", "s"))
    return [tuple(r) for r in each.groupBy("cluster", "i").agg(F.sum("s"), F.sum("n")).collect()]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of every kept vector, and the final centroids.

    A kept vector has ``dim`` components (128 at most), none null or not finite; each becomes floor(scale * component),
    saturating at 2 ** 27 either way. Repeated rows are vectors of their own; a null vec_id hashes like an empty one; of
    rows alike in hash the smaller components come first. With fewer vectors than ``k`` there are as many centroids as
    vectors, with none no rows. Ties go to the smaller cluster, an empty cluster keeps its centroid, and rounds end
    early once no centroid moves, as nothing changes after that. Other columns play no part.

    The vectors are written once, bucketed by a row number; each round's owners and distances likewise, so that their
    join needs no shuffle. What travels between executors is each batch's signed sums of the vectors that changed
    owner; the driver holds clusters times components whole numbers. A lost executor's tasks read the tables again.
    """
    spark = vectors.sparkSession
    if not 0 < dim <= 128:
        raise ValueError("between 1 and 128 components")
    shared_dir(spark)
    kept = whole_numbers(vectors, vec_id, embedding, dim, scale)
    n = kept.count()
    buckets = max(1, math.ceil(n / BUCKET_ROWS), min(spark.sparkContext.defaultParallelism, n // 2_000))
    numbered = kept.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row")
    vs = Persisted(numbered, buckets, "vectors")
    centroids = first_centroids(vs.read().select("vec_id", "v"), k, seed, dim)
    sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
    changed, now = list(range(len(centroids))), None
    for step in range(rounds + 1):
        before, now = now, Persisted(assigned(vs.read(), now and now.read(), centroids, changed), buckets, "owners")
        if before:
            before.drop()
        if step == rounds:
            break
        seen = set()
        for c, i, s, m in moved_sums(now.read()):
            sums[c, i] += s
            counts[c] += m if c not in seen else 0  # the count comes with every component
            seen.add(c)
        after = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        changed = np.flatnonzero((after != centroids).any(axis=1)).tolist()
        centroids = after
        if not changed:
            break
    owners = now.read().select("row", F.col("owner").alias("cluster"), "distance").hint("shuffle_hash")
    return vs.read().select("row", "vec_id").join(owners, "row").select("vec_id", "cluster", "distance"), centroids


def _bigint(total: Column) -> Column:
    """A sum of longs, taken as a decimal; null where it is beyond 64 bits."""
    return total.try_cast("long")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner, distance and inertias of every kept row of embeddings; hard cases as in cluster."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))  # a row a cluster, summed map-side
    sums = {r.cluster: r.s for r in by_cluster.collect()}
    total = sum(sums.values())
    facts = spark.createDataFrame([(k, d, sums.get(k), total) for k, d in digests], "cluster int, centroid_sha256 string, s decimal(38,0), t decimal(38,0)")
    facts = small(facts.withColumnRenamed("cluster", "k"), len(digests))
    return found.join(facts, F.col("cluster") == F.col("k")).select(
        "vec_id", "cluster", "distance", _bigint(F.col("s")).alias("cluster_inertia"), _bigint(F.col("t")).alias("inertia"), "centroid_sha256",
    )


def _sql() -> str:
    kept = f"len(embedding) = {DIM} AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {kept})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM v QUALIFY k < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min((d, k)) AS b FROM (SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) GROUP BY r)")
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT b[2] AS k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT b, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i} JOIN v USING (r)) GROUP BY ALL)")
            parts.append(f"m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{i} GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (k))")
    last = ROUNDS
    return f"""WITH {", ".join(parts)},
f AS (SELECT vec_id, CAST(b[2] AS INTEGER) AS cluster, b[1] AS distance FROM a{last} JOIN v USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN c{last} ON cluster = k"""


OP13_SQL = _sql()
