"""The batch limiter against counting hit by hit, for a client with very many hits."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kgweave.streaming.limiter import limit_batch


def test_hit_by_hit(spark):
    rng = random.Random(111)
    began = datetime(2024, 1, 1)
    times = [(0, rng.choice((0, 30, 59, 60, 61, 600)) * 1_000_000 + rng.choice((0, 0, 1, 999_999))) for _ in range(300)] + [(rng.randint(1, 4), rng.randrange(400_000_000)) for _ in range(400)]
    rows = [(i, k, began + timedelta(microseconds=us)) for i, (k, us) in enumerate(times)] + [(9000, 1, None), (9001, None, began), (9002, None, began)]
    got = {r.id: (r.n_window, r.rejected) for r in limit_batch(spark.createDataFrame(rows, "id long, k int, ts timestamp"), "k", "ts", 60, 20, "id").collect()}
    for i, k, t in rows:
        if t is None:
            assert got[i] == (None, False)
            continue
        n = sum(1 for j, k2, t2 in rows if k2 == k and t2 is not None and (t2 < t or (t2 == t and j <= i)) and t - t2 < timedelta(seconds=60))
        assert got[i] == (n, n > 20), (i, k, t)
    assert len(got) == len(rows)


def test_one_client_is_in_many_tasks(spark):
    n = 200_000
    hits = spark.range(n).select("id", F.lit(1).alias("k"), F.timestamp_micros(F.col("id") * 60_000).alias("ts"))  # 1,000 a minute
    out = limit_batch(hits, "k", "ts", 60, 999, "id")
    assert out.where((F.col("n_window") != F.least(F.col("id") + 1, F.lit(1000))) | (F.col("rejected") != (F.col("n_window") > 999))).count() == 0
    sizes = Counter(r.p for r in out.withColumn("p", F.spark_partition_id()).select("p").collect())
    assert len(sizes) > 1 and max(sizes.values()) < 0.5 * n
