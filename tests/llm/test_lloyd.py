"""Delta Lloyd against plain Lloyd in whole numbers of any size."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, `row` string, v string, owner string"


def plain(rows, k=lloyd.CLUSTERS, rounds=lloyd.ROUNDS, dim=lloyd.DIM):
    kept = [(i, [math.floor(lloyd.SCALE * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{lloyd.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in found]


def run(spark, rows, path):
    spark.createDataFrame([(i, e, 1, "own", "own", "own") for i, e in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, lloyd.op13_clusters(spark, str(path)).collect()), key=repr)


def test_contract(spark, tmp_path):
    rng = random.Random(51)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for i in range(400)]
    rows += [(500 + i, centres[0]) for i in range(150)]  # one group of copies
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (None, rows[4][1])]  # shared and missing ids
    bad = rows[5][1]
    rows += [(900, None), (901, []), (902, bad[:63]), (903, [*bad, 0.5]), (904, [None, *bad[1:]]), (905, [float("nan"), *bad[1:]]), (906, [*bad[:63], float("-inf")]), (907, [0.0] * 64), (908, [-0.0] * 64), (909, [3000.25] * 64)]
    got = run(spark, rows, tmp_path)
    assert got == sorted(plain(rows), key=repr)
    assert len(got) == len(rows) - 7


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors(spark, tmp_path, n):
    rows = [(i, [float(i % 2)] * 64) for i in range(n)] + [(99, [1.0])]
    assert run(spark, rows, tmp_path) == sorted(plain(rows), key=repr)


def test_ties_and_empty_clusters_in_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BUCKET_ROWS", 60)
    rng = random.Random(52)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rounds in (0, 1, 4, 30):
        found, _ = lloyd.cluster(df, k=12, rounds=rounds, dim=3)
        assert sorted(map(tuple, found.collect())) == sorted(r[:3] for r in plain(rows, 12, rounds, 3))


def test_deltas_compare_only_what_can_have_changed():
    rng = np.random.default_rng(53)
    v = rng.integers(-2000, 2000, (500, 8))
    c = rng.integers(-2000, 2000, (6, 8))
    owner, distance = lloyd.assign(v, np.full(500, -1, np.int32), np.zeros(500, np.int64), c, list(range(6)))
    moved = c.copy()
    moved[2] += 300
    again = lloyd.assign(v, owner, distance, moved, [2])
    want = lloyd.assign(v, np.full(500, -1, np.int32), np.zeros(500, np.int64), moved, list(range(6)))
    assert all((a == b).all() for a, b in zip(again, want, strict=True))
    sent = lloyd.transfers(v, owner, again[0])
    assert sum(t["n"] for t in sent) == 0 and all(sum(t["sums"][i] for t in sent) == 0 for i in range(8))


def test_the_join_of_vectors_and_owners_is_not_shuffled(spark, capsys, monkeypatch):
    monkeypatch.setattr(lloyd, "BUCKET_ROWS", 50)
    df = spark.range(200).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(i * F.col("id"))).alias("embedding"))
    monkeypatch.setattr(lloyd, "DIM", 4)
    found, _ = lloyd.cluster(df, k=3, rounds=2, dim=4)
    found.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_refuses_vectors_that_could_overflow(spark):
    with pytest.raises(ValueError):
        lloyd.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"), dim=129)
