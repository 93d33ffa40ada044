"""Approximate nearest neighbours: a navigable small-world graph per shard, as flat neighbour arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgweave.llm.base import cut, quoted, small, table

#: Distinct vectors of a shard on average, links of a node on upper levels (twice on the lowest), beam width while building.
SHARD, LINKS, EF_BUILD = 16_384, 16, 64
#: Beam widths to choose from. A shard takes the least at which PROBES of its own vectors find TARGET of their nearest.
WIDTHS, PROBES, TARGET = (64, 128, 256, 512, 1024), 64, 0.95
#: Queries that meet a shard in one task, those of one row, and those that advance together.
BLOCK, PACK, TOGETHER = 32_768, 2048, 256
#: Nodes expanded in one step of a beam.
STEP = 4
#: Nodes without an incoming path get one of these extra slots of a node that has.
EXTRA = 4


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ef nodes (ids, -1: none; inner products) for each query, found along the links from its entries."""
    n, b = len(x), len(q)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # -1
    rows = np.arange(b)[:, None]
    ids = np.full((b, ef), -1, np.int32)
    sims = np.full((b, ef), -np.inf, np.float32)
    width = entry.shape[1]
    ids[:, :width] = entry
    sims[:, :width] = np.where(entry >= 0, np.einsum("bmd,bd->bm", x[entry], q), -np.inf)
    seen[rows, entry] = True
    seen[:, n] = True
    fresh = ids >= 0
    while True:
        rank = np.where(fresh, sims, -np.inf)
        k = min(STEP, ef)
        top = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        chosen = np.where(np.take_along_axis(rank, top, 1) > -np.inf, np.take_along_axis(ids, top, 1), -1)
        live = np.flatnonzero((chosen >= 0).any(1))
        if not len(live):
            break
        np.put_along_axis(fresh, top, False, 1)
        near = np.where(chosen[live][:, :, None] >= 0, links[chosen[live]], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[live[:, None], near], -1, near)
        seen[live[:, None], near] = True
        s = np.where(near >= 0, np.einsum("bmd,bd->bm", x[near], q[live]), -np.inf).astype(np.float32)
        all_ids, all_sims = np.concatenate((ids[live], near), 1), np.concatenate((sims[live], s), 1)
        all_fresh = np.concatenate((fresh[live], near >= 0), 1)
        best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[live], sims[live], fresh[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_fresh))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def diverse(x: np.ndarray, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (best first): those nearer to the row's vector than to any chosen one, then the best of the rest."""
    b, c = ids.shape
    v = x[ids]
    mutual = np.matmul(v, v.transpose(0, 2, 1))
    mutual[np.broadcast_to((ids < 0)[:, None, :], mutual.shape)] = -np.inf
    chosen = np.zeros((b, c), bool)
    for j in range(c):
        good = (ids[:, j] >= 0) & (chosen.sum(1) < most) & ~((mutual[:, j, :] > sims[:, j : j + 1]) & chosen).any(1)
        chosen[:, j] = good
    rank = np.where(ids < 0, 2 * c + np.arange(c), np.where(chosen, np.arange(c), c + np.arange(c)))
    pick = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(ids, pick, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def link(x: np.ndarray, links: np.ndarray, most: int, new: np.ndarray, near: np.ndarray) -> None:
    """Links of new nodes, and those back to them; a full list keeps a diverse choice."""
    links[new, :most] = near
    source, target = np.repeat(new, near.shape[1]), near.reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    nodes, first, n = np.unique(target, return_index=True, return_counts=True)
    if not len(nodes):
        return
    back = np.full((len(nodes), int(n.max())), -1, np.int32)
    back[np.repeat(np.arange(len(nodes)), n), np.arange(len(target)) - np.repeat(first, n)] = source
    every = np.concatenate((links[nodes, :most], back), 1)
    every = np.sort(every, axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    sims = np.where(every >= 0, np.einsum("bmd,bd->bm", x[every], x[nodes]), -np.inf).astype(np.float32)
    order = np.argsort(-sims, axis=1)
    every, sims = np.take_along_axis(every, order, 1), np.take_along_axis(sims, order, 1)
    width = int((every >= 0).sum(1).max())
    if width > most:
        links[nodes, :most] = diverse(x, x[nodes], every[:, :width], sims[:, :width], most)
    else:
        links[nodes, :most] = np.pad(every[:, :width], ((0, 0), (0, most - width)), constant_values=-1)


def reached(links: np.ndarray, start: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(links) + 1, bool)
    front = start
    seen[front] = True
    while len(front):
        near = np.unique(links[front])
        front = near[(near >= 0) & ~seen[near]]
        seen[front] = True
    return seen[:-1]


def lengthened(x: np.ndarray) -> np.ndarray:
    """With a further component that makes all vectors equally long."""
    square = (x.astype(np.float64) ** 2).sum(1)
    return np.concatenate((x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]), 1).astype(np.float32)


def build(vectors: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Augmented vectors in insertion order and, from the top level down, (order, flat neighbours) as positions.

    A further component makes all vectors equally long, so that the largest inner product is the nearest vector; a
    query's is zero. Levels come from a hash of the id, so a rebuilt shard is the same.
    """
    n = len(vectors)
    u = (pd.util.hash_array(ids.astype(np.int64)) >> np.uint64(11)).astype(np.float64) / 2**53
    level = np.minimum((-np.log(np.maximum(u, 1e-300)) / math.log(LINKS)).astype(int), 8)
    order = np.lexsort((ids, -level))  # upper levels are prefixes of this order
    x = lengthened(vectors)[order]
    levels = level[order]
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for lv in range(int(levels[0]), -1, -1):
        m = int((levels >= lv).sum())
        most = LINKS if lv else 2 * LINKS
        links = np.full((m, most + EXTRA), -1, np.int32)
        at, size = 1, 8
        while at < m:
            new = np.arange(at, min(at + size, m), dtype=np.int32)
            entry = descend(x, layers, x[new], np.zeros((len(new), 1), np.int32))
            entry = np.where(entry < at, entry, 0)
            found, sims = beam(x[:at], links[:at], x[new], entry, EF_BUILD)
            inner = x[new] @ x[new].T
            np.fill_diagonal(inner, -np.inf)
            inner[np.triu_indices(len(new))] = -np.inf  # earlier ones of the batch
            both = np.concatenate((found, np.broadcast_to(new, (len(new), len(new)))), 1)
            both_sims = np.concatenate((sims, inner), 1)
            best = np.argsort(-both_sims, axis=1, kind="stable")[:, :EF_BUILD]
            both, both_sims = np.take_along_axis(both, best, 1), np.take_along_axis(both_sims, best, 1)
            both = np.where(both_sims > -np.inf, both, -1)
            link(x, links, most, new, diverse(x, x[new], both, both_sims, LINKS if lv else LINKS + LINKS // 2) if most == LINKS else np.pad(diverse(x, x[new], both, both_sims, LINKS + LINKS // 2), ((0, 0), (0, LINKS // 2)), constant_values=-1))
            at += len(new)
            size = min(128, max(8, at // 4))
        for slot in range(EXTRA):
            lost = np.flatnonzero(~reached(links, np.zeros(1, np.int32)))
            if not len(lost):
                break
            seen = reached(links, np.zeros(1, np.int32))
            for i in lost.tolist():
                near = [j for j in links[i] if j >= 0 and seen[j] and links[j, most + slot] < 0]
                if near:
                    links[near[0], most + slot] = i
        layers.append((np.arange(m, dtype=np.int32), links))
    return order, layers


def descend(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, entry: np.ndarray) -> np.ndarray:
    for _, links in layers:
        entry = beam(x[: len(links)], links, q, entry, STEP)[0][:, :1]
    return entry


def search(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, ef: int) -> np.ndarray:
    """Positions of up to ef neighbours of each query, best first (-1: none)."""
    out = []
    for i in range(0, len(q), TOGETHER):
        part = np.concatenate((q[i : i + TOGETHER], np.zeros((len(q[i : i + TOGETHER]), 1), np.float32)), 1)
        entry = descend(x, layers[:-1], part, np.zeros((len(part), 1), np.int32))
        out.append(beam(x, layers[-1][1], part, entry, max(ef, STEP))[0])
    return np.concatenate(out)


def width(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int) -> int:
    """The beam width this shard needs, measured against all of it; 0 where none suffices and all vectors are compared."""
    probe = x[np.argsort(pd.util.hash_array(ids.astype(np.int64) ^ 0x5BD1E995))[:PROBES], :-1]
    k = min(k, len(x))
    full = probe @ x[:, :-1].T
    least = -np.partition(-full, k - 1, axis=1)[:, k - 1]
    for ef in WIDTHS:
        if ef >= k:
            found = search(x, layers, probe, max(ef, STEP))
            hit = (found >= 0) & (np.take_along_axis(full, np.maximum(found, 0), 1) >= least[:, None] - 1e-5 * np.abs(least[:, None]))
            if np.minimum(hit.sum(1), k).sum() >= TARGET * k * len(probe):
                return ef
    return 0


def scan(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest inner products of each query, all vectors compared."""
    k = min(k, len(x))
    out = []
    for i in range(0, len(q), TOGETHER):
        full = q[i : i + TOGETHER] @ x.T
        top = np.argpartition(-full, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(full, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v, dim of vectors that take part: not null, finite, not zero, with an id."""
    v = F.col(quoted(embedding))
    ok = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.where(F.col(quoted(vec_id)).isNotNull() & ok).select(F.col(quoted(vec_id)).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim")).distinct()


GRAPH = "dim int, shard int, shards int, ef int, x binary, ids binary, n_ids binary, links array<binary>, sizes array<int>"


def index(vectors: DataFrame, keep: int, shard: int = SHARD) -> DataFrame:
    """One row a shard (GRAPH): ids (of each distinct vector, smallest first, ``keep`` at most), x (their float32), layers
    as flat arrays, and ef, the beam width measured for it.

    vectors: vec_id, v, dim. Equal vectors are one node: no search returns more than ``keep`` of them, those of smallest
    id. Distinct vectors are dealt to shards by hash, so that no shard grows with a popular vector.
    """
    first = Window.partitionBy("v").orderBy("vec_id")
    nodes = vectors.select("dim", "v", "vec_id", F.row_number().over(first).alias("r")).where(F.col("r") <= keep).groupBy("dim", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(nodes, "nodes")
    sizes = cut(nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")), "sizes")
    dealt = nodes.join(small(sizes, sizes.count()), "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
        order, layers = build(x, np.array([i[0] for i in pdf["ids"]], np.int64))
        ids = [pdf["ids"].iloc[i] for i in order]
        x = x[order]
        ef = width(lengthened(x), layers, np.array([i[0] for i in ids], np.int64), keep)
        return pd.DataFrame({
            "dim": pdf["dim"].iloc[:1].to_numpy(), "shard": pdf["shard"].iloc[:1].to_numpy(), "shards": pdf["shards"].iloc[:1].to_numpy(), "ef": [ef], "x": [x.tobytes()],
            "ids": [np.concatenate(ids).astype(np.int64).tobytes()], "n_ids": [np.array([len(i) for i in ids], np.int32).tobytes()], "links": [[a.tobytes() for _, a in layers]], "sizes": [[len(a) for a, _ in layers]],
        })

    return dealt.groupBy("dim", "shard").applyInPandas(make, GRAPH)


def packed(queries: DataFrame, blocks: int) -> DataFrame:
    """Distinct query vectors (dim, v, k1, k2) in rows of about PACK: dim, block, x (float32), k1, k2 (their keys)."""
    parts = BLOCK // PACK
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("v", F.lit(7)), F.lit(blocks * parts)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1].to_numpy(), "block": [int(pdf["part"].iloc[0]) // parts], "x": [x.tobytes()], "k1": [pdf["k1"].to_numpy(np.int64).tobytes()], "k2": [pdf["k2"].to_numpy(np.int64).tobytes()]})

    return dealt.groupBy("dim", "part").applyInPandas(pack, "dim int, block int, x binary, k1 binary, k2 binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best found by inner product in double precision, ties to smaller ids.

    Both tables: ids and vectors; other columns play no part. A query's own id is no candidate; vectors that are null,
    zero, or hold null or non-finite components, and rows without id, take no part; vectors are only compared with
    those of equal length; equal rows count once; of equal scores the smaller ids come first. Either table may be empty.

    Each shard's beam is as wide as it must be to find TARGET of the nearest of a sample of its own vectors; a shard in
    which no width does is scanned. Blocks of queries, not single ones, go to the shards.
    """
    built = cut(index(valid(vectors, vec_id, embedding), k + 1, shard), "index")
    keyed = valid(queries, vec_id, embedding).select("vec_id", "dim", "v", F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2"))
    asked = cut(keyed.select("vec_id", "k1", "k2"), "asked")
    distinct = cut(keyed.select("dim", "v", "k1", "k2").distinct(), "distinct")
    blocks = max(1, math.ceil(distinct.count() / BLOCK))
    lasts = cut(built.groupBy("dim").agg(F.max("shard").alias("last")), "lasts")
    sent = cut(packed(distinct, blocks), "packed").join(small(lasts, lasts.count()), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    graphs = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(graph: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if graph.empty or ask.empty:
            return pd.DataFrame({"k1": [], "k2": [], "grp": [], "found": []})
        g = graph.iloc[0]
        dim = int(g["dim"])
        x = np.frombuffer(g["x"], np.float32).reshape(-1, dim)
        layers = [(np.arange(n), np.frombuffer(raw, np.int32).reshape(n, -1)) for raw, n in zip(g["links"], g["sizes"], strict=True)]
        n_ids = np.frombuffer(g["n_ids"], np.int32)
        ends = np.cumsum(n_ids)
        ids = np.frombuffer(g["ids"], np.int64)
        q = np.concatenate([np.frombuffer(b, np.float32) for b in ask["x"]]).reshape(-1, dim)
        k1, k2 = (np.concatenate([np.frombuffer(b, np.int64) for b in ask[c]]) for c in ("k1", "k2"))
        ef = int(g["ef"])
        found = search(lengthened(x), layers, q, min(max(ef, k + 1), max(len(x), STEP))) if ef else scan(x, q, k + 1)
        exact = x.astype(np.float64)
        out = []
        for i, row in enumerate(found):
            row = row[row >= 0]
            score = (exact[row] * q[i].astype(np.float64)).sum(1)
            every = np.concatenate([ids[ends[j] - n_ids[j] : ends[j]] for j in row])
            scores = np.repeat(score, n_ids[row])
            best = np.lexsort((every, -scores))[: k + 1]
            out.append([{"neg": -float(s), "id": int(e)} for s, e in zip(scores[best], every[best], strict=True)])
        return pd.DataFrame({"k1": k1, "k2": k2, "grp": int(g["shard"]) // 64, "found": out})

    hits = graphs.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInPandas(look, "k1 long, k2 long, grp int, found array<struct<neg:double,id:long>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1)
    merged = hits.groupBy("k1", "k2", "grp").agg(best.alias("found")).groupBy("k1", "k2").agg(best.alias("found"))
    each = asked.withColumnRenamed("vec_id", "query_id").join(merged, ["k1", "k2"])
    own = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(own).alias("pos", "f")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.neg")).alias("score"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each row whose vec_id is divisible by 20, among all other rows. Nulls and ties as in nearest."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
