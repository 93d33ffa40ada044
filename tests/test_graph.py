import random

import pandas as pd

from kgweave.operators.graph_ops import neighbourhood, shortest_paths
from kgweave.sources import files
from kgweave.sources.files import append_jsonl, read_jsonl, read_tsv, write_tsv
from kgweave.streaming.limiter import limit_batch, limit_stream


def test_bfs_against_brute_force(spark):
    rng = random.Random(1)
    edges = {(f"n{rng.randint(0, 25):02d}", f"n{rng.randint(0, 25):02d}") for _ in range(34)}
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def paths(root):
        found = {root: (0, root)}
        layer = [root]
        while layer:
            new: dict[str, tuple[int, str]] = {}
            for x in layer:
                for y in near.get(x, ()):
                    if y not in found:
                        p = f"{found[x][1]}>{y}"
                        if y not in new or p < new[y][1]:
                            new[y] = (found[x][0] + 1, p)
            found |= new
            layer = list(new)
        return found

    df = spark.createDataFrame(sorted(edges), "source string, target string")
    nodes = sorted(near)
    ask = spark.createDataFrame([(a, b) for a in nodes[:5] for b in nodes], "from_id string, to_id string")
    got = {(r.from_id, r.to_id): (r.hops, r.path) for r in shortest_paths(df, ask).collect()}
    want = {(a, b): v for a in nodes[:5] for b, v in paths(a).items() if a != b and v[0] <= 4}
    assert got == want
    seeds = spark.createDataFrame([(i, n) for i, n in enumerate(nodes[:5])], "question_id long, node string")
    one, two = ({(r.question_id, r.node) for r in neighbourhood(df, seeds, h).collect()} for h in (1, 2))
    assert one <= two == {(i, b) for i, a in enumerate(nodes[:5]) for b, v in paths(a).items() if v[0] <= 2}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "x, y"), ("b", "")], "k string, v string")
    write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, read_tsv(spark, str(tmp_path / "t"), ["k", "v"]).collect())) == [("a", "x, y"), ("b", "")]
    for _ in range(2):
        append_jsonl(df, str(tmp_path / "j"))
    assert read_jsonl(spark, str(tmp_path / "j"), "k string, v string")[0].count() == 4


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A", "gene"), ("b", "B", "drug")], "id string, label string, type string")
    edges = spark.createDataFrame([("e", "a", "b")], "id string, source string, target string")
    path = f"file://{tmp_path}/g"
    files.write_graph(path, "_heldout", nodes=nodes, edges=edges, seed_nodes=nodes.limit(1), seed_edges=edges.limit(0), search_index=nodes)
    assert [df.count() for df in files.read_graph(spark, path, "_heldout")] == [2, 1]
    assert [df.count() for df in files.read_graph(spark, path, "_heldout", seed=True)] == [1, 0]
    one, two = files.cached_graph(spark, path, "_heldout"), files.cached_graph(spark, path, "_heldout")
    assert one[0] is two[0] and one[0].is_cached
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "members": [{"rsid": "rs1"}]}], "edges": [{"id": "e", "source": "a", "target": "a", "pmids": ["1"]}]}')
    n, e = files.read_graph_json(spark, f"file://{tmp_path}/g.json")
    assert (n.first().members[0].rsid, e.first().pmids) == ("rs1", ["1"])
    made = []
    for _ in range(2):
        files.built_once(spark, f"{path}/built", lambda: made.append(1) or nodes)
    assert made == [1]
    files.set_search_index(spark, nodes)
    assert files.has_search_index(spark) and files.get_search_index(spark).count() == spark.table("search_index").count() == 2
    facts = spark.createDataFrame([("rs1", "G1", " x"), ("rs2", "G2", None)], "variant string, gene string, type string")
    keys = spark.createDataFrame([("rs1|G1|x",)], "row_key string")
    files.write_holdout(facts, keys, ["variant", "gene", "type"], path)
    assert read_tsv(spark, f"{path}/heldout_variants", ["variant", "gene", "type"]).count() == 1
    assert [r.row_key for r in files.read_lines(spark, f"{path}/heldout_variant_hashes").collect()] == ["rs1|G1|x"]


def test_limiter_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 3, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=rng.randint(0, 600))) for i in range(150)]
    rows = sorted({r for r in rows})
    df = spark.createDataFrame([(k, t.to_pydatetime()) for k, t in rows], "k int, ts timestamp").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
    q = limit_stream(stream, "k", "ts", 60, 3).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = sorted((r.k, r.ts, r.n_window, r.rejected) for r in spark.table("limited").collect())
    assert got == sorted((r.k, r.ts, r.n_window, r.rejected) for r in limit_batch(df, "k", "ts", 60, 3).collect())
