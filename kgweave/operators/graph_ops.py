"""Graph operators in batch form: state is keyed by question and node, frontiers are tables, hops are bounded."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgweave.constants import CRITICAL_LEVELS, MOST_HOPS, SEED_HOPS, SEED_NODES
from kgweave.sources.shared import BROADCAST_ROWS, cut, small


#: Neighbours of one node in one block of an adjacency table.
BLOCK_EDGES = 50_000


class Adjacency:
    """Every edge in both directions (src, dst, block), written once: each hop joins with it again.

    The neighbours of a hub are dealt into blocks of about BLOCK_EDGES, and ``heavy`` (src, blocks) says how many; what
    stands on a hub meets its blocks one by one, so no task has all edges of one node.
    """

    def __init__(self, edges: DataFrame, size: int = BLOCK_EDGES):
        both = edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).where("src <> dst")
        pairs = cut(both.union(both.select("dst", "src")).distinct(), "pairs")
        self.degrees = cut(pairs.groupBy("src").agg(F.count("*").alias("degree")), "degrees")
        heavy = self.degrees.where(F.col("degree") > size)
        self.heavy = cut(heavy.select("src", F.ceil(F.col("degree") / size).cast("int").alias("blocks")), "heavy")
        self._hubs = self.heavy.count()
        block = F.pmod(F.xxhash64("dst"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int")
        self.edges = cut(pairs.join(self._hubs_table(), "src", "left").select("src", "dst", block.alias("block")), "adjacency") if self._hubs else pairs.withColumn("block", F.lit(0))

    def _hubs_table(self) -> DataFrame:
        return small(self.heavy, self._hubs)

    def step(self, front: DataFrame, node: str = "node") -> DataFrame:
        """``front`` with dst, a row for each neighbour of ``node``."""
        at = front.withColumn("block", F.lit(0))
        if self._hubs:
            blocks = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
            at = front.join(self._hubs_table().withColumnRenamed("src", node), node, "left").select(*front.columns, blocks.alias("block"))
        return at.join(self.edges.withColumnRenamed("src", node), [node, "block"]).drop("block")

    def load(self, front: DataFrame, node: str = "node") -> int:
        """Rows that a step from ``front`` makes."""
        return front.join(self.degrees.withColumnRenamed("src", node), node).agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 1, adjacency: Adjacency | None = None) -> DataFrame:
    """question_id, node, hop: nodes within ``hops`` (0 to 4) undirected steps of a question's seeds (question_id, node).

    adjacency: of ``edges``, where it is at hand.
    """
    hops = max(0, min(hops, MOST_HOPS))
    seen = seeds.select("question_id", "node").distinct().withColumn("hop", F.lit(0))
    front = seen
    if hops == 1 and adjacency is None:
        few = cut(seeds.select("question_id", "node").distinct(), "seeds")
        n = few.count()
        if n <= BROADCAST_ROWS:  # one step from a few seeds reads the edges as they are
            back = edges.select(F.col("target").alias("node"), F.col("source").alias("dst"))
            step = edges.select(F.col("source").alias("node"), F.col("target").alias("dst")).union(back).join(small(few, n), "node")
            near = step.select("question_id", F.col("dst").alias("node")).distinct().join(small(few, n), ["question_id", "node"], "left_anti")
            return seen.unionByName(cut(near.withColumn("hop", F.lit(1)), "front"))
    if hops and adjacency is None:
        adjacency = Adjacency(edges)
    for h in range(1, hops + 1):
        step = adjacency.step(front.select("question_id", "node")).select("question_id", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, ["question_id", "node"], "left_anti").withColumn("hop", F.lit(h)), "front")
        seen = seen.unionByName(front)
    return seen


def hydrate(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``ids`` (node, ...) with the attributes of their nodes; ids that are no node are dropped."""
    return ids.join(nodes.withColumnRenamed("id", "node"), "node")


def seed_expansion(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: float | None = 1, most: int = SEED_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes (question_id, id, attributes) and edges (question_id, ...) of each seed's surroundings, the ``most`` nodes of
    greatest degree in them.

    hops is brought to 1 to 3; without a number (null, not a number) there is no step and only the seed remains.
    """
    steps = 0 if hops is None or hops != hops else int(min(max(hops, 1), SEED_HOPS))
    kept = cut(hydrate(nodes, neighbourhood(edges, seeds, steps)).withColumnRenamed("node", "id").drop("hop"), "expansion")
    inner = cut(induced(edges, kept.select("question_id", F.col("id").alias("node"))), "induced")
    ends = inner.select("question_id", F.explode(F.array("source", "target")).alias("id")).groupBy("question_id", "id").agg(F.count("*").alias("degree"))
    ranked = kept.join(ends, ["question_id", "id"], "left").withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "id")))
    top = ranked.where(F.col("r") <= most).drop("degree", "r")
    for end in ("source", "target"):
        inner = inner.join(top.select("question_id", F.col("id").alias(end)), ["question_id", end], "left_semi")
    return top, inner


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among a question's nodes, with question_id."""
    a = nodes.select("question_id", F.col("node").alias("source"))
    b = nodes.select("question_id", F.col("node").alias("target"))
    return edges.join(a, "source").join(b, ["question_id", "target"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree; a loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def filter_edges(edges: DataFrame, types: list[str] | None = None, levels: list[str] | None = None) -> DataFrame:
    """Edges of the types and levels; an edge without level passes any level filter."""
    if types:
        edges = edges.where(F.col("type").isin(*types))
    if levels:
        edges = edges.where(F.col("level").isNull() | (F.col("level") == "") | F.col("level").isin(*levels))
    return edges


def ranked_nodes(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` nodes (id, ...) of greatest degree in ``edges``; ties: smaller id."""
    found = nodes.join(degrees(edges).withColumnRenamed("node", "id"), "id", "left")
    return found.orderBy(F.desc(F.coalesce("degree", F.lit(0))), "id").limit(most).drop("degree")


def apply_filters(nodes: DataFrame, edges: DataFrame, node_types: list[str] | None = None, edge_types: list[str] | None = None, levels: list[str] | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that pass the filters (none: all pass), without dangling edges; then the ``most`` nodes of greatest degree."""
    if node_types:
        nodes = nodes.where(F.col("type").isin(*node_types))
    passed = filter_edges(edges, edge_types, levels)
    if not most:
        return nodes, _joined_ends(passed, nodes)
    # ends alone are counted; edges as a whole meet only the nodes that are left
    top = cut(ranked_nodes(nodes, _joined_ends(passed.select("source", "target"), nodes), most), "ranked")
    return top, _joined_ends(passed, top, most)


def _joined_ends(edges: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Edges with both ends among the nodes, of which there are at most ``most``, if it is given."""
    for end in ("source", "target"):
        ids = nodes.select(F.col("id").alias(end))
        edges = edges.join(ids if most is None else small(ids, most), end, "left_semi")
    return edges


def hidden_elements(nodes: DataFrame, edges: DataFrame, node_types: list[str] | None = None, edge_types: list[str] | None = None, levels: list[str] | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """ids of the nodes and of the edges that the filters hide: what ``apply_filters`` does not keep."""
    shown_nodes, shown_edges = apply_filters(nodes, edges, node_types, edge_types, levels, most)
    ids = lambda shown, name: (held := cut(shown.select("id"), name), held.count())
    return nodes.select("id").join(small(*ids(shown_nodes, "shown")), "id", "left_anti"), edges.select("id").join(small(*ids(shown_edges, "shown")), "id", "left_anti")


@dataclass(frozen=True)
class Filters:
    """What a view shows: all types and levels, the ``most`` nodes of greatest degree, clusters as one node each.

    most: from LEAST to MOST in steps of STEP; other numbers go to the nearest of these.
    """

    node_types: tuple[str, ...] | None = None
    edge_types: tuple[str, ...] | None = None
    levels: tuple[str, ...] | None = None
    most: int = 80
    collapse_variants: bool = True

    LEAST, MOST, STEP = 20, 300, 10

    def __post_init__(self) -> None:
        held = min(max(self.most, self.LEAST), self.MOST)
        object.__setattr__(self, "most", self.LEAST + (held - self.LEAST + self.STEP // 2) // self.STEP * self.STEP)

    def apply(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not self.collapse_variants:
            nodes, edges = expand_graph(nodes, edges)
        as_list = lambda x: None if x is None else list(x)
        return apply_filters(nodes, edges, as_list(self.node_types), as_list(self.edge_types), as_list(self.levels), self.most)


def top_nodes(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of greatest degree (ties: smaller id) and the edges among them."""
    nodes = degrees(edges).orderBy(F.desc("degree"), "node").limit(most)
    kept = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")
    return nodes, kept


def hidden(edges: DataFrame, types: list[str] | None = None, levels: list[str] | None = None) -> DataFrame:
    """Nodes that no visible edge touches."""
    visible = degrees(filter_edges(edges, types, levels)).select("node")
    return degrees(edges).select("node").join(visible, "node", "left_anti")


def search_paths(edges: DataFrame, pairs: DataFrame, most: int = MOST_HOPS, adjacency: Adjacency | None = None) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """The paths of ``shortest_paths``, and of each step taken its side, its depth and the rows of its frontier.

    Paths grow from both ends of the pairs that are left, a level at a time and always on the side whose frontier has
    fewer edges, and meet in the middle: after f steps from one end and b from the other, a node that both reach at
    their last level is on a path of f + b hops, and no shorter one was found before. Each frontier keeps the smallest
    path to each (root, node); the smallest whole path through a node is made of the smallest two parts.
    """
    adjacency = adjacency or Adjacency(edges)
    left = cut(pairs.where("from_id <> to_id").select("from_id", "to_id").distinct(), "pairs")
    ends = {"from": "from_id", "to": "to_id"}
    seen, fronts, depth = {}, {}, {"from": 0, "to": 0}
    for side, end in ends.items():
        seen[side] = fronts[side] = left.select(F.col(end).alias("root")).distinct().select("root", F.col("root").alias("node"), F.col("root").alias("path"))
    found, report = [], []
    for hops in range(1, most + 1):
        wanted = {side: fronts[side].join(left.select(F.col(end).alias("root")).distinct(), "root", "left_semi") for side, end in ends.items()}
        side = "from" if hops == 1 else min(ends, key=lambda s: adjacency.load(wanted[s]))
        grown = F.concat("path", F.lit(">"), "dst") if side == "from" else F.concat("dst", F.lit(">"), "path")
        step = adjacency.step(wanted[side]).select("root", F.col("dst").alias("node"), grown.alias("path"))
        front = step.join(seen[side].select("root", "node"), ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("path").alias("path"))
        fronts[side] = cut(front, "front")
        seen[side] = seen[side].unionByName(fronts[side])
        depth[side] += 1
        report.append((side, depth[side], fronts[side].count()))
        begin = fronts["from"].select(F.col("root").alias("from_id"), "node", F.col("path").alias("head"))
        end_ = fronts["to"].select(F.col("root").alias("to_id"), "node", F.col("path").alias("tail"))
        # the node in the middle ends one part and begins the other
        whole = F.concat("head", F.substring("tail", F.length("node") + 1, F.length("tail")))
        met = left.join(begin, "from_id").join(end_, ["to_id", "node"]).groupBy("from_id", "to_id").agg(F.min(whole).alias("path"))
        met = cut(met.select("from_id", "to_id", F.lit(hops).alias("hops"), "path"), "met")
        found.append(met)
        if hops < most:
            left = cut(left.join(met, ["from_id", "to_id"], "left_anti"), "left")
            if left.isEmpty():
                break
    return functools.reduce(DataFrame.union, found), report


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = MOST_HOPS, adjacency: Adjacency | None = None) -> DataFrame:
    """from_id, to_id, hops, path (ids joined by ``>``): fewest undirected hops, of these the smallest path by characters.

    Pairs of one node with itself, or farther apart than ``most``, have no row.
    """
    return search_paths(edges, pairs, most, adjacency)[0]


def critical_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths with critical: any edge along it is critical or of level 1A or 1B; critical ones first, then fewer hops."""
    ids = F.split("path", ">")
    paths = cut(paths, "paths")
    steps = paths.select("from_id", "to_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(ids) - 1), lambda i: F.struct(F.least(F.element_at(ids, i), F.element_at(ids, i + 1)).alias("lo"), F.greatest(F.element_at(ids, i), F.element_at(ids, i + 1)).alias("hi")))).alias("s")).select("from_id", "to_id", "s.lo", "s.hi")
    on_path = cut(steps.select("lo", "hi").distinct(), "steps")  # edges on no path are left out before they are shuffled
    ends = edges.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target")).join(small(on_path, on_path.count()), ["lo", "hi"], "left_semi")
    strong = ends.select("lo", "hi", (F.col("critical") | F.col("level").isin(*CRITICAL_LEVELS)).alias("c")).groupBy("lo", "hi").agg(F.max("c").alias("c"))
    flags = steps.join(strong, ["lo", "hi"], "left").groupBy("from_id", "to_id").agg(F.max(F.coalesce("c", F.lit(False))).alias("critical"))
    return paths.join(flags, ["from_id", "to_id"]).orderBy(F.desc("critical"), "hops", "from_id", "to_id")


def expand_clusters(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Member nodes (id, label, level) and gene -has_variant-> member edges, instead of the cluster nodes."""
    each = clusters.select("gene", F.explode("members").alias("m")).select("gene", "m.variant", "m.level")
    nodes = each.select(F.concat(F.lit("variant:"), "variant").alias("id"), F.col("variant").alias("label"), "level").groupBy("id", "label").agg(F.min("level").alias("level"))
    return nodes, each.select(F.concat(F.lit("gene:"), "gene").alias("source"), F.concat(F.lit("variant:"), "variant").alias("target"), F.lit("has_variant").alias("type"), "level")


def expand_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with each variant cluster replaced by a node for every member, joined to the cluster's gene; edges of the
    clusters themselves are gone. Clusters without members stay."""
    gone = nodes.where("type = 'variant_cluster' AND size(members) > 0").select("id", "gene", "members")
    ids = cut(gone.select("id"), "gone")  # one a gene: few beside the edges, which then need no shuffle
    ids = small(ids, ids.count())
    parent = edges.where("type = 'has_variant'").groupBy(F.col("target").alias("id")).agg(F.max("source").alias("parent"))
    parent = cut(parent, "parents")
    each = gone.join(small(parent, parent.count()), "id", "left").select("parent", "gene", F.col("id").alias("cluster"), F.explode("members").alias("m")).withColumn("id", F.concat("cluster", F.lit("__"), "m.rsid"))
    fresh = each.select("id", F.col("m.rsid").alias("label"), F.lit("variant_cluster").alias("type"), "gene", F.col("m.level").alias("level"), F.array("m").alias("members"))
    kept = nodes.join(ids, "id", "left_anti")
    new_edges = each.where("parent IS NOT NULL").select(F.md5(F.concat_ws("|", "parent", F.lit("has_variant"), "id")).alias("id"), F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("has_variant").alias("type"), F.col("m.level").alias("level"))
    left = edges
    for end in ("source", "target"):
        left = left.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True), left.unionByName(new_edges, allowMissingColumns=True)
