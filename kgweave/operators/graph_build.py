"""Facts to a typed property graph. Order-dependent merges carry an explicit order, never the order of rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgweave.constants import DRUG_CLASSES, HIGH_EVIDENCE, MOST_PMIDS, SEED_CLASSES, SEED_TYPES
from kgweave.functions.columns import edge_type, fold_distinct, is_critical, level_rank, row_key, slug, split_cell
from kgweave.sources.shared import DENSE, cut, cut_parts, drop_cut, small


def node_id(kind: str, label: Column) -> Column:
    return slug(F.lit(kind), label)


def expand_facts(facts: DataFrame) -> DataFrame:
    """One row for each gene, chemical and phenotype of a fact (variant, gene, chemicals, phenotypes, role, level, ord).

    Genes and chemicals are split at ``,``, phenotypes at ``,`` or ``;`` and quotes stripped. Rows without gene or
    chemical are dropped; without phenotype the phenotype is null. The order goes on in sub-positions.
    """
    genes = facts.withColumn("_g", split_cell(F.col("gene"))).where("size(_g) > 0").select("*", F.posexplode("_g").alias("g_ord", "gene_name"))
    chems = genes.withColumn("_c", split_cell(F.col("chemicals"))).where("size(_c) > 0").select("*", F.posexplode("_c").alias("c_ord", "chemical"))
    phens = chems.select("*", F.posexplode_outer(split_cell(F.col("phenotypes"), "[,;]")).alias("p_ord", "phenotype"))
    return phens.drop("_g", "_c").withColumn("chemical", F.trim("chemical", F.lit('"'))).withColumn("phenotype", F.trim("phenotype", F.lit('"')))


def merge_nodes(rows: DataFrame, id_col: str, attributes: list[str], order: str) -> DataFrame:
    """First non-empty value of each attribute by order, per id."""
    return rows.groupBy(id_col).agg(*[F.min_by(a, F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(order))).alias(a) for a in attributes])


def merge_edges(rows: DataFrame, keys: list[str], level: str = "level", role: str = "role", critical: str = "critical", count: str = "n", order: str = "ord", gene: str | None = None) -> DataFrame:
    """Edge upsert: strongest level (first on ties), any critical, summed count, roles (and genes) folded in order.

    The fold drops a role that an earlier one contains as a substring. Distinct roles with their first place are
    collected, not all rows, so a hot edge stays small.
    """
    texts = [role, *([gene] if gene else [])]
    best = F.struct(level_rank(F.col(level)).alias("r"), F.col(order).alias("o"), F.col(level).alias("level"))
    # a hash before the keys: rows are sorted by a number, and texts are compared only where numbers agree
    base = rows.withColumn("_h", F.xxhash64(*keys)).groupBy("_h", *keys, *texts).agg(F.min(best).alias("_b"), F.max(critical).alias("_c"), F.sum(count).alias("_n"), F.min(order).alias("_o"))
    each = F.sort_array(F.collect_list(F.struct("_o", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts])))
    merged = base.groupBy("_h", *keys).agg(F.min("_b").alias("_b"), F.max("_c").alias("critical"), F.sum("_n").alias("n"), each.alias("_t"))
    fold = lambda c: F.when(F.size("_t") == 1, F.col("_t")[0][c]).otherwise(fold_distinct(F.transform("_t", lambda s: s[c]), ","))
    return merged.select(*keys, F.col("_b.level").alias("level"), "critical", "n", *[fold(c).alias(c) for c in texts])


def merged_around(rows: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``merge_edges`` those that touch one of a few nodes (node, ...), with the node's columns: once for each end that does.

    Ends are keys, so rows of other edges are left out before anything is joined or merged.
    """
    few = F.broadcast(nodes)
    around = lambda end: merge_edges(rows.join(few.select(F.col("node").alias(end)), end, "left_semi"), keys).join(few, F.col(end) == F.col("node"))
    return around("source").union(around("target"))


def fact_edges(facts: DataFrame) -> DataFrame:
    """chemical -> gene edge events of single-valued facts: source, target, type, level, role, critical, n, ord."""
    critical = is_critical(F.col("role"), F.col("level"))
    return facts.select(F.concat(F.lit("drug:"), F.col("chemical")).alias("source"), F.concat(F.lit("gene:"), F.col("gene")).alias("target"), edge_type(F.col("role"), F.col("level")).alias("type"), "level", "role", critical.alias("critical"), F.lit(1).cast("long").alias("n"), "ord")


def phenotype_edges(facts: DataFrame) -> DataFrame:
    """drug -can_trigger-> phenotype of critical facts, gene -associated_with-> phenotype of the others."""
    critical = is_critical(F.col("role"), F.col("level"))
    return facts.where(F.coalesce(F.col("phenotype"), F.lit("")) != "").select(
        F.when(critical, F.concat(F.lit("drug:"), F.col("chemical"))).otherwise(F.concat(F.lit("gene:"), F.col("gene"))).alias("source"), F.concat(F.lit("phenotype:"), F.col("phenotype")).alias("target"),
        F.when(critical, "can_trigger").otherwise("associated_with").alias("type"), "level", F.lit("").alias("role"), F.lit(False).alias("critical"), F.lit(1).cast("long").alias("n"), "ord",
    )


def class_edges(drugs: DataFrame, classes: DataFrame) -> DataFrame:
    """drug -belongs_to_class-> class; drugs: chemical; classes: chemical, drug_class (a dimension)."""
    return drugs.select("chemical").distinct().join(classes, "chemical").select(F.concat(F.lit("drug:"), F.col("chemical")).alias("source"), F.concat(F.lit("class:"), F.col("drug_class")).alias("target")).distinct()


def cluster_members(facts: DataFrame) -> DataFrame:
    """Best record of each (gene, variant): strongest level, first on ties; ``first`` is the variant's first place."""
    best = F.min_by(F.struct("level", "role", "chemical", "phenotype", "ord"), F.struct(level_rank(F.col("level")).alias("r"), F.col("ord").alias("o")))
    return facts.groupBy("gene", "variant").agg(best.alias("b"), F.min("ord").alias("first")).select("gene", "variant", "b.*", "first")


def clusters(members: DataFrame) -> DataFrame:
    """Per gene: label ``GENE variants (N)``, N, best level, and members in the order of their variants' first places."""
    m = F.sort_array(F.collect_list(F.struct("first", "variant", "level", "role", "chemical")))
    return members.groupBy("gene").agg(F.count("*").alias("n"), F.min_by("level", level_rank(F.col("level"))).alias("level"), m.alias("members")).withColumn("label", F.concat("gene", F.lit(" variants ("), F.col("n").cast("string"), F.lit(")")))


def critical_phenotypes(members: DataFrame) -> DataFrame:
    """gene, phenotype of critical members, distinct."""
    return members.where(is_critical(F.col("role"), F.col("level")) & (F.col("phenotype") != "")).select("gene", "phenotype").distinct()


def pmid_sets(relations: DataFrame, most: int = MOST_PMIDS, excluded: tuple[str, ...] = ("not associated", "ambiguous", "")) -> DataFrame:
    """lo, hi, pmids: per unordered pair the first ``most`` distinct identifiers, sorted as strings."""
    kept = relations.where(~F.lower(F.trim("association")).isin(*excluded)).where("entity1 <> entity2")
    pairs = kept.select(F.least("entity1", "entity2").alias("lo"), F.greatest("entity1", "entity2").alias("hi"), F.explode_outer(split_cell(F.col("pmids"), ";")).alias("pmid")).where("pmid IS NOT NULL")
    rows = pairs.select(F.xxhash64("lo", "hi").alias("_h"), "lo", "hi", "pmid").distinct()
    first = Window.partitionBy("_h", "lo", "hi").orderBy("pmid")
    return rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).groupBy("_h", "lo", "hi").agg(F.sort_array(F.collect_list("pmid")).alias("pmids")).drop("_h")


def attach_pmids(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Every parallel edge of a pair gets the pair's identifiers; others get none."""
    pair = edges.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target"))
    hashed = lambda df: df.withColumn("_h", F.xxhash64("lo", "hi"))
    return hashed(pair).join(hashed(sets), ["_h", "lo", "hi"], "left").drop("_h", "lo", "hi")


def seed_nodes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds that occur, and their neighbours: node."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source"))
    touched = both.join(seeds.select(F.col("node").alias("a")), "a", "left_semi")
    return touched.select(F.col("a").alias("node")).union(touched.select("b")).distinct()


def search_index(nodes: DataFrame) -> DataFrame:
    """id, label, type, alt by type and lower-cased label."""
    return nodes.select("id", "label", "type", "alt").orderBy("type", F.lower("label"), "id")


def numbered(rows: DataFrame, order: list[Column | str], name: str = "place", parts: int | None = None) -> DataFrame:
    """``rows`` with their place from 1 in an order over all of them.

    Ranges of the order are sorted and written with each row's place in its range; the sizes of the ranges, one number
    each, are added up. No task has more than a range, and equal rows are numbered in any order.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")  # the range in the upper bits, the place in it in the lower 33
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # a row a range
        offsets.append((r["p"], before))
        before += r["n"]
    table = spark.createDataFrame(offsets, "_p long, _before long")
    return held.join(small(table, len(offsets)), part == F.col("_p")).withColumn(name, F.col("_before") + inside + 1).drop("_at", "_p", "_before")


def alias_dimension(drugs: DataFrame) -> DataFrame:
    """name, target: primary names win over aliases; of primary rows the last, of aliases the first (drugs: name, aliases, target, ord)."""
    primary = drugs.select(F.lower(F.trim("name")).alias("name"), F.col("target"), F.lit(0).alias("kind"), (-F.col("ord")).alias("o"))
    alias = drugs.select(F.explode(split_cell(F.col("aliases"))).alias("name"), "target", F.lit(1).alias("kind"), F.col("ord").alias("o")).withColumn("name", F.lower("name"))
    return primary.unionByName(alias).where("name <> ''").groupBy("name").agg(F.min_by("target", F.struct("kind", "o", "target")).alias("target"))


def holdout(facts: DataFrame, key_columns: list[str], share: float = 0.30, seed: int = 42) -> DataFrame:
    """row_key of the held-out high-evidence rows: round-half-even(share * n) of them in an order seeded by md5."""
    keyed = facts.where(F.col("level").isin(*HIGH_EVIDENCE)).select(row_key(*[F.col(c).cast("string") for c in key_columns]).alias("row_key")).distinct()
    hashed = cut(keyed.withColumn("h", F.md5(F.concat(F.lit(str(seed)), F.lit("|"), "row_key"))), "hashed")  # read three times
    # the k smallest hashes without a global sort: whole ranges of the first four digits, then part of one range
    bins = hashed.groupBy(F.substring("h", 1, 4).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()  # 65,536 rows at most
    left = round(sum(r["n"] for r in bins) * share)
    edge = ""
    for r in bins:
        edge = r["bin"]
        if r["n"] > left:
            break
        left -= r["n"]
    else:
        return hashed.select("row_key")
    whole = hashed.where(F.substring("h", 1, 4) < edge).select("row_key")
    return whole.union(hashed.where(F.substring("h", 1, 4) == edge).orderBy("h", "row_key").limit(left).select("row_key"))


def held_facts(facts: DataFrame, held: DataFrame, key_columns: list[str], seed: int = 42) -> DataFrame:
    """The facts whose key is in ``held`` (row_key). ``holdout`` draws keys by their hashes, so of its keys (same seed) most facts
    need no join: those beyond the greatest hash that was drawn."""
    hashed = lambda df: F.md5(F.concat(F.lit(str(seed)), F.lit("|"), df))
    last = held.agg(F.max(hashed(F.col("row_key")))).first()[0]
    keyed = facts.withColumn("row_key", row_key(*[F.col(c).cast("string") for c in key_columns]))
    return keyed.where(hashed(F.col("row_key")) <= F.lit(last)).join(held.select("row_key"), "row_key", "left_semi").drop("row_key")


def exclude(facts: DataFrame, held: DataFrame, key_columns: list[str]) -> DataFrame:
    return facts.withColumn("row_key", row_key(*[F.col(c).cast("string") for c in key_columns])).join(held, "row_key", "left_anti").drop("row_key")


# from raw tables to one graph


def dimension(rows: DataFrame, name: str, columns: dict[str, str], flags: dict[str, str] | None = None, upper: bool = False, order: str = "ord") -> DataFrame:
    """key and attributes of a reference table: trimmed cells, flags from ``yes``, of rows with one key the last (by ``order``).

    columns: attribute -> column; key: the trimmed name in one case. Rows without a name are dropped.
    """
    label = F.trim(F.coalesce(F.col(name), F.lit("")))
    each = rows.where(label != "").select(
        (F.upper if upper else F.lower)(label).alias("key"), label.alias("name"), *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(a) for a, c in columns.items()],
        *[(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) == "yes").alias(a) for a, c in (flags or {}).items()], F.col(order).alias("_o"),
    )
    attributes = [c for c in each.columns if c not in ("key", "_o")]
    return each.groupBy("key").agg(F.max_by(F.struct(*attributes), "_o").alias("a")).select("key", "a.*")


def named_drugs(rows: DataFrame, name: str, aliases: str, columns: dict[str, str], order: str = "ord") -> DataFrame:
    """key and attributes of drugs by name and alias: a name wins over aliases; of names the last row, of aliases the first."""
    label = F.trim(F.coalesce(F.col(name), F.lit("")))
    each = rows.where(label != "").select(F.struct(label.alias("name"), *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(a) for a, c in columns.items()]).alias("a"), F.col(aliases).alias("_x"), F.col(order).alias("_o"))
    unquoted = lambda c: F.trim(F.trim(F.coalesce(c, F.lit("")), F.lit('"')))
    names = each.select(F.lower("a.name").alias("key"), "a", F.lit(0).alias("kind"), (-F.col("_o")).alias("o"))
    more = each.select(F.explode(split_cell(unquoted(F.col("_x")))).alias("key"), "a", F.lit(1).alias("kind"), F.col("_o").alias("o")).withColumn("key", F.lower(unquoted(F.col("key")))).where("key <> ''")
    return names.unionByName(more).groupBy("key").agg(F.min_by("a", F.struct("kind", "o")).alias("a")).select("key", "a.*")


def class_table(spark, classes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:  # noqa: ANN001
    """class, member: the curated drug classes."""
    return spark.createDataFrame([(c, m) for c, members in (classes or DRUG_CLASSES).items() for m in members], "class string, member string")


def occurrences(facts: DataFrame) -> DataFrame:
    """One row for each gene and chemical of a fact, with its variants and phenotypes as arrays and a total order.

    facts: variant, gene, type, level, chemicals, phenotypes, ord. Genes and variants are divided at ``,`` and ``;``,
    chemicals and phenotypes at ``,`` with outer quotes stripped. Facts without gene, variant or chemical cells are
    dropped. A fact whose chemical cell holds no name has one row without chemical.
    """
    cell = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    unquoted = lambda c: F.trim(cell(c), F.lit('"'))
    rows = facts.where((cell("gene") != "") & (cell("variant") != "") & (cell("chemicals") != "")).select(
        "ord", cell("type").alias("role"), cell("level").alias("level"), F.transform(split_cell(F.col("gene"), "[,;]"), F.upper).alias("genes"),
        split_cell(F.col("variant"), "[,;]").alias("variants"), split_cell(unquoted("chemicals")).alias("chems"), split_cell(unquoted("phenotypes")).alias("phens"),
    )
    # an inner explode would make the cells a second and a third time, to drop rows without any before it
    genes = rows.select("*", F.posexplode_outer("genes").alias("g", "gene")).where("gene IS NOT NULL")
    return genes.select("ord", "g", F.posexplode_outer("chems").alias("c", "chemical"), "gene", "role", "level", "variants", "phens", is_critical(F.col("role"), F.col("level")).alias("critical"))


def build_graph(facts: DataFrame, genes: DataFrame, drugs: DataFrame, phenotypes: DataFrame, classes: DataFrame, relations: DataFrame, most: int = MOST_PMIDS) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of one property graph.

    facts: as in ``occurrences`` (held-out ones excluded before). genes: ``dimension`` with fullName, pharmgkb_id,
    chromosome, is_vip by upper-case key; drugs: ``named_drugs`` with pharmgkb_id, atc, top_level; phenotypes:
    ``dimension`` with pharmgkb_id, xref. classes: class, member. relations: entity1, type1, entity2, type2,
    association, pmids. Every class becomes a node, used or not.

    Nodes take the first label, and of each attribute the first value that is not empty; edges of one source, target and
    type are one, with the strongest level, roles and genes folded in order. An edge's id is a hash of its ends and
    type. Every step is a join or an aggregation on node or edge ids; nothing is collected.
    """
    seen, best = read_facts(facts)
    nodes = build_nodes(seen, best, genes, drugs, phenotypes, classes)
    return nodes, build_edges(seen, best, classes, relations, most)


def read_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What nodes and edges are made of, both written: ``occurrences`` with gene_id and drug_id, and of each gene and variant
    the record of strongest level (phens of critical ones), its first place and the gene's name there."""
    drug_id = F.when(F.col("chemical").isNotNull(), slug(F.lit("drug"), F.col("chemical")))
    seen = cut(occurrences(facts).select("*", slug(F.lit("gene"), F.col("gene")).alias("gene_id"), drug_id.alias("drug_id")), "occurrences", DENSE)
    record = F.struct("level", "role", "chemical", F.when(F.col("critical"), F.col("phens")).alias("phens")).alias("m")
    each = seen.where("chemical IS NOT NULL").select("gene_id", "gene", "level", "role", "chemical", "phens", "critical", "ord", "g", "c", F.posexplode_outer("variants").alias("v", "rsid")).where("rsid IS NOT NULL")
    member = each.select(F.xxhash64("gene_id", "rsid").alias("_h"), "gene_id", "gene", "rsid", record, level_rank(F.col("level")).alias("rank"), F.struct("ord", "g", "c", "v").alias("o"))
    best = member.groupBy("_h", "gene_id", "rsid").agg(F.min_by("m", F.struct("rank", "o")).alias("m"), F.min(F.struct("o", "gene")).alias("named"))
    return seen, cut(best.select("gene_id", "rsid", "m.*", "named.*"), "members", DENSE)


def gene_clusters(best: DataFrame) -> DataFrame:
    """gene_id, gene, n, level and members of each gene with variants, from the records of ``read_facts``."""
    per = best.groupBy("gene_id").agg(
        F.min(F.struct("o", "gene")).alias("named"), F.count("*").alias("n"), F.min_by("level", F.when(F.col("level") != "", level_rank(F.col("level")))).alias("level"),
        F.transform(F.sort_array(F.collect_list(F.struct("o.*", "rsid", "level", "role", "chemical"))), lambda x: F.struct(x["rsid"].alias("rsid"), x["level"].alias("level"), x["role"].alias("role"), x["chemical"].alias("chemical"))).alias("members"),
    )
    return per.select("gene_id", F.col("named.gene").alias("gene"), "n", F.coalesce("level", F.lit("")).alias("level"), "members")


def cluster_id(gene_id: Column) -> Column:
    return slug(F.lit("vcluster"), gene_id)


def build_nodes(seen: DataFrame, best: DataFrame, genes: DataFrame, drugs: DataFrame, phenotypes: DataFrame, classes: DataFrame) -> DataFrame:
    """The nodes of ``build_graph``, written; seen and best as from ``read_facts``."""
    chems = seen.where("chemical IS NOT NULL")
    gene_id, drug_id, phen_id = (lambda c, k=k: slug(F.lit(k), c) for k in ("gene", "drug", "phen"))
    place = lambda i, j: F.struct("ord", "g", F.coalesce("c", F.lit(-1)).alias("c"), F.lit(i).alias("step"), j.alias("sub")).alias("o")
    none = F.lit(None).cast("string")
    zero = F.lit(0)

    def rows(df: DataFrame, kind: str, node: Column, label: Column, order: Column, **extra: Column) -> DataFrame:
        more = {"fullName": none, "pharmgkb_id": none, "chromosome": none, "is_vip": F.lit(None).cast("boolean"), "atc": none, "top_level": none, "gene": none, "level": none, "xref": none, "description": none} | extra
        return df.select(node.alias("id"), label.alias("label"), F.lit(kind).alias("type"), order, *[c.alias(a) for a, c in more.items()])

    first = lambda df, c: df.groupBy(c).agg(F.min("o").alias("o"))
    g = first(seen.select("gene", place(0, zero)), "gene").join(genes.withColumnRenamed("key", "gene"), "gene", "left")
    p = first(seen.select(F.posexplode("phens").alias("sub", "phen"), "ord", "g", "c").select("phen", place(1, F.col("sub"))), "phen").withColumn("key", F.lower("phen")).join(phenotypes, "key", "left")
    c = first(chems.select("chemical", place(2, zero)), "chemical").withColumn("key", F.lower("chemical")).join(drugs, "key", "left")
    node_rows = [
        rows(g, "gene", gene_id(F.col("gene")), F.col("gene"), F.col("o"), fullName=F.coalesce("fullName", "gene"), pharmgkb_id=F.col("pharmgkb_id"), chromosome=F.col("chromosome"), is_vip=F.coalesce("is_vip", F.lit(False))),
        rows(p, "phenotype", phen_id(F.col("phen")), F.col("phen"), F.col("o"), pharmgkb_id=F.col("pharmgkb_id"), xref=F.col("xref")),
        rows(c, "drug", drug_id(F.col("chemical")), F.col("chemical"), F.col("o"), pharmgkb_id=F.col("pharmgkb_id"), atc=F.col("atc"), top_level=F.col("top_level")),
    ]
    every = node_rows[0].unionByName(node_rows[1]).unionByName(node_rows[2])
    filled = lambda a: F.coalesce(F.col(a).cast("string"), F.lit("")) != ""
    attributes = [a for a in every.columns if a not in ("id", "label", "type", "o")]
    merged = every.groupBy("id").agg(F.min_by("label", "o").alias("label"), F.min_by("type", "o").alias("type"), *[F.max(a).alias(a) if a == "is_vip" else F.min_by(a, F.when(filled(a), F.col("o"))).alias(a) for a in attributes])
    # of a node that has the attribute at all an empty value stays empty, not null
    had = {"gene": ("pharmgkb_id", "chromosome", "fullName"), "phenotype": ("pharmgkb_id", "xref"), "drug": ("pharmgkb_id", "atc", "top_level")}
    for a in {x for v in had.values() for x in v}:
        merged = merged.withColumn(a, F.when(F.col("type").isin(*[k for k, v in had.items() if a in v]), F.coalesce(a, F.lit(""))).otherwise(F.col(a)))
    named = classes.select("class").distinct()
    class_nodes = rows(named, "drug_class", slug(F.lit("class"), F.col("class")), F.col("class"), F.lit(None).alias("o"), description=F.concat(F.lit("Drug class: "), "class")).drop("o")

    per = gene_clusters(best)
    label = F.concat("gene", F.lit(" variants ("), F.col("n").cast("string"), F.lit(")"))
    members_type = per.schema["members"].dataType
    cluster_nodes = rows(per.withColumn("_l", label), "variant_cluster", cluster_id(F.col("gene_id")), F.col("_l"), F.lit(None).alias("o"), gene=F.col("gene"), level=F.col("level"), members=F.col("members")).drop("o")
    plain = merged.unionByName(class_nodes).withColumn("members", F.lit(None).cast(members_type))
    return cut(plain.unionByName(cluster_nodes), "nodes", DENSE)


def build_edges(seen: DataFrame, best: DataFrame, classes: DataFrame, relations: DataFrame, most: int = MOST_PMIDS, spend: bool = False) -> DataFrame:
    """The edges of ``build_graph``, written; seen and best as from ``read_facts``. spend: these are deleted once they are read.

    Relations of names that are no node need no filter: no edge has them as its ends. Edges of different types never merge,
    so those of genes, drugs and phenotypes are folded one kind after another, each with the disk to itself.
    """
    chems = seen.where("chemical IS NOT NULL")
    none, zero = F.lit(None).cast("string"), F.lit(0)

    def events(df: DataFrame, source: Column, target: Column, kind: Column, level: Column = none, role: Column = none, critical: Column | None = None, n: Column | None = None, gene: Column = none, order: Column | None = None) -> DataFrame:
        return df.select(
            source.alias("source"), target.alias("target"), kind.alias("type"), level.alias("level"), role.alias("role"), (F.lit(None).cast("boolean") if critical is None else critical).alias("critical"),
            (F.lit(None).cast("long") if n is None else n.cast("long")).alias("n"), gene.alias("gene"), order if order is not None else F.lit(None).alias("ord"),
        )

    # of a class the drug's name alone matters, so each name is looked up once
    class_ids = classes.select("class").distinct().select("class", slug(F.lit("class"), F.col("class")).alias("class_id"))  # a class has many members
    names = chems.select("chemical", "drug_id").distinct().withColumn("member", F.lower("chemical"))
    to_class = names.join(classes.select(F.lower("member").alias("member"), "class").join(class_ids, "class"), "member").select("drug_id", "class_id").distinct()
    at = lambda j: F.struct("ord", "g", "c", j.alias("sub")).alias("ord")
    each_phen = chems.select("ord", "g", "c", "gene", "gene_id", "drug_id", "role", "level", "critical", F.posexplode("phens").alias("sub", "phen"))
    key = F.col("critical")
    drug, gene, phen = F.col("drug_id"), F.col("gene_id"), slug(F.lit("phen"), F.col("phen"))
    belongs = events(to_class, drug, F.col("class_id"), F.lit("belongs_to_class")).drop("ord")
    clustered = events(gene_clusters(best), F.col("gene_id"), cluster_id(F.col("gene_id")), F.lit("has_variant"), F.col("level"), n=F.col("n")).drop("ord")
    risky = best.where(is_critical(F.col("role"), F.col("level"))).select("gene_id", F.explode("phens").alias("phen")).select(cluster_id(F.col("gene_id")).alias("source"), phen.alias("target")).distinct()
    risks = events(risky, F.col("source"), F.col("target"), F.lit("linked_to_risk"), critical=F.lit(True)).drop("ord")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    fold = lambda raw: merge_edges(raw, ["source", "target", "type"], gene="gene").select("source", "target", "type", "level", blank("role").alias("role"), "critical", "n", blank("gene").alias("gene"))

    def finished(edges: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        found = edges.withColumn("pmids", F.lit(None).cast("array<string>")) if sets is None else attach_pmids(edges, sets)
        return found.select(F.md5(F.concat_ws("|", "source", "type", "target")).alias("id"), "source", "target", "type", "level", "role", "critical", F.col("n").alias("count"), "gene", "pmids")

    def parts() -> Iterator[DataFrame]:
        for rest in (belongs, clustered, risks):  # of classes and clusters, which no relation names
            yield finished(rest)
        if spend:
            drop_cut(best)
        sets = cut(pmid_sets(entity_ids(relations), most), "sets", DENSE)
        of_phen = cut(sets.where(F.startswith("lo", F.lit("phen")) | F.startswith("hi", F.lit("phen"))), "sets")
        kinds = (
            (events(each_phen.where(key), drug, phen, F.lit("can_trigger"), F.col("level"), gene=F.col("gene"), order=at(F.col("sub"))), of_phen),
            (events(each_phen.where(~key), gene, phen, F.lit("associated_with"), F.col("level"), F.col("role"), order=at(F.col("sub"))), of_phen),
            (events(chems, drug, gene, edge_type(F.col("role"), F.col("level")), F.col("level"), F.col("role"), key, order=at(zero)), sets),
        )
        for raw, own in kinds:
            if own.isEmpty():  # as a rule relations name no phenotypes
                yield finished(fold(raw))
                continue
            folded = cut(fold(raw), "folded", DENSE)
            yield finished(folded, own)
            drop_cut(folded)
        drop_cut(sets, of_phen, *([seen] if spend else []))

    return cut_parts(parts(), "edges", DENSE)


def touched(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ord and node of all that a fact makes: its genes, drugs, phenotypes and clusters; and id of the edges between them."""
    seen = cut(occurrences(facts), "touched")
    gene, drug = slug(F.lit("gene"), F.col("gene")), F.when(F.col("chemical").isNotNull(), slug(F.lit("drug"), F.col("chemical")))
    ids = F.concat(F.array(gene, slug(F.lit("vcluster"), gene), drug), F.transform("phens", lambda p: slug(F.lit("phen"), p)))
    nodes = seen.select("ord", F.explode(F.array_compact(ids)).alias("node")).distinct()
    each = seen.where("chemical IS NOT NULL").select(gene.alias("g"), drug.alias("d"), F.transform("phens", lambda p: slug(F.lit("phen"), p)).alias("ps"), edge_type(F.col("role"), F.col("level")).alias("kind"), F.lower("chemical").alias("member"))
    key = lambda source, kind, target: F.md5(F.concat_ws("|", source, kind, target))
    made = F.concat(
        F.array(key(F.col("d"), F.col("kind"), F.col("g"))), F.transform("ps", lambda p: key(F.col("d"), F.lit("can_trigger"), p)), F.transform("ps", lambda p: key(F.col("g"), F.lit("associated_with"), p)),
    )
    return nodes, each.select("d", "member", F.explode(made).alias("id"))


def reduced_graph(nodes: DataFrame, edges: DataFrame, facts: DataFrame, held: DataFrame, key_columns: list[str], genes: DataFrame, drugs: DataFrame, phenotypes: DataFrame, classes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes and edges of the graph without the held-out facts (row_key), made from those of the whole graph; and the facts read for it.

    What a held-out fact touched is made again from the facts left that touch it too; everything else is as it was. All
    facts that mention a node or pair of nodes are among these, so the result is that of a full build. Edges of a touched
    cluster all count as touched, since another fact can come first for one of its members. facts: ``ord`` names a fact.
    """
    keyed = facts.withColumn("row_key", row_key(*[F.col(c).cast("string") for c in key_columns]))
    gone = held_facts(facts, held, key_columns)
    left = cut(keyed.join(held.select("row_key"), "row_key", "left_anti").drop("row_key"), "left")
    gone_nodes, gone_edges = touched(gone)
    changed = cut(gone_nodes.select(F.col("node").alias("id")).distinct(), "changed")
    to_class = gone_edges.select("d", "member").distinct().join(classes.select(F.lower("member").alias("member"), "class"), "member").select(F.md5(F.concat_ws("|", "d", F.lit("belongs_to_class"), slug(F.lit("class"), F.col("class")))).alias("id"))
    clusters_ = changed.where(F.startswith("id", F.lit("vcluster_"))).select(F.col("id").alias("end"))
    of_clusters = lambda e: e.select("id", F.explode(F.array("source", "target")).alias("end")).join(clusters_, "end", "left_semi").select("id")
    keys = gone_edges.select("id").union(to_class)
    again = left.join(touched(left)[0].join(changed.withColumnRenamed("id", "node"), "node", "left_semi").select("ord").distinct(), "ord", "left_semi")
    again = cut(again.select(*facts.columns), "again")
    new_nodes, new_edges = build_graph(again, genes, drugs, phenotypes, classes, relations)
    # of either build the edges that are made anew
    anew = cut(keys.union(of_clusters(edges)).union(of_clusters(new_edges)).distinct(), "anew")
    out_nodes = nodes.join(changed, "id", "left_anti").unionByName(new_nodes.join(changed, "id", "left_semi"))
    return out_nodes, edges.join(anew, "id", "left_anti").unionByName(new_edges.join(anew, "id", "left_semi")), again


def entity_ids(relations: DataFrame) -> DataFrame:
    """relations between two different names: entity1, entity2 (ids), association, pmids. Entities of other types are dropped."""
    kinds = {"Gene": "gene", "Chemical": "drug", "Disease": "phen"}
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))

    def node(i: int) -> Column:
        prefix = functools.reduce(lambda c, k: c.when(trimmed(f"type{i}") == k, kinds[k]), list(kinds)[1:], F.when(trimmed(f"type{i}") == "Gene", kinds["Gene"]))
        name = F.when(trimmed(f"type{i}") == "Gene", F.upper(trimmed(f"entity{i}"))).otherwise(trimmed(f"entity{i}"))
        return F.when(trimmed(f"type{i}").isin(*kinds), slug(prefix, name))

    # made in a generated row, so that the filter does not make the ids a second time
    both = F.explode(F.array(F.struct(node(1).alias("entity1"), node(2).alias("entity2")))).alias("e")
    return relations.select(both, "association", "pmids").select("e.*", "association", "pmids").where("entity1 <> entity2")


def entity_pairs(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``entity_ids`` of which both are nodes."""
    mapped = entity_ids(relations)
    for c in ("entity1", "entity2"):
        mapped = mapped.join(nodes.select(F.col("id").alias(c)), c, "left_semi")
    return mapped


def seed_graph(nodes: DataFrame, edges: DataFrame, classes: DataFrame, seed_classes: tuple[str, ...] = SEED_CLASSES) -> tuple[DataFrame, DataFrame]:
    """The view around the drugs of some classes: these drugs and classes, genes and phenotypes that an edge joins with a
    drug, clusters of these genes, and all edges between them."""
    kinds = nodes.select("id", "type")
    drugs = classes.where(F.col("class").isin(*seed_classes)).select(slug(F.lit("drug"), F.col("member")).alias("id")).distinct().join(kinds.select("id"), "id", "left_semi")
    drugs = cut(drugs, "seeds")
    own = classes.where(F.col("class").isin(*seed_classes)).select(slug(F.lit("class"), F.col("class")).alias("id")).distinct()
    near = edges.where(F.col("type").isin(*SEED_TYPES))
    ends = near.select(F.col("source").alias("id"), F.col("target").alias("other")).union(near.select("target", "source"))
    reached = ends.join(small(drugs, drugs.count()), "id", "left_semi").select(F.col("other").alias("id")).distinct().join(kinds, "id")
    genes = cut(reached.where("type = 'gene'").select("id"), "genes")
    phens = reached.where("type = 'phenotype'").select("id")
    clusters_ = edges.where("type = 'has_variant'").join(small(genes, genes.count()).withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id")).join(kinds.where("type = 'variant_cluster'").select("id"), "id", "left_semi")
    keep = cut(drugs.union(own).union(genes).union(phens).union(clusters_).distinct(), "seed")
    keep = small(keep, keep.count())  # where they are few, neither nodes nor edges are shuffled
    both = edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(keep, "id", "left_semi"), both.select(edges.columns)
