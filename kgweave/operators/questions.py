"""Question sets: templates over facts and relations in eight strata, with gold answers.

Shuffles are orders by md5 of a seed and the row's key, so a set can be repeated, also in SQL. A stratum has its first
``n`` candidates in that order. facts: variant, gene, type, level, chemicals, phenotypes, ord, all as raw cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgweave.constants import HIGH_EVIDENCE, MOST_CHUNK_PMIDS, OOD_NAMES, STRATA
from kgweave.functions.columns import row_key, split_cell

SEED = 7
GOLD = (
    "struct<entities:array<string>,evidence_level:string,evidence_levels:map<string,string>,pmids:array<string>,drug_class:string,cv_type:string,"
    "should_refuse:boolean,expected_negative:boolean,answer_summary:string>"
)
KEY = ("variant", "gene", "type", "level", "chemicals", "phenotypes")


def cell(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def first_gene(name: str = "gene") -> Column:
    """The first of a list of genes, upper case."""
    return F.upper(F.trim(F.split_part(cell(name), F.lit(","), F.lit(1))))


def names(name: str) -> Column:
    """The names of a cell divided at ``,`` and ``;``, outer quotes stripped."""
    return split_cell(F.trim(cell(name), F.lit('"')), "[,;]")


def first_class(rows: DataFrame, classes: DataFrame, chemicals: str = "_drugs") -> DataFrame:
    """``rows`` with _class: the class of the first of their chemicals that has one, case ignored (of several the greater);
    rows without one are dropped. Each list of chemicals is looked up once, by a join. classes: class, member."""
    of = classes.groupBy(F.lower("member").alias("_m")).agg(F.max("class").alias("_c"))
    each = rows.select(chemicals).distinct().select(chemicals, F.posexplode(chemicals).alias("_p", "_d"))
    found = each.join(of, F.lower("_d") == F.col("_m")).groupBy(chemicals).agg(F.min_by("_c", "_p").alias("_class"))
    return rows.join(found, chemicals)


def shuffled(rows: DataFrame, stratum: str, key: Column, seed: int = SEED) -> DataFrame:
    return rows.withColumn("_key", key).withColumn("_h", F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.lit(stratum), F.col("_key"))))


def drawn(rows: DataFrame, stratum: str, n: int, order: tuple[str, ...], question: Column, template: str, source: Column, gold: dict[str, Column]) -> DataFrame:
    """id, stratum, question, template, source_row_hash, gold of the first ``n`` rows by ``order``."""
    top = rows.orderBy(*order).limit(n)
    place = F.row_number().over(Window.orderBy(*order))  # of n rows
    fields = [f.split(":")[0] for f in GOLD.removeprefix("struct<").replace("array<string>", "a").replace("map<string,string>", "m").removesuffix(">").split(",")]
    full = {"should_refuse": F.lit(False)} | gold
    packed = F.struct(*[full.get(f, F.lit(None)).alias(f) for f in fields]).cast(GOLD)
    return top.select(F.concat(F.lit(f"{stratum}-"), F.lpad(place.cast("string"), 3, "0")).alias("id"), F.lit(stratum).alias("stratum"), question.alias("question"), F.lit(template).alias("template"), source.alias("source_row_hash"), packed.alias("gold"))


def _prepared(facts: DataFrame, stratum: str) -> DataFrame:
    rows = facts.withColumns({"_gene": first_gene(), "_drugs": names("chemicals"), "_phens": names("phenotypes"), "_level": cell("level"), "_type": cell("type"), "_variant": F.trim(F.split_part(cell("variant"), F.lit(","), F.lit(1)))})
    rows = shuffled(rows, stratum, row_key(*[F.col(c) for c in KEY]))
    return rows.withColumn("_drug", F.try_element_at("_drugs", F.lit(1))).withColumn("_phen", F.try_element_at("_phens", F.lit(1)))


ORDER = ("_h", "_key", "ord")


def wellknown(facts: DataFrame, n: int = STRATA["S1"]) -> DataFrame:
    """S1: the gene of a phenotype."""
    rows = _prepared(facts, "S1").where("_phen IS NOT NULL AND _gene <> ''")
    ask = F.concat(F.lit("Which gene is most strongly associated with "), "_phen", F.lit(" in pharmacogenomic guidelines?"))
    return drawn(rows, "S1", n, ORDER, ask, "s1_phen_to_gene", F.col("_key"), {"entities": F.array("_gene", "_phen"), "answer_summary": F.concat("_gene", F.lit(" is the most strongly associated gene."))})


def evidence_level(facts: DataFrame, n: int = STRATA["S2"]) -> DataFrame:
    """S2: the evidence level of a drug and a gene."""
    rows = _prepared(facts, "S2").where("_drug IS NOT NULL AND _gene <> '' AND _level <> ''")
    ask = F.concat(F.lit("In PharmGKB's clinical guidelines, what is the evidence level for the "), "_drug", F.lit(" × "), "_gene", F.lit(" association"), F.coalesce(F.concat(F.lit(" for "), "_phen"), F.lit("")), F.lit("?"))
    entities = F.filter(F.array("_drug", "_gene", "_phen"), lambda e: e.isNotNull())
    return drawn(rows, "S2", n, ORDER, ask, "s2_evidence_level", F.col("_key"), {"entities": entities, "evidence_level": F.col("_level"), "answer_summary": F.concat(F.lit("Evidence level "), "_level", F.lit("."))})


def multihop(facts: DataFrame, classes: DataFrame, n: int = STRATA["S3"]) -> DataFrame:
    """S3: from a variant through gene and drug to the drug's class."""
    rows = first_class(_prepared(facts, "S3").where("_variant <> '' AND _gene <> ''"), classes)
    act = F.when(F.contains("_type", F.lit("Toxicity")), "should be avoided").otherwise("may require dose adjustment")
    ask = F.concat(F.lit("A patient is found to carry the "), "_variant", F.lit(" variant in "), "_gene", F.lit(". Which class of medications "), act, F.lit(", and why?"))
    gold = {"entities": F.concat(F.array("_variant", "_gene", "_class"), F.slice("_drugs", 1, 3)), "drug_class": F.col("_class"), "answer_summary": F.concat("_class", F.lit(" "), act, F.lit(" because of the "), "_gene", F.lit(" variant."))}
    return drawn(rows, "S3", n, ORDER, ask, "s3_variant_to_class", F.col("_key"), gold)


def pair_pmids(relations: DataFrame) -> DataFrame:
    """drug (lower case), gene (upper case), pmids: distinct, in order of relations, of ``associated`` chemicals and genes.

    relations: entity1, type1, entity2, type2, association, pmids, ord.
    """
    kind = [F.lower(cell(f"type{i}")) for i in (1, 2)]
    chemical_first = (kind[0] == "chemical") & (kind[1] == "gene")
    gene_first = (kind[0] == "gene") & (kind[1] == "chemical")
    kept = relations.where((F.lower(cell("association")) == "associated") & (chemical_first | gene_first))
    each = kept.select(
        F.lower(F.when(chemical_first, cell("entity1")).otherwise(cell("entity2"))).alias("drug"), F.upper(F.when(chemical_first, cell("entity2")).otherwise(cell("entity1"))).alias("gene"), "ord", F.posexplode(split_cell(F.col("pmids"), "[,;]")).alias("p", "pmid")
    )
    first = each.groupBy("drug", "gene", "pmid").agg(F.min(F.struct("ord", "p")).alias("at"))
    return first.groupBy("drug", "gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "pmid"))), lambda s: s["pmid"]).alias("pmids"))


def citation(facts: DataFrame, pmids: DataFrame, n: int = STRATA["S4"]) -> DataFrame:
    """S4: a reference for a drug and a gene; pmids: of ``pair_pmids``."""
    rows = _prepared(facts, "S4").where("_drug IS NOT NULL AND _gene <> ''")
    rows = rows.withColumn("_low", F.lower("_drug")).join(pmids.select(F.col("drug").alias("_low"), F.col("gene").alias("_gene"), "pmids"), ["_low", "_gene"])
    ask = F.concat(F.lit("Cite a primary research reference (PMID) supporting the "), "_drug", F.lit(" × "), "_gene", F.lit(" pharmacogenomic association."))
    gold = {"entities": F.array("_drug", "_gene"), "pmids": F.slice("pmids", 1, MOST_CHUNK_PMIDS), "answer_summary": F.concat(F.lit("Any PMID from the curated list supporting "), "_drug", F.lit(" × "), "_gene", F.lit("."))}
    return drawn(rows, "S4", n, ORDER, ask, "s4_citation", F.col("_key"), gold)


def longtail(facts: DataFrame, every: DataFrame, n: int = STRATA["S5"]) -> DataFrame:
    """S5: drugs or genes that are rare in ``every`` fact, the rarest first; unknown ones count as 99."""
    rows = _prepared(facts, "S5").where("_drug IS NOT NULL AND _gene <> ''")
    drugs = every.select(F.explode(names("chemicals")).alias("d")).groupBy(F.lower("d").alias("_low")).agg(F.count("*").alias("_df"))
    genes = every.select(F.explode(names("gene")).alias("g")).groupBy(F.upper("g").alias("_gene")).agg(F.count("*").alias("_gf"))
    scored = rows.withColumn("_low", F.lower("_drug")).join(drugs, "_low", "left").join(genes, "_gene", "left").withColumn("_s", F.least(F.coalesce("_df", F.lit(99)), F.coalesce("_gf", F.lit(99))))
    ask = F.concat(F.lit("What pharmacogenomic relationship has PharmGKB documented between "), "_drug", F.lit(" and "), "_gene", F.lit("? Be specific about the type (metabolism/efficacy/toxicity)."))
    summary = F.concat(F.lit("PharmGKB documents a "), F.when(F.coalesce("type", F.lit("")) == "", "pharmacogenomic").otherwise(F.col("type")), F.lit(" relationship."))
    return drawn(scored, "S5", n, ("_s", "ord"), ask, "s5_longtail_drug_gene", F.col("_key"), {"entities": F.array("_drug", "_gene"), "evidence_level": F.col("_level"), "cv_type": F.col("_type"), "answer_summary": summary})


def negative_pairs(relations: DataFrame, most: int | None = None) -> DataFrame:
    """drug, gene of the relations between a chemical and a gene that are not associated or ambiguous; of the first ``most`` by ord, if it is given."""
    kind = [F.lower(cell(f"type{i}")) for i in (1, 2)]
    kept = relations.where(F.lower(cell("association")).isin("not associated", "ambiguous") & (F.array_sort(F.array(*kind)) == F.array(F.lit("chemical"), F.lit("gene"))))
    if most is not None:
        kept = kept.orderBy("ord").limit(most)
    chemical_first = kind[0] == "chemical"
    return kept.select("ord", F.when(chemical_first, cell("entity1")).otherwise(cell("entity2")).alias("drug"), F.upper(F.when(chemical_first, cell("entity2")).otherwise(cell("entity1"))).alias("gene"))


def negative(relations: DataFrame, n: int = STRATA["S6"], most: int | None = None) -> DataFrame:
    """S6: pairs without an association; most: as in ``negative_pairs``."""
    source = F.concat(F.lit("NEG|"), F.lower("drug"), F.lit("|"), F.col("gene"))
    rows = shuffled(negative_pairs(relations, most).where("drug <> '' AND gene <> ''"), "S6", source)
    ask = F.concat(F.lit("According to PharmGKB-curated evidence, is there a clinically meaningful pharmacogenomic association between "), "drug", F.lit(" and "), "gene", F.lit("?"))
    return drawn(rows, "S6", n, ORDER, ask, "s6_negative_control", F.col("_key"), {"entities": F.array("drug", "gene"), "expected_negative": F.lit(True), "answer_summary": F.lit("No, PharmGKB lists this pair as not associated / ambiguous.")})


def out_of_domain(spark: SparkSession, n: int = STRATA["S7"], ood: tuple[str, ...] = OOD_NAMES, known: DataFrame | None = None) -> DataFrame:
    """S7: names that no guideline covers; those that turn out to be ``known`` (name, any case) are left out."""
    names_ = spark.createDataFrame([(i, d) for i, d in enumerate(ood)], "ord long, drug string")
    if known is not None:
        names_ = names_.join(known.select(F.lower(F.trim("name")).alias("_known")), F.lower("drug") == F.col("_known"), "left_anti")
    rows = shuffled(names_, "S7", F.concat(F.lit("OOD|"), F.lower("drug")))
    ask = F.concat(F.lit("What pharmacogenomic guidelines exist for "), "drug", F.lit(" in PharmGKB? Cite the specific gene-drug interactions if any."))
    summary = F.concat("drug", F.lit(" is not in PharmGKB's clinical guidelines; appropriate response is to indicate no pharmacogenomic guidelines exist."))
    return drawn(rows, "S7", n, ORDER, ask, "s7_ood_drug", F.col("_key"), {"entities": F.array("drug"), "should_refuse": F.lit(True), "answer_summary": summary})


def siblings(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """gene, class, drug_a, level_a, drug_b, level_b: of each gene and class the first two drugs (lower-cased, by their first
    row), with the level and spelling of their last row. facts: of high evidence."""
    each = facts.select("ord", first_gene().alias("gene"), cell("level").alias("level"), F.posexplode(names("chemicals")).alias("p", "drug")).where("gene <> ''")
    member = each.withColumn("low", F.lower("drug")).join(classes.select(F.lower("member").alias("low"), F.col("class")), "low")
    one = member.groupBy("gene", "class", "low").agg(F.min(F.struct("ord", "p")).alias("at"), F.max_by(F.struct("drug", "level"), F.struct("ord", "p")).alias("d"))
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy("gene", "class").orderBy("at", "low"))).where("r <= 2")
    per = ranked.groupBy("gene", "class").agg(F.max(F.when(F.col("r") == 1, F.col("d"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("b")).where("b IS NOT NULL")
    return per.select("gene", "class", F.col("a.drug").alias("drug_a"), F.col("a.level").alias("level_a"), F.col("b.drug").alias("drug_b"), F.col("b.level").alias("level_b"))


def comparative(facts: DataFrame, classes: DataFrame, n: int = STRATA["S8"]) -> DataFrame:
    """S8: which of two drugs of one class has the stronger evidence; facts of high evidence count."""
    source = F.concat_ws("|", F.lit("CMP"), "gene", "class", "drug_a", "drug_b")
    rows = shuffled(siblings(facts.where(cell("level").isin(*HIGH_EVIDENCE)), classes), "S8", source)
    ask = F.concat(F.lit("Between "), "drug_a", F.lit(" and "), "drug_b", F.lit(" (both in the "), "class", F.lit(" class), which has stronger PharmGKB evidence for an interaction with "), "gene", F.lit(", and at what evidence level?"))
    gold = {"entities": F.array("drug_a", "drug_b", "class", "gene"), "evidence_levels": F.map_from_arrays(F.array("drug_a", "drug_b"), F.array("level_a", "level_b")), "answer_summary": F.concat("drug_a", F.lit("="), "level_a", F.lit(", "), "drug_b", F.lit("="), "level_b", F.lit("."))}
    return drawn(rows, "S8", n, ("_h", "_key"), ask, "s8_comparative_same_class", F.col("_key"), gold)


def question_set(held: DataFrame, every: DataFrame, relations: DataFrame, classes: DataFrame, counts: dict[str, int] | None = None, known: DataFrame | None = None) -> DataFrame:
    """All strata: questions over held-out facts, with ``every`` fact for frequencies and comparisons, and the names that are ``known``."""
    n = STRATA | (counts or {})
    parts = [
        wellknown(held, n["S1"]), evidence_level(held, n["S2"]), multihop(held, classes, n["S3"]), citation(held, pair_pmids(relations), n["S4"]), longtail(held, every, n["S5"]),
        negative(relations, n["S6"]), out_of_domain(held.sparkSession, n["S7"], known=known), comparative(every, classes, n["S8"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vocabulary(facts: DataFrame) -> DataFrame:
    """drug: every name in the facts' chemicals, lower case."""
    return facts.select(F.explode(names("chemicals")).alias("drug")).select(F.lower("drug").alias("drug")).distinct()


def follow_ups(candidates: DataFrame, arms: tuple[str, ...] = ("A0", "A1", "A3"), pairs: tuple[str, ...] = ("A3_vs_A1", "A3_vs_A0")) -> tuple[DataFrame, DataFrame]:
    """Runs (question_id, pattern, question, arm) and judgings (question_id, pattern, pair) of follow-up prompts (id, pattern, question)."""
    rows = candidates.select(F.col("id").alias("question_id"), "pattern", "question")
    return rows.withColumn("arm", F.explode(F.array(*map(F.lit, arms)))), rows.drop("question").withColumn("pair", F.explode(F.array(*map(F.lit, pairs))))
