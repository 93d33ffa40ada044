"""Grading, judging and statistics over logs of answers and judgments."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgweave.constants import ARMS, NEGATIVE_CUES, REFUSAL_CUES, STRATA
from kgweave.functions.columns import any_cue, extract_pmids, mentions, normalize_answer, sign_test, stripped, wilson


def latest_success(log: DataFrame, keys: list[str], is_error: Column, order: list[str]) -> DataFrame:
    """Per key the latest row without error; the first row if all have one."""
    seq = F.struct(*order)
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), F.when(~is_error, seq)).alias("ok"), F.min_by(F.struct(*log.columns), F.when(is_error, seq)).alias("bad"))
    return best.select(F.coalesce("ok", "bad").alias("row")).select("row.*")


def remaining(tasks: DataFrame, log: DataFrame, keys: list[str], is_error: Column) -> DataFrame:
    """Tasks that no successful record covers yet."""
    return tasks.join(log.where(~is_error).select(*keys).distinct(), keys, "left_anti")


def entity_recall(answers: DataFrame, gold: str = "gold", text: str = "text") -> DataFrame:
    """answers with mentioned, missed and recall: gold entities between word boundaries, case ignored; null without gold."""
    held = F.transform(gold, lambda e: F.struct(e.alias("e"), mentions(F.col(text), e).alias("m")))
    pick = lambda yes: F.transform(F.filter("_held", lambda x: x["m"] == yes), lambda x: x["e"])
    out = answers.withColumn("_held", held).withColumn("mentioned", pick(True)).withColumn("missed", pick(False)).drop("_held")
    return out.withColumn("recall", F.when(F.size(gold) > 0, F.size("mentioned") / F.size(gold)))


def citation_rates(answers: DataFrame, known: DataFrame, text: str = "text", key: str = "question_id") -> DataFrame:
    """key, cited, found, exists_rate (null without citations); known: pmid."""
    cited = answers.select(key, F.explode_outer(extract_pmids(F.col(text))).alias("pmid"))
    flagged = cited.join(known.select("pmid").distinct().withColumn("k", F.lit(1)), "pmid", "left")
    return flagged.groupBy(key).agg(F.count("pmid").alias("cited"), F.coalesce(F.sum("k"), F.lit(0)).alias("found")).withColumn("exists_rate", F.when(F.col("cited") > 0, F.col("found") / F.col("cited")))


def grade(answers: DataFrame, questions: DataFrame, known: DataFrame) -> DataFrame:
    """One record for each answer whose question is known.

    answers: question_id, arm, answer, error, context_chars, duration_ms. questions: id, stratum, gold (struct of
    entities, pmids, evidence_level). known: pmid, those that exist. An answer that is empty or failed has its sizes and
    nothing else. pmid_correct_rate is of stratum S4 and 0 without citations, evidence_level_match of S2 and null
    without a claim, refusal_correct of S7 (a refusal) and S6 (a negative answer or a refusal).
    """
    q = questions.select(F.col("id").alias("question_id"), "stratum", "gold")
    text = F.coalesce("answer", F.lit(""))
    rows = answers.join(q, "question_id").withColumn("_text", text).withColumn("_ok", (text != "") & (F.coalesce("error", F.lit("")) == ""))
    rows = rows.withColumn("_gold", F.coalesce("gold.entities", F.array().cast("array<string>")))
    rows = entity_recall(rows, "_gold", "_text").withColumn("_cited", extract_pmids(F.col("_text")))
    each = rows.select("question_id", "arm", F.explode("_cited").alias("pmid")).distinct().join(known.select("pmid").distinct(), "pmid").groupBy("question_id", "arm").agg(F.count("*").alias("_exist"))
    rows = rows.join(each, ["question_id", "arm"], "left").withColumn("_levels", claimed_levels("_text"))
    n = F.size("_cited")
    right = F.size(F.filter("_cited", lambda p: F.array_contains(F.coalesce("gold.pmids", F.array().cast("array<string>")), p)))
    asked = F.coalesce("gold.evidence_level", F.lit("")) != ""
    only = lambda c, *when: F.when(functools.reduce(operator.and_, when, F.col("_ok")), c)
    s2, s4 = F.col("stratum") == "S2", F.col("stratum") == "S4"
    refused, negative = any_cue(F.col("_text"), REFUSAL_CUES), any_cue(F.col("_text"), NEGATIVE_CUES)
    return rows.select(
        "question_id", "stratum", "arm", F.length("_text").alias("answer_chars"), F.coalesce("context_chars", F.lit(0)).alias("context_chars"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), "error",
        only(F.col("recall")).alias("entity_recall"), only(F.col("mentioned")).alias("entities_mentioned"), only(F.col("missed")).alias("entities_missed"), only(F.col("_cited")).alias("pmids_cited"),
        only(F.coalesce("_exist", F.lit(0)) / n, n > 0).alias("pmid_exists_rate"), only(F.when(n > 0, right / n).otherwise(0.0), s4).alias("pmid_correct_rate"),
        only(F.array_contains("_levels", F.upper("gold.evidence_level")).cast("int"), s2, asked, F.size("_levels") > 0).alias("evidence_level_match"), only(F.col("_levels"), s2, asked).alias("evidence_levels_claimed"),
        only(F.when(F.col("stratum") == "S7", refused.cast("int")).when(F.col("stratum") == "S6", (refused | negative).cast("int"))).alias("refusal_correct"),
    )


def refusals(answers: DataFrame, text: str = "text") -> DataFrame:
    return answers.withColumn("refused", any_cue(F.col(text), REFUSAL_CUES)).withColumn("negative", any_cue(F.col(text), NEGATIVE_CUES))


#: A level named after the word, and one that counts only near a telling word. Fixed values.
TAGGED_LEVEL = r"(?iU)\blevel\s*[:=]?\s*(1A|1B|2A|2B|3|4)\b"
LOOSE_LEVEL = r"(?iU)\b(?:L[\s-]?)?(1A|1B|2A|2B|3|4)\b(?:\s*evidence|\s*level)?"
#: Characters around a loose level that are looked at, and as many mentions as can stand in them on one side.
NEAR, NEAR_HITS = 20, 10


def claimed_levels(text: str | Column) -> Column:
    """Evidence levels that a text claims, sorted: after ``level``, or with ``evidence``, ``level`` or a word in l within
    20 characters around. Null and empty texts claim none.

    The text is cut at its loose mentions; what stands around one is put together from the pieces next to it, each of
    which has two characters at least.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    hits, gaps = F.regexp_extract_all(t, F.lit(LOOSE_LEVEL), F.lit(0)), F.split(t, LOOSE_LEVEL, -1)
    joined = lambda p, first, n: F.array_join(F.slice(p, first, n), "")
    last = lambda c: F.substring(c, F.greatest(F.length(c) - NEAR + 1, F.lit(1)), F.lit(NEAR))

    def near(pieces: Column, rest: Column, gap: Column, hit: Column, i: Column) -> Column:
        before = last(F.concat(joined(pieces, F.greatest(i - NEAR_HITS, F.lit(0)) + 1, F.least(i, F.lit(NEAR_HITS))), gap))
        after = F.substring(F.concat(joined(pieces, i + 2, F.lit(NEAR_HITS)), rest), 1, NEAR)
        return F.concat(F.lit(" "), before, hit, after)

    around = lambda c: F.transform(
        F.arrays_zip(c["hits"].alias("hit"), c["gaps"].alias("gap"), F.sequence(F.lit(0), F.size(c["hits"]) - 1).alias("i")),
        lambda x: F.struct(x["hit"].alias("hit"), near(c["pieces"], F.element_at(c["gaps"], -1), x["gap"], x["hit"], x["i"]).alias("near")),
    )
    whole = F.struct(hits.alias("hits"), gaps.alias("gaps"), F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))).alias("pieces"))
    told = F.filter(F.element_at(F.transform(F.array(whole), around), 1), lambda x: F.regexp_like(x["near"], F.lit("(?iU)evidence|level| l")))
    loose = F.when(F.size(hits) > 0, F.transform(F.filter(told, lambda x: x["hit"].isNotNull()), lambda x: F.regexp_extract(x["hit"], LOOSE_LEVEL, 1)))
    tagged = F.regexp_extract_all(t, F.lit(TAGGED_LEVEL), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.concat(tagged, F.coalesce(loose, F.array().cast("array<string>"))), F.upper)))


def tolerant_json(text: str | Column) -> Column:
    """The first balanced braces of a text (fences and prose around them ignored), if they hold a JSON object; else null.

    Braces in strings count like others; what follows the first balanced pair is not looked at. JSON has no NaN and no
    infinities.
    """
    t = stripped(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    open_fence, end_fence = r"^```(?:json)?\s*", r"\s*```$"
    t = F.when(F.startswith(t, F.lit("```")), F.regexp_replace(F.regexp_replace(t, open_fence, ""), end_fence, "")).otherwise(t)
    # pieces end in a brace; depth is the running sum of the braces, the blob what lies between the last rise to 1 and the first fall to 0
    pieces = F.regexp_extract_all(t, F.lit(r"[^{}]*[{}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit(0).alias("stop"))

    def step(a: Column, p: Column) -> Column:
        end, rises = a["at"] + F.length(p), F.endswith(p, F.lit("{"))
        falls = ~rises & (a["depth"] == 1) & (a["stop"] == 0)
        return F.struct(
            end.alias("at"), (a["depth"] + F.when(rises, 1).otherwise(-1)).alias("depth"),
            F.when(rises & (a["depth"] == 0) & (a["stop"] == 0), end).otherwise(a["start"]).alias("start"), F.when(falls, end).otherwise(a["stop"]).alias("stop"),
        )

    found = F.aggregate(pieces, zero, step)
    blob = F.element_at(F.transform(F.array(F.struct(t.alias("t"), found.alias("f"))), lambda c: F.when(c["f"]["stop"] > 0, F.substring(c["t"], c["f"]["start"], c["f"]["stop"] - c["f"]["start"] + 1))), 1)
    return F.element_at(F.transform(F.array(blob), lambda b: F.when(F.from_json(b, "map<string,string>", {"allowSingleQuotes": "false"}).isNotNull(), b)), 1)


CLAIMS = "claims array<struct<id string, text string, made_by array<string>, supported string>>"


def parse_claims(replies: DataFrame, text: str = "text") -> DataFrame:
    """replies with claims, and error: no-json where no object with claims is found, claims-not-list where they are no list."""
    out = replies.withColumn("_blob", tolerant_json(text))
    what = F.schema_of_variant(F.expr("try_variant_get(try_parse_json(_blob), '$.claims', 'variant')"))
    claims = F.from_json("_blob", f"struct<{CLAIMS.replace(' array', ': array', 1)}>")["claims"]
    listed = F.startswith(what, F.lit("ARRAY"))
    error = F.when(F.col("_blob").isNull() | what.isNull(), "no-json").when(~listed, "claims-not-list")
    return out.withColumn("error", error).withColumn("claims", F.when(error.isNull(), claims).otherwise(F.array().cast("array<struct<id:string,text:string,made_by:array<string>,supported:string>>"))).drop("_blob")


def swap(seed: int, *parts: Column) -> Column:
    """A fair coin from a hash of the seed and parts."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 1).isin(*"01234567")


def parse_verdict(text: Column, strict: bool = False) -> Column:
    """A, B or TIE from the first line; lenient: a line that only begins with A or B counts (so "ANSWER B" is A). All else is TIE."""
    line = F.upper(stripped(F.split_part(stripped(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(1))))
    exact = F.when(line.isin("A", "B", "TIE"), line)
    begins = F.when(F.startswith(line, F.lit("A")), "A").when(F.startswith(line, F.lit("B")), "B")
    return F.coalesce(exact, F.lit("TIE")) if strict else F.coalesce(exact, begins, F.lit("TIE"))


def verdict_reason(text: Column) -> Column:
    """What follows an exact verdict line; else the whole text (200 characters where it is no verdict), 300 at most."""
    whole = stripped(F.coalesce(text, F.lit("")))
    line = F.upper(stripped(F.split_part(whole, F.lit("\n"), F.lit(1))))
    rest = F.when(F.contains(whole, F.lit("\n")), stripped(F.regexp_replace(whole, r"^[^\n]*\n", ""))).otherwise("")
    return F.substring(F.when(line.isin("A", "B", "TIE"), rest).when(F.startswith(line, F.lit("A")) | F.startswith(line, F.lit("B")), whole).otherwise(F.substring(whole, 1, 200)), 1, 300)


def unblind(pick: Column, a_arm: Column, b_arm: Column) -> Column:
    return F.when(pick == "A", a_arm).when(pick == "B", b_arm).when(pick == "TIE", "TIE")


def parse_rubric(text: Column) -> tuple[Column, Column, Column]:
    """F=n C=n CS=n as integers, null where absent."""
    pattern = r"(?i)F\s*=\s*([1-5])\s+C\s*=\s*([1-5])\s+CS\s*=\s*([1-5])"
    return tuple(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, i).try_cast("int") for i in (1, 2, 3))


def mean_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and half width 1.96 * sd / sqrt(n) of the non-null values; one value has width 0."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (1.96 * F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value))).alias("half"))


def pairwise(judgments: DataFrame, keys: list[str], target: str) -> DataFrame:
    """wins, losses, ties of ``target`` (judgments: winner), rate over decided ones, interval, p and verdict."""
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = judgments.where("winner IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), one(F.col("winner") == target).alias("wins"), one((F.col("winner") != target) & (F.col("winner") != "TIE")).alias("losses"), one(F.col("winner") == "TIE").alias("ties"))
    decided = F.col("wins") + F.col("losses")
    lo, hi = wilson(F.col("wins"), decided)
    s = s.withColumn("rate", F.when(decided > 0, F.col("wins") / decided)).withColumn("lo", lo).withColumn("hi", hi).withColumn("p", sign_test(F.col("wins"), F.col("losses")))
    return s.withColumn("verdict", F.when(F.col("p") >= 0.05, "no difference").when(F.col("rate") > 0.5, "better").otherwise("worse"))


def headline(scores: DataFrame, metrics: list[str], is_error: Column) -> DataFrame:
    """Per arm: n, n_errors and the mean of each metric over rows that have it."""
    return scores.groupBy("arm").agg(F.count("*").alias("n"), F.sum(is_error.cast("long")).alias("n_errors"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def grid(scores: DataFrame, strata: DataFrame, arms: DataFrame, metric: str) -> DataFrame:
    """Every stratum (column stratum) with every arm (column arm), also those without scores. Both are short lists."""
    cells = strata.withColumn("_j", F.lit(1)).join(F.broadcast(arms.withColumn("_j", F.lit(1))), "_j").drop("_j")
    return cells.join(scores.groupBy("stratum", "arm").agg(F.count("*").alias("n"), F.avg(metric).alias("mean")), ["stratum", "arm"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hallucination(segments: DataFrame, arms: tuple[str, ...] | None = None) -> DataFrame:
    """Per arm: claims, supported, unsupported, unverifiable (anything but true and false, case ignored), rates (null
    without claims), and questions_covered, the segments with claims, of all arms together.

    segments: question_id, label_to_arm, claims. Labels without an arm are dropped; ``arms`` also get rows without claims.
    """
    held = segments.where(F.size("claims") > 0)
    claims = held.select("label_to_arm", F.explode("claims").alias("c")).select("label_to_arm", F.explode("c.made_by").alias("label"), F.lower(F.coalesce(F.col("c.supported"), F.lit(""))).alias("s"))
    named = claims.select(F.try_element_at("label_to_arm", F.col("label")).alias("arm"), "s").where("arm IS NOT NULL")
    per = named.groupBy("arm").agg(F.count("*").alias("claims"), F.count_if(F.col("s") == "true").alias("supported"), F.count_if(F.col("s") == "false").alias("unsupported"), F.count_if(~F.col("s").isin("true", "false")).alias("unverifiable"))
    if arms is not None:
        each = segments.sparkSession.createDataFrame([(a,) for a in arms], "arm string")
        per = each.join(per, "arm", "left").fillna(0)
    covered = held.agg(F.count("*").alias("questions_covered"))
    rate = lambda c: F.when(F.col("claims") > 0, F.col(c) / F.col("claims"))
    return per.join(F.broadcast(covered)).withColumn("hallucination_rate", rate("unsupported")).withColumn("support_rate", rate("supported"))


def judge_tasks(questions: DataFrame, answers: DataFrame, pairs: tuple[str, ...] = ("A3_vs_A1", "A3_vs_A0"), seed: int = 42) -> DataFrame:
    """Every question with every pair ``X_vs_Y``: shown_a_arm, shown_b_arm (swapped by a seeded coin), shown_a, shown_b
    (normalised answers), and error where a side has no answer (then nothing is shown).

    questions: id, question. answers: question_id, arm, answer, one for each, successful ones only.
    """
    asked = questions.select(F.col("id").alias("question_id"), "question", F.explode(F.array(*map(F.lit, pairs))).alias("pair"))
    asked = asked.withColumn("x", F.split_part("pair", F.lit("_vs_"), F.lit(1))).withColumn("y", F.split_part("pair", F.lit("_vs_"), F.lit(2)))
    side = lambda c: answers.select("question_id", F.col("arm").alias(c), F.col("answer").alias(f"{c}_answer"))
    met = asked.join(side("x"), ["question_id", "x"], "left").join(side("y"), ["question_id", "y"], "left")
    missing = F.when(F.col("x_answer").isNull(), F.col("x")).when(F.col("y_answer").isNull(), F.col("y"))
    error = F.concat(F.lit("missing answer for ('"), "question_id", F.lit("', '"), missing, F.lit("')"))
    turned = swap(seed, F.col("question_id"), F.col("pair"))
    shown = lambda a, b: F.when(error.isNull(), F.when(turned, b).otherwise(a))
    x, y = (normalize_answer(F.col(f"{c}_answer")) for c in ("x", "y"))
    return met.select("question_id", "pair", "question", shown(F.col("x"), F.col("y")).alias("a_arm"), shown(F.col("y"), F.col("x")).alias("b_arm"), shown(x, y).alias("shown_a"), shown(y, x).alias("shown_b"), error.alias("error"))


def blind_labels(answers: DataFrame, seed: int = 42, labels: str = "ABCD", arms: tuple[str, ...] = ARMS) -> DataFrame:
    """question_id, label_to_arm: labels dealt to the arms in a seeded order, for questions that all arms have answered."""
    held = answers.where(F.col("arm").isin(*arms)).select("question_id", "arm").distinct()
    order = F.array_sort(F.collect_list(F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "question_id", "arm")).alias("h"), "arm")))
    per = held.groupBy("question_id").agg(order.alias("o")).where(F.size("o") == len(arms))
    return per.select("question_id", F.map_from_arrays(F.array(*map(F.lit, labels[: len(arms)])), F.transform("o", lambda s: s["arm"])).alias("label_to_arm"))


def select_run(questions: DataFrame, strata: tuple[str, ...] | None = None, limit: int = 0) -> DataFrame:
    """questions of the strata, and of these the first ``limit`` by id (0: all)."""
    kept = questions.where(F.col("stratum").isin(*strata)) if strata else questions
    return kept.orderBy("id").limit(limit) if limit else kept


def score_headline(scores: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """Per arm, also without answers: n_answers, n_errors, means over what applies, n_with_citations. scores: of ``grade``."""
    per = scores.groupBy("arm").agg(
        F.count("*").alias("n_answers"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_errors"), F.avg("answer_chars").alias("answer_chars_mean"), (F.avg("duration_ms") / 1000).alias("duration_s_mean"),
        F.avg("entity_recall").alias("entity_recall_mean"), F.avg("pmid_exists_rate").alias("pmid_exists_rate_mean"), F.count_if(F.size("pmids_cited") > 0).alias("n_with_citations"),
    )
    each = scores.sparkSession.createDataFrame([(a,) for a in arms], "arm string")
    return each.join(per, "arm", "left").fillna(0, ["n_answers", "n_errors", "answer_chars_mean", "duration_s_mean", "n_with_citations"])


def score_grid(scores: DataFrame, strata: tuple[str, ...] = tuple(STRATA), arms: tuple[str, ...] = ARMS) -> DataFrame:
    """Every stratum with every arm: n, errors, and the means of its metrics (null where they do not apply)."""
    means = ("entity_recall", "pmid_exists_rate", "evidence_level_match", "pmid_correct_rate", "refusal_correct")
    per = scores.groupBy("stratum", "arm").agg(F.count("*").alias("n"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), *[F.avg(m).alias(m) for m in means])
    cells = scores.sparkSession.createDataFrame([(s, a) for s in strata for a in arms], "stratum string, arm string")
    return cells.join(per, ["stratum", "arm"], "left").fillna(0, ["n", "errors"])


def with_stratum(judgments: DataFrame, questions: DataFrame) -> DataFrame:
    """judgments with the stratum of their question; null for an unknown one."""
    return judgments.join(questions.select(F.col("id").alias("question_id"), "stratum"), "question_id", "left")


def verdicts(judgments: DataFrame, questions: DataFrame, scores: DataFrame) -> DataFrame:
    """hypothesis, value, supported. H1: A3 wins over A1 by more than 0.55 with p < 0.05; H2: in S3 by 0.60 or more;
    H3: entity recall of A3 and A0 in S1 differs by 0.05 at most. judgments: question_id, pair, winner, error."""
    decided = judgments.where((F.col("pair") == "A3_vs_A1") & (F.coalesce("error", F.lit("")) == ""))
    one = pairwise(decided, [], "A3").select(F.lit("H1").alias("hypothesis"), F.col("rate").alias("value"), ((F.col("rate") > 0.55) & (F.col("p") < 0.05)).alias("supported"))
    two = pairwise(with_stratum(decided, questions).where("stratum = 'S3'"), [], "A3").select(F.lit("H2").alias("hypothesis"), F.col("rate").alias("value"), (F.col("rate") >= 0.60).alias("supported"))
    recall = lambda arm: F.avg(F.when((F.col("stratum") == "S1") & (F.col("arm") == arm), F.col("entity_recall")))
    gap = F.when((F.col("a") > 0) & (F.col("b") > 0), F.abs(F.col("a") - F.col("b")))
    three = scores.agg(recall("A0").alias("a"), recall("A3").alias("b")).select(F.lit("H3").alias("hypothesis"), gap.alias("value"), (gap <= 0.05).alias("supported"))
    return one.unionByName(two).unionByName(three).withColumn("supported", F.coalesce("supported", F.lit(False)))


def first_of_each(questions: DataFrame, strata: tuple[str, ...] = ("S2", "S3", "S4", "S6", "S7")) -> DataFrame:
    """stratum, id: the first question of each of the strata."""
    return questions.where(F.col("stratum").isin(*strata)).groupBy("stratum").agg(F.min("id").alias("id"))


def summary_document(**tables: DataFrame) -> DataFrame:
    """One row with one JSON document: each table, of a report's bounded size, as a list of its rows in order."""
    parts = None
    for name, df in tables.items():
        rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")).agg(F.concat(F.lit(f'"{name}": ['), F.array_join(F.array_sort(F.collect_list("row")), ", "), F.lit("]")).alias("part"))
        rows = rows.select(F.lit(name).alias("name"), "part")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "part"))), lambda s: s["part"]), ", "), F.lit("}")).alias("document"))


def complete(log: DataFrame, key: str, member: str, least: int) -> DataFrame:
    """Keys that have ``least`` distinct members."""
    return log.groupBy(key).agg(F.count_distinct(member).alias("members")).where(F.col("members") >= least)


def question_ids(questions: DataFrame, order: list[str]) -> DataFrame:
    """questions with id ``S{n}-{idx:03d}`` within each stratum."""
    r = F.row_number().over(Window.partitionBy("stratum").orderBy(*order))
    return questions.withColumn("id", F.concat("stratum", F.lit("-"), F.lpad(r.cast("string"), 3, "0")))
