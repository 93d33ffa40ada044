"""Column functions of the engine: all run in the JVM, except the LCS ratio (an Arrow batch function)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.constants import EDGE_VERB, LEVEL_RANK, UNKNOWN_RANK

#: Up to here a factorial's logarithm is added up; beyond, Stirling's series is as exact as a double.
SMALL = 256
WORD = r"[\p{L}\p{N}_]+"


def slug(*parts: Column) -> Column:
    """Non-empty parts joined by ``_``; runs outside A-Za-z0-9_:.- become ``_``; outer ``_`` go; lower case.

    Nearly all names are slugs but for their case; one anchored match tells them apart, several times cheaper than replacing.
    """
    joined = F.concat_ws("_", *[F.nullif(p, F.lit("")) for p in parts])
    clean = F.rlike(joined, F.lit(r"^[A-Za-z0-9:.-][A-Za-z0-9_:.-]*+(?<!_)\z"))
    return F.lower(F.when(clean, joined).otherwise(F.trim(F.regexp_replace(joined, "[^A-Za-z0-9_:.-]+", "_"), F.lit("_"))))


def split_cell(cell: Column, pattern: str = ",") -> Column:
    """Trimmed, non-empty parts of a multi-valued cell; a null cell has none."""
    cell = F.coalesce(cell, F.lit(""))
    parts = F.filter(F.transform(F.split(cell, pattern), lambda x: F.trim(x)), lambda x: x != "")
    # most cells have one value, which needs no functions over arrays
    one = F.when(F.trim(cell) == "", F.array().cast("array<string>")).otherwise(F.array(F.trim(cell)))
    return F.when(F.rlike(cell, F.lit(pattern)), parts).otherwise(one)


def row_key(*cells: Column) -> Column:
    """Trimmed cells joined by ``|``, null as empty."""
    return F.concat_ws("|", *[F.trim(F.coalesce(c, F.lit(""))) for c in cells])


def level_rank(level: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in LEVEL_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, F.coalesce(level, F.lit(""))), F.lit(UNKNOWN_RANK))


def edge_type(role: Column, level: Column) -> Column:
    critical = is_critical(role, level)
    return F.when(critical, "linked_to_risk").otherwise("affects_response_to")


def is_critical(role: Column, level: Column) -> Column:
    return F.coalesce(F.contains(role, F.lit("Toxicity")) & level.isin("1A", "1B"), F.lit(False))


def fold_distinct(ordered: Column, separator: str) -> Column:
    """Ordered strings joined unless already contained as a substring; empty ones are passed over."""
    return F.aggregate(ordered, F.lit(""), lambda a, x: F.when((x == "") | F.contains(a, x), a).when(a == "", x).otherwise(F.concat(a, F.lit(separator), x)))


def tokens(text: Column) -> Column:
    """Lower-cased word tokens, Unicode letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def question_terms(text: Column, stopwords: list[str]) -> Column:
    """Tokens of at least three characters that are no stop words; ``-`` stays within a token."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s-]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(F.array(*[F.lit(w) for w in stopwords]), t))


def ngrams(terms: Column, sizes: tuple[int, ...] = (3, 2, 1)) -> Column:
    """Distinct n-grams in order, longest first."""
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(terms) - n + 1), lambda i: F.array_join(F.slice(terms, i, F.lit(n)), " "))
        return F.when(F.size(terms) >= n, grams).otherwise(none)

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in sizes])))


def edge_verb(kind: Column) -> Column:
    verbs = F.create_map(*[F.lit(x) for kv in EDGE_VERB.items() for x in kv])
    return F.coalesce(F.try_element_at(verbs, kind), kind)


def edge_tags(*tags: Column, separator: str = ", ", lead: str = "") -> Column:
    """``[a, b]`` of the tags that apply (not null), with ``lead`` before; nothing where none does."""
    own = F.filter(F.array(*tags), lambda t: t.isNotNull())
    return F.when(F.size(own) > 0, F.concat(F.lit(f"{lead}["), F.array_join(own, separator), F.lit("]"))).otherwise("")


def tag(value: Column, prefix: str = "", suffix: str = "") -> Column:
    """The value between prefix and suffix; null for an empty one."""
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(prefix), value.cast("string"), F.lit(suffix)))


def render_edge(a: Column, b: Column, kind: Column, level: Column, role: Column, critical: Column, count: Column) -> Column:
    """``A --verb[Llevel, role, CRITICAL, n variants]--> B``; tags that do not apply are left out."""
    tags = edge_tags(tag(level, "L"), tag(role), F.when(critical, F.lit("CRITICAL")), F.when(count > 0, tag(count, suffix=" variants")))
    return F.concat(a, F.lit(" --"), edge_verb(kind), tags, F.lit("--> "), b)


#: White space of the patterns below and of ``stripped``: ASCII, without the vertical tab in classes that two engines read differently.
BLANK = r"[ \t\n\f\r]"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def normalize_answer(text: Column) -> Column:
    """An answer without marks of its origin: one form of citation, no list marks and emphasis, single blank lines."""
    text = F.coalesce(text, F.lit(""))
    for pattern, put in (
        (r"(?i)\[PMID[: \t\n\f\r]*([0-9]+)\]", "(cite $1)"), (r"(?i)\bPMID[: \t\n\f\r]*([0-9]+)\b", "(cite $1)"),
        (rf"(?dm)^{BLANK}*[-•·*]{BLANK}+", ""), (rf"(?dm)^{BLANK}*[0-9]+[.)]{BLANK}+", ""), (r"\*\*|__", ""), (rf"\n{BLANK}*\n+", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, put)
    return stripped(text)


def extract_pmids(text: Column) -> Column:
    """Distinct identifiers of 6 to 9 digits in citation contexts (``PMID: 1234567``, ``[1234567]``), in order."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\bPMID[: \t\n\f\r]*[0-9]{6,9}\b|\[[0-9]{6,9}\]"), F.lit(0))
    return F.array_distinct(F.transform(hits, lambda m: F.regexp_extract(m, r"([0-9]{6,9})", 1)))


def quoted_pattern(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def mentions(text: Column, entity: Column) -> Column:
    """Whether the entity stands in the text between word boundaries, case ignored; an empty one does not."""
    pattern = F.concat(F.lit(r"(?iU)\b"), quoted_pattern(entity), F.lit(r"\b"))
    return (F.coalesce(entity, F.lit("")) != "") & F.regexp_like(F.coalesce(text, F.lit("")), pattern)


def format_percent(x: Column, digits: int = 1) -> Column:
    """A share as a percentage; null as a dash."""
    return F.when(x.isNull(), "—").otherwise(F.format_string(f"%.{digits}f%%", 100 * x.cast("double")))


def format_number(x: Column, whole: bool = False) -> Column:
    """A number with one decimal, a whole one as it is; null as a dash."""
    return F.when(x.isNull(), "—").otherwise(x.cast("string") if whole else F.format_string("%.1f", x.cast("double")))


def any_cue(text: Column, cues: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(low, c))


def estimate_tokens(chars: Column) -> Column:
    return F.floor(chars / 3.7 + 0.5).cast("long")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Confidence interval of k out of n, within [0, 1]; n = 0: all of it."""
    k, n = k.cast("double"), n.cast("double")
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial p-value at 1/2, through logarithms of factorials; without decisions 1."""
    n, k = wins + losses, F.least(wins, losses)
    x = lambda m: F.greatest(m, F.lit(1)).cast("double")
    exact = lambda m: F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(m, F.lit(1)), F.lit(SMALL)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    log_factorial = lambda m: F.when(m <= SMALL, exact(m)).otherwise(x(m) * F.log(x(m)) - x(m) + F.log(2 * math.pi * x(m)) / 2 + 1 / (12 * x(m)) - 1 / (360 * F.pow(x(m), F.lit(3))))
    # terms from the middle down: each is the next one times (i + 1) / (n - i); after 10 sqrt(n) of them what is left is below exp(-200) of the first
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.log(F.lit(2.0)))
    steps = F.least(k, F.ceil(10 * F.sqrt(n.cast("double"))) + 10).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), steps), F.struct(top.alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a["t"] * (k - i) / (n - k + i + 1)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def lcs_ratio_of(a: str | None, b: str | None) -> float | None:
    """2 * longest common subsequence / (len a + len b), bit-parallel."""
    if a is None or b is None:
        return None
    if not a and not b:
        return 1.0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & at.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def register(spark) -> None:  # noqa: ANN001
    """SQL-callable helpers: functions of SQL where the expression is one, an Arrow batch function for the ratio."""
    spark.udf.register("lcs_ratio", lcs_ratio)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION slug(part STRING) RETURNS STRING RETURN lower(trim(BOTH '_' FROM regexp_replace(part, '[^A-Za-z0-9_:.-]+', '_')))")
    mid, half, d = "(k / n + 1.96 * 1.96 / (2 * n))", "1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))", "(1 + 1.96 * 1.96 / n)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION wilson_lo(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n = 0 THEN 0D ELSE greatest(0D, ({mid} - {half}) / {d}) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION wilson_hi(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n = 0 THEN 1D ELSE least(1D, ({mid} + {half}) / {d}) END")
    log_factorial = f"""(CASE WHEN {{0}} <= {SMALL} THEN aggregate(sequence(1, greatest(1, least({{0}}, {SMALL}))), 0D, (b, j) -> b + ln(j))
        ELSE {{0}} * ln(greatest({{0}}, 1)) - {{0}} + ln(2 * pi() * greatest({{0}}, 1)) / 2 + 1 / (12D * greatest({{0}}, 1)) - 1 / (360 * pow(greatest({{0}}, 1), 3)) END)"""
    n, k, rest = "(w + l)", "least(w, l)", "greatest(w, l)"
    top = f"exp({log_factorial.format(n)} - {log_factorial.format(k)} - {log_factorial.format(rest)} - {n} * ln(2D))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION sign_test_p(w BIGINT, l BIGINT) RETURNS DOUBLE RETURN CASE WHEN w + l = 0 THEN 1D ELSE least(1D, 2 * aggregate(sequence(0, least({k}, ceil(10 * sqrt({n})) + 10)),
        named_struct('t', {top}, 's', 0D), (a, i) -> named_struct('t', a.t * ({k} - i) / ({rest} + i + 1), 's', a.s + a.t), a -> a.s)) END""")
