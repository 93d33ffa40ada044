"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.base import ascii_lower, quoted, row_of, small, table, unpacked


@dataclass(frozen=True)
class UrlRule:
    """A regular expression over ``host + path + rest``, with literal tokens every match contains."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int = 0
    kind: str = "pattern"


def site_rule(verdict: str, rule: str) -> UrlRule:
    """host/path rule: fits the host and all subdomains where the path starts with the rule's."""
    host, _, path = rule.partition("/")
    tokens = tuple(t for t in re.split(r"[^a-z0-9]+", host) if t)
    return UrlRule(rule, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape('/' + path)}", tokens, verdict, len(rule), "site")


SITE_RULES = (
    site_rule("block", "net/"),
    site_rule("allow", "example.net/en/"),
    site_rule("block", "example.com/de/"),
    site_rule("allow", "org/fr/"),
)

#: The method's own rules, for addresses that no site rule covers. Fixed values.
PATTERN_RULES = tuple(
    UrlRule(name, pattern, tokens, "block", rank, "pattern")
    for name, pattern, tokens, rank in (
        ("adult host", r"^(?:[^/?#]*[.-])?xxx[.-]", ("xxx",), 10),
        ("casino host", r"^(?:[^/?#]*[.-])?casino[.-]", ("casino",), 10),
        ("login page", r"/login(?:[/?.]|$)", ("login",), 5),
        ("cart page", r"/cart(?:[/?.]|$)", ("cart",), 5),
        ("feed", r"/feed/?(?:\?|$)", ("feed",), 3),
        ("admin script", r"/wp-admin/", ("wp", "admin"), 5),
        ("session id", r"[?&]phpsessid=", ("phpsessid",), 5),
        ("print view", r"[?&]print=1(?:&|$)", ("print",), 2),
        ("tag archive", r"/tag/[^/]+/page/[0-9]+", ("tag", "page"), 2),
    )
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(url), "[^a-z0-9]+"), lambda t: t != ""))


RULE = "rule_id int, name string, pattern string, tokens array<string>, verdict string, rank int, kind string"


def rule_table(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    """The rules as a table (RULE); an earlier rule has the smaller rule_id."""
    return spark.createDataFrame([(i, r.name, r.pattern, list(r.tokens), r.verdict, r.rank, r.kind) for i, r in enumerate(rules)], RULE)


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """One row a rule under its rarest literal token, by the tokens' frequency in ``urls`` (ties: longer, then first).

    rules: RULE. urls: column ``url``. The frequencies are counted over all of it; only the rules' own tokens are counted.
    """
    literals = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = (
        urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
        .join(small(literals, literals.count()), "token", "left_semi")
        .groupBy("token").agg(F.count("*").alias("freq"))
    )
    return (
        rules.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left")
        .groupBy("rule_id", "name", "pattern", "verdict", "rank", "kind")
        .agg(F.min_by("token", F.struct(F.coalesce("freq", F.lit(0)), -F.length("token"), "token")).alias("anchor"))
    )


def judge_urls(df: DataFrame, rules: tuple[UrlRule, ...] | DataFrame = SITE_RULES + PATTERN_RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule, verdict, pattern_rule.

    rules: a tuple, or a table of RULE columns for sets too large for one. Each distinct url fetches the rules indexed
    under one of its tokens; only those run their regular expression. The matching site rule of greatest rank (ties:
    smaller rule_id) gives rule and verdict; otherwise the highest pattern rule gives the verdict and pattern_rule;
    otherwise ``default``. A null url, or one without ``://``, has empty host and path and gets the default, as has an
    empty one. Rows are kept one for one, repeated ones too; an empty table gives an empty one. Columns of ``df`` with
    the five names are replaced; all others keep theirs.
    """
    spark = df.sparkSession
    own = ("host", "path", "rule", "verdict", "pattern_rule")
    rows = df.select(row_of(df, *own).alias("_row"), F.col(quoted(url)).alias("url"))
    urls = rows.select("url").where(F.col("url").contains("://")).distinct()
    table_ = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    index = small(rule_index(table_, rows.select("url").where(F.col("url").contains("://"))), table_.count())
    u = F.col("url")
    subject = F.concat(F.col("h"), F.regexp_extract(u, r"(?s)^.*?://[^/?#]*(.*)$", 1))
    hits = (
        urls.select("url", host_of(u).alias("h"), F.explode(url_tokens(u)).alias("token"))
        .join(index, F.col("token") == F.col("anchor"))
        .withColumn("subject", F.when(F.col("kind") == "site", subject).otherwise(ascii_lower(subject)))
        .where(F.regexp_like("subject", F.col("pattern")))
    )
    # max_by ignores rows whose ordering is null, so each kind is judged on its own
    best = lambda kind: F.max_by(F.struct("name", "verdict"), F.when(F.col("kind") == kind, F.struct("rank", -F.col("rule_id"))))
    judged = hits.groupBy("url").agg(best("site").alias("s"), best("pattern").alias("p")).withColumnRenamed("url", "_hit")
    joined = rows.join(judged, F.col("url") == F.col("_hit"), "left")
    return joined.select(
        *unpacked(df, "_row", *own), host_of(u).alias("host"), path_of(u).alias("path"), F.col("s.name").alias("rule"),
        F.coalesce("s.verdict", "p.verdict", F.lit(default)).alias("verdict"), F.when(F.col("s").isNull(), F.col("p.name")).alias("pattern_rule"),
    )


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict. A null url, and one without ``://``, has empty host and path and is allowed;
    repeated rows are judged alike, one for one; otherwise as in judge_urls."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def _sql_site() -> str:
    cases = []
    for r in sorted(SITE_RULES, key=lambda r: (-r.rank, r.name)):
        host, _, path = r.name.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{r.name}'")
    return "CASE " + " ".join(cases) + " END"


def _sql_pattern() -> str:
    cases = [f"WHEN regexp_matches(subject, '{r.pattern}') AND " + " AND ".join(f"list_contains(toks, '{t}')" for t in r.tokens) + f" THEN '{r.name}'" for r in sorted(PATTERN_RULES, key=lambda r: -r.rank)]
    return "CASE " + " ".join(cases) + " END"


OP6_SQL = f"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS subject
  FROM pages),
ruled AS (SELECT *, {_sql_site()} AS rule, regexp_split_to_array(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') AS toks FROM cut),
more AS (SELECT *, CASE WHEN rule IS NULL AND contains(url, '://') THEN {_sql_pattern()} END AS pattern_rule FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern_rule
FROM more"""
