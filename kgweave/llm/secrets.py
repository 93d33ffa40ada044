"""Secret scans: candidate secrets, and how many owners share each of them in the whole corpus."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.base import BROADCAST_ROWS, between, cut, doc_key, let, pieces, prefixes, quoted, row_of, running, table


@dataclass(frozen=True)
class SecretKind:
    """pattern: non-overlapping matches, leftmost first. gate: a cheaper pattern that every matching text contains.

    value: group of the pattern that is the secret itself. least: code points the value must have.
    """

    name: str
    pattern: str
    gate: str
    value: int = 0
    least: int = 0


#: A run of [0-9a-f] or of AKIA[A-Z0-9] matches as a whole, so a lower bound in the pattern keeps the same spans.
KINDS = (
    SecretKind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 12),
    SecretKind("access", r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}"),
    SecretKind("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
)
#: Candidates that count only if corpus-wide ownership shows them to be owner-specific.
GENERIC = SecretKind("owned", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+", r"[A-Za-z0-9+/_=-]{24}")
#: Owners, or repositories of fewer owners, from which on a value is a widely copied example.
MIN_OWNERS, MIN_REPOS = 3, 25
#: Beyond every offset.
NEVER = 1 << 62


def find_spans(text: Column, kind: SecretKind, order: int) -> Column:
    """array<struct<start,ord,end,kind,value>>: code point offsets from the lengths of the gaps between matches."""
    value = lambda hit: F.regexp_extract(hit, kind.pattern, kind.value) if kind.value else hit
    span = lambda x: F.struct(
        (x["before"] + x["gap"]).alias("start"), F.lit(order).alias("ord"), (x["before"] + x["gap"] + F.length(x["hit"])).alias("end"), F.lit(kind.name).alias("kind"), value(x["hit"]).alias("value"),
    )
    gaps = lambda found: F.transform(F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found)), F.length)
    before = lambda found, gap: running(F.zip_with(gap, found, lambda g, h: g + F.length(h)))
    placed = lambda found, gap: F.transform(F.arrays_zip(before(found, gap).alias("before"), gap.alias("gap"), found.alias("hit")), span)
    spans = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda found: let(gaps(found), lambda gap: placed(found, gap)))
    none = F.expr("CAST(array() AS array<struct<start:int,ord:int,end:int,kind:string,value:string>>)")
    kept = F.filter(spans, lambda s: F.length(s["value"]) >= kind.least) if kind.least else spans
    return F.when(F.regexp_like(text, F.lit(kind.gate)), kept).otherwise(none)


def scan(df: DataFrame, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: carried columns, ``base`` and ``extra`` span arrays (by start, then kind). Null text: none."""
    t = F.coalesce(F.col(text), F.lit(""))
    flat = df.select(*carry, *[find_spans(t, k, i).alias(f"_s{i}") for i, k in enumerate(KINDS)], find_spans(t, GENERIC, len(KINDS)).alias("_g"))
    base = F.array_sort(F.concat(*[F.col(f"_s{i}") for i in range(len(KINDS))]))
    flat = flat.select(*carry, base.alias("base"), "_g")
    told = F.filter("_g", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    return flat.select(*carry, "base", apart(told, F.col("base")).alias("extra"))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of ``others`` (both by start): in one order by start, no other span that began
    before goes on into one, and the next other begins after its end."""
    mark = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), F.lit(own).alias("own"), s["end"].cast("long").alias("end"), s.alias("s")))
    reached = lambda all_: prefixes(F.transform(all_, lambda x: F.when(x["own"] == 1, F.lit(0)).otherwise(x["end"])), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))
    follows = lambda all_: F.reverse(prefixes(F.reverse(F.transform(all_, lambda x: F.when(x["own"] == 1, F.lit(NEVER)).otherwise(x["start"]))), lambda a, b: F.least(a, b), F.lit(NEVER)))
    free = lambda x: (x["a"]["own"] == 1) & (x["r"] <= x["a"]["start"]) & (x["f"] >= x["a"]["end"])
    swept = lambda all_: F.transform(F.filter(F.arrays_zip(all_.alias("a"), reached(all_).alias("r"), follows(all_).alias("f")), free), lambda x: x["a"]["s"])
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(F.array_sort(F.concat(mark(others, 0), mark(spans, 1))), swept))


def ownership(spans: DataFrame, owner: str, repo: str) -> DataFrame:
    """Per value hash: distinct owners and distinct repositories. Counted in steps, so that no value's rows meet in one task."""
    return (
        spans.select("vhash", F.col(owner).alias("o"), F.col(repo).alias("r")).distinct()
        .groupBy("vhash", "o").agg(F.count("*").alias("n"))
        .groupBy("vhash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))
    )


def secret_report(df: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """Per row of ``df``: _k1, _k2, doc_id, base spans, and ``found``: every span with ``live``.

    A repository is a distinct text, so that copies of one document are one, and its owner the ``owner`` column (null
    is an owner of its own). Spans are written once and read from there. A candidate value held by ``min_owners`` owners, or in ``min_repos`` repositories of fewer,
    is a widely copied example, otherwise live. Candidates without a telling prefix (kind owned) become spans only
    where live. Empty and null texts have no spans; repeated rows each get their result; an empty table has no rows.
    Other columns of ``df`` play no part, whatever their names.
    """
    keyed = df.select(F.col(quoted(doc_id)).alias("doc_id"), F.coalesce(F.col(quoted(owner)).cast("string"), F.lit("\0")).alias("_o"), F.col(quoted(text)).alias("_t"))
    docs = keyed.select(*doc_key("doc_id", "_t"), "doc_id", "_o", "_t")
    scanned = cut(scan(docs, "_t", ("_k1", "_k2", "doc_id", "_o")), "spans")  # texts are read once; offsets and values are small beside them
    spans = scanned.where((F.size("base") > 0) | (F.size("extra") > 0)).select("_k1", "_k2", "_o", F.explode(F.concat("base", "extra")).alias("s"))
    spans = spans.select("_k1", "_k2", "_o", "s.*", F.sha2(F.col("s.value"), 256).alias("vhash")).distinct()
    owners = ownership(spans, "_o", "_k2")
    judged = (
        spans.join(owners, "vhash").withColumn("live", (F.col("n_owners") < min_owners) & (F.col("n_repos") < min_repos))
        .where((F.col("kind") != GENERIC.name) | F.col("live"))
        .select("_k1", "_k2", F.struct("start", "ord", "end", "kind", "live", "vhash").alias("s")).distinct()
        .groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list("s")).alias("found"))
    )
    empty = F.expr("CAST(array() AS array<struct<start:int,ord:int,end:int,kind:string,live:boolean,vhash:string>>)")
    return scanned.select("_k1", "_k2", "doc_id", "base").join(judged, ["_k1", "_k2"], "left").withColumn("found", F.coalesce("found", empty))


def redact(df: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", min_owners: int = MIN_OWNERS, mark: str = "[secret]", min_repos: int = MIN_REPOS) -> DataFrame:
    """``df`` with each live span of ``text`` replaced by ``mark``; overlapping live spans become one mark. Columns as in ``df``.

    Texts are read twice: for their spans, and to be rewritten. Live spans go to the texts by broadcast if they are few,
    counted; otherwise the texts that a gate finds candidates in are moved to them, and all others pass as they are.
    Null and empty texts stay. Rows are kept one for one, repeated ones too; an empty table gives an empty one.
    """
    report = secret_report(df, text, doc_id, owner, min_owners, min_repos)
    live = cut(report.select("_k1", "_k2", F.filter("found", lambda s: s["live"]).alias("_live")).where(F.size("_live") > 0).dropDuplicates(["_k1", "_k2"]), "live")
    n = live.agg(F.coalesce(F.sum(F.size("_live")), F.lit(0))).first()[0]
    if n <= BROADCAST_ROWS:
        return _rewritten(df, F.broadcast(live), text, doc_id, mark)
    gates = functools.reduce(operator.or_, [F.regexp_like(F.col(quoted(text)), F.lit(k.gate)) for k in (*KINDS, GENERIC)])
    may = F.coalesce(gates, F.lit(False))
    return _rewritten(df.where(may), live, text, doc_id, mark).union(df.where(~may))


def _rewritten(df: DataFrame, live: DataFrame, text: str, doc_id: str, mark: str) -> DataFrame:
    packed = df.select(row_of(df).alias("_row"), F.col(quoted(doc_id)).alias("_d"), F.col(quoted(text)).alias("_t"))
    joined = packed.select("_row", "_t", *doc_key("_d", "_t")).join(live, ["_k1", "_k2"], "left")
    t = F.col("_t")
    # a span that begins before an earlier one ends is under that one's mark
    reached = lambda spans: prefixes(F.transform(spans, lambda s: s["end"].cast("long")), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))
    placed = lambda spans: F.filter(F.arrays_zip(spans.alias("s"), reached(spans).alias("r")), lambda x: x["s"]["start"] >= x["r"])
    last = F.array_max(F.transform("_live", lambda s: s["end"]))
    clear = lambda c: F.concat(
        F.array_join(F.transform(placed(F.col("_live")), lambda x: F.concat(between(c["p"], x["r"].cast("int"), x["s"]["start"]), F.lit(mark))), ""), between(c["p"], c["last"], c["n"])
    )
    new = F.when(F.col("_live").isNull(), t).otherwise(let(F.struct(pieces(t).alias("p"), last.alias("last"), F.length(t).alias("n")), clear))
    return joined.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = secret_report(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return report.select(
        "doc_id", *[count(k.name) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )
