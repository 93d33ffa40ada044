"""Fill-in-middle transformation: documents cut in three by a hash of their id, rearranged around sentinels, and restored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.base import let, quoted, row_of, table, unpacked

#: Code points of a block. Units of single code points are made of the blocks that a cut falls in only, so that the
#: unit arrays of a long text take little more room than the text.
BLOCK = 128
OWN = ("_n", "_form", "_first", "_second", "_out")


@dataclass(frozen=True)
class Fim:
    """seed: of the hash. rate, spm: percent of documents transformed, and of these in the order suffix, prefix, middle.

    A sentinel begins with a character that stands nowhere else in the three: then no occurrence of one can overlap
    another or reach out of it, and texts without sentinels are restored from any arrangement.
    """

    seed: int = 1
    rate: int = 90
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3 or len({m[0] for m in marks}) > 1 or any(marks[0][0] in m[1:] for m in marks):
            raise ValueError(f"sentinels must differ and begin with one character that stands nowhere else in them: {marks}")


def draw(digest: Column, group: int, below: Column) -> Column:
    """The group-th 8 hex digits of a digest, as an unsigned integer, modulo ``below``."""
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long") % below


def sliced(blocks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text cut into blocks: whole blocks between, and slices of the units of the blocks at both ends."""
    units = lambda b: F.regexp_extract_all(F.element_at(blocks, (b + 1).cast("int")), F.lit("(?s)."), F.lit(0))
    piece = lambda b, i, j: F.array_join(F.slice(units(b), (i + 1).cast("int"), (j - i).cast("int")), "")
    first, last = F.floor(start / BLOCK), F.floor((end - 1) / BLOCK)
    whole = F.array_join(F.slice(blocks, (first + 2).cast("int"), F.greatest(last - first - 1, F.lit(0)).cast("int")), "")
    ends = F.concat(piece(first, start - first * BLOCK, F.lit(BLOCK)), whole, piece(last, F.lit(0), end - last * BLOCK))
    return F.when(end <= start, F.lit("")).when(first == last, piece(first, start - first * BLOCK, end - first * BLOCK)).otherwise(ends)


def transform(df: DataFrame, how: Fim = Fim(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with _n (code points), _form (plain, psm or spm), _first and _second (the cuts; null if plain) and _out.

    Cuts and form follow from the hash of seed and doc_id alone, so they are the same on every run; rows of one doc_id
    share them, a null doc_id hashes like an empty one. A null text counts as empty; an empty one, and one that holds a
    sentinel, stays plain. Rows are transformed one for one, repeated ones too; an empty table gives an empty one.
    Columns of ``df`` with the five names are replaced, all others keep theirs. Nothing is shuffled.
    """
    t, d = F.col("_t"), F.col("_d")
    held = df.select(row_of(df, *OWN).alias("_row"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("_t"), F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))), 256).alias("_d"))
    held = held.select("_row", "_t", "_d", F.length(t).cast("long").alias("_n"))
    marked = F.contains(t, F.lit(how.prefix)) | F.contains(t, F.lit(how.suffix)) | F.contains(t, F.lit(how.middle))
    order = F.when(draw(d, 4, F.lit(100)) < how.spm, "spm").otherwise("psm")
    form = F.when((F.col("_n") == 0) | marked | (draw(d, 3, F.lit(100)) >= how.rate), "plain").otherwise(order)
    a, b = draw(d, 1, F.col("_n") + 1), draw(d, 2, F.col("_n") + 1)
    held = held.select("_row", "_t", "_n", form.alias("_form"), F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y"))
    # one lambda a step keeps the generated method small enough to be compiled
    free = held.select("_row", "_t", "_n", "_form", *[F.when(F.col("_form") != "plain", F.col(c)).alias(c) for c in ("_x", "_y")])
    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    parts = let(F.struct(blocks.alias("b"), "_x", "_y", "_n"), lambda c: F.array(*[sliced(c["b"], i, j) for i, j in ((F.lit(0), c["_x"]), (c["_x"], c["_y"]), (c["_y"], c["_n"]))]))
    held = free.select("_row", "_t", "_n", "_form", "_x", "_y", F.when(F.col("_form") != "plain", parts).alias("_p"))
    pre, mid, suf = (F.element_at("_p", i) for i in (1, 2, 3))
    psm = F.concat(F.lit(how.prefix), pre, F.lit(how.suffix), suf, F.lit(how.middle), mid)
    spm = F.concat(F.lit(how.suffix), suf, F.lit(how.prefix), pre, F.lit(how.middle), mid)
    out = F.when(F.col("_form") == "psm", psm).when(F.col("_form") == "spm", spm).otherwise(t)
    return held.select(*unpacked(df, "_row", *OWN), "_n", "_form", F.col("_x").alias("_first"), F.col("_y").alias("_second"), out.alias("_out"))


def restored(out: Column, form: Column, how: Fim = Fim()) -> Column:
    """The text again, from an arrangement and its form: each sentinel stands there once, and its part up to the next one."""
    after = lambda m: F.substring_index(out, m, -1)
    upto = lambda c, m: F.substring_index(c, m, 1)
    psm = F.concat(upto(after(how.prefix), how.suffix), after(how.middle), upto(after(how.suffix), how.middle))
    spm = F.concat(upto(after(how.prefix), how.middle), after(how.middle), upto(after(how.suffix), how.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's arrangement and what is restored from it, as digests; null, empty, long and repeated texts as in transform."""
    out = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_first").alias("prefix_chars"), (F.col("_second") - F.col("_first")).alias("middle_chars"),
        F.sha2("_out", 256).alias("output_sha256"), F.sha2(restored(F.col("_out"), F.col("_form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS x, greatest(a, b) AS y,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, x) AS pre, substring(t, x + 1, y - x) AS mid, substring(t, y + 1, n - y) AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(x AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(y - x AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
