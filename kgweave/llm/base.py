"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.sources.shared import cut, drop_cut, new_folder, release, shared_dir

__all__ = ["cut", "drop_cut", "new_folder", "release", "shared_dir"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows of a small side up to which it may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(c, UPPER, LOWER)


def row_of(df: DataFrame, *dropped: str) -> Column:
    """All columns of ``df`` but ``dropped`` as one struct, which no name of an operator's own can clash with."""
    return F.struct(*([F.col(quoted(c)) for c in others(df, *dropped)] or [F.lit(0).alias("_none")]))


def others(df: DataFrame, *dropped: str) -> list[str]:
    """Columns of ``df`` but ``dropped``, whose case does not count."""
    gone = {d.lower() for d in dropped}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpacked(df: DataFrame, row: str, *dropped: str) -> list[Column]:
    """The columns that row_of packed, to be selected."""
    return [F.col(row)[c].alias(c) for c in others(df, *dropped)]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used: lambdas and branches share no subexpressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefixes(values: Column, fold: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each entry of an array the fold of those before it (of ``zero``'s type).

    In blocks of about the square root of its size, as appending to an array copies it: n entries cost n times the root
    of n steps. ``fold`` is associative.
    """
    none = F.array().cast("array<long>")
    step = lambda a, x: F.struct(fold(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    total = lambda x: F.aggregate(x, zero, fold)
    whole = lambda x, at: F.aggregate(x, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])
    cuts = lambda c: F.transform(F.sequence(F.lit(0), F.ceil(F.size(c["v"]) / c["b"]).cast("int") - 1), lambda i: F.slice(c["v"], i * c["b"] + 1, c["b"]))
    many = lambda c: let(cuts(c), lambda parts: F.flatten(F.zip_with(parts, whole(F.transform(parts, total), zero), whole)))
    root = lambda v: F.struct(v.alias("v"), F.ceil(F.sqrt(F.size(v))).cast("int").alias("b"))
    return let(values, lambda v: F.when(F.size(v) > 64, let(root(v), many)).otherwise(whole(v, zero)))


def running(sizes: Column) -> Column:
    """For each entry of an array of integers the sum of those before it."""
    longs = F.transform(sizes, lambda n: n.cast("long"))
    return F.transform(prefixes(longs, lambda a, n: a + n, F.lit(0).cast("long")), lambda n: n.cast("int"))


#: A text's pieces have 2 ** PIECE code points.
PIECE = 10


def pieces(text: Column) -> Column:
    """A text in pieces, to be read from with between()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << PIECE}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text in pieces: a few pieces are looked at, where substring walks from the text's beginning."""
    first, last, mask = F.shiftright(start, PIECE), F.shiftright(end - 1, PIECE), (1 << PIECE) - 1
    head = F.substring(F.element_at(parts, first + 1), start.bitwiseAND(F.lit(mask)) + 1, F.least(end - start, F.lit(1 << PIECE)))
    rest = F.concat(F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.element_at(parts, last + 1), F.lit(1), end - F.shiftleft(last, PIECE)))
    return F.when(end <= start, F.lit("")).when(first == last, head).otherwise(F.concat(head, rest))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if its counted rows are within the limit, unchanged otherwise."""
    return F.broadcast(df) if rows <= limit else df


def give_back() -> None:
    """Freed memory of this process goes to the system; allocators keep it otherwise, in workers that wait idle too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library is another one
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow that gives memory back at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that name a document's content: rows that agree in both have equal results."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_k1"), F.xxhash64(F.col(text)).alias("_k2")]
