"""Edit-aware token counts: a segment tree of pre-token counts per document, updated where edits touch it."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.llm.base import cut, lean, let, others, quoted, running, table

#: The vocabulary of the query; the operator takes any file of tiktoken's format.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The vocabulary's pre-token pattern. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points after a pre-token's end on which its boundary can depend.
REACH = 3
#: Pre-tokens of a leaf when it is made; a leaf of twice as many is divided.
LEAF = 64
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000


class Encoder:
    """Token counts of pre-tokens."""

    def __init__(self, ranks: bytes):
        table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.bpe = tiktoken.Encoding("kgweave", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})
        self.find = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.bpe.encode_ordinary(piece))
        return n

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Length and token count of each pre-token."""
        found = self.find.findall(text)
        return [len(p) for p in found], [self.count(p) for p in found]

    def until(self, text: str, start: int, known: dict[int, int], limit: int) -> Iterator[tuple[int, int]]:
        """(end, token count) of pre-tokens from ``start``, up to and with the first that ends in ``known`` or beyond ``limit``."""
        for m in self.find.finditer(text, start):
            yield m.end(), self.count(m.group())
            if m.end() in known or m.end() > limit:
                return


class SegmentTree:
    """Leaves of about LEAF pre-tokens, some empty after edits; inner nodes hold sums of code points and tokens of their subtrees."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.build()

    def build(self) -> None:
        size = 1 << (len(self.leaves) - 1).bit_length()
        self.size = size
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for i, (lengths, counts) in enumerate(self.leaves):
            self.chars[size + i], self.tokens[size + i] = sum(lengths), sum(counts)
        for i in range(size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a code point, and the leaf's first code point (the last leaf for positions beyond)."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if position >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def set_leaves(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        """Replace leaves first..last by these pre-tokens, and the sums above them."""
        slots = last - first + 1
        if len(lengths) <= 2 * LEAF * slots:
            share = max(1, -(-len(lengths) // slots))
            changed = set()
            for j in range(slots):
                own = self.leaves[first + j] = lengths[j * share : (j + 1) * share], counts[j * share : (j + 1) * share]
                i = self.size + first + j
                self.chars[i], self.tokens[i] = sum(own[0]), sum(own[1])
                changed.add(i // 2)
            while changed - {0}:  # level by level, each sum once
                for i in changed:
                    self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                    self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
                changed = {i // 2 for i in changed} - {0}
        else:  # the text has grown by more than its leaves hold
            self.leaves[first : last + 1] = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)]
            self.leaves = [x for x in self.leaves if x[0]] or [([], [])]
            self.build()

    def flat(self) -> tuple[list[int], list[int]]:
        return [n for x, _ in self.leaves for n in x], [n for _, x in self.leaves for n in x]


def edit(tree: SegmentTree, encoder: Encoder, text: str, start: int, end: int, put: str) -> tuple[str, int]:
    """Replace text[start:end] by ``put`` in text and tree; the new text, and how many pre-tokens were encoded again.

    Encoding begins at the last old boundary that nothing from REACH code points before the edit on can have set, and
    ends at the first new boundary after the edit that was an old one: from there on all boundaries are as before.
    """
    new = text[:start] + put + text[end:]
    if new == text:
        return text, 0
    shift = len(new) - len(text)
    first, first_at = tree.leaf_at(max(0, start - REACH))
    lengths, counts = tree.leaves[first]
    bounds = list(accumulate(lengths, initial=first_at))
    keep = max(0, bisect_right(bounds, start - REACH) - 1)  # pre-tokens that end at start - REACH or before
    at = bounds[keep]
    last, last_at = tree.leaf_at(end)
    ends: list[int] = []
    again: list[int] = []
    while True:
        old_lengths, old_counts = tree.leaves[last]
        old = list(accumulate(old_lengths, initial=last_at))
        known = {b + shift: i for i, b in enumerate(old) if b >= end}
        if at not in known:
            for stop, n in encoder.until(new, at, known, old[-1] + shift):
                ends.append(stop - at)
                again.append(n)
                at = stop
        if at in known:
            break
        last, last_at = last + 1, old[-1]
    rest = known[at]
    tree.set_leaves(first, last, lengths[:keep] + ends + old_lengths[rest:], counts[:keep] + again + old_counts[rest:])
    return new, len(ends)


def apply_edits(tree: SegmentTree, encoder: Encoder, text: str, edits: list[tuple[int, int, str]]) -> tuple[str, int]:
    """Edits (start, end, replacement), each in code points of the text as it is by then."""
    again = 0
    for start, end, put in edits:
        start = min(max(0, start), len(text))
        text, n = edit(tree, encoder, text, start, min(max(start, end), len(text)), put or "")
        again += n
    return text, again


STATE = "_n_before long, _n_tokens long, _n_pieces long, _n_again long, _n_edits long, _text string, _lengths array<int>, _counts array<int>"


def lists(column: pa.Array) -> list[list[int] | None]:
    """The lists of an Arrow column of lists, by way of one array of all their items."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()]).tolist()
    return [flat[a:b] if ok else None for a, b, ok in zip([0, *ends], ends, column.is_valid().to_pylist(), strict=False)]


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", edits: str | None = None, lengths: str | None = None, counts: str | None = None, leaves: bool = True) -> DataFrame:
    """``df`` with STATE: token counts before and after the edits, the edited text and the tree's leaves.

    vocabulary: a file of tiktoken's format, as a path or URI that the driver can read. edits: column of
    array<struct<start,end,put>>, applied in order, each to the text as left by the one before; offsets beyond the text
    are moved to its end; null: none. lengths, counts: columns with the leaves of an earlier run over the same text;
    without them (or where they are null) the text is encoded once. A null text counts as empty: 0 tokens. Rows are
    counted one for one, repeated ones too; an empty table gives an empty one. Columns of ``df`` with names of STATE
    are replaced, also where they are the input.
    """
    fs, path = pafs.FileSystem.from_uri(vocabulary)
    with fs.open_input_stream(path) as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())  # one file of a fixed vocabulary
    own = T._parse_datatype_string(STATE)
    passed = others(df, *[f.name for f in own.fields])
    inputs = {k: v for k, v in (("text", text), ("edits", edits), ("lengths", lengths), ("counts", counts)) if v}
    # columns travel under numbers, so that none clashes with another
    sent = [*passed, *[c for c in dict.fromkeys(inputs.values()) if c not in passed]]
    at = {k: sent.index(v) for k, v in inputs.items()}
    numbered = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(sent)])
    schema = T.StructType([*numbered.schema.fields[: len(passed)], *own.fields])
    types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for b in batches:
            for lo in range(0, b.num_rows, 500):  # leaves take several times the room of texts
                part = b.slice(lo, 500)
                out = []
                old = zip(lists(part.column(at["lengths"])), lists(part.column(at["counts"])), strict=True) if lengths and counts else [(None, None)] * part.num_rows
                todo = part.column(at["edits"]).to_pylist() if edits else [None] * part.num_rows
                for t, e, (ls, cs) in zip(part.column(at["text"]).to_pylist(), todo, old, strict=True):
                    t = t or ""
                    if ls is None or cs is None:
                        ls, cs = encoder.pieces(t)
                    before = sum(cs)
                    again = 0
                    if e:
                        tree = SegmentTree(ls, cs)
                        t, again = apply_edits(tree, encoder, t, [(x["start"], x["end"], x["put"]) for x in e])
                        total = tree.total
                        ls, cs = tree.flat()
                    else:
                        total = before
                    out.append((before, total, len(ls), again, len(e or ()), t if leaves else None, np.array(ls, np.int32) if leaves else None, np.array(cs, np.int32) if leaves else None))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(passed)], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], [f.name for f in schema.fields])

    found = numbered.mapInArrow(lean(run), schema)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(passed)], *[f.name for f in own.fields])


def redactions(text: Column, pattern: str, put: str) -> Column:
    """Edits that replace every match of the pattern, last first, so that offsets stay those of the text."""
    zero = F.expr("CAST(array() AS array<struct<start:int,end:int,put:string>>)")
    gaps = lambda found: F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
    edit_ = lambda x: F.struct((x["before"] + x["gap"]).alias("start"), (x["before"] + x["gap"] + F.length(x["hit"])).alias("end"), F.lit(put).alias("put"))
    placed = lambda found, gap: F.transform(F.arrays_zip(running(F.zip_with(gap, found, lambda g, h: g + F.length(h))).alias("before"), gap.alias("gap"), found.alias("hit")), edit_)
    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(gaps(found), lambda gap: F.reverse(placed(found, gap))))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(zero)


#: Long digit runs, telephone and network numbers.
NUMBERS = r"\+?[0-9][0-9() .-]{6,}[0-9]"


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and after its personal numbers are replaced: trees are written once, and the edits
    applied to those read back. Null and empty texts have 0 tokens; repeated rows each get theirs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_text"), redactions(F.coalesce("text", F.lit("")), NUMBERS, "<number>").alias("edits"))
    edited = F.size("edits") > 0
    first = count_tokens(docs, VOCABULARY, "_text")
    # texts and leaves go on where edits need them
    trees = cut(first.select("doc_id", "edits", F.col("_n_tokens").alias("n_tokens"), F.col("_n_pieces").alias("n_pieces"), *[F.when(edited, F.col(c)).alias(c) for c in ("_text", "_lengths", "_counts")]), "trees")
    rest = trees.where(~edited).select("doc_id", "n_tokens", F.lit(0).cast("long").alias("n_edits"), F.col("n_tokens").alias("n_tokens_edited"), "n_pieces", F.lit(0).cast("long").alias("n_encoded_again"))
    again = count_tokens(trees.where(edited).select("doc_id", "n_tokens", "edits", "_text", "_lengths", "_counts"), VOCABULARY, "_text", "edits", "_lengths", "_counts", leaves=False)
    return rest.unionByName(again.select("doc_id", "n_tokens", F.col("_n_edits").alias("n_edits"), F.col("_n_tokens").alias("n_tokens_edited"), F.col("_n_pieces").alias("n_pieces"), F.col("_n_again").alias("n_encoded_again")))
