"""Quality rules: how well public vocabularies fit a text, with rejection bands by language or script, beside plain counts."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgweave.llm.base import cut, drop_cut, lean, quoted, small, table
from kgweave.llm.tokens import Encoder

#: Public vocabularies, as paths or URIs that the driver can read: byte-level merges (tiktoken), and pieces with byte fallback (sentencepiece).
RANKS, PIECES = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model"
#: Words of a repeated window; bytes of text handled at once; words and tokens that a worker remembers.
WINDOW, CHUNK, REMEMBERED, REMEMBERED_TOKENS = 8, 4 << 20, 600_000, 6_000_000
#: New words encoded in one call.
BLOCK = 20_000
#: Rules on plain counts: fewest words, and percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Documents that a group needs for bands of its own.
LEAST_DOCS = 50
#: Widths of a band beyond its quartiles.
REACH = 3.0


@dataclass(frozen=True)
class Measure:
    """low, high: whether a value can be too small or too large. slack: least distance of a fence from its quartile. step: values are taken in steps of it."""

    name: str
    low: bool
    high: bool
    slack: float
    step: float = 0.001


MEASURES = (Measure("chars_per_token", True, True, 0.3), Measure("chars_per_piece", True, True, 0.3), Measure("fallback_share", False, True, 0.05), Measure("token_entropy", True, True, 0.5))

#: Scripts by their main ranges of code points (Unicode blocks). Fixed values.
SCRIPTS = (
    (0x0041, 0x005A, "latin"), (0x0061, 0x007A, "latin"), (0x00C0, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
)
NAMES = sorted({s[2] for s in SCRIPTS})


def script_of(text: bytes) -> str:
    """The script of most letters, ties to the first by name; ``none`` without letters of a known one."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first, last = np.array([s[0] for s in SCRIPTS]), np.array([s[1] for s in SCRIPTS])
    at = np.searchsorted(first, points, "right") - 1
    inside = (at >= 0) & (points <= last[np.maximum(at, 0)])
    if not inside.any():
        return "none"
    index = np.array([NAMES.index(s[2]) for s in SCRIPTS])
    return NAMES[int(np.bincount(index[at[inside]], minlength=len(NAMES)).argmax())]


class Words:
    """What the vocabularies make of each word on its own: token ids, and numbers of pieces and of byte pieces."""

    def __init__(self, ranks: bytes, pieces: bytes):
        self.bpe = Encoder(ranks).bpe
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.widths = np.array([len(self.bpe.decode_single_token_bytes(i)) for i in range(self.bpe.n_vocab)], np.int64)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.tokens, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.counts = np.zeros((1 << 14, 2), np.int32)
        self.filled = 0

    def learn(self, words: list[bytes]) -> None:
        new = list(set(words) - self.index.keys())
        for i in range(0, len(new), BLOCK):
            self.append(new[i : i + BLOCK])

    def append(self, new: list[bytes]) -> None:
        # words in a row are encoded as each alone: no pre-token goes on beyond a blank that a word follows
        text = b"".join([b" " + w for w in new]).decode("utf-8", "replace")
        flat = np.array(self.bpe.encode_ordinary(text), np.int32)
        bounds = np.cumsum([len(w) + 1 for w in new])
        ends = np.searchsorted(np.cumsum(self.widths[flat]), bounds) + 1
        pieces = self.pieces.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
        n_pieces = np.fromiter(map(len, pieces), np.int64, len(new))
        byte_pieces = np.cumsum(self.fallback[np.fromiter(chain.from_iterable(pieces), np.int64, int(n_pieces.sum()))])
        upto = np.concatenate(([0], byte_pieces))[np.concatenate(([0], np.cumsum(n_pieces)))]
        n = len(self.index)
        while len(self.ends) < n + len(new):
            self.ends, self.counts = np.concatenate((self.ends, self.ends)), np.concatenate((self.counts, self.counts))
        while len(self.tokens) < self.filled + len(flat):
            self.tokens = np.concatenate((self.tokens, self.tokens))
        self.tokens[self.filled : self.filled + len(flat)] = flat
        self.ends[n : n + len(new)] = self.filled + ends
        self.counts[n : n + len(new), 0], self.counts[n : n + len(new), 1] = n_pieces, np.diff(upto)
        self.filled += len(flat)
        self.index.update(zip(new, range(n, n + len(new)), strict=True))

    def forget(self) -> None:
        if len(self.index) > REMEMBERED or self.filled > REMEMBERED_TOKENS:
            self.clear()

    def sizes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of tokens of each word."""
        start = np.where(words > 0, self.ends[words - 1], 0)
        return start, self.ends[words] - start


@functools.lru_cache(maxsize=1)
def opened(ranks: bytes, pieces: bytes) -> Words:
    return Words(ranks, pieces)


def dense(x: np.ndarray) -> tuple[np.ndarray, int]:
    values, inverse = np.unique(x, return_inverse=True)
    return inverse.astype(np.int64), len(values)


def repeated(words: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Of each document how many of its words are in windows of WINDOW words that it holds twice or more.

    Equal windows get equal numbers by pairs of pairs of pairs, exactly.
    """
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(docs, np.int64)
    at, width, (number, most) = len(words), 1, dense(words)
    while width < WINDOW:
        at -= width
        number, most = dense(number[:at] * most + number[width : width + at])
        width *= 2
    whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    again, count = np.unique(number[whole] * docs + doc[whole], return_inverse=True, return_counts=True)[1:]
    starts = whole[count[again] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=docs)


def entropies(known: Words, words: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document its tokens and their entropy in bits."""
    start, size = known.sizes(words)
    total = np.bincount(doc, size, docs)
    at = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(words) else np.zeros(0, np.int64)
    each, n = np.unique(np.repeat(doc, size) << 32 | known.tokens[at], return_counts=True)
    mass = np.bincount(each >> 32, n * np.log2(n), docs) if len(each) else np.zeros(docs)
    whole = np.maximum(total, 1)
    return total, np.maximum(np.log2(whole) - mass / whole, 0)


def counted(known: Words, texts: list[bytes]) -> dict[str, np.ndarray]:
    """Plain counts and measures of some texts."""
    split = [t.split() for t in texts]  # bytes are split at the blanks 09-0D and 20
    docs, n = len(texts), np.array([len(w) for w in split], np.int64)
    flat = list(chain.from_iterable(split))
    known.learn(flat)
    words = np.fromiter(map(known.index.__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(docs), n)
    starts = np.cumsum([0, *map(len, texts)])
    x = np.frombuffer(b"".join(texts), np.uint8)
    upto = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit)))[starts])
    chars = upto((x & 0xC0 != 0x80) & (x != 0x20) & ~((x >= 0x09) & (x <= 0x0D)))
    symbols = upto(np.isin(x, np.frombuffer(b"#*$%&|<>", np.uint8)))
    twice = []
    for t in texts:
        lines = [y for y in t.split(b"\n") if y and not y.isspace()]
        twice.append(len(lines) - len(set(lines)))
    tokens, entropy = entropies(known, words, doc, docs)
    pieces, fallback = (np.bincount(doc, known.counts[words, i], docs) for i in (0, 1))
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": np.array(twice, np.int64), "n_repeat_words": repeated(words, doc, docs), "n_tokens": tokens.astype(np.int64),
        "chars_per_token": chars / np.maximum(tokens, 1), "chars_per_piece": chars / np.maximum(pieces, 1), "fallback_share": fallback / np.maximum(pieces, 1), "token_entropy": entropy,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")


def measured(df: DataFrame, text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ("doc_id",), ranks: str = RANKS, pieces: str = PIECES) -> DataFrame:
    """_group, COUNTS, the four MEASURES and the carried columns, one row for each of ``df``; texts are left behind.

    Words are runs of anything but the blanks 20 and 09-0D; each is encoded alone, behind a blank. _group is the language, or the
    script of most letters where it is null or empty. A null text has no words; without words all measures are 0.
    Texts are handled CHUNK bytes at a time, a longer one alone and whole, at about 25 times its size in memory.
    """
    spark = df.sparkSession
    files = []
    for f in (ranks, pieces):
        fs, path = pafs.FileSystem.from_uri(f)
        with fs.open_input_stream(path) as s:
            files.append(s.read())
    files = spark.sparkContext.broadcast(tuple(files))  # two files of a fixed size
    held = df.select(F.encode(F.coalesce(F.col(quoted(text)), F.lit("")), "utf-8").alias("t"), F.col(quoted(lang)).cast("string").alias("l"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carry)])
    schema = ", ".join(["_group string", *[f"{c} long" for c in COUNTS], *[f"{m.name} double" for m in MEASURES], *[f"c{i} {held.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(*files.value)
        for b in batches:
            lengths = pa.compute.binary_length(b.column(0)).to_numpy()
            group = np.cumsum(lengths.astype(np.int64)) // CHUNK
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(group)) + 1):
                if not len(part):
                    continue
                own = b.slice(int(part[0]), len(part))
                texts = own.column(0).to_pylist()
                found = counted(known, texts)
                known.forget()
                groups = [lang or f"script {script_of(t)}" for lang, t in zip(own.column(1).to_pylist(), texts, strict=True)]
                columns = [pa.array(groups, pa.string()), *[pa.array(found[c], pa.int64()) for c in COUNTS], *[pa.array(found[m.name], pa.float64()) for m in MEASURES], *own.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["_group", *COUNTS, *[m.name for m in MEASURES], *[f"c{i}" for i in range(len(carry))]])

    out = held.mapInArrow(lean(run), schema)
    return out.select("_group", *COUNTS, *[m.name for m in MEASURES], *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def length_class() -> Column:
    """Doublings of the number of tokens: measures of short texts scatter more, and entropy grows with length."""
    return F.floor(F.log2(F.greatest("n_tokens", F.lit(1)).cast("double"))).cast("int")


def bands(rows: DataFrame) -> DataFrame:
    """_of (group, null: of all), _class, and low and high of each measure: fences around the quartiles of all rows that pass the plain rules.

    A fence is REACH times the distance of the quartiles, or the slack if that is more, outside its quartile. Quartiles
    are exact in steps: rows are counted by group, class and step before they are ordered, and a group has as many
    steps as its measures have. Groups of fewer than LEAST_DOCS rows are left out.
    """
    kept = rows.where(~base_failed()).select(F.explode(F.array("_group", F.lit(None).cast("string"))).alias("_of"), length_class().alias("_class"), *[m.name for m in MEASURES])
    each = kept.select("_of", "_class", F.posexplode(F.array(*[F.round(F.col(m.name) / m.step).cast("long") for m in MEASURES])).alias("i", "bin"))
    steps = each.groupBy("_of", "_class", "i", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("_of", "_class", "i")
    upto = steps.select("*", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("all")).where(F.col("all") >= LEAST_DOCS)
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin")))
    found = upto.groupBy("_of", "_class", "i").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    step, slack = (F.element_at(F.array(*[F.lit(getattr(m, a)) for m in MEASURES]), F.col("i") + 1) for a in ("step", "slack"))
    reach = F.greatest(REACH * (F.col("q3") - F.col("q1")) * step, slack)
    fences = found.select("_of", "_class", "i", (F.col("q1") * step - reach).alias("low"), (F.col("q3") * step + reach).alias("high"))
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    return fences.groupBy("_of", "_class").agg(*[pick(i, c).alias(f"{c}_{m.name}") for i, m in enumerate(MEASURES) for c in ("low", "high") if getattr(m, c)])


def judged(rows: DataFrame) -> DataFrame:
    """Rows of ``measured`` (written, as they are read twice) with base_failed, kept and ``rejected_by``: the measures outside the bands.

    A text is held against the bands of its group and length class, else against those of all texts of its class; where
    neither has enough texts nothing is known and it stays. A text that fails the plain rules is not kept.
    """
    found = cut(bands(rows), "bands")
    n = found.count()  # groups times length classes
    own = small(found.where("_of IS NOT NULL").withColumnRenamed("_class", "_own"), n, 100_000)
    every = small(found.where("_of IS NULL").select(F.col("_class").alias("_any"), F.struct(*[c for c in found.columns if c[0] != "_"]).alias("_all")), n, 100_000)
    fences = [c for c in found.columns if c[0] != "_"]
    joined = rows.withColumn("_class", length_class()).join(own, (F.col("_group") == F.col("_of")) & (F.col("_class") == F.col("_own")), "left").join(every, F.col("_class") == F.col("_any"), "left")
    limit = lambda c: F.when(F.col("_of").isNull(), F.col("_all")[c]).otherwise(F.col(c))
    out = {m.name: F.lit(False) for m in MEASURES}
    for c in fences:
        side, name = c.split("_", 1)
        out[name] = out[name] | F.coalesce(F.col(name) < limit(c) if side == "low" else F.col(name) > limit(c), F.lit(False))
    names = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in out.items()]))
    joined = joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_join(names, ","))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == "")).select(*rows.columns, "base_failed", "rejected_by", "kept")


def op12_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, measures and verdict of every document. Null and empty texts have no words and fail; repeated rows are
    judged alike, one for one; an empty table gives an empty one; a null language goes by script."""
    rows = cut(measured(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "measured")
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "n_tokens", *[m.name for m in MEASURES])
