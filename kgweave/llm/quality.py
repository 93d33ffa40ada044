"""Quality classifier: an interpolated modified Kneser-Ney model of UTF-8 byte n-grams, trained on trusted text.

Counts, continuation counts, discounts and interpolated probabilities are Spark tables joined by n-gram key. The model
is stored as shards of bounded size; scoring tasks read shards one after another, so documents are never shuffled.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.llm.base import cut, drop_cut, lean, new_folder, others, quoted, release, small, table

#: Bytes of an n-gram: longer than most syllables, so that counts go on growing with the text.
ORDER = 6
#: Rows of one model shard, of which a worker holds one. n-grams of up to WIDE bytes are in every shard: some 100,000.
SHARD_ROWS, WIDE = 1_500_000, 3
#: Positions of one numpy pass, which takes some 80 bytes for each; counts that a task holds before it adds them up.
SEGMENT, HELD = 1 << 18, 4 << 20
#: Bytes of text of one task scored against one shard before the next is loaded.
CHUNK = 16 << 20
#: A document's cross entropy is shrunk towards its language's median as if it had so many more bytes.
PRIOR = 200
#: Share of a language's trusted text, scored by a model that did not train on it, that the limit keeps; and parts for that.
KEPT, FOLDS = 0.98, 2
#: Steps of one nat a byte in which medians and limits are taken.
BINS = 10_000
#: Beyond the greatest order.
ORDERS = 8
OWN = ("_q_bytes", "_q_loss", "_q_mid", "_q_limit", "_q_keep")
NO_LANGUAGE = "und"


def padded(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, order - 1 zeros before each, and the end of each text in them."""
    texts = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lengths = np.diff(offsets)
    gap = order - 1
    ends = np.cumsum(lengths + gap)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    for start, end, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ends.tolist(), strict=True):
        out[at - (end - start) : at] = data[start:end]
    return out, ends


def pads(ends: np.ndarray, lo: int, hi: int, lengths: np.ndarray, gap: int) -> np.ndarray:
    """Which positions of [lo, hi) are text."""
    real = np.zeros(hi - lo + 1, np.int32)
    begin, stop = np.clip(ends - lengths, lo, hi) - lo, np.clip(ends, lo, hi) - lo
    np.add.at(real, begin, 1)
    np.add.at(real, stop, -1)
    return np.cumsum(real[:-1]) > 0


def keys(x: np.ndarray, lo: int, hi: int, order: int) -> np.ndarray:
    """The last ``order`` bytes up to each position of [lo, hi), as one integer (lo >= order - 1)."""
    out = x[lo:hi].astype(np.int64)
    for j in range(1, order):
        out |= x[lo - j : hi - j].astype(np.int64) << (8 * j)
    return out


def count_grams(df: DataFrame, text: str, order: int) -> DataFrame:
    """key, n of all n-grams of the texts; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate([h[1] for h in held])).astype(np.int64)

        for b in batches:
            x, ends = padded(b.column(0), order)
            lengths = np.diff(np.concatenate(([0], ends))) - (order - 1)
            for lo in range(order - 1, len(x), SEGMENT):
                hi = min(lo + SEGMENT, len(x))
                held.append(np.unique(keys(x, lo, hi, order)[pads(ends, lo, hi, lengths, order - 1)], return_counts=True))
                if sum(len(h[0]) for h in held) > HELD:
                    held[:] = [merged()]
        if held:
            k, n = merged()
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["key", "n"])

    return df.select(text).mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; 0.5, 1, 1.5 where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def train(trusted: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """Model rows, to be saved: ord, key, logp (interpolated, of the n-gram's last byte) and logb (of the n-gram as a context of the next order)."""
    counts = {order: cut(count_grams(trusted, text, order), "counts")}
    for o in range(order - 1, 0, -1):  # continuation counts: how many different bytes stand before
        counts[o] = counts[o + 1].groupBy((F.col("key").bitwiseAND(F.lit((1 << 8 * o) - 1))).alias("key")).agg(F.count("*").alias("n"))
    for o in range(order - 1, 0, -1):
        counts[o] = cut(counts[o], f"counts{o}")
    of = functools.reduce(DataFrame.unionByName, [c.select(F.lit(o).alias("o"), "n").where("n <= 4").groupBy("o", "n").agg(F.count("*").alias("c")) for o, c in counts.items()])
    seen = {(r.o, r.n): r.c for r in of.collect()}
    probability, rows, tables = None, [], []
    for o in range(1, order + 1):
        d1, d2, d3 = discounts(*(seen.get((o, i), 0) for i in (1, 2, 3, 4)))
        d = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        ctx = F.shiftright("key", 8)
        # whole numbers are added, so that a model does not depend on the order of rows
        of_count = [F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") > 2)]
        back = functools.reduce(operator.add, [c * x for c, x in zip(of_count, (d1, d2, d3), strict=True)])
        contexts = counts[o].groupBy(ctx.alias("ctx")).agg(F.sum("n").alias("total"), (back / F.sum("n")).alias("back"))
        lower = F.lit(1 / 256) if o == 1 else F.col("lower")
        grams = counts[o].select("key", "n", ctx.alias("ctx")).join(contexts, "ctx")
        if o > 1:
            grams = grams.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * (o - 1)) - 1))).join(probability.select(F.col("key").alias("suffix"), F.col("p").alias("lower")), "suffix")
        probability = cut(grams.select("key", ((F.col("n") - d) / F.col("total") + F.col("back") * lower).alias("p")), f"p{o}")
        tables.append(probability)
        rows.append(probability.select(F.lit(o).alias("ord"), "key", F.log("p").alias("logp"), F.lit(None).cast("double").alias("logb")))
        rows.append(contexts.select(F.lit(o).alias("ord"), F.col("ctx").alias("key"), F.lit(None).cast("double").alias("logp"), F.log("back").alias("logb")))
    model = functools.reduce(DataFrame.unionByName, rows)
    model._parts = [*counts.values(), *tables]
    return model


def shard_of(context: Column | np.ndarray, shards: int) -> Column | np.ndarray:
    """By the WIDE bytes before the last: all longer n-grams of one position share them."""
    mask = (1 << 8 * WIDE) - 1
    if isinstance(context, Column):
        return F.pmod(context.bitwiseAND(F.lit(mask)) * F.lit(40503), F.lit(16777259)) % F.lit(shards)
    return (context & mask) * 40503 % 16777259 % shards


def save(model: DataFrame, shards: int | None = None) -> tuple[str, tuple[str, ...]]:
    """Write the model as one Arrow file a shard in the shared folder: the folder, and the file of each shard ('' for none).

    Orders up to WIDE are in every shard. A file is named by the attempt that wrote it and never
    replaced; those of lost attempts are not among the names returned.
    """
    spark = model.sparkSession
    model = cut(model, "model")
    shards = shards or max(1, math.ceil(model.count() / SHARD_ROWS))
    uri = new_folder(spark, "shards")
    context = F.when(F.col("logb").isNotNull(), F.col("key")).otherwise(F.shiftright("key", 8))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    dealt = model.withColumn("shard", F.explode(F.when(F.col("ord") <= WIDE, every).otherwise(F.array(shard_of(context, shards).cast("int")))))
    kind = F.col("logb").isNotNull()
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("ord", kind, "key")  # one shard a partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        t = pa.Table.from_batches(list(batches))
        shard = t.column("shard")[0].as_py()
        name = f"shard-{shard}-{TaskContext.get().taskAttemptId()}"
        value = pa.compute.coalesce(t.column("logp"), t.column("logb"))
        kept = pa.table({"ord": t.column("ord").cast(pa.int8()), "back": t.column("logb").is_valid(), "key": t.column("key"), "value": value})
        with fs.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_file(out, kept.schema) as writer:
            writer.write_table(kept)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name], pa.string())], ["shard", "file"])

    files = {r.shard: r.file for r in dealt.mapInArrow(guarded(run), "shard int, file string").collect()}  # a name a shard
    drop_cut(model)
    return uri, tuple(files.get(s, "") for s in range(shards))


def trained(texts: DataFrame, text: str, order: int) -> tuple[str, tuple[str, ...]]:
    """A saved model; the tables it was made of are gone."""
    model = train(texts, text, order)
    out = save(model)
    drop_cut(*model._parts)
    release(texts.sparkSession)
    return out


def guarded(run):  # noqa: ANN001, ANN201
    """Empty partitions have no batch, and so no schema."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from run(held)

    return whole


@functools.lru_cache(maxsize=1)
def load(uri: str, file: str) -> dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and values by (order, logp or logb)."""
    if not file:
        return {}
    fs, root = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(f"{root}/{file}") as f:
        t = pa.ipc.open_file(f).read_all()
    order, back, key, value = (t.column(c).to_numpy() for c in ("ord", "back", "key", "value"))
    # rows are in order of these, so each table is a slice
    tables = 2 * order.astype(np.int16) + back
    first = np.searchsorted(tables, np.arange(2 * ORDERS + 2))
    return {(o, what): (key[a:b], value[a:b]) for o in range(1, ORDERS) for i, what in enumerate(("logp", "logb")) for a, b in [first[2 * o + i : 2 * o + i + 2]] if b > a}


def find(part: dict, o: int, what: str, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, value = part.get((o, what), (np.zeros(0, np.int64), np.zeros(0)))
    if not len(known):
        return np.zeros(len(k), bool), np.zeros(len(k))
    at = np.searchsorted(known, k)
    at[at == len(known)] = 0
    return known[at] == k, value[at]


def log_probability(part: dict, k: np.ndarray, order: int) -> np.ndarray:
    """Natural logarithm of each n-gram's last byte given the bytes before it."""
    out = np.zeros(len(k))
    left = np.arange(len(k))
    for o in range(order, 0, -1):
        rest = k[left] & ((1 << 8 * o) - 1)
        known, value = find(part, o, "logp", rest)
        out[left[known]] += value[known]
        left, rest = left[~known], rest[~known]
        if not len(left):
            return out
        known, value = find(part, o, "logb", rest >> 8)
        out[left[known]] += value[known]
    out[left] -= math.log(256)
    return out


def scored(df: DataFrame, uri: str, files: tuple[str, ...], text: str = "text", order: int = ORDER) -> DataFrame:
    """``df`` with _q_bytes and _q_loss (nats over all bytes of the text). All columns and rows pass through.

    An n-gram and all that it backs off to are in one shard, so each position is looked up in one. A task holds CHUNK
    bytes of its text and one shard at a time, and reads every shard once for each CHUNK; a join of positions with
    counts would move many times the text.
    """
    shards = len(files)
    schema = T.StructType([*df.schema.fields, T.StructField("_q_bytes", T.LongType()), T.StructField("_q_loss", T.DoubleType())])
    column = df.columns.index(text)

    def losses(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        x, ends = padded(texts, order)
        lengths = np.diff(np.concatenate(([0], ends))) - (order - 1)
        total = np.zeros(len(ends))
        for shard, file in enumerate(files):
            part = load(uri, file)
            for lo in range(order - 1, len(x), SEGMENT):
                hi = min(lo + SEGMENT, len(x))
                k = keys(x, lo, hi, order)
                own = pads(ends, lo, hi, lengths, order - 1)
                if shards > 1:
                    own &= shard_of(k >> 8, shards) == shard
                loss = np.zeros(hi - lo)
                each, again = np.unique(k[own], return_inverse=True)  # far fewer than positions, and looked up in order
                loss[own] = -log_probability(part, each, order)[again]
                first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi - 1, "right")
                doc = np.searchsorted(ends, np.arange(lo, hi), "right") if last > first else None
                if doc is None:
                    total[first] += loss.sum()
                else:
                    total[first : last + 1] += np.bincount(doc - first, loss, last - first + 1)
        return total

    def scored_(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches with their losses: each shard is loaded once for all of them."""
        found = losses(pa.chunked_array([b.column(column) for b in held]).combine_chunks())
        for b in held:
            n = pa.compute.binary_length(b.column(column)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n, pa.array(found[: b.num_rows])], [f.name for f in schema.fields])
            found = found[b.num_rows :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            held, size = [], 0
            for b in batches:
                n = pa.compute.binary_length(b.column(column)).fill_null(0).to_numpy().astype(np.int64)
                group = (size + np.cumsum(n)) // CHUNK
                for rows in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(group)) + 1):
                    if not len(rows):
                        continue
                    part = int(n[rows].sum())
                    if held and size + part > CHUNK:
                        yield from scored_(held)
                        held, size = [], 0
                    held.append(b.slice(int(rows[0]), len(rows)))
                    size += part
            if held:
                yield from scored_(held)
        finally:
            load.cache_clear()  # the worker outlives the task

    return df.mapInArrow(lean(run), schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that are labelled, of good quality in all their labels and toxic in none."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND coalesce(t, 0) = 0").select("doc_id")


def held_out(trusted: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """_q_name (language), _q_bytes, _q_loss of trusted texts, each scored by a model of the other parts. Copies are in one part."""
    dealt = trusted.select(lang, text, F.pmod(F.xxhash64(text), F.lit(FOLDS)).alias("_q_fold"))
    parts = []
    for fold in range(FOLDS):
        model = trained(dealt.where(F.col("_q_fold") != fold), text, order)
        parts.append(scored(dealt.where(F.col("_q_fold") == fold), *model, text, order))
    every = functools.reduce(DataFrame.unionByName, parts).where("_q_bytes > 0")
    return cut(every.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("_q_name"), "_q_bytes", "_q_loss"), "held_out")


def shrunk() -> Column:
    """Cross entropy (nats a byte), shrunk towards the language's median by PRIOR bytes."""
    return (F.col("_q_loss") + PRIOR * F.col("_q_mid")) / (F.col("_q_bytes") + PRIOR)


def binned(value: Column) -> Column:
    return F.round(value * BINS).cast("long")


def quantile(rows: DataFrame, value: Column, share: float, name: str) -> DataFrame:
    """_q_lang and ``name``: the least value, in steps of 1 / BINS, that at least ``share`` of a language's rows do not exceed.

    Exact: rows are counted by language and step, and a language has a few 100,000 steps at most.
    """
    counts = rows.select("_q_lang", binned(value).alias("bin")).groupBy("_q_lang", "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("_q_lang")
    upto = counts.select("_q_lang", "bin", F.sum("n").over(whole.orderBy("bin")).alias("upto"), F.sum("n").over(whole).alias("all"))
    return upto.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("_q_lang").agg((F.min("bin") / BINS).alias(name))


def limits(losses: DataFrame) -> DataFrame:
    """_q_lang, _q_mid, _q_limit (nats a byte): of each language the median, and the limit that keeps KEPT of ``losses``; _q_lang null: of all."""
    each = losses.withColumn("_q_lang", F.explode(F.array("_q_name", F.lit(None).cast("string"))))
    mids = cut(quantile(each, F.col("_q_loss") / F.col("_q_bytes"), 0.5, "_q_mid"), "medians")
    languages = mids.count()
    with_mid = each.join(small(mids.withColumnRenamed("_q_lang", "_q_of"), languages, 100_000), F.col("_q_lang").eqNullSafe(F.col("_q_of")))
    top = quantile(with_mid, shrunk(), KEPT, "_q_limit").withColumnRenamed("_q_lang", "_q_of")
    return mids.join(small(top, languages, 100_000), F.col("_q_lang").eqNullSafe(F.col("_q_of"))).drop("_q_of")


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """``docs`` with _q_bytes, _q_loss, _q_mid, _q_limit and _q_keep, which replace columns of these names.

    Trained on all trusted documents; the limits come from trusted text scored by models that did not see it. Kept is a
    document whose cross entropy, shrunk towards the median of its language by PRIOR bytes, is at most the language's
    limit; a language without trusted text, and a null language, take the limits of all. Null and empty texts have no
    perplexity and are not kept. Rows are judged one for one, repeated ones alike; a null doc_id is never trusted, but
    judged. Without any trusted text nothing is known and every text is kept; an empty table gives an empty one.
    """
    return _judged(docs, labels, text, lang, doc_id, order, others(docs, *OWN), OWN)


def kept(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns and no others."""
    return _judged(docs, labels, text, lang, doc_id, order, docs.columns, ())


def _judged(docs: DataFrame, labels: DataFrame, text: str, lang: str, doc_id: str, order: int, columns: list[str], own: tuple[str, ...]) -> DataFrame:
    """Columns travel under numbers, so that none clashes with an operator's own; without ``own`` only kept rows."""
    number = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.select(*[F.col(quoted(c)).alias(n) for c, n in number.items()])
    text, lang, doc_id = number[text], number[lang], number[doc_id]
    ids = trusted_ids(labels)
    trusted = docs.join(small(ids, ids.count()).withColumnRenamed("doc_id", "_q_id"), F.col(doc_id) == F.col("_q_id"), "left_semi")
    model = trained(trusted, text, order)
    found = cut(limits(held_out(trusted, text, lang, order)), "limits")  # a row for each language
    every = found.where("_q_lang IS NULL").first()
    by_lang = small(found.where("_q_lang IS NOT NULL"), found.count(), 100_000)
    out = scored(docs, *model, text, order).withColumn("_q_name", F.coalesce(F.col(lang), F.lit(NO_LANGUAGE))).join(by_lang, F.col("_q_name") == F.col("_q_lang"), "left").drop("_q_name", "_q_lang")
    mid, limit = (every["_q_mid"], every["_q_limit"]) if every else (None, None)
    out = out.withColumn("_q_mid", F.coalesce("_q_mid", F.lit(mid).cast("double"))).withColumn("_q_limit", F.coalesce("_q_limit", F.lit(limit).cast("double")))
    out = out.withColumn("_q_keep", (F.col("_q_bytes") > 0) & F.coalesce(binned(shrunk()) <= binned(F.col("_q_limit")), F.lit(True)))
    return (out if own else out.where("_q_keep")).select(*[F.col(number[c]).alias(c) for c in columns], *own)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity a byte of every document, its language's limit, and whether it is kept. Null and empty texts have no
    perplexity; otherwise as in judged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    perplexity = lambda c: F.exp(c)
    return judged(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "lang", F.col("_q_bytes").alias("n_bytes"), F.when(F.col("_q_bytes") > 0, perplexity(F.col("_q_loss") / F.col("_q_bytes"))).alias("perplexity"),
        perplexity(F.col("_q_limit")).alias("threshold"), F.col("_q_keep").alias("keep"),
    )
