"""N-gram Jaccard join by token-combination prefixes.

Tokens are hashed shingles. A document's prefix is its rarest tokens, extended until more signatures stand in it than
the tokens that a partner may lack. Rare tokens are signatures by themselves; frequent tokens only in pairs of one
subclass. So two documents that are similar enough share a signature, and a frequent token alone never makes a
candidate. Candidates are verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.llm.base import cut, drop_cut, give_back, lean, quoted, release, row_of, small, table, unpacked
from kgweave.llm.components import components
from kgweave.llm.shingles import Hasher, U, mix, set_id

#: Documents up to which a token counts as rare.
RARE = 8
#: Set sizes at which another part of the tokens is used, and that part as a multiple of (1 - similarity).
REGIMES = ((1, 10.0), (101, 5.0), (401, 2.5))
#: Tokens of one task in the frequency count, documents of one of its salts, and least number of token ranges.
TASK_TOKENS, TASK_DOCS, LEAST_RANGES = 1_500_000, 2_000_000, 64
#: Tokens that a task holds before it hands them on.
HELD = 2_000_000
#: Holders of a signature from which on its undecided pairs are compared in blocks, sets of a block, and tokens compared at once.
MANY, BLOCK, COLUMNS = 64, 512, 4096


class Threshold:
    """100 * intersection >= percent * union, in integers."""

    def __init__(self, percent: int):
        self.percent = percent
        share = (100 - percent) / 100
        tops = [lo for lo, _ in REGIMES[1:]] + [None]
        self.regimes = [(lo, None if hi is None else (hi - 1) * 100 // percent, min(1.0, c * share)) for (lo, c), hi in zip(REGIMES, tops, strict=True)]

    def spare(self, n: int) -> int:
        """Tokens of n that a partner may lack."""
        return n - -(-n * self.percent // 100)

    def of(self, n: int) -> list[int]:
        """Regimes of a set of n tokens: its own, and the one below if a smaller partner can be in that."""
        return [r for r, (lo, hi, _) in enumerate(self.regimes) if n >= lo and (hi is None or n <= hi)]

    def used(self, s: np.ndarray, r: int) -> np.ndarray:
        """The tokens of a sorted set that regime r uses: a fixed part of all tokens."""
        q = self.regimes[r][2]
        return s if q >= 1 else s[: np.searchsorted(s, U(int(q * 2**64)))]

    def alone(self, n: int) -> bool:
        """No other set than an equal one can be similar: n tokens and one more are already too far apart."""
        return 100 * n < self.percent * (n + 1)


def stats(docs: DataFrame, k: int, th: Threshold) -> DataFrame:
    """doc_id, n (set size), rid (names the set; null for an empty one), used (tokens by regime), and the columns of docs after text."""
    more = docs.schema.fields[2:]
    schema = T.StructType([*T._parse_datatype_string("doc_id long, n long, rid long, used array<long>").fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            n, rid, used = [0] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            for row, s in hasher.sets(b.column(1), k):
                if len(s):
                    n[row], rid[row], used[row] = len(s), set_id(s), [len(th.used(s, r)) for r in range(len(th.regimes))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(rid, pa.int64()), pa.array(used, pa.list_(pa.int64())), *b.columns[2:]], [f.name for f in schema.fields])

    return docs.mapInArrow(lean(run), schema)


def token_pieces(docs: DataFrame, k: int, th: Threshold, ranges: list[int], salts: int) -> DataFrame:
    """Tokens and set names packed by regime, token range and salt: part, salt, tokens, rids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        seen: set[int] = set()
        held: list[list[tuple[np.ndarray, int]]] = [[] for _ in th.regimes]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, int, bytes, bytes]] = []
            for r, sets in enumerate(held):
                if not sets:
                    continue
                tokens = np.concatenate([s for s, _ in sets])
                rids = np.repeat(np.array([rid for _, rid in sets], np.int64), [len(s) for s, _ in sets])
                q = int(min(th.regimes[r][2], 1.0) * 2**32)
                part = ((tokens >> U(32)) * U(ranges[r]) // U(max(q, 1))).astype(np.int64)
                group = np.minimum(part, ranges[r] - 1) * salts + rids % salts
                by = np.argsort(group, kind="stable")
                tokens, rids, group = tokens[by], rids[by], group[by]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    g = int(group[a]) if b > a else 0
                    out.append((r * 10_000_000 + g // salts, g % salts, tokens[a:b].tobytes(), rids[a:b].tobytes()))
                sets.clear()
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64], strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "salt", "tokens", "rids"])

        for b in batches:
            for _, s in hasher.sets(b.column(1), k):
                if not len(s) or th.alone(len(s)) or (rid := set_id(s)) in seen:
                    continue
                seen.add(rid)
                for r in th.of(len(s)):
                    used = th.used(s, r)
                    held[r].append((used, rid))
                    size += len(used)
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(lean(run), "part int, salt int, tokens binary, rids binary")


def _pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (token, set), by token."""
    tokens = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")])
    rids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t.column("rids")])
    by = np.lexsort((rids, tokens))
    tokens, rids = tokens[by], rids[by]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (rids[1:] != rids[:-1])
    return tokens[new], rids[new]


def shared_tokens(pieces: DataFrame, salts: int) -> DataFrame:
    """regime, rid, tok, df of tokens that two sets or more hold. With several salts a token's sets are in several tasks."""
    schema = "regime int, rid long, tok long, df long"
    names = ["regime", "rid", "tok", "df"]

    def rows(part: int, tokens: np.ndarray, rids: np.ndarray, df: np.ndarray) -> pa.Table:
        keep = df > 1
        n = int(keep.sum())
        return pa.table([pa.array(np.full(n, part // 10_000_000, np.int32)), pa.array(rids[keep]), pa.array(tokens[keep].view(np.int64)), pa.array(df[keep].astype(np.int64))], names=names)

    if salts == 1:

        def whole(t: pa.Table) -> pa.Table:
            tokens, rids = _pairs(t)
            _, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
            out = rows(t.column("part")[0].as_py(), tokens, rids, n[inverse])
            give_back()
            return out

        return pieces.groupBy("part").applyInArrow(whole, schema)

    def local(t: pa.Table) -> pa.Table:
        token, n = np.unique(_pairs(t)[0], return_counts=True)
        return pa.table([pa.array(np.full(len(token), t.column("part")[0].as_py(), np.int32)), pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["part", "tok", "n"])

    def known(t: pa.Table, totals: pa.Table) -> pa.Table:
        if not t.num_rows:
            return rows(0, *[np.zeros(0, d) for d in (np.uint64, np.int64, np.int64)])
        tokens, rids = _pairs(t)
        tok, n = totals.column("tok").to_numpy().view(np.uint64), totals.column("n").to_numpy()
        by = np.argsort(tok)
        return rows(t.column("part")[0].as_py(), tokens, rids, n[by][np.searchsorted(tok[by], tokens)])

    counted = pieces.groupBy("part", "salt").applyInArrow(local, "part int, tok long, n long").groupBy("part", "tok").agg(F.sum("n").alias("n"))
    totals = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pieces.groupBy("part", "salt").cogroup(totals.groupBy("part", "salt")).applyInArrow(known, schema)


def signatures_of(n: int, regime: int, used: int, shared: list[tuple[int, int]], th: Threshold) -> list[int]:
    """Signatures of one set. shared: (frequency, token) of its tokens that other sets hold too; its other used tokens
    come first in the order, and need no signature as nobody shares them."""
    need = th.spare(n) + 1 - (used - len(shared))
    if need <= 0:
        return []
    shared = sorted(shared)
    rare = [tok for df, tok in shared if df <= RARE]
    frequent = [tok for df, tok in shared if df > RARE]
    out = [(1, regime, tok, 0, 0) for tok in rare[:need]]
    need -= len(rare)
    if need > 0:
        size = n.bit_length() - 1
        q = th.regimes[regime][2]
        below = size - 1 if n * th.percent < (100 << size) else None  # the smallest partner's size class
        for c in (size, below):
            if c is None:
                continue
            groups = max(1, int((1 << c) * q / 3))
            members: dict[int, list[int]] = {}
            got = 0
            for tok in frequent:
                own = members.setdefault(tok % groups, [])
                out.extend((2, regime, *((x, tok) if x < tok else (tok, x)), c) for x in own)
                got += bool(own)
                own.append(tok)
                if got >= need:
                    break
            else:  # pairs do not suffice: of two such sets each has all its tokens as signatures
                out.extend((3, regime, tok, 0, c) for tok in frequent)
                if used < th.spare(n) + 1:
                    out.append((4, regime, 0, 0, c))
    if not out:
        return []
    a = np.array([[x & (2**64 - 1) for x in sig] for sig in set(out)], np.uint64)
    h = a[:, 0] * U(0x9E3779B97F4A7C15) + a[:, 1] + U(1)
    for j in (2, 3, 4):
        h = mix(h) * U(0xD6E8FEB86659FD93) + a[:, j]
    return np.unique(mix(h)).view(np.int64).tolist()


def signatures(shared: DataFrame, classes: DataFrame, th: Threshold) -> DataFrame:
    """sig, rid, n."""
    per = shared.groupBy("regime", "rid").agg(F.collect_list(F.struct("df", "tok")).alias("toks")).join(classes.select("rid", "n", "used"), "rid")
    per = per.withColumn("u", F.element_at("used", F.col("regime") + 1))
    spare = F.col("n") - F.ceil(F.col("n") * th.percent / 100)
    per = per.where(F.col("u") - F.size("toks") < spare + 1).select("rid", "n", "regime", "u", F.col("toks.df").alias("df"), F.col("toks.tok").alias("tok"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig: list[int] = []
            rid: list[int] = []
            size: list[int] = []
            for r, n, regime, u, df, tok in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = signatures_of(n, regime, u, list(zip(df, tok, strict=True)), th)
                sig += found
                rid += [r] * len(found)
                size += [n] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sig, rid, size)], ["sig", "rid", "n"])

    return per.mapInArrow(lean(run), "sig long, rid long, n long")


def whole_sets(docs: DataFrame, wanted: DataFrame, wanted_rows: int, k: int) -> DataFrame:
    """rid, tokens (binary, sorted) of the sets in ``wanted`` (rid, rep: a document that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            rids = b.column(2).to_pylist()
            out = [(rids[row], s.tobytes()) for row, s in hasher.sets(b.column(1), k) if len(s) and set_id(s) == rids[row]]
            for i in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 500], strict=True), (pa.int64(), pa.binary()), strict=True)], ["rid", "tokens"])

    joined = docs.join(small(wanted.select(F.col("rep").alias("doc_id"), "rid"), wanted_rows), "doc_id").select("doc_id", "text", "rid")
    return joined.mapInArrow(lean(run), "rid long, tokens binary")


def verified(pairs: DataFrame, sets: DataFrame, th: Threshold) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= th.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("rid").alias("b"), F.col("tokens").alias("y")), "b")
    two = one.join(sets.select(F.col("rid").alias("a"), F.col("tokens").alias("x")), "a")
    return two.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def similar(t: pa.Table, th: Threshold) -> np.ndarray:
    """Which sets of two blocks (or of one) are similar enough, as a matrix; i, j, block, tokens. Sets of one of two blocks are not compared."""
    block = t.column("block").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")]
    n = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), n)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    rows, token = rows[shared], np.unique(token[shared], return_inverse=True)[1] if shared.any() else token[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(token, kind="stable")
    rows, token = rows[by], token[by]
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        a, b = np.searchsorted(token, (lo, lo + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[rows[a:b], token[a:b] - lo] = 1
        common += m @ m.T
    both = common.astype(np.int64)
    near = 100 * both >= th.percent * (n[:, None] + n[None, :] - both)
    if t.column("i")[0].as_py() != t.column("j")[0].as_py():
        near &= block[:, None] != block[None, :]
    np.fill_diagonal(near, False)
    return near


def compare(t: pa.Table, th: Threshold) -> pa.Table:
    """Links between two blocks (or within one) of sets that join what is still apart; rid, comp, i, j, block, tokens."""
    rids, near = t.column("rid").to_numpy(), similar(t, th)
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    comp = t.column("comp").to_pylist()
    out: list[tuple[int, int]] = []
    for x, y in np.argwhere(np.triu(near, 1)).tolist():
        u, v = top(comp[x]), top(comp[y])
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((int(min(rids[x], rids[y])), int(max(rids[x], rids[y]))))
    return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def compared(mixed: DataFrame, sets: DataFrame, th: Threshold) -> DataFrame:
    """Links among sets that share a signature many hold: such sets form clusters, cut into blocks by hash, and each two
    blocks are compared as matrices. mixed: sig, rid, comp. No pair is a row; only links that join components are."""
    middle = mixed.groupBy("sig").agg(F.min("rid").alias("a"))
    clusters = components(mixed.join(middle, "sig").select("a", F.col("rid").alias("b")))
    members = clusters.select(F.col("node").alias("rid"), F.col("comp").alias("cluster")).join(mixed.groupBy("rid").agg(F.first("comp").alias("comp")), "rid")
    members = cut(members, "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).join(sets, "rid")
    sent = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rid", "comp", "tokens")
    return sent.groupBy("cluster", "i", "j").applyInArrow(lambda t: compare(t, th), "a long, b long")


def side_by_side(comp: DataFrame, docs: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """The members of each component (node, comp) cut into blocks, and each two blocks together: kind, cluster, i, j, block,
    rid, docs, tokens. Components of one block are packed together. Links are within components, so nothing else can link."""
    members = comp.withColumnRenamed("node", "rid").join(docs, "rid")
    sizes = members.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    alone = F.col("blocks") == 1
    bins = F.lit(max(1, math.ceil(2 * most / BLOCK)))
    dealt = dealt.withColumn("kind", alone.cast("int")).withColumn("cluster", F.when(alone, F.pmod(F.xxhash64("comp"), bins)).otherwise(F.col("comp"))).join(sets, "rid")
    each = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("kind", "cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rid", "docs", "tokens")


def all_links(blocks: DataFrame, th: Threshold) -> DataFrame:
    """Every link between two different sets, once: a, b (rid, a < b)."""

    def run(t: pa.Table) -> pa.Table:
        rids = t.column("rid").to_numpy()
        x, y = np.nonzero(np.triu(similar(t, th)))
        out = pa.table([pa.array(f(rids[x], rids[y])) for f in (np.minimum, np.maximum)], names=["a", "b"])
        give_back()
        return out

    return blocks.groupBy("kind", "cluster", "i", "j").applyInArrow(run, "a long, b long")


def link_counts(blocks: DataFrame, th: Threshold) -> DataFrame:
    """rid, others: documents of all different sets that a set links with. Counted within the blocks, so no link is a row."""

    def run(t: pa.Table) -> pa.Table:
        others = similar(t, th) @ t.column("docs").to_numpy()
        out = pa.table([t.column("rid").combine_chunks(), pa.array(others.astype(np.int64))], names=["rid", "others"])
        give_back()
        return out

    return blocks.groupBy("kind", "cluster", "i", "j").applyInArrow(run, "rid long, others long").groupBy("rid").agg(F.sum("others").alias("others"))


def jaccard_components(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, rid, component_id, and the columns of ``carry``) and all verified links between different sets (a, b: rid, a < b), made when
    they are read. Documents of one rid have equal sets and link with each other too.
    """
    out, blocks, th, _ = joined_sets(df, k, percent, text, doc_id, carry)
    return out, all_links(blocks, th)


def survivors(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``df`` of each group of near duplicates, with all its columns.

    Rows are judged one by one, by content: of the rows that links join, that of smallest doc_id stays (a null doc_id
    comes last; then the smallest hash of the content), whatever other rows share its doc_id. Of rows alike in doc_id
    and text one stays. Texts without words (null, empty) are nobody's duplicate; their rows all stay.
    """
    packed = df.select(row_of(df).alias("_row"), F.col(quoted(doc_id)).cast("long").alias("_d"), F.col(quoted(text)).alias("_t"))
    packed = packed.select("_row", "_d", "_t", F.xxhash64("_d", "_t").alias("_key"), F.xxhash64("_t", "_d", F.lit(1)).alias("_other"))
    found, _ = jaccard_components(packed, k, percent, "_t", "_key", ("_d", "_other"))
    named = found.where("rid IS NOT NULL").select(F.col("doc_id").alias("_key"), "_other", F.col("component_id").alias("comp"), F.struct(F.col("_d").isNull(), "_d", F.col("doc_id"), "_other").alias("order"))
    first = named.groupBy("comp").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a row of each group, and what else is in it; groups of one need no look-up
    several = cut(named.join(first, "comp").groupBy("_key", "_other").agg(F.max(F.col("order") == F.col("first")).alias("stays"), F.count("*").alias("copies")), "several")
    judged = packed.join(small(several, several.count()), ["_key", "_other"], "left").where("stays IS NULL OR stays")
    columns = unpacked(df, "_row")
    repeated = F.coalesce(F.col("copies"), F.lit(1)) > 1
    return judged.where(~repeated).select(*columns).unionByName(judged.where(repeated).dropDuplicates(["_key", "_other"]).select(*columns))


def jaccard_links(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents (doc_id, n, rid, component_id, n_links: other documents that it links with; null without doc_id).

    Rows of one doc_id count once for each set they have.
    """
    out, blocks, th, docs = joined_sets(df, k, percent, text, doc_id)
    counts = docs.join(link_counts(blocks, th), "rid", "left").select("rid", (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return out.join(counts, "rid", "left").withColumn("n_links", F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))))


def joined_sets(df: DataFrame, k: int, percent: int, text: str, doc_id: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, Threshold, DataFrame]:
    """Documents (doc_id, n, rid, component_id), the members of components side by side, and rid, docs (documents of a set).

    Sets of k-word shingles of whole texts link where 100 * intersection >= percent * union. Equal sets are one class
    from the start. Each signature's smallest set is verified against the others that hold it; only sets that this
    leaves in different components are then compared with each other, so components are those of all links. The links
    themselves come from comparing all members of each component afterwards.
    component_id is the smallest doc_id reachable. A null or empty text has the empty set and links with nothing; a
    document without doc_id keeps its row with component_id null; repeated rows each keep theirs.
    """
    th = Threshold(percent)
    docs = df.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    found = cut(stats(df.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"), *carry), k, th), "stats")
    named = found.where("rid IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(named.groupBy("rid").agg(F.first("n").alias("n"), F.first("used").alias("used"), F.min("doc_id").alias("rep")), "classes")
    sums = classes.agg(F.count("*").alias("docs"), *[F.coalesce(F.sum(F.element_at("used", r + 1)), F.lit(0)).alias(f"u{r}") for r in range(len(th.regimes))]).first()
    ranges = [max(LEAST_RANGES, math.ceil(sums[f"u{r}"] / TASK_TOKENS)) for r in range(len(th.regimes))]
    salts = max(1, math.ceil(sums["docs"] / TASK_DOCS))
    shared = shared_tokens(token_pieces(docs.where("doc_id IS NOT NULL"), k, th, ranges, salts), salts)
    sigs = cut(signatures(shared, classes, th), "signatures")
    fits = lambda m, n: F.least(m, n) * 100 >= F.greatest(m, n) * percent
    first = sigs.groupBy("sig").agg(F.min(F.struct("rid", "n")).alias("c"), F.count("*").alias("m")).where("m > 1").select("sig", "c")
    star = sigs.join(first, "sig").where(F.col("rid") != F.col("c.rid")).where(fits(F.col("n"), F.col("c.n")))
    star = cut(star.select(F.col("c.rid").alias("a"), F.col("rid").alias("b")).distinct(), "star")
    # sets that any pair may need: those of signatures that two sets hold
    held = sigs.join(first.select("sig"), "sig", "left_semi").select("rid").distinct()
    wanted = cut(classes.join(held, "rid", "left_semi").select("rid", "rep"), "wanted")
    wanted_rows = wanted.count()
    sets = cut(whole_sets(docs, wanted, wanted_rows, k), "sets")
    links = cut(verified(star, sets, th), "links")
    comp = components(links)
    where = sigs.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    apart = where.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("sig", "m")
    where = cut(where.join(apart, "sig"), "mixed")
    few, many = where.where(F.col("m") <= MANY), where.where(F.col("m") > MANY)
    x, y = (few.select("sig", *[F.col(c).alias(f"{c}{i}") for c in ("rid", "n", "comp")]) for i in (1, 2))
    rest = x.join(y, "sig").where("comp1 < comp2").where(fits(F.col("n1"), F.col("n2")))
    rest = rest.select(F.least("rid1", "rid2").alias("a"), F.greatest("rid1", "rid2").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = verified(rest, sets, th)
    if not many.isEmpty():
        more = more.union(compared(many, sets, th))
    more = cut(more, "more")
    if not more.isEmpty():
        first_comp, comp = comp, components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
        drop_cut(first_comp)
    drop_cut(sigs, star, wanted, links, where, more)
    release(df.sparkSession)
    reps = classes.select("rid", "rep").join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    least = reps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = reps.join(least, "comp").select("rid", "component_id")
    out = found.join(by_class, "rid", "left").select("doc_id", "n", "rid", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *carry)
    holders = named.select("rid", "doc_id").distinct().groupBy("rid").agg(F.count("*").alias("docs"))
    return out, side_by_side(comp, holders, sets, wanted_rows), th, holders


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document. Nulls, empty texts and repeated rows as in joined_sets."""
    docs, _ = jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)
    return docs.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op5_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_ngram_join with each document's number of links."""
    docs = jaccard_links(table(spark, sf_dir, "documents"), k=3, percent=90)
    return docs.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * common >= 90 * (na + nb - common)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (
  WITH RECURSIVE walk AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT w.node, CASE WHEN e.a = w.seen THEN e.b ELSE e.a END FROM walk w JOIN e ON e.a = w.seen OR e.b = w.seen)
  SELECT node, min(seen) AS component_id FROM walk GROUP BY node) c ON c.node = s.doc_id"""

OP5_LINKS_SQL = f"""SELECT doc_id, n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM ({OP5_SQL}) AS o LEFT JOIN (
{OP5_SQL[: OP5_SQL.index(",\nr AS ")]} SELECT doc_id, count(*) AS n_links FROM (SELECT a AS doc_id FROM e UNION ALL SELECT b FROM e) GROUP BY doc_id) AS l USING (doc_id)"""
