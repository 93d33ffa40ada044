"""Benchmark decontamination: a distributed positional index over the training texts.

Test windows are looked up rarest term first: postings are stored for the few rarest terms of each window, their lists
are intersected after subtracting each term's offset, and what survives is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.base import BROADCAST_ROWS, ascii_lower, cut, doc_key, drop_cut, quoted, release, row_of, small, table, unpacked

WINDOW = 10
#: Terms of each window that get postings, rarest first.
INDEX_TERMS = 2
#: Words of a full window that a proximity match needs, and how far from their places they may stand.
NEAR, SLOP = 8, 3
#: Words of a stretch of text in which two lists meet.
STRETCH = 64
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: win (id), terms (array), items (which hold it). Items without words have none."""
    w = items.select(F.col(quoted(item_id)).alias("item"), words(F.col(quoted(text))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("terms"))
    named = each.groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return named.select(F.xxhash64(F.array_join("terms", " ")).alias("win"), "terms", "items")


def term_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each vocabulary term (column term) in all texts."""
    return docs.select(F.explode(words(F.col(text))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def index_terms(wins: DataFrame, counts: DataFrame, k: int = INDEX_TERMS, size: int = WINDOW, near: int = NEAR) -> DataFrame:
    """Per window its k rarest terms with offsets: rank 1 is the rarest (ties: smaller offset).

    Terms that no text holds have no place. A window with fewer other terms than a match needs is gone: ``near`` of a
    full window, all of a shorter one.
    """
    each = wins.select("win", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term")).join(counts, "term")
    need = F.when(F.col("len") == size, F.least(F.lit(near), F.col("len"))).otherwise(F.col("len"))
    per = each.groupBy("win", "len").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("t")).where(F.size("t") >= need)
    return per.select("win", "len", F.least(F.size("t"), F.lit(k)).alias("needs"), F.posexplode(F.slice("t", 1, k)).alias("rank", "t")).select("win", "len", "needs", (F.col("rank") + 1).alias("rank"), "t.off", "t.term")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, _k1, _k2, pos of every occurrence of the terms in docs (_k1, _k2, _t)."""
    return docs.select("_k1", "_k2", F.posexplode(words(F.col("_t"))).alias("pos", "term")).join(terms, "term", "left_semi")


def candidates(index: DataFrame, rare: DataFrame, rows: int, slop: int = SLOP) -> DataFrame:
    """Offset-adjusted intersection: (_k1, _k2, win, start) where the rarest term of a window stands at its offset and
    the next rarest within ``slop`` words of its own. rows: of ``rare``.

    The rarest term's list comes first; the next list meets it in stretches of STRETCH words, so that a text in which
    both are common is compared piece by piece.
    """
    place = lambda rank: index.join(small(rare.where(F.col("rank") == rank).select("win", "len", "needs", "off", "term"), rows), "term").select("_k1", "_k2", "win", "len", "needs", (F.col("pos") - F.col("off")).alias("start"))
    stretch = lambda c: F.floor(c / STRETCH)
    first = place(1).where(F.col("start") >= -slop)
    alone = first.where(F.col("needs") == 1)
    other = place(2).select("_k1", "_k2", "win", F.col("start").alias("at"))
    other = other.withColumn("piece", F.explode(F.array_distinct(F.array(stretch(F.col("at") - slop), stretch(F.col("at") + slop)))))
    both = first.where(F.col("needs") > 1).withColumn("piece", stretch(F.col("start")))
    held = [both[c] == other[c] for c in ("_k1", "_k2", "win", "piece")]
    both = both.join(other, [*held, F.abs(F.col("at") - F.col("start")) <= slop], "left_semi")
    return alone.select("_k1", "_k2", "win", "start").unionByName(both.select("_k1", "_k2", "win", "start"))


def matched_texts(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WINDOW, near: int = NEAR, slop: int = SLOP, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per text with a match (_k1, _k2: of doc_key): exact, near (proximity matches of full windows); a written table.

    Both are arrays of start, len, items, by start. An exact match has all words of the window at their places. A
    proximity match begins where the window's rarest term stands at its place and the next rarest within ``slop`` words
    of its own, with at least ``near`` words of the window within ``slop`` words of their places; so exact matches of
    full windows are among them, and a window with an inserted, dropped or changed word is found unless that was one of
    its two rarest terms. Rarity is by occurrences in all texts.

    A null text, or one without words, has no matches; repeated rows each get theirs; a null doc_id matches like any;
    items without words and items without texts find nothing; either table may be empty. Ids of items can be of any
    type. What is broadcast is counted before: terms, windows and places up to BROADCAST_ROWS, beyond that shuffled.
    """
    source = keyed(docs, doc_id, text)
    wins = cut(windows(items, item_id, item_text, size), "windows")
    n_wins = wins.count()
    vocabulary = cut(wins.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = term_counts(source, small(vocabulary, vocabulary.count()), "_t")
    rare = cut(index_terms(wins, counts, INDEX_TERMS, size, near), "rare")
    named = rare.select("term").distinct()
    n_rare = rare.count()
    index = cut(postings(source, small(named, n_rare)), "postings")
    found = candidates(index, rare, n_rare, slop).distinct()
    per = cut(found.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "win")).alias("places")), "places")
    n_places = per.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    # a place is compared with its window where the text is: the words around it go to the window, not the text
    texts = source.select("_k1", "_k2", "_t").join(small(per, n_places), ["_k1", "_k2"]).select("_k1", "_k2", words(F.col("_t")).alias("w"), "places").dropDuplicates(["_k1", "_k2"])
    lo = lambda p: F.greatest(p["start"] - slop, F.lit(0))
    around = texts.select("_k1", "_k2", F.explode(F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["win"].alias("win"), lo(p).alias("lo"), F.slice("w", lo(p) + 1, p["start"] + size + slop - lo(p)).alias("part")))).alias("p")).select("_k1", "_k2", "p.*")
    met = around.join(small(wins, n_wins), "win").withColumn("len", F.size("terms"))
    exact = (F.col("start") >= 0) & (F.slice("part", F.col("start") - F.col("lo") + 1, F.col("len")) == F.col("terms"))
    stands = lambda t, i: F.array_contains(F.slice("part", F.greatest(F.col("start") + i - slop - F.col("lo"), F.lit(0)) + 1, F.col("start") + i + slop - F.greatest(F.col("start") + i - slop, F.col("lo")) + 1), t)
    placed = F.size(F.filter(F.transform("terms", lambda t, i: stands(t, i)), lambda x: x))
    hits = met.select("_k1", "_k2", F.col("start"), "len", "items", exact.alias("exact"), ((F.col("len") == size) & (placed >= near)).alias("near")).where("exact OR near")
    span = F.struct("start", "len", "items")
    found = cut(hits.groupBy("_k1", "_k2").agg(*[F.array_sort(F.collect_list(F.when(F.col(c), span))).alias(c) for c in ("exact", "near")]), "matches")
    drop_cut(wins, vocabulary, rare, index, per)
    release(docs.sparkSession)
    return found


def keyed(docs: DataFrame, doc_id: str, text: str, *columns: Column) -> DataFrame:
    """_k1, _k2, _t and ``columns`` of every row of ``docs``."""
    rows = docs.select(F.col(quoted(doc_id)).alias("_d"), F.col(quoted(text)).alias("_t"), *columns)
    return rows.select(*doc_key("_d", "_t"), *rows.columns[1:])


def phrase_matches(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] | None = None, **terms) -> DataFrame:  # noqa: ANN003
    """Rows of ``docs`` one for one as a struct ``_row`` (its columns, or those of ``keep``), with n_words, matches (exact
    windows) and near (proximity matches), both arrays of start, len, items, by start. Cases as in matched_texts."""
    spans = matched_texts(docs, items, text, doc_id, **terms)
    n_spans = spans.agg(F.coalesce(F.sum(F.size("exact") + F.size("near")), F.lit(0))).first()[0]
    rows = keyed(docs, doc_id, text, row_of(docs if keep is None else docs.select(*[F.col(quoted(c)) for c in keep])).alias("_row"))
    counted = rows.select("_row", "_k1", "_k2", F.size(words(F.col("_t"))).cast("long").alias("n_words"))
    joined = counted.join(small(spans, n_spans, BROADCAST_ROWS // 4), ["_k1", "_k2"], "left")
    none = F.array().cast(spans.schema["exact"].dataType)
    return joined.select("_row", "n_words", F.coalesce("exact", none).alias("matches"), F.coalesce("near", none).alias("near"))


def uncontaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **terms) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs``, with all their columns, in which no window of an item stands, neither exactly nor nearly."""
    bad = matched_texts(docs, items, text, doc_id, **terms).select("_k1", "_k2")
    rows = keyed(docs, doc_id, text, row_of(docs).alias("_row")).drop("_t")
    return rows.join(small(bad, bad.count()), ["_k1", "_k2"], "left_anti").select(*unpacked(docs, "_row"))


def covered(matches: Column) -> Column:
    """Words inside any match; matches are sorted by start."""
    step = lambda a, m: F.struct((a["n"] + F.greatest(F.lit(0), m["start"] + m["len"] - F.greatest(a["to"], m["start"]))).alias("n"), F.greatest(a["to"], m["start"] + m["len"]).alias("to"))
    return F.aggregate(matches, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda a: a["n"])


def item_names(matches: Column) -> Column:
    """Ids of the items of matches, as strings: distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(matches, lambda m: m["items"])), lambda i: i.cast("string"))))


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests of exact matches, and items and words that proximity matches cover. Nulls, repeats and
    empty tables as in phrase_matches."""
    found = phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    items, near = item_names(F.col("matches")), item_names(F.col("near"))
    hit = covered(F.col("matches")).cast("long")
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"), F.size(near).cast("long").alias("n_near_items"), F.sha2(F.array_join(near, ","), 256).alias("near_sha256"),
    )


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hits AS (SELECT r, i, grams.n, item_id FROM grams JOIN wins ON grams.g = wins.g AND grams.n = wins.n),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r),
counts AS (SELECT t, count(*) AS n FROM d, unnest(w) AS u(t) GROUP BY t),
full_ AS (SELECT DISTINCT g, string_split(g, ' ') AS t FROM wins WHERE n = 10),
offs AS (SELECT g, o - 1 AS o, t[o] AS t FROM full_, unnest(range(1, 11)) AS u(o)),
ranked AS (SELECT g, o, offs.t, row_number() OVER (PARTITION BY g ORDER BY n, o) AS rank, count(*) OVER (PARTITION BY g) AS held FROM offs JOIN counts ON counts.t = offs.t),
posts AS (SELECT r, i - 1 AS p, w[i] AS t FROM d, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i] IN (SELECT t FROM offs)),
firsts AS (SELECT DISTINCT r, g, p - o AS s FROM posts JOIN ranked ON posts.t = ranked.t WHERE rank = 1 AND held >= 8 AND p - o >= -3),
starts AS (SELECT f.r, f.g, f.s FROM firsts f JOIN ranked k ON k.g = f.g AND k.rank = 2 JOIN posts p ON p.r = f.r AND p.t = k.t AND p.p - k.o - f.s BETWEEN -3 AND 3 GROUP BY ALL),
near AS (SELECT s.r, s.g, s.s FROM starts s JOIN offs k ON k.g = s.g JOIN posts p ON p.r = s.r AND p.t = k.t AND p.p - k.o - s.s BETWEEN -3 AND 3 GROUP BY ALL HAVING count(DISTINCT k.o) >= 8),
near_n AS (SELECT r, count(*) AS n_near FROM near GROUP BY r),
near_i AS (SELECT r, count(*) AS n_near_items, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM near JOIN wins ON wins.g = near.g AND wins.n = 10) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items, sha256(coalesce(near_items, '')) AS near_sha256
FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r) LEFT JOIN near_n USING (r) LEFT JOIN near_i USING (r)"""
