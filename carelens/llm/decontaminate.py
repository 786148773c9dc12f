"""Benchmark decontamination (operator 5): prefix-filtered set join, native.

Items are cut into windows of 13 words and windows into shingles of five.  One
pass over the documents keeps the positions of shingles that some item has
(compared as text, so exactly).  Their corpus counts order the shingles by
rarity; a window can only occur where its rarest shingle occurs (for containment
the necessary prefix is one token long), at the position that shingle has within
the window and with room for the window's length.  Each such candidate is
verified: all its shingles must lie at their places.

DataFrame functions only.  The items' shingles are broadcast while their counted
number is below a bound; beyond it the same join shuffles.  A frequent shingle is
never a prefix unless its whole window is as frequent, and all grouping is by
document row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, document_key, without

WINDOW, SHINGLE = 13, 5
# What is not a word character, once A-Z counts as a-z.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Item shingles (about 60 bytes each) up to which they are broadcast.
BROADCAST_SHINGLES = 500_000
# A document is contaminated if hits make up at least 1 / SHARE of its words.
SHARE = 20


def words(text: str = "text"):
    """Array of words; only A-Z change case."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(plain, GAPS), "")


def _shingle(array: str, pos, k: int):
    """The k words from 0-based ``pos``, joined; null where fewer are left."""
    return F.when(pos + k <= F.size(array), F.concat_ws(" ", *[F.get(array, pos + i) for i in range(k)]))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, first, len, k) of each window; k words make one of its shingles."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words().alias("w")).where("size(w) > 0")
    n = F.size("w")
    return (items.withColumn("len", F.least(n, F.lit(WINDOW)))
            .withColumn("first", F.explode(F.sequence(F.lit(0), n - F.col("len"))))
            .withColumn("k", F.least("len", F.lit(SHINGLE))))


def window_shingles(benchmark: DataFrame) -> DataFrame:
    """(window, item_id, len, k, at, shingle): every shingle of every distinct
    window; a window found in several items has one row set for each."""
    w = item_windows(benchmark).withColumn("text", F.concat_ws(" ", F.expr("slice(w, first + 1, len)"))).select(
        "item_id", "text", "len", "k").distinct()
    parts = F.split("text", " ")
    return (w.withColumn("p", parts).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))))
            .withColumn("shingle", F.concat_ws(" ", F.expr("slice(p, at + 1, k)")))
            .select(F.col("text").alias("window"), "item_id", "len", "k", "at", "shingle"))


def _positions(docs: DataFrame, shingles: DataFrame, sizes: list[int], few: bool) -> DataFrame:
    """One row per document row (shingle null) and one per position at which it
    has an item's shingle: _row, doc_id, n_words, pos, shingle."""
    base = docs.select("doc_id", words().alias("w")).withColumn("_row", F.monotonically_increasing_id())
    out = []
    for k in sizes:
        own = shingles.where(F.col("k") == k).select("shingle")
        # One entry beyond the last word, without a shingle, stands for the row itself.
        each = base.select("_row", "doc_id", "w", F.size("w").alias("n_words"),
                           F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "_word"))
        each = each.withColumn("shingle", _shingle("w", F.col("pos"), k))
        if few:
            hit = own.select(F.col("shingle").alias("_own"))
            hits = each.join(F.broadcast(hit), F.col("shingle") == F.col("_own"), "left")
            last = F.col("pos") == F.col("n_words") if k == sizes[0] else F.lit(False)
            out.append(hits.where(F.col("_own").isNotNull() | last)
                       .select("_row", "doc_id", "n_words", "pos", F.col("_own").alias("shingle")))
        else:
            found = each.where("shingle IS NOT NULL").select("_row", "doc_id", "n_words", "pos", "shingle")
            out.append(found.join(own, "shingle", "left_semi").select("_row", "doc_id", "n_words", "pos", "shingle"))
    if not few or not sizes:
        out.append(base.select("_row", "doc_id", F.size("w").alias("n_words"), F.size("w").alias("pos"),
                               F.lit(None).cast("string").alias("shingle")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.union(more)
    return rows.withColumn("k", F.size(F.split("shingle", " ")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row.

    Null or empty texts have no words: such an item has no window, such a
    document no hit.  Items and windows that repeat count once per item_id; a null item_id has no name and is
    left out.  Repeated rows and ids give a result row each; an empty table gives no rows
    (or, for the benchmark, no hits); only doc_id, item_id and text are read.
    """
    parts = cut(window_shingles(benchmark.where("item_id IS NOT NULL")))
    shingles = cut(parts.select("shingle", "k").distinct())
    sizes = [r.k for r in shingles.groupBy("k").count().orderBy("k").collect()]
    few = shingles.count() <= BROADCAST_SHINGLES
    # Written once: what follows uses it five times, by row number.
    rows = cut(_positions(docs, shingles, sizes, few))
    hits = rows.where("shingle IS NOT NULL")

    # Rarity over the whole corpus; a window with an absent shingle occurs nowhere.
    freq = hits.groupBy("shingle").agg(F.count("*").alias("freq"))
    ranked = parts.join(freq, "shingle", "left")
    by_window = Window.partitionBy("window", "item_id").orderBy("freq", "shingle", "at")
    whole = Window.partitionBy("window", "item_id")
    prefix = cut(ranked.withColumns({"_first": F.row_number().over(by_window), "_least": F.min(F.coalesce("freq", F.lit(0))).over(whole)})
                 .where("_least > 0 AND _first = 1").select("window", "item_id", "len", "k", "at", "shingle"))
    rare = prefix.groupBy("window", "len", "k", "at", "shingle").agg(F.collect_set("item_id").alias("items"))
    places = parts.join(rare.select("window"), "window", "left_semi").select(
        "window", "at", F.col("shingle").alias("part")).distinct().groupBy("window").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "part"))).alias("parts"))
    # Positional and length bounds of the candidates.
    cand = (hits.join(rare.join(places, "window"), ["shingle", "k"])
            .withColumn("start", F.col("pos") - F.col("at"))
            .where("start >= 0 AND start + len <= n_words"))
    # Verification: each shingle of the window at its place in the document.
    need = cand.select("_row", "window", "items", "start", "len", "k", F.explode("parts").alias("off", "shingle")).withColumn(
        "pos", F.col("start") + F.col("off"))
    found = need.join(hits.select("_row", "pos", "k", "shingle"), ["_row", "pos", "k", "shingle"])
    sure = (found.groupBy("_row", "start", "len", "k", "window").agg(F.count("*").alias("n"), F.first("items").alias("items"))
            .where("n = len - k + 1"))
    # Words hit: positions within the document, each once.
    covered = sure.select("_row", F.explode(F.expr("sequence(start, start + len - 1)")).alias("pos")).distinct().groupBy(
        "_row").agg(F.count("*").alias("n_hit"))
    items = sure.select("_row", F.explode("items").alias("item")).groupBy("_row").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return (rows.where("shingle IS NULL").select("_row", "doc_id", F.col("n_words").cast("bigint").alias("n_words"))
            .join(covered.join(items, "_row"), "_row", "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
                    F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
                    ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were;
    rows that repeat a doc_id are one document, dropped if any of them is; so are
    rows without doc_id that repeat a text."""
    key = document_key()
    return without(docs, decontaminate(docs.withColumn("doc_id", key), benchmark).where("contaminated")
                   .select(F.col("doc_id").alias("_bad")), key)
