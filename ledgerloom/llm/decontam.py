"""Benchmark decontamination by a prefix-filtered containment join.

An item is cut into windows of ``n`` consecutive words. Three-word shingles of a window are ordered by how many
documents hold them. A document that contains the window holds its rarest shingle, so that one-shingle prefix
is all that has to be joined; positions and lengths bound the place, and the words are compared there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, settle, small_side

#: Words are what stands between these; digits, letters and all that isn't ASCII belong to words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_WORDS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column, pattern: str = BETWEEN_WORDS) -> Column:
    """Words of an already lower-cased text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda w: w != "")


def shingle_hashes(tokens: str, size: int, each: str = "{}") -> str:
    """SQL for the hashes of every ``size`` consecutive words, in order."""
    parts = ", ".join(each.format(f"get({tokens}, i + {j})") for j in range(size))
    return f"IF(size({tokens}) < {size}, array(), transform(sequence(0, size({tokens}) - {size}), i -> xxhash64({size}, {parts})))"


def windows(items: DataFrame, n: int, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, window (array of words): every ``n`` consecutive words; a shorter item, if not empty, is one window."""
    w = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(ascii_lower(F.col(text))).alias("w")).where(F.size("w") > 0)
    return w.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {n} + 1, 1)), i -> slice(w, i, {n}))")).alias("window")).distinct()


def occurrences(docs: DataFrame, wins: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, h, win, start (0-based word), len for each place where a window's words stand in a document.

    docs: doc_id, h, text; equal (doc_id, h) are the same text. wins: win, window. Hashes are of words in full
    lower case, word by word: that is cheaper than A-Z alone on whole texts and can only let more places through.
    """
    wins = wins.withColumn("len", F.size("window")).withColumn("s", F.least(F.col("len"), F.lit(shingle)))
    sizes = sorted(r.s for r in wins.select("s").distinct().collect())  # at most ``shingle`` values
    by_size = " ".join(f"WHEN {s} THEN {shingle_hashes('window', s, 'lower({})')}" for s in range(1, shingle + 1))
    parts = settle(wins.select("win", "len", F.posexplode(F.expr(f"CASE s {by_size} END")).alias("offset", "token")))
    tokens = small_side(settle(parts.select("token").distinct()))
    lowered = docs.select("doc_id", "h", F.transform(words(F.col("text"), BETWEEN_WORDS_ANY_CASE), F.lower).alias("w"))
    met = docs.select("doc_id", "h", F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("token")).limit(0)
    for s in sizes:
        each = lowered.select("doc_id", "h", F.size("w").alias("n"), F.posexplode(F.expr(shingle_hashes("w", s))).alias("pos", "token"))
        met = met.unionByName(each.join(tokens, "token", "left_semi"))
    met = settle(met)
    held = met.select("token", "doc_id", "h").distinct().groupBy("token").agg(F.count("*").alias("docs"))
    rarest = Window.partitionBy("win").orderBy("docs", "offset")
    prefix = parts.join(held, "token", "left").withColumn("docs", F.coalesce("docs", F.lit(0))).withColumn("r", F.row_number().over(rarest))
    prefix = small_side(settle(prefix.where("r = 1 AND docs > 0").select("win", "len", "offset", "token")))
    near = met.join(prefix, "token").withColumn("start", F.col("pos") - F.col("offset"))
    near = settle(near.where("start >= 0 AND start + len <= n").select("doc_id", "h", "win", "len", "start").distinct())
    here = small_side(settle(near.select("doc_id", "h").distinct()))
    texts = docs.join(here, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    texts = texts.select("doc_id", "h", words(ascii_lower(F.col("text"))).alias("w"))
    placed = near.join(small_side(settle(wins.select("win", "window"))), "win")
    return texts.join(placed, ["doc_id", "h"]).where("slice(w, start + 1, len) = window").select("doc_id", "h", "win", "start", "len")


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_hit (long) and items (sorted array of item ids as strings).

    A word is hit if it stands inside any occurrence of any window. Null and empty texts have no words; null and
    empty items have no windows; items without id are left out; repeated items count once; repeated documents
    get equal results row by row. Texts of any length are read whole. Columns of ``docs`` named n_words, n_hit or items
    are replaced; an empty table gives no rows.
    """
    key = {"_doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), "_hash": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    docs = docs.drop("n_words", "n_hit", "items").withColumns(key)
    of = settle(windows(items, n, item_text, item_id).withColumn("win", F.xxhash64("window")))
    where = settle(occurrences(docs.select(F.col("_doc").alias("doc_id"), F.col("_hash").alias("h"), F.col(text).alias("text")), of.select("win", "window").distinct()))
    by_place = Window.partitionBy("doc_id", "h").orderBy("start", "stop")
    spans = where.select("doc_id", "h", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
    before = F.coalesce(F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", before))).groupBy("doc_id", "h").agg(F.sum("fresh").alias("n_hit"))
    named = small_side(settle(of.select("win", F.col("item_id").cast("string").alias("item_id")).distinct()))
    named = where.select("doc_id", "h", "win").distinct().join(named, "win").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    facts = hit.join(named, ["doc_id", "h"]).withColumnsRenamed({"doc_id": "_doc", "h": "_hash"})
    counted = docs.withColumn("n_words", F.size(words(F.col(text), BETWEEN_WORDS_ANY_CASE)).cast("long"))
    out = counted.join(facts, ["_doc", "_hash"], "left").drop("_doc", "_hash")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
