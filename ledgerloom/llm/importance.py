"""Importance resampling towards a target distribution, by hashed n-gram features.

Identical texts are collapsed first, by their whole text: features are computed once for each distinct text, counts are
multiplied by the number of copies, and the weight is joined back to the documents before each one draws its own noise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, settle
from ledgerloom.llm.decontam import words

#: Buckets that features are hashed to; a table of gains has as many rows at most, so it may be broadcast.
BUCKETS = 10_000


def features(tokens: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""


    def runs(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.concat(tokens, *(runs(n) for n in range(2, longest + 1)))


def collapsed(rows: DataFrame, text: str, longest: int, buckets: int) -> DataFrame:
    """print, copies, n_words, buckets (of every feature, repeats kept) of each distinct text; null counts as empty.

    The grouping key is the whole text; equal texts of one task meet before the shuffle, so a frequent text is no hot key.
    """
    each = rows.groupBy(F.coalesce(F.col(text), F.lit("")).alias("t")).agg(F.count("*").alias("copies"))
    each = each.select(F.unhex(F.sha2("t", 256)).alias("print"), "copies", words(ascii_lower(F.col("t"))).alias("w"))
    bucket = lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")
    return each.select("print", "copies", F.size("w").cast("long").alias("n_words"), F.transform(features(F.col("w"), longest), bucket).alias("buckets"))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: how many features of all rows stand in it; copies count."""
    return texts.select("copies", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias("n"))


def gains(texts: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: floor(1000 ln(p_target / p_raw)), both with one added to each bucket."""
    raw, aim = settle(bucket_counts(texts)), settle(bucket_counts(target))
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    s, t = total(raw), total(aim)
    both = raw.join(F.broadcast(aim.select("bucket", F.col("n").alias("t"))), "bucket", "left")
    one = lambda c: F.coalesce(c, F.lit(0)).cast("double") + 1
    ratio = (one(F.col("t")) * float(s + buckets)) / (one(F.col("n")) * float(t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 Gumbel noise) by the hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with rank (1, 2, 3... in ``order``) over all partitions: a range exchange, then a count of each range."""
    at = F.monotonically_increasing_id()  # partition in the upper 31 bits, place in the lower 33
    rows = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)).withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = settle(sizes.select("_range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_start")))
    out = rows.join(F.broadcast(starts), "_range")
    return out.withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_range", "_start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (all long) of every row of ``docs``.

    weight: sum of the gains of a text's features towards ``target``; score: weight and noise of the row's own doc_id.
    Of the N rows with ``least_words`` words, the floor(percent N / 100) of highest score are drawn and ranked; ties go
    to the smaller doc_id, null last. All others have a null rank.

    Null and empty texts have no features and weight 0. A null doc_id draws its noise as the empty string. Rows repeated
    in id and text have equal scores and different ranks; which has which is open. Texts of any length are taken whole.
    With an empty target every gain follows from the added ones; an empty ``docs`` gives no rows. Other columns are left out.
    """
    texts = settle(collapsed(docs, text, longest, buckets))
    of = gains(texts, collapsed(target, target_text, longest, buckets), buckets)
    summed = texts.select("print", F.explode("buckets").alias("bucket")).join(F.broadcast(of), "bucket").groupBy("print").agg(F.sum("gain").alias("weight"))
    weights = texts.select("print", "n_words", F.size("buckets").cast("long").alias("n_features")).join(summed, "print", "left")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("print")).join(weights, "print")
    weight = F.coalesce("weight", F.lit(0)).cast("long")
    scored = settle(rows.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score")))
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    first = ranked(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return first.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
