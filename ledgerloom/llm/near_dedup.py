"""Near-duplicate groups by SetSketch.

A document is the set of its distinct 5-word shingles. Its sketch holds, for each register, the exponentially
spaced, truncated minimum of a hash of that register over the set; the sketch of a union is the register-wise
maximum. Equal sets are joined first. Bands of register values give candidates, a joint maximum-likelihood estimate
of the similarity from both sketches and the exact set sizes drops the hopeless ones, and the rest is verified on
full sets.

Within a bucket not all pairs are listed: members are first compared with two hubs. Documents of buckets that are then
still in several components go through an exact prefix join: shingles are ordered by rarity, linked sets must share one
early enough in both, and such shingles' documents are again compared with a hub first and only across components then.
So a group of near copies costs about its size, and no pair that shares a bucket is left undecided.

A shingle is 64 bits mixed from sound hashes of its words, so two different ones agree with a chance of 2^-64. Links are
confirmed on full sets made with another seed, so what happened to agree for the candidates doesn't agree again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import settle, small_side, text_batches

#: Registers by band. A pair of similarity 0.75 shares no band with a chance of (1 - 0.75^5)^60 < 1e-7.
BANDS, PER_BAND = 60, 5
REGISTERS = BANDS * PER_BAND
#: Sketch parameters: base, rate of the exponentials, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Shingles are words in runs of this length.
WORDS = 5
#: Seeds of the shingles that give candidates and of those that confirm links.
FIND, CONFIRM = 0, 1
#: Rows of one key of a join, or documents of one frequent shingle, beyond which they are dealt to several tasks.
HOT, PIECES = 1000, 32
#: By how much the estimate may stay below the wanted similarity; the standard error is 0.025 at 300 registers.
SLACK = 0.2

_MULTIPLIERS = (np.random.default_rng(20240229).integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS, seed: int = FIND) -> np.ndarray:
    """Sorted distinct 64-bit hashes of every ``words`` consecutive words, A-Z lower-cased.

    A text of fewer words is one shingle; one without words has none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found, repeat(seed)), np.uint64, len(found))
    run = min(words, len(found))
    whole = np.full(len(found) - run + 1, run, np.uint64)
    for i in range(run):
        whole = _mix(whole * np.uint64(0x9E3779B97F4A7C15) + each[i : i + len(whole)])
    return np.unique(whole)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers (uint16) of a non-empty set."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(least, (short[at : at + 256, None] * _MULTIPLIERS).min(axis=0), out=least)
    drawn = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(drawn) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(one, other)


def likely_similarity(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray, steps: int = 100) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows) of sets of known sizes, on a grid."""
    more, less = (one > other).sum(axis=1)[:, None], (one < other).sum(axis=1)[:, None]
    same = one.shape[1] - more - less
    u = (n_one / (n_one + n_other))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, steps + 1)[None, :] * np.minimum(u / v, v / u)
    above = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    p, q = above(u - v * grid), above(v - u * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return np.take_along_axis(grid, (more * log(p) + less * log(q) + same * log(1 - p - q)).argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, prints, regs = [], [], []
        for text in batch.column(1).to_pylist():
            found = shingles(text)
            n.append(len(found))
            prints.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
            regs.append(sketch(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "print", "regs"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, BANDS, PER_BAND).astype(np.uint64)
            key = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), regs.shape[:2]).copy()
            for i in range(PER_BAND):
                key = _mix(key * np.uint64(31) + regs[:, :, i] + np.uint64(1))
            ids, n = (np.repeat(batch.column(i).to_numpy(), BANDS) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids), pa.array(n)], ["key", "id", "n"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t, seed=CONFIRM).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "full"])


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                keep = likely_similarity(one, other, batch.column("na").to_numpy(), batch.column("nb").to_numpy()) >= least
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: str, counted: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Join on ``key``, of which ``right`` has few rows each; rows of keys that are frequent in ``left`` are dealt to
    PIECES tasks by a hash of ``by``, and such rows of ``right`` repeated for each.

    ``counted`` is ``left`` or a settled table with at least its rows, ``counts`` a settled table of ``key`` and the
    number (count) of its rows, where there is one already. Frequent: more than HOT rows and more than a 100,000th of
    all, so there are at most 100,000 of them.
    """
    if counts is None:
        counted = left if counted is None else counted
        n, counts = counted.count(), counted.groupBy(key).count()
    else:
        n = counts.agg(F.sum("count")).first()[0] or 0
    most = max(HOT, n // 100_000)
    if n <= most:
        return left.join(right, key)
    hot = settle(counts.where(F.col("count") > most).select(key, F.lit(True).alias("_hot")))
    if not hot.head(1):
        return left.join(right, key)
    hot = F.broadcast(hot)  # at most 100,000 keys
    left = left.join(hot, key, "left").withColumn("_piece", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(PIECES))).otherwise(0)).drop("_hot")
    right = right.join(hot, key, "left").withColumn("_piece", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right.withColumn("_piece", F.col("_piece").cast("long")), [key, "_piece"]).drop("_piece")


def components(edges: DataFrame) -> DataFrame:
    """id, comp: for each end of ``edges`` (a, b) the smallest id that it is connected to.

    Each round every node takes the smallest neighbour as its parent, twice over, and edges are drawn anew between
    parents; a star ends in one round, a chain in a number that grows with the logarithm of its length.
    """
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = settle(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")))
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = settle(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")))
        labels = settle(labels.join(parent.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")))
        edges = dealt_join(edges, parent, "a", "b").select(F.col("p").alias("x"), "b")
        edges = edges.join(parent.withColumnRenamed("a", "b"), "b").select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b"))
        edges = settle(edges.where("a < b").distinct())
    return labels


def _early_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """token, id, n, pos: of each set (id, full) the shared shingles that stand early enough to link it.

    Shingles are ordered by the number of these sets that have them; pos counts from 1. Those of one set alone come
    first and need no rows. A linked set shares one of its first n - ceil(percent * n / 100) + 1.
    """
    rows = settle(sets.select("id", F.xxhash64("full").alias("h"), F.size("full").cast("long").alias("n"), F.explode("full").alias("token")))
    held = settle(rows.groupBy("token").count().where("count > 1"))
    own = Window.partitionBy("id", "h", "n")
    rows = dealt_join(rows, held.withColumnRenamed("count", "df"), "token", "id", counts=held).withColumn("pos", F.row_number().over(own.orderBy("df", "token")) + F.col("n") - F.count("*").over(own))
    return rows.where(f"100 * (n - pos + 1) >= {percent} * n").select("token", "id", "n", "pos")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Documents with 100 * intersection >= percent * union are linked (percent at least 75, which the bands are made
    for). component_id is the smallest doc_id that can be reached, kept whether that is the document itself. Without
    words or text the set is empty and nothing is linked. Rows that repeat a doc_id count as one document with several
    texts; a row without doc_id isn't linked, has no component_id and is kept. Texts of any length are taken whole.
    Extra columns are ignored, an empty table gives no rows. Texts stay where they are read; sketches and the sets of
    documents that have a candidate are exchanged.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    drawn = settle(docs.mapInArrow(_sketches, "id long, n long, print binary, regs binary"))
    some = drawn.where("id IS NOT NULL AND n > 0")
    first = settle(some.groupBy("print").agg(F.min("id").alias("rep")))
    reps = some.join(first.select("print", F.col("rep").alias("id")), ["print", "id"], "left_semi").select("id", "n", "regs").distinct()
    reps = settle(reps)
    repeated = bool(some.groupBy("id", "print").count().where("count > 1").head(1))

    def full_sets(ids: DataFrame) -> DataFrame:
        """id, full: the sets of documents ``ids``, read where the texts are; rows that repeat one count once."""
        sets = docs.join(small_side(ids), "id", "left_semi").mapInArrow(_full_sets, "id long, full array<bigint>")
        return sets.distinct() if repeated else sets

    def rows() -> DataFrame:
        return reps.mapInArrow(_band_rows, "key long, id long, n long")

    hubs = settle(rows().groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("count")).where("lo < hi"))
    shared = settle(dealt_join(rows(), hubs.drop("count"), "key", "id", counts=hubs))
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are linked."""
        side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("regs").alias("r" + x))
        pairs = settle(pairs)
        maybe = dealt_join(dealt_join(pairs, side("a"), "a", "b"), side("b"), "b", "a", pairs).where(near).mapInArrow(_likely(percent / 100 - SLACK), "a long, b long")
        maybe = settle(maybe.distinct())
        sets = settle(full_sets(settle(maybe.select(F.explode(F.array("a", "b")).alias("id")).distinct())))
        side = lambda x: sets.select(F.col("id").alias(x), F.col("full").alias("f" + x))
        both = dealt_join(dealt_join(maybe, side("a"), "a", "b"), side("b"), "b", "a", maybe)
        both = both.select("a", "b", F.size(F.array_intersect("fa", "fb")).cast("long").alias("i"), (F.size("fa") + F.size("fb")).cast("long").alias("t"))
        return settle(both.where(f"100 * i >= {percent} * (t - i)").select("a", "b").distinct())

    star = shared.select(F.explode(F.array("lo", "hi")).alias("a"), F.col("id").alias("b")).where("a <> b")
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = linked(star)
    labels = components(edges)

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    mixed = settle(named(shared.select("key", "id")))
    several = mixed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = settle(dealt_join(mixed, several, "key", "id", counts=hubs).select("id").distinct())
    early = settle(_early_shingles(full_sets(open_), percent))
    hub = named(early).groupBy("token").agg(F.min_by(F.struct("id", "n", "pos", "comp"), F.struct("pos", "id")).alias("h")).select("token", *[F.col(f"h.{c}").alias(c + "_h") for c in ("id", "n", "pos", "comp")])
    bound = f"100 * least(n, n_h) >= {percent} * greatest(n, n_h) AND {100 + percent} * (least(n - pos, n_h - pos_h) + 1) >= {percent} * (n + n_h)"
    pair = F.least("id", "id_h").alias("a"), F.greatest("id", "id_h").alias("b")
    more = linked(dealt_join(named(early), hub, "token", "id", early).where(f"comp <> comp_h AND {bound}").select(*pair).distinct())
    if more.head(1):
        edges = settle(edges.unionByName(more))
        labels = components(edges)
    here = settle(named(early))
    several = here.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    here = settle(dealt_join(here, several, "token", "id"))
    # documents of one frequent shingle are dealt to g parts by id; each two parts meet once, in a task of their own
    parts = here.groupBy("token").agg(F.ceil(F.count("*") / HOT).cast("int").alias("g"))
    here = dealt_join(here, parts, "token", "id").withColumns({"p": F.pmod(F.xxhash64("id"), F.col("g")).cast("int"), "q": F.explode(F.sequence(F.lit(0), F.col("g") - 1))})
    cell = [F.least("p", "q").alias("p1"), F.greatest("p", "q").alias("p2")]
    here = settle(here.select("token", "id", "n", "pos", "comp", "p", *cell))
    there = here.select("token", "p1", "p2", F.col("p").alias("p_h"), *[F.col(c).alias(c + "_h") for c in ("id", "n", "pos", "comp")])
    met = here.join(there, ["token", "p1", "p2"]).where(f"(p1 = p2 OR p <> p_h) AND comp < comp_h AND {bound}")
    more = linked(met.select(*pair).distinct())
    if more.head(1):
        labels = components(edges.unionByName(more))
    of = first.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("comp", "rep").alias("comp"))
    out = drawn.select("id", "n", F.when(F.col("id").isNotNull(), F.col("print")).alias("print")).join(of, "print", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"), F.coalesce(F.coalesce("comp", "id") == F.col("id"), F.lit(True)).alias("kept"))
