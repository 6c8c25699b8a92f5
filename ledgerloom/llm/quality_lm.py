"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

An n-gram of up to seven bytes is one long, so counts, continuation counts, discounts, back-off weights and the
interpolation are joins and aggregations of sharded tables over all trusted text. Logarithms are kept as whole numbers
(2^20 parts), so a document's sum is the same in whatever order it is added. The finished tables score documents from
memory while they are small (they are counted first). Larger ones are cut by the two bytes before the byte in question
into ranges that fit, texts are read once for each range, and only sums are joined; perplexities are identical.
A document is kept if its perplexity is at most a high quantile of held-out trusted text in its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import settle, small_side, text_batches
from ledgerloom.llm.lookup import Lookup
from ledgerloom.llm.near_dedup import dealt_join

#: Bytes of the longest n-gram; at most 7.
ORDER = 5
#: Share of trusted text that a language's threshold lets through, the fold that sets it, and how many held-out texts a
#: language needs for a threshold of its own (with fewer a 0.995 quantile says nothing; it takes that of all text).
KEEP, FOLDS, OWN = 0.995, 5, 20
#: Rows of all tables together up to which a copy goes to every executor (at 12 bytes each, and up to 2.8 times that).
IN_MEMORY = 2_000_000
#: Rows of the tables of one range beyond IN_MEMORY; two bytes with more rows than that make a range of their own.
RANGE = 4_000_000
#: Parts of one in a stored logarithm, n-grams taken at once, and counted n-grams that a task holds.
PARTS, AT_ONCE, HELD = 1 << 20, 1 << 18, 1 << 19
UNKNOWN = -round(float(np.log(256)) * PARTS)


def flattened(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, with where each text's n-grams begin and end; each text is led by line ends and ended by one."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    pad = b"\n" * (order - 1)
    flat = np.frombuffer(b"".join(x for r in raw for x in (pad, r, b"\n")), np.uint8)
    starts = np.cumsum(lengths + order) - lengths - order
    return flat, starts, starts + lengths + 1


def grams_of(flat: np.ndarray, begin: int, end: int, order: int) -> np.ndarray:
    """The n-grams that begin at these places."""
    grams = np.zeros(end - begin, np.int64)
    for i in range(order):
        grams = (grams << 8) | flat[begin + i : end + i]
    return grams


def _counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "c"])

        for batch in batches:
            flat, starts, ends = flattened(batch.column(0).to_pylist(), order)
            own = np.zeros(len(flat) + 1, np.int8)
            np.add.at(own, starts, 1)
            np.add.at(own, ends, -1)
            own = np.cumsum(own, dtype=np.int8).astype(bool)
            for at in range(0, len(flat) - order + 1, AT_ONCE):
                end = min(at + AT_ONCE, len(flat) - order + 1)
                new, n = np.unique(grams_of(flat, at, end, order)[own[at:end]], return_counts=True)
                both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
                keys, counts = both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
                if len(keys) > HELD:
                    yield rows()
                    keys, counts = keys[:0], counts[:0]
        yield rows()

    return run


def train(texts: DataFrame, order: int = ORDER, text: str = "text") -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each n the tables (gram, p, lp) and (context, g, lg): interpolated probabilities and back-off weights.

    lp and lg are their logarithms in whole parts of PARTS. texts: trusted documents; null and empty ones add only a
    line end. The table of n = 1 backs off to 1/256.
    """
    text_batches(texts.sparkSession)
    level = settle(texts.select(text).mapInArrow(_counted(order), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")))
    counts = {order: level}
    for n in range(order - 1, 0, -1):  # continuation counts: of how many bytes the n-gram is the end of a longer one
        counts[n] = settle(counts[n + 1].groupBy((F.col("gram") % F.lit(1 << 8 * n)).alias("gram")).agg(F.count("*").alias("c")))
    tables: dict[int, tuple[DataFrame, DataFrame]] = {}
    for n in range(1, order + 1):
        r = counts[n].agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        y = r.n1 / max(1, r.n1 + 2 * r.n2)
        discount = [min(max(i - (i + 1) * y * r[i] / max(1, r[i - 1]), 0.05), i - 0.05) for i in (1, 2, 3)]
        d = F.when(F.col("c") == 1, discount[0]).when(F.col("c") == 2, discount[1]).otherwise(discount[2])
        rows = counts[n].withColumn("d", d).withColumn("context", F.shiftright("gram", 8)).withColumn("low", F.col("gram") % F.lit(1 << 8 * (n - 1)))
        sums = settle(rows.groupBy("context").agg(F.sum("c").alias("all"), (F.sum("d") / F.sum("c")).alias("g")))
        rows = rows.join(sums, "context")
        if n == 1:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            rows = rows.join(tables[n - 1][0].select(F.col("gram").alias("low"), F.col("p").alias("lower")), "low")
        p = rows.select("gram", ((F.col("c") - F.col("d")) / F.col("all") + F.col("g") * F.col("lower")).alias("p"))
        tables[n] = settle(p.withColumn("lp", _parts(F.col("p")))), sums.select("context", "g", _parts(F.col("g")).alias("lg"))
    return tables


def _parts(x: Column) -> Column:
    return F.round(F.log(x) * PARTS).cast("int")


class Scorer:
    """The tables of ``train`` in memory: for each n the keys and logarithms of both.

    It adds up the bytes whose two predecessors are from ``low`` to ``high``, and needs only the rows for those.
    """

    def __init__(self, tables: dict[int, tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]], low: int = 0, high: int = 65535):
        self.order, self.low, self.high = max(tables), low, high
        self.p = {n: Lookup(*pair) for n, (pair, _) in tables.items()}
        self.g = {n: Lookup(*pair) for n, (_, pair) in tables.items()}

    def log_p(self, grams: np.ndarray, n: int) -> np.ndarray:
        found = self.p[n].get(grams, 1).astype(np.int64)
        miss = np.flatnonzero(found > 0)
        if len(miss):
            few = grams[miss]
            lower = self.log_p(few % (1 << 8 * (n - 1)), n - 1) if n > 1 else UNKNOWN
            found[miss] = self.g[n].get(few >> 8, 0) + lower
        return found

    def of_range(self, grams: np.ndarray) -> np.ndarray:
        """log_p of the longest n-grams, 0 outside the range."""
        if (self.low, self.high) == (0, 65535):
            return self.log_p(grams, self.order)
        two = (grams >> 8) & 0xFFFF
        here = np.flatnonzero((two >= self.low) & (two <= self.high))
        out = np.zeros(len(grams), np.int64)
        out[here] = self.log_p(grams[here], self.order)
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, with its end: the sum of log p over its bytes in the range, in parts of PARTS, and how many bytes it has."""
        flat, starts, ends = flattened(texts, self.order)
        edges = np.concatenate([starts, ends])
        order = np.argsort(edges, kind="stable")
        upto, so_far, last = np.zeros(len(edges), np.int64), 0, len(flat) - self.order + 1
        for at in range(0, max(last, 0), AT_ONCE):
            end = min(at + AT_ONCE, last)
            sums = so_far + np.concatenate([[0], np.cumsum(self.of_range(grams_of(flat, at, end, self.order)))])
            here = order[np.searchsorted(edges, at, "left", order) : np.searchsorted(edges, end, "right", order)]
            upto[here] = sums[edges[here] - at]
            so_far = sums[-1]
        return upto[len(starts) :] - upto[: len(starts)], ends - starts


def _loaded(tables: dict[int, tuple[DataFrame, DataFrame]], low: int = 0, high: int = 65535) -> Scorer:
    """The rows that a range needs, as numpy arrays; tables of fewer than three bytes have at most 66,049 and are whole."""
    loaded = {}
    for n, (p, g) in tables.items():
        if n > 2:
            p, g = p.where(_two(F.shiftright("gram", 8)).between(low, high)), g.where(_two(F.col("context")).between(low, high))
        both = (t.toArrow() for t in (p.select("gram", "lp"), g.select("context", "lg")))
        loaded[n] = tuple((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in both)
    return Scorer(loaded, low, high)


def _two(context: Column) -> Column:
    """The last two bytes of a context."""
    return context.bitwiseAND(F.lit(0xFFFF))


def _ranges(tables: dict[int, tuple[DataFrame, DataFrame]], most: int) -> list[tuple[int, int]]:
    """Ranges of two bytes that cover all of them, each with at most ``most`` rows unless it is one value."""
    keys = [k for n, (p, g) in tables.items() if n > 2 for k in (p.select(_two(F.shiftright("gram", 8)).alias("k")), g.select(_two(F.col("context")).alias("k")))]
    ranges, low, held = [], 0, 0
    for r in reduce(DataFrame.unionByName, keys).groupBy("k").count().orderBy("k").collect() if keys else []:  # at most 65,536
        if held and held + r["count"] > most:
            ranges.append((low, r.k - 1))
            low, held = r.k, 0
        held += r["count"]
    return [*ranges, (low, 65535)]


def _shared(spark: SparkSession, tables: dict[int, tuple[DataFrame, DataFrame]], in_memory: int) -> Broadcast | None:
    """The tables as numpy arrays for every executor, if together they have at most ``in_memory`` rows."""
    if sum(t.count() for pair in tables.values() for t in pair) > in_memory:
        return None
    return spark.sparkContext.broadcast(_loaded(tables))


def _sums_here(docs: DataFrame, shared: Broadcast, text: str) -> DataFrame:
    """All of ``docs`` with _sum and _n of each text that isn't null or empty."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value  # loaded once by a worker process
        for batch in batches:
            texts = batch.column(at).to_pylist()
            sums, n = scorer.sums(texts)
            none = np.array([not t for t in texts], bool)
            yield batch.append_column("_sum", pa.array(sums, pa.int64(), mask=none)).append_column("_n", pa.array(n, pa.int64(), mask=none))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_sum", T.LongType()), T.StructField("_n", T.LongType())]))


def _sums_by_range(docs: DataFrame, tables: dict, text: str) -> DataFrame:
    """As ``_sums_here``, by one reading of the texts for each range of the tables; texts are known by their SHA-256.

    What is written is one row of sums for each document and range. Documents of a frequent text are dealt to several
    tasks by the part of ``docs`` they stand in.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_h", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))

    def run_with(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = shared.value
            for batch in batches:
                texts = batch.column(1).to_pylist()
                sums, n = scorer.sums(texts)
                none = np.array([not t for t in texts], bool)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64(), mask=none), pa.array(n, pa.int64(), mask=none)], ["_h", "_sum", "_n"])

        return run

    parts = []
    for low, high in _ranges(tables, RANGE):
        shared = spark.sparkContext.broadcast(_loaded(tables, low, high))
        parts.append(settle(docs.select("_h", text).mapInArrow(run_with(shared), "_h binary, _sum long, _n long")).withColumn("_at", F.lit(len(parts))))
        shared.destroy()
    total = reduce(Column.__add__, [F.max(F.when(F.col("_at") == i, F.col("_sum"))) for i in range(len(parts))])  # equal texts have equal sums
    sums = settle(reduce(DataFrame.unionByName, parts).groupBy("_h").agg(total.alias("_sum"), F.max("_n").alias("_n"), F.count_if(F.col("_at") == 0).alias("count")))
    return dealt_join(docs.withColumn("_from", F.spark_partition_id()), sums.drop("count"), "_h", "_from", counts=sums.select("_h", "count")).drop("_h", "_from")


def perplexity(docs: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]], text: str = "text", out: str = "perplexity", in_memory: int = IN_MEMORY) -> DataFrame:
    """All rows and columns of ``docs`` with ``out``: perplexity by byte of the whole text, to six decimals; null for null or empty ones."""
    return _scored(docs, tables, _shared(docs.sparkSession, tables, in_memory), text, out)


def _scored(docs: DataFrame, tables: dict, shared: Broadcast | None, text: str, out: str = "perplexity") -> DataFrame:
    text_batches(docs.sparkSession)
    docs = docs.drop(out)
    sums = _sums_by_range(docs, tables, text) if shared is None else _sums_here(docs, shared, text)
    return sums.withColumn(out, F.round(F.exp(-F.col("_sum") / (F.col("_n") * float(PARTS))), 6)).drop("_sum", "_n")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", order: int = ORDER, keep: float = KEEP, in_memory: int = IN_MEMORY) -> DataFrame:
    """All rows and columns of ``docs`` with perplexity, threshold and kept (boolean).

    Trusted are documents with quality 1 among ``labels`` (and no other value). One fold of them sets each language's
    threshold, the others train. A language (null is one) of fewer than OWN held-out trusted texts takes the threshold
    of all; without any, everything with text is kept. Null and empty texts have no perplexity and are not kept. Columns
    named perplexity, threshold or kept are replaced. Rows are judged one by one: those that repeat a doc_id each get the
    result of their own text, equal rows equal results; a row without doc_id is judged, but never trusted. Texts of any
    length are read whole. An empty table gives no rows. Beyond ``in_memory`` table rows texts are read once for each
    RANGE of them.
    """
    docs = docs.drop("perplexity", "threshold", "kept")
    marks = labels.where(f"{doc_id} IS NOT NULL AND {quality} IS NOT NULL").groupBy(F.col(doc_id).alias("_id")).agg(F.min(F.col(quality)).alias("q"))
    trusted = small_side(settle(marks.where("q = 1").select("_id")))
    good = docs.join(trusted, docs[doc_id] == F.col("_id"), "left_semi")
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0
    tables = train(good.where(~fold), order, text)
    shared = _shared(docs.sparkSession, tables, in_memory)
    held = settle(_scored(good.where(fold).select(F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.col(text).alias("text")), tables, shared, "text").select("_lang", "perplexity"))
    limit = F.percentile_approx("perplexity", keep, 100_000)
    whole = held.agg(limit).first()[0]
    each = small_side(settle(held.groupBy("_lang").agg(limit.alias("threshold"), F.count("perplexity").alias("n")).where(F.col("n") >= OWN).drop("n")))
    out = _scored(docs, tables, shared, text).withColumn("_lang", F.coalesce(F.col(lang), F.lit(""))).join(each, "_lang", "left").drop("_lang")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(whole).cast("double")))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
