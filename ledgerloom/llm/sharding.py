"""Sharding by histogram sort.

Rows are ordered by a key of their text and then by doc_id. Probes cut the key range; each pass counts the exact
bytes below every probe over all partitions and keeps only the intervals that hold a wanted splitter, until each
lies within the tolerance of its target or at a single key. Then the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import settle, small_side

#: Bits of the key, and bits by which a pass narrows an interval.
KEY_BITS, STEP = 60, 10
#: Parts by doc_id that the rows of one frequent text are cut into, bytes of a run, and bytes that a task of the exchange takes.
PARTS, RUN_BYTES, TASK_BYTES = 1024, 8 << 20, 64 << 20


def text_key(text: Column) -> Column:
    """The first 60 bits of the text's MD5 as a long; equal texts stand together."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


@dataclass
class Splitter:
    """Rows at (key, doc) or above belong to later shards; doc None: only keys above ``key``."""

    key: int
    doc: int | None


def _cut_group(rows: DataFrame, key: int, wanted: list[int], before: int) -> list[Splitter]:
    """Splitters at doc ids inside the rows of one key: the first row that starts at or after each target."""
    rows = rows.where(F.col("k") == key)
    lo, hi = rows.agg(F.min("d"), F.max("d")).first()
    found: dict[int, int] = {}
    open_ = {t: (lo, hi, before) for t in wanted}  # target -> doc range, bytes before it
    while open_:
        cases = None
        for a, b, _ in set(open_.values()):
            width = max(1, -(-(b - a + 1) // 1024))
            bin_ = F.expr(f"cast((cast(d AS decimal(20,0)) - {a}) div {width} AS int)")
            hit = F.col("d").between(a, b)
            item = F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), bin_.alias("bin"))
            cases = F.when(hit, item) if cases is None else cases.when(hit, item)
        hist = rows.select(cases.alias("c"), "d", "size").where("c IS NOT NULL").groupBy("c").agg(F.sum("size").alias("size"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
        by: dict = {}
        for r in sorted(hist, key=lambda r: (r.c.a, r.c.bin)):
            by.setdefault((r.c.a, r.c.b), []).append(r)
        fresh = {}
        for t, (a, b, at) in open_.items():
            for r in by[a, b]:
                if at >= t:
                    found[t] = r.lo
                    break
                if at + r.size > t and r.lo < r.hi:
                    fresh[t] = (r.lo, r.hi, at)
                    break
                at += r.size
            else:
                found[t] = b + 1
        open_ = fresh
    return [Splitter(key, found[t]) for t in wanted]


def splitters(rows: DataFrame, shards: int, keep_together: float = 0.04) -> list[Splitter]:
    """The shards - 1 splitters of ``rows`` (k, d, size) for shards of equal bytes.

    A target inside rows of one key moves to the nearer end of that group if the group is at most
    ``keep_together`` of a shard, so that equal texts stay together; larger groups are cut by doc id.
    """
    whole = rows.agg(F.sum("size")).first()[0] or 0
    targets = [t * whole // shards for t in range(1, shards)]
    out: dict[int, Splitter] = {}
    open_ = {i: (0, 0) for i in range(len(targets))} if whole else {}  # -> prefix of the interval, bytes before it
    groups: dict[int, tuple[int, list[int]]] = {}
    for shift in range(KEY_BITS - STEP, -1, -STEP):
        if not open_:
            break
        inside = sorted({p for p, _ in open_.values()})
        part = rows if shift == KEY_BITS - STEP else rows.where(F.shiftright("k", shift + STEP).isin(inside))
        hist = part.groupBy(F.shiftright("k", shift).alias("p")).agg(F.sum("size").alias("size"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
        by: dict[int, list] = {}
        for r in sorted(hist, key=lambda r: r.p):
            by.setdefault(r.p >> STEP, []).append(r)
        fresh = {}
        for i, (prefix, at) in open_.items():
            t = targets[i]
            for r in by[prefix]:
                if at >= t:
                    out[i] = Splitter(r.lo - 1, None)
                    break
                if at + r.size > t:
                    if r.lo < r.hi:
                        fresh[i] = (r.p, at)
                    elif r.size <= keep_together * whole / shards:
                        out[i] = Splitter(r.lo - 1 if t - at <= at + r.size - t else r.lo, None)
                    else:
                        groups.setdefault(r.lo, (at, []))[1].append(i)
                    break
                at += r.size
            else:
                out[i] = Splitter(by[prefix][-1].hi, None)
        open_ = fresh
    for key, (at, wanted) in groups.items():
        out |= dict(zip(wanted, _cut_group(rows, key, [targets[i] for i in wanted], at), strict=True))
    return [out[i] for i in sorted(out)]


def histogram_shards(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", rows_per_run: int = 50_000) -> DataFrame:
    """All rows and columns of ``docs`` with size (UTF-8 bytes + 1), shard (int) and slot (long, gapless from 0).

    Slots follow (text key, doc_id) within a shard. A null text counts as an empty one; a null doc_id comes
    first. Rows equal in text and doc_id can't be told apart and stay in one shard. Texts of any length are whole;
    one that is larger than a shard's share fills it alone. An empty table gives no rows. Columns of ``docs`` named size, shard or slot are replaced.

    The exchange goes by runs: ranges of the sorted order of about ``rows_per_run`` rows or RUN_BYTES, so that no
    task holds a shard; the rows of every more frequent text are cut into up to PARTS runs at quantiles of doc_id.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    keyed = docs.drop("size", "shard", "slot").withColumns({"size": size, "_k": text_key(F.col(text)), "_d": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))})
    rows = settle(keyed.select(F.col("_k").alias("k"), F.col("_d").alias("d"), "size"))
    cuts = splitters(rows, shards)
    n, whole = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shift = KEY_BITS - min(40, max(3, (n // rows_per_run).bit_length(), (whole // RUN_BYTES).bit_length()))

    above = [F.col("_k") > c.key if c.doc is None else (F.col("_k") > c.key) | ((F.col("_k") == c.key) & (F.col("_d") >= c.doc)) for c in cuts]
    shard = sum((a.cast("int") for a in above), F.lit(0))
    frequent = settle(rows.groupBy("k").count().where(F.col("count") > rows_per_run).select("k"))  # at most n / rows_per_run
    hot = rows.join(small_side(frequent), "k", "left_semi").groupBy("k").agg(F.percentile_approx("d", [i / PARTS for i in range(1, PARTS)]).alias("cuts"))
    hot = small_side(settle(hot.groupBy(F.shiftright("k", shift).alias("_run")).agg(F.array_sort(F.collect_list(F.struct("k", "cuts"))).alias("_hot"))), 2000)

    def placed(df: DataFrame) -> DataFrame:
        """With _shard, _run, _zone (an odd one is a frequent text) and _part, by which rows are sorted; then by key and doc_id."""
        df = df.withColumns({"_shard": shard, "_run": F.shiftright("_k", shift)}).join(hot, "_run", "left")
        zone = F.expr("coalesce(2 * size(filter(_hot, h -> h.k < _k)) + int(exists(_hot, h -> h.k = _k)), 0)")
        part = F.expr("coalesce(size(filter(filter(_hot, h -> h.k = _k)[0].cuts, c -> c <= _d)), 0)")
        return df.withColumns({"_zone": F.when(F.col("_hot").isNull(), 0).otherwise(zone), "_part": F.when(F.col("_hot").isNull() | (F.expr("size(filter(_hot, h -> h.k = _k))") == 0), 0).otherwise(part)}).drop("_hot")

    by_run = ["_shard", "_run", "_zone", "_part"]
    counts = settle(placed(rows.select(F.col("k").alias("_k"), F.col("d").alias("_d"))).groupBy(by_run).count())
    upto = Window.partitionBy("_shard").orderBy("_run", "_zone", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = small_side(settle(counts.select(*by_run, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_start"))))  # as many rows as runs
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // TASK_BYTES))
    ordered = Window.partitionBy(by_run).orderBy("_k", "_d")
    out = placed(keyed).repartition(tasks, *by_run).withColumn("_row", F.row_number().over(ordered)).join(starts, by_run)
    out = out.withColumns({"shard": F.col("_shard"), "slot": (F.col("_start") + F.col("_row") - 1).cast("long")})
    return out.drop("_k", "_d", "_row", "_start", *by_run)
