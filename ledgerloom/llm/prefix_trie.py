"""Prefix tries of conversations.

Equal conversations are collapsed to one with a count. The rest is dealt by the digest of the first turn, and a task
builds the trie of its share from dictionaries of pointers; one pass from the last node to the first is its postorder.
A first turn under which more than ``most`` turns stand is dealt again by the next turn, and so on. The prefixes that were
split so are the trunk: few nodes, whose figures are sums over the subtries below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import settle, small_side

#: Bytes of a packed turn: 16 of its digest, 8 of the length of its text.
TURN, DIGEST = 24, 16
#: Turns that one subtrie may hold, depths that a round of splitting looks at, and ids that a run of ids holds.
MOST, ROUND, IDS = 100_000, 8, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def packed(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns (binary): the turns of each conversation in order, TURN bytes each.

    Order: turn (null first), then role and text. Null roles and texts count as empty. Rows without conv_id are left out.
    Digests are the first half of the SHA-256 of role and text, told apart by the length of the role.
    """
    empty = F.lit("")
    each = rows.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * DIGEST)
    each = each.select("conv_id", F.struct(at.alias("at"), F.concat(digest, F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0")).alias("turn")).alias("t"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join(F.col("t.turn"), "")).alias("turns"))


def with_shared_heads(convs: DataFrame, span: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c behind the first h turns of conversation c - c % span in place of its own first h.

    h: unsigned crc32 of c in decimal, modulo ``heads``. An absent conversation gives no turns.
    """
    h = TURN * (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = convs.select(F.col("conv_id").alias("_base"), F.substring("turns", 1, TURN * (heads - 1)).alias("_head"))
    own = convs.withColumns({"_h": h, "_base": F.col("conv_id") - F.col("conv_id") % span}).join(base, "_base", "left")
    return own.select("conv_id", F.concat(F.expr("substring(coalesce(_head, x''), 1, _h)"), F.expr("substring(turns, _h + 1)")).alias("turns"))


def key(depth: Column | int) -> Column:
    """Which node of ``depth`` a conversation passes."""
    return F.md5(F.substring("turns", F.lit(1), depth * TURN))


def ends(convs: DataFrame) -> DataFrame:
    """k (key of the whole conversation), ends: SHA-256 of the ascending conv_ids, comma-joined.

    Ids are sorted over all partitions and joined to runs; the runs of a key are hashed one after the other as they
    stream by, so that a conversation with any number of copies takes constant memory.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, ids = batch.column("k").to_pylist(), batch.column("conv_id").to_pylist()
            cuts = [i for i in range(len(k)) if i == 0 or k[i] != k[i - 1]] + [len(k)]
            parts = [(a, min(a + IDS, b)) for lo, b in zip(cuts, cuts[1:]) for a in range(lo, b, IDS)]
            yield pa.RecordBatch.from_pydict({"k": [k[a] for a, _ in parts], "first": pa.array([ids[a] for a, _ in parts], pa.int64()), "ids": [",".join(map(str, ids[a:b])) for a, b in parts]})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[str, str]] = []
            for k, ids in zip(batch.column("k").to_pylist(), batch.column("ids").to_pylist()):
                if k != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"k": pa.array([x for x, _ in done], pa.string()), "ends": pa.array([x for _, x in done], pa.string())})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"k": [now], "ends": [state.hexdigest()]})

    ids = convs.select(F.md5("turns").alias("k"), "conv_id")
    ids = ids.repartitionByRange("k", "conv_id").sortWithinPartitions("k", "conv_id").mapInArrow(runs, "k string, first long, ids string")
    return ids.repartition("k").sortWithinPartitions("k", "first").mapInArrow(hashed, "k string, ends string")


def trunk(seqs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes under which more than ``most`` turns of several conversations stand, and for each conversation how many it passes.

    First: depth, key, prefix, size, n_convs, conv_id. Second: k, passed.
    """
    spark, open_, depth = seqs.sparkSession, seqs.where("len > 0"), 0
    heavy = spark.createDataFrame([], "depth int, key string, prefix binary, size long, n_convs long, conv_id long")
    passed = spark.createDataFrame([], "k string, passed int")
    while True:
        each = open_.withColumn("depth", F.explode(F.sequence(F.lit(depth + 1), F.least("len", F.lit(depth + ROUND)))))
        prefix = F.expr(f"substring(turns, 1, depth * {TURN})")
        size = F.conv(F.hex(F.expr(f"substring(turns, depth * {TURN} - 7, 8)")), 16, 10).cast("long")
        each = each.select("k", "depth", key(F.col("depth")).alias("key"), prefix.alias("prefix"), size.alias("size"), "n", "conv_id", (F.col("len") - F.col("depth") + 1).alias("turns_below"))
        found = each.groupBy("depth", "key").agg(F.sum("turns_below").alias("turns_below"), F.count("*").alias("seqs"), F.min("size").alias("size"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        found = settle(found.where((F.col("turns_below") > most) & (F.col("seqs") > 1)).select("depth", "key", "size", "n_convs", "conv_id"))
        if found.isEmpty():
            return heavy, passed
        marks = small_side(found.select("depth", "key"))
        through = settle(each.join(marks, ["depth", "key"], "left_semi").groupBy("k").agg(F.max("depth").alias("passed")))
        named = settle(each.select("depth", "key", "prefix", "conv_id").join(small_side(found.select("depth", "key", F.col("conv_id"))), ["depth", "key", "conv_id"]).groupBy("depth", "key").agg(F.first("prefix").alias("prefix")))
        heavy = heavy.unionByName(found.join(named, ["depth", "key"]))
        passed = passed.unionByName(through)
        depth += ROUND
        open_ = settle(open_.where(F.col("len") > depth).join(small_side(through.where(F.col("passed") == depth).select("k")), "k", "left_semi"))


def _subtries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one share: every conversation is walked from the node where it was cut off."""
    tops: dict[str, int] = {}
    below: list[dict[bytes, int]] = []
    parent, depth, convs, first, size, end, above = [], [], [], [], [], [], []

    def node(up: int, at: int, length: int, over: str | None) -> int:
        for column, value in ((below, {}), (parent, up), (depth, at), (convs, 0), (first, None), (size, length), (end, NO_ENDS), (above, over)):
            column.append(value)
        return len(parent) - 1

    for top, cut, over, s, n, conv, e in zip(pdf["top"], pdf["cut"], pdf["above"], pdf["turns"], pdf["n"], pdf["conv_id"], pdf["ends"]):
        length = lambda i, s=s: int.from_bytes(s[i * TURN - 8 : i * TURN], "big")
        at = tops.get(top)
        if at is None:
            at = tops[top] = node(-1, cut, length(cut), over)
        for i in range(cut, len(s) // TURN + 1):
            convs[at] += n
            first[at] = conv if first[at] is None or conv < first[at] else first[at]
            if i < len(s) // TURN:
                turn = s[i * TURN : i * TURN + DIGEST]
                after = below[at].get(turn)
                if after is None:
                    after = below[at][turn] = node(at, i + 1, length(i + 1), None)
                at = after
        end[at] = e
    leaves, saved = [0] * len(parent), [0] * len(parent)
    for i in range(len(parent) - 1, -1, -1):  # a node is younger than its parent: children come first
        leaves[i] = leaves[i] or 1
        saved[i] += (convs[i] - 1) * size[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    ups = pd.array([first[p] if p >= 0 else None for p in parent], dtype="Int64")
    return pd.DataFrame({"conv_id": first, "depth": depth, "parent_conv_id": ups, "n_convs": convs, "n_children": [len(b) for b in below], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": end, "above": above})


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(convs: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each node, the distinct sequences of first d turns, from ``convs`` (conv_id, turns as ``packed``).

    conv_id: the smallest member; depth; parent_conv_id: its parent's conv_id (root: null); n_convs: members;
    n_children; n_leaves: childless nodes of its subtree; saved_tokens: (n_convs - 1) times the bytes of the last text,
    summed over its subtree; ends_sha256: of the conv_ids that end here. Subtrees include their top.

    Conversations without turns are members of the root; null turns count as none. A table without conversations has no nodes,
    not even a root. conv_id is taken to be unique, as ``packed`` makes it. The turns of one conversation (24 bytes each,
    no texts) stand in one task; all else is split.
    """
    convs = settle(convs.select("conv_id", F.coalesce("turns", F.lit(b"")).alias("turns")))
    if convs.isEmpty():
        return convs.sparkSession.createDataFrame([], NODE)
    seqs = convs.groupBy("turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).withColumns({"k": F.md5("turns"), "len": (F.octet_length("turns") / TURN).cast("int")})
    seqs = settle(seqs.join(ends(convs), "k"))
    heavy, passed = trunk(seqs, most)
    root = seqs.agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("len").alias("turns"))
    total = root.first()["turns"]
    heavy = heavy.unionByName(root.select(F.lit(0).alias("depth"), F.md5(F.lit(b"")).alias("key"), F.lit(b"").alias("prefix"), F.lit(0).cast("long").alias("size"), "n_convs", "conv_id"))
    heavy = settle(heavy.withColumn("above", F.when(F.col("depth") > 0, F.md5(F.expr(f"substring(prefix, 1, (depth - 1) * {TURN})")))))

    rows = seqs.join(small_side(settle(passed.groupBy("k").agg(F.max("passed").alias("passed")))), "k", "left").withColumn("cut", F.coalesce("passed", F.lit(0)) + 1)
    shares = max(4 * int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // most))
    rows = rows.where("cut <= len").select(key(F.col("cut")).alias("top"), "cut", key(F.col("cut") - 1).alias("above"), "turns", "n", "conv_id", "ends")
    rows = rows.withColumn("share", F.pmod(F.xxhash64("top"), F.lit(shares)))
    nodes = settle(rows.groupBy("share").applyInPandas(lambda pdf: _subtries(pdf), NODE + ", above string"))

    tops = nodes.where("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    splits = heavy.where("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("splits"))
    own = heavy.join(tops.withColumnRenamed("above", "key"), "key", "left").join(splits.withColumnRenamed("above", "key"), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    own = settle(own.withColumns({"n_children": zero("tops") + zero("splits"), "saved": zero("saved") + (F.col("n_convs") - 1) * F.col("size"), "leaves": zero("leaves")}).drop("tops", "splits"))
    upward = own.select("leaves", "saved", F.explode(F.expr(f"transform(sequence(0, depth), d -> md5(substring(prefix, 1, d * {TURN})))")).alias("key"))
    upward = upward.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    over = small_side(settle(heavy.select(F.col("key").alias("above"), F.col("conv_id").alias("up"))))
    split = own.drop("leaves", "saved").join(upward, "key").join(seqs.select(F.col("k").alias("key"), "ends"), "key", "left").join(over, "above", "left")
    split = split.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    under = nodes.join(over, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).select(split.columns)
    return under.unionByName(split)
