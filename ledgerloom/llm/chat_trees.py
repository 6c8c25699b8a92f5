"""Chat formatting of reply trees.

Messages point to the message that they answer. Paths from the root to chosen leaves are enumerated by iterative
self-joins that double their reach (ancestors at distance 1, 2, 4, ...), so a thread of any depth takes a number of
joins that grows with the logarithm of its depth. Branches are ranked by the sum of their scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, settle

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Put one more backslash between ``<`` and ``|`` wherever only backslashes stand between them."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _escape_role(role: Column) -> Column:
    """A role stands on one line: its backslashes and line ends are written as two characters."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    """Pairs of backslashes are read from the left, so a line end's backslash is never taken for half of a pair."""
    parts = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def reply_paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """tree, leaf, path_rank (from 1), depth (from 0) and node of the ``best`` paths of each tree; None: all.

    nodes: tree, node, parent (null: root), score (null: 0); node unique within its tree. A path's score is the
    sum along it; ties go to the smaller leaf. A node whose parent doesn't exist is a root. Nodes on a cycle of
    parents have no leaf and are left out.
    """
    up = settle(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    rows = up.count()
    near = F.broadcast if rows <= BROADCAST_ROWS else lambda side: side  # larger forests are joined by a shuffle
    known = near(up.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there")))
    up = up.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("far"), "score", F.lit(1).cast("long").alias("length"))
    up = settle(up)
    open_, total = up.where("far IS NOT NULL"), up.where("far IS NULL")
    # jumps[k]: far is the ancestor at distance 2^k. Rows carry score and length of the path from node up to before far;
    # those that have reached the root wait in total, so a round joins only the nodes that are deeper than 2^k.
    jumps = []
    while open_.head(1) and 2 ** len(jumps) <= 2 * rows:  # beyond that only cycles are left
        jumps.append(open_.select("tree", "node", "far"))
        over = open_.unionByName(total).select("tree", F.col("node").alias("far"), F.col("far").alias("far2"), F.col("score").alias("score2"), F.col("length").alias("length2"))
        step = open_.join(near(over), ["tree", "far"]).select("tree", "node", F.col("far2").alias("far"), (F.col("score") + F.col("score2")).alias("score"), (F.col("length") + F.col("length2")).alias("length"))
        step = settle(step)
        open_, total = step.where("far IS NOT NULL"), total.unionByName(step.where("far IS NULL"))
    parents = up.where("far IS NOT NULL").select("tree", F.col("far").alias("node")).distinct()
    ranked = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    leaves = total.join(near(parents), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "score", "length").withColumn("path_rank", F.row_number().over(ranked))
    if best is not None:
        leaves = leaves.where(F.col("path_rank") <= best)
    on = settle(leaves.select("tree", "leaf", "path_rank", F.col("leaf").alias("node"), (F.col("length") - 1).alias("depth")))
    for k, jump in reversed(list(enumerate(jumps))):
        over = on.join(near(jump), ["tree", "node"]).select("tree", "leaf", "path_rank", F.col("far").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        on = settle(on.unionByName(over))
    return on


def format_paths(turns: DataFrame) -> DataFrame:
    """conv, formatted, loss: one row per conversation of ``turns`` (conv, depth, role, text).

    Each turn is written as START role, line end, text, END, line end, with role and text escaped. ``loss`` is an
    array of (start, length) in characters of ``formatted``: the text of each assistant turn, in order.
    """
    role, text = _escape_role(F.col("role")), escape(F.col("text"))
    piece = F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))
    before = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select("conv", "depth", F.col("role").eqNullSafe("assistant").alias("learn"), piece.alias("piece"), (F.length(role) + len(START) + 1).alias("head"), F.length(text).alias("chars"))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("head"))
    span = F.when(F.col("learn"), F.struct(F.col("start").cast("long").alias("start"), F.col("chars").cast("long").alias("length")))
    rows = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss"))
    return rows.select("conv", F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv, depth, role, text, learn: the turns as they stand in ``formatted``; learn: under the loss mask."""
    pieces = formatted.select("conv", F.posexplode(F.split("formatted", r"<\|im_end\|>\n")).alias("depth", "piece")).where("piece <> ''")
    at = F.instr("piece", "\n")
    before = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece") + len(END) + 1).over(before), F.lit(0)) + at)
    rows = rows.select("conv", "depth", "start", F.expr(f"substring(piece, {len(START) + 1}, instr(piece, '\\n') - {len(START) + 1})").alias("role"), F.expr("substring(piece, instr(piece, '\\n') + 1)").alias("body"))
    spans = formatted.select("conv", F.explode("loss").alias("s")).select("conv", F.col("s.start").alias("start"), F.col("s.length").alias("chars")).groupBy("conv", "start").agg(F.max("chars").alias("chars"))
    rows = rows.join(spans, ["conv", "start"], "left")
    return rows.select("conv", "depth", _unescape_role(F.col("role")).alias("role"), unescape(F.col("body")).alias("text"), F.col("chars").isNotNull().alias("learn"), unescape(F.expr("substring(body, 1, cast(coalesce(chars, 0) AS int))")).alias("learned"))


def linear_tree(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, node, parent, role, text: each turn answers the one before it; equal turns go by role, then text.

    Null roles and texts are empty; rows without conversation are left out by ``format_trees``.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def format_trees(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """conv, path_rank, formatted, loss: the ``best`` paths of each reply tree as conversations.

    nodes: conv, node, parent, role, text and optionally score. Null roles and texts are empty; an empty table
    gives no rows; extra columns are ignored; nodes without conversation or node are left out. Texts of any length are whole.
    """
    nodes = settle(nodes)
    tree = nodes.select(F.col("conv").alias("tree"), "node", "parent", F.col("score") if "score" in nodes.columns else F.lit(0.0).alias("score"))
    paths = reply_paths(tree, best).withColumnRenamed("tree", "of")
    turns = paths.join(nodes.select(F.col("conv").alias("of"), "node", "role", "text"), ["of", "node"])
    turns = turns.select(F.struct("of", "path_rank").alias("conv"), "depth", "role", "text")
    return format_paths(turns).select(F.col("conv.of").alias("conv"), F.col("conv.path_rank").alias("path_rank"), "formatted", "loss")
