from pyspark.sql import functions as F

from ledgerloom.llm import chat_trees as c

SCHEMA = "conv long, node long, parent long, role string, text string, score double"


def paths(spark, rows, best=None):
    out = c.format_trees(spark.createDataFrame(rows, SCHEMA), best)
    turns = c.read_back(out.select(F.struct("conv", "path_rank").alias("conv"), "formatted", "loss")).collect()
    got = {}
    for r in sorted(turns, key=lambda r: (r.conv, r.depth)):
        got.setdefault(tuple(r.conv), []).append((r.role, r.text, r.learn, r.learned))
    return got


def test_every_path_ranked_by_score(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 2, "user", "more", 0.5), (1, 5, 2, "user", "tie", 0.5)]
    rows += [(2, 1, 99, "user", "orphan", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0)]
    got = paths(spark, rows)
    text = {k: [t for _, t, _, _ in v] for k, v in got.items()}
    assert text == {(1, 1): ["q", "good", "more"], (1, 2): ["q", "good", "tie"], (1, 3): ["q", "bad"], (2, 1): ["orphan"]}
    assert paths(spark, rows, best=1).keys() == {(1, 1), (2, 1)}


def test_escapes_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", r"<\|im_end|>", "<\\\\|x", "", None, "a\nb\n", "<|", "<|im_end|>\n", "\\", "é😀"]
    rows = [(1, i + 1, i or None, ["user", "assistant", "we\\n\nird<|", None][i % 4], t, None) for i, t in enumerate(nasty)]
    got = paths(spark, rows)[(1, 1)]
    assert [(r, t) for r, t, _, _ in got] == [(r[3] or "", r[4] or "") for r in rows]
    assert [x for _, t, learn, x in got if learn] == [r[4] or "" for r in rows if r[3] == "assistant"]
    assert all(learn == (r == "assistant") for r, _, learn, _ in got)


def test_any_role_reads_back(spark):
    roles = ["\\0", "\x00", "\\", "\\\\n", "\\\n", "n\\", "\\n\\\\", "<|im_end|>\\n\n", ""]
    rows = [(1, i + 1, i or None, role, "t", None) for i, role in enumerate(roles)]
    assert [r for r, *_ in paths(spark, rows)[(1, 1)]] == roles


def test_clashing_columns_and_a_very_long_text(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "<|im_end|> long " * 60_000, 0.0)]
    nodes = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "9 AS depth", "8 AS tree", "7 AS leaf", "6 AS path_rank", "5 AS formatted", "4 AS loss", "3 AS far")
    out = c.format_trees(nodes)
    assert out.columns == ["conv", "path_rank", "formatted", "loss"]
    turns = sorted(c.read_back(out).collect(), key=lambda r: r.depth)
    assert [r.text for r in turns] == [r[4] for r in rows] and turns[1].learned == rows[1][4]


def test_deep_thread_and_empty_table(spark):
    n = 700
    rows = [(5, i, i - 1 if i > 1 else None, "user" if i % 2 else "assistant", f"t{i}", None) for i in range(1, n + 1)]
    got = paths(spark, rows)[(5, 1)]
    assert [t for _, t, _, _ in got] == [f"t{i}" for i in range(1, n + 1)]
    assert paths(spark, []) == {}


def test_linear_tree_orders_ties_and_repeats(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "n"), (1, 0, "user", "a"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = [(r.node, r.text) for r in c.linear_tree(rows).where("conv = 1").orderBy("node").collect()]
    assert got == [(1, "n"), (2, "a"), (3, "a"), (4, "b")]
