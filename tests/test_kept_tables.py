import json
import random

from pyspark.sql import functions as F

from ledgerloom.operators import chain, index, search
from ledgerloom.sources import readers
from ledgerloom.streaming import intake

TERMS = ["fee", "card", "a", "zz"]


def rows_of(spark, data):
    return spark.createDataFrame(list(data.items()), "row_key string, text string")


def scanned(spark, data):
    return [tuple(r) for r in search.bm25(rows_of(spark, data), TERMS, 50, doc_id="row_key").collect()]


def test_index_after_changes_equals_one_built_anew(spark, tmp_path):
    r, path = random.Random(1), f"{tmp_path}/index"
    text = lambda: " ".join(r.choice(["fee", "card", "a", "b", "c", "Fee-7"]) for _ in range(r.randint(0, 6)))
    state = {f"k{i}": text() for i in range(30)}
    index.create(spark, path, 4)
    index.change(path, rows_of(spark, state))
    for change in ({f"k{i}": text() for i in range(20, 40)}, {f"k{i}": None for i in range(0, 30, 4)} | {"k99": None}, {"k0": "fee fee", "k50": ""}):
        index.change(path, rows_of(spark, change))
        state = {k: t for k, t in (state | change).items() if t is not None}
        assert [tuple(x) for x in index.search(spark, path, TERMS, 50).collect()] == scanned(spark, state)
    assert {x.row_key for x in index.live(spark, path).collect()} == set(state)
    index.compact(spark, path, f"{tmp_path}/small")
    assert [tuple(x) for x in index.search(spark, f"{tmp_path}/small", TERMS, 50).collect()] == scanned(spark, state)
    assert len(index.segments(spark, f"{tmp_path}/small")) == 2
    index.change(f"{tmp_path}/small", rows_of(spark, {"k1": "zz"}))
    assert [tuple(x) for x in index.search(spark, f"{tmp_path}/small", TERMS, 50).collect()] == scanned(spark, state | {"k1": "zz"})


def test_a_change_that_was_cut_off_does_not_count(spark, tmp_path):
    path = f"{tmp_path}/index"
    index.change(path, rows_of(spark, {"a": "fee", "b": "card"}))
    stray = index.live(spark, path).select(F.lit("b").alias("row_key"), F.lit(None).cast("int").alias("doc_len"), F.lit(2).alias("segment"), F.lit("stray").alias("part"))
    stray.write.mode("append").partitionBy("part").parquet(f"{path}/docs")  # as a writer leaves it that never got to the table of segments
    assert {x.row_key for x in index.live(spark, path).collect()} == {"a", "b"}
    index.change(path, rows_of(spark, {"b": "fee fee"}))
    assert [x.row_key for x in index.search(spark, path, ["fee"]).collect()] == ["b", "a"]


def test_empty_index(spark, tmp_path):
    path = f"{tmp_path}/index"
    index.change(path, rows_of(spark, {"x": None}).where("row_key = ''"))
    assert index.search(spark, path, ["fee"]).count() == index.search(spark, path, []).count() == 0
    index.change(path, spark.createDataFrame([("a", "fee"), ("a", "fee fee"), (None, "fee")], "row_key string, text string"))
    assert [(x.row_key, x.doc_len) for x in index.live(spark, path).collect()] == [("a", 2)]


def a_statement(seed, n_pages):
    r, balance, pages = random.Random(seed), 1000.0, []
    for page in range(1, n_pages + 1):
        rows = []
        for _ in range(r.randint(0, 3)):
            move = r.randint(1, 99)
            balance += r.choice([-1, 1]) * move
            rows.append({"date": None, "description": "x", "movement": f"{move * r.choice([1, 1, 100])}.00", "balance": r.choice([f"{balance:.2f}", f"{balance:.2f}", None]), "side": None})
        pages.append({"statement": seed, "page": page, "rows": rows, "stamp": "r1"})
    return pages


COLUMNS = ["statement", "page", "row_no", "derived", "side", "ok", "opening", "boundary"]


def in_one(spark, pages, tmp_path, name):
    (tmp_path / name).write_text("\n".join(map(json.dumps, pages)))
    return sorted((tuple(r) for r in chain.derive(readers.rows_of_checkpoints(readers.checkpoints(spark, f"{tmp_path}/{name}"))).select(*COLUMNS).collect()), key=str)


def as_it_stands(spark, folder):
    return sorted((tuple(r) for r in intake.current(spark, folder).select(*COLUMNS).collect()), key=str)


def test_any_order_of_arrival_ends_in_the_batch_result(spark, tmp_path):
    pages = [p for s in (1, 2, 3) for p in a_statement(s, 7)]
    want = in_one(spark, pages, tmp_path, "all.json")
    for seed in (1, 2):
        shuffled = random.Random(seed).sample(pages, len(pages))
        folder = f"{tmp_path}/out{seed}"
        for batch in range(3):
            (tmp_path / f"{seed}-{batch}.json").write_text("\n".join(map(json.dumps, shuffled[batch::3])))
            intake.take(readers.checkpoints(spark, f"{tmp_path}/{seed}-{batch}.json"), batch, folder)
        assert as_it_stands(spark, folder) == want


def test_a_stream_goes_on_after_a_crash(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pages, folder, check = a_statement(1, 6), f"{tmp_path}/out", f"{tmp_path}/check"
    run = lambda: intake.start(spark, f"{tmp_path}/in", folder, check, files=1).awaitTermination()
    for k, some in enumerate((pages[3:], pages[:2])):
        (tmp_path / f"in/{k}.json").write_text("\n".join(map(json.dumps, some)))
        run()
    done = sorted((tmp_path / "check/commits").glob("[0-9]*"))
    (done[-1].parent / f".{done[-1].name}.crc").unlink(missing_ok=True)
    done[-1].unlink()  # the last batch was written, but not committed: it runs again
    (tmp_path / "in/2.json").write_text(json.dumps(pages[2]) + "\n{torn")
    run()
    assert as_it_stands(spark, folder) == in_one(spark, pages, tmp_path, "all.json")
    (tmp_path / "in/3.json").write_text("\n".join(map(json.dumps, pages)))  # all of them once more
    run()
    assert intake.stored(spark, folder, "pages").count() == 6 and as_it_stands(spark, folder) == in_one(spark, pages, tmp_path, "all.json")


def test_failed_pages_break_only_what_follows_and_other_readers_are_refused(spark, tmp_path):
    pages, folder = a_statement(4, 5), f"{tmp_path}/out"

    def take(batch, some):
        (tmp_path / f"b{batch}.json").write_text("\n".join(map(json.dumps, some)))
        intake.take(readers.checkpoints(spark, f"{tmp_path}/b{batch}.json"), batch, folder)

    take(0, [p | ({"rows": [], "error": "torn"} if p["page"] == 3 else {}) for p in pages])
    without = as_it_stands(spark, folder)
    assert without == in_one(spark, [p for p in pages if p["page"] != 3], tmp_path, "w.json")
    take(1, [p | {"stamp": "r2"} for p in pages])
    refused = intake.stored(spark, folder, "refused").collect()
    assert {(x.page, x.stamp, x.owner) for x in refused} == {(p, "r2", "r1") for p in range(1, 6)} and as_it_stands(spark, folder) == without
    for _ in range(2):  # the same batch twice, as after a crash
        take(2, [pages[2], pages[2]])
        assert as_it_stands(spark, folder) == in_one(spark, pages, tmp_path, "all.json")
    assert {x.page for x in intake.stored(spark, folder, "results").where("batch = 2").collect()} <= {3, 4, 5}


def test_nothing_to_take_in(spark, tmp_path):
    intake.take(spark.createDataFrame([], intake.PAGES), 0, f"{tmp_path}/none")
    assert as_it_stands(spark, f"{tmp_path}/none") == []


def test_a_batch_is_worked_out_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    one = spark.createDataFrame([(1, p, None, None, [("2024-01-01", "a", "1", str(p), None)], "r", None) for p in (1, 2, 3)], intake.PAGES)
    intake.take(one.mapInPandas(counted, one.schema), 0, f"{tmp_path}/once")
    assert made.value == 3 and intake.current(spark, f"{tmp_path}/once").count() == 3
