"""Pages of statements taken in as they come, with the balance carried from page to page.

Pages may arrive in any order, late, or failed and read again later. Each batch derives anew only the pages from the earliest
that it brought, behind the last balance before them; the rest of the statement stands. A batch writes its own folders and
reads those of earlier ones alone, so a batch that is run again after a crash gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import chain
from ledgerloom.sources.readers import CHECKPOINT, rows_of_checkpoints
from ledgerloom.streaming.pages import page_stream

MONEY = "decimal(18,2)"
PAGES = CHECKPOINT.replace(", _corrupt string", "")
DERIVED = f"statement long, page int, row_no int, date string, description string, movement {MONEY}, balance {MONEY}, printed_side string, boundary string, opening boolean, derived {MONEY}, side string, ok boolean, scale_fixed boolean"
REFUSED = "statement long, page int, stamp string, owner string"
TABLES = {"pages": PAGES, "refused": REFUSED, "results": DERIVED}


def create(spark: SparkSession, folder: str) -> None:
    """Empty tables in ``folder``, unless they are there."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).withColumn("batch", F.lit(-1)).write.mode("ignore").partitionBy("batch").parquet(f"{folder}/{name}")


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What all batches have written to a table, with batch."""
    return spark.read.schema(f"{TABLES[name]}, batch long").parquet(f"{folder}/{name}")


def take(pages: DataFrame, batch: int, folder: str) -> None:
    """Take one batch of pages (as stored by a run) into ``folder``.

    The first stamp of a statement is its reader's; pages with another one are refused and named. A page that was read is
    never taken again; one that failed (error) has no rows and is replaced once it is read. Of one page's copies in a batch
    the first by error, stamp and content counts.
    """
    spark = pages.sparkSession
    create(spark, folder)
    before = stored(spark, folder, "pages").where(F.col("batch") < batch)
    one = Window.partitionBy("statement", "page").orderBy(F.col("error").isNotNull(), "stamp", F.to_json(F.struct("rows", "footer")))
    fresh = pages.where("statement IS NOT NULL AND page IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("statement", "page", "stamp").orderBy(F.col("error").isNotNull(), F.to_json(F.struct("rows", "footer"))))).where("_n = 1").drop("_n")
    owners = before.groupBy("statement").agg(F.min_by(F.struct("stamp"), F.struct("batch", "page")).alias("_old"))
    first = F.first(F.struct("stamp")).over(Window.partitionBy("statement").orderBy("page", "stamp"))
    fresh = fresh.withColumn("_new", first).join(owners, "statement", "left").withColumn("owner", F.coalesce("_old", "_new").stamp).drop("_old", "_new")
    incoming = f"{folder}/incoming/batch={batch}"
    fresh.write.mode("overwrite").parquet(incoming)  # the batch is worked out once, not for each table
    fresh = spark.read.schema(fresh.schema).parquet(incoming)
    own = F.col("stamp").eqNullSafe(F.col("owner"))
    fresh.where(~own).select("statement", "page", "stamp", "owner").write.mode("overwrite").parquet(f"{folder}/refused/batch={batch}")
    read = before.where("error IS NULL").select("statement", "page")
    taken = fresh.where(own).withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "owner").join(read, ["statement", "page"], "left_anti")
    taken.select(*before.drop("batch").columns).write.mode("overwrite").parquet(f"{folder}/pages/batch={batch}")
    derive(spark, batch, folder)


def derive(spark: SparkSession, batch: int, folder: str) -> None:
    """Results of the pages that a batch touches: its own and all that follow in their statements."""
    known = stored(spark, folder, "pages").where((F.col("batch") <= batch) & F.col("error").isNull())
    since = stored(spark, folder, "pages").where(F.col("batch") == batch).groupBy("statement").agg(F.min("page").alias("since"))
    pages = known.join(since, "statement")
    rows = rows_of_checkpoints(pages.where("page >= since")).drop("seq")
    before = rows_of_checkpoints(pages.where("page < since")).where("balance IS NOT NULL").groupBy("statement").agg(F.max_by("balance", F.struct("page", "row_no")).alias("balance"))
    nothing = {c: F.lit(None).cast(t) for c, t in rows.dtypes if c not in ("statement", "page", "row_no", "balance")}
    carried = before.join(since, "statement").select("statement", (F.col("since") - 1).alias("page"), F.lit(0).alias("row_no"), "balance").withColumns(nothing)
    chained = chain.derive(rows.unionByName(carried).withColumn("seq", F.row_number().over(Window.partitionBy("statement").orderBy("page", "row_no"))))
    out = chained.where("row_no > 0").select(*stored(spark, folder, "results").drop("batch").columns)
    out.write.mode("overwrite").parquet(f"{folder}/results/batch={batch}")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The statements as they stand: each page's rows from the last batch that derived it."""
    results = stored(spark, folder, "results")
    last = results.groupBy("statement", "page").agg(F.max("batch").alias("batch"))
    return results.join(last, ["statement", "page", "batch"]).drop("batch")


def start(spark: SparkSession, source: str, folder: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Take in what lies in ``source`` and stop; run it again for what has come since, also after a crash."""
    stream = page_stream(spark, source, files)
    return stream.writeStream.foreachBatch(lambda df, batch: take(df, batch, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
