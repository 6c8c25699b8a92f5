"""Readers of what a statement reader leaves behind, and sinks, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ascii_digits, iso_date, parse_amount

MONEY = "decimal(18,2)"
ROW = "struct<date:string,description:string,movement:string,balance:string,side:string>"
#: A page as it is stored by a run: what was read, the printed totals, and how it went.
CHECKPOINT = f"statement long, page int, printed_page int, footer struct<debits:string,credits:string,balance:string>, rows array<{ROW}>, stamp string, error string, _corrupt string"


def csv_statement(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of a CSV with a header: date, description, movement, balance, side; unreadable amounts are null."""
    raw = spark.read.schema("date string, description string, movement string, balance string, side string").option("header", True).csv(path)
    return raw.withColumns({"movement": parse_amount(F.col("movement")), "balance": parse_amount(F.col("balance")), "date": iso_date(F.col("date"))})


def ocr_words(spark: SparkSession, path: str, confidence: float = 0.0) -> DataFrame:
    """Words of a tab-separated OCR table with digits in ASCII; empty words and those under ``confidence`` are dropped."""
    raw = spark.read.schema("page int, x int, y int, w int, h int, conf double, text string").options(header=True, sep="\t").csv(path)
    return raw.where((F.col("conf") >= confidence) & (F.trim("text") != "")).withColumn("text", ascii_digits(F.col("text")))


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages (JSON lines); lines that can't be read are left out."""
    rows = spark.read.schema(CHECKPOINT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("page IS NOT NULL AND _corrupt IS NULL").drop("_corrupt")


def rows_of_checkpoints(pages: DataFrame) -> DataFrame:
    """One typed row per stored row, numbered within its page from 1 and within the statement by seq."""
    rows = pages.select("statement", "page", F.posexplode("rows").alias("i", "r"))
    order = Window.partitionBy("statement").orderBy("page", "i")
    return rows.select("statement", "page", (F.col("i") + 1).alias("row_no"), iso_date(F.col("r.date")).alias("date"), F.col("r.description").alias("description"), parse_amount(F.col("r.movement")).alias("movement"), parse_amount(F.col("r.balance")).alias("balance"), F.col("r.side").alias("printed_side"), F.row_number().over(order).alias("seq"))


def footers_of_checkpoints(pages: DataFrame) -> DataFrame:
    """Printed totals by page; a footer of which nothing could be read is null in every part."""
    return pages.select("statement", "page", *[parse_amount(F.col(f"footer.{p}")).alias(p) for p in ("debits", "credits", "balance")])


def publishable(pages: DataFrame, stamp: str) -> DataFrame:
    """How many pages carry the reader's stamp, none, or another's."""
    kind = F.when(F.col("stamp").isNull(), "unstamped").when(F.col("stamp") == stamp, "matching").otherwise("stale")
    return pages.groupBy(kind.alias("kind")).agg(F.count("*").alias("pages"))


def pages_of_text(texts: DataFrame, mark: str = "\f") -> DataFrame:
    """statement, page, text: one row per page of a text with page marks; empty pages are kept."""
    return texts.select("statement", F.posexplode(F.split("text", mark)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def rows_of_text(pages: DataFrame) -> DataFrame:
    """Rows from lines that begin with a date: up to three amounts at the end are balance; movement and balance; or debit, credit and balance."""
    lines = pages.select("statement", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    start = r"^\s*([0-9٠-٩۰-۹]{1,4}[/.-][0-9٠-٩۰-۹]{1,2}[/.-][0-9٠-٩۰-۹]{1,4})\s+(.*)$"
    lines = lines.where(F.col("line").rlike(start)).select("statement", "page", "line_no", F.regexp_extract("line", start, 1).alias("date"), F.regexp_extract("line", start, 2).alias("rest"))
    tail = F.regexp_extract("rest", r"((?:\s*-?[0-9٠-٩۰-۹][0-9٠-٩۰-۹.,٫٬]*-?){1,3})\s*$", 1)
    lines = lines.withColumn("amounts", F.transform(F.filter(F.split(F.trim(tail), r"\s+"), lambda w: w != ""), parse_amount)).withColumn("description", F.trim(F.expr("left(rest, length(rest) - length(regexp_extract(rest, '((?:\\\\s*-?[0-9٠-٩۰-۹][0-9٠-٩۰-۹.,٫٬]*-?){1,3})\\\\s*$', 0)))")))
    n = F.size("amounts")
    first, second = F.get("amounts", F.lit(0)), F.get("amounts", F.lit(1))
    movement = F.when(n == 2, first).when(n == 3, F.coalesce(F.nullif(first, F.lit(0).cast(MONEY)), second))
    side = F.when(n == 3, F.when(F.coalesce(first, F.lit(0)) != 0, "debit").otherwise("credit"))
    return lines.select("statement", "page", "line_no", "date", "description", movement.alias("movement"), F.when(n > 0, F.element_at("amounts", -1)).alias("balance"), side.alias("printed_side"))


def answer_rows(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Rows of a model's JSON answer: a list, or an object with rows; commas before a closing bracket are forgiven."""
    json = F.regexp_replace(F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1), r",\s*([\]}])", "$1")
    plain, wrapped = F.from_json(json, f"array<{ROW}>"), F.from_json(json, f"struct<rows:array<{ROW}>>").getField("rows")
    rows = F.when(json.startswith("["), plain).otherwise(wrapped)
    return answers.withColumn("_r", rows).select(*answers.columns, F.posexplode_outer("_r").alias("i", "r")).select(*[c for c in answers.columns if c != text], "i", "r.*")


def witness_rows(lines: DataFrame) -> DataFrame:
    """page, x, amount, balance from lines ``ROW|x|amount|balance``; other lines are skipped."""
    parts = F.split("line", r"\|")
    return lines.where(F.col("line").startswith("ROW|") & (F.size(parts) == 4)).select("page", parts[1].try_cast("double").alias("x"), parse_amount(parts[2]).alias("amount"), parse_amount(parts[3]).alias("balance"))


def column_of_position(x: Column, debit_x: Column, credit_x: Column) -> Column:
    """The nearer of two columns; '' if neither."""
    return F.when(F.abs(x - debit_x) < F.abs(x - credit_x), "debit").when(F.abs(x - debit_x) > F.abs(x - credit_x), "credit").otherwise("")


def clusters(words: DataFrame, tolerance: int = 8) -> DataFrame:
    """line: words whose y is within ``tolerance`` of the word above stand on one line."""
    order = Window.partitionBy("page").orderBy("y", "x")
    new = (F.col("y") - F.lag("y").over(order) > tolerance).cast("int")
    return words.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("line", F.sum("_new").over(order)).drop("_new")


def write_index(rows: DataFrame, path: str) -> None:
    """Parquet of the rows, zstd, sorted within files by statement and page for pruning."""
    rows.sortWithinPartitions("statement", "page").write.mode("overwrite").option("compression", "zstd").parquet(path)
