"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; every caller counts the side first.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset a new local one, on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a settled table for broadcast if it has at most ``most`` rows, else leave it to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Elements of an array that are summed anew for each place; sums of whole blocks are kept.
BLOCK = 128


def _sum(widths: str, after: str, count: str) -> str:
    return f"aggregate(slice({widths}, {after} + 1, {count}), 0, (t, x) -> t + x)"


def block_sums(widths: str) -> str:
    """SQL: for each BLOCK elements of an array of ints the sum of all before them."""
    return f"aggregate(filter(sequence(0, size({widths}) div {BLOCK}), b -> b > 0), array(0), (a, b) -> concat(a, array(element_at(a, -1) + {_sum(widths, f'(b - 1) * {BLOCK}', str(BLOCK))})), a -> a)"


def sum_before(widths: str, blocks: str, i: str) -> str:
    """SQL: the sum of the first ``i`` elements, from ``block_sums``; a text with many matches costs in proportion to them."""
    return f"{blocks}[{i} div {BLOCK}] + {_sum(widths, f'{i} div {BLOCK} * {BLOCK}', f'{i} % {BLOCK}')}"
