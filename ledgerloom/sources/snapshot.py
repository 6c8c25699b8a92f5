"""A statement's reading, stored with the digest of its content and of the file that was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lanes of a digest: the first 60 hex digits of a row's SHA-256, fifteen each, added up modulo 2^60.
LANES = 4


class SnapshotMismatch(ValueError):
    """What is stored isn't what its manifest says, or was read from another file."""


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: its columns in order of name, each with its name and length; null differs from empty."""
    cell = lambda c: F.concat(F.lit(c + "="), F.coalesce(F.length(F.col(c).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.sha2(F.concat_ws("|", *[cell(c) for c in sorted(columns)]), 256)


def digest(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n and digest of all rows (or of each group): sums of hashes, so the order of rows and files doesn't matter.

    A changed cell, a lost or doubled row and contents that changed places between rows all change it.
    """
    d = rows.select(*(by or []), row_digest(rows.columns).alias("d"))
    lane = lambda i: F.sum(F.conv(F.substring("d", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)"))
    out = d.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[lane(i).alias(f"l{i}") for i in range(LANES)])
    text = F.concat_ws(".", *[F.coalesce(F.pmod(F.col(f"l{i}"), F.lit(2**60).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(LANES)])
    return out.select(*(by or []), "n", F.sha2(F.concat_ws("/", F.col("n").cast("string"), text), 256).alias("digest"))


def save(tables: dict[str, DataFrame], path: str, source: str) -> None:
    """Write each table as Parquet under ``path``, then a manifest: table, n, digest, columns and the digest of the source."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = [digest(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("table"), "n", "digest", F.lit(source).alias("source")) for name in sorted(tables)]
    whole = manifest[0]
    for part in manifest[1:]:
        whole = whole.unionByName(part)
    whole.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str, source: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, after its source and every digest were compared; SnapshotMismatch otherwise."""
    manifest = spark.read.schema("table string, n long, digest string, source string").json(f"{path}/manifest").collect()  # a row for each table
    if not manifest or {m.source for m in manifest} != {source}:
        raise SnapshotMismatch("the stored reading is of another file")
    out = {}
    for m in manifest:
        table = spark.read.parquet(f"{path}/{m.table}")
        found = digest(table).first()
        if (found.n, found.digest) != (m.n, m.digest):
            raise SnapshotMismatch(f"{m.table}: {found.n} rows of digest {found.digest[:12]}, not {m.n} of {m.digest[:12]}")
        out[m.table] = table
    return out
