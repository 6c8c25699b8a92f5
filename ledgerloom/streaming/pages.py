"""Pages and events as streams.

A run over pages is a file stream with a checkpoint: a page that was taken in is never read again, and a run that was
cut off goes on where it was. Windows over events are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.readers import CHECKPOINT


def page_stream(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """Stored pages as they appear in ``folder``, at most so many files a batch."""
    return spark.readStream.schema(CHECKPOINT).option("maxFilesPerTrigger", files).option("columnNameOfCorruptRecord", "_corrupt").json(folder).where("page IS NOT NULL AND _corrupt IS NULL").drop("_corrupt")


def take_in(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to ``out`` and stop; run it again to take in what has come since."""
    return pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by window and kind; events later than ``late`` are not counted in."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))
