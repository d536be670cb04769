"""Archives that arrive in a folder, verified as they come. An addition of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import images as I

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, size) of new archives below a folder; contents aren't read here."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    return files.filter(F.lower("path").endswith(".chd")).select("path", F.col("length").alias("size"))


def verify_arrivals(spark: SparkSession, root: str, reports: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write a report row for each new archive to ``reports``.

    A batch that runs again replaces its own folder, so each archive has one row there.
    """

    def write(batch: DataFrame, number: int) -> None:
        I.verify(batch).write.mode("overwrite").parquet(f"{reports}/batch={number}")

    q = arrivals(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="10 seconds")).start()
