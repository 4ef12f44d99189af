"""Identification of files as they arrive.

Results depend on one file at a time, so the stream keeps no state: the same
plan runs over each micro-batch and appends. ``max_files`` bounds a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.identify import identify
from sigloom.sources.catalog import Catalog

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of the files that appear in a folder."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", max_files).load(folder).withColumn("mime", F.lit(""))


def identify_stream(files: DataFrame, catalogs: list[Catalog], out: str, checkpoint: str, mode: str = "conclusive", once: bool = True, then: Callable | None = None):
    """Start the stream: every batch is identified and appended to the parquet table ``out``.

    A batch writes under its number, so a batch that is run again after a failure replaces its own rows.
    """

    def batch(df: DataFrame, number: int) -> None:
        identify(df, catalogs, mode).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if then:
            then(df, number)

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
