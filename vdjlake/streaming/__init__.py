"""Running repertoire counts over a growing folder of tables.

An extension: the batch operators are the library's core.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sequence_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_per_id(stream: DataFrame, item: str = "id", time: str = "loaded_at", delay: str = "7 days") -> DataFrame:
    """Each id once; rows delivered again within the delay are dropped, and so is the state beyond it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([item])


def running_clone_counts(stream: DataFrame, keys: list[str], time: str = "loaded_at", window: str = "1 day") -> DataFrame:
    """Rows per clone and day of loading."""
    return stream.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", *keys, "n")
