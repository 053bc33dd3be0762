"""Streams of records: read as files arrive, drop what was seen, assign windows, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str | T.StructType, form: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(folder)


def once_per_key(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first row of a key; keys are remembered for as long as rows may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def assign(stream: DataFrame, windows: DataFrame, key: str, at: str) -> DataFrame:
    """Joins the stream with static windows (key, start, end, split); rows outside all windows are dropped.

    The windows of a key must not overlap (see operators.intervals.overlaps): a stream keeps no order
    among a row's matches.
    """
    w = windows.select(F.col(key).alias("_k"), "start", "end", "split")
    return stream.join(w, (F.col(key) == F.col("_k")) & (F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("_k", "start", "end")


def counts(stream: DataFrame, at: str, by: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per tumbling (or sliding) window; rows later than `late` are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size, slide) if slide else F.window(at, size), *by).count().select(F.col("window.start").alias("start"), *by, "count")


def append(stream: DataFrame, folder: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Writes what is available now and stops; run again, it goes on where it stopped."""
    return stream.writeStream.format(form).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
