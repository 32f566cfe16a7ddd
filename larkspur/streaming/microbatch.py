"""Structured Streaming: filtered micro-batches to hourly folders, and windowed counts with watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def track(source: DataFrame, text: str, words: Sequence[str] = (), langs: Sequence[str] = (), lang: str = "lang") -> DataFrame:
    """Rows that hold one of words and are in one of langs; no words or langs means any."""
    if words:
        source = source.where(F.lower(text).rlike("|".join(rf"\Q{w.lower()}\E" for w in words)))
    return source.where(F.col(lang).isin(list(langs))) if langs else source


def parquet_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_sink(stream: DataFrame, ts: str, path: str, checkpoint: str, every: str = "1 second", available_now: bool = False) -> StreamingQuery:
    """Appends JSON to folders by hour, each batch after `every`, or all that is there and then an end."""
    out = stream.withColumn("hour", F.date_format(ts, "yyyy-MM-dd-HH"))
    return out.writeStream.format("json").partitionBy("hour").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**({"availableNow": True} if available_now else {"processingTime": every})).start()


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and tumbling window; as a stream, rows later than `late` are dropped. The same plan runs on a table."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
