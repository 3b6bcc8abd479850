"""Gates over streams: counts by event-time window, and the share of a class, as Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.sources.sinks import shared_folder


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant: a time without a zone is read in the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def window_counts(stream: DataFrame, ts: str, by: tuple, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, end, by, n): state is one counter for each open window and key; rows later than the watermark go."""
    got = _timed(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, window).alias("_w"), *by).agg(F.count("*").alias("n"))
    return got.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "n")


def share_gate(stream: DataFrame, ts: str, label: str, least: float = 0.15, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, n, share, pass): whether the label is true in at least the given share of a window's rows."""
    got = _timed(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, window).alias("_w")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("share"))
    return got.select(F.col("_w.start").alias("start"), "n", "share", (F.col("share") >= least).alias("pass"))


def drained(result: DataFrame, path: str | None = None) -> DataFrame:
    """Run an appending stream over all that its source has now, into Parquet, and read that: windows the watermark has closed."""
    spark = result.sparkSession
    out = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = result.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/rows")
