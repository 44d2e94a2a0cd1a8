"""Bars from a stream of ticks: a day's bar is provisional until the watermark has passed its end, then it is published once.

The state is one row for each key and open day, kept by the state store and its checkpoint: a tick that comes later in a day supersedes what was known of it, in
whatever order ticks arrive; ticks of a day that is closed are dropped. A restarted stream goes on where it stood and
publishes no day twice, because the file sink knows its batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def live_bars(ticks: DataFrame, keys: list[str], time: str, value: str, version: str, late: str = "2 days") -> DataFrame:
    """(keys, day, open, high, low, close, n) of each day. ``ticks`` is a stream or a table; of ticks at one time the one with the larger
    ``version`` is the later. Ticks without a time or value count for nothing."""
    own = ticks.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    if own.isStreaming:
        own = own.withWatermark(time, late)
    order = F.struct(time, version)
    bars = own.groupBy(F.window(time, "1 day").alias("w"), *keys).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(F.lit(1)).alias("n")
    )
    return bars.select(*keys, F.to_date("w.start").alias("day"), "open", "high", "low", "close", "n")


def publish(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, keys: list[str], time: str, value: str, version: str, late: str = "2 days") -> DataFrame:
    """Takes what is new in ``source`` (a folder of Parquet files), publishes the days that it closes in ``sink``, and returns all that is published."""
    stream = live_bars(spark.readStream.schema(schema).parquet(source), keys, time, value, version, late)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)
