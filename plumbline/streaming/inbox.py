"""An inbox of drawing tables: layer totals that are kept up to date as files arrive.

Micro-batches are added to the totals by batch id, so a batch that is tried again
replaces its own part and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.caches import WatchedMap


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window of event time; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def keep_totals(rows: DataFrame, target: str, checkpoint: str, keys: list[str], value: str) -> StreamingQuery:
    """Partial totals by batch below target; totals() adds them up."""

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(target).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def keep_joined(rows: DataFrame, map_: WatchedMap, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Rows with the value that the map has for their key when their batch comes, below target; keys in upper case without a leading H, as the map's.

    The map is looked at before each batch and read anew where its file has changed. A
    batch that is tried again replaces its own part.
    """

    def put(batch: DataFrame, number: int) -> None:
        own = F.regexp_replace(F.upper(F.col(key)), "^H", "")
        entries = map_.entries().select(F.col("key").alias("_map_key"), F.col("value").alias("map_value"))
        batch.join(entries, own == F.col("_map_key"), "left").drop("_map_key").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
