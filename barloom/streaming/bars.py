"""Incremental versions of the two tables that are refreshed while the market is open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import work_path
from barloom.sources.ticks import tick_rank

# Bar units and their window lengths.
WINDOWS = {"MINUTE": "1 minute", "HOUR": "1 hour", "DAY": "1 day"}


def tick_stream(spark: SparkSession, folder: str, file_glob: str, schema) -> DataFrame:
    """Ticks from Parquet files as they arrive; event time needs a zoned type, so zone-free times are cast."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(ticks: DataFrame, *, symbol: str, price: str, tick_id: str, unit: str, late: str = "1 hour") -> DataFrame:
    """Tumbling bars; a bar is final once the watermark has passed its end."""
    order = tick_rank(ticks, ["ts", tick_id])
    bars = (
        ticks.withWatermark("ts", late)
        .groupBy(F.col(symbol).alias("symbol"), F.window("ts", WINDOWS[unit]).alias("w"))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def run_to_table(stream: DataFrame, label: str) -> str:
    """Drain what is there into a Parquet table (exactly once, by checkpoint) and return its path."""
    spark = stream.sparkSession
    path = work_path(spark, label)
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{path}/table"


def stream_latest(ticks: DataFrame, *, symbol: str, price: str, tick_id: str) -> DataFrame:
    """Newest price per symbol; the state is one row per symbol."""
    return ticks.groupBy(F.col(symbol).alias("symbol")).agg(
        F.max_by(price, tick_rank(ticks, ["ts", tick_id])).alias("latest_price"), F.max("ts").cast("timestamp_ntz").alias("ts")
    )


def run_latest(stream: DataFrame, label: str) -> str:
    """Write the changed symbols of each batch under its batch number, so a repeated batch replaces itself."""
    spark = stream.sparkSession
    path = work_path(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(keep).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{path}/table"


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each symbol over all batches."""
    return spark.read.parquet(path).groupBy("symbol").agg(
        F.max_by("latest_price", "batch").alias("latest_price"), F.max_by("ts", "batch").alias("ts")
    )
