"""Panel steps from records that arrive over time, late ones included.

Records are summed by cell and day as a stream. Each micro-batch writes the sums that it changed,
with its number, so a rerun batch overwrites its own part; the last number of a step is its value.
State is dropped once the watermark has passed a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def daily_sums(records: DataFrame, time: str, key: str, value: str, late: str = "2 days") -> DataFrame:
    """(key, time, value in cents, n) by day, of a stream or a table."""
    stream = records.withWatermark(time, late) if records.isStreaming else records
    sums = stream.groupBy(F.window(time, "1 day").alias("_w"), key).agg(F.sum(F.round(F.col(value) * 100).cast("long")).alias("value"), F.count("*").alias("n"))
    return sums.select(key, F.to_date("_w.start").alias("time"), "value", "n")


def run_to_end(sums: DataFrame, path: str) -> None:
    """Feeds what has arrived by now through the stream; ``path`` holds the changed steps of each batch and the checkpoint."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/steps/batch={number}")

    sums.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """The steps as of the last batch that changed them."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))
    return spark.read.parquet(f"{path}/steps").withColumn("_last", last).where("_last = 1").drop("_last", "batch")
