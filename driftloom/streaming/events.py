"""Events as they arrive. No state crosses events, so a batch query serves each micro-batch; late and repeated rows are dropped within a watermark where asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery



def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_per_key(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows whose key came before within ``late`` are dropped."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts per tumbling window and ``by``; a window is final once the watermark passed it."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def run_per_batch(rows: DataFrame, work: Callable[[DataFrame], DataFrame], root: str, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies a batch query to each micro-batch and writes its rows under ``batch_id``; a batch that is run again replaces its own rows, so each counts once."""

    def one(batch: DataFrame, n: int) -> None:
        work(batch).withColumn("batch_id", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/{name}")

    w = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


