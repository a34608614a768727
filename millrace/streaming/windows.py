"""Windowed statistics and first-behaviour filters over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.timeline import window_statistics


def stream_statistics(samples: DataFrame, ts: str, late: str = "10 minutes", width: str = "2 minutes", least: int = 10) -> DataFrame:
    """Window statistics of a stream of samples; rows later than the watermark are dropped by Spark, as asked."""
    return window_statistics(samples.withWatermark(ts, late), ts, width, least)


def stream_first_of(df: DataFrame, signature: Column, ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each signature within the watermark."""
    return df.withColumn("signature", signature).withWatermark(ts, late).dropDuplicatesWithinWatermark(["signature"])


def upsert_sink(path: str, key: str, updated: str):
    """A foreachBatch function that keeps one Parquet version of the state a micro-batch: ``path/version=<id>``; an
    epoch that is repeated writes the same version again, so the state is exactly-once."""

    def write(batch: DataFrame, epoch: int) -> None:
        from pyspark.sql import Window as W

        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        before = f"{path}/version={epoch - 1}"
        if epoch > 0 and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(before)):
            batch = batch.unionByName(spark.read.parquet(before).select(*batch.columns))
        w = W.partitionBy(key).orderBy(F.desc(updated))
        batch.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return write
