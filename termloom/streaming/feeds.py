"""Arriving article files as a stream: insert-if-absent by a keyed table, late and repeated rows included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_feed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def insert_ignore_stream(feed: DataFrame, key: str, order: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends to the Parquet folder ``target`` the first row (by ``order``) of every key it lacks, batch by batch.

    A batch that is repeated after a failure writes the same folder again, so keys stay unique. Null keys are left out.
    Each batch is one anti-join against the keys written before it.
    """

    def take_in(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c != key]
        firsts = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("__row"))
        rows = firsts.select(key, *[F.col("__row")[c].alias(c) for c in cols])
        jvm = spark.sparkContext._jvm
        home = jvm.org.apache.hadoop.fs.Path(target)
        if home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(home):
            old = spark.read.schema(batch.select(key).schema.add("batch", "long")).option("basePath", target).parquet(target).where(F.col("batch") != number)
            rows = rows.join(old.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return feed.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(feed: DataFrame, time: str, term: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """``start, term, n`` per window of event time; rows later than ``late`` behind the newest are dropped."""
    w = F.window(time, window)
    counted = feed.withWatermark(time, late).groupBy(w.alias("w"), F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w")["start"].alias("start"), "term", "n")
