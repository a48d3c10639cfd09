"""Tables as header CSV: reading with a schema, writing, and persisted vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, null: str = "") -> DataFrame:
    """A header CSV; values with commas, quotes and line breaks stand in double quotes, a quote in them is doubled.

    ``null`` is what stands for null; by default every empty value is null.
    """
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", null).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, null: str = "") -> None:
    """A folder of header CSV; null is written as ``null``, an empty text as a quoted one."""
    df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').option("emptyValue", '""').option("nullValue", null).csv(path)


def write_stop_words(stop: DataFrame, missing: DataFrame, path: str) -> None:
    """The stop words ``term, category`` and the orphans ``term``, by category in sorted order, one folder per category.

    Orphans get the category ``Missing``.
    """
    both = stop.select("term", "category").unionByName(missing.select("term", F.lit("Missing").alias("category")))
    both.distinct().repartition("category").sortWithinPartitions("category", "term").write.mode("overwrite").partitionBy("category").parquet(path)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, category string").parquet(path)


def write_scores(scores: DataFrame, path: str, key: str = "pmid") -> None:
    """Scores replaced as a whole, range-partitioned and sorted by key: a look-up by key reads few row groups."""
    scores.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
