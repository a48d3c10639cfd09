"""Average ranks over whole columns without a single-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import small, written

#: Values with more than one in so many rows are never shuffled to one task; there are fewer than this of them.
HOT_VALUES = 1000


def average_ranks(df: DataFrame, cols: list[str], digits: int = 9) -> DataFrame:
    """``df`` with ``rank_<col>``: average rank of ties divided by the number of rows, for each numeric column.

    Nulls get no rank and are not counted. Values are rounded to ``digits`` first, so that sums added up in another order
    tie as they should. Equal values are counted first; the distinct values are range-partitioned and sorted, counts of whole
    partitions are prefix-summed (as many rows as partitions), then counts within each: no task sees a whole column. Ranks of
    few distinct values (counted) are broadcast to the rows; of many, only those of values that hold more than one in
    ``HOT_VALUES`` of the rows are, and the others joined by a shuffle, so a value in a third of all rows causes no skew.
    """
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.round(F.col(c).cast("double"), digits).alias("x")) for c in cols])).alias("s")).select("s.*").where(F.col("x").isNotNull())
    counts = flat.groupBy("c", "x").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("c", "x").withColumn("part", F.spark_partition_id())
    counts = written(counts, "rank-counts")
    parts = counts.groupBy("c", "part").agg(F.sum("n").alias("n_part"))
    ahead = Window.partitionBy("c").orderBy("part")
    parts = parts.withColumn("ahead", F.sum("n_part").over(ahead) - F.col("n_part")).withColumn("n_all", F.sum("n_part").over(Window.partitionBy("c")))
    inside = Window.partitionBy("c", "part").orderBy("x")
    upto = counts.withColumn("upto", F.sum("n").over(inside)).join(parts, ["c", "part"])
    rank = (F.col("ahead") + F.col("upto") - F.col("n") + (F.col("n").cast("double") + 1.0) / 2.0) / F.col("n_all")
    ranks = upto.select("c", "x", rank.alias("r"), (F.col("n") * HOT_VALUES > F.col("n_all")).alias("hot"))
    distinct = {r["c"]: r["count"] for r in counts.groupBy("c").count().collect()}  # one row per column

    def add(d: DataFrame, c: str) -> DataFrame:
        r = ranks.where(F.col("c") == c).select(F.col("x").alias("__x"), F.col("r").alias(f"rank_{c}"), "hot")
        at = F.round(F.col(c).cast("double"), digits) == F.col("__x")
        if small(r, distinct.get(c, 0)):
            return d.join(F.broadcast(r), at, "left").drop("__x", "hot")
        marked = d.join(F.broadcast(r.where("hot")), at, "left").drop("__x")
        done, rest = marked.where(F.col("hot")), marked.where(F.col("hot").isNull()).drop("hot", f"rank_{c}")
        return done.drop("hot").unionByName(rest.join(r.where(~F.col("hot")), at, "left").drop("__x", "hot"))

    return reduce(add, cols, df)
