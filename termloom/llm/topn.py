"""The N best items within every group, from one global sort and prefix sums of counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.session import written


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, rank_name: str = "rnk") -> DataFrame:
    """``group, item, score`` and the position from 1 of the first ``n`` items of each group: higher score, then smaller item.

    Each item counts once per group, with its highest score that is neither null nor NaN; rows without group or item are
    left out. All rows are range-partitioned on (group, score, item) and sorted, so a group of any size is spread over as
    many partitions as it needs. Each partition numbers its rows within the group and keeps those up to ``n`` (a row further
    down cannot rank higher overall); the counts of the partitions before it, summed per group, turn the local number into
    the exact position. Counts above ``n`` need not be exact, as they put every later row beyond ``n``.
    """
    s = F.col(score).cast("double")
    best = df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & s.isNotNull() & ~F.isnan(s)).groupBy(group, item).agg(F.max(s).alias(score))
    placed = best.repartitionByRange(F.col(group).asc(), F.col(score).desc(), F.col(item).asc())
    placed = placed.sortWithinPartitions(F.col(group).asc(), F.col(score).desc(), F.col(item).asc())
    schema = T.StructType([*placed.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__local", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0)
            at = np.arange(batch.num_rows)
            new = np.concatenate([[True], (g.slice(1).to_numpy(zero_copy_only=False) != g.slice(0, batch.num_rows - 1).to_numpy(zero_copy_only=False))])
            start = np.maximum.accumulate(np.where(new, at, 0))
            local = at - start + 1
            if g[0].as_py() == last:
                local[start == 0] += seen
            last, seen = g[-1].as_py(), int(local[-1])
            keep = pa.array(local <= n)
            cols = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(local.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema]).filter(keep)

    kept = written(placed.mapInArrow(number, schema), "topn")
    counts = kept.groupBy(group, "__part").agg(F.max("__local").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where(F.col("__before") < n).drop("__n")
    out = kept.join(counts, [group, "__part"]).withColumn(rank_name, (F.col("__before") + F.col("__local")).cast("int"))
    return out.where(F.col(rank_name) <= n).select(group, item, score, rank_name)
