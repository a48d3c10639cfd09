"""Tables numbered by position and kept on files of the shared folder, from which tasks read columns as arrays.

What one task must hold whole (an adjacency, the terms of a chain) goes from these files into the task; the driver sees counts only.
"""

from __future__ import annotations

from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import forget, scratch, written

#: Bits of the row number in ``monotonically_increasing_id``; those above are the partition.
_ROW_BITS = 33


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path for :func:`columns`."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, str]:
    """``df`` with ``at``, the position from 0 when sorted by ``order`` (no two rows alike), and the path of its files.

    Rows are sorted over range partitions and numbered by prefix sums of the partitions' counts; no task sees them all.
    """
    place = F.monotonically_increasing_id()
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place), f"{name}-placed")
    part = F.shiftright("__place", _ROW_BITS)
    base, total = [], 0
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):  # one row per partition
        base.append((r["p"], total))
        total += r["n"]
    before = df.sparkSession.createDataFrame(base, "__part long, __before long")
    at = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    out = stored(placed.withColumn("__part", part).join(F.broadcast(before), "__part").select(*df.columns, at.alias("at")), name)
    forget(placed)
    return out


def columns(path: str, names: list[str]) -> list[np.ndarray]:
    """Whole columns of a stored table of at least one row, in any order of the rows but the same for all; for use in tasks."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        files, at = fs.LocalFileSystem(), urlparse(path).path
    else:
        files, at = fs.FileSystem.from_uri(path)
    got = ds.dataset(at, filesystem=files, format="parquet").to_table(columns=names, use_threads=False)
    return [got.column(x).to_numpy() for x in names]
