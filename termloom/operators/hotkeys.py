"""Per-key results when a handful of keys hold most rows: map-side combining of algebraic states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """``cols`` with redelivered rows counted once by ``id_col``.

    A row without id counts as itself. Redelivered rows are equal in ``cols``; where they are not, each differing version
    stays. Grouping on the ids and the values themselves keeps the plan at hash aggregates, combined before the shuffle.
    """
    both = list(dict.fromkeys([id_col, *cols]))
    known = df.where(F.col(id_col).isNotNull()).select(*both).distinct()
    return known.unionByName(df.where(F.col(id_col).isNull()).select(*both)).select(*cols)


def combine_by_key(df: DataFrame, key: Column, values: dict[str, Column], key_name: str = "key") -> DataFrame:
    """Per key: rows, and for each named value its count, sum, least, greatest, mean and variance.

    Only algebraic aggregates are used, so every task folds its rows into one small state per key (hash table, spilling)
    and the shuffle carries at most one state per key and task: a key with a third of all rows costs no more than others.
    Rows without key are left out; null values are ignored and give null statistics when nothing else is there.
    """
    cols = {f"__v{i}": v for i, v in enumerate(values.values())}
    flat = df.select(key.alias(key_name), *[v.alias(c) for c, v in cols.items()])
    named = dict(zip(values, (F.col(c) for c in cols), strict=True))
    aggs = [F.count(key_name).alias("n_rows")]  # 0 for the null key, which so drops out without working out the key twice
    for name, v in named.items():
        d = v.cast("double")
        aggs += [F.count(d).alias(f"{name}_n"), F.sum(d).alias(f"{name}_sum"), F.min(d).alias(f"{name}_min"), F.max(d).alias(f"{name}_max"), F.avg(d).alias(f"{name}_mean"), F.var_pop(d).alias(f"{name}_var")]
    return flat.groupBy(key_name).agg(*aggs).where(F.col("n_rows") > 0)


def heavy_keys(df: DataFrame, key: Column, one_in: int, key_name: str = "key") -> DataFrame:
    """Keys with at least one in ``one_in`` of all rows that have a key: (key, n_rows). Empty input gives no row.

    The total is an uncorrelated scalar subquery over the per-key counts, not over the rows.
    """
    counts = combine_by_key(df, key, {}, key_name)
    total = counts.agg(F.sum("n_rows"))
    return counts.where(F.col("n_rows") * one_in >= total.scalar())
