"""How often every distinct term occurs, and in how many records: recursive radix partitioning on disk, then DuckDB."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import maybe_broadcast, scratch, written

#: Rows of a partial table a task holds before it adds them up; least digit width in bits; rows of a partition that one DuckDB
#: process aggregates (beyond that the next hash digit splits it), where it can spill and where it cannot; memory of that process.
HELD_ROWS, RADIX_BITS, PART_ROWS, PART_ROWS_IN_MEMORY, DUCKDB_MEMORY = 500_000, 5, 4_000_000, 500_000, "512MB"
#: Bits of the hash that may be used up, and partitions of the first level at most (as a power of two).
MAX_BITS, MAX_FIRST_BITS = 60, 12
PARTIAL = "grp string, term string, occurrences bigint, records bigint, weight double"


def partial_counts(df: DataFrame, group: str, terms: str, weight: str | None) -> DataFrame:
    """Per task: ``(grp, term, occurrences, records, weight)`` of the lists ``terms``, added up before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0

        def fold(tables: list[pa.Table]) -> pa.Table:
            t = pa.concat_tables(tables).group_by(["grp", "term"]).aggregate([("occurrences", "sum"), ("records", "sum"), ("weight", "sum")])
            return t.rename_columns(["grp", "term", "occurrences", "records", "weight"])

        for batch in batches:
            lists = batch.column(1)
            parent = pc.list_parent_indices(lists)
            flat = lists.flatten()
            if not len(flat):
                continue
            w = batch.column(2).cast(pa.float64()).take(parent) if weight else pa.array(np.zeros(len(flat)))
            one = pa.table({"row": parent, "grp": batch.column(0).take(parent), "term": flat, "weight": w})
            one = one.filter(pc.is_valid(one["term"]))
            per_row = one.group_by(["row", "grp", "term"]).aggregate([([], "count_all"), ("weight", "sum")])
            per_row = per_row.append_column("one", pa.array(np.ones(len(per_row), np.int64)))
            t = per_row.group_by(["grp", "term"]).aggregate([("count_all", "sum"), ("one", "sum"), ("weight_sum", "sum")])
            held.append(t.rename_columns(["grp", "term", "occurrences", "records", "weight"]))
            n += len(t)
            if n >= HELD_ROWS:
                t = fold(held)
                held, n = [t], len(t)
                if n >= HELD_ROWS // 2:
                    yield from t.combine_chunks().to_batches(max_chunksize=20_000)
                    held, n = [], 0
        if held:
            yield from fold(held).combine_chunks().to_batches(max_chunksize=20_000)

    return df.select(group, terms, *([weight] if weight else [])).mapInArrow(run, PARTIAL)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a folder that all executors reach."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def _aggregate_with_duckdb(paths: DataFrame, temp: str) -> DataFrame:
    """Adds up each partition folder in its own DuckDB process, out of core below ``temp`` when memory runs short.

    Spilling needs a shared folder that is mounted; elsewhere partitions are split until they fit in memory.
    """
    shared = filesystem(temp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import duckdb
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = filesystem(path)
                con = duckdb.connect()
                con.execute(f"SET memory_limit='{DUCKDB_MEMORY}'")
                con.execute("SET threads=1")
                con.execute("SET preserve_insertion_order=false")
                con.execute("SET temp_directory=''")  # nothing below a folder of this machine alone
                if isinstance(shared[0], fs.LocalFileSystem):
                    os.makedirs(shared[1], exist_ok=True)
                    con.execute(f"SET temp_directory='{tempfile.mkdtemp(dir=shared[1])}'")
                con.register("part", ds.dataset(at, filesystem=files, format="parquet", exclude_invalid_files=False))
                got = con.sql("SELECT grp, term, sum(occurrences)::BIGINT occurrences, sum(records)::BIGINT records, sum(weight)::DOUBLE weight FROM part GROUP BY grp, term")
                yield from got.to_arrow_reader(20_000)
                con.close()

    return paths.mapInArrow(run, PARTIAL)


def term_frequencies(df: DataFrame, group: str, terms: str, weight: str | None = None, part_rows: int | None = None) -> DataFrame:
    """``(grp, term, occurrences, records, weight)`` for every distinct term of the lists in ``terms``, per ``group``.

    ``occurrences`` counts every listing, ``records`` the rows that list the term, ``weight`` adds the row's weight (null
    counts 0) once per listing. Null lists, empty lists and null terms count nothing; empty input gives no row.

    Rows are added up in the task that reads them, so a term in a third of all rows is one row per task from there on. The
    partial counts are partitioned on disk by the low bits of their hash, one task per partition (at least as many as shuffle
    partitions); all partitions above ``part_rows`` are split again by the next bits in one job, as often as needed; each
    partition is then aggregated out of core by one DuckDB process. Sizes and paths of partitions stay in tables.
    """
    from pyarrow import fs

    spark = df.sparkSession
    root = scratch(spark, "radix")
    spills = isinstance(filesystem(f"{root}/duckdb")[0], fs.LocalFileSystem)
    limit = part_rows or (PART_ROWS if spills else PART_ROWS_IN_MEMORY)
    bits = min(MAX_FIRST_BITS, max(RADIX_BITS, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    low_bits = lambda n: F.xxhash64("grp", "term").bitwiseAND(F.lit((1 << n) - 1))
    spread = partial_counts(df, group, terms, weight).withColumn("part", low_bits(bits)).repartitionById(1 << bits, F.col("part").cast("int"))
    done = None
    while True:
        at = f"{root}/bits{bits}"
        spread.write.partitionBy("part").parquet(at)
        back = spark.read.schema(spread.schema).parquet(at)
        sizes = written(back.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "radix-sizes")
        split = (F.col("n") > limit) if bits + RADIX_BITS <= MAX_BITS else F.lit(False)
        small = sizes.where(~split).select(F.concat(F.lit(f"{at}/part="), F.col("part").cast("string")).alias("path"))
        done = small if done is None else done.unionByName(small)
        large = sizes.where(split).select("part")
        n_large = large.count()
        if not n_large:
            break
        bits += RADIX_BITS
        again = back.join(maybe_broadcast(large, n_large), "part", "left_semi").withColumn("part", low_bits(bits))
        spread = again.select(*[c for c in spread.columns]).repartition("part")
    n_done = done.count()
    if not n_done:
        return spark.createDataFrame([], PARTIAL)
    return _aggregate_with_duckdb(done.repartition(n_done), f"{root}/duckdb")
