"""The ledger outlives its object: reopened paths, other key types, repeated batches, compaction, hot keys."""

import pytest
from pyspark.sql import functions as F

from termloom.llm import ledger


def answers(df, *cols):
    return sorted(tuple(r[c] for c in (*cols, "seen")) for r in df.collect())


def test_a_reopened_ledger_knows_its_keys(spark, tmp_path):
    at = f"file://{tmp_path}/l"
    one = ledger.KeyLedger(spark, at, 4)
    assert answers(one.absorb(spark.createDataFrame([(1, 1), (2, 2)], "k long, o long"), "k", "o"), "k") == [(1, False), (2, False)]
    one.drop()
    two = ledger.KeyLedger(spark, at)
    assert two.buckets == 4
    assert answers(two.absorb(spark.createDataFrame([(1, 3), (3, 4)], "k long, o long"), "k", "o"), "k") == [(1, True), (3, False)]
    day3 = spark.createDataFrame([(3, 9), (5, 10)], "k long, o long")
    assert answers(ledger.seen_before(day3, "k", "o", 2, path=at), "k") == [(3, True), (5, False)]


def test_text_keys_and_types(spark):
    one = ledger.KeyLedger(spark, buckets=2)
    batch = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("a", "z", 2), (None, "w", 3)], "k string, note string, o int")
    assert answers(one.absorb(batch, "k", "o"), "note") == [("w", False), ("x", False), ("y", False), ("z", True)]
    with pytest.raises(TypeError):
        one.absorb(spark.createDataFrame([(1, 2)], "k long, o int"), "k", "o")
    with pytest.raises(ValueError):
        one.absorb(batch.withColumn("seen", F.lit(1)), "k", "o")


def test_two_keys_with_one_order_number(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 2)], "k string, o long")
    assert answers(ledger.seen_before(rows, "k", "o", 1, 2), "k", "o") == [("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, True)]


def test_a_repeated_batch_changes_nothing(spark):
    one = ledger.KeyLedger(spark, buckets=2)
    batch = spark.createDataFrame([(1, 1), (2, 2), (1, 3)], "k long, o long")
    first = answers(one.absorb(batch, "k", "o"), "k", "o")
    assert answers(one.absorb(batch, "k", "o"), "k", "o") == first == [(1, 1, False), (1, 3, True), (2, 2, False)]
    assert one.keys().count() == 2


def test_compaction_keeps_every_key(spark, tmp_path):
    one = ledger.KeyLedger(spark, f"file://{tmp_path}/l", 2)
    for day in range(ledger.FILES_PER_BUCKET + 2):
        batch = spark.createDataFrame([(day, 2 * day), (0, 2 * day + 1)], "k long, o long")
        assert answers(one.absorb(batch, "k", "o"), "o") == [(2 * day, False), (2 * day + 1, True)]
    assert one.meta["generation"] > 0 and one.keys().count() == ledger.FILES_PER_BUCKET + 2
    assert sum(1 for p in (tmp_path / "l" / f"g{one.meta['generation']}").glob("*.parquet")) <= 2 * one.meta["appends"]


def test_a_key_with_a_third_of_all_rows(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"))
    assert ledger.hot_keys(rows.agg(*ledger.sketch("k")).first())
    got = ledger.seen_before(rows, "k", "o", 3, 4)
    assert got.where("seen").count() == 9_999 and got.where("seen and k <> -1").count() == 0 and got.count() == 30_000
