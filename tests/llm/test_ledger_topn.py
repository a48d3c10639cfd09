import random

import pytest

from termloom.llm import ledger, topn


@pytest.mark.parametrize("n_batches", [1, 3, 7])
def test_seen_before_is_exact(spark, n_batches):
    r = random.Random(n_batches)
    keys = [r.choice([7, 7, 7, None, r.randint(0, 60)]) for _ in range(400)]
    orders = r.sample(range(10_000), 400)
    df = spark.createDataFrame([(k, o, "x", 1) for k, o in zip(keys, orders, strict=True)], "k long, o long, first_order string, key int")
    got = {row.o: row.seen for row in ledger.seen_before(df, "k", "o", n_batches, 4).collect()}
    known = set()
    for o, k in sorted(zip(orders, keys, strict=True)):
        assert got[o] == (k in known)
        if k is not None:
            known.add(k)
    assert len(got) == 400


def test_ledger_of_nothing(spark):
    df = spark.createDataFrame([], "k long, o long")
    assert ledger.seen_before(df, "k", "o").count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "k long, o long")
    assert [r.seen for r in ledger.seen_before(nulls, "k", "o", 2, 2).collect()] == [False, False]


def test_top_n_ties_nulls_and_repeats(spark):
    nan = float("nan")
    rows = [("a", 5, 1.0), ("a", 3, 1.0), ("a", 3, 0.5), ("a", 9, nan), ("a", 8, None), ("a", 4, 2.0), (None, 1, 3.0), ("b", 1, nan), ("c", 2, -1.0), ("c", 2, -1.0)]
    df = spark.createDataFrame(rows, "g string, i long, s double")
    assert sorted(map(tuple, topn.top_n(df, "g", "i", "s", 2).collect())) == [("a", 3, 1.0, 2), ("a", 4, 2.0, 1), ("c", 2, -1.0, 1)]
    assert topn.top_n(df.limit(0), "g", "i", "s", 2).count() == 0


def test_top_n_of_a_huge_group(spark):
    r = random.Random(1)
    rows = [("hot", i, float(r.randint(0, 50))) for i in range(6000)] + [(f"g{i % 40}", i, float(r.randint(0, 3))) for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for row in topn.top_n(spark.createDataFrame(rows, "g string, i long, s double").repartition(7), "g", "i", "s", 10).collect():
            got.setdefault(row.g, []).append((row.rnk, row.i))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in {x[0] for x in rows}:
        want = sorted(((-s, i) for gg, i, s in rows if gg == g))[:10]
        assert sorted(got[g]) == [(k + 1, i) for k, (_, i) in enumerate(want)]
