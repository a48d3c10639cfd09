import pytest

from termloom.llm import ledger


@pytest.mark.parametrize("n_batches", [1, 4])
def test_rows_without_an_order_stay_and_are_not_seen(spark, n_batches):
    rows = [(i % 5, i) for i in range(20)] + [(1, None), (77, None), (None, None)]
    got = ledger.seen_before(spark.createDataFrame(rows, "k long, no long"), "k", "no", n_batches, 2).collect()
    want = [(k, no, no is not None and no >= 5) for k, no in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
