import math
import random
import struct
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import cooccurrence, frequency, quantiles


def bits(x):
    b = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return ~b if x < 0 else b


def test_ordered_bits(spark):
    xs = [0.0, 1.0, 1.5, 0.1, 3.14159, 2**53 + 0.0, 1e308, 1.7976931348623157e308, 5e-324, 2.2250738585072014e-308, 1e-310, 8.0, 7.999999999999999, float("inf"), -0.1, -5e-324, -1e300]
    xs += [random.Random(4).uniform(-1e6, 1e6) * 10 ** random.Random(i).randint(-30, 30) for i in range(200)]
    b = quantiles.ordered_bits(F.col("x"))
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", b.alias("b"), quantiles.bits_to_double(b).alias("y")).collect()
    assert [r.b for r in got] == [bits(x) for x in xs] and [r.y for r in got] == xs
    assert sorted(xs) == [r.x for r in sorted(got, key=lambda r: r.b)]
    odd = spark.createDataFrame([(None,), (float("nan"),), (-0.0,)], "x double").select(b.alias("b")).collect()
    assert [r.b for r in odd] == [None, None, 0]


@pytest.mark.parametrize("broadcast", [True, False])
def test_radix_select(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(quantiles, "maybe_broadcast", lambda df, n: df)
    r = random.Random(2)
    groups = {"hot": [r.lognormvariate(2, 2) for _ in range(900)], "ties": [3.0] * 50, "one": [7.5], "two": [1.0, 2.0], "neg": [-r.random() for _ in range(31)] + [r.random() for _ in range(30)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("hot", None), ("hot", float("nan")), ("none", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit(1))
    got = {(x.g, x.pct): x.value for x in quantiles.radix_select(df, ["g"], "v", [50, 90, 99]).collect()}
    want = {(g, p): float(np.percentile(xs, p)) for g, xs in {**groups, None: [4.0]}.items() for p in (50, 90, 99)}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert quantiles.radix_select(df.limit(0), ["g"], "v", [50]).count() == 0


def test_sketches_merge_within_their_bound(spark):
    r = random.Random(3)
    rows = [(d, "g", r.lognormvariate(1, 3)) for d in range(5) for _ in range(300)] + [(0, "z", 0.0)] * 3
    df = spark.createDataFrame(rows, "d int, g string, v double")
    daily = quantiles.sketch(df, ["d", "g"], "v")
    got = {(x.g, x.pct): x.value for x in quantiles.sketch_percentiles(quantiles.merged(daily, ["g"]), ["g"], [50, 90, 99]).collect()}
    exact = {(x.g, x.pct): x.value for x in quantiles.radix_select(df, ["g"], "v", [50, 90, 99]).collect()}
    assert set(got) == set(exact)
    for k, v in exact.items():
        assert got[k] == pytest.approx(v, rel=quantiles.SKETCH_ERROR * 1.0001)


def records():
    r = random.Random(5)
    return [sorted(r.sample("abcdefghijklé", r.randint(0, 6))) for _ in range(300)] + [["a", "b"]] * 150


def test_pair_statistics(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "HELD_PAIRS", 50)
    recs = records()
    df = spark.createDataFrame([(x,) for x in [*recs, None]], "items array<string>").withColumn("counts", F.lit(1)).repartition(3)
    got = {(r.term_a, r.term_b): r for r in cooccurrence.pair_statistics(df, "items").collect()}
    pairs, single, n = Counter(p for x in recs for p in combinations(x, 2)), Counter(w for x in recs for w in x), sum(bool(x) for x in recs)
    assert {k: r.n_ab for k, r in got.items()} == dict(pairs)
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n) == (single[a], single[b], n)
        cells = [(r.n_ab, r.n_a * r.n_b), (r.n_a - r.n_ab, r.n_a * (n - r.n_b)), (r.n_b - r.n_ab, (n - r.n_a) * r.n_b), (n - r.n_a - r.n_b + r.n_ab, (n - r.n_a) * (n - r.n_b))]
        assert r.llr == pytest.approx(2 * sum(o * math.log(o * n / e) for o, e in cells if o), abs=1e-6)
        assert r.lift == pytest.approx(r.n_ab * n / (r.n_a * r.n_b))
    assert cooccurrence.pair_statistics(df.limit(0), "items").count() == 0


def test_a_very_long_record(spark):
    items = sorted(f"t{i:05d}" for i in range(2100))
    df = spark.createDataFrame([(items,), (items[:2],)], "items array<string>")
    top = cooccurrence.pair_statistics(df, "items", min_pairs=2).collect()
    assert [(r.term_a, r.term_b, r.n_ab) for r in top] == [(items[0], items[1], 2)]


@pytest.mark.parametrize("part_rows", [4_000_000, 20])
def test_term_frequencies(spark, part_rows):
    r = random.Random(6)
    rows = [("m", [r.choice(["hot", f"t{r.randint(0, 90)}", "é", None]) for _ in range(r.randint(0, 5))], float(i % 3)) for i in range(500)]
    rows += [("s", ["hot"], 2.0)] * 200 + [("s", None, 1.0), ("s", [], 1.0), ("s", ["hot"], None)]
    df = spark.createDataFrame(rows, "grp string, ts array<string>, w double").withColumn("term", F.lit("clash")).repartition(5)
    occ, rec, weight = Counter(), Counter(), Counter()
    for g, ts, w in rows:
        for t in ts or []:
            if t is not None:
                occ[g, t] += 1
                weight[g, t] += w or 0.0
        rec.update((g, t) for t in set(ts or []) if t is not None)
    got = frequency.term_frequencies(df, "grp", "ts", "w", part_rows).collect()
    assert {(x.grp, x.term): (x.occurrences, x.records, x.weight) for x in got} == {k: (occ[k], rec[k], weight[k]) for k in occ}
    assert len(got) == len(occ)


def test_frequencies_of_nothing(spark):
    assert frequency.term_frequencies(spark.createDataFrame([], "g string, ts array<string>"), "g", "ts").count() == 0
