"""Percentiles of very large numeric columns: radix selection on order-preserving integers, and mergeable histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import maybe_broadcast, written

DIGITS = (16, 16, 16, 16)
#: Leading bits of the mergeable histogram: sign, 11 of the exponent and 8 of the fraction.
SKETCH_BITS = 20
SKETCH_ERROR = 2.0**-9


def ordered_bits(x: Column) -> Column:
    """The 64 bits of a double as a signed integer in the order of the values; -0.0 counts as 0.0. Null and NaN give null.

    Spark has no bit cast for doubles: exponent and fraction are taken apart by exact powers of two, all inside codegen.
    """
    x = x.cast("double")
    mag = F.abs(x)
    guess = F.floor(F.log2(mag)).cast("int")
    two = F.lit(2.0)
    exp = guess - F.when(F.pow(two, guess.cast("double")) > mag, 1).otherwise(0) + F.when(F.pow(two, (guess + 1).cast("double")) <= mag, 1).otherwise(0)
    fraction = ((mag / F.pow(two, exp.cast("double")) - 1.0) * float(2**52)).cast("bigint")
    normal = F.shiftleft((exp + 1023).cast("bigint"), 52) + fraction
    tiny = (mag * float(2.0**537) * float(2.0**537)).cast("bigint")
    infinite = F.lit(0x7FF0000000000000)
    bits = F.when(mag == 0.0, F.lit(0).cast("bigint")).when(mag > 1.7976931348623157e308, infinite).when(mag < 2.2250738585072014e-308, tiny).otherwise(normal)
    return F.when(x.isNull() | F.isnan(x), None).otherwise(F.when(x < 0, F.bitwise_not(bits)).otherwise(bits))


def bits_to_double(b: Column) -> Column:
    """The value of an integer made by :func:`ordered_bits`."""
    mag = F.when(b < 0, F.bitwise_not(b)).otherwise(b)
    exp = F.shiftright(mag, 52)
    frac = mag.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(2**52)
    normal = (frac + 1.0) * F.pow(F.lit(2.0), (exp - 1023).cast("double"))
    tiny = frac * float(2.0**-1022)
    value = F.when(exp == 2047, F.lit(float("inf"))).when(exp == 0, tiny).otherwise(normal)
    return F.when(b < 0, -value).otherwise(value)


def radix_select(df: DataFrame, groups: list[str], value: str, pcts: list[int]) -> DataFrame:
    """``groups``, ``pct`` and ``value``: exact percentiles per group, interpolated linearly between the two nearest ranks.

    Values become order-preserving integers; digit by digit (``DIGITS`` bits) a histogram per group, with the least and the
    greatest value of every digit, tells the digit in which each wanted rank lies. A digit that holds one value only settles
    its ranks at once (so do integers, mostly after one or two digits). Rows below the other digits are written and are all that
    the next digit reads. Every histogram is a count per (group, digit), combined map-side: a group with a third of all rows
    costs one state per task and digit. Hashes of the wanted prefixes (at most two per group and percentile) are broadcast when
    counted small, else joined by a salted shuffle. Null and NaN values are ignored; a group without values gives no row.
    ``df`` must not have columns named ``pct``, ``bits``, ``rank``, ``prefix`` or ``digit``.
    """
    data = written(df.select(*groups, ordered_bits(F.col(value)).alias("bits")).where(F.col("bits").isNotNull()), "radix-values")
    settled: list[DataFrame] = []
    wanted, shift = None, 64
    for width in DIGITS:
        shift -= width
        if wanted is None:
            hist = _histogram(data, groups, F.shiftright("bits", shift))
            wanted, keys = _wanted_ranks(hist, groups, pcts), groups
        else:
            above = F.shiftright("bits", shift + width)
            data = written(_rows_below(data.withColumn("prefix", above), wanted, [*groups, "prefix"]).drop("prefix"), f"radix-rows-{shift}")
            keys = [*groups, "prefix"]
            hist = _histogram(data.withColumn("prefix", above), keys, F.shiftright("bits", shift).bitwiseAND(F.lit((1 << width) - 1)))
        w = Window.partitionBy(*keys).orderBy("digit")
        hist = hist.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
        h = hist.select(*[F.col(k).alias(f"h_{k}") for k in keys], "digit", "before", "upto", "least", "greatest")
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"h_{k}")) for k in keys]) & (F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("upto"))
        new = F.col("digit") if shift + width == 64 else F.shiftleft("prefix", width).bitwiseOR(F.col("digit"))
        found = wanted.join(h, on).select(*groups, "pct", "at", "rank", new.alias("prefix"), (F.col("rest") - F.col("before")).alias("rest"), "least", "greatest")
        found = written(found, f"radix-{shift}")
        settled.append(found.where(F.col("least") == F.col("greatest")))
        wanted = found.where(F.col("least") < F.col("greatest")).drop("least", "greatest")
        if wanted.isEmpty():
            break
    done = reduce(DataFrame.unionByName, settled)
    v = bits_to_double(F.col("least"))
    low = F.min_by(v, F.col("rank"))
    high = F.max_by(v, F.col("rank"))
    part = F.max("at") - F.min("rank")
    out = done.groupBy(*groups, "pct").agg(low.alias("lo"), high.alias("hi"), part.alias("part"))
    return out.select(*groups, "pct", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))


def _histogram(rows: DataFrame, keys: list[str], digit: Column) -> DataFrame:
    """Count, least and greatest value per key and digit."""
    return rows.groupBy(*keys, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min("bits").alias("least"), F.max("bits").alias("greatest"))


def _wanted_ranks(hist: DataFrame, groups: list[str], pcts: list[int]) -> DataFrame:
    """Per group and percentile its place ``at`` and the one or two ranks beside it; ``rest`` counts down within the prefix."""
    total = hist.groupBy(*groups).agg(F.sum("n").alias("n_all"))
    place = [F.struct(F.lit(p).alias("pct"), (F.lit(p) * (F.col("n_all") - 1) / F.lit(100.0)).alias("at")) for p in pcts]
    ranks = F.array_distinct(F.array(F.floor("q.at").cast("bigint"), F.ceil("q.at").cast("bigint")))
    flat = total.withColumn("q", F.explode(F.array(*place)))
    return flat.select(*groups, F.col("q.pct").alias("pct"), F.col("q.at").alias("at"), F.explode(ranks).alias("rank")).withColumn("rest", F.col("rank"))


def _rows_below(rows: DataFrame, alive: DataFrame, names: list[str]) -> DataFrame:
    """The rows whose (group, prefix) is wanted.

    Only 64-bit hashes of the wanted pairs are sent to the rows: eight bytes each, whatever the groups' texts. A row let
    through by a collision does no harm, as its histogram meets no wanted rank.
    """
    wanted = written(alive.select(F.xxhash64(*names).alias("alive")).distinct(), "alive")
    side = maybe_broadcast(wanted, wanted.count())
    hashed = rows.withColumn("hash", F.xxhash64(*names))
    if side is wanted:  # too many: salt the rows and repeat the hashes
        salts = 16
        hashed = hashed.withColumn("hash", F.xxhash64("hash", F.pmod(F.monotonically_increasing_id(), F.lit(salts))))
        side = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))).select(F.xxhash64("alive", "salt").alias("alive"))
    return hashed.join(side, F.col("hash") == F.col("alive"), "left_semi").drop("hash")


def sketch(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Mergeable histogram ``groups, cell, n``: values counted by the leading ``SKETCH_BITS`` of their ordered bits."""
    cell = F.shiftright(ordered_bits(F.col(value)), 64 - SKETCH_BITS)
    return df.select(*groups, cell.alias("cell")).where(F.col("cell").isNotNull()).groupBy(*groups, "cell").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Histograms of several days, partitions or deliveries as one: counts add."""
    return sketches.groupBy(*groups, "cell").agg(F.sum("n").alias("n"))


def sketch_percentiles(sketches: DataFrame, groups: list[str], pcts: list[int]) -> DataFrame:
    """``groups, pct, value``: from one merged histogram per group, interpolated as in :func:`radix_select`.

    Each of the two ranks is off by at most ``SKETCH_ERROR`` of its value (the middle of its cell), so is the result for
    values of one sign; counts are exact.
    """
    w = Window.partitionBy(*groups).orderBy("cell")
    cum = sketches.withColumn("upto", F.sum("n").over(w))
    cum = cum.withColumn("before", F.col("upto") - F.col("n")).withColumn("n_all", F.sum("n").over(Window.partitionBy(*groups)))
    low = bits_to_double(F.shiftleft("cell", 64 - SKETCH_BITS))
    high = bits_to_double(F.shiftleft("cell", 64 - SKETCH_BITS).bitwiseOR(F.lit((1 << (64 - SKETCH_BITS)) - 1)))
    mid = F.when(F.col("cell") == 0, F.lit(0.0)).otherwise((low + high) / 2)
    place = F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), (F.lit(p) * (F.col("n_all") - 1) / F.lit(100.0)).alias("at")) for p in pcts]))
    q = cum.select(*groups, "before", "upto", mid.alias("mid"), place.alias("q"))
    inside = lambda r: (r >= F.col("before")) & (r < F.col("upto"))
    lo, hi = F.floor("q.at"), F.ceil("q.at")
    q = q.where(inside(lo) | inside(hi))
    got = q.groupBy(*groups, F.col("q.pct").alias("pct")).agg(F.max(F.when(inside(lo), F.col("mid"))).alias("lo"), F.max(F.when(inside(hi), F.col("mid"))).alias("hi"), F.max(F.col("q.at") - lo).alias("part"))
    return got.select(*groups, "pct", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))
