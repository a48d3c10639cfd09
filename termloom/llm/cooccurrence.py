"""Items that appear together: stripes of co-occurring neighbours, merged by key, with log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import maybe_broadcast, written

#: Most pairs and items a task holds before it hands on its stripes; most segments a stripe is cut into, and the share of all
#: listings (one in so many) from which it is cut at all.
HELD_PAIRS, HELD_NAMES, SEGMENTS, FREQUENT = 2_000_000, 500_000, 64, 1000


def vocabulary(records: DataFrame, items: str) -> tuple[DataFrame, int, int, dict[int, int]]:
    """(``code, term`` of every distinct item, their number, the seed of the codes, the segments of frequent items by code).

    A code is the 64-bit hash of seed and item: it needs no dictionary where records are read. The first seed is taken under
    which no two items share a code, so codes are exact. An item with more than one in ``FREQUENT`` of all listings (there are
    fewer than ``FREQUENT`` of these) has its stripe cut into up to ``SEGMENTS`` parts, in proportion.
    """
    terms = written(records.select(F.explode(items).alias("term")).where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "items")
    n, total = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    seed = 0
    while terms.agg(F.count_distinct(code_of(F.col("term"), seed))).first()[0] < n:
        seed += 1
    coded = terms.select(code_of(F.col("term"), seed).alias("code"), "term", "n")
    frequent = {r["code"]: min(SEGMENTS, 2 ** int(r["n"] * FREQUENT / total).bit_length()) for r in coded.where(F.col("n") * FREQUENT > total).collect()}
    return coded.select("code", "term"), n, seed, frequent


def code_of(item: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), item)


def stripes(records: DataFrame, items: str, seed: int, frequent: dict[int, int]) -> DataFrame:
    """Partial stripes ``(item, segment, neighbours, counts)`` of lists of distinct items, combined within each task.

    Items are their codes. The stripe of an item holds the items of greater code and itself; the count with itself is the
    number of records. A task adds up its pairs as integers (numpy) and emits an associative array per item and neighbour
    segment whenever it holds ``HELD_PAIRS`` of them, so memory is bounded and no pair of a single record is ever shuffled.
    """

    def pairs_of(codes: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.diff(off)
        for k in np.unique(sizes[sizes > 0]):
            k = int(k)
            rows = off[:-1][sizes == k]
            step = max(1, HELD_PAIRS // (k * (k + 1) // 2))
            if k <= 2000:
                i, j = np.triu_indices(k)
                for s in range(0, len(rows), step):
                    m = codes[rows[s : s + step, None] + np.arange(k)]
                    yield m[:, i].ravel(), m[:, j].ravel()
            else:  # a very long record: one row of its triangle at a time
                for r in rows:
                    m = codes[r : r + k]
                    for x in range(k):
                        yield np.full(k - x, m[x]), m[x:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def fold() -> None:
            nonlocal held, n_held
            key, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate([h[1] for h in held])).astype(np.int64)
            held, n_held = [(key, total)], len(key)

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held
            if not held:
                return
            fold()
            key, total = held[0]
            held, n_held = [], 0
            codes = np.fromiter(names, np.int64, len(names))
            a, b = codes[key >> 32], codes[key & 0xFFFFFFFF]
            parts = np.fromiter((frequent.get(c, 1) for c in names), np.int64, len(names))[key >> 32]
            segment = (b & (parts - 1)).astype(np.int32)
            order = np.lexsort((b, segment, a))
            a, b, segment, total = a[order], b[order], segment[order], total[order]
            begins = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (segment[1:] != segment[:-1])]))
            off = pa.array(np.concatenate([begins, [len(a)]]).astype(np.int32))
            cols = [pa.array(a[begins]), pa.array(segment[begins]), pa.ListArray.from_arrays(off, pa.array(b)), pa.ListArray.from_arrays(off, pa.array(total))]
            made = pa.RecordBatch.from_arrays(cols, names=["item", "segment", "neighbours", "counts"])
            for s in range(0, made.num_rows, 4096):
                yield made.slice(s, 4096)

        for batch in batches:
            lists = batch.column(0).drop_null()
            if not len(lists):
                continue
            off = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            enc = lists.flatten().dictionary_encode()
            local = np.array([names.setdefault(w, len(names)) for w in enc.dictionary.to_pylist()], dtype=np.int64)
            codes = local[enc.indices.to_numpy(zero_copy_only=False)] if len(enc) else np.empty(0, np.int64)
            for a, b in pairs_of(codes, off):
                key, count = np.unique((a << 32) | b, return_counts=True)
                held.append((key, count))
                n_held += len(key)
                if n_held >= HELD_PAIRS:
                    fold()
                    if n_held >= HELD_PAIRS // 2:
                        yield from emit()
            if len(names) > HELD_NAMES:
                yield from emit()
                names.clear()
        yield from emit()

    coded = records.select(F.array_sort(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: code_of(x, seed))).alias("codes"))
    return coded.mapInArrow(run, "item bigint, segment int, neighbours array<bigint>, counts array<bigint>")


def llr(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Log-likelihood ratio (G squared) of a two-by-two table of counts; empty cells add nothing."""

    def x_log_x(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x > 0, x * F.ln(x)).otherwise(0.0)

    n_a, n_b, n_ab, n = (c.cast("double") for c in (n_a, n_b, n_ab, n))
    cells = x_log_x(n_ab) + x_log_x(n_a - n_ab) + x_log_x(n_b - n_ab) + x_log_x(n - n_a - n_b + n_ab)
    margins = x_log_x(n_a) + x_log_x(n - n_a) + x_log_x(n_b) + x_log_x(n - n_b)
    return F.greatest(F.lit(0.0), 2.0 * (cells - margins + x_log_x(n)))


def merged_stripes(partial: DataFrame) -> DataFrame:
    """Whole stripes: the partial arrays of each item and neighbour segment added up into one, ``(item, segment, neighbours, counts)``.

    Arrays travel whole, keyed by item and segment, so the stripe of a frequent item is spread over several tasks. Each
    task gets its stripes sorted by key and merges the arrays of a key at a time (numpy), ``HELD_PAIRS`` entries at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        kept = np.empty(0, np.int64), np.empty(0, np.int64)

        def made(items: np.ndarray, segments: np.ndarray, off: np.ndarray, near: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            off = pa.array(off.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(items), pa.array(segments), pa.ListArray.from_arrays(off, pa.array(near)), pa.ListArray.from_arrays(off, pa.array(n))], names=["item", "segment", "neighbours", "counts"])

        for whole in batches:
            sizes = np.diff(whole.column(2).offsets.to_numpy())
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // HELD_PAIRS)) + 1
            for s, e in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                batch = whole.slice(s, e - s)
                if not batch.num_rows:
                    continue
                item, segment = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                near, n, size = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(), sizes[s:e]
                new = np.concatenate([[(item[0], segment[0]) != last], (item[1:] != item[:-1]) | (segment[1:] != segment[:-1])])
                if last is not None and new[0]:
                    yield made(np.array([last[0]]), np.array([last[1]], np.int32), np.array([0, len(kept[0])]), *kept)
                elif last is not None:
                    near, n = np.concatenate([kept[0], near]), np.concatenate([kept[1], n])
                group = np.repeat(np.cumsum(new), size)
                group = np.concatenate([np.zeros(len(near) - len(group), np.int64) + (0 if not new[0] else 1), group])
                order = np.lexsort((near, group))
                near, group, n = near[order], group[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], (near[1:] != near[:-1]) | (group[1:] != group[:-1])]))
                near, group, n = near[first], group[first], np.add.reduceat(n, first)
                begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                keys = np.flatnonzero(new) if new[0] else np.concatenate([[0], np.flatnonzero(new)])
                if len(begins) > 1:
                    stop = begins[-1]
                    yield made(item[keys[:-1]], segment[keys[:-1]], begins, near[:stop], n[:stop])
                last, kept = (item[-1], segment[-1]), (near[begins[-1] :], n[begins[-1] :])
        if last is not None:
            yield made(np.array([last[0]]), np.array([last[1]], np.int32), np.array([0, len(kept[0])]), *kept)

    placed = partial.repartition("item", "segment").sortWithinPartitions("item", "segment")
    return placed.mapInArrow(run, partial.schema)


def pair_statistics(records: DataFrame, items: str, min_pairs: int = 1, min_share: int | None = None) -> DataFrame:
    """``(term_a, term_b, n_ab, n_a, n_b, n, lift, llr)`` of every pair a < b of items sharing ``min_pairs`` records or more.

    ``records`` holds one row per record with ``items``, a list of distinct items; null and empty lists count as
    records without items and form no pair. ``min_share`` keeps pairs in at least one of so many records. ``lift`` is the
    observed count against that under independence.
    """
    terms, n_terms, seed, frequent = vocabulary(records, items)
    whole = written(merged_stripes(stripes(records, items, seed, frequent)), "stripes")
    counted = whole.select(F.col("item").alias("x"), F.inline(F.arrays_zip("neighbours", "counts"))).withColumnsRenamed({"neighbours": "y", "counts": "n_ab"})
    n = records.where(F.size(items) > 0).agg(F.count(F.lit(1)).alias("n"))
    alone = maybe_broadcast(written(counted.where(F.col("x") == F.col("y")).join(terms, F.col("x") == F.col("code")).select("code", "term", F.col("n_ab").alias("n_own")), "singles"), n_terms)
    pairs = counted.where((F.col("x") < F.col("y")) & (F.col("n_ab") >= min_pairs)).withColumn("n", n.scalar())
    if min_share:
        pairs = pairs.where(F.col("n_ab") * min_share >= F.col("n"))
    pairs = reduce(lambda p, c: p.join(alone.select(F.col("code").alias(c), F.struct("term", "n_own").alias(f"own_{c}")), c), ("x", "y"), pairs)
    a, b = F.least("own_x", "own_y"), F.greatest("own_x", "own_y")
    pairs = pairs.select(a["term"].alias("term_a"), b["term"].alias("term_b"), "n_ab", a["n_own"].alias("n_a"), b["n_own"].alias("n_b"), "n")
    expected = F.col("n_a").cast("double") * F.col("n_b")
    return pairs.withColumn("lift", F.col("n_ab").cast("double") * F.col("n") / expected).withColumn("llr", llr(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")))
