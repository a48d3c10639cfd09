"""Has this key been seen before? An exact ledger of keys, bucketed on disk."""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.session import delete_path, read_small_text, scratch, write_small_text, written

#: Most keys that are treated as hot (so their first arrivals are broadcast), files of a bucket before the ledger is compacted.
HOT_KEYS, FILES_PER_BUCKET = 64, 8


class KeyLedger:
    """History of first arrivals, hash-partitioned into buckets on disk; no key is held in memory.

    The ledger is a table ``(key, first_order)`` bucketed by ``key`` below ``path``, where ``_ledger.json`` keeps its bucket
    count, types and generation: a ledger opened on the path of an earlier one goes on where that stopped. Keys and orders may
    have any type Spark can hash and sort; later batches must bring the same types (``TypeError`` otherwise).

    A batch is taken in with one shuffle: its rows are hash-partitioned by key as the ledger is, ranked by arrival within
    their key, and sort-merge left-joined with the ledger bucket by bucket (the history is never shuffled); keys without
    match are appended. A row has been seen unless it is the first of its key in the batch and the ledger has no earlier
    arrival. Keys that hold a large share of a batch (at most ``HOT_KEYS``, named by a bounded sketch that only balances the
    load) send one row per task, their first arrival, through that stage; their other rows are answered in place from these
    few first arrivals. Every append adds a file per bucket; after ``FILES_PER_BUCKET`` appends the ledger is rewritten with
    one file per bucket as a new generation, without a shuffle.

    Answers are exact: the rate of wrong answers is zero. A batch that is taken in again (after a failure) gets the same
    answers and appends nothing. Null keys are never seen and never enter the ledger; of rows sharing key and order all count
    as the first. An empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or scratch(spark, "ledger")).rstrip("/")
        found = read_small_text(spark, f"{self.path}/_ledger.json")
        self.meta: dict | None = json.loads(found) if found else None
        self.buckets = self.meta["buckets"] if self.meta else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"ledger_{uuid.uuid4().hex[:16]}"
        atexit.register(self.drop)
        if self.meta:
            self._attach()

    def drop(self) -> None:
        """Takes the ledger's table out of the catalog; its files stay."""
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        except Exception:  # the session may already be gone
            pass

    def _place(self, generation: int) -> str:
        return f"{self.path}/g{generation}"

    def _attach(self) -> None:
        m = self.meta
        self.drop()
        place = self._place(m["generation"]).replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {self.name} (key {m['key']}, first_order {m['order']}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def _save(self, **changes) -> None:
        self.meta = {**self.meta, **changes}
        write_small_text(self.spark, f"{self.path}/_ledger.json", json.dumps(self.meta))

    def keys(self) -> DataFrame:
        """``key, first_order`` of all keys so far."""
        return self.spark.table(self.name)

    def _start(self, batch: DataFrame, key: str, order: str) -> None:
        types = {"key": batch.schema[key].dataType.simpleString(), "order": batch.schema[order].dataType.simpleString()}
        if self.meta is None:
            self.meta = {"buckets": self.buckets, **types, "generation": 0, "appends": 0}
            self._save()
            self._attach()
        elif any(self.meta[k] != t for k, t in types.items()):
            raise TypeError(f"the ledger holds {self.meta['key']} by {self.meta['order']}, the batch {types['key']} by {types['order']}")

    def absorb(self, batch: DataFrame, key: str, order: str) -> DataFrame:
        """Takes in one batch, later than all before; returns its rows with ``seen``. Rows without key or order are not seen."""
        keyed = batch.where(F.col(key).isNotNull() & F.col(order).isNotNull())
        out = self._absorb(keyed, key, order, hot_keys(keyed.agg(*sketch(key)).first()))
        return out.unionByName(batch.where(F.col(key).isNull() | F.col(order).isNull()).withColumn("seen", F.lit(False)))

    def _absorb(self, keyed: DataFrame, key: str, order: str, hot: list[int]) -> DataFrame:
        """:meth:`absorb` for rows that have key and order."""
        self._start(keyed, key, order)
        clash = {"seen", "__new", "__hot", "__key", "__first", "__old", "__rank"} & set(keyed.columns)
        if clash:
            raise ValueError(f"columns {sorted(clash)} are taken")
        k, o = F.col(key), F.col(order)
        is_hot = F.xxhash64(key).isin(hot) if hot else F.lit(False)
        rows = keyed.where(~is_hot).withColumn("__hot", F.lit(False)) if hot else keyed.withColumn("__hot", F.lit(False))
        if hot:
            firsts = keyed.where(is_hot).groupBy(k.alias(key)).agg(F.min(o).alias(order))
            rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema if f.name not in (key, order)]
            rows = rows.unionByName(firsts.select(key, order, *rest, F.lit(True).alias("__hot")))
        ranked = rows.repartition(self.buckets, key).withColumn("__rank", F.rank().over(Window.partitionBy(key).orderBy(order)))
        old = self.keys().select(F.col("key").alias("__key"), F.col("first_order").alias("__first")).hint("merge")
        joined = ranked.join(old, k == F.col("__key"), "left")
        earlier = F.coalesce(F.col("__first") < o, F.lit(False))
        told = written(joined.withColumn("seen", (F.col("__rank") > 1) | earlier).withColumn("__new", (F.col("__rank") == 1) & F.col("__first").isNull()).drop("__key", "__first", "__rank"), "ledger-answers")
        self._append(told.where("__new").select(k.alias("key"), o.alias("first_order")))
        out = told.where(~F.col("__hot")).select(*keyed.columns, "seen")
        if hot:
            known = F.broadcast(told.where("__hot").select(k.alias("__key"), o.alias("__first"), F.col("seen").alias("__old")))
            answered = keyed.where(is_hot).join(known, k == F.col("__key")).withColumn("seen", F.col("__old") | (o > F.col("__first")))
            out = out.unionByName(answered.select(*keyed.columns, "seen"))
        return out

    def _append(self, new: DataFrame) -> None:
        if new.isEmpty():
            return
        put = new.repartition(self.buckets, "key").dropDuplicates(["key"]).write.bucketBy(self.buckets, "key").sortBy("key").mode("append").format("parquet")
        put.option("path", self._place(self.meta["generation"])).saveAsTable(self.name)
        self._save(appends=self.meta["appends"] + 1)
        if self.meta["appends"] >= FILES_PER_BUCKET:
            self.compact()

    def compact(self) -> None:
        """One file per bucket again, as a new generation; the old one is removed once the new one is named in the ledger's file."""
        old = self.meta["generation"]
        name = f"{self.name}_new"
        whole = self.keys().groupBy("key").agg(F.min("first_order").alias("first_order"))  # asks for the buckets' partitioning
        whole.write.bucketBy(self.buckets, "key").sortBy("key").mode("overwrite").format("parquet").option("path", self._place(old + 1)).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        self._save(generation=old + 1, appends=1)
        self._attach()
        delete_path(self.spark, self._place(old))


def sketch(key: str) -> list[Column]:
    """Aggregates from which :func:`hot_keys` reads: rows with a key, and a bounded sketch of its most frequent hashes."""
    h = F.when(F.col(key).isNotNull(), F.xxhash64(key))
    return [F.count(h).alias("n"), F.call_function("approx_top_k", h, F.lit(HOT_KEYS), F.lit(10_000)).alias("top")]


def hot_keys(sketched: Row) -> list[int]:
    """Hashes of keys that may hold more than one in ``HOT_KEYS`` of the rows. A miss or a false one only moves load."""
    return [t["item"] for t in sketched["top"] or [] if t["item"] is not None and t["count"] * HOT_KEYS > sketched["n"] and t["count"] > 1000]


def seen_before(feed: DataFrame, key: str, order: str, n_batches: int = 4, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``feed`` with ``seen``: whether the row's key arrived in an earlier row, batch by batch through a :class:`KeyLedger`.

    With ``path`` the ledger kept there is read and carried on: keys of earlier calls count as seen. The feed is read twice:
    once for the bounds of the batches (about equal numbers of rows; orders that are no numbers or times make one batch) and
    the sketch of hot keys, once to lay it down batch by batch. Rows with a null key are not seen. Rows with a null
    order arrived at no known time: they are not seen, and no other row is seen because of them. Other columns pass through;
    ``feed`` must not have a column ``seen`` or one of the names that :meth:`KeyLedger.absorb` takes.
    """
    ledger = KeyLedger(feed.sparkSession, path, buckets)
    at = [i / n_batches for i in range(1, n_batches)] if isinstance(feed.schema[order].dataType, (T.NumericType, T.DateType, T.TimestampType)) else []
    told = feed.agg(*sketch(key), *([F.percentile_approx(order, at, 1000).alias("q")] if at else [])).first()
    hot, bounds = hot_keys(told), sorted(set((told["q"] or []) if at else []))
    number = sum(((F.col(order) > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    landed = written(feed.withColumn("__batch", F.when(F.col(key).isNull() | F.col(order).isNull(), -1).otherwise(number)), "ledger-feed", ["__batch"])
    out = landed.where(F.col("__batch") == -1).drop("__batch").withColumn("seen", F.lit(False))
    for n in range(len(bounds) + 1):
        out = out.unionByName(ledger._absorb(landed.where(F.col("__batch") == n).drop("__batch"), key, order, hot))
    return out
