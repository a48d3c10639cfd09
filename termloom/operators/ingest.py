"""Article feeds: annotation, insert-if-absent, updates, pruning and citation expansion, all as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.scalars import generation_number
from termloom.session import written


def first_rows(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Per non-null ``key`` the ``cols`` of the row with the lowest ``order``; combined before the shuffle."""
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("__first"))
    return kept.select(key, *[F.col("__first")[c].alias(c) for c in cols])


def annotate(articles: DataFrame, cache: DataFrame, key: str, field: str) -> DataFrame:
    """``articles`` with ``field`` filled from ``cache`` (one row per key) where it is null or empty and the cache has the key."""
    found = cache.select(F.col(key).alias("__key"), F.col(field).alias("__new"))
    both = articles.join(found, F.col(key) == F.col("__key"), "left")
    fill = (F.col(field).isNull() | (F.col(field) == "")) & F.col("__key").isNotNull()
    return both.withColumn(field, F.when(fill, F.col("__new")).otherwise(F.col(field))).drop("__key", "__new")


def missing(source: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``source`` that ``known`` lacks."""
    return source.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """``old`` and the first row (by ``order``) of every key of ``new`` that it lacks; null keys are not inserted."""
    cols = [c for c in old.columns if c != key]
    firsts = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("__row"))
    fresh = firsts.join(old.select(key), key, "left_anti").select(key, *[F.col("__row")[c].alias(c) for c in cols])
    return old.unionByName(fresh.select(*old.columns))


def update_links(articles: DataFrame, links: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``articles`` with ``fields`` replaced by those of ``links`` (one row per key) where the key is found there."""
    new = links.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    out = articles.join(new, F.col(key) == F.col("__key"), "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"__{f}"), F.col(f)))
    return out.drop("__key", *[f"__{f}" for f in fields])


def prune_generations(articles: DataFrame, generation: str, first_removed: int) -> DataFrame:
    """Rows whose generation is below G``first_removed``; P0 and unreadable labels always stay."""
    k = generation_number(F.col(generation))
    return articles.where(F.coalesce((k < first_removed) | (k == 0), F.lit(True)))


def citation_expand(roots: DataFrame, links: DataFrame, generations: int) -> DataFrame:
    """``pmid, generation`` reached from ``roots(pmid)`` through ``links(pmid, child)``, first generation first.

    ``generations`` counts the roots: n gives n - 1 hops. Each hop joins the frontier with the links, drops what was reached
    before by an anti-join, and is written to the shared folder.
    """
    reached = written(roots.select("pmid").where(F.col("pmid").isNotNull()).distinct().withColumn("hop", F.lit(0)), "hop0")
    frontier = reached
    for hop in range(1, max(1, generations)):
        children = frontier.join(links, "pmid").select(F.col("child").alias("pmid")).where(F.col("pmid").isNotNull()).distinct()
        frontier = written(children.join(reached, "pmid", "left_anti").withColumn("hop", F.lit(hop)), f"hop{hop}")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.select("pmid", F.when(F.col("hop") == 0, "P0").otherwise(F.concat(F.lit("G"), F.col("hop").cast("string"))).alias("generation"))
