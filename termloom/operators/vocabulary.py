"""Controlled vocabulary: descriptors, tree categories, stop words, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories whose terms are kept, terms that are stop words whatever their category, levels in order.
KEPT_CATEGORIES = ["A", "C", "D", "G"]
FORCED_TAGS = ["Male", "Female"]
LEVELS = ["Stressor", "Molecular", "Cellular", "Tissue", "Organ", "Adverse Outcome", "Uncategorized"]


def dedupe_descriptors(df: DataFrame, name: str, ui: str) -> DataFrame:
    """One row per name with its least identifier; rows lacking either are dropped."""
    return df.where(F.col(name).isNotNull() & F.col(ui).isNotNull()).groupBy(name).agg(F.min(ui).alias(ui))


def first_descriptors(df: DataFrame, name: str, ui: str, position: str) -> DataFrame:
    """One row per name with the identifier of its first record by ``position``; rows lacking either are dropped."""
    kept = df.where(F.col(name).isNotNull() & F.col(ui).isNotNull())
    return kept.groupBy(name).agg(F.min_by(ui, position).alias(ui))


def categories(tree: DataFrame, name: str, number: str) -> DataFrame:
    """Per heading the sorted distinct first letters, upper case, of its tree numbers; other first characters are ignored."""
    letter = F.upper(F.substring(number, 1, 1))
    return tree.where(letter.rlike("^[A-Z]$")).groupBy(name).agg(F.array_sort(F.collect_set(letter)).alias("categories"))


def classify_stop_words(cats: DataFrame, name: str, kept: list[str] | None = None) -> DataFrame:
    """Headings with none of the ``kept`` categories, filed under their first category."""
    keep = F.array(*[F.lit(c) for c in kept or KEPT_CATEGORIES])
    return cats.where(~F.arrays_overlap("categories", keep)).select(F.col(name).alias("term"), F.array_min("categories").alias("category"))


def orphans(headings: DataFrame, cats: DataFrame, name: str, forced: list[str] | None = None) -> DataFrame:
    """Headings without any category, and the ``forced`` ones that exist."""
    without = headings.select(name).distinct().join(cats.select(name), name, "left_anti")
    tags = headings.where(F.col(name).isin(forced if forced is not None else FORCED_TAGS)).select(name).distinct()
    return without.unionByName(tags).distinct().select(F.col(name).alias("term"))


def tag_stop_words(df: DataFrame, name: str, stop: DataFrame, stop_name: str) -> DataFrame:
    """``df`` with ``is_stop``: whether the name is a stop word, whatever the case."""
    low = stop.select(F.lower(stop_name).alias("__stop")).where(F.col("__stop").isNotNull()).distinct()
    return df.join(low, F.lower(name) == F.col("__stop"), "left").withColumn("is_stop", F.col("__stop").isNotNull()).drop("__stop")


def without_stop_words(df: DataFrame, name: str, stop: DataFrame, stop_name: str) -> DataFrame:
    """Rows whose name is not exactly a stop word; null names stay."""
    return df.join(stop.select(F.col(stop_name).alias("__stop")).distinct(), F.col(name) == F.col("__stop"), "left_anti")


def level_index(level: Column) -> Column:
    """Place of a level in ``LEVELS`` from 1, spelling and case aside; unknown and null count as the last."""
    low = F.array(*[F.lit(x.lower()) for x in LEVELS])
    at = F.array_position(low, F.lower(F.trim(level)))
    return F.when(at > 0, at).otherwise(len(LEVELS)).cast("int")


def level_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), index)


def strata(df: DataFrame, heading: Column, level: str) -> DataFrame:
    """``term, level``: one row per heading with its first level in order."""
    return df.select(heading.alias("term"), level_index(F.col(level)).alias("i")).where(F.col("term").isNotNull()).groupBy("term").agg(F.min("i").alias("i")).select("term", level_name(F.col("i")).alias("aop_level"))
