"""Scalar column expressions: generations, citation counts, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def generation_number(gen: Column) -> Column:
    """0 for ``P0``, k for ``Gk`` in any case and with stray white space; null for everything else (null, NaN, ``G``)."""
    g = F.upper(F.regexp_replace(gen, r"\s", ""))
    return F.when(g == "P0", F.lit(0).cast("bigint")).when(g.rlike("^G[0-9]{1,18}$"), F.substring(g, 2, 20).cast("bigint"))


def generation_weight(gen: Column, decay: float = 1.0) -> Column:
    """``exp(-decay * k)``, 1.0 for ``P0``; a plain number counts as k, negatives as 0; 0.0 where nothing can be read."""
    number = F.try_to_number(F.trim(gen), F.lit("S999999999.999999")).cast("double")
    k = F.coalesce(generation_number(gen).cast("double"), F.when(number.isNotNull(), F.greatest(number, F.lit(0.0))))
    return F.coalesce(F.exp(-decay * k), F.lit(0.0))


def generation_label(k: Column) -> Column:
    """``P0``, ``Gk``, or ``Unknown`` for null and negative numbers."""
    return F.when(k == 0, "P0").when(k > 0, F.concat(F.lit("G"), k.cast("string"))).otherwise("Unknown")


def joined_count(packed: Column) -> Column:
    """Pieces of a ``;``-joined list, empty ones included; 0 for null, blank and ``nan``."""
    t = F.trim(packed)
    return F.when(t.isNull() | (t == "") | (F.lower(t) == "nan"), 0).otherwise(F.size(F.split(packed, ";", -1)))


def parse_date(text: Column) -> Column:
    """The date of ``Y/m/d``, ``Y-m-d``, ``Y/m``, ``Y-m`` or ``Y``; missing parts are 1; null where none fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in ("yyyy/M/d", "yyyy-M-d", "yyyy/M", "yyyy-M", "yyyy")]).cast("date")


def search_date(day: Column) -> Column:
    return F.date_format(day, "yyyy/MM/dd")


def midpoint(a: Column, b: Column) -> Column:
    """The day halfway from a to b, rounded down."""
    return F.date_add(a, F.floor(F.datediff(b, a) / 2).cast("int"))
