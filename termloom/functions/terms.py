"""Column expressions for controlled-vocabulary tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def heading_of(token: Column) -> Column:
    """Heading of a token: before the first ``/``, trimmed, leading asterisks off, inner white space single, lower case.

    Null, blank and asterisk-only tokens have none: the result is null.
    """
    before = F.substring_index(token, "/", 1)
    even = F.when(before.rlike(r"(?U)[^\S ]|  "), F.regexp_replace(before, r"(?U)\s+", " ")).otherwise(before)
    return F.nullif(F.lower(F.trim(F.ltrim(F.trim(even), F.lit("*")))), F.lit(""))


def parse_terms(packed: Column) -> Column:
    """``array<struct<name,type,is_major>>`` of a ``;``-joined field in the token grammar ``[*]heading[/[*]qualifier]*``.

    Null or blank fields give an empty array. A token whose part before ``/`` is blank is skipped as a whole; a part is
    major when it starts with an asterisk, and is left out when nothing but asterisks stands in it.
    """

    def part(piece: Column, kind: Column) -> Column:
        p = F.trim(piece)
        return F.struct(F.trim(F.ltrim(p, F.lit("*"))).alias("name"), kind.alias("type"), p.startswith("*").alias("is_major"))

    def token(t: Column) -> Column:
        parts = F.split(t, "/", -1)
        made = F.transform(parts, lambda p, i: part(p, F.when(i == 0, F.lit("mesh_term")).otherwise(F.lit("subheading"))))
        return F.when(F.trim(parts[0]) != "", F.filter(made, lambda s: s["name"] != ""))

    tokens = F.filter(F.transform(F.split(packed, ";", -1), lambda t: F.trim(t)), lambda t: t != "")
    empty = F.array().cast("array<struct<name:string,type:string,is_major:boolean>>")
    return F.coalesce(F.flatten(F.filter(F.transform(tokens, token), lambda a: a.isNotNull())), empty)


def plain_terms(packed: Column) -> Column:
    """Unqualified tokens for term statistics: tokens with ``/`` dropped, trimmed, leading asterisks off, not trimmed again."""
    kept = F.filter(F.split(packed, ";", -1), lambda t: F.instr(t, "/") == 0)
    bare = F.transform(kept, lambda t: F.ltrim(F.trim(t), F.lit("*")))
    return F.coalesce(F.filter(bare, lambda t: t != ""), F.array().cast("array<string>"))


def search_term(token: Column) -> Column:
    """The token as it is sent to a search: before ``/``, without asterisks at either end."""
    return F.trim(F.split(token, "/", 2)[0], F.lit("*"))
