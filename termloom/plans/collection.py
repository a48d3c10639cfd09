"""Collection stages: first articles and their citations, annotations of new articles, the pool that relevance is scored on.

Where articles, links and annotations come from is a function over a table of ids (or terms), so the same stages run against a
remote service (``sources.search.fetch_in_batches``) and against stored tables (``stored_links``, ``stored_annotations``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.scalars import generation_label
from termloom.functions.terms import search_term
from termloom.operators import ingest
from termloom.operators.packed import packed_lists
from termloom.session import written

#: From ``pmid`` to ``pmid, status, cited_by, cites`` (packed lists); ``status`` is ok, empty or failed.
Links = Callable[[DataFrame], DataFrame]
#: From ``pmid`` to ``pmid, status, val`` (packed headings).
Annotations = Callable[[DataFrame], DataFrame]
#: From ``term, query`` to ``term, pmid``.
TermSearch = Callable[[DataFrame], DataFrame]


def stored_links(links: DataFrame) -> Links:
    """Links of a table ``pmid, cited_by, cites``: absent articles and those never fetched fail, articles without links are empty."""

    def look_up(ids: DataFrame) -> DataFrame:
        both = ids.join(links.withColumn("__known", F.lit(True)), "pmid", "left")
        unknown = F.col("__known").isNull() | (F.col("cited_by").isNull() & F.col("cites").isNull())
        blank = (F.coalesce("cited_by", F.lit("")) == "") & (F.coalesce("cites", F.lit("")) == "")
        return both.select("pmid", F.when(unknown, "failed").when(blank, "empty").otherwise("ok").alias("status"), "cited_by", "cites")

    return look_up


def stored_annotations(table: DataFrame) -> Annotations:
    """Annotations of a table ``pmid, mesh_terms``: absent and null ones fail, blank ones are empty."""

    def look_up(ids: DataFrame) -> DataFrame:
        val = F.col("mesh_terms")
        status = F.when(val.isNull(), "failed").when(F.trim(val) == "", "empty").otherwise("ok")
        return ids.join(table, "pmid", "left").select("pmid", status.alias("status"), F.when(status == "empty", "").otherwise(val).alias("val"))

    return look_up


def children(links: DataFrame) -> DataFrame:
    """``pmid, child`` of packed link lists, once each."""
    parts = [packed_lists(links.select("pmid", f), f, "numbers", ["pmid"]).select("pmid", F.explode("vals").alias("child")) for f in ("cited_by", "cites")]
    return parts[0].unionByName(parts[1]).select("pmid", F.try_to_number("child", F.lit("9" * 18)).cast("bigint").alias("child")).where(F.col("child").isNotNull()).distinct()


def collect_articles(roots: DataFrame, links: Links, generations: int) -> DataFrame:
    """``pmid, generation, status, cited_by, cites`` of ``roots(pmid)`` and what citations reach from them.

    ``generations`` counts the roots. Links are looked up once per article, for the last generation too (whose children are
    not added). A failed look-up keeps null lists, so it never looks like an article without links. Each generation is written.
    """
    frontier = written(roots.select(F.col("pmid").cast("bigint").alias("pmid")).where(F.col("pmid").isNotNull()).distinct(), "roots")
    found = None
    for k in range(max(1, generations)):
        got = written(links(frontier).withColumn("hop", F.lit(k)), f"generation{k}")
        found = got if found is None else found.unionByName(got)
        if k + 1 >= generations:
            break
        new = children(got.where(F.col("status") == "ok")).select(F.col("child").alias("pmid")).distinct()
        frontier = written(new.join(found.select("pmid"), "pmid", "left_anti"), f"frontier{k}")
        if frontier.isEmpty():
            break
    return found.select("pmid", generation_label(F.col("hop")).alias("generation"), "status", "cited_by", "cites")


def populate_cache(cache: DataFrame, ids: DataFrame, annotations: Annotations) -> tuple[DataFrame, DataFrame]:
    """(cache ``pmid, mesh_terms`` with what it lacked of ``ids(pmid)``; what was asked for as ``pmid, status``).

    Failed ids are not entered, so that the next run asks again; empty ones are entered as ''. The second table is the log.
    """
    asked = written(annotations(ingest.missing(ids, cache, "pmid")), "annotations")
    fresh = asked.where(F.col("status") != "failed").select("pmid", F.col("val").alias("mesh_terms"))
    return cache.select("pmid", "mesh_terms").unionByName(fresh), asked.select("pmid", "status")


def pool_terms(seeds: DataFrame, processed: DataFrame) -> DataFrame:
    """``term, query`` of the distinct seeds that are not in ``processed(term)``; the query is the term as a search takes it."""
    new = seeds.select("term").where(F.col("term").isNotNull()).distinct().join(processed.select("term"), "term", "left_anti")
    return new.select("term", search_term(F.col("term")).alias("query"))


def extend_pool(pool: DataFrame, processed: DataFrame, seeds: DataFrame, search: TermSearch) -> tuple[DataFrame, DataFrame]:
    """(pool ``pmid``, processed ``term``) after searching the seeds not searched before; both written.

    Running it again with the same seeds searches nothing.
    """
    terms = written(pool_terms(seeds, processed), "pool-terms")
    found = search(terms).select(F.col("pmid").cast("bigint").alias("pmid")).where(F.col("pmid").isNotNull())
    return written(pool.select("pmid").unionByName(found).distinct(), "pool"), written(processed.select("term").unionByName(terms.select("term")), "processed")
