"""Contextual relevance of articles and terms, and the ad-hoc queries over the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.terms import heading_of
from termloom.operators.packed import packed_lists


def pool_tokens(articles: DataFrame, field: str, token_mode: str = "raw") -> DataFrame:
    """``pmid, term`` of annotated articles: pieces between semicolons as they stand (``raw``), or their headings (``heading``).

    Raw pieces match a seed only when equal to it; stars, qualifiers and spaces stay.
    """
    if token_mode == "raw":
        return articles.select("pmid", F.explode(F.split(field, ";", -1)).alias("term")).where(F.col("term") != "").distinct()
    lists = packed_lists(articles, field, "terms", ["pmid"])
    return lists.select("pmid", F.explode("vals").alias("t")).select("pmid", heading_of(F.col("t")).alias("term")).where(F.col("term").isNotNull()).distinct()


def article_scores(tokens: DataFrame, seeds: DataFrame, weights: list[str]) -> DataFrame:
    """``pmid, score_<weight>..., contributing_seeds`` of the articles that hold a seed.

    ``tokens`` has (pmid, term), ``seeds`` (term, the weights). A score is the share of all seed weight that the article's
    distinct seed terms carry; 0 when the weights add up to nothing. Seeds are sorted and joined by ``;``.
    """
    hits = tokens.select("pmid", "term").where(F.col("term").isNotNull()).distinct().join(seeds, "term")
    totals = seeds.agg(F.struct(*[F.sum(w).alias(w) for w in weights])).scalar()
    share = lambda w: F.when(totals[w] > 0, F.sum(w) / totals[w]).otherwise(0.0).alias(f"score_{w}")
    return hits.groupBy("pmid").agg(*[share(w) for w in weights], F.array_join(F.array_sort(F.collect_set("term")), ";").alias("contributing_seeds"))


def term_scores(tokens: DataFrame, scores: DataFrame, weights: list[str], seeds: DataFrame) -> DataFrame:
    """``term, n_articles, CRS_<weight>...``: mean score of the articles holding a seed term times log10(articles + 1)."""
    held = tokens.select("pmid", "term").distinct().join(seeds.select("term"), "term", "left_semi").join(scores, "pmid")
    n = F.count(F.lit(1))
    return held.groupBy("term").agg(n.alias("n_articles"), *[(F.avg(f"score_{w}") * F.log10(n + 1.0)).alias(f"CRS_{w}") for w in weights])


def node_articles(scores: DataFrame, term: str, score: str, limit: int | None = None, like: bool = False) -> DataFrame:
    """Articles whose seeds contain ``term``, best first, then by pmid: exact seeds, or the substring with ``like``."""
    return _ranked(scores.where(_holds(term, like)), score, limit)


def edge_articles(scores: DataFrame, a: str, b: str, score: str, limit: int | None = None, like: bool = False) -> DataFrame:
    """Articles whose seeds contain both terms."""
    return _ranked(scores.where(_holds(a, like) & _holds(b, like)), score, limit)


def top_articles(scores: DataFrame, score: str, limit: int = 20) -> DataFrame:
    return _ranked(scores, score, limit)


def _holds(term: str, like: bool):
    if like:
        return F.ilike(F.col("contributing_seeds"), F.lit(f"%{term}%"))
    return F.array_contains(F.split("contributing_seeds", ";"), term)


def _ranked(df: DataFrame, score: str, limit: int | None) -> DataFrame:
    out = df.orderBy(F.desc(score), "pmid")
    return out.limit(limit) if limit else out
