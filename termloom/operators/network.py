"""The weighted term co-occurrence network: bags of terms, citation statistics, edges, nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.scalars import generation_label
from termloom.functions.special import binomial_tail_udf, log_likelihood_term, pair_probability
from termloom.operators.ranks import average_ranks
from termloom.session import maybe_broadcast, written

#: Shares of generation, article rank, median rank and total rank in a node's weight.
NODE_SHARES = {"generation": 0.45, "articles": 0.15, "median": 0.20, "total": 0.20}


def article_terms(tokens: DataFrame) -> DataFrame:
    """``pmid, term, is_major``: one row per article and term; major where any of its tokens is. Null terms are dropped."""
    return tokens.where(F.col("term").isNotNull()).groupBy("pmid", "term").agg(F.max("is_major").alias("is_major"))


def term_statistics(tokens: DataFrame, articles: DataFrame) -> DataFrame:
    """Per term over its unqualified tokens (repeats count): rows, median, mean and sum of the articles' citation counts."""
    plain = tokens.where(~F.col("qualified") & F.col("term").isNotNull()).join(articles.select("pmid", "cited_by_count"), "pmid")
    c = F.col("cited_by_count")
    return plain.groupBy("term").agg(F.count(F.lit(1)).alias("total_pmids"), F.median(c).alias("median_citations"), F.round(F.avg(c), 9).alias("mean_citations"), F.sum(c).alias("total_citations"))


def rank_terms(stats: DataFrame) -> DataFrame:
    """Term statistics with average ranks, divided by the number of terms, of their four columns."""
    return average_ranks(written(stats, "term-statistics"), ["total_pmids", "median_citations", "mean_citations", "total_citations"])


def normalise_articles(articles: DataFrame) -> DataFrame:
    """``articles`` with ``normalized_cited_by``: average rank of the citation count over the number of articles.

    A single article gets 0.5 when it is cited, else 0.0.
    """
    articles = written(articles, "articles-plain")
    n = articles.agg(F.count(F.lit(1)))
    ranked = average_ranks(articles, ["cited_by_count"])
    alone = F.when(F.col("cited_by_count") > 0, 0.5).otherwise(0.0)
    return ranked.withColumn("normalized_cited_by", F.when(n.scalar() == 1, alone).otherwise(F.col("rank_cited_by_count"))).drop("rank_cited_by_count")


def cooccurrence_edges(bags: DataFrame, articles: DataFrame) -> DataFrame:
    """``source, target, cooccurrence_count, cumulative_weight`` with source < target.

    Pairs are made inside each article from its sorted array of terms and added up in the task before they are shuffled.
    Each article adds the mean of its normalised citation count and generation weight.
    """
    lists = bags.groupBy("pmid").agg(F.array_sort(F.collect_list("term")).alias("ts")).where(F.size("ts") > 1)
    weight = (F.coalesce(F.col("normalized_cited_by"), F.lit(0.0)) + F.coalesce(F.col("generation_weight"), F.lit(0.0))) / 2.0
    lists = lists.join(articles.select("pmid", weight.alias("w")), "pmid")
    pairs = F.flatten(F.transform("ts", lambda x, i: F.transform(F.slice("ts", i + 2, F.size("ts")), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    flat = lists.select("w", F.inline(pairs))
    return flat.groupBy("source", "target").agg(F.count(F.lit(1)).alias("cooccurrence_count"), F.round(F.sum("w"), 9).alias("cumulative_weight"))


def strengths(edges: DataFrame, weight: str = "cooccurrence_count") -> DataFrame:
    """``id, degree, strength`` of every node with an edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), F.col(weight).alias("w"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def scored_edges(edges: DataFrame, bags: DataFrame | None = None) -> DataFrame:
    """Edges with the strengths ``k_source, k_target``, the total ``t``, ``expected`` probability and ``loglik`` term.

    With ``bags`` also the articles of each end, ``n_source, n_target``: one table of nodes is joined once per end.
    """
    k = strengths(edges).select("id", "strength")
    if bags is not None:
        k = k.join(bags.groupBy(F.col("term").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id")
    k = written(k, "node-strengths")
    n_nodes = k.count()
    total = edges.agg(F.sum("cooccurrence_count"))
    out = edges
    for end in ("source", "target"):
        one = k.select(F.col("id").alias(end), F.col("strength").alias(f"k_{end}"), *([F.col("n").alias(f"n_{end}")] if bags is not None else []))
        out = out.join(maybe_broadcast(one, n_nodes), end)
    out = out.withColumn("t", total.scalar())
    args = F.col("k_source"), F.col("k_target"), F.col("t")
    return out.withColumn("p", pair_probability(*args)).withColumn("loglik", F.round(log_likelihood_term(F.col("cooccurrence_count"), *args), 6))


def significance(scored: DataFrame) -> DataFrame:
    """Scored edges with ``mlf_p_value``, the chance of at least the observed count among ``t`` draws, and its logarithm to 10."""
    tail = binomial_tail_udf(F.col("cooccurrence_count").cast("double"), F.col("t").cast("double"), F.col("p"))
    return scored.withColumn("__tail", tail).select("*", F.col("__tail.p").alias("mlf_p_value"), F.col("__tail.log10_p").alias("mlf_log10_p")).drop("__tail")


def edge_table(scored: DataFrame, bags: DataFrame | None = None) -> DataFrame:
    """The public edge attributes. A single edge, or all weights equal, ranks 0.5; equal counts scale to 0.5.

    ``bags`` is needed only where the edges were scored without it.
    """
    if bags is not None and "n_source" not in scored.columns:
        n = bags.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        for end in ("source", "target"):
            scored = scored.join(n.select(F.col("term").alias(end), F.col("n").alias(f"n_{end}")), end)
    e = significance(scored)
    both = F.col("n_source") + F.col("n_target") - F.col("cooccurrence_count")
    jaccard = F.when(both > 0, F.col("cooccurrence_count") / both).otherwise(0.0)
    e = average_ranks(e, ["cumulative_weight"])
    log = F.log1p(F.col("cooccurrence_count").cast("double"))
    bounds = scored.agg(F.struct(F.min("cooccurrence_count").alias("lo"), F.max("cooccurrence_count").alias("hi"), F.min("cumulative_weight").alias("wlo"), F.max("cumulative_weight").alias("whi")).alias("b")).scalar()
    lo, hi = F.log1p(bounds["lo"].cast("double")), F.log1p(bounds["hi"].cast("double"))
    minmax = F.when(hi - lo > 1e-9, (log - lo) / (hi - lo)).otherwise(0.5)
    rank = F.when(bounds["wlo"] == bounds["whi"], 0.5).otherwise(F.col("rank_cumulative_weight"))
    return e.select("source", "target", "cooccurrence_count", F.col("cumulative_weight").alias("cumulative_weight_original"), rank.alias("weight"), jaccard.alias("normalized_cooccurrence"), minmax.alias("log1p_cooccurrence_minmax"), "mlf_p_value")


def node_table(bags: DataFrame, articles: DataFrame, stats: DataFrame, edges: DataFrame) -> DataFrame:
    """The public node attributes; terms without unqualified token have citation ranks 0.0, isolated terms degree 0."""
    per = bags.join(articles.select("pmid", "generation_weight", "generation_no"), "pmid").groupBy("term").agg(
        F.count(F.lit(1)).alias("article_count"), F.sum(F.col("is_major").cast("bigint")).alias("n_major"), F.max("is_major").alias("is_major_topic"), F.greatest(F.max("generation_weight"), F.lit(0.0)).alias("generation_weight"), F.min("generation_no").alias("g")
    )
    per = written(per, "node-articles")
    ranked = average_ranks(per, ["article_count"])
    n = per.agg(F.count(F.lit(1)))
    ranked = ranked.withColumn("rank_article_count", F.when(n.scalar() == 1, 0.5).otherwise(F.col("rank_article_count")))
    r = rank_terms(stats).select("term", "rank_median_citations", "rank_mean_citations", "rank_total_citations")
    out = ranked.join(r, "term", "left").na.fill(0.0, ["rank_median_citations", "rank_mean_citations", "rank_total_citations"])
    out = out.join(strengths(edges).select(F.col("id").alias("term"), "degree"), "term", "left").na.fill(0, ["degree"])
    s, total = NODE_SHARES, sum(NODE_SHARES.values())
    weight = (s["generation"] * F.col("generation_weight") + s["articles"] * F.col("rank_article_count") + s["median"] * F.col("rank_median_citations") + s["total"] * F.col("rank_total_citations")) / total
    return out.select(
        F.col("term").alias("id"), generation_label(F.col("g")).alias("generation"), "generation_weight", "is_major_topic", "article_count", F.col("rank_article_count").alias("article_count_rank_normalized"),
        (F.col("n_major") / F.col("article_count")).alias("major_topic_proportion"), F.col("rank_median_citations").alias("rank_norm_median_cit"), F.col("rank_mean_citations").alias("rank_norm_mean_cit"),
        F.col("rank_total_citations").alias("rank_norm_total_cit"), weight.alias("adjusted_node_weight"), "degree",
    )


def best_edges(scored: DataFrame, m: int, total: float) -> DataFrame:
    """The ``m`` edges that lower the likelihood most when the subgraph weighs ``total``: a deterministic top-k."""
    gain = F.round(F.col("loglik") + F.col("cooccurrence_count") * F.ln(F.lit(float(total))), 6)
    return scored.withColumn("gain", gain).orderBy("gain", "source", "target").limit(m)


def fitted_best_edges(scored: DataFrame, m: int, rounds: int = 20) -> DataFrame:
    """:func:`best_edges` with ``total`` put to the weight of the edges chosen, until it stays the same."""
    total = None
    chosen = scored.orderBy(F.desc("cooccurrence_count"), "source", "target").limit(m)
    for _ in range(rounds):
        now = chosen.agg(F.sum("cooccurrence_count")).first()[0]
        if not now or now == total:
            break
        total = now
        chosen = best_edges(scored, m, total)
    return chosen
