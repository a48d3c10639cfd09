"""Queries of the collection stages, text sinks, raw-token modes and of the exact centralities of the extracted subgraph, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import scalars
from termloom.functions.terms import heading_of, plain_terms, search_term
from termloom.operators import figures, graph, ingest, network, relevance, vocabulary
from termloom.plans import adhoc, collection
from termloom.plans import network_queries as nq
from termloom.plans.network_sql import sql
from termloom.session import scratch, written
from termloom.sources import graph_json, text_tables
from termloom.sources.tables import table


# ------------------------------------------------------------------------------------------------ collection
def collect_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Two generations after the roots, links looked up in the feed: status and number of distinct links."""
    a = nq.raw_articles(spark, folder)
    roots = a.where(scalars.generation_number(F.col("generation")) == 0).select("pmid")
    got = written(collection.collect_articles(roots, collection.stored_links(a.select("pmid", "cited_by", "cites")), 3), "collected")
    n = collection.children(got).groupBy("pmid").agg(F.count(F.lit(1)).alias("n_links"))
    return got.join(n, "pmid", "left").select("pmid", "generation", "status", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def populate_cache(spark: SparkSession, folder: str) -> DataFrame:
    """What the annotation cache lacks of the articles, looked up in the feed: the log of the run and what was entered."""
    a = nq.raw_articles(spark, folder).select("pmid", "mesh_terms")
    cache = nq.cache(spark, folder)
    full, log = collection.populate_cache(cache, a.select("pmid"), collection.stored_annotations(a))
    return log.join(full, "pmid", "left").select("pmid", "status", F.length("mesh_terms").alias("n_chars"))


def relevance_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The pool of the annotated headings in two sittings: the second searches only what the first left."""
    seeds = written(nq.strata(spark, folder).select("term"), "seed-terms")
    toks = written(nq.tokens_of(nq.cache(spark, folder)), "pool-tokens")

    def search(terms: DataFrame) -> DataFrame:
        return terms.join(toks.withColumnRenamed("term", "query"), "query").select("term", "pmid")

    none = spark.createDataFrame([], "term string")
    pool, processed = collection.extend_pool(spark.createDataFrame([], "pmid bigint"), none, seeds.where(F.col("term") < "m"), search)
    left = collection.pool_terms(seeds, processed)
    pool, processed = collection.extend_pool(pool, processed, seeds, search)
    return pool.crossJoin(left.agg(F.count(F.lit(1)).alias("n_second")).join(processed.agg(F.count(F.lit(1)).alias("n_terms"))))


def search_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct raw tokens of the annotation cache as a search takes them."""
    raw = nq.cache(spark, folder).select(F.explode(F.split("mesh_terms", ";", -1)).alias("t"))
    return raw.select(search_term(F.col("t")).alias("query")).distinct()


def empty_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log of articles without headings, written as one id per line and read again."""
    ids = nq.annotate_articles(spark, folder).where(F.coalesce(F.trim("mesh_terms"), F.lit("")) == "").select(F.col("pmid").alias("PMID"))
    path = scratch(spark, "log")
    ids.write.option("header", True).option("sep", "\t").csv(path)
    return spark.read.schema("PMID bigint").option("header", True).option("sep", "\t").csv(path)


# ------------------------------------------------------------------------------------------------ vocabulary, text tables
def descriptor_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first record of every name, in the order of the file; records lacking name or identifier are dropped."""
    t = table(spark, folder, "mesh_terms").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("position"))
    return vocabulary.first_descriptors(t, "descriptor_name", "descriptor_ui", "position")


def stop_word_table(spark: SparkSession, folder: str) -> DataFrame:
    """Stop words and orphans, persisted by category and read again."""
    cats = written(vocabulary.categories(nq.tree(spark, folder), "descriptor_name", "mn"), "categories")
    path = scratch(spark, "stop-words")
    text_tables.write_stop_words(vocabulary.classify_stop_words(cats, "descriptor_name"), vocabulary.orphans(nq.descriptor_dedup(spark, folder), cats, "descriptor_name", []), path)
    return text_tables.read_stop_words(spark, path)


def csv_strata(spark: SparkSession, folder: str) -> DataFrame:
    """The annotation table written as CSV, read with a schema, and brought to one level per heading."""
    path = scratch(spark, "csv")
    text_tables.write_csv(table(spark, folder, "aop_annotations_master"), path)
    return vocabulary.strata(text_tables.read_csv(spark, path, "mesh_term string, aop_level string"), heading_of(F.col("mesh_term")), "aop_level")


def csv_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows written as CSV and read again: packed seeds with any character come back."""
    path = scratch(spark, "csv")
    t = table(spark, folder, "article_relevance_scores").select("pmid", "contributing_seeds")
    text_tables.write_csv(t, path, null="\\N")
    return text_tables.read_csv(spark, path, "pmid bigint, contributing_seeds string", null="\\N")


def score_table(spark: SparkSession, folder: str) -> DataFrame:
    """Best scores replaced as a sorted table and a range of keys read from it."""
    path = scratch(spark, "score-table")
    best = nq._best_scores(nq._score_rows(spark, folder))
    for _ in range(2):  # the second run replaces the first
        text_tables.write_scores(best, path)
    mid = best.agg(F.percentile_approx("pmid", 0.5, 10_000_000)).first()[0] or 0
    return spark.read.schema("pmid bigint, score double").parquet(path).where(F.col("pmid") <= mid)


def export_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the second subgraph as a graph document, exported as CSV and read again."""
    b = nq.subs(spark, folder)[2]
    path = scratch(spark, "export")
    graph_json.write(network.strengths(b), b.select("source", "target", "cooccurrence_count"), f"{path}/graph")
    adhoc.export(spark, f"{path}/graph", path)
    return text_tables.read_csv(spark, f"{path}/edges", "source string, target string, cooccurrence_count bigint")


# ------------------------------------------------------------------------------------------------ raw tokens
def citation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Citation counts as pieces between semicolons, empty ones included."""
    return nq.raw_articles(spark, folder).select("pmid", scalars.joined_count(F.col("cited_by")).cast("bigint").alias("n"))


def plain_term_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of unqualified raw tokens, their case kept, without stop words compared with their case."""
    stop = table(spark, folder, "mesh_terms").where("mesh_stop_term").select(F.col("descriptor_name").alias("stop"))
    flat = nq.annotate_articles(spark, folder).select("pmid", F.explode(plain_terms(F.col("mesh_terms"))).alias("term"), F.lit(False).alias("qualified"))
    counts = citation_counts(spark, folder).withColumnRenamed("n", "cited_by_count")
    return network.term_statistics(vocabulary.without_stop_words(flat, "term", stop, "stop"), counts)


def ars_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Article scores in raw mode: a seed matches only a token that is equal to it, case and marks included."""
    b = nq.subs(spark, folder)[2]
    seeds = written(network.strengths(b).select(F.col("id").alias("term"), F.col("strength").cast("double").alias("strength")), "seeds")
    got = relevance.article_scores(relevance.pool_tokens(nq.cache(spark, folder), "mesh_terms", "raw"), seeds, ["strength"])
    return got.select("pmid", F.round("score_strength", 9).alias("score_strength"), "contributing_seeds")


# ------------------------------------------------------------------------------------------------ centralities, histograms
def betweenness_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """Exact betweenness inside the largest component of the second subgraph."""
    b = nq.subs(spark, folder)[2]
    return graph.betweenness(nq.lcc_graph(b))[0].select("id", F.round("betweenness", 9).alias("betweenness"))


def edge_betweenness_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    b = nq.subs(spark, folder)[2]
    return graph.betweenness(nq.lcc_graph(b))[1].select("source", "target", F.round("edge_betweenness", 9).alias("edge_betweenness"))


def sampled_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    """Betweenness of the full graph from 50 pivots only, beside the exact values: nodes and the largest difference."""
    lcc = nq.lcc_graph(nq.full_graph(spark, folder))
    rough, exact = graph.betweenness(lcc, 50, nq.FULL.seed, links=False)[0], graph.betweenness(lcc, links=False)[0]
    both = exact.join(rough.withColumnRenamed("betweenness", "rough"), "id")
    return both.agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.abs(F.col("rough") - F.col("betweenness"))).alias("max_difference"), F.corr("rough", "betweenness").alias("correlation"))


def louvain_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Modularity of the communities of the largest component, worked out from the edges and the communities alone."""
    lcc = nq.lcc_graph(nq.full_graph(spark, folder))
    c = written(graph.louvain(lcc, nq.FULL.seed), "communities")
    return graph.quality(lcc, c)


def crs_histogram_fine(spark: SparkSession, folder: str) -> DataFrame:
    return figures.histogram_even(written(nq._rounded(nq.crs_table(spark, folder)), "crs"), "crs_strength", 100)


def crs_histogram_stacked(spark: SparkSession, folder: str) -> DataFrame:
    """Ten bins over all nodes, counted by level."""
    c = figures.annotate(nq._rounded(nq.crs_table(spark, folder)).withColumnRenamed("term", "id"), nq.strata(spark, folder))
    return figures.histogram_even(written(c, "crs"), "crs_strength", 10, ["aop_level"])


def louvain_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the second subgraph by size, with their levels: what the composition figure shows."""
    members = written(graph.louvain(nq.subs(spark, folder)[2]), "communities")
    return figures.composition(figures.annotate(members, nq.strata(spark, folder)))


def figure_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the second subgraph through the graph document, renamed and with their level as figures take them."""
    b = nq.subs(spark, folder)[2]
    doc = graph_json.round_trip(network.strengths(b), b.select("source", "target", "cooccurrence_count"))
    return graph_json.figure_nodes(doc, nq.strata(spark, folder)).select("mesh_term", "degree", "strength", "aop_level")


def edge_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of a graph document as they stand: the second subgraph with every edge twice."""
    b = nq.subs(spark, folder)[2].select("source", "target", "cooccurrence_count")
    return graph_json.raw_edges(graph_json.round_trip(network.strengths(b), b.unionByName(b))).select("source", "target", "cooccurrence_count")


def embedding_table(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates of the final network's nodes with community, level and relevance."""
    points = nq.tsne_coords(spark, folder)
    c = nq._rounded(nq.crs_table(spark, folder)).select(F.col("term").alias("id"), "crs_strength", "crs_degree")
    out = points.join(graph.louvain(nq.subs(spark, folder)[2]), "id", "left").join(c, "id", "left")
    return figures.annotate(out.na.fill(-1, ["community"]), nq.strata(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        collect_articles, populate_cache, relevance_pool, search_terms, empty_log, descriptor_first, stop_word_table, csv_strata, csv_seeds, score_table, export_csv, citation_counts, plain_term_stats, ars_raw,
        betweenness_subgraph, edge_betweenness_subgraph, sampled_betweenness, louvain_quality, crs_histogram_fine, crs_histogram_stacked, louvain_sizes, figure_nodes, edge_rows, embedding_table,
    )
}

#: Shortest paths of the subgraph's largest component: walks by length, their least length and number.
_SP = """"wl" AS (SELECT id AS u, id AS v, 0 AS d, 1::DOUBLE AS c FROM lcc UNION ALL SELECT u, links.other, d + 1, sum(c) FROM wl JOIN links ON links.id = wl.v WHERE d < (SELECT max(d) FROM (SELECT u, v, min(d) AS d FROM paths GROUP BY 1, 2)) GROUP BY 1, 2, 3),
"sp" AS MATERIALIZED (SELECT u, v, d, c FROM wl QUALIFY d = min(d) OVER (PARTITION BY u, v)), "nn" AS (SELECT count(*)::DOUBLE AS n FROM lcc)"""
_COUNT = r"CASE WHEN trim(cited_by) IS NULL OR trim(cited_by) = '' OR lower(trim(cited_by)) = 'nan' THEN 0 ELSE len(string_split(cited_by, ';')) END"
_BIN = "least(floor((crs_strength - lo) / (hi - lo) * {n}), {n} - 1)::BIGINT"


def _with(extra: str, final: str, uses: str) -> str:
    """``final`` below the shared expressions that ``uses`` names, and ``extra`` ones."""
    head, _, _ = sql(f"SELECT * FROM {uses}").rpartition("\n")
    return f"{head},\n{extra}\n{final}"


ORACLES = {
    "collect_articles": sql(f"""SELECT h.pmid, h.generation, CASE WHEN a0.pmid IS NULL OR (a0.cited_by IS NULL AND a0.cites IS NULL) THEN 'failed' WHEN coalesce(a0.cited_by, '') = '' AND coalesce(a0.cites, '') = '' THEN 'empty' ELSE 'ok' END AS status, coalesce(n.n_links, 0) AS n_links
FROM (SELECT pmid, 'P0' AS generation FROM hop0 UNION ALL SELECT pmid, 'G1' FROM hop1 UNION ALL SELECT pmid, 'G2' FROM hop2) h LEFT JOIN a0 ON a0.pmid = h.pmid LEFT JOIN (SELECT pmid, count(*) AS n_links FROM cite GROUP BY 1) n ON n.pmid = h.pmid"""),
    "populate_cache": sql("SELECT pmid, CASE WHEN mesh_terms IS NULL THEN 'failed' WHEN trim(mesh_terms) = '' THEN 'empty' ELSE 'ok' END AS status, CASE WHEN mesh_terms IS NOT NULL THEN CASE WHEN trim(mesh_terms) = '' THEN 0 ELSE length(mesh_terms) END END::INTEGER AS n_chars FROM a0 WHERE pmid NOT IN (SELECT pmid FROM m0)"),
    "relevance_pool": sql("SELECT DISTINCT pmid, (SELECT count(*) FROM lev WHERE term >= 'm') AS n_second, (SELECT count(*) FROM lev) AS n_terms FROM pooltok WHERE term IN (SELECT term FROM lev)"),
    "search_terms": sql("SELECT DISTINCT trim(string_split(t, '/')[1], '*') AS query FROM (SELECT unnest(string_split(mesh_terms, ';')) AS t FROM m0)"),
    "empty_log": sql("SELECT pmid AS \"PMID\" FROM annotated WHERE trim(coalesce(mesh_terms, '')) = ''"),
    "descriptor_first": "SELECT descriptor_name, descriptor_ui FROM (SELECT *, row_number() OVER () AS pos FROM mesh_terms) WHERE descriptor_name IS NOT NULL AND descriptor_ui IS NOT NULL QUALIFY pos = min(pos) OVER (PARTITION BY descriptor_name)",
    "stop_word_table": sql("SELECT term, category FROM stopc UNION SELECT descriptor_name, 'Missing' FROM \"desc\" WHERE descriptor_name NOT IN (SELECT descriptor_name FROM cats)"),
    "csv_strata": sql("SELECT term, (['Stressor', 'Molecular', 'Cellular', 'Tissue', 'Organ', 'Adverse Outcome', 'Uncategorized'])[i] AS aop_level FROM lev"),
    "csv_seeds": "SELECT pmid, contributing_seeds FROM article_relevance_scores",
    "score_table": sql("SELECT pmid, score FROM sbest WHERE pmid <= (SELECT quantile_disc(pmid, 0.5) FROM sbest)"),
    "export_csv": sql("SELECT source, target, cooccurrence_count FROM subb"),
    "edge_rows": sql("SELECT source, target, cooccurrence_count FROM subb UNION ALL SELECT source, target, cooccurrence_count FROM subb"),
    "figure_nodes": sql("SELECT bk.id AS mesh_term, degree, strength, (['Stressor', 'Molecular', 'Cellular', 'Tissue', 'Organ', 'Adverse Outcome', 'Uncategorized'])[coalesce(i, 7)] AS aop_level FROM bk LEFT JOIN lev ON lev.term = bk.id"),
    "citation_counts": sql(f"SELECT pmid, ({_COUNT})::BIGINT AS n FROM a0"),
    "plain_term_stats": sql(f"""SELECT term, count(*) AS total_pmids, median(c)::DOUBLE AS median_citations, round(avg(c), 9) AS mean_citations, sum(c)::BIGINT AS total_citations FROM (SELECT pmid, ltrim(trim(t), '*') AS term FROM (SELECT pmid, unnest(string_split(mesh_terms, ';')) AS t FROM annotated) WHERE NOT contains(t, '/'))
JOIN (SELECT pmid, ({_COUNT})::BIGINT AS c FROM a0) USING (pmid) WHERE term <> '' AND term NOT IN (SELECT descriptor_name FROM mesh_terms WHERE mesh_stop_term AND descriptor_name IS NOT NULL) GROUP BY 1"""),
    "ars_raw": sql("SELECT pmid, round(sum(strength) / (SELECT sum(strength) FROM seeds), 9) AS score_strength, string_agg(term, ';' ORDER BY term) AS contributing_seeds FROM (SELECT DISTINCT pmid, unnest(string_split(mesh_terms, ';')) AS term FROM m0) JOIN seeds USING (term) GROUP BY 1"),
    "betweenness_subgraph": _with(_SP, "SELECT lcc.id, round(coalesce(sum(a.c * b.c / t.c), 0) / ((SELECT n FROM nn) - 1) / ((SELECT n FROM nn) - 2), 9) AS betweenness FROM lcc LEFT JOIN (sp a JOIN sp b ON a.v = b.u AND a.u <> a.v AND b.u <> b.v JOIN sp t ON t.u = a.u AND t.v = b.v AND t.d = a.d + b.d) ON a.v = lcc.id GROUP BY 1", "lcc JOIN paths ON TRUE"),
    "edge_betweenness_subgraph": _with(_SP, "SELECT source, target, round(sum(a.c * b.c / t.c) / (SELECT n * (n - 1) FROM nn), 9) AS edge_betweenness FROM (SELECT source, target, source AS x, target AS y FROM lcce UNION ALL SELECT source, target, target, source FROM lcce) e JOIN sp a ON a.v = e.x JOIN sp b ON b.u = e.y JOIN sp t ON t.u = a.u AND t.v = b.v AND t.d = a.d + b.d + 1 GROUP BY 1, 2", "lcce JOIN paths ON TRUE"),
    "crs_histogram_fine": sql(f"SELECT {_BIN.format(n=100)} AS bin, count(*) AS n FROM (SELECT crs_strength, min(crs_strength) OVER () AS lo, max(crs_strength) OVER () AS hi FROM crsr) GROUP BY 1"),
    "crs_histogram_stacked": sql(f"SELECT (['Stressor', 'Molecular', 'Cellular', 'Tissue', 'Organ', 'Adverse Outcome', 'Uncategorized'])[coalesce(i, 7)] AS aop_level, {_BIN.format(n=10)} AS bin, count(*) AS n FROM (SELECT term, crs_strength, min(crs_strength) OVER () AS lo, max(crs_strength) OVER () AS hi FROM crsr) c LEFT JOIN lev ON lev.term = c.term GROUP BY 1, 2"),
}
