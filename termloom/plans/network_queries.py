"""Queries of the network engine over the article feeds, with the SQL that checks them.

The base tables: ``articles`` are the first rows per pmid of ``pmids_table``, annotated from the first rows of
``master_mesh_annotations``; tokens are the values of their packed headings; stop words come from ``mesh_terms``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.config import Config
from termloom.functions import scalars
from termloom.functions.terms import heading_of, parse_terms
from termloom.operators import figures, graph, ingest, network, relevance, sampler, vocabulary
from termloom.operators.packed import packed_lists
from termloom.plans.network_sql import ORACLES  # noqa: F401
from termloom.session import written
from termloom.sources import graph_json, search
from termloom.sources.tables import table, validate_columns

#: Edges of the extracted subgraphs and the weight their likelihood is linearised at.
SUB_EDGES, SUB_TOTAL = 500, 1000.0
#: Pivots and seed of betweenness, and the rest of a full run's settings.
FULL = Config()


# ------------------------------------------------------------------------------------------------ base tables
def raw_articles(spark: SparkSession, folder: str) -> DataFrame:
    t = validate_columns(table(spark, folder, "pmids_table"), ["pmid", "record_no", "generation", "cited_by", "cites", "mesh_terms"])
    return ingest.first_rows(t, "pmid", "record_no", ["generation", "cited_by", "cites", "mesh_terms"])


def cache(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.first_rows(table(spark, folder, "master_mesh_annotations"), "pmid", "record_no", ["mesh_terms"])


def annotate_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of the articles, null and empty ones filled from the annotation cache."""
    return ingest.annotate(raw_articles(spark, folder).select("pmid", "mesh_terms"), cache(spark, folder), "pmid", "mesh_terms")


def load_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with generation number and weight and their citation count."""
    a = raw_articles(spark, folder)
    counted = packed_lists(a.select("pmid", "generation", "cited_by"), "cited_by", "numbers", ["pmid", "generation"])
    return counted.select("pmid", scalars.generation_number(F.col("generation")).alias("generation_no"), F.round(scalars.generation_weight(F.col("generation")), 9).alias("generation_weight"), F.greatest(F.size("vals"), F.lit(0)).cast("bigint").alias("cited_by_count"))


def stop_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mesh_terms").where("mesh_stop_term").select(F.lower("descriptor_name").alias("stop")).distinct()


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``pmid, term, is_major, qualified``: the tokens of the articles without stop words."""
    lists = packed_lists(annotate_articles(spark, folder), "mesh_terms", "terms", ["pmid"])
    flat = lists.select("pmid", F.explode("vals").alias("token"))
    flat = flat.select("pmid", heading_of(F.col("token")).alias("term"), F.col("token").startswith("*").alias("is_major"), F.contains("token", F.lit("/")).alias("qualified"))
    return vocabulary.without_stop_words(flat.where(F.col("term").isNotNull()), "term", stop_words(spark, folder), "stop")


def base(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles with normalised counts, tokens, bags), written once."""
    toks = written(tokens(spark, folder), "tokens")
    arts = written(network.normalise_articles(load_articles(spark, folder)), "articles")
    return arts, toks, network.article_terms(toks)


def edges_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    arts, toks, bags = base(spark, folder)
    return arts, toks, bags, written(network.cooccurrence_edges(bags, arts), "edges")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return written(network.scored_edges(edges_of(spark, folder)[3]), "scored")


def sub_a(s: DataFrame) -> DataFrame:
    return network.best_edges(s, SUB_EDGES, SUB_TOTAL)


def sub_b(s: DataFrame) -> DataFrame:
    """Edges with the largest count times log ratio to the expected count."""
    w = F.col("cooccurrence_count").cast("double")
    info = F.round(w * F.ln(w / (F.col("t") * F.col("p"))), 6)
    return s.withColumn("info", info).orderBy(F.desc("info"), "source", "target").limit(SUB_EDGES)


def subs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = scored(spark, folder)
    return s, written(sub_a(s), "sub-a"), written(sub_b(s), "sub-b")


def consensus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("source", "target"), ["source", "target"], "left_semi")


# ------------------------------------------------------------------------------------------------ sources, sinks
def scan_project(spark: SparkSession, folder: str) -> DataFrame:
    """Projection with a pushed filter."""
    return table(spark, folder, "pmids_table").where(F.col("generation") == "G2").select("record_no", "pmid")


def descriptor_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.dedupe_descriptors(table(spark, folder, "mesh_terms"), "descriptor_name", "descriptor_ui")


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """Invented tree numbers: a letter from the identifier; every seventh descriptor has none, some have a second."""
    d = descriptor_dedup(spark, folder).withColumn("n", F.try_to_number(F.substring("descriptor_ui", 2, 12), F.lit("999999999999")).cast("bigint"))
    letter = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNVZ"), (n % 16 + 1).cast("int"), 1)
    some = d.where(F.col("n") % 7 != 0)
    one = some.select("descriptor_name", F.concat(letter(F.col("n")), F.lit("01.100")).alias("mn"))
    two = some.where(F.col("n") % 5 == 0).select("descriptor_name", F.lit("g02.3").alias("mn"))
    return one.unionByName(two)


def tree_categories(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.categories(tree(spark, folder), "descriptor_name", "mn").select("descriptor_name", F.array_join("categories", "").alias("letters"))


def stopword_classify(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.classify_stop_words(vocabulary.categories(tree(spark, folder), "descriptor_name", "mn"), "descriptor_name")


def stopword_orphans(spark: SparkSession, folder: str) -> DataFrame:
    cats = vocabulary.categories(tree(spark, folder), "descriptor_name", "mn")
    return vocabulary.orphans(descriptor_dedup(spark, folder), cats, "descriptor_name", ["Holonax Assay", "Velarmic Assay"])


def stopword_tag(spark: SparkSession, folder: str) -> DataFrame:
    stop = stopword_classify(spark, folder).select(F.upper("term").alias("term"))
    return vocabulary.tag_stop_words(descriptor_dedup(spark, folder), "descriptor_name", stop, "term")


def citation_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the articles of generation G1 joined with the generation of the linked article."""
    a = raw_articles(spark, folder)
    links = citation_links(spark, folder)
    roots = a.where(scalars.generation_number(F.col("generation")) == 1).select("pmid")
    known = a.select(F.col("pmid").alias("child"), scalars.generation_label(scalars.generation_number(F.col("generation"))).alias("child_generation"))
    return links.join(roots, "pmid").join(known, "child", "left").select("pmid", "child", "child_generation")


def citation_links(spark: SparkSession, folder: str) -> DataFrame:
    a = raw_articles(spark, folder)
    parts = [packed_lists(a.select("pmid", f), f, "numbers", ["pmid"]).select("pmid", F.explode("vals").alias("child")) for f in ("cited_by", "cites")]
    return parts[0].unionByName(parts[1]).select("pmid", F.col("child").cast("bigint").alias("child")).distinct()


def missing_pmids(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.missing(table(spark, folder, "pmids_table"), table(spark, folder, "master_mesh_annotations"), "pmid")


def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """The cache of the earlier half of the feed with the rest inserted where absent."""
    m = table(spark, folder, "master_mesh_annotations").select("record_no", "pmid", "mesh_terms")
    half = m.agg(F.max("record_no")).scalar() / 2
    old = ingest.first_rows(m.where(F.col("record_no") <= half), "pmid", "record_no", ["record_no", "mesh_terms"])
    return ingest.insert_ignore(old, m.where(F.col("record_no") > half), "pmid", F.col("record_no"))


def prune_generations(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.prune_generations(raw_articles(spark, folder), "generation", 2).select("pmid", "generation")


def citation_expand(spark: SparkSession, folder: str) -> DataFrame:
    a = raw_articles(spark, folder)
    roots = a.where(scalars.generation_number(F.col("generation")) == 0).select("pmid")
    return ingest.citation_expand(roots, written(citation_links(spark, folder), "citations"), 3)


def date_bisect(spark: SparkSession, folder: str) -> DataFrame:
    """Date ranges that each hold at most a twentieth of the articles, unless they are a single day."""
    days = table(spark, folder, "pmids_table").groupBy(F.to_date("fetched_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    rows = [(r["day"], r["n"]) for r in days.collect()]  # one row per day
    ranges = search.bisect_days(rows, max(1, sum(n for _, n in rows) // 20))
    return spark.createDataFrame(ranges, "first date, last date, n long, over boolean")


# ------------------------------------------------------------------------------------------------ scalars
def parse_terms_query(spark: SparkSession, folder: str) -> DataFrame:
    """Names, types and major marks of the raw ``;``-joined tokens of the annotation feed."""
    t = table(spark, folder, "master_mesh_annotations")
    flat = t.select("record_no", F.posexplode(parse_terms(F.col("mesh_terms"))).alias("at", "s"))
    return flat.select("record_no", "at", F.col("s")["name"].alias("name"), F.col("s")["type"].alias("type"), F.col("s")["is_major"].alias("is_major"))


def generation_weight(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "df").select("row_id", F.round(scalars.generation_weight(F.col("generation")), 9).alias("w"), scalars.generation_label(scalars.generation_number(F.col("generation"))).alias("label"))


def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Days written in five ways and read again."""
    d = table(spark, folder, "documents").select("doc_id", F.to_date("added_at").alias("day"))
    forms = F.element_at(F.array(F.date_format("day", "yyyy/M/d"), F.date_format("day", "yyyy-MM-dd"), F.date_format("day", "yyyy/MM"), F.date_format("day", "yyyy-M"), F.date_format("day", "yyyy"), F.lit("soon")), (F.col("doc_id") % 6 + 1).cast("int"))
    parsed = d.select("doc_id", "day", scalars.parse_date(forms).alias("parsed"))
    return parsed.select("doc_id", "parsed", scalars.search_date(F.col("parsed")).alias("written"), scalars.midpoint(F.col("parsed"), F.col("day")).alias("middle"))


# ------------------------------------------------------------------------------------------------ network
def term_citation_stats(spark: SparkSession, folder: str) -> DataFrame:
    arts, toks, _ = base(spark, folder)
    r = network.rank_terms(network.term_statistics(toks, arts))
    return r.select("term", "total_pmids", "median_citations", "mean_citations", "total_citations", *[F.round(f"rank_{c}", 9).alias(f"rank_{c}") for c in ("total_pmids", "median_citations", "mean_citations", "total_citations")])


def article_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder)[0].select("pmid", "cited_by_count", F.round("normalized_cited_by", 9).alias("normalized_cited_by"))


def cooccurrence_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)[3]
    return e.select("source", "target", "cooccurrence_count", F.round("cumulative_weight", 6).alias("cumulative_weight"))


def node_strengths(spark: SparkSession, folder: str) -> DataFrame:
    return network.strengths(edges_of(spark, folder)[3])


def degree(spark: SparkSession, folder: str) -> DataFrame:
    return node_strengths(spark, folder).select("id", "degree")


def edge_loglik(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("source", "target", "loglik")


def edge_significance(spark: SparkSession, folder: str) -> DataFrame:
    return network.significance(scored(spark, folder)).select("source", "target", F.round("mlf_p_value", 5).alias("mlf_p_value"), F.round("mlf_log10_p", 5).alias("mlf_log10_p"))


def edge_table(spark: SparkSession, folder: str) -> DataFrame:
    _, _, bags, e = edges_of(spark, folder)
    t = network.edge_table(written(network.scored_edges(e, bags), "scored"))
    return t.select("source", "target", "cooccurrence_count", F.round("cumulative_weight_original", 6).alias("cumulative_weight_original"), *[F.round(c, 6).alias(c) for c in ("weight", "normalized_cooccurrence", "log1p_cooccurrence_minmax")], F.round("mlf_p_value", 5).alias("mlf_p_value"))


def node_table(spark: SparkSession, folder: str) -> DataFrame:
    arts, toks, bags, e = edges_of(spark, folder)
    t = network.node_table(bags, arts, network.term_statistics(toks, arts), e)
    ints = ("article_count", "degree")
    return t.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c).cast("bigint").alias(c) if c in ints else c for c, k in t.dtypes])


def loglik_topk(spark: SparkSession, folder: str) -> DataFrame:
    return sub_a(scored(spark, folder)).select("source", "target", "cooccurrence_count")


# ------------------------------------------------------------------------------------------------ subgraphs
def consensus_edges(spark: SparkSession, folder: str) -> DataFrame:
    _, a, b = subs(spark, folder)
    return consensus(a, b).select("source", "target")


def full_graph(spark: SparkSession, folder: str) -> DataFrame:
    """All co-occurrence edges, uncut."""
    return edges_of(spark, folder)[3]


def lcc_graph(e: DataFrame) -> DataFrame:
    """The edges of the largest component of ``e``."""
    return written(graph.induced(e, written(graph.largest_component(graph.components(e)), "lcc")), "lcc-edges")


def components_query(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(full_graph(spark, folder))


def lcc_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.largest_component(graph.components(full_graph(spark, folder)))


def lcc_edges(spark: SparkSession, folder: str) -> DataFrame:
    return lcc_graph(full_graph(spark, folder)).select("source", "target")


def lcc_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-ins where centralities are switched off: 1.0 inside the largest component, else 0.0."""
    labels = written(graph.components(full_graph(spark, folder)), "labels")
    inside = graph.largest_component(labels).withColumn("one", F.lit(1.0))
    v = F.coalesce(F.col("one"), F.lit(0.0))
    return labels.select("id").join(inside, "id", "left").select("id", v.alias("betweenness_centrality"), v.alias("eigenvector_centrality"), F.lit(0.0).alias("clustering_coefficient"), F.lit(-1).alias("community"))


def induced_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """All edges among the nodes of the consensus."""
    s, a, b = subs(spark, folder)
    return graph.induced(s, written(graph.endpoints(consensus(a, b)), "ends")).select("source", "target", "cooccurrence_count")


def triangles(spark: SparkSession, folder: str) -> DataFrame:
    return graph.triangles(full_graph(spark, folder))


def clustering_coefficient(spark: SparkSession, folder: str) -> DataFrame:
    return graph.clustering(full_graph(spark, folder)).select("id", "degree", "n_triangles", F.round("clustering", 9).alias("clustering"))


def shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Inside the largest component of the second subgraph: the distances the embedding of the final network is drawn from."""
    b = subs(spark, folder)[2]
    return graph.shortest_paths(graph.induced(b, written(graph.largest_component(graph.components(b)), "lcc")))


def betweenness(spark: SparkSession, folder: str) -> DataFrame:
    """Of every node of the full graph, from pivots inside its largest component; 0.0 outside."""
    e = full_graph(spark, folder)
    found = graph.betweenness(lcc_graph(e), FULL.pivots, FULL.seed, links=False)[0]
    return graph.endpoints(e).join(found, "id", "left").na.fill(0.0, ["betweenness"])


def edge_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    """Of every edge of the full graph, from pivots inside its largest component; 0.0 outside."""
    e = full_graph(spark, folder)
    found = graph.betweenness(lcc_graph(e), FULL.pivots, FULL.seed)[1]
    return e.select("source", "target").join(found, ["source", "target"], "left").na.fill(0.0, ["edge_betweenness"])


def eigenvector(spark: SparkSession, folder: str) -> DataFrame:
    """Of every node of the full graph, iterated inside its largest component; 0.0 outside."""
    e = full_graph(spark, folder)
    found = graph.eigenvector(lcc_graph(e)).select("id", F.round("eigenvector", 9).alias("eigenvector"))
    return graph.endpoints(e).join(found, "id", "left").na.fill(0.0, ["eigenvector"])


def louvain(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the largest component of the full graph; nodes outside -1."""
    e = full_graph(spark, folder)
    found = graph.louvain(lcc_graph(e), FULL.seed)
    return graph.endpoints(e).join(found, "id", "left").na.fill(-1, ["community"])


def glf_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    return sampler.subgraph(scored(spark, folder), "glf", FULL.target_edges, FULL.iterations, FULL.chains, FULL.seed)


def sa_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    return sampler.subgraph(scored(spark, folder), "sa", FULL.target_edges, FULL.iterations, FULL.chains, FULL.seed, FULL.temperature, FULL.cooling)


def sampler_trajectory(spark: SparkSession, folder: str) -> DataFrame:
    s = scored(spark, folder)
    glf = sampler.trajectory(s, "glf", FULL.target_edges, FULL.iterations, seed=FULL.seed)
    return glf.unionByName(sampler.trajectory(s, "sa", FULL.target_edges, FULL.iterations, seed=FULL.seed, start=FULL.temperature, cooling=FULL.cooling))


def communities(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(second subgraph, its members with component numbers by size): the deterministic stand-in for communities."""
    b = subs(spark, folder)[2]
    return b, written(graph.renumbered(graph.components(b), "component").select("id", "component", F.col("community").cast("bigint").alias("community")), "members")


def community_rank(spark: SparkSession, folder: str) -> DataFrame:
    m = communities(spark, folder)[1]
    return m.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def component_report(spark: SparkSession, folder: str) -> DataFrame:
    """The five components after the largest with their node of highest betweenness in the full graph, of equals the smallest id."""
    m = communities(spark, folder)[1].where((F.col("community") > 1) & (F.col("community") <= 6))
    k = m.select("id", "community").join(betweenness(spark, folder).select("id", F.round("betweenness", 9).alias("betweenness")), "id")
    best = k.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("betweenness")).alias("b"), "id")).alias("top"))
    return best.select("community", "n", F.col("top.id").alias("top_node"))


def component_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """The five components after the largest with their node of highest weighted degree."""
    b, m = communities(spark, folder)
    return top_nodes(b, m).where((F.col("community") > 1) & (F.col("community") <= 6)).select("community", "n", F.col("id").alias("top_node"))


def top_nodes(b: DataFrame, m: DataFrame) -> DataFrame:
    """``community, n, id``: size and node of highest weighted degree, of equals the smallest id."""
    k = m.select("id", "community").join(network.strengths(b), "id")
    best = k.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.max("strength").alias("strength"))
    return k.join(best, ["community", "strength"]).groupBy("community", "n").agg(F.min("id").alias("id"))


def strata(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.strata(table(spark, folder, "aop_annotations_master"), heading_of(F.col("mesh_term")), "aop_level")


def annotate_strata(spark: SparkSession, folder: str) -> DataFrame:
    b = subs(spark, folder)[2]
    return figures.annotate(graph.endpoints(b), strata(spark, folder))


def community_composition(spark: SparkSession, folder: str) -> DataFrame:
    m = figures.annotate(communities(spark, folder)[1], strata(spark, folder))
    c = figures.composition(m)
    return c.select("community", *[F.col(f"`{x}`").alias(x.lower().replace(" ", "_")) for x in vocabulary.LEVELS], "total")


def community_label(spark: SparkSession, folder: str) -> DataFrame:
    b, m = communities(spark, folder)
    named = figures.annotate(top_nodes(b, m), strata(spark, folder))
    return named.select("community", F.concat(F.col("community").cast("string"), F.lit(": "), "id", F.lit(" ("), "aop_level", F.lit(")")).alias("label"))


def alluvial_flows(spark: SparkSession, folder: str) -> DataFrame:
    levels = strata(spark, folder).select(F.col("term").alias("id"), vocabulary.level_index(F.col("aop_level")).alias("i"))
    return figures.flows(scored(spark, folder), levels)


def edge_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by bins of 25: all edges beside the first subgraph."""
    s, a, _ = subs(spark, folder)
    h = figures.histogram_fixed(s, "cooccurrence_count", 25).withColumn("part", F.lit("before"))
    return h.unionByName(figures.histogram_fixed(a, "cooccurrence_count", 25).withColumn("part", F.lit("after")))


def subgraph_overlap(spark: SparkSession, folder: str) -> DataFrame:
    _, a, b = subs(spark, folder)
    e = figures.overlap(a, b, ["source", "target"]).withColumn("part", F.lit("edges"))
    n = figures.overlap(graph.endpoints(a), graph.endpoints(b), ["id"]).withColumn("part", F.lit("nodes"))
    return e.unionByName(n).select("part", "n_a", "n_b", "n_both", F.round("jaccard", 9).alias("jaccard"), F.round("f1", 9).alias("f1"))


def subgraph_metrics(spark: SparkSession, folder: str) -> DataFrame:
    c = graph.clustering(subs(spark, folder)[2])
    n, m = F.count(F.lit(1)), F.sum("degree") / 2
    return c.agg(n.alias("n_nodes"), m.cast("bigint").alias("n_edges"), F.round(2.0 * m / (n * (n - 1)), 9).alias("density"), F.round(F.avg("clustering"), 9).alias("average_clustering"))


def retention_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges left after each stage: full graph, subgraph, its largest component, consensus."""
    s, a, b = subs(spark, folder)
    lcc = graph.induced(b, written(graph.largest_component(graph.components(b)), "lcc"))
    stages = [("1 full", s), ("2 subgraph", b), ("3 component", lcc), ("4 consensus", consensus(a, b))]
    rows = None
    for name, e in stages:
        one = graph.both_ways(e.select("source", "target")).agg(F.lit(name).alias("stage"), F.count_distinct("id").alias("n_nodes"), (F.count(F.lit(1)) / 2).cast("bigint").alias("n_edges"))
        rows = one if rows is None else rows.unionByName(one)
    out = figures.cascade(figures.cascade(rows, "stage", "n_nodes").withColumnRenamed("retained", "nodes_retained"), "stage", "n_edges")
    return out.select("stage", "n_nodes", "n_edges", F.round("nodes_retained", 9).alias("nodes_retained"), F.round("retained", 9).alias("edges_retained"))


# ------------------------------------------------------------------------------------------------ relevance
def tokens_of(articles: DataFrame) -> DataFrame:
    """``pmid, term``: distinct headings of annotated articles."""
    return relevance.pool_tokens(articles, "mesh_terms", "heading")


def scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds of the second subgraph with strength and degree, heading tokens of the annotation pool, article scores)."""
    b = subs(spark, folder)[2]
    seeds = written(network.strengths(b).select(F.col("id").alias("term"), F.col("strength").cast("double").alias("strength"), F.col("degree").cast("double").alias("degree")), "seeds")
    toks = written(tokens_of(cache(spark, folder)), "pool")
    return seeds, toks, written(relevance.article_scores(toks, seeds, ["strength", "degree"]), "scores")


def _out(s: DataFrame) -> DataFrame:
    return s.select("pmid", F.round("score_strength", 9).alias("score_strength"), F.round("score_degree", 9).alias("score_degree"), "contributing_seeds")


def ars_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _out(scores(spark, folder)[2])


def crs_table(spark: SparkSession, folder: str) -> DataFrame:
    seeds, toks, s = scores(spark, folder)
    return relevance.term_scores(toks, s, ["strength", "degree"], seeds).join(seeds, "term")


def crs_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every node of the subgraph; nodes without article 0.0."""
    seeds, toks, s = scores(spark, folder)
    c = relevance.term_scores(toks, s, ["strength", "degree"], seeds)
    return seeds.select("term").join(c, "term", "left").select("term", F.round(F.coalesce("CRS_strength", F.lit(0.0)), 6).alias("crs_strength"), F.round(F.coalesce("CRS_degree", F.lit(0.0)), 6).alias("crs_degree"))


def _score_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The given score table: every scored row with its own list of seeds."""
    t = table(spark, folder, "article_relevance_scores").where(F.col("score_betweenness_centrality").isNotNull() & ~F.isnan("score_betweenness_centrality"))
    return t.select("pmid", F.col("score_betweenness_centrality").alias("score"), "contributing_seeds")


def _once(rows: DataFrame, best: DataFrame) -> DataFrame:
    """``rows`` once per article: the article's highest score in ``best``, and its first list of seeds in code-point order."""
    return rows.groupBy("pmid").agg(F.min("contributing_seeds").alias("contributing_seeds")).join(best, "pmid").select("pmid", "score", "contributing_seeds")


def _best_scores(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pmid").agg(F.max("score").alias("score"))


def node_articles(spark: SparkSession, folder: str) -> DataFrame:
    rows = _score_rows(spark, folder)
    return _once(relevance.node_articles(rows, "assay", "score", like=True), _best_scores(rows)).orderBy(F.desc("score"), "pmid").limit(20)


def node_articles_exact(spark: SparkSession, folder: str) -> DataFrame:
    rows = _score_rows(spark, folder)
    return _once(relevance.node_articles(rows, "Quinanax Assay", "score"), _best_scores(rows))


def edge_articles(spark: SparkSession, folder: str) -> DataFrame:
    rows = _score_rows(spark, folder)
    ends = [relevance.node_articles(rows, x, "score", like=True) for x in ("quinanax assay", "messenger")]
    both = ends[0].join(ends[1].select("pmid").distinct(), "pmid", "left_semi")
    return _once(both, _best_scores(rows)).orderBy(F.desc("score"), "pmid").limit(20)


def top_articles(spark: SparkSession, folder: str) -> DataFrame:
    rows = _score_rows(spark, folder)
    return relevance.top_articles(_once(rows, _best_scores(rows)), "score", 20)


def _rounded(c: DataFrame) -> DataFrame:
    return c.select("term", "strength", "degree", F.round("CRS_strength", 6).alias("crs_strength"), F.round("CRS_degree", 6).alias("crs_degree"))


def top_nodes_joint(spark: SparkSession, folder: str) -> DataFrame:
    """The five best nodes by either score, one list after the other; a node may stand in both."""
    c = written(_rounded(crs_table(spark, folder)), "crs")
    return c.orderBy(F.desc("crs_strength"), "term").limit(5).withColumn("by", F.lit("strength")).unionByName(c.orderBy(F.desc("crs_degree"), "term").limit(5).withColumn("by", F.lit("degree")))


def crs_gap_top20(spark: SparkSession, folder: str) -> DataFrame:
    c = _rounded(crs_table(spark, folder)).withColumn("gap", F.round(F.abs(F.col("crs_strength") - F.col("crs_degree")), 6))
    return c.orderBy(F.desc("gap"), "term").limit(20).select("term", "crs_strength", "crs_degree", "gap").orderBy("crs_strength", "term")


def crs_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return figures.histogram_even(written(_rounded(crs_table(spark, folder)), "crs"), "crs_strength", 10)


def scatter_fit(spark: SparkSession, folder: str) -> DataFrame:
    c = crs_table(spark, folder).withColumnRenamed("term", "id")
    f = figures.linear_fit(figures.annotate(c, strata(spark, folder)), "aop_level", "strength", "CRS_strength")
    return f.select("aop_level", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def scatter_panel(spark: SparkSession, folder: str) -> DataFrame:
    c = _rounded(crs_table(spark, folder))
    return c.where((F.col("strength") > 0) & (F.col("crs_strength") > 0)).select("term", "strength", "crs_strength")


def nb_dispersion(spark: SparkSession, folder: str) -> DataFrame:
    return figures.negative_binomial(scored(spark, folder), "cooccurrence_count")


# ------------------------------------------------------------------------------------------------ exports, embeddings
def export_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the second subgraph, through the interchange document and back."""
    b = subs(spark, folder)[2]
    return graph_json.nodes(graph_json.round_trip(network.strengths(b), b.select("source", "target", "cooccurrence_count")))


def export_edges(spark: SparkSession, folder: str) -> DataFrame:
    b = subs(spark, folder)[2]
    return graph_json.edges(graph_json.round_trip(network.strengths(b), b.select("source", "target", "cooccurrence_count")))


def graph_json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    b = subs(spark, folder)[2]
    doc = graph_json.round_trip(network.strengths(b), b.select("source", "target", "cooccurrence_count"))
    return doc.select(F.size("elements.nodes").alias("n_nodes"), F.size("elements.edges").alias("n_edges"))


def tsne_coords(spark: SparkSession, folder: str) -> DataFrame:
    return figures.tsne_coords(shortest_paths(spark, folder))


def community_hulls(spark: SparkSession, folder: str) -> DataFrame:
    points = tsne_coords(spark, folder)
    return figures.convex_hulls(points.join(graph.louvain(subs(spark, folder)[2]), "id"), "community")


def node_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return figures.node_vectors(subs(spark, folder)[2])


def ward_linkage(spark: SparkSession, folder: str) -> DataFrame:
    return figures.ward_linkage(node_vectors(spark, folder))


_NAMES = {"parse_terms_query": "parse_terms", "components_query": "components"}
QUERIES = {
    _NAMES.get(f.__name__, f.__name__): f
    for f in (
        scan_project, load_articles, annotate_articles, descriptor_dedup, tree_categories, stopword_classify, stopword_orphans, stopword_tag, citation_lookup, missing_pmids, insert_ignore, prune_generations, citation_expand, date_bisect,
        parse_terms_query, generation_weight, parse_dates, term_citation_stats, article_ranks, cooccurrence_edges, node_strengths, degree, edge_loglik, edge_significance, edge_table, node_table, loglik_topk,
        consensus_edges, components_query, lcc_nodes, lcc_edges, lcc_flags, induced_subgraph, triangles, clustering_coefficient, shortest_paths, betweenness, edge_betweenness, eigenvector, louvain, glf_subgraph, sa_subgraph, sampler_trajectory,
        community_rank, component_report, component_degrees, annotate_strata, community_composition, community_label, alluvial_flows, edge_histogram, subgraph_overlap, subgraph_metrics, retention_cascade,
        ars_scores, crs_scores, node_articles, node_articles_exact, edge_articles, top_articles, top_nodes_joint, crs_gap_top20, crs_histogram, scatter_fit, scatter_panel, nb_dispersion,
        export_nodes, export_edges, graph_json_roundtrip, tsne_coords, community_hulls, node_vectors, ward_linkage,
    )
}
