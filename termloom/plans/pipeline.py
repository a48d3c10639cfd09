"""The whole run as stages: ``python -m termloom.plans.pipeline TABLES OUT``.

Every stage writes Parquet below OUT and is skipped where a finished output (``_SUCCESS``) is found, so a run that was cut
short goes on where it stopped.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.config import Config
from termloom.functions import scalars
from termloom.functions.terms import heading_of
from termloom.operators import graph, ingest, network, relevance, sampler, vocabulary
from termloom.operators.packed import packed_lists
from termloom.plans import collection
from termloom.session import exists, written
from termloom.sources import graph_json
from termloom.sources.tables import table


class Stages:
    """Outputs by name below one folder; each is made once."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.made = spark, out.rstrip("/"), []

    def exists(self, path: str) -> bool:
        return exists(self.spark, path)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.out}/{name}"
        if not self.exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)

    def ledger(self, name: str, progress: str, schema: str, progress_schema: str, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
        """A result that grows with what was processed: ``step(result, processed)`` gives both anew; stored as a new version of each.

        The version that was finished last counts, so a run cut short goes on from it.
        """
        paths = [f"{self.out}/{name}", f"{self.out}/{progress}"]
        last = max((v for v in range(1000) if all(self.exists(f"{p}/v{v}/_SUCCESS") for p in paths)), default=None) if any(self.exists(p) for p in paths) else None
        old = [self.spark.createDataFrame([], x) if last is None else self.spark.read.parquet(f"{p}/v{last}") for p, x in zip(paths, (schema, progress_schema), strict=True)]
        new = step(*old)
        if last is not None and new[1].count() == old[1].count():
            return old[0], old[1]
        at = 0 if last is None else last + 1
        for df, p in zip(new, paths, strict=True):
            df.write.mode("overwrite").parquet(f"{p}/v{at}")
        self.made.append(name)
        return self.spark.read.parquet(f"{paths[0]}/v{at}"), self.spark.read.parquet(f"{paths[1]}/v{at}")

    def id_log(self, ids: DataFrame, name: str) -> None:
        """One id per line below the header PMID; no file when there are none."""
        if not ids.isEmpty():
            ids.select(F.col(ids.columns[0]).alias("PMID")).write.mode("overwrite").option("sep", "\t").csv(f"{self.out}/logs/{name}", header=True)


def centralities(edges: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    """(``id`` with betweenness, eigenvector and community of the largest component; ``source, target, edge_betweenness``)."""
    lcc = written(graph.largest_component(graph.components(edges)), "lcc")
    inside = graph.induced(edges, lcc)
    if not c.full_centrality:
        one = lcc.select("id", F.lit(1.0).alias("betweenness_centrality"), F.lit(1.0).alias("eigenvector_centrality"), F.lit(-1).alias("community"))
        return one, inside.select("source", "target", F.lit(1.0).alias("edge_betweenness"))
    nodes, links = graph.betweenness(inside, c.pivots, c.seed)
    out = nodes.withColumnRenamed("betweenness", "betweenness_centrality").join(graph.eigenvector(inside).select("id", F.col("eigenvector").alias("eigenvector_centrality")), "id")
    return out.join(graph.louvain(inside, c.seed), "id"), links


@dataclass(frozen=True)
class Sources:
    """Where a run gets what its tables lack; what is None is looked up in the tables themselves."""

    search: collection.TermSearch | None = None
    annotations: collection.Annotations | None = None
    links: collection.Links | None = None


def run(spark: SparkSession, folder: str, out: str, c: Config | None = None, sources: Sources | None = None, roots: DataFrame | None = None) -> Stages:
    """All stages from the tables of ``folder`` to the scored network below ``out``.

    With ``roots(pmid)`` the articles are collected from these through citations (``c.generations`` of them), their links looked up
    by ``sources.links`` or in the table of articles; without, the table of articles is taken as it is.
    """
    c, sources = c or Config(), sources or Sources()
    s = Stages(spark, out)
    feed = ingest.first_rows(table(spark, folder, "pmids_table"), "pmid", "record_no", ["generation", "cited_by", "cites", "mesh_terms"])
    cache = ingest.first_rows(table(spark, folder, "master_mesh_annotations"), "pmid", "record_no", ["mesh_terms"])
    if roots is not None:
        links = sources.links or collection.stored_links(feed.select("pmid", "cited_by", "cites"))
        got = s.table("collected", lambda: collection.collect_articles(roots, links, c.generations))
        feed = got.drop("status").join(feed.select("pmid", "mesh_terms"), "pmid", "left")
    if c.prune_from is not None:
        feed = ingest.prune_generations(feed, "generation", c.prune_from)
    arts0 = s.table("annotated", lambda: ingest.annotate(feed, cache, "pmid", "mesh_terms"))
    s.id_log(ingest.missing(arts0, cache, "pmid"), "not_annotated")

    def articles() -> DataFrame:
        counted = packed_lists(arts0.select("pmid", "generation", "cited_by"), "cited_by", "numbers", ["pmid", "generation"])
        g = F.col("generation")
        a = counted.select("pmid", scalars.generation_number(g).alias("generation_no"), scalars.generation_weight(g, c.decay).alias("generation_weight"), F.greatest(F.size("vals"), F.lit(0)).cast("bigint").alias("cited_by_count"))
        return network.normalise_articles(a)

    def tokens(source: DataFrame) -> DataFrame:
        t = packed_lists(source, "mesh_terms", "terms", ["pmid"]).select("pmid", F.explode("vals").alias("t"))
        return t.select("pmid", heading_of(F.col("t")).alias("term"), F.col("t").startswith("*").alias("is_major"), F.contains("t", F.lit("/")).alias("qualified")).where(F.col("term").isNotNull())

    stop = table(spark, folder, "mesh_terms").where("mesh_stop_term").select(F.lower("descriptor_name").alias("stop"))
    arts = s.table("articles", articles)
    toks = s.table("tokens", lambda: vocabulary.without_stop_words(tokens(arts0), "term", stop, "stop"))
    bags = network.article_terms(toks)
    edges = s.table("edges_raw", lambda: network.cooccurrence_edges(bags, arts))
    scored = s.table("edges_scored", lambda: network.scored_edges(edges, bags))

    @lru_cache(None)
    def full_network() -> tuple[DataFrame, DataFrame]:
        per_node, per_edge = centralities(edges, c)
        nodes = network.node_table(bags, arts, network.term_statistics(toks, arts), edges).join(per_node, "id", "left").join(graph.clustering(edges).select("id", F.col("clustering").alias("clustering_coefficient")), "id", "left")
        nodes = nodes.na.fill(0.0, ["betweenness_centrality", "eigenvector_centrality", "clustering_coefficient"]).na.fill(-1, ["community"])
        links = network.edge_table(scored).join(per_edge, ["source", "target"], "left").na.fill(0.0, ["edge_betweenness"])
        return nodes, links

    nodes = s.table("nodes", lambda: full_network()[0])
    links = s.table("edges", lambda: full_network()[1])
    glf = s.table("glf", lambda: sampler.subgraph(scored, "glf", c.target_edges, c.iterations, c.chains, c.seed))
    sa = s.table("sa", lambda: sampler.subgraph(scored, "sa", c.target_edges, c.iterations, c.chains, c.seed, c.temperature, c.cooling))
    both = glf.select("source", "target").join(sa.select("source", "target"), ["source", "target"], "left_semi")
    core = s.table("consensus_edges", lambda: graph.induced(links.join(both, ["source", "target"], "left_semi"), graph.largest_component(graph.components(both))))
    members = s.table("communities", lambda: graph.louvain(core, c.seed))
    seeds = nodes.join(members.select("id"), "id", "left_semi").select(F.col("id").alias("term"), "betweenness_centrality", "eigenvector_centrality")
    weights = ["betweenness_centrality", "eigenvector_centrality"]
    stored = relevance.pool_tokens(cache, "mesh_terms", "heading")
    search = sources.search or (lambda terms: terms.join(stored.withColumnRenamed("term", "query"), "query").select("term", "pmid"))
    pooled, processed = s.ledger("pool", "processed_terms", "pmid bigint", "term string", lambda pool, done: collection.extend_pool(pool, done, seeds.select("term"), search))

    @lru_cache(None)
    def populated() -> tuple[DataFrame, DataFrame]:
        return collection.populate_cache(cache, pooled, sources.annotations or collection.stored_annotations(arts0.select("pmid", "mesh_terms")))

    known, log = s.table("annotation_cache", lambda: populated()[0]), s.table("annotation_log", lambda: populated()[1])
    for status in ("failed", "empty"):
        s.id_log(log.where(F.col("status") == status).select("pmid"), status)
    pool = s.table("pool_tokens", lambda: relevance.pool_tokens(known.join(pooled, "pmid", "left_semi"), "mesh_terms", c.token_mode))
    scores = s.table("article_scores", lambda: relevance.article_scores(pool, seeds, weights))
    crs = s.table("term_scores", lambda: relevance.term_scores(pool, scores, weights, seeds))
    final = nodes.join(members.select("id", F.col("community").alias("filtered_community")), "id").join(crs.withColumnRenamed("term", "id"), "id", "left").na.fill(0.0, [f"CRS_{w}" for w in weights])
    final = s.table("final_nodes", lambda: final)
    if not s.exists(f"{s.out}/final_network/_SUCCESS"):
        graph_json.write(final.select("id", "generation", "degree", "adjusted_node_weight", "betweenness_centrality", "eigenvector_centrality", F.col("filtered_community").alias("filtered_louvain_community_id"), "CRS_betweenness_centrality", "CRS_eigenvector_centrality"), core.drop("weight"), f"{s.out}/final_network")
        s.made.append("final_network")
    return s


if __name__ == "__main__":
    run(SparkSession.builder.appName("termloom").getOrCreate(), sys.argv[1], sys.argv[2])
