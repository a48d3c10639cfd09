"""The graph interchange document ``elements.nodes[].data`` and ``elements.edges[].data``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.operators.vocabulary import LEVELS
from termloom.session import scratch

_D, _L, _S, _I, _B = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()
#: Attributes of the document, missing ones null.
NODE_FIELDS = {"id": _S, "label": _S, "generation": _S, "term_type": _S, "is_major_topic": _B, "generation_weight": _D, "article_count": _L, "article_count_rank_normalized": _D, "major_topic_proportion": _D, "rank_norm_median_cit": _D, "rank_norm_mean_cit": _D, "rank_norm_total_cit": _D, "adjusted_node_weight": _D, "degree": _L, "strength": _L, "betweenness_centrality": _D, "eigenvector_centrality": _D, "clustering_coefficient": _D, "unfiltered_louvain_community_id": _I, "filtered_louvain_community_id": _I, "CRS_betweenness_centrality": _D, "CRS_eigenvector_centrality": _D}
EDGE_FIELDS = {"source": _S, "target": _S, "weight": _D, "cumulative_weight_original": _D, "cooccurrence_count": _L, "normalized_cooccurrence": _D, "log1p_cooccurrence_minmax": _D, "edge_betweenness": _D, "mlf_p_value": _D}


def _struct(fields: dict) -> T.StructType:
    return T.StructType([T.StructField("data", T.StructType([T.StructField(n, k) for n, k in fields.items()]))])


SCHEMA = T.StructType([T.StructField("elements", T.StructType([T.StructField("nodes", T.ArrayType(_struct(NODE_FIELDS))), T.StructField("edges", T.ArrayType(_struct(EDGE_FIELDS)))]))])
#: Largest graph, in nodes and edges together, that is put into one document.
MAX_ELEMENTS = 2_000_000


def write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One document of a bounded graph (tables stay the canonical form); published by Spark's output committer."""
    n = nodes.count() + edges.count()
    if n > MAX_ELEMENTS:
        raise ValueError(f"{n} elements; a document takes at most {MAX_ELEMENTS}")
    pack = lambda df, keys: F.array_sort(F.collect_list(F.struct(F.struct(*keys, *[c for c in df.columns if c not in keys]).alias("data"))))
    one = nodes.agg(pack(nodes, ["id"]).alias("nodes")).select("nodes", edges.agg(pack(edges, ["source", "target"])).scalar().alias("edges"))
    one.select(F.to_json(F.struct(F.struct("nodes", "edges").alias("elements"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The document; an absent path gives an empty graph."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([(([], []),)], SCHEMA)
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def all_nodes(doc: DataFrame) -> DataFrame:
    """Nodes with an id, all attributes; those that a node lacks are null."""
    return doc.select(F.inline("elements.nodes")).select("data.*").where(F.col("id").isNotNull())


def nodes(doc: DataFrame) -> DataFrame:
    """Nodes with an id, their degree and strength."""
    return all_nodes(doc).select("id", "degree", "strength")


def raw_edges(doc: DataFrame) -> DataFrame:
    """Edges as they stand, all attributes, repeated pairs included."""
    return doc.select(F.inline("elements.edges")).select("data.*")


def edges(doc: DataFrame) -> DataFrame:
    """Edges with both ends, as sorted pairs; of repeated pairs the one with the largest count."""
    e = raw_edges(doc).where(F.col("source").isNotNull() & F.col("target").isNotNull())
    e = e.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "cooccurrence_count")
    return e.groupBy("source", "target").agg(F.max("cooccurrence_count").alias("cooccurrence_count"))


def figure_nodes(doc: DataFrame, strata: DataFrame) -> DataFrame:
    """Nodes as figures take them: ``mesh_term``, ``ARS`` (the node weight), ``CRS_betweenness``, ``CRS_eigenvector``, and ``aop_level``.

    ``strata(term, aop_level)`` has one row per heading; nodes without one are the last level.
    """
    named = all_nodes(doc).withColumnsRenamed({"id": "mesh_term", "adjusted_node_weight": "ARS", "CRS_betweenness_centrality": "CRS_betweenness", "CRS_eigenvector_centrality": "CRS_eigenvector"})
    levels = strata.select(F.lower("term").alias("__t"), "aop_level")
    return named.join(levels, F.lower("mesh_term") == F.col("__t"), "left").drop("__t").na.fill(LEVELS[-1], ["aop_level"])


def round_trip(nodes_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    path = scratch(nodes_df.sparkSession, "graph-json")
    write(nodes_df, edges_df, path)
    return read(nodes_df.sparkSession, path)
