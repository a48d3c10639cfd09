"""Ad-hoc questions: ``python -m termloom.plans.adhoc SCORES node TERM``, ``... edge TERM TERM``, ``... top`` or ``... export GRAPH OUT``.

``SCORES`` is a folder of article scores (Parquet); ``GRAPH`` a graph document whose nodes and edges are written as CSV below OUT.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from termloom.operators import relevance
from termloom.sources import graph_json
from termloom.sources.text_tables import write_csv


def answer(scores: DataFrame, question: str, terms: list[str], score: str, limit: int | None = 20, like: bool = False) -> DataFrame:
    """Articles of a node (one term), of an edge (two terms), or the best of all, best first, then by pmid."""
    if question == "node":
        return relevance.node_articles(scores, terms[0], score, limit, like)
    if question == "edge":
        return relevance.edge_articles(scores, terms[0], terms[1], score, limit, like)
    return relevance.top_articles(scores, score, limit or 20)


def export(spark: SparkSession, graph: str, out: str) -> None:
    """The nodes and edges of a graph document as two CSV folders; an absent graph gives empty ones."""
    doc = graph_json.read(spark, graph)
    write_csv(graph_json.nodes(doc), f"{out}/nodes")
    write_csv(graph_json.edges(doc), f"{out}/edges")


def main(spark: SparkSession, argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("source")
    p.add_argument("question", choices=["node", "edge", "top", "export"])
    p.add_argument("terms", nargs="*")
    p.add_argument("--score", default="score_betweenness_centrality")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--like", action="store_true", help="parts of seeds, whatever their case")
    p.add_argument("--csv", help="folder for all rows, without the limit")
    a = p.parse_args(argv)
    if a.question == "export":
        return export(spark, a.source, a.terms[0])
    scores = spark.read.parquet(a.source)
    answer(scores, a.question, a.terms, a.score, a.limit, a.like).show(a.limit, False)
    if a.csv:
        write_csv(answer(scores, a.question, a.terms, a.score, None, a.like), a.csv)


if __name__ == "__main__":
    main(SparkSession.builder.appName("termloom").getOrCreate())
