import __spark_entry__ as entry


def test_every_list_of_seeds_of_an_article_counts(spark, tmp_path):
    rows = [(1, 2.0, "Alpha Cell"), (1, 1.0, "Messenger;Quinanax Assay"), (2, 3.0, "Quinanax Assay"), (2, None, "Messenger"), (3, 1.0, "Alpha Cell"), (4, 5.0, "Messenger"), (4, 4.0, "Quinanax Assay")]
    spark.createDataFrame(rows, "pmid long, score_betweenness_centrality double, contributing_seeds string").write.parquet(str(tmp_path / "article_relevance_scores.parquet"))
    got = lambda name: [(r.pmid, r.score) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got("node_articles_exact")) == [(1, 2.0), (2, 3.0), (4, 5.0)]
    assert got("node_articles") == [(4, 5.0), (2, 3.0), (1, 2.0)]
    assert got("edge_articles") == [(4, 5.0), (1, 2.0)]
    assert got("top_articles") == [(4, 5.0), (2, 3.0), (1, 2.0), (3, 1.0)]
