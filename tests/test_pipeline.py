from termloom.config import Config
from termloom.plans import pipeline


def test_run_and_resume(spark, tmp_path):
    c = Config(pivots=20, target_edges=120, iterations=3000, chains=2)
    out = str(tmp_path / "out")
    first = pipeline.run(spark, "/root/testdata/sf0.001", out, c)
    assert {"nodes", "edges", "glf", "sa", "article_scores", "final_nodes", "final_network"} <= set(first.made)
    nodes, edges = spark.read.parquet(f"{out}/nodes"), spark.read.parquet(f"{out}/edges")
    assert nodes.where("betweenness_centrality < 0 or adjusted_node_weight > 1").count() == 0 and nodes.where("betweenness_centrality > 0").count() > 0
    assert edges.where("source >= target or mlf_p_value > 1 or weight > 1").count() == 0
    assert spark.read.parquet(f"{out}/glf").count() == 120
    again = pipeline.run(spark, "/root/testdata/sf0.001", out, c)
    assert again.made == []


def test_without_centralities(spark, tmp_path):
    c = Config(full_centrality=False, target_edges=50, iterations=500, chains=1, prune_from=2)
    out = str(tmp_path / "out")
    pipeline.run(spark, "/root/testdata/sf0.001", out, c)
    assert {r[0] for r in spark.read.parquet(f"{out}/nodes").select("betweenness_centrality").distinct().collect()} <= {0.0, 1.0}


def test_from_roots_with_sources(spark, tmp_path):
    feed = spark.read.parquet("/root/testdata/sf0.001/pmids_table.parquet")
    roots = feed.where("generation = 'P0' and pmid is not null").select("pmid").distinct()
    asked = []

    def search(terms):
        asked.append(terms.count())
        return terms.crossJoin(spark.createDataFrame([(-5,), (-6,)], "pmid long")).select("term", "pmid")

    def annotations(ids):
        from pyspark.sql import functions as F

        return ids.select("pmid", F.when(F.col("pmid") == -5, "ok").otherwise("failed").alias("status"), F.when(F.col("pmid") == -5, "Some Heading;Other").alias("val"))

    c = Config(full_centrality=False, target_edges=50, iterations=500, chains=1, generations=2, token_mode="raw")
    out = str(tmp_path / "out")
    first = pipeline.run(spark, "/root/testdata/sf0.001", out, c, pipeline.Sources(search=search, annotations=annotations), roots)
    assert {"collected", "pool", "annotation_cache"} <= set(first.made)
    got = spark.read.parquet(f"{out}/collected")
    assert {r.generation for r in got.select("generation").distinct().collect()} == {"P0", "G1"} and got.where("generation = 'P0'").count() == roots.count()
    assert [r.PMID for r in spark.read.option("header", True).csv(f"{out}/logs/failed").collect()] == ["-6"]
    assert spark.read.parquet(f"{out}/annotation_cache").where("pmid = -5").count() == 1
    again = pipeline.run(spark, "/root/testdata/sf0.001", out, c, pipeline.Sources(search=search, annotations=annotations), roots)
    assert again.made == [] and asked[0] > 0 and asked[1:] == [0]
