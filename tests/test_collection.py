import pytest
from pyspark.sql import functions as F

from termloom.functions import special
from termloom.operators import graph, relevance, vocabulary
from termloom.plans import adhoc, collection
from termloom.sources import text_tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_collecting_articles(spark):
    links = spark.createDataFrame([(1, "2;3", ""), (2, "", ""), (3, None, None), (4, "9", None)], "pmid long, cited_by string, cites string")
    roots = spark.createDataFrame([(1,), (1,), (None,), (4,)], "pmid long")
    got = collection.collect_articles(roots, collection.stored_links(links), 2).select("pmid", "generation", "status")
    assert rows(got) == [(1, "P0", "ok"), (2, "G1", "empty"), (3, "G1", "failed"), (4, "P0", "ok"), (9, "G1", "failed")]
    assert rows(collection.collect_articles(roots, collection.stored_links(links), 1).select("pmid")) == [(1,), (4,)]
    assert collection.collect_articles(roots.limit(0), collection.stored_links(links), 3).count() == 0


def test_cache_enters_no_failures(spark):
    table = spark.createDataFrame([(1, "a;b"), (2, " "), (3, None)], "pmid long, mesh_terms string")
    cache = spark.createDataFrame([(7, "z")], "pmid long, mesh_terms string")
    full, log = collection.populate_cache(cache, spark.createDataFrame([(1,), (2,), (3,), (4,), (7,), (None,)], "pmid long"), collection.stored_annotations(table))
    assert rows(full) == [(1, "a;b"), (2, ""), (7, "z")]
    assert rows(log) == [(1, "ok"), (2, "empty"), (3, "failed"), (4, "failed")]


def test_pool_searches_a_seed_once(spark):
    asked = []

    def search(terms):
        asked.append(rows(terms))
        return terms.select("term", F.length("query").cast("bigint").alias("pmid"))

    seeds = spark.createDataFrame([("*ab/cd",), ("xyz",), (None,), ("xyz",)], "term string")
    none = spark.createDataFrame([], "pmid bigint"), spark.createDataFrame([], "term string")
    pool, processed = collection.extend_pool(*none, seeds.where("term <> 'xyz'"), search)
    pool, processed = collection.extend_pool(pool, processed, seeds, search)
    assert asked == [[("*ab/cd", "ab")], [("xyz", "xyz")]] and rows(pool) == [(2,), (3,)] and rows(processed) == [("*ab/cd",), ("xyz",)]
    assert collection.pool_terms(seeds, processed).count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\n c '), (2, ""), (3, None), (4, " ;x")], "i int, t string")
    text_tables.write_csv(df, str(tmp_path / "c"), null="-")
    assert rows(text_tables.read_csv(spark, str(tmp_path / "c"), "i int, t string", null="-")) == rows(df)
    (tmp_path / "a.csv").write_text('mesh_term,aop_level\n"Antibodies, Monoclonal",Organ\n')
    assert rows(text_tables.read_csv(spark, str(tmp_path / "a.csv"), "mesh_term string, aop_level string")) == [("Antibodies, Monoclonal", "Organ")]


def test_first_descriptor_is_kept(spark):
    df = spark.createDataFrame([("a", "D2", 1), ("a", "D1", 2), ("b", None, 3), (None, "D3", 4)], "n string, u string, p long")
    assert rows(vocabulary.first_descriptors(df, "n", "u", "p")) == [("a", "D2")]


def test_raw_tokens_match_as_they_stand(spark):
    df = spark.createDataFrame([(1, "*Skin;Skin/x; Skin;Skin;;skin"), (2, None), (3, "")], "pmid long, t string")
    assert rows(relevance.pool_tokens(df, "t", "raw")) == [(1, " Skin"), (1, "*Skin"), (1, "Skin"), (1, "Skin/x"), (1, "skin")]
    assert rows(relevance.pool_tokens(df, "t", "heading")) == [(1, "skin")]


def test_tails_far_below_the_smallest_double():
    got = special.binomial_tail_log([400.0, 3.0, 0.0, 5.0], [1e6, 10.0, 10.0, 4.0], [1e-9, 0.5, 0.5, 0.5])
    import math

    exact = math.lgamma(1e6 + 1) - math.lgamma(401) - math.lgamma(1e6 - 399) + 400 * math.log(1e-9) + (1e6 - 400) * math.log1p(-1e-9)
    assert got[0] == pytest.approx(exact, rel=1e-6) and math.exp(got[1]) == pytest.approx(0.9453125, rel=1e-12) and got[2] == 0 and got[3] == -math.inf


def test_quality_equals_modularity(spark):
    import numpy as np

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")], "source string, target string")
    c = graph.louvain(e, 1)
    adj = graph.Adjacency.of(e)
    label = {r.id: r.community for r in c.collect()}
    want = graph.modularity(adj, np.array([label[x] for x in adj.ids]))
    row = graph.quality(e, c).first()
    assert row.modularity == pytest.approx(want, abs=1e-9) and (row.n_nodes, row.n_edges, row.n_communities) == (6, 7, 2) and want > 0.3


def test_adhoc_questions(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, 0.5, "a;b"), (2, 0.9, "a"), (3, None, "b")], "pmid long, score_betweenness_centrality double, contributing_seeds string")
    df.write.parquet(str(tmp_path / "s"))
    adhoc.main(spark, [str(tmp_path / "s"), "edge", "a", "b", "--csv", str(tmp_path / "out")])
    assert "|1   |0.5" in capsys.readouterr().out
    assert text_tables.read_csv(spark, str(tmp_path / "out"), "pmid long, score double, seeds string").count() == 1
    assert [r.pmid for r in adhoc.answer(df, "node", ["a"], "score_betweenness_centrality").collect()] == [2, 1]
    adhoc.main(spark, [str(tmp_path / "none"), "export", str(tmp_path / "csv")])
    assert (tmp_path / "csv" / "nodes").exists()


MEDLINE = """PMID- 11
MH  - *Skin/pathology
MH  - Antibodies,
      Monoclonal

PMID- 12
TI  - no headings
"""


def test_tagged_records_and_remote_annotations(spark):
    from termloom.sources import records

    assert [r.get("MH") for r in records.tagged_records(MEDLINE)] == [["*Skin/pathology", "Antibodies, Monoclonal"], None]
    ids = spark.createDataFrame([(11,), (12,), (13,)], "pmid long").coalesce(1)
    got = records.remote_annotations(lambda: lambda ids: MEDLINE)(ids)
    assert rows(got) == [(11, "ok", "*Skin/pathology;Antibodies, Monoclonal"), (12, "empty", ""), (13, "failed", None)]


def test_remote_links(spark):
    from termloom.sources import records

    answer = '{"data": [{"pmid": 1, "cited_by": [2, 3], "references": null}, {"pmid": 2, "cited_by": [], "references": []}, {"pmid": 77}]}'
    ids = spark.createDataFrame([(1,), (2,), (3,)], "pmid long").coalesce(1)
    got = records.remote_links(lambda: lambda ids: answer)(ids)
    assert rows(got) == [(1, "ok", "2;3", ""), (2, "empty", "", ""), (3, "failed", None, None)]
    roots = spark.createDataFrame([(1,)], "pmid long")
    assert rows(collection.collect_articles(roots, records.remote_links(lambda: lambda ids: answer), 2).select("pmid", "generation", "status")) == [(1, "P0", "ok"), (2, "G1", "empty"), (3, "G1", "failed")]


def test_marc_to_first_descriptors(spark):
    df = spark.createDataFrame([("Skin", "D9", 4), ("Skin", "D1", 7)], "descriptor_name string, descriptor_ui string, position long")
    assert rows(vocabulary.first_descriptors(df, "descriptor_name", "descriptor_ui", "position")) == [("Skin", "D9")]


def test_figure_nodes_rename_and_annotate(spark):
    from termloom.sources import graph_json

    nodes = spark.createDataFrame([("Skin", 0.5, 0.1), ("x", 0.2, None)], "id string, adjusted_node_weight double, CRS_betweenness_centrality double")
    edges = spark.createDataFrame([("Skin", "x", 2)], "source string, target string, cooccurrence_count long")
    strata = spark.createDataFrame([("skin", "Organ")], "term string, aop_level string")
    got = graph_json.figure_nodes(graph_json.round_trip(nodes, edges), strata).select("mesh_term", "ARS", "CRS_betweenness", "CRS_eigenvector", "aop_level")
    assert rows(got) == [("Skin", 0.5, 0.1, None, "Organ"), ("x", 0.2, None, None, "Uncategorized")]
