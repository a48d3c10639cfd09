"""Queries of the full network against independent results; none of them may stop at the subgraph's 500 edges."""

import inspect

import duckdb
import pytest

import __spark_entry__ as entry
from termloom.operators import sampler
from termloom.plans import network_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("pmids_table", "master_mesh_annotations", "mesh_terms", "article_relevance_scores"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", ["components", "lcc_nodes", "lcc_edges", "lcc_flags", "triangles", "clustering_coefficient"])
def test_full_graph(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in sorted(df.columns))} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows(df) == sorted(map(repr, want))


def test_centralities_cover_the_full_graph(spark):
    e = network_queries.full_graph(spark, FOLDER)
    n = network_queries.graph.endpoints(e).count()
    assert e.count() > network_queries.SUB_EDGES
    b, c = (entry.queries()[x](spark, FOLDER) for x in ("betweenness", "louvain"))
    eb = entry.queries()["edge_betweenness"](spark, FOLDER)
    assert b.count() == c.count() == n and eb.count() == e.count()
    assert b.where("betweenness > 0").count() > 0 and eb.where("edge_betweenness > 0").count() > network_queries.SUB_EDGES


def test_samplers_and_vectors_run_at_full_length(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(network_queries, "scored", lambda *_: None)
    monkeypatch.setattr(network_queries, "subs", lambda *_: (None, None, None))
    monkeypatch.setattr(sampler, "_chains", lambda s, method, m, iterations, chains, seed, start, cooling, *_: calls.append((method, m, iterations, start if method == "sa" else None, cooling)) or spark.range(1))
    monkeypatch.setattr(sampler, "subgraph", lambda *a, **k: sampler._chains(*bound(subgraph, a, k), 0, False))
    subgraph = SUBGRAPH
    network_queries.glf_subgraph(spark, FOLDER), network_queries.sa_subgraph(spark, FOLDER), network_queries.sampler_trajectory(spark, FOLDER)
    assert [c[:3] for c in calls] == [(m, 500, 5_000_000) for m in ("glf", "sa", "glf", "sa")]
    assert all(c[3:] == (5000.0, 0.999995) for c in calls if c[0] == "sa")
    monkeypatch.setattr(network_queries.figures, "random_walks", lambda e, length, per_node, **_: calls.append((length, per_node)) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        network_queries.node_vectors(spark, FOLDER)
    assert calls[-1] == (30, 200)


SUBGRAPH = sampler.subgraph


def bound(f, a, k):
    """The arguments of a call with the defaults filled in."""
    b = inspect.signature(f).bind(*a, **k)
    b.apply_defaults()
    return b.arguments.values()
