"""What grows with the graph never comes to the driver: results are those of the arrays built here, with ``toPandas`` forbidden."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import graph, sampler


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(5)
    pairs = sorted({tuple(sorted(r.sample([f"n{i:02d}" for i in range(30)], 2))) for _ in range(120)})
    rows = [(s, t, r.randint(1, 9), -r.random() * 9) for s, t in pairs]
    return spark.createDataFrame(rows, "source string, target string, cooccurrence_count long, loglik double").repartition(5).cache()


@pytest.fixture
def driver_takes_none(spark, scored, monkeypatch):
    """The sorted rows; afterwards tables may neither be brought to the driver as frames nor made of as many rows there."""
    rows = sorted(map(tuple, scored.collect()))

    def refused(*_, **__):
        raise AssertionError("a table came to the driver")

    make = type(spark).createDataFrame
    monkeypatch.setattr(type(scored), "toPandas", refused)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: refused() if len(data) > 10 else make(self, data, *a, **k))
    return rows


def chosen(rows, method, chains, **k):
    """Best of the chains, each run on arrays of the sorted rows."""
    w, term = np.array([float(r[2]) for r in rows]), np.array([r[3] for r in rows])
    best, ll, _ = min((sampler.run_chain(w, term, 7, 3000, 42 + c, **k) for c in range(chains)), key=lambda x: x[1])
    return sorted(rows[i][:2] for i in best), ll


def test_glf_chains_read_their_edges_in_tasks(scored, driver_takes_none):
    got = sampler.subgraph(scored, "glf", 7, 3000, 3).collect()
    want, ll = chosen(driver_takes_none, "glf", 3)
    assert sorted((r.source, r.target) for r in got) == want and {r.ll for r in got} == {ll}
    assert sampler.subgraph(scored.limit(0), "glf", 7, 30, 2).count() == 0


def test_annealing_reads_its_edges_in_tasks(scored, driver_takes_none):
    got = sampler.subgraph(scored, "sa", 7, 3000, 3, start=50.0, cooling=0.999).collect()
    want, ll = chosen(driver_takes_none, "sa", 3, temperature=50.0, cooling=0.999)
    assert sorted((r.source, r.target) for r in got) == want and {r.ll for r in got} == {ll}


@pytest.mark.parametrize("method", ["glf", "sa"])
def test_trajectories_read_their_edges_in_tasks(scored, driver_takes_none, method):
    got = sorted((r.iteration, r.ll) for r in sampler.trajectory(scored, method, 7, 3000, start=50.0, cooling=0.999, log_every=500).collect())
    w, term = np.array([float(r[2]) for r in driver_takes_none]), np.array([r[3] for r in driver_takes_none])
    assert got == sampler.run_chain(w, term, 7, 3000, 42, 50.0 if method == "sa" else None, 0.999, 500)[2] and len(got) == 7


def test_edge_betweenness_is_worked_out_in_tasks(scored, driver_takes_none):
    edges = scored.select("source", "target")
    got = {(r.source, r.target): r.edge_betweenness for r in graph.betweenness(edges)[1].collect()}
    near = {}
    for s, t, *_ in driver_takes_none:
        near.setdefault(s, set()).add(t), near.setdefault(t, set()).add(s)
    want, n = dict.fromkeys((r[:2] for r in driver_takes_none), 0.0), len(near)
    for s in near:  # Brandes, a node at a time
        dist, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for u in sorted(near[v]):
                if u not in dist:
                    dist[u], paths[u] = dist[v] + 1, 0.0
                    order.append(u)
                if dist[u] == dist[v] + 1:
                    paths[u] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    share = paths[u] / paths[v] * (1 + delta[v])
                    want[min(u, v), max(u, v)] += share
                    delta[u] += share
    assert got == pytest.approx({k: v / (n * (n - 1)) for k, v in want.items()}, abs=1e-12)
    assert graph.betweenness(edges.limit(0))[1].count() == 0 and graph.betweenness(edges, 9)[1].count() == len(want)


def test_eigenvector_is_iterated_in_a_task(scored, driver_takes_none):
    got = {r.id: (r.eigenvector, r.converged) for r in graph.eigenvector(scored, 300).collect()}
    ids = sorted(got)
    a = np.zeros((len(ids), len(ids)))
    for s, t, *_ in driver_takes_none:
        a[ids.index(s), ids.index(t)] = a[ids.index(t), ids.index(s)] = 1.0
    lead = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert [got[i][0] for i in ids] == pytest.approx(list(lead), abs=1e-4) and all(v[1] for v in got.values())
    assert graph.eigenvector(scored.limit(0)).count() == 0


@pytest.mark.parametrize("weight", [None, "cooccurrence_count"])
def test_louvain_runs_in_a_task(scored, driver_takes_none, weight):
    got = {r.id: r.community for r in graph.louvain(scored, 3, weight).collect()}
    ids = sorted({x for r in driver_takes_none for x in r[:2]})
    a, b = (np.array([ids.index(r[i]) for r in driver_takes_none]) for i in (0, 1))
    adj = graph.Adjacency.coded(len(ids), a, b, np.array([float(r[2]) if weight else 1.0 for r in driver_takes_none]))
    label = graph._louvain(adj, 3)
    groups = sorted({c: [i for i, x in zip(ids, label) if x == c] for c in label}.values(), key=lambda g: (-len(g), g[0]))
    assert got == {i: k + 1 for k, g in enumerate(groups) for i in g} and len(groups) > 1
    assert graph.louvain(scored.limit(0), 3, weight).count() == 0


def test_louvain_quality_keeps_edges_in_tasks(scored, driver_takes_none, spark, monkeypatch):
    from termloom.plans import network_queries, stage_queries

    monkeypatch.setattr(network_queries, "full_graph", lambda *_: scored)
    row = stage_queries.louvain_quality(spark, "").first()
    assert (row.n_nodes, row.n_edges) == (30, len(driver_takes_none)) and row.n_communities > 1 and row.modularity > 0.1


def test_sampled_betweenness_keeps_edges_in_tasks(scored, driver_takes_none, spark, monkeypatch):
    from termloom.plans import network_queries, stage_queries

    monkeypatch.setattr(network_queries, "full_graph", lambda *_: scored)
    row = stage_queries.sampled_betweenness(spark, "").first()
    assert (row.n_nodes, row.max_difference) == (30, pytest.approx(0.0, abs=1e-12))  # fewer nodes than pivots: exact


@pytest.mark.parametrize("limit", [10, 60])
def test_louvain_quality_above_the_limit_keeps_edges_in_tasks(scored, driver_takes_none, spark, monkeypatch, limit):
    from termloom.plans import network_queries, stage_queries

    monkeypatch.setattr(network_queries, "full_graph", lambda *_: scored)
    monkeypatch.setattr(graph, "CSR_EDGES", limit)  # rounds of joins, then the groups' graph in one task
    row = stage_queries.louvain_quality(spark, "").first()
    assert (row.n_nodes, row.n_edges) == (30, len(driver_takes_none)) and row.n_communities > 1 and row.modularity > 0.1
