"""The joined forms of graph operators give what the ones on one adjacency give; the limit is lowered to reach them."""

import random

import numpy as np
import pytest

from termloom.operators import figures, graph


@pytest.fixture(scope="module")
def edges(spark):
    r = random.Random(4)
    pairs = {tuple(sorted(r.sample([f"n{i:02d}" for i in range(24)], 2))) for _ in range(40)} | {("x1", "x2"), ("x2", "x3")}
    return spark.createDataFrame(sorted(pairs), "source string, target string").cache()


def values(df, *keys):
    other = next(c for c in df.columns if c not in keys)
    return {tuple(r[k] for k in keys): r[other] for r in df.collect()}


def test_betweenness_by_joins(edges):
    nodes, links = graph.betweenness(edges)
    joined_nodes, joined_links = graph.betweenness_by_joins(edges)
    for a, b, keys in ((nodes, joined_nodes, ("id",)), (links, joined_links, ("source", "target"))):
        want, got = values(a, *keys), values(b, *keys)
        assert got == pytest.approx(want, abs=1e-12) and set(got) == set(want)
    assert graph.betweenness_by_joins(edges, 5)[0].count() == len(values(nodes, "id"))


def test_paths_and_walks_by_joins(edges, monkeypatch):
    want = {(r.u, r.v): r.dist for r in graph.shortest_paths(edges).collect()}
    near = {(r.id, r.other) for r in graph.both_ways(edges).collect()}
    monkeypatch.setattr(graph, "CSR_EDGES", 3)
    got = {(r.u, r.v): r.dist for r in graph.shortest_paths(edges).collect()}
    assert got == {k: want[k] for k in got} and all(v == max(want.values()) for k, v in want.items() if k not in got)
    walks = [r.walk for r in figures.random_walks(edges, 10, 3).collect()]
    assert len(walks) == 3 * len({a for a, _ in near}) and all(len(w) == 10 and all(p in near for p in zip(w, w[1:])) for w in walks)
    with pytest.raises(ValueError):
        figures.random_walks(edges, 4, 1, p=2.0)


@pytest.mark.parametrize("limit", [3, 30])
def test_communities_by_joins(spark, monkeypatch, limit):
    r = random.Random(9)
    pairs = {(f"{g}{i}", f"{g}{j}") for g in "abcd" for i in range(8) for j in range(i + 1, 8) if r.random() < 0.8} | {("a0", "b0"), ("b1", "c1"), ("c2", "d2")}
    e = spark.createDataFrame(sorted(pairs), "source string, target string")
    adj = graph.Adjacency.of(e)
    monkeypatch.setattr(graph, "CSR_EDGES", limit)
    found = graph.louvain(e, 3)
    label = {x.id: x.community for x in found.collect()}
    assert set(label) == set(adj.ids)
    assert graph.modularity(adj, np.array([label[x] for x in adj.ids])) > 0.6
    assert sorted(label.items()) == sorted((x.id, x.community) for x in graph.louvain(e, 3).collect())
