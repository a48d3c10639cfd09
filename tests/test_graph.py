import itertools
import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import figures, graph, relevance, sampler

PAIRS = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("x", "y"), ("y", "z")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(s, t, i + 1) for i, (s, t) in enumerate(PAIRS)], "source string, target string, cooccurrence_count long")


def neighbours():
    out = {}
    for s, t in PAIRS:
        out.setdefault(s, set()).add(t)
        out.setdefault(t, set()).add(s)
    return out


def brute_betweenness():
    near, nodes = neighbours(), sorted(neighbours())
    node, edge = dict.fromkeys(nodes, 0.0), dict.fromkeys(PAIRS, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        paths, queue, best = [], deque([[s]]), None
        while queue:
            p = queue.popleft()
            if best and len(p) > best:
                break
            if p[-1] == t:
                best = len(p)
                paths.append(p)
                continue
            queue.extend(p + [q] for q in near[p[-1]] if q not in p)
        for p in paths:
            for v in p[1:-1]:
                node[v] += 1 / len(paths)
            for a, b in zip(p, p[1:], strict=False):
                edge[(min(a, b), max(a, b))] += 1 / len(paths)
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in node.items()}, {k: v / (n * (n - 1)) for k, v in edge.items()}


def test_betweenness(edges):
    nodes, links = graph.betweenness(edges)
    want_n, want_e = brute_betweenness()
    assert {r.id: r.betweenness for r in nodes.collect()} == pytest.approx(want_n)
    assert {(r.source, r.target): r.edge_betweenness for r in links.collect()} == pytest.approx(want_e)
    assert graph.betweenness(edges, k=100)[0].count() == 9


def test_components_and_lcc(edges):
    labels = graph.components(edges)
    assert {r.id: r.component for r in labels.collect()} == {**dict.fromkeys("abcdef", "a"), **dict.fromkeys("xyz", "x")}
    assert sorted(r.id for r in graph.largest_component(labels).collect()) == list("abcdef")
    path = edges.sparkSession.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "source string, target string")
    assert {r.component for r in graph.components(path).collect()} == {"n000"}
    tie = edges.sparkSession.createDataFrame([("p", "q"), ("a", "b")], "source string, target string")
    assert sorted(r.id for r in graph.largest_component(graph.components(tie)).collect()) == ["a", "b"]
    assert graph.components(tie.limit(0)).count() == 0


def test_triangles_and_clustering(edges):
    assert sorted(map(tuple, graph.triangles(edges).collect())) == [("a", "b", "c"), ("d", "e", "f")]
    c = {r.id: r.clustering for r in graph.clustering(edges).collect()}
    assert c["a"] == 1.0 and c["c"] == pytest.approx(1 / 3) and c["x"] == 0.0


def test_shortest_paths_and_eigenvector(edges):
    d = {(r.u, r.v): r.dist for r in graph.shortest_paths(edges).collect()}
    assert d["a", "f"] == 3 and d["a", "x"] == 6 and d["x", "z"] == 2
    small = {r.id: r.eigenvector for r in graph.eigenvector(edges).collect()}
    joins = {r.id: r.eigenvector for r in graph.eigenvector(edges, iterations=6, limit=0).collect()}
    six = {r.id: r.eigenvector for r in graph.eigenvector(edges, iterations=6).collect()}
    assert joins == pytest.approx(six, abs=1e-9)
    assert small["c"] == max(small.values())


def test_louvain(edges):
    got = {r.id: r.community for r in graph.louvain(edges).collect()}
    assert len({got[x] for x in "abc"}) == 1 and len({got[x] for x in "xyz"}) == 1 and got["a"] != got["x"]
    assert got == {r.id: r.community for r in graph.louvain(edges).collect()}
    adj = graph.Adjacency.of(edges)
    assert graph.modularity(adj, np.array([got[i] for i in adj.ids])) > graph.modularity(adj, np.arange(len(adj.ids)))
    with pytest.raises(ValueError):
        graph.Adjacency.of(edges, limit=2)


def test_chains_reach_the_best_subset():
    rng = np.random.default_rng(0)
    w, term = rng.integers(1, 9, 12).astype(float), -rng.random(12) * 20
    value = lambda idx: math.lgamma(w[list(idx)].sum() + 1) + term[list(idx)].sum()
    best = min(value(c) for c in itertools.combinations(range(12), 4))
    for start in (None, 50.0):
        chosen, ll, course = sampler.run_chain(w, term, 4, 20_000, 1, start, 0.999, 5000)
        assert ll == pytest.approx(best) and value(chosen) == pytest.approx(ll) and len(course) == 5
    assert len(sampler.run_chain(w, term, 99, 10, 1)[0]) == 12


def test_subgraph_is_seeded(edges):
    scored = edges.withColumn("loglik", -F.col("cooccurrence_count").cast("double"))
    one = sorted(map(tuple, sampler.subgraph(scored, "glf", 3, 500, 2).collect()))
    assert one == sorted(map(tuple, sampler.subgraph(scored, "glf", 3, 500, 2).collect())) and len(one) == 3
    assert sampler.trajectory(scored, "sa", 3, 500, log_every=100).count() == 6


def test_relevance_golden(spark):
    toks = spark.createDataFrame([(1, "Allergens"), (1, "Nickel"), (1, "*Skin/pathology"), (2, "Allergens"), (2, "*Nickel"), (3, "Skin"), (3, "Allergens"), (4, "*Skin"), (6, "Apoptosis"), (6, None)], "pmid long, term string")
    seeds = spark.createDataFrame([("Allergens", 0.5), ("Nickel", 0.3), ("Skin", 0.2)], "term string, w double")
    s = relevance.article_scores(toks, seeds, ["w"])
    got = {r.pmid: (r.score_w, r.contributing_seeds) for r in s.collect()}
    assert {k: v[1] for k, v in got.items()} == {1: "Allergens;Nickel", 2: "Allergens", 3: "Allergens;Skin"}
    assert [got[k][0] for k in (1, 2, 3)] == pytest.approx([0.8, 0.5, 0.7])
    crs = {r.term: r.CRS_w for r in relevance.term_scores(toks, s, ["w"], seeds).collect()}
    assert crs == pytest.approx({"Allergens": 0.401373, "Nickel": 0.240824, "Skin": 0.210721}, abs=1e-6)
    assert [r.pmid for r in relevance.edge_articles(s, "Allergens", "Skin", "score_w").collect()] == [3]
    assert [r.pmid for r in relevance.node_articles(s, "allerg", "score_w", 2, like=True).collect()] == [1, 3]


def test_figures(spark, edges):
    df = spark.createDataFrame([(float(x),) for x in (0, 10, 25, 49, 50)], "x double")
    assert sorted(map(tuple, figures.histogram_fixed(df, "x", 25).collect())) == [(0, 2), (1, 3)]
    assert sorted(map(tuple, figures.histogram_even(df, "x", 5).collect())) == [(0, 1), (1, 1), (2, 1), (4, 2)]
    o = figures.overlap(edges.limit(0), edges.limit(0), ["source"]).first()
    assert (o.n_a, o.jaccard, o.f1) == (0, 0.0, 0.0)
    nb = figures.negative_binomial(spark.createDataFrame([(int(x),) for x in np.random.default_rng(3).negative_binomial(2, 0.4, 4000)], "c long"), "c").first()
    assert nb.mu == pytest.approx(3.0, rel=0.1) and nb.alpha == pytest.approx(0.5, rel=0.15)
    pts = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 0.0), (1, 0.0, 1.0), (1, 0.2, 0.2), (2, 5.0, 5.0)], "c int, x double, y double")
    assert sorted((r.x, r.y) for r in figures.convex_hulls(pts, "c").collect()) == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]
    w = figures.ward(np.array([[0.0], [1.0], [10.0], [12.0]]))
    assert w[:, 2] == pytest.approx([1.0, 2.0, math.sqrt(2 * 2 * 2 / 4 * (10.5**2))]) and list(w[-1, :2]) == [4, 5]
    y = figures.tsne(np.array([[abs(i // 3 - j // 3) * 5.0 + (i != j) for j in range(9)] for i in range(9)]), steps=200)
    assert np.isfinite(y).all()
    walks = graph_walks = figures.random_walks(edges, 5, 2).collect()
    assert len(walks) == 18 and graph_walks == figures.random_walks(edges, 5, 2).collect()


def test_ranks_without_broadcast_keep_hot_values(spark, monkeypatch):
    from termloom.operators import ranks

    rows = [(i, 0.0 if i % 3 else float(i), None if i % 10 == 0 else float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    want = sorted(map(tuple, ranks.average_ranks(df, ["a", "b"]).collect()))
    monkeypatch.setattr(ranks, "small", lambda *_: False)
    monkeypatch.setattr(ranks, "HOT_VALUES", 5)
    assert sorted(map(tuple, ranks.average_ranks(df, ["a", "b"]).select("id", "a", "b", "rank_a", "rank_b").collect())) == want


def test_renumbering_over_many_groups(spark):
    members = spark.createDataFrame([(f"n{i:03d}", i % 40 if i < 200 else 7) for i in range(260)], "id string, c long")
    sizes = {}
    for i in range(260):
        sizes.setdefault(i % 40 if i < 200 else 7, []).append(f"n{i:03d}")
    order = sorted(sizes, key=lambda c: (-len(sizes[c]), min(sizes[c])))
    got = {r.id: r.community for r in graph.renumbered(members, "c").collect()}
    assert got == {i: order.index(c) + 1 for c, ids in sizes.items() for i in ids}
