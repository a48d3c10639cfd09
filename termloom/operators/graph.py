"""Graph operators on edge tables ``(source, target)`` with source < target.

Degrees, components, triangles and clustering run as joins over edge tables of any size. Betweenness, shortest paths,
eigenvector centrality, walks and communities work on a compressed adjacency that every task holds where the graph has at most
``CSR_EDGES`` edges (some 70 MB of arrays), and as rounds of joins on written tables beyond that. For betweenness, eigenvector
centrality and communities each task builds it from written files (:class:`Coded`); the driver holds neither ids nor edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.coded import columns, numbered, stored
from termloom.session import forget, maybe_broadcast, written

#: Largest graph, in edges, that every task holds as one adjacency.
CSR_EDGES = 2_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    """``(id, other)`` for both ends of every edge."""
    return edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))).alias("e")).select("e.*")


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges with source < target; loops and null ends are dropped."""
    return edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).where(F.col("source").isNotNull() & (F.col("source") < F.col("target"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component``: the smallest id reachable from each node.

    Each round takes the least label among a node and its neighbours, then jumps to that label's own label, so a path of n
    nodes needs about log n rounds. Labels are written to the shared folder after each round.
    """
    links = written(both_ways(edges), "links")
    labels = written(links.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")), "labels0")
    for turn in range(max_rounds):
        near = links.join(labels.select(F.col("id").alias("other"), F.col("component").alias("c")), "other").groupBy("id").agg(F.min("c").alias("c"))
        least = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("up"))
        new = written(least.join(jump, "c").select("id", "old", F.least("c", "up").alias("component")), f"labels{turn + 1}")
        previous, labels = labels, new.select("id", "component")
        forget(previous)
        if new.where(F.col("old") != F.col("component")).isEmpty():
            break
    return labels


def largest_component(labels: DataFrame) -> DataFrame:
    """``id`` of the nodes of the largest component; of equals the one with the smallest id."""
    best = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(best.select("component"), "component", "left_semi").select("id")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ``nodes(id)``."""
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """``a, b, c`` (a < b < c) of every triangle: edges point to the end of higher degree, so no hub is expanded."""
    deg = both_ways(edges).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    e = edges.select("source", "target").join(deg.select(F.col("id").alias("source"), F.col("d").alias("ds")), "source").join(deg.select(F.col("id").alias("target"), F.col("d").alias("dt")), "target")
    up = (F.col("ds") < F.col("dt")) | ((F.col("ds") == F.col("dt")) & (F.col("source") < F.col("target")))
    out = e.select(F.when(up, F.col("source")).otherwise(F.col("target")).alias("x"), F.when(up, F.col("target")).otherwise(F.col("source")).alias("y"))
    wedge = out.join(out.select("x", F.col("y").alias("z")), "x").where(F.col("y") < F.col("z"))
    closed = wedge.join(edges.select(F.col("source").alias("y"), F.col("target").alias("z")), ["y", "z"])
    s = F.array_sort(F.array("x", "y", "z"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """``id, degree, n_triangles, clustering``: 2 triangles / (degree (degree - 1)), 0 below degree 2."""
    deg = both_ways(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    tri = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_triangles"))
    out = deg.join(tri, "id", "left").na.fill(0, ["n_triangles"])
    possible = F.col("degree").cast("double") * (F.col("degree") - 1)
    return out.withColumn("clustering", F.when(F.col("degree") > 1, 2.0 * F.col("n_triangles") / possible).otherwise(0.0))


class Adjacency:
    """Compressed adjacency of a bounded graph: sorted ids, offsets, neighbours and weights."""

    def __init__(self, ids: list, off: np.ndarray, to: np.ndarray, weight: np.ndarray):
        self.ids, self.off, self.to, self.weight = ids, off, to, weight

    @classmethod
    def of(cls, edges: DataFrame, weight: str | None = None, limit: int = CSR_EDGES) -> Adjacency:
        n = edges.count()
        if n > limit:
            raise ValueError(f"{n} edges; this operator takes at most {limit}")
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        pdf = edges.select("source", "target", w.alias("w")).toPandas()
        ids = sorted({*pdf.source, *pdf.target})
        at = {x: i for i, x in enumerate(ids)}
        s, t = pdf.source.map(at).to_numpy(dtype=np.int64), pdf.target.map(at).to_numpy(dtype=np.int64)
        a, b, ww = np.concatenate([s, t]), np.concatenate([t, s]), np.concatenate([pdf.w, pdf.w]).astype(float)
        order = np.lexsort((b, a))
        a, b, ww = a[order], b[order], ww[order]
        return cls(ids, np.searchsorted(a, np.arange(len(ids) + 1)), b, ww)

    @classmethod
    def coded(cls, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> Adjacency:
        """Of edges between the numbers 0 to n - 1, which stand for ids; without weights ``weight`` is empty."""
        key = np.concatenate([a.astype(np.int64) * n + b, b.astype(np.int64) * n + a])
        weight = np.empty(0)
        if w is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, weight = key[order], np.concatenate([w, w])[order]
        return cls(range(n), np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * n), (key % n).astype(np.int32), weight)

    def owner(self) -> np.ndarray:
        """The node that each place in ``to`` belongs to."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.off))

    def places(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all neighbours of ``nodes`` in ``to``, and the node each belongs to."""
        sizes = self.off[nodes + 1] - self.off[nodes]
        ends = np.cumsum(sizes)
        return np.repeat(self.off[nodes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), np.repeat(nodes, sizes)

    def levels(self, source: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Distances from a node (-1: none), numbers of shortest paths, the nodes of each level, and the steps of shortest paths
        to each further level: (place in ``to``, from, to); a whole level at a time."""
        n = len(self.ids)
        dist, paths = np.full(n, -1, np.int32), np.zeros(n)
        dist[source], paths[source] = 0, 1.0
        level, out, steps, left = np.array([source]), [], [], n - 1
        while len(level):
            out.append(level)
            if not left:
                break
            at, origin = self.places(level)
            reach = self.to[at]
            new = dist[reach] < 0
            at, origin, reach = at[new], origin[new], reach[new]
            paths += np.bincount(reach, weights=paths[origin], minlength=n)
            steps.append((at, origin, reach))
            seen = np.zeros(n, bool)
            seen[reach] = True
            level = np.flatnonzero(seen)
            dist[level] = len(out)
            left -= len(level)
        return dist, paths, out, steps


class Coded:
    """A graph on files: nodes numbered in the order of their ids, edges as pairs of numbers, which tasks read as an adjacency.

    ``loops(id, w)`` may give weights inside nodes. The driver holds the number of nodes and two paths.
    """

    def __init__(self, edges: DataFrame, weight: str | None = None, loops: DataFrame | None = None):
        nodes = endpoints(edges)
        if loops is not None:
            nodes = nodes.join(loops, "id", "left").select("id", F.coalesce("w", F.lit(0.0)).alias("loop"))
        self.nodes, self.node_path = numbered(nodes, ["id"], "coded-nodes")
        self.n, self.weighted, self.looped = self.nodes.count(), weight is not None, loops is not None
        e = edges.select("source", "target", *([F.col(weight).cast("double").alias("w")] if weight else []))
        for end, code in (("source", "a"), ("target", "b")):
            e = e.join(maybe_broadcast(self.nodes.select(F.col("id").alias(end), F.col("at").cast("int").alias(code)), self.n), end)
        self.edges, self.edge_path = stored(e, "coded-edges")

    def reader(self):
        """A function for tasks that gives the adjacency; of at least one edge."""
        n, path, names = self.n, self.edge_path, ["a", "b", *(["w"] if self.weighted else [])]
        return lambda: Adjacency.coded(n, *columns(path, names))

    def loop_reader(self):
        """A function for tasks that gives the weights inside nodes, or None."""
        n, path, looped = self.n, self.node_path, self.looped

        def read() -> np.ndarray | None:
            if not looped:
                return None
            out = np.empty(n)
            at, given = columns(path, ["at", "loop"])
            out[at] = given
            return out

        return read


def betweenness(edges: DataFrame, k: int | None = None, seed: int = 42, links: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(``id, betweenness``; ``source, target, edge_betweenness``) of a graph, unweighted and normalised.

    Brandes' accumulation from ``k`` pivots drawn with ``seed`` (all nodes when k is None or not smaller), spread over tasks.
    Node values are scaled by 1 / ((n - 1)(n - 2)), edge values by 1 / (n (n - 1)), both by n / k. Without ``links`` edge values
    are left out.
    """
    if edges.count() > CSR_EDGES:
        return betweenness_by_joins(edges, k, seed)
    spark = edges.sparkSession
    graph = Coded(edges)
    n, read = graph.n, graph.reader()
    sampled = k is not None and k < n
    chosen = np.sort(np.random.default_rng(seed).choice(n, k, replace=False)) if sampled else None
    pivots = spark.createDataFrame(pd.DataFrame({"pivot": chosen})) if sampled else spark.range(n).withColumnRenamed("id", "pivot")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = None
        for batch in batches:
            if g is None and len(batch):
                g = read()
                node, edge = np.zeros(n), np.zeros(len(g.to) if links else 0)
            for s in batch["pivot"]:
                _, paths, levels, steps = g.levels(int(s))
                delta = np.zeros(n)
                for at, before, after in reversed(steps):
                    share = paths[before] * ((1.0 + delta) / np.maximum(paths, 1.0))[after]
                    if links:
                        edge[at] += share
                    delta += np.bincount(before, weights=share, minlength=n)
                delta[int(s)] = 0.0
                node += delta
        if g is None:
            return
        yield pd.DataFrame({"a": np.arange(n, dtype=np.int32), "b": np.int32(-1), "v": node})
        if links:
            owner = g.owner()
            back = np.argsort(g.to.astype(np.int64) * n + owner)  # place of the same edge the other way round
            edge += edge[back]
            keep = np.flatnonzero((owner < g.to) & (edge > 0))
            yield pd.DataFrame({"a": owner[keep], "b": g.to[keep], "v": edge[keep]})

    count = min(k, n) if k is not None else n
    tasks = min(max(1, count // 8), spark.sparkContext.defaultParallelism * 2)
    sums = written(pivots.repartition(tasks).mapInPandas(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")), "brandes")
    scale = n / max(1, count)
    per_node, per_edge = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0), (1.0 / (n * (n - 1)) if n > 1 else 0.0)
    value = F.coalesce(F.col("v"), F.lit(0.0))
    nodes = graph.nodes.join(sums.where("b < 0").select(F.col("a").alias("at"), "v"), "at", "left").select("id", (value * per_node * scale).alias("betweenness"))
    if not links:
        return nodes, None
    ends = graph.edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "source", "target")
    return nodes, ends.join(sums.where("b >= 0"), ["a", "b"], "left").select("source", "target", (value * per_edge * scale).alias("edge_betweenness"))


def searches(links: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Breadth-first searches from all ``sources(s)`` at once: per distance a written table ``s, id, paths`` of the nodes at it.

    A round joins the frontier with ``links(id, other)``, adds up the numbers of shortest paths map-side, and drops what an
    earlier round reached by an anti-join.
    """
    level = written(sources.select("s", F.col("s").alias("id"), F.lit(1.0).alias("paths")), "search0")
    levels = [level]
    while True:
        step = level.join(links, "id").groupBy("s", F.col("other").alias("id")).agg(F.sum("paths").alias("paths"))
        near = levels[-1] if len(levels) == 1 else levels[-1].unionByName(levels[-2])  # a neighbour is one level up or down, or beside
        level = written(step.join(near.select("s", "id"), ["s", "id"], "left_anti"), f"search{len(levels)}")
        if level.isEmpty():
            return levels
        levels.append(level)


def betweenness_by_joins(edges: DataFrame, k: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """:func:`betweenness` for graphs of any size; the ``k`` pivots are those with the smallest seeded hashes."""
    links = written(both_ways(edges), "links")
    ids = written(links.select("id").distinct(), "nodes")
    n = ids.count()
    sources = ids.select(F.col("id").alias("s"))
    if k is not None and k < n:
        sources = sources.orderBy(F.xxhash64(F.lit(seed), "s"), "s").limit(k)
    levels = searches(links, sources)
    scale = n / max(1, min(k or n, n))
    shares: list[DataFrame] = []
    deltas: list[DataFrame] = []
    below = None
    for d in range(len(levels) - 1, 0, -1):
        here = levels[d].withColumn("delta", F.lit(0.0)) if below is None else levels[d].join(below, ["s", "id"], "left").na.fill(0.0, ["delta"])
        here = written(here, f"delta{d}")
        deltas.append(here.select("id", "delta"))
        up = levels[d - 1].select("s", F.col("id").alias("other"), F.col("paths").alias("up_paths"))
        share = here.join(links, "id").join(up, ["s", "other"]).select("s", "id", "other", (F.col("up_paths") / F.col("paths") * (1.0 + F.col("delta"))).alias("share"))
        share = written(share, f"share{d}")
        shares.append(share.select(F.least("id", "other").alias("source"), F.greatest("id", "other").alias("target"), "share"))
        below = share.groupBy("s", F.col("other").alias("id")).agg(F.sum("share").alias("delta"))
    spark = edges.sparkSession
    per_node, per_edge = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0), (1.0 / (n * (n - 1)) if n > 1 else 0.0)
    node = reduce(DataFrame.unionByName, deltas) if deltas else spark.createDataFrame([], "id string, delta double")
    edge = reduce(DataFrame.unionByName, shares) if shares else spark.createDataFrame([], "source string, target string, share double")
    nodes = ids.join(node.groupBy("id").agg(F.sum("delta").alias("v")), "id", "left").select("id", (F.coalesce("v", F.lit(0.0)) * per_node * scale).alias("betweenness"))
    found = edges.select("source", "target").join(edge.groupBy("source", "target").agg(F.sum("share").alias("v")), ["source", "target"], "left")
    return nodes, found.select("source", "target", (F.coalesce("v", F.lit(0.0)) * per_edge * scale).alias("edge_betweenness"))


def shortest_paths(edges: DataFrame) -> DataFrame:
    """``u, v, dist`` between all pairs of nodes; unreachable pairs get twice the largest distance.

    The result has a row per pair of nodes. Beyond ``CSR_EDGES`` edges only reachable pairs are listed.
    """
    spark = edges.sparkSession
    if edges.count() > CSR_EDGES:
        links = written(both_ways(edges), "links")
        levels = searches(links, links.select(F.col("id").alias("s")).distinct())
        return reduce(DataFrame.unionByName, [level.select(F.col("s").alias("u"), F.col("id").alias("v"), F.lit(d).cast("bigint").alias("dist")) for d, level in enumerate(levels)])
    adj = Adjacency.of(edges)
    shared = spark.sparkContext.broadcast(adj)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g: Adjacency = shared.value
        for batch in batches:
            for s in batch["pivot"]:
                dist = g.levels(int(s))[0]
                yield pd.DataFrame({"u": g.ids[int(s)], "v": g.ids, "dist": dist})

    n = len(adj.ids)
    rows = spark.createDataFrame([(i,) for i in range(n)], "pivot long").repartition(min(max(1, n // 8), spark.sparkContext.defaultParallelism * 2))
    found = written(rows.mapInPandas(run, "u string, v string, dist long"), "paths")
    most = found.agg(F.max("dist"))
    return found.withColumn("dist", F.when(F.col("dist") < 0, 2 * most.scalar()).otherwise(F.col("dist")))


def eigenvector(edges: DataFrame, iterations: int = 500, tolerance: float = 1e-6, limit: int = CSR_EDGES) -> DataFrame:
    """``id, eigenvector, converged`` by x <- x + A x from the uniform vector, L2-normalised each step.

    Stops when the absolute changes add up to less than n times the tolerance; the last vector is returned even when it has
    not converged. Graphs above ``limit`` edges iterate as joins, each step written to the shared folder.
    """
    spark = edges.sparkSession
    if edges.count() <= limit:
        graph = Coded(edges)
        n, read = graph.n, graph.reader()
        if not n:
            return spark.createDataFrame([], "id string, eigenvector double, converged boolean")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _ in batches:
                g = read()
                owner, x, done = g.owner(), np.full(n, 1.0 / n), False
                for _ in range(iterations):
                    new = x + np.bincount(owner, weights=x[g.to], minlength=n)
                    new /= np.linalg.norm(new) or 1.0
                    done = bool(np.abs(new - x).sum() < n * tolerance)
                    x = new
                    if done:
                        break
                yield pd.DataFrame({"at": np.arange(n), "eigenvector": np.round(x, 15), "converged": done})  # without the last bit, which the order of ids moves

        found = written(spark.range(0, 1, 1, 1).mapInPandas(run, "at long, eigenvector double, converged boolean"), "eigenvector")
        return graph.nodes.join(found, "at").select("id", "eigenvector", "converged")
    links = written(both_ways(edges), "links")
    state = written(links.select("id").distinct().withColumn("x", F.lit(1.0)), "x0")
    n, done, last = state.count(), False, state
    for turn in range(iterations):
        pulled = links.join(state.select(F.col("id").alias("other"), "x"), "other").groupBy("id").agg(F.sum("x").alias("ax"))
        raw = written(state.join(pulled, "id").select("id", F.col("x").alias("old"), (F.col("x") + F.col("ax")).alias("y")), f"y{turn}")
        norm = float(raw.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0])
        state = raw.select("id", (F.col("y") / norm).alias("x"), "old")
        done = float(state.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0]) < n * tolerance
        state = state.select("id", "x")
        forget(last)
        last = raw
        if done:
            break
    return state.select("id", F.col("x").alias("eigenvector"), F.lit(done).alias("converged"))


def modularity(adj: Adjacency, community: np.ndarray) -> float:
    """Newman's modularity of an assignment."""
    m2 = adj.weight.sum()
    if not m2:
        return 0.0
    owner = np.repeat(np.arange(len(adj.ids)), np.diff(adj.off))
    inside = adj.weight[community[owner] == community[adj.to]].sum()
    k = np.bincount(community, weights=np.bincount(owner, weights=adj.weight, minlength=len(adj.ids)))
    return float(inside / m2 - ((k / m2) ** 2).sum())


def quality(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row ``n_nodes, n_edges, n_communities, modularity`` of ``members(id, community)`` over unweighted edges, by joins."""
    label = members.select("id", F.col("community").alias("c"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    inside = edges.join(label.withColumnsRenamed({"id": "source", "c": "cs"}), "source").join(label.withColumnsRenamed({"id": "target", "c": "ct"}), "target")
    inside = inside.where(F.col("cs") == F.col("ct")).groupBy(F.col("cs").alias("c")).agg(F.count(F.lit(1)).alias("e"))
    degree = both_ways(edges).groupBy("id").agg(F.count(F.lit(1)).alias("d")).join(label, "id").groupBy("c").agg(F.sum("d").alias("k"), F.count(F.lit(1)).alias("n"))
    rows = degree.join(inside, "c", "left").withColumn("m", m.scalar().cast("double"))
    q = F.sum(F.coalesce("e", F.lit(0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), F.lit(2.0)))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.max("m").cast("bigint").alias("n_edges"), F.count(F.lit(1)).alias("n_communities"), F.round(q, 9).alias("modularity"))


def _louvain(adj: Adjacency, seed: int, inner: np.ndarray | None = None) -> np.ndarray:
    """Community of every node; ``inner`` is the weight of links inside each node, where nodes stand for groups.

    Everything is flat arrays; without weights in ``adj`` every link counts 1.
    """
    rng = np.random.default_rng(seed)
    n = len(adj.ids)
    ends, to, weight = adj.off, adj.to, adj.weight if len(adj.weight) == len(adj.to) else np.ones(len(adj.to))
    loops = np.zeros(n) if inner is None else inner
    member = np.arange(n)
    while True:
        size, off = len(ends) - 1, ends.tolist()
        owner = np.repeat(np.arange(size, dtype=np.int32), np.diff(ends))
        k = np.bincount(owner, weights=weight, minlength=size) + 2 * loops
        m2 = float(k.sum()) or 1.0
        com, tot = np.arange(size), k.copy()
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in rng.permutation(size).tolist():
                first, last, own, mine = off[v], off[v + 1], com[v], k[v]
                near, at = np.unique(com[to[first:last]], return_inverse=True)
                w = np.bincount(at, weights=weight[first:last], minlength=len(near))
                tot[own] -= mine
                g = w - tot[near] * mine / m2
                i = int(near.searchsorted(own))
                held = w[i] if i < len(near) and near[i] == own else 0.0
                best, gain = own, held - tot[own] * mine / m2
                if len(near) and g.max() > gain + 1e-12:
                    for c, x in zip(near[high := g > g.max() - 1e-9], g[high], strict=True):  # the first of the best, in their order
                        if x > gain + 1e-12:
                            best, gain = c, x
                tot[best] += mine
                if best != own:
                    com[v] = best
                    moved = moved_any = True
        names, com = np.unique(com, return_inverse=True)
        member = com[member]
        if not moved_any:
            return member
        groups, a, b = len(names), com[owner], com[to]
        same = a == b
        loops = np.bincount(com, weights=loops, minlength=groups) + np.bincount(a[same], weights=weight[same] / 2, minlength=groups)
        key, at = np.unique(a[~same] * groups + b[~same], return_inverse=True)
        weight = np.bincount(at, weights=weight[~same], minlength=len(key))
        ends, to = np.searchsorted(key, np.arange(groups + 1) * groups), key % groups


def _louvain_coded(graph: Coded, seed: int) -> DataFrame:
    """``at, c``: the community of every node's number, found in one task."""
    read, loops = graph.reader(), graph.loop_reader()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            found = _louvain(read(), seed, loops())
            yield pd.DataFrame({"at": np.arange(len(found)), "c": found})

    return written(graph.edges.sparkSession.range(0, 1, 1, 1).mapInPandas(run, "at long, c long"), "louvain")


def louvain(edges: DataFrame, seed: int = 42, weight: str | None = None) -> DataFrame:
    """``id, community``: local moving and merging until modularity no longer rises; the same seed gives the same result.

    Communities are numbered from 1 by size, larger first, then by their smallest id. Graphs of more than ``CSR_EDGES`` edges are
    first brought below that by :func:`moved_and_merged`.
    """
    spark = edges.sparkSession
    if edges.count() > CSR_EDGES:
        return renumbered(_large_louvain(edges, seed, weight), "c").select("id", "community")
    graph = Coded(edges, weight)
    if not graph.n:
        return spark.createDataFrame([], "id string, community int")
    return renumbered(graph.nodes.join(_louvain_coded(graph, seed), "at").select("id", "c"), "c").select("id", "community")


def _large_louvain(edges: DataFrame, seed: int, weight: str | None) -> DataFrame:
    """``id, c`` of a graph of any size: rounds of moving and merging as joins until the groups' graph fits into one adjacency."""
    spark = edges.sparkSession
    e = edges.select("source", "target", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    members, loops = written(both_ways(e).select("id").distinct().withColumn("c", F.col("id")), "members"), None
    while True:
        merged = moved_and_merged(e, loops, seed)
        if merged is None:
            break
        label, e, loops = merged
        members = written(members.join(label.select(F.col("id").alias("c"), F.col("c").alias("up")), "c", "left").select("id", F.coalesce("up", "c").alias("c")), "members")
        if e.count() <= CSR_EDGES:
            break
    if e.isEmpty() or e.count() > CSR_EDGES:  # one group each, or moving no longer helps
        return members
    graph = Coded(e, "w", loops)
    found = graph.nodes.join(_louvain_coded(graph, seed).withColumnRenamed("c", "to"), "at").select(F.col("id").alias("c"), "to")
    return members.join(found, "c", "left").select("id", F.coalesce(F.concat(F.lit("#"), F.col("to").cast("string")), F.col("c")).alias("c"))


def moved_and_merged(e: DataFrame, loops: DataFrame | None, seed: int, rounds: int = 12) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(``id, c``; the groups' links ``source, target, w``; the weight inside each group ``id, w``), or None if no node moved.

    A round works out, by joins, what every node would gain in each neighbouring group; half of the nodes (by seeded hash, another
    half each round) then move to their best group, so that neighbours do not swap places for ever. Two rounds without a move end it.
    """
    links = written(e.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other"), "w"), F.struct(F.col("target").alias("id"), F.col("source").alias("other"), "w"))).alias("x")).select("x.*"), "moving-links")
    k = links.groupBy("id").agg(F.sum("w").alias("k"))
    if loops is not None:
        k = k.join(loops.withColumnRenamed("w", "loop"), "id", "full").select("id", (F.coalesce("k", F.lit(0.0)) + 2 * F.coalesce("loop", F.lit(0.0))).alias("k"))
    k = written(k, "moving-degrees")
    m2 = k.agg(F.sum("k")).first()[0] or 1.0
    label, still, any_moved = written(k.select("id", F.col("id").alias("c"), "k"), "labels0"), 0, False
    for turn in range(rounds):
        total = label.groupBy("c").agg(F.sum("k").alias("tot"))
        near = links.join(label.select(F.col("id").alias("other"), "c"), "other").groupBy("id", "c").agg(F.sum("w").alias("w_in"))
        own = label.select("id", F.col("c").alias("own"), "k")
        choice = near.join(own, "id").join(total, "c")
        stay = F.col("c") == F.col("own")
        gain = F.col("w_in") - (F.col("tot") - F.when(stay, F.col("k")).otherwise(0.0)) * F.col("k") / m2
        best = choice.select("id", "c", stay.alias("stay"), F.round(gain, 9).alias("gain")).groupBy("id").agg(F.max(F.when(F.col("stay"), F.col("gain"))).alias("own_gain"), F.max_by("c", F.struct("gain", F.col("stay"), F.xxhash64("c"))).alias("to"), F.max("gain").alias("top"))
        alone = own.join(total, F.col("own") == F.col("c")).select("id", "own", "k", (-(F.col("tot") - F.col("k")) * F.col("k") / m2).alias("leave"))
        turn_of = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "id"), F.lit(2)) == 0
        moves = turn_of & (F.col("top") > F.coalesce("own_gain", "leave") + 1e-9)
        new = written(alone.join(best, "id", "left").select("id", F.when(F.coalesce(moves, F.lit(False)), F.col("to")).otherwise(F.col("own")).alias("c"), "k", F.coalesce(moves & (F.col("to") != F.col("own")), F.lit(False)).alias("moved")), f"labels{turn + 1}")
        moved = not new.where("moved").isEmpty()
        forget(label)
        label, any_moved, still = new.select("id", "c", "k"), any_moved or moved, 0 if moved else still + 1
        if still == 2:
            break
    if not any_moved:
        return None
    ends = e.join(label.select(F.col("id").alias("source"), F.col("c").alias("cs")), "source").join(label.select(F.col("id").alias("target"), F.col("c").alias("ct")), "target")
    groups = written(ends.groupBy(F.least("cs", "ct").alias("source"), F.greatest("cs", "ct").alias("target")).agg(F.sum("w").alias("w")), "groups")
    inside = groups.where(F.col("source") == F.col("target")).select(F.col("source").alias("id"), "w")
    if loops is not None:
        inside = inside.unionByName(loops.join(label, "id").select(F.col("c").alias("id"), "w"))
    inside = written(inside.groupBy("id").agg(F.sum("w").alias("w")), "inside")
    return label.select("id", "c"), groups.where(F.col("source") < F.col("target")), inside


def renumbered(members: DataFrame, label: str) -> DataFrame:
    """``members(id, label)`` with ``community`` from 1 by size, larger first, then by the smallest id of the group.

    The groups are sorted over range partitions and numbered by prefix sums of the partitions' counts; no task sees them all.
    """
    from pyspark.sql import Window

    groups = members.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    placed = written(groups.repartitionByRange(F.desc("n"), F.asc("first")).withColumn("part", F.spark_partition_id()), "groups")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    ahead = {r["part"]: r["m"] for r in parts.collect()}  # one row per partition
    base, total = [], 0
    for p in sorted(ahead):
        base.append((p, total))
        total += ahead[p]
    before = members.sparkSession.createDataFrame(base, "part int, before long")
    inside = Window.partitionBy("part").orderBy(F.desc("n"), "first")
    numbers = placed.join(F.broadcast(before), "part").select(label, (F.col("before") + F.row_number().over(inside)).cast("int").alias("community"))
    return members.join(numbers, label)
