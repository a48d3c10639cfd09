"""Datasets behind the figures: compositions, flows, histograms, overlaps, fits, embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.special import _lgamma
from termloom.operators import graph
from termloom.operators.graph import Adjacency
from termloom.operators.vocabulary import LEVELS, level_name
from termloom.session import written


def annotate(nodes: DataFrame, strata: DataFrame) -> DataFrame:
    """``nodes`` with ``aop_level``; nodes without annotation are the last level."""
    s = strata.select(F.col("term").alias("__t"), "aop_level")
    return nodes.join(s, F.col("id") == F.col("__t"), "left").drop("__t").na.fill(LEVELS[-1], ["aop_level"])


def composition(members: DataFrame) -> DataFrame:
    """Per community the number of members of each level (a column per level) and in all; ``members(community, aop_level)``."""
    out = members.groupBy("community").pivot("aop_level", LEVELS).agg(F.count(F.lit(1))).na.fill(0)
    return out.withColumn("total", sum((F.col(f"`{x}`") for x in LEVELS), F.lit(0)).cast("bigint"))


def flows(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """``source_level, target_level, weight``: edges between levels, the earlier level first, both ends annotated.

    ``levels(id, i)`` holds the place of each node's level.
    """
    a, b = levels.select(F.col("id").alias("source"), F.col("i").alias("si")), levels.select(F.col("id").alias("target"), F.col("i").alias("ti"))
    e = edges.join(a, "source").join(b, "target")
    e = e.groupBy(F.least("si", "ti").alias("lo"), F.greatest("si", "ti").alias("hi")).agg(F.count(F.lit(1)).alias("weight"))
    return e.select(level_name(F.col("lo")).alias("source_level"), level_name(F.col("hi")).alias("target_level"), "weight")


def histogram_fixed(df: DataFrame, col: str, width: float) -> DataFrame:
    """``bin, n``: rows by bins ``[width * bin, width * (bin + 1))`` from 0; the largest value closes the last bin."""
    top = df.agg(F.max(col)).scalar()
    n_bins = F.greatest(F.ceil(top / width), F.lit(1))
    at = F.least(F.floor(F.col(col) / width), n_bins - 1)
    return df.where(F.col(col).isNotNull()).groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_even(df: DataFrame, col: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """``bin`` (0 to bins - 1), ``n`` over equal widths between least and largest; all equal: bin 0."""
    b = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    at = F.when(b["hi"] > b["lo"], F.least(F.floor((F.col(col) - b["lo"]) / (b["hi"] - b["lo"]) * bins), F.lit(bins - 1))).otherwise(0)
    return df.where(F.col(col).isNotNull()).groupBy(*(by or []), at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def overlap(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row: ``n_a, n_b, n_both, jaccard, f1`` of two sets of keys; 0 where both are empty."""
    both = a.select(*on).distinct().withColumn("a", F.lit(1)).join(b.select(*on).distinct().withColumn("b", F.lit(1)), on, "full")
    s = both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n_both"))
    union, total = F.col("n_a") + F.col("n_b") - F.col("n_both"), F.col("n_a") + F.col("n_b")
    return s.withColumn("jaccard", F.when(union > 0, F.col("n_both") / union).otherwise(0.0)).withColumn("f1", F.when(total > 0, 2 * F.col("n_both") / total).otherwise(0.0))


def cascade(counts: DataFrame, order: str, n: str) -> DataFrame:
    """``counts`` with ``retained``: the share of the stage before; null for the first and after an empty one. Few rows."""
    from pyspark.sql import Window

    before = F.lag(n).over(Window.orderBy(order))
    return counts.withColumn("retained", F.when(before > 0, F.col(n) / before))


def linear_fit(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """``by, n, slope, intercept`` of least squares over rows with x > 0 and y > 0."""
    kept = df.where((F.col(x) > 0) & (F.col(y) > 0))
    return kept.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def negative_binomial(df: DataFrame, col: str) -> DataFrame:
    """One row ``n, mu, alpha, loglik``: intercept-only negative binomial fit of counts (log link, dispersion alpha).

    Only the frequency of each distinct count reaches the driver; the likelihood in alpha is maximised by golden section.
    """
    freq = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    spark = df.sparkSession
    if not len(freq):
        return spark.createDataFrame([], "n long, mu double, alpha double, loglik double")
    x, n = freq.x.to_numpy(), freq.n.to_numpy(dtype=float)
    mu = float((x * n).sum() / n.sum())

    def like(log_alpha: float) -> float:
        r = math.exp(-log_alpha)
        one = _lgamma(x + r) - _lgamma(np.full_like(x, r)) - _lgamma(x + 1) + r * math.log(r / (r + mu)) + np.where(x > 0, x * math.log(max(mu, 1e-300) / (r + mu)), 0.0)
        return float((one * n).sum())

    lo, hi, g = -12.0, 8.0, (math.sqrt(5) - 1) / 2
    while hi - lo > 1e-9:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if like(a) > like(b) else (a, hi)
    return spark.createDataFrame([(int(n.sum()), mu, math.exp((lo + hi) / 2), like((lo + hi) / 2))], "n long, mu double, alpha double, loglik double")


def tsne(dist: np.ndarray, perplexity: float = 30.0, seed: int = 42, steps: int = 500) -> np.ndarray:
    """Two-dimensional t-SNE of a small precomputed distance matrix."""
    n = len(dist)
    if n < 3:
        return np.zeros((n, 2))
    perplexity = min(perplexity, (n - 1) / 3)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        d = np.delete(dist[i] ** 2, i)
        for _ in range(60):
            e = np.exp(-(d - d.min()) * beta)
            q = e / e.sum()
            h = -(q * np.log(np.maximum(q, 1e-300))).sum()
            if abs(h - math.log(perplexity)) < 1e-5:
                break
            lo, hi = (beta, hi) if h > math.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, v, gain = rng.normal(0, 1e-4, (n, 2)), np.zeros((n, 2)), np.ones((n, 2))
    for step in range(steps):
        num = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(num, 0)
        q = np.maximum(num / num.sum(), 1e-12)
        f = ((12.0 if step < 100 else 1.0) * p - q) * num
        grad = 4 * (np.diag(f.sum(1)) - f) @ y
        gain = np.maximum(np.where(np.sign(grad) != np.sign(v), gain + 0.2, gain * 0.8), 0.01)
        v = (0.5 if step < 100 else 0.8) * v - 200.0 * gain * grad
        y = y + v
        y -= y.mean(0)
    return y


def tsne_coords(paths: DataFrame, seed: int = 42, limit: int = 2000) -> DataFrame:
    """``id, x, y`` from a long distance table ``(u, v, dist)`` of at most ``limit`` nodes."""
    spark = paths.sparkSession
    if paths.count() > limit * limit:
        raise ValueError(f"more than {limit} nodes")
    pdf = paths.toPandas()
    ids = sorted(set(pdf.u))
    m = pdf.pivot(index="u", columns="v", values="dist").reindex(index=ids, columns=ids).to_numpy(dtype=float)
    y = tsne(m, seed=seed)
    return spark.createDataFrame(pd.DataFrame({"id": ids, "x": y[:, 0], "y": y[:, 1]}), "id string, x double, y double")


def convex_hulls(points: DataFrame, by: str) -> DataFrame:
    """``by, corner, x, y``: corners of each group's convex hull, counter-clockwise; groups below three points have none."""

    def hull(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(set(zip(pdf.x, pdf.y, strict=True)))
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

        def half(seq: list) -> list:
            out: list = []
            for q in seq:
                while len(out) > 1 and turn(out[-2], out[-1], q) <= 0:
                    out.pop()
                out.append(q)
            return out[:-1]

        corners = half(pts) + half(pts[::-1]) if len(pts) > 2 else []
        return pd.DataFrame({by: key[0], "corner": range(len(corners)), "x": [c[0] for c in corners], "y": [c[1] for c in corners]})

    kind = points.schema[by].dataType.simpleString()
    return points.groupBy(by).applyInPandas(hull, f"{by} {kind}, corner long, x double, y double")


def random_walks(edges: DataFrame, length: int = 30, per_node: int = 200, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """``walk array<string>``: second-order random walks, ``per_node`` from every node, each seeded by its start and number."""
    spark = edges.sparkSession
    if edges.count() > graph.CSR_EDGES:
        if p != 1.0 or q != 1.0:
            raise ValueError("walks over graphs of this size are of first order: p = q = 1")
        return walks_by_joins(edges, length, per_node, seed)
    adj = Adjacency.of(edges)
    shared = spark.sparkContext.broadcast(adj)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g: Adjacency = shared.value
        near = [set(g.to[g.off[v] : g.off[v + 1]].tolist()) for v in range(len(g.ids))]
        for batch in batches:
            out = []
            for s in batch["start"]:
                for k in range(per_node):
                    rng = np.random.default_rng([seed, int(s), k])
                    walk = [int(s)]
                    while len(walk) < length:
                        to = g.to[g.off[walk[-1]] : g.off[walk[-1] + 1]]
                        if len(walk) == 1 or (p == 1.0 and q == 1.0):
                            walk.append(int(to[rng.integers(len(to))]))
                        else:
                            w = np.array([1 / p if t == walk[-2] else 1.0 if t in near[walk[-2]] else 1 / q for t in to])
                            walk.append(int(rng.choice(to, p=w / w.sum())))
                    out.append([g.ids[v] for v in walk])
            yield pd.DataFrame({"walk": out})

    n = len(adj.ids)
    starts = spark.createDataFrame([(i,) for i in range(n)], "start long").repartition(min(max(1, n // 4), spark.sparkContext.defaultParallelism * 2))
    return starts.mapInPandas(run, "walk array<string>")


def walks_by_joins(edges: DataFrame, length: int, per_node: int, seed: int) -> DataFrame:
    """First-order walks over a graph of any size: each step joins every walk's end with one of its numbered neighbours.

    The number is a seeded hash of walk and step modulo the degree, so a repeated task takes the same step.
    """
    from pyspark.sql import Window

    links = graph.both_ways(edges)
    numbered = written(links.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("other")) - 1), "walk-links")
    degree = written(numbered.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "walk-degrees")
    walks = degree.select("id").withColumn("start", F.col("id")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_node)))).withColumn("walk", F.array("id"))
    for step in range(1, length):
        drawn = walks.join(degree, "id").withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "start", "k", F.lit(step)), F.col("degree")).cast("int"))
        moved = drawn.join(numbered, ["id", "at"]).select(F.col("other").alias("id"), "start", "k", F.array_append("walk", F.col("other")).alias("walk"))
        walks = written(moved, f"walks{step}") if step % 8 == 0 else moved
    return walks.select("walk")


def node_vectors(edges: DataFrame, dims: int = 64, length: int = 30, per_node: int = 200, window: int = 10, seed: int = 42) -> DataFrame:
    """``id, vector`` of skip-gram over random walks (``pyspark.ml`` Word2Vec)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    walks = random_walks(edges, length, per_node, seed=seed)
    model = Word2Vec(vectorSize=dims, windowSize=window, minCount=1, seed=seed, inputCol="walk", outputCol="v", maxIter=1).fit(walks)
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("vector"))


def ward(vectors: np.ndarray) -> np.ndarray:
    """Ward linkage of a small set of vectors: rows (a, b, height, size); new clusters are numbered from n."""
    n = len(vectors)
    vectors = np.asarray(vectors, float)
    norm = (vectors**2).sum(1)
    d = np.maximum(norm[:, None] + norm[None] - 2 * vectors @ vectors.T, 0.0)  # one matrix of n by n, whatever the dimensions
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), np.ones(n), []
    for k in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        a, b = sorted((name[i], name[j]))
        out.append((a, b, math.sqrt(d[i, j]), size[i] + size[j]))
        s = size[i] + size[j] + size
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / s
        new[[i, j]] = np.inf
        live = np.isfinite(d[i]) | np.isfinite(d[j])
        d[i] = d[:, i] = np.where(live, new, np.inf)
        d[j] = d[:, j] = np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        name[i] = n + k
    return np.array(out)


def ward_linkage(vectors: DataFrame, limit: int = 5000) -> DataFrame:
    """``a, b, height, size`` of :func:`ward` over ``(id, vector)`` in the order of the ids; more than ``limit`` rows raise."""
    if vectors.count() > limit:
        raise ValueError(f"more than {limit} vectors")
    rows = ward(np.array(vectors.orderBy("id").toPandas()["vector"].tolist()))
    return vectors.sparkSession.createDataFrame(pd.DataFrame(rows.reshape(-1, 4), columns=["a", "b", "height", "size"]), "a double, b double, height double, size double")
