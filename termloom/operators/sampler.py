"""Subgraphs of least likelihood: seeded Metropolis and simulated-annealing chains."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.coded import columns, numbered

#: Largest edge table, in edges, that a chain holds (three numbers each).
MAX_EDGES = 5_000_000


def run_chain(w: np.ndarray, term: np.ndarray, m: int, iterations: int, seed: int, temperature: float | None = None, cooling: float = 0.999995, log_every: int = 10_000) -> tuple[np.ndarray, float, list[tuple[int, float]]]:
    """Edges chosen, their log-likelihood and its course, of one chain.

    The state holds ``m`` edges; its value is ln gamma(W + 1) + the sum of the edges' terms, W their weight; smaller is better.
    A step swaps a chosen with another edge; it is taken when the value falls, else with probability exp(-rise), or
    exp(-rise / temperature) when annealing (then the temperature is multiplied by ``cooling`` each step). The best state is
    kept. With ``m`` at or above the number of edges all are chosen.
    """
    rng = np.random.default_rng(seed)
    n = len(w)
    m = min(m, n)
    order = rng.permutation(n)
    total = float(w[order[:m]].sum())
    value = math.lgamma(total + 1) + float(term[order[:m]].sum())
    best, best_value, course = order[:m].copy(), value, [(0, value)]
    if m == n or m == 0:
        return best, best_value, course
    on, off = order[:m].tolist(), array("q", order[m:].tobytes())  # one number is read faster than from numpy, in a fifth of a list's memory
    weight, terms, lgamma, exp = array("d", w.tobytes()), array("d", term.tobytes()), math.lgamma, math.exp
    held = lgamma(total + 1)
    step = 0
    while step < iterations:
        size = min(65_536, iterations - step)
        draws = zip(rng.integers(0, m, size).tolist(), rng.integers(0, n - m, size).tolist(), rng.random(size).tolist(), strict=True)
        for i, j, u in draws:
            x, y = on[i], off[j]
            new_total = total + weight[y] - weight[x]
            new_held = lgamma(new_total + 1)
            rise = new_held - held + terms[y] - terms[x]
            if rise < 0 or (u < exp(-min(rise, 700.0)) if temperature is None else temperature > 1e-9 and u < exp(-min(rise / temperature, 700.0))):
                on[i], off[j] = y, x
                total, held, value = new_total, new_held, value + rise
                if value < best_value - 1e-12:
                    best, best_value = list(on), value
            if temperature is not None:
                temperature *= cooling
            step += 1
            if step % log_every == 0:
                course.append((step, value))
    return np.array(best), best_value, course


def _chains(scored: DataFrame, method: str, m: int, iterations: int, chains: int, seed: int, start: float, cooling: float, log_every: int, course: bool) -> DataFrame:
    spark = scored.sparkSession
    n = scored.count()
    if n > MAX_EDGES:
        raise ValueError(f"{n} edges; the chains take at most {MAX_EDGES}")
    edges, path = numbered(scored.select("source", "target", F.col("cooccurrence_count").cast("double").alias("w"), F.col("loglik").cast("double").alias("loglik")), ["source", "target"], "chain-edges")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chain in (int(c) for batch in batches for c in batch["chain"]):
            w, term = np.empty(n), np.empty(n)
            if n:
                at, *given = columns(path, ["at", "w", "loglik"])
                w[at], term[at] = given
                del at, given
            best, value, log = run_chain(w, term, m, iterations, seed + chain, start if method == "sa" else None, cooling, log_every)
            if course:
                yield pd.DataFrame({"chain": chain, "at": [x[0] for x in log], "ll": [x[1] for x in log]})
            else:
                yield pd.DataFrame({"chain": chain, "at": np.sort(best), "ll": value})

    out = spark.range(0, chains, 1, chains).withColumnRenamed("id", "chain").mapInPandas(run, "chain long, at long, ll double")  # a task each
    if course:
        return out.select(F.lit(method).alias("method"), "chain", F.col("at").alias("iteration"), "ll")
    return out.join(edges, "at").select("chain", "source", "target", "ll")


def subgraph(scored: DataFrame, method: str = "glf", m: int = 500, iterations: int = 5_000_000, chains: int = 4, seed: int = 42, start: float = 5000.0, cooling: float = 0.999995) -> DataFrame:
    """``source, target, ll`` of the best of several seeded chains (``glf`` Metropolis, ``sa`` annealing); ties: first chain."""
    from termloom.session import written

    got = written(_chains(scored, method, m, iterations, chains, seed, start, cooling, 10**12, False), method)
    best = got.groupBy("chain").agg(F.min("ll").alias("ll")).orderBy("ll", "chain").limit(1).select("chain")
    return got.join(best, "chain", "left_semi").select("source", "target", "ll")


def trajectory(scored: DataFrame, method: str, m: int = 500, iterations: int = 5_000_000, chains: int = 1, seed: int = 42, start: float = 5000.0, cooling: float = 0.999995, log_every: int = 10_000) -> DataFrame:
    """``method, chain, iteration, ll``: the value of each chain every ``log_every`` steps."""
    return _chains(scored, method, m, iterations, chains, seed, start, cooling, log_every, True)
