"""Parameters of a pipeline run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults of a full run. ``full_centrality`` off replaces centralities by flags of the largest component."""

    decay: float = 1.0
    full_centrality: bool = True
    pivots: int = 1000
    seed: int = 42
    target_edges: int = 500
    iterations: int = 5_000_000
    chains: int = 4
    temperature: float = 5000.0
    cooling: float = 0.999995
    prune_from: int | None = None
    #: Generations collected from given roots, the roots counted.
    generations: int = 3
    #: How seeds match articles: by heading, as the network's nodes are headings, or ``raw``, by equal pieces of the packed field.
    token_mode: str = "heading"
