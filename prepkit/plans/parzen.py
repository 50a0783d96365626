"""Search that learns: a tree-structured Parzen estimator proposes draws, median stopping ends bad ones early.

The draws told so far are parted into good ones and the rest. Each parameter gets two densities, sums of truncated
normals around the draws of either part and a flat one. Of some values drawn from the good density the next draw takes
the one whose good density is largest against the other. The driver holds the numbers of the draws alone; what a
draw costs, its fits, are Spark jobs of the objective.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist
from typing import NamedTuple

import numpy as np

_NORMAL = NormalDist()


class Range(NamedTuple):
    """The values of a parameter from ``low`` to ``high``, both included; ``kind`` is float, log or int."""

    low: float
    high: float
    kind: str = "float"

    def value(self, share: float) -> float | int:
        """The value at a share from 0 to 1 of the range."""
        if self.kind == "log":
            return math.exp(math.log(self.low) + share * (math.log(self.high) - math.log(self.low)))
        if self.kind == "int":
            return min(int(self.high), int(self.low) + int(share * (self.high - self.low + 1)))
        return self.low + share * (self.high - self.low)


class Density:
    """Truncated normals on [0, 1] around the points, as wide as the gap to the farther neighbour, and a flat part."""

    def __init__(self, points: Sequence[float]):
        self.at = np.sort(np.asarray(points, float))
        edges = np.concatenate([[0.0], self.at, [1.0]])
        gap = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        self.width = np.clip(gap, 1.0 / (1.0 + min(100, len(self.at))), 1.0)
        self.low = np.array([_NORMAL.cdf(-m / w) for m, w in zip(self.at, self.width, strict=True)])
        self.high = np.array([_NORMAL.cdf((1 - m) / w) for m, w in zip(self.at, self.width, strict=True)])

    def log(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.at) / self.width
        each = np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * self.width * (self.high - self.low))
        return np.log((1.0 + each.sum(axis=1)) / (1 + len(self.at)))

    def draw(self, rng: np.random.RandomState, n: int) -> np.ndarray:
        part, u = rng.randint(len(self.at) + 1, size=n), rng.uniform(size=n)
        out = u.copy()  # the last part is the flat one
        for i in np.flatnonzero(part < len(self.at)):
            k = part[i]
            p = min(max(self.low[k] + u[i] * (self.high[k] - self.low[k]), 1e-12), 1 - 1e-12)
            out[i] = self.at[k] + self.width[k] * _NORMAL.inv_cdf(p)
        return np.clip(out, 0.0, 1.0)


@dataclass
class Estimator:
    """Proposes values for ``ranges``; higher scores are better. The same seed and scores give the same draws."""

    ranges: dict[str, Range]
    seed: int = 42
    startup: int = 8  # draws at random before the densities are used
    good_share: float = 0.2
    tries: int = 24
    told: list[tuple[float, dict[str, float]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rng = np.random.RandomState(self.seed)

    def shares(self) -> dict[str, float]:
        """The next draw, as shares of the ranges."""
        if len(self.told) < self.startup:
            return {name: float(self.rng.uniform()) for name in self.ranges}
        best = sorted(range(len(self.told)), key=lambda i: (-self.told[i][0], i))  # ties: the earlier draw
        n_good = max(1, math.ceil(self.good_share * len(best)))
        out = {}
        for name in self.ranges:
            good = Density([self.told[i][1][name] for i in best[:n_good]])
            rest = Density([self.told[i][1][name] for i in best[n_good:]])
            x = good.draw(self.rng, self.tries)
            out[name] = float(x[int(np.argmax(good.log(x) - rest.log(x)))])
        return out

    def values(self, shares: dict[str, float]) -> dict[str, float | int]:
        return {name: r.value(shares[name]) for name, r in self.ranges.items()}

    def tell(self, shares: dict[str, float], score: float) -> None:
        """A score that isn't finite is the worst."""
        self.told.append((score if math.isfinite(score) else -math.inf, shares))


class Trial(NamedTuple):
    trial: int
    values: dict[str, float | int]
    score: float | None  # the mean over all folds; null for what was stopped or failed
    running: float | None  # the mean over the folds that were fitted
    folds: int
    state: str  # done, stopped or failed
    error: str | None


def optimise(estimator: Estimator, objective: Callable[[dict[str, float | int], int], float], trials: int, folds: int,
             warm: int = 4) -> list[Trial]:
    """Trials one after the other, each fold by fold; ``objective(values, fold)`` is the score of one fit.

    After ``warm`` whole trials, a trial ends once its mean so far lies below the median of the means that whole
    trials had after as many folds. A fold that raises ends its trial as failed; it is told as the worst.
    """
    out: list[Trial] = []
    means: list[list[float]] = []  # of whole trials, after each fold
    for t in range(trials):
        shares = estimator.shares()
        values = estimator.values(shares)
        scores: list[float] = []
        own: list[float] = []
        state, error = "done", None
        for f in range(folds):
            try:
                scores.append(float(objective(values, f)))
            except Exception as e:  # reported with the trial
                state, error = "failed", str(e)
                break
            own.append(float(np.mean(scores)))
            if f + 1 < folds and len(means) >= warm and not own[-1] >= float(np.median([m[f] for m in means])):
                state = "stopped"
                break
        if state == "done":
            means.append(own)
        estimator.tell(shares, own[-1] if own and state != "failed" else -math.inf)
        out.append(Trial(t, values, own[-1] if state == "done" and own else None, own[-1] if own else None, len(scores), state, error))
    return out
