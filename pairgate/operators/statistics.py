"""Statistics that a caller gives to the bootstrap, as small mergeable states.

The bootstrap hands rows to ``update`` in blocks: rows of one block are in rising order of the score,
all rows of a score are in one block, and with them come the weights of many replicates at once.
``before`` and ``total`` tell, per replicate and label (0, 1), the weight of all rows with a smaller
score and of all rows, so ranks and quantiles of the whole are known inside a block and no class is
ever gathered.  A state is ``size`` numbers per replicate; Spark merges the states of blocks number
by number as ``merge`` says, and ``finish`` makes the value.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np


class Statistic(Protocol):
    """What the bootstrap needs; arrays have a row per score row or replicate as noted."""

    @property
    def size(self) -> int:
        """Numbers in a state."""

    @property
    def merge(self) -> tuple[str, ...]:
        """'sum', 'min' or 'max' for each of them."""

    def update(self, score: np.ndarray, label: np.ndarray, weight: np.ndarray, before: np.ndarray, total: np.ndarray) -> np.ndarray:
        """score, label: (rows); weight: (rows, replicates); before, total: (replicates, 2).
        Returns (replicates, size)."""

    def finish(self, state: np.ndarray, total: np.ndarray) -> np.ndarray:
        """(replicates, size) and (replicates, 2) to (replicates); NaN where it is undefined."""


def _cumulated(weight: np.ndarray) -> np.ndarray:
    """Weight of the rows before each row of a block."""
    return np.cumsum(weight, 0) - weight


def _by_score(score: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of equal scores added up: (scores, replicates)."""
    return np.add.reduceat(weight, np.flatnonzero(np.append(True, np.diff(score) != 0)), axis=0)


@dataclass(frozen=True)
class Auroc:
    """Share of (positive, negative) pairs in order, ties counting half."""

    size: int = 1
    merge: tuple[str, ...] = ("sum",)

    def update(self, score, label, weight, before, total):
        p = _by_score(score, np.where(label[:, None] == 1, weight, 0.0))
        n = _by_score(score, np.where(label[:, None] == 0, weight, 0.0))
        return (p * (before[:, 0] + _cumulated(n) + n / 2)).sum(0)[:, None]

    def finish(self, state, total):
        pairs = total[:, 0] * total[:, 1]
        return np.where(pairs > 0, state[:, 0] / np.where(pairs > 0, pairs, 1), np.nan)


@dataclass(frozen=True)
class TrimmedMean:
    """Mean score of the rows between two shares of all weight, boundary rows in part."""

    low: float = 0.1
    high: float = 0.9
    size: int = 1
    merge: tuple[str, ...] = ("sum",)

    def update(self, score, label, weight, before, total):
        start = before.sum(1) + _cumulated(weight)
        lo, hi = self.low * total.sum(1), self.high * total.sum(1)
        inside = np.clip(np.minimum(start + weight, hi) - np.maximum(start, lo), 0, None)
        return (score[:, None] * inside).sum(0)[:, None]

    def finish(self, state, total):
        whole = (self.high - self.low) * total.sum(1)
        return np.where(whole > 0, state[:, 0] / np.where(whole > 0, whole, 1), np.nan)


@dataclass(frozen=True)
class Spread:
    """Greatest minus smallest score that a replicate holds."""

    size: int = 2
    merge: tuple[str, ...] = field(default=("min", "max"))

    def update(self, score, label, weight, before, total):
        there = weight > 0
        low = np.where(there, score[:, None], np.inf).min(0)
        return np.stack((low, np.where(there, score[:, None], -np.inf).max(0)), 1)

    def finish(self, state, total):
        held = total.sum(1) > 0
        return np.where(held, np.where(held, state[:, 1], 0) - np.where(held, state[:, 0], 0), np.nan)
