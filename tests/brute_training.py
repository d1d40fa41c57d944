"""Additive models on one machine: what the library's distributed training must equal."""

from __future__ import annotations

import numpy as np


class Booster:
    """Additive model of histogram steps, one feature at a time in turn."""

    def __init__(self, bins: int = 16, rounds: int = 60, rate: float = 0.1):
        self.bins, self.rounds, self.rate = bins, rounds, rate
        self.edges: list[np.ndarray] = []
        self.scores: list[np.ndarray] = []
        self.base = 0.0

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, edges: list[np.ndarray] | None = None) -> Booster:
        w = np.ones(len(y)) if weight is None else weight.astype(float)
        self.edges = edges or [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.scores = [np.zeros(len(e) + 1) for e in self.edges]
        self.base = float(np.average(y, weights=w)) if w.sum() else 0.0
        codes, res = self.codes(x), y - self.base
        for _ in range(self.rounds):
            for j, c in enumerate(codes):
                s = np.bincount(c, w * res, len(self.scores[j])) / (np.bincount(c, w, len(self.scores[j])) + 1.0)
                self.scores[j] += self.rate * s
                res = res - self.rate * s[c]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(s[c] for s, c in zip(self.scores, self.codes(x), strict=True))

    def importance(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.abs(s[c]).mean() for s, c in zip(self.scores, self.codes(x), strict=True)])

    def shapes(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per feature: bin centers, scores, and the density of x (mass per unit)."""
        out = []
        for j, (edges, scores) in enumerate(zip(self.edges, self.scores, strict=True)):
            bounds = np.concatenate(([x[:, j].min()], edges, [x[:, j].max()]))
            mass = np.bincount(np.searchsorted(edges, x[:, j], side="right"), minlength=len(scores)) / len(x)
            width = np.diff(bounds)
            pdf = np.divide(mass, width, out=np.full(len(mass), np.nan), where=width > 0)
            pdf = np.where(np.isnan(pdf), np.nanmedian(pdf) if (~np.isnan(pdf)).any() else 1.0, pdf)
            out.append((0.5 * (bounds[:-1] + bounds[1:]), scores, pdf))
        return out


class Ensemble:
    """Boosters on bags of dates (counts of a block bootstrap) on common bins, and
    tables of the pairs of features that explain most of what is left."""

    def __init__(self, bags: int = 4, pairs: int = 2, block: int = 20, cells: int = 6, **how):
        self.n_bags, self.n_pairs, self.block, self.cells, self.how = bags, pairs, block, cells, how
        self.bags: list[Booster] = []
        self.given: np.ndarray | None = None  # how often a bag has each day
        self.rows: np.ndarray | None = None  # and each row
        self.pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def counts(self, dates: np.ndarray, bag: int) -> np.ndarray:
        """What the given counts of days say of each row's date."""
        return self.given[bag][np.unique(dates, return_inverse=True)[1]]

    def fit(self, x: np.ndarray, y: np.ndarray, dates: np.ndarray) -> Ensemble:
        weights = [np.ones(len(y))] if self.n_bags < 2 else [self.counts(dates, b) * (1 if self.rows is None else self.rows[b]) for b in range(self.n_bags)]
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(x.shape[1])]
        self.bags = [Booster(**self.how).fit(x, y, w, edges) for w in weights]
        res, found = y - self.predict(x), []
        for a in range(x.shape[1]):
            for b in range(a + 1, x.shape[1]):
                ea, eb = (np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cells + 1)[1:-1])) for j in (a, b))
                cell = np.searchsorted(ea, x[:, a], side="right") * (len(eb) + 1) + np.searchsorted(eb, x[:, b], side="right")
                n = np.bincount(cell, minlength=(len(ea) + 1) * (len(eb) + 1))
                s = np.bincount(cell, res, len(n)) / (n + 10.0)
                found.append((-float((n * s * s).sum()), a, b, ea, eb, s))
        self.pairs = [f[1:] for f in sorted(found, key=lambda f: f[:3])[: self.n_pairs]]
        return self

    def _cells(self, x: np.ndarray, a: int, b: int, ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
        return np.searchsorted(ea, x[:, a], side="right") * (len(eb) + 1) + np.searchsorted(eb, x[:, b], side="right")

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.mean([m.predict(x) for m in self.bags], axis=0)
        for a, b, ea, eb, s in self.pairs:
            out = out + s[self._cells(x, a, b, ea, eb)]
        return out

    def importance(self, x: np.ndarray, names: list[str]) -> list[tuple[str, float]]:
        """Terms with the mean of |score|; a pair is called `a & b`."""
        main = np.mean([m.importance(x) for m in self.bags], axis=0)
        return list(zip(names, main.tolist(), strict=True)) + [(f"{names[a]} & {names[b]}", float(np.abs(s[self._cells(x, a, b, ea, eb)]).mean())) for a, b, ea, eb, s in self.pairs]
