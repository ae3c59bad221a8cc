"""Mixtures of normal or Beta laws, fitted by expectation and maximisation: one additive aggregate over all rows a round.

A round is one pass of column arithmetic that adds up, for each component, the rows' shares and the shares times the law's
sufficient statistics.  Only those sums and the parameters, a few numbers a component, reach the driver.  The mean
log-likelihood never falls from round to round.  Rows that are null, not finite, or outside the law's support take no
part; without rows there is no fit.  A component whose share of the rows is ``LEAST`` or less keeps its place at that weight.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import log, pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions import special
from tidebar.functions.shared import percentiles

#: Weight below which a component holds no rows, and the change of the mean log-likelihood that ends a fit: fixed values.
LEAST, SETTLED, ROUNDS = 1e-9, 1e-8, 120


def _spots(df: DataFrame, column: str, k: int, takes: Callable[[Column], Column]) -> list[float] | None:
    """The middles of k equal parts of the rows that take part, and the quartiles; None without rows."""
    own = df.select(F.col(column).cast("double").alias("x")).where(takes(F.col("x")))
    row = percentiles(own, "x", [(c + 0.5) / k for c in range(k)] + [0.25, 0.75]).first()
    return row and list(row.cuts)


@dataclass(frozen=True)
class Gaussian:
    weights: tuple[float, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]
    floor: float = 1e-9

    @staticmethod
    def start(df: DataFrame, column: str, k: int, floor: float = 1e-9) -> Gaussian | None:
        """Means at the middles of k equal parts, deviations a k-th of the spread between the quartiles."""
        spots = _spots(df, column, k, Gaussian.takes)
        if spots is None:
            return None
        *means, low, high = spots
        return Gaussian((1 / k,) * k, tuple(means), (max(abs(high - low) / k, floor),) * k, floor)

    @staticmethod
    def takes(x: Column) -> Column:
        return (F.abs(x) < float("inf")) & ~F.isnan(x)

    def log_terms(self, x: Column) -> list[Column]:
        parts = zip(self.weights, self.means, self.sds, strict=True)
        return [F.lit(log(max(w, LEAST)) - log(s) - 0.5 * log(2 * pi)) - 0.5 * F.pow((x - m) / s, 2) for w, m, s in parts]

    @staticmethod
    def statistics(x: Column) -> list[Column]:
        return [x, x * x]

    def best(self, c: int, means: list[float]) -> Gaussian:
        """With component c at the maximum for the mean statistics of its rows."""
        mean, square = means
        sd = max(max(square - mean * mean, 0.0) ** 0.5, self.floor)
        put = lambda old, x: (*old[:c], x, *old[c + 1 :])
        return replace(self, means=put(self.means, mean), sds=put(self.sds, sd))

    def rows(self) -> list[tuple[float, float, float]]:
        return list(zip(self.weights, self.means, self.sds, strict=True))


@dataclass(frozen=True)
class Beta:
    weights: tuple[float, ...]
    alphas: tuple[float, ...]
    betas: tuple[float, ...]
    most: float = 1e6

    @staticmethod
    def start(df: DataFrame, column: str, k: int, most: float = 1e6) -> Beta | None:
        """Means as for normal laws; the concentration of a deviation of a k-th of the quartiles' spread, but with a peak."""
        spots = _spots(df, column, k, Beta.takes)
        if spots is None:
            return None
        *means, low, high = spots
        sd = max(abs(high - low) / k, 1e-3)
        total = [min(max(m * (1 - m) / sd**2 - 1, 2 / min(m, 1 - m)), most) for m in means]
        return Beta((1 / k,) * k, tuple(m * t for m, t in zip(means, total, strict=True)), tuple((1 - m) * t for m, t in zip(means, total, strict=True)), most)

    @staticmethod
    def takes(x: Column) -> Column:
        return (x > 0) & (x < 1)

    def log_terms(self, x: Column) -> list[Column]:
        a, b = np.array(self.alphas), np.array(self.betas)
        norm = (special.ln_gamma(a) + special.ln_gamma(b) - special.ln_gamma(a + b)).tolist()
        left, right = F.ln(x), F.log1p(-x)
        parts = zip(self.weights, self.alphas, self.betas, norm, strict=True)
        return [F.lit(log(max(w, LEAST)) - n) + F.lit(p - 1) * left + F.lit(q - 1) * right for w, p, q, n in parts]

    @staticmethod
    def statistics(x: Column) -> list[Column]:
        return [F.ln(x), F.log1p(-x)]

    def best(self, c: int, means: list[float]) -> Beta:
        """The maximum of (a - 1) g + (b - 1) h - ln B(a, b), which is concave: Newton's steps, halved until it rises."""
        g, h = means
        at = np.array([self.alphas[c], self.betas[c]])

        def value(p: np.ndarray) -> float:
            return float((p[0] - 1) * g + (p[1] - 1) * h - special.ln_gamma(p[0]) - special.ln_gamma(p[1]) + special.ln_gamma(p.sum()))

        now = value(at)
        for _ in range(100):
            slope = np.array([g, h]) - special.digamma(at) + special.digamma(at.sum())
            bend = np.diag(-special.trigamma(at)) + special.trigamma(at.sum())
            step, size = -np.linalg.solve(bend, slope), 1.0
            while size > 1e-10:
                new = np.clip(at + size * step, 1e-6, self.most)
                if (then := value(new)) >= now:
                    break
                size /= 2
            else:
                break
            moved, at, now = np.abs(new - at).max() > 1e-12 * np.abs(at).max(), new, then
            if not moved:
                break
        put = lambda old, x: (*old[:c], float(x), *old[c + 1 :])
        return replace(self, alphas=put(self.alphas, at[0]), betas=put(self.betas, at[1]))

    def rows(self) -> list[tuple[float, float, float]]:
        return list(zip(self.weights, self.alphas, self.betas, strict=True))


Law = Gaussian | Beta


def log_density(law: Law, x: Column) -> Column:
    """ln of the mixture's density; null outside its support."""
    terms = law.log_terms(x)
    most = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return F.when(law.takes(x), most + F.ln(sum((F.exp(t - most) for t in terms[1:]), F.exp(terms[0] - most))))


def sweep(df: DataFrame, column: str, law: Law) -> tuple[Law, float, int]:
    """(the next law, the mean log-likelihood of this one, rows) of one pass."""
    k, x = len(law.weights), F.col("_x")
    own = df.select(F.col(column).cast("double").alias("_x")).where(law.takes(x))
    own = own.select("_x", *(t.alias(f"_t{c}") for c, t in enumerate(law.log_terms(x))), log_density(law, x).alias("_ll"))
    stats = law.statistics(x)
    share = [F.exp(F.col(f"_t{c}") - F.col("_ll")) for c in range(k)]
    sums = [F.sum(share[c] * s) for c in range(k) for s in (F.lit(1.0), *stats)]
    n, total, *found = own.agg(F.count("*"), F.sum("_ll"), *sums).first()
    if not n:
        return law, float("nan"), 0
    weights, width = [], 1 + len(stats)
    for c in range(k):
        mass, *own_sums = found[c * width : (c + 1) * width]
        if not mass > n * LEAST:
            weights.append(LEAST)
            continue
        weights.append(mass / n)
        law = law.best(c, [s / mass for s in own_sums])
    whole = sum(weights)
    return replace(law, weights=tuple(w / whole for w in weights)), total / n, n


def fit(df: DataFrame, column: str, start: Law | None, rounds: int = ROUNDS, settled: float = SETTLED) -> tuple[Law | None, list[float]]:
    """The law and each round's mean log-likelihood; ends when that changes by less than ``settled``."""
    law, path = start, []
    for _ in range(rounds if law is not None else 0):
        nxt, level, n = sweep(df, column, law)
        if not n or not np.isfinite(level):
            break
        law = nxt
        path.append(level)
        if len(path) > 1 and abs(path[-1] - path[-2]) < settled:
            break
    return law, path
