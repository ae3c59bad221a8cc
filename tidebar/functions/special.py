"""Gamma, digamma, incomplete gamma, error function and normal law: NumPy over whole batches, and columns over Arrow.

Stated errors, held by tests: ``ln_gamma`` and ``digamma`` 1e-12 absolute up to 100 and relative beyond; ``gamma_p`` and
``gamma_q`` 1e-12 absolute for shapes up to 1,000; ``erfc`` and ``normal_cdf`` 1e-12 relative down to 1e-300.  Outside
their domains all give NaN, as a column null; null gives null.

Gamma and its derivatives take the argument up by ``LIFT`` steps in one product or sum and use the asymptotic series there,
whose coefficients come from Bernoulli's numbers by their recurrence.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LIFT, TERMS = 14, 9


def bernoulli(most: int) -> list[Fraction]:
    """B_0 to B_most, by the sum over all before."""
    out = [Fraction(1)]
    for n in range(1, most + 1):
        out.append(-sum(comb(n + 1, k) * out[k] for k in range(n)) / (n + 1))
    return out


_B = [float(b) for b in bernoulli(2 * TERMS)]


def _positive(x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.where(x > 0, x, np.nan)


def _lifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The argument of the series, and the steps (x, x + 1, ...) that lead there; 0 rows of steps where x is large."""
    low = x < LIFT
    return np.where(low, x + LIFT, x), np.where(low[..., None], x[..., None] + np.arange(LIFT), np.nan)


def _series(z: np.ndarray, coefficient: Callable[[int], float], power: int) -> np.ndarray:
    """Sum of coefficient(n) / z ** (2n + power), n from 1, from the least term up."""
    total, square = np.zeros_like(z), 1 / (z * z)
    for n in range(TERMS, 0, -1):
        total = (total + coefficient(n)) * square
    return total * z ** float(-power)


def ln_gamma(x) -> np.ndarray:
    x = _positive(x)
    z, steps = _lifted(x)
    tail = _series(z, lambda n: _B[2 * n] / (2 * n * (2 * n - 1)), -1)
    drop = np.where(x < LIFT, np.log(np.nanprod(steps, axis=-1)), 0.0)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + tail - drop


def digamma(x) -> np.ndarray:
    x = _positive(x)
    z, steps = _lifted(x)
    return np.log(z) - 0.5 / z - _series(z, lambda n: _B[2 * n] / (2 * n), 0) - np.nansum(1 / steps, axis=-1) + 0 * x


def trigamma(x) -> np.ndarray:
    x = _positive(x)
    z, steps = _lifted(x)
    return 1 / z + 0.5 / z**2 + _series(z, lambda n: _B[2 * n], 1) + np.nansum(1 / steps**2, axis=-1) + 0 * x


def _front(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x ** a * exp(-x) / Gamma(a)."""
    with np.errstate(divide="ignore"):
        return np.exp(a * np.log(x) - x - ln_gamma(a))


def _lower(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P by its series of rising powers; all terms are positive."""
    term = 1 / a
    total, n = term.copy(), 0
    while n < 100_000 and (term > total * 1e-17).any():
        n += 1
        term = term * (x / (a + n))
        total = total + term
    return total * _front(a, x)


def _upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q by Legendre's continued fraction, from its tail up, which adds no rounding to that of the last steps."""
    depth = 128 + int(16 * np.sqrt(a.max()))
    tail = x + 2 * depth + 1 - a
    for n in range(depth, 0, -1):
        tail = x + 2 * n - 1 - a - n * (n - a) / tail
    return _front(a, x) / tail


def _incomplete(a, x, upper: bool) -> np.ndarray:
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    known = (a > 0) & (x >= 0)
    small = known & (x < a + 1)
    large = known & ~small & np.isfinite(x)
    if small.any():
        p = np.where(x[small] > 0, _lower(a[small], np.maximum(x[small], 1e-320)), 0.0)
        out[small] = 1 - p if upper else p
    if large.any():
        q = _upper(a[large], x[large])
        out[large] = q if upper else 1 - q
    out[known & np.isposinf(x)] = 0.0 if upper else 1.0
    return out


def gamma_p(a, x) -> np.ndarray:
    """The regularised lower incomplete gamma function."""
    return _incomplete(a, x, False)


def gamma_q(a, x) -> np.ndarray:
    """Its complement, with its own relative precision where it is small."""
    return _incomplete(a, x, True)


def erfc(x) -> np.ndarray:
    x = np.asarray(x, float)
    far = gamma_q(0.5, x * x)
    return np.where(np.isnan(x), np.nan, np.where(x >= 0, far, 2 - far))


def normal_cdf(x) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(x, float) / np.sqrt(2))


def column(of: Callable[..., np.ndarray], *args: Column) -> Column:
    """``of`` over columns, in Arrow batches."""

    @F.pandas_udf("double")
    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series(of(*(p.to_numpy(float, na_value=np.nan) for p in parts)))

    return run(*(a.cast("double") for a in args))
