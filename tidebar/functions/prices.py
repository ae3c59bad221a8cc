"""Expressions over prices: encodings, spread estimators, scalings, calendars of ids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT2 = math.sqrt(2)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), and null where one of them is not above 0."""
    return F.when((a > 0) & (b > 0), F.ln(F.try_divide(a, b)))


def percent_diff(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, b) * 100


def symlog(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def symexp(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def whole_shares(budget: Column, price: Column) -> Column:
    return F.floor(F.try_divide(budget, price))


def corwin_schultz_alpha(h1: Column, l1: Column, h2: Column, l2: Column) -> Column:
    """From two consecutive bars' highs and lows."""
    k = 3 - 2 * SQRT2
    beta = F.pow(log_ratio(h1, l1), 2) + F.pow(log_ratio(h2, l2), 2)
    gamma = F.pow(log_ratio(F.greatest(h1, h2), F.least(l1, l2)), 2)
    return (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)


def corwin_schultz_spread(alpha: Column) -> Column:
    """A share of the price; negative estimates are none."""
    return F.greatest(2 * F.expm1(alpha) / (1 + F.exp(alpha)), F.lit(0.0))


def abdi_ranaldo_moment(c1: Column, h1: Column, l1: Column, h2: Column, l2: Column) -> Column:
    """4 (c - eta)(c - eta') with eta the middle of a bar's log range."""
    eta = lambda h, l: (F.ln(h) + F.ln(l)) / 2  # noqa: E731, E741
    return 4 * (F.ln(c1) - eta(h1, l1)) * (F.ln(c1) - eta(h2, l2))


def impact_bps(k: float, sigma_bps: Column, participation: Column) -> Column:
    return F.lit(k) * sigma_bps * F.sqrt(participation)


def closure_kelly(mu: Column, variance: Column, most: float) -> Column:
    """The fraction that grows fastest, for a lognormal law of the horizon's log return, at most ``most`` either way."""
    m1, m2 = F.exp(mu + variance / 2), F.exp(2 * mu + 2 * variance)
    f = F.try_divide(m1 - 1, m2 - 2 * m1 + 1)
    return F.least(F.greatest(f, F.lit(-most)), F.lit(most))


def dof(prev: Column, o: Column, h: Column, low: Column, c: Column, volume: Column, usual: Column) -> dict[str, Column]:
    """A bar by five free coordinates: r, s, u, v, w.

    r is the log return, s the log range, u and v the places of close and open in that range (0.5 where the bar is
    flat), w the log of volume over its usual level.
    """
    safe = lambda x, other: F.when((x > 0) & ~F.isnan(x), x).otherwise(other)
    c_ = safe(c, prev)
    o_ = safe(o, c_)
    top, bottom = F.greatest(safe(h, c_), o_, c_), F.least(safe(low, c_), o_, c_)
    cut = lambda x: F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))
    s = cut(log_ratio(top, bottom))
    place = lambda p: F.when(s > 0, F.least(F.greatest(F.try_divide(log_ratio(p, bottom), s), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
    w = F.when((volume > 0) & (usual > 0), cut(log_ratio(volume, usual))).otherwise(0.0)
    return {"r": cut(log_ratio(c_, prev)), "s": s, "u": place(c_), "v": place(o_), "w": w}


def undof(prev: Column, r: Column, s: Column, u: Column, v: Column) -> dict[str, Column]:
    """Prices of a bar from its coordinates and the close before it."""
    close = prev * F.exp(r)
    low = close * F.exp(-u * s)
    return {"open": low * F.exp(v * s), "high": low * F.exp(s), "low": low, "close": close}


def eastern(ts_ms: Column) -> Column:
    """New York wall time of UTC epoch milliseconds, as a timestamp without zone."""
    utc = F.timestamp_add("MILLISECOND", ts_ms, F.expr("TIMESTAMP_NTZ'1970-01-01'"))
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), utc)


def time_ids(ts_ms: Column) -> dict[str, Column]:
    """minute of day, weekday (Monday 0) and session (0 night, 1 early, 2 regular, 3 late, 4 night) in New York."""
    local = eastern(ts_ms)
    minute = F.hour(local) * 60 + F.minute(local)
    session = F.when(minute < 240, 0).when(minute < 570, 1).when(minute < 960, 2).when(minute < 1200, 3).otherwise(4)
    return {"et_minute": minute, "et_weekday": F.weekday(local), "et_session": session, "et_day": F.to_date(local)}


def elapsed_bucket(gap_ms: Column, res_ms: int) -> Column:
    """1 + floor(log2(gap / resolution)), at least 1, at most 12; 0 without a bar before."""
    n = F.floor(gap_ms / res_ms).cast("long")
    return F.when(gap_ms.isNull(), 0).when(n < 1, 1).otherwise(F.least(F.length(F.bin(n)), F.lit(12))).cast("int")
