"""Bars and their indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.folds import ema
from tidebar.operators import momentum as M
from tidebar.plans import query
from tidebar.sources.views import DAY, bars, bars_sql

BARS = bars_sql()
#: Symbols' bars numbered from 0, with what the indicators share.
NUMBERED = f"""{BARS}, numbered AS (
    SELECT *, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS d
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))"""


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def shown(df: DataFrame, *names: str) -> DataFrame:
    return df.select("symbol", "ts_ms", *(r6(n).alias(n) for n in names))


@query("ohlcv_1h", f"WITH {BARS} SELECT symbol, ts_ms, open, high, low, close, volume, round(vwap, 6) AS vwap, trades FROM bars")
def ohlcv_1h(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).withColumn("vwap", r6("vwap"))


@query("ohlcv_1d", f"WITH {bars_sql(DAY)} SELECT symbol, ts_ms, open, high, low, close, volume, round(vwap, 6) AS vwap, trades FROM bars")
def ohlcv_1d(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf, DAY).withColumn("vwap", r6("vwap"))


@query(
    "log_returns",
    f"""WITH {BARS} SELECT symbol, ts_ms, round(coalesce(ln(close / lag(close) OVER w), 0), 6) AS log_return
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)""",
)
def log_returns(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.with_log_returns(bars(spark, sf)), "log_return")


@query(
    "price_differences",
    f"""WITH {BARS} SELECT symbol, ts_ms, round(close - lag(close, 1, 100.0::DOUBLE) OVER w, 6) AS difference
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)""",
)
def price_differences(spark: SparkSession, sf: str) -> DataFrame:
    return shown(bars(spark, sf).withColumn("difference", M.differences()), "difference")


@query(
    "expanding_range",
    f"""WITH {BARS} SELECT symbol, ts_ms, round((max(high) OVER w - min(low) OVER w) / close, 6) AS expanding_range
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS UNBOUNDED PRECEDING)""",
)
def expanding_range(spark: SparkSession, sf: str) -> DataFrame:
    return shown(bars(spark, sf).withColumn("expanding_range", M.expanding_range()), "expanding_range")


@query(
    "price_normals",
    f"""WITH {BARS}, low AS (SELECT symbol, min(close) AS least FROM bars GROUP BY 1)
        SELECT symbol, ts_ms, round((close - least) / least, 6) AS price_normal FROM bars JOIN low USING (symbol)""",
)
def price_normals(spark: SparkSession, sf: str) -> DataFrame:
    return shown(bars(spark, sf).withColumn("price_normal", M.price_normals()), "price_normal")


def momentum_sql(columns: dict[str, str], extra: str = "") -> str:
    picked = ", ".join(f"round({sql}, 6) AS {name}" for name, sql in columns.items())
    return f"""WITH {NUMBERED}{extra} SELECT symbol, ts_ms, {picked} FROM {'five' if extra else 'numbered'}
        WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms),
               f14 AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
               f20 AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


def _back(k: int, bound: float) -> str:
    return f"CASE WHEN i >= {k} THEN least(greatest(close / lag(close, {k}) OVER w - 1, -{bound}), {bound}) ELSE 0 END"


@query("momentum_returns", momentum_sql({f"mom_{k}": _back(k, b) for k, b in ((5, 0.5), (60, 1.0), (120, 2.0))}))
def momentum_returns(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.momentum(bars(spark, sf)), "mom_5", "mom_60", "mom_120")


@query(
    "momentum_acceleration",
    momentum_sql(
        {"mom_accel": "CASE WHEN i >= 10 THEN least(greatest(mom_5 - lag(mom_5, 5) OVER w, -0.2), 0.2) ELSE 0 END"},
        f""", five AS (SELECT *, {_back(5, 0.5)} AS mom_5 FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))""",
    ),
)
def momentum_acceleration(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.momentum(bars(spark, sf)), "mom_accel")


@query(
    "rsi14",
    momentum_sql(
        {
            "rsi": """CASE WHEN i >= 14 THEN 1 - 1 / (1 + sum(greatest(d, 0)) OVER f14
                      / greatest(sum(greatest(-d, 0)) OVER f14, 1e-10)) ELSE 0.5 END"""
        }
    ),
)
def rsi14(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.momentum(bars(spark, sf)), "rsi")


@query(
    "trend_strength",
    momentum_sql(
        {
            "trend_strength": """CASE WHEN i >= 14 THEN greatest(count(*) FILTER (d > 0) OVER f14,
                                 count(*) FILTER (d < 0) OVER f14) / 14.0::DOUBLE ELSE 0 END"""
        }
    ),
)
def trend_strength(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.momentum(bars(spark, sf)), "trend_strength")


_PLACE = "(close - min(close) OVER f20) / greatest(max(close) OVER f20 - min(close) OVER f20, 1e-10)"


@query(
    "stoch_range",
    momentum_sql(
        {
            "range_pos": f"CASE WHEN i >= 20 THEN {_PLACE} * 2 - 1 ELSE 0 END",
            "stoch_k": f"CASE WHEN i >= 20 THEN {_PLACE} ELSE 0.5 END",
        }
    ),
)
def stoch_range(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.momentum(bars(spark, sf)), "range_pos", "stoch_k")


@query(
    "zscore20",
    momentum_sql(
        {
            "zscore": """CASE WHEN i >= 20 THEN least(greatest((close - avg(close) OVER f20)
                         / greatest(stddev_pop(close) OVER f20, 1e-10), -3), 3) ELSE 0 END"""
        }
    ),
)
def zscore20(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.momentum(bars(spark, sf)), "zscore")


@query(
    "vol_adj_mom",
    momentum_sql(
        {
            "vol_adj_mom": """CASE WHEN i >= 20 THEN least(greatest((close / lag(close, 20) OVER w - 1)
                / greatest(greatest(stddev_pop(close) OVER f20, 1e-10) / avg(close) OVER f20, 1e-10), -5), 5) ELSE 0 END"""
        }
    ),
)
def vol_adj_mom(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.momentum(bars(spark, sf)), "vol_adj_mom")


@query(
    "efficiency20",
    momentum_sql(
        {
            "efficiency": """CASE WHEN i >= 20 THEN least(greatest(abs(close - lag(close, 20) OVER w)
                             / greatest(sum(abs(d)) OVER f20, 1e-10), 0), 1) ELSE 0 END"""
        }
    ),
)
def efficiency20(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.momentum(bars(spark, sf)), "efficiency")


def recursive_sql(start: str, step: str, out: str, source: str = NUMBERED) -> str:
    """Recursion over a symbol's bars: ``start`` and ``step`` give column lists after (symbol, i)."""
    return f"""WITH RECURSIVE {source}, walk AS (
        SELECT n.symbol, n.i, {start} FROM numbered n WHERE n.i = 0
        UNION ALL
        SELECT n.symbol, n.i, {step} FROM walk p JOIN numbered n ON n.symbol = p.symbol AND n.i = p.i + 1)
        SELECT n.symbol, n.ts_ms, {out} FROM walk p JOIN numbered n ON n.symbol = p.symbol AND n.i = p.i"""


@query(
    "ema_price",
    recursive_sql(
        "close AS e", "0.1::DOUBLE * n.close + (1 - 0.1::DOUBLE) * p.e AS e",
        "round(e, 6) AS ema, round((close - e) / e, 6) AS ema_diff",
    ),
)
def ema_price(spark: SparkSession, sf: str) -> DataFrame:
    found = ema(bars(spark, sf), "close", {"ema": 0.1})
    return shown(found.withColumn("ema_diff", (F.col("close") - F.col("ema")) / F.col("ema")), "ema", "ema_diff")


@query(
    "rsi_ema",
    recursive_sql(
        "1.0::DOUBLE AS u, 0.0::DOUBLE AS v",
        "greatest(n.d, 0) / 14 + (1 - 1 / 14.0::DOUBLE) * p.u AS u, greatest(-n.d, 0) / 14 + (1 - 1 / 14.0::DOUBLE) * p.v AS v",
        "round(100 * u / (u + v), 6) AS rsi_ema, round(u / (u + v), 6) AS rsi_percent",
    ),
)
def rsi_ema(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.rsi_ema(bars(spark, sf)), "rsi_ema", "rsi_percent")


@query(
    "macd_ema",
    recursive_sql(
        "close AS f, close AS s",
        """n.close / 12 + (1 - 1 / 12.0::DOUBLE) * p.f AS f, n.close / 26 + (1 - 1 / 26.0::DOUBLE) * p.s AS s""",
        "round(f - s, 6) AS macd_plain",
    ),
)
def macd_ema(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.macd_plain(bars(spark, sf)), "macd_plain")


@query(
    "macd_percent",
    recursive_sql(
        "close AS f, close AS s",
        "n.close * (2 / 13.0::DOUBLE) + (1 - 2 / 13.0::DOUBLE) * p.f AS f, n.close * (2 / 27.0::DOUBLE) + (1 - 2 / 27.0::DOUBLE) * p.s AS s",
        "round(CASE WHEN n.i > 0 THEN least(greatest((f - s) / close * 100, -5), 5) ELSE 0 END, 6) AS macd",
    ),
)
def macd_percent(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.macd(bars(spark, sf)), "macd")


@query(
    "rolling_vol",
    f"""WITH {NUMBERED}, returns AS (
            SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms)) AS r FROM numbered)
        SELECT symbol, ts_ms, round(CASE WHEN i >= 20 THEN stddev_pop(r) OVER (PARTITION BY symbol ORDER BY ts_ms
               ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) * sqrt(19656.0::DOUBLE) * 100 END, 6) AS rolling_vol FROM returns""",
)
def rolling_vol(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.rolling_volatility(bars(spark, sf)), "rolling_vol")


@query(
    "rolling_sharpe",
    f"""WITH {NUMBERED}, returns AS (
            SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms)) AS r FROM numbered
        ), framed AS (
            SELECT *, avg(r) OVER f AS m, stddev_pop(r) OVER f AS s FROM returns
            WINDOW f AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING)
        ), falls AS (
            SELECT a.symbol, a.i, b.close,
                   max(b.close) OVER (PARTITION BY a.symbol, a.i ORDER BY b.i ROWS UNBOUNDED PRECEDING) AS peak
            FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 100 AND a.i - 1 WHERE a.i >= 100
        ), worst AS (SELECT symbol, i, max(1 - close / peak) AS fall FROM falls GROUP BY 1, 2)
        SELECT f.symbol, f.ts_ms,
               round(CASE WHEN f.i >= 100 THEN CASE WHEN s > 1e-10 THEN m / s * sqrt(19656.0::DOUBLE) ELSE 0 END END, 6) AS rolling_sharpe,
               round(fall, 6) AS rolling_drawdown
        FROM framed f LEFT JOIN worst w ON f.symbol = w.symbol AND f.i = w.i""",
)
def rolling_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.rolling_sharpe(bars(spark, sf)), "rolling_sharpe", "rolling_drawdown")


@query(
    "running_drawdown",
    f"""WITH {BARS} SELECT symbol, ts_ms, max(close) OVER w AS peak, round(1 - close / max(close) OVER w, 6) AS drawdown
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS UNBOUNDED PRECEDING)""",
)
def running_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.drawdown(bars(spark, sf)), "peak", "drawdown")


@query(
    "volume_reference",
    recursive_sql(
        "volume AS e, volume AS before", "n.volume * (2 / 21.0::DOUBLE) + (1 - 2 / 21.0::DOUBLE) * p.e AS e, p.e AS before",
        "round(before, 6) AS ema_volume",
    ),
)
def volume_reference(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.volume_reference(bars(spark, sf)), "ema_volume")


#: Steps of an agent, out of the hourly bars: reward is the return; every 97th step terminates, every 41st is cut.
STEPS = f"""{NUMBERED}, steps AS (
    SELECT symbol AS env, i AS t, coalesce(ln(close / lag(close) OVER w), 0) AS reward, close / 100 AS value,
           coalesce(lead(close) OVER w / 100, 0) AS next_value, i % 97 = 96 AS terminated, i % 41 = 40 AS truncated
    FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))"""


@query(
    "gae",
    f"""WITH RECURSIVE {STEPS}, back AS (
            SELECT *, row_number() OVER (PARTITION BY env ORDER BY t DESC) AS k,
                   reward + CASE WHEN terminated THEN 0 ELSE 0.995::DOUBLE * next_value END - value AS delta FROM steps
        ), walk AS (
            SELECT env, k, delta AS a FROM back WHERE k = 1
            UNION ALL
            SELECT b.env, b.k, b.delta + CASE WHEN terminated OR truncated THEN 0 ELSE 0.995::DOUBLE * 0.95::DOUBLE * p.a END
            FROM walk p JOIN back b ON b.env = p.env AND b.k = p.k + 1)
        SELECT b.env, b.t, round(a, 6) AS advantage, round(a + value, 6) AS value_target
        FROM walk w JOIN back b ON w.env = b.env AND w.k = b.k""",
)
def gae(spark: SparkSession, sf: str) -> DataFrame:
    numbered = bars(spark, sf).withColumn("t", M.index().cast("long"))
    steps = numbered.select(
        F.col("symbol").alias("env"), "t", F.coalesce(M.log_return(), F.lit(0.0)).alias("reward"),
        (F.col("close") / 100).alias("value"), F.coalesce(F.lead("close").over(M.by()) / 100, F.lit(0.0)).alias("next_value"),
        (F.col("t") % 97 == 96).alias("terminated"), (F.col("t") % 41 == 40).alias("truncated"),
    )
    return M.gae(steps).select("env", "t", r6("advantage").alias("advantage"), r6("value_target").alias("value_target"))
