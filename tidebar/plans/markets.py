"""Costs, panels, backtests, forecast statistics, encodings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions import prices as P
from tidebar.operators import costs as C
from tidebar.operators import horizons as Z
from tidebar.operators import momentum as M
from tidebar.operators import panel as N
from tidebar.operators import reports as R
from tidebar.operators import skill as S
from tidebar.operators import support as B
from tidebar.operators import universe as U
from tidebar.plans import query
from tidebar.plans.indicators import BARS, NUMBERED, r6, recursive_sql, shown
from tidebar.sources.views import DAY, HOUR, bars, bars_sql

COST_BASE = f"""{BARS}, pairs AS (
    SELECT *, lead(ts_ms) OVER w - ts_ms = {HOUR} AS paired, ts_ms - lag(ts_ms) OVER w = {HOUR} AS joined,
           lead(high) OVER w AS h2, lead(low) OVER w AS l2, lead(close) OVER w AS c2, lag(close) OVER w AS c0
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)
), parts AS (
    SELECT *, power(ln(high / low), 2) + power(ln(h2 / l2), 2) AS beta,
           power(ln(greatest(high, h2) / least(low, l2)), 2) AS gamma,
           4 * (ln(close) - (ln(high) + ln(low)) / 2) * (ln(close) - (ln(h2) + ln(l2)) / 2) AS moment
    FROM pairs
), estimates AS (
    SELECT *, CASE WHEN paired THEN (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) END AS alpha,
           CASE WHEN paired THEN moment END AS ar, CASE WHEN joined THEN ln(close / c0) END AS r,
           CASE WHEN paired THEN ln(c2 / close) END AS later, vwap * volume AS dollars, ts_ms // {DAY} AS day, 24288 AS jan
    FROM parts), leveled AS (SELECT *, jan AS month FROM estimates UNION ALL SELECT *, NULL AS month FROM estimates)"""


@query(
    "spread_estimators",
    f"""WITH {COST_BASE} SELECT symbol, ts_ms, round(alpha, 6) AS alpha, round(greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0), 6) AS cs_spread,
        round(ar, 6) AS ar_moment FROM estimates WHERE paired""",
)
def spread_estimators(spark: SparkSession, sf: str) -> DataFrame:
    lead = lambda c: F.lead(c).over(M.by())
    found = bars(spark, sf).withColumns(
        {
            "alpha": P.corwin_schultz_alpha(F.col("high"), F.col("low"), lead("high"), lead("low")),
            "ar_moment": P.abdi_ranaldo_moment(F.col("close"), F.col("high"), F.col("low"), lead("high"), lead("low")),
            "_gap": lead("ts_ms") - F.col("ts_ms"),
        }
    ).where(F.col("_gap") == HOUR)
    return shown(found.withColumn("cs_spread", P.corwin_schultz_spread(F.col("alpha"))), "alpha", "cs_spread", "ar_moment")


MEASURED = f"""{COST_BASE}, days AS (SELECT symbol, month, day, sum(dollars) AS dollars FROM leveled GROUP BY 1, 2, 3
), daily AS (SELECT symbol, month, median(dollars) AS daily_dollars, count(*) AS days FROM days GROUP BY 1, 2
), sums AS (
    SELECT symbol, month, count(*) AS bars, count(alpha) AS pairs, avg(alpha) AS alpha, avg(ar) AS ar, stddev_samp(r) AS sd,
           avg(r * later) AS roll, count(r * later) AS roll_pairs, sum(1 / close) AS inverse FROM leveled GROUP BY 1, 2
), measured AS (
    SELECT s.symbol, s.month, bars, pairs, days, daily_dollars, sd * sqrt(24.0::DOUBLE) AS sigma_daily,
           greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) AS cs_spread, CASE WHEN ar > 0 THEN sqrt(ar) END AS ar_spread,
           CASE WHEN roll < 0 AND roll_pairs >= 64 THEN 2 * sqrt(-roll) END AS roll_spread, bars / inverse AS harmonic_price
    FROM sums s JOIN daily d ON s.symbol = d.symbol AND s.month IS NOT DISTINCT FROM d.month)"""
_FIELDS = ("daily_dollars", "sigma_daily", "cs_spread", "ar_spread", "roll_spread", "harmonic_price")


@query(
    "monthly_liquidity",
    f"WITH {MEASURED} SELECT symbol, month, bars, pairs, days, {', '.join(f'round({f}, 6) AS {f}' for f in _FIELDS)} FROM measured",
)
def monthly_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    found = C.measured(bars(spark, sf), HOUR, 24)
    return found.select("symbol", "month", "bars", "pairs", "days", *(r6(f).alias(f) for f in _FIELDS))


USER_DAILY = f"""{bars_sql(DAY, "user_id")}, names AS (
    SELECT symbol, median(vwap * volume) AS daily_dollars, stddev_samp(close) / avg(close) AS sigma_daily, avg(ln(high / low)) AS spread
    FROM bars GROUP BY 1)"""


def user_costs(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf, DAY, "user_id").groupBy("symbol").agg(
        F.median(F.col("vwap") * F.col("volume")).alias("daily_dollars"),
        (F.stddev_samp("close") / F.avg("close")).alias("sigma_daily"), F.avg(P.log_ratio(F.col("high"), F.col("low"))).alias("spread"),
    )


@query(
    "cost_deciles",
    f"""WITH {USER_DAILY}, ranked AS (SELECT *, row_number() OVER (ORDER BY round(daily_dollars, 6) NULLS FIRST, symbol) - 1 AS i, count(*) OVER () AS n FROM names),
        sliced AS (SELECT *, (((i + 1) * 10 - 1) // n)::INTEGER AS decile FROM ranked)
        SELECT decile, count(*) AS symbols, round(median(daily_dollars), 6) AS daily_dollars, round(median(sigma_daily), 6) AS sigma_daily,
               round(median(spread), 6) AS spread, round(median(spread) / 2 * 10000 + median(sigma_daily) * 10000 * sqrt(0.01::DOUBLE), 6) AS all_in_bps
        FROM sliced GROUP BY 1""",
)
def cost_deciles(spark: SparkSession, sf: str) -> DataFrame:
    own = user_costs(spark, sf).withColumn("_by", F.round("daily_dollars", 6))
    found = C.deciles(own, "_by", ["daily_dollars", "sigma_daily", "spread"])
    found = found.withColumn("all_in_bps", C.all_in_bps(F.col("spread"), F.col("sigma_daily"), 0.01))
    return found.select("decile", "symbols", *(r6(c).alias(c) for c in ("daily_dollars", "sigma_daily", "spread", "all_in_bps")))


AUMS = (1e4, 1e5, 1e6, 1e7)


@query(
    "capacity_curve",
    f"""WITH {USER_DAILY}, books AS (SELECT symbol AS book, spread * 3 AS gross, spread AS fixed, sigma_daily / sqrt(daily_dollars) AS impact FROM names),
             aums AS (SELECT unnest([{", ".join(f"{a}::DOUBLE" for a in AUMS)}]) AS aum)
        SELECT book, aum, round(gross - fixed - sqrt(aum) * impact, 6) AS net,
               round(CASE WHEN gross - fixed <= 0 THEN 0 WHEN impact > 0 THEN power((gross - fixed) / impact, 2) END, 4) AS capacity
        FROM books, aums""",
)
def capacity_curve(spark: SparkSession, sf: str) -> DataFrame:
    books = user_costs(spark, sf).select(
        F.col("symbol").alias("book"), (F.col("spread") * 3).alias("gross"), F.col("spread").alias("fixed"),
        (F.col("sigma_daily") / F.sqrt("daily_dollars")).alias("impact"),
    )
    found = C.capacity(books, AUMS)
    return found.select("book", "aum", r6("net").alias("net"), F.round("capacity", 4).alias("capacity"))


# --- panels

PANEL = f"""{BARS}, clock AS (
    SELECT ts_ms, row_number() OVER (ORDER BY ts_ms) - 1 AS t, lag(ts_ms) OVER (ORDER BY ts_ms) AS tick FROM (SELECT DISTINCT ts_ms FROM bars)
), chained AS (
    SELECT *, lag(ts_ms) OVER w AS prev, lag(close) OVER w AS c0 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)
), panel AS (
    SELECT t, c.ts_ms, symbol, ln(close / c0) AS realized_r, close FROM chained c JOIN clock k USING (ts_ms)
    WHERE prev = tick AND close > 0 AND c0 > 0)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return N.returns(bars(spark, sf))


@query("panel_returns", f"WITH {PANEL} SELECT t, ts_ms, symbol, round(realized_r, 6) AS realized_r FROM panel")
def panel_returns(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select(F.col("t").cast("long").alias("t"), "ts_ms", "symbol", r6("realized_r").alias("realized_r"))


#: Scores of names: the return before, turned round.
SCORED = f"""{PANEL}, scored AS (
    SELECT *, -coalesce(lag(realized_r) OVER (PARTITION BY symbol ORDER BY t), 0) AS score FROM panel
), centred AS (SELECT *, greatest(score, 0) AS l, score - avg(score) OVER (PARTITION BY t) AS c FROM scored
), weighed AS (
    SELECT *, coalesce(l / nullif(sum(abs(l)) OVER at_t, 0), 0) AS long_only, coalesce(score / nullif(sum(abs(score)) OVER at_t, 0), 0) AS signed,
           coalesce(c / nullif(sum(abs(c)) OVER at_t, 0), 0) AS neutral
    FROM centred WINDOW at_t AS (PARTITION BY t))"""


def weighed(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("realized_r").over(W.partitionBy("symbol").orderBy("t"))
    return N.book_weights(panel(spark, sf).withColumn("score", -F.coalesce(before, F.lit(0.0))), "score")


@query(
    "book_weights",
    f"""WITH {SCORED} SELECT t, symbol, round(long_only, 6) AS long_only, round(signed, 6) AS signed,
               round(CASE WHEN min(score) OVER at_t < max(score) OVER at_t THEN neutral ELSE 0 END, 6) AS neutral
        FROM weighed WINDOW at_t AS (PARTITION BY t)""",
)
def book_weights(spark: SparkSession, sf: str) -> DataFrame:
    found = weighed(spark, sf)
    return found.select(F.col("t").cast("long").alias("t"), "symbol", *(r6(c).alias(c) for c in ("long_only", "signed", "neutral")))


@query(
    "panel_backtest_flat",
    f"""WITH {SCORED}, held AS (
            SELECT t, symbol, signed AS w, realized_r, lag(t) OVER o AS before, lead(t) OVER o AS later, lag(signed) OVER o AS w0
            FROM weighed WINDOW o AS (PARTITION BY symbol ORDER BY t)
        ), legs AS (
            SELECT t, w * (exp(realized_r) - 1) AS pay, abs(w - CASE WHEN before = t - 1 THEN w0 ELSE 0 END) AS trade FROM held
            UNION ALL SELECT t + 1, 0, abs(w) FROM held WHERE (later IS NULL OR later > t + 1) AND t < (SELECT max(t) FROM held)
        ), steps AS (SELECT t, sum(pay) AS gross_r, sum(trade) AS turnover FROM legs GROUP BY 1)
        SELECT t, round(gross_r, 6) AS gross_r, round(turnover, 6) AS turnover, round(gross_r - turnover * 5 / 10000, 6) AS net_r FROM steps""",
)
def panel_backtest_flat(spark: SparkSession, sf: str) -> DataFrame:
    found = N.panel_backtest(weighed(spark, sf), "signed", 5.0)
    return found.select(F.col("t").cast("long").alias("t"), *(r6(c).alias(c) for c in ("gross_r", "turnover", "net_r")))


@query(
    "pairwise_corr",
    f"""WITH {PANEL}, whole AS (SELECT * FROM panel WHERE t IN (SELECT t FROM panel GROUP BY 1 HAVING count(*) = 5)),
             z AS (SELECT t, symbol, (realized_r - avg(realized_r) OVER s) / stddev_pop(realized_r) OVER s AS z FROM whole WINDOW s AS (PARTITION BY symbol)),
             sums AS (SELECT t, sum(z) AS z, count(*) AS n FROM z GROUP BY 1)
        SELECT max(n) AS names, round((avg(z * z) - max(n)) / (max(n) * max(n) - max(n)), 6) AS mean_correlation FROM sums""",
)
def pairwise_corr(spark: SparkSession, sf: str) -> DataFrame:
    own = panel(spark, sf).withColumn("_n", F.count("*").over(W.partitionBy("t"))).where("_n = 5")
    return N.pairwise_correlation(own, "realized_r").withColumn("mean_correlation", r6("mean_correlation"))


@query(
    "equal_weight_benchmark",
    f"""WITH {NUMBERED}, entry AS (SELECT symbol, open AS first_open FROM numbered WHERE i = 1)
        SELECT i AS step, round(sum(CASE WHEN i = 0 THEN 10000.0 / 5 ELSE 10000.0 / 5 / first_open * close END), 4) AS value, count(*) AS names
        FROM numbered JOIN entry USING (symbol) GROUP BY 1""",
)
def equal_weight_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    found = N.equal_weight_benchmark(bars(spark, sf))
    return found.select(F.col("step").cast("long").alias("step"), F.round("value", 4).alias("value"), "names")


EQUITY = f"""{BARS}, equity AS (SELECT symbol, ts_ms, 10000.0::DOUBLE * close / first_value(close) OVER w AS value
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))"""
_METRICS = ("total_return", "max_drawdown", "sharpe", "sortino", "calmar", "win_rate")


def equity(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", "ts_ms", (10_000.0 * F.col("close") / F.first("close").over(M.by())).alias("value"))


@query(
    "backtest_metrics",
    f"""WITH {EQUITY}, steps AS (
            SELECT *, value / lag(value) OVER w - 1 AS r, (1 - value / greatest(max(value) OVER w, 10000)) * 100 AS fall
            FROM equity WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS UNBOUNDED PRECEDING)
        ), stats AS (
            SELECT symbol, count(r) AS returns, (arg_max(value, ts_ms) / 10000 - 1) * 100 AS total, max(fall) AS fall, avg(r) AS m,
                   stddev_pop(r) AS sd, stddev_pop(r) FILTER (r < 0) AS down, avg((r > 0)::INTEGER) AS win_rate FROM steps GROUP BY 1)
        SELECT symbol, returns, round(total, 6) AS total_return, round(fall, 6) AS max_drawdown, round(coalesce(CASE WHEN sd > 0 THEN m / sd END, 0), 6) AS sharpe,
               round(coalesce(CASE WHEN down > 0 THEN m / down END, 0), 6) AS sortino, round(coalesce(total / nullif(fall, 0), 0), 6) AS calmar, round(win_rate, 6) AS win_rate FROM stats""",
)
def backtest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = N.metrics(equity(spark, sf), "symbol", "ts_ms", "value")
    return found.select("symbol", "returns", *(r6(c).alias(c) for c in _METRICS))


@query(
    "population_stats",
    f"""WITH {BARS}, k AS (SELECT close, row_number() OVER (ORDER BY close) - 1 AS k, count(*) OVER () AS n FROM bars)
        SELECT max(close) FILTER (k = floor((n - 1) * 0.05::DOUBLE + 0.5)) AS p05, max(close) FILTER (k = floor((n - 1) * 0.5::DOUBLE + 0.5)) AS p50,
               max(close) FILTER (k = floor((n - 1) * 0.95::DOUBLE + 0.5)) AS p95 FROM k""",
)
def population_stats(spark: SparkSession, sf: str) -> DataFrame:
    return N.nearest_rank_by_rows(bars(spark, sf), "close", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


# --- forecasts: mu is the score of a name, r its return

FORECAST = f"{SCORED}, forecast AS (SELECT t, symbol, round(score, 6) AS mu, round(realized_r, 6) AS r FROM scored)"


def forecast(spark: SparkSession, sf: str) -> DataFrame:
    return weighed(spark, sf).select("t", "symbol", r6("score").alias("mu"), r6("realized_r").alias("r"))


RANKED = f"""{FORECAST}, ranked AS (
    SELECT *, rank() OVER (ORDER BY mu) + (count(*) OVER (PARTITION BY mu) - 1) / 2.0::DOUBLE AS a,
           rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0::DOUBLE AS b FROM forecast)"""


@query("spearman_ic", f"WITH {RANKED} SELECT round(corr(mu, r), 6) AS pearson, round(corr(a, b), 6) AS spearman, count(*) AS n FROM ranked")
def spearman_ic(spark: SparkSession, sf: str) -> DataFrame:
    return S.information(forecast(spark, sf)).select(r6("pearson").alias("pearson"), r6("spearman").alias("spearman"), "n")


@query(
    "within_name_ic",
    f"""WITH {FORECAST}, own AS (SELECT symbol, corr(mu, r) AS c FROM forecast GROUP BY 1)
        SELECT count(*) AS keys, round(median(c), 6) AS median_ic, round(avg(c), 6) AS mean_ic, round(avg((c > 0)::INTEGER), 6) AS share_positive FROM own""",
)
def within_name_ic(spark: SparkSession, sf: str) -> DataFrame:
    found = S.within(forecast(spark, sf), "symbol")
    return found.select("keys", *(r6(c).alias(c) for c in ("median_ic", "mean_ic", "share_positive")))


@query(
    "confusion_report",
    f"""WITH {FORECAST}, c AS (
            SELECT count(*) FILTER (mu > 0 AND r > 0) AS tp, count(*) FILTER (mu > 0 AND r < 0) AS fp, count(*) FILTER (mu < 0 AND r > 0) AS fn,
                   count(*) FILTER (mu < 0 AND r < 0) AS tn, count(*) FILTER (mu = 0) AS undirected, count(*) FILTER (r = 0) AS flat,
                   avg(sign(mu) * r) FILTER (mu <> 0) * 10000 AS edge FROM forecast)
        SELECT tp, fp, fn, tn, undirected, flat, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
               round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced, round(tp / (tp + fp), 6) AS precision,
               round((tp + fn) / (tp + fp + fn + tn), 6) AS base_rate,
               round(greatest((tp + fn) / (tp + fp + fn + tn), (fp + tn) / (tp + fp + fn + tn)), 6) AS majority, round(edge, 6) AS edge_bps FROM c""",
)
def confusion_report(spark: SparkSession, sf: str) -> DataFrame:
    found = S.confusion(forecast(spark, sf))
    rounded = ("accuracy", "balanced", "precision", "base_rate", "majority", "edge_bps")
    return found.select("tp", "fp", "fn", "tn", "undirected", "flat", *(r6(c).alias(c) for c in rounded))


@query(
    "auc",
    f"""WITH {FORECAST}, own AS (SELECT * FROM forecast WHERE mu <> 0 AND r <> 0), ranked AS (
            SELECT r, (rank() OVER (ORDER BY mu) + (count(*) OVER (PARTITION BY mu) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER () AS p FROM own)
        SELECT round(0.5 + avg(p) FILTER (r > 0) - avg(p) FILTER (r < 0), 6) AS auc FROM ranked""",
)
def auc(spark: SparkSession, sf: str) -> DataFrame:
    return S.auc(forecast(spark, sf)).select(r6("auc").alias("auc"))


DECILED = f"""{FORECAST}, cuts AS (
    SELECT quantile_cont(abs(mu), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM forecast
), deciled AS (SELECT t, symbol, mu, r, len(list_filter(cuts, lambda c: round(c, 9) < round(abs(mu), 9))) AS decile FROM forecast, cuts)"""


def deciled(spark: SparkSession, sf: str) -> DataFrame:
    own = forecast(spark, sf).withColumn("size", F.abs("mu"))
    cuts = S.cutpoints(own, "size").select(F.transform("cuts", lambda c: F.round(c, 9)).alias("cuts"))
    return S.bucketed(own.withColumn("size", F.round("size", 9)), "size", cuts)


@query("decile_assign", f"WITH {DECILED} SELECT t, symbol, decile::BIGINT AS decile FROM deciled")
def decile_assign(spark: SparkSession, sf: str) -> DataFrame:
    return deciled(spark, sf).select(F.col("t").cast("long").alias("t"), "symbol", F.col("decile").cast("long").alias("decile"))


@query(
    "selective_table",
    f"""WITH {DECILED}, ks AS (SELECT unnest(range(10))::INTEGER AS k), steps AS (
            SELECT k, symbol, t, CASE WHEN decile >= k THEN sign(mu) ELSE 0 END AS pos, r FROM deciled, ks
        ), turns AS (
            SELECT *, abs(pos - coalesce(lag(pos) OVER w, 0)) + CASE WHEN lead(t) OVER w IS NULL THEN abs(pos) ELSE 0 END AS turn
            FROM steps WINDOW w AS (PARTITION BY k, symbol ORDER BY t))
        SELECT k, count(*) FILTER (pos <> 0) AS held, round(sum(turn), 6)::DOUBLE AS turnover, round(sum(pos * r) / count(*) FILTER (pos <> 0) * 10000, 6) AS edge_bps,
               round(sum(pos * r) / sum(turn) * 10000, 6) AS break_even_bps, round(count(*) FILTER (pos * r > 0) / count(*) FILTER (pos <> 0), 6) AS hit_rate
        FROM turns GROUP BY 1""",
)
def selective_table(spark: SparkSession, sf: str) -> DataFrame:
    found = S.selective(deciled(spark, sf), "symbol", "t")
    return found.select("k", "held", *(r6(c).alias(c) for c in ("turnover", "edge_bps", "break_even_bps", "hit_rate")))


DRAWS = 200
#: From numbered (i from 0) to picks: how often each draw takes each block.
PICKS = f"""size AS (SELECT max(i) + 1 AS n FROM numbered_blocks),
        picks AS (SELECT draw, (('0x' || substr(md5('0:' || draw || ':' || pick), 1, 8))::BIGINT % n) AS i, count(*) AS times
                  FROM (SELECT n, unnest(range(n)) AS pick FROM size WHERE n > 1), range({DRAWS}) AS d(draw) GROUP BY 1, 2)"""


@query(
    "bootstrap_interval",
    f"""WITH {FORECAST}, numbered_blocks AS (
            SELECT row_number() OVER (ORDER BY day) - 1 AS i, s, c FROM (SELECT t // 24 AS day, sum(sign(mu) * r) AS s, count(sign(mu) * r) AS c FROM forecast GROUP BY 1)
        ), {PICKS}, drawn AS (SELECT draw, sum(s * times) / sum(c * times) AS m FROM numbered_blocks JOIN picks USING (i) GROUP BY 1)
        SELECT (SELECT n FROM size) AS blocks, round((SELECT sum(s) / sum(c) FROM numbered_blocks), 9) AS mean, round(stddev_samp(m), 9) AS sd,
               round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM drawn""",
)
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Mean return of the signed forecasts with an interval from days resampled with replacement."""
    own = forecast(spark, sf).withColumn("day", F.floor(F.col("t") / 24)).withColumn("pay", F.signum("mu") * F.col("r"))
    found = S.block_bootstrap(own, "day", "pay", DRAWS)
    return found.select("blocks", *(F.round(c, 9).alias(c) for c in ("mean", "sd", "low", "high")))


_EDGES = ("edge_bps", "hit_rate", "round_trip")


@query(
    "decile_edges",
    f"""WITH {DECILED}, cells AS (
            SELECT t // 24 AS day, decile, sum(sign(mu) * r) AS pay, sum(abs(sign(mu))) AS held, sum(CASE WHEN sign(mu) * r > 0 THEN 1 ELSE 0 END) AS hits FROM deciled GROUP BY 1, 2
        ), both_cells AS (
            SELECT * FROM cells UNION ALL SELECT day, NULL, sum(pay), sum(held), sum(hits) FROM cells GROUP BY 1
        ), numbered_blocks AS (SELECT dense_rank() OVER (ORDER BY day) - 1 AS i, * FROM both_cells), {PICKS}, totals AS (
            SELECT draw, decile, sum(pay * times) AS pay, sum(held * times) AS held, sum(hits * times) AS hits FROM numbered_blocks JOIN picks USING (i) GROUP BY 1, 2
            UNION ALL SELECT -1, decile, sum(pay), sum(held), sum(hits) FROM numbered_blocks GROUP BY 2
        ), plain AS (
            SELECT draw, decile, pay / nullif(held, 0) * 10000 AS edge_bps, hits / nullif(held, 0) AS hit_rate, pay / nullif(held, 0) * 10000 / (2 * 5.0::DOUBLE) AS round_trip FROM totals
        ), pooled AS (SELECT * FROM plain WHERE decile IS NULL), each AS (
            SELECT p.draw, p.decile, unnest(['edge_bps', 'hit_rate', 'round_trip', 'edge_bps_over_pooled', 'hit_rate_over_pooled', 'round_trip_over_pooled']) AS stat,
                   unnest([p.edge_bps, p.hit_rate, p.round_trip, p.edge_bps / nullif(q.edge_bps, 0), p.hit_rate / nullif(q.hit_rate, 0), p.round_trip / nullif(q.round_trip, 0)]) AS x
            FROM plain p JOIN pooled q USING (draw)
        ), found AS (
            SELECT decile, stat, max(x) FILTER (draw < 0) AS point, stddev_samp(x) FILTER (draw >= 0) AS se, quantile_cont(x, 0.025) FILTER (draw >= 0) AS low,
                   quantile_cont(x, 0.975) FILTER (draw >= 0) AS high, count(x) FILTER (draw >= 0) AS draws FROM each GROUP BY 1, 2)
        SELECT decile::BIGINT AS decile, stat, round(point, 6) AS point, CASE WHEN ok THEN round(se, 6) END AS se, CASE WHEN ok THEN round(low, 6) END AS low,
               CASE WHEN ok THEN round(high, 6) END AS high, n AS blocks, draws
        FROM (SELECT *, draws * 2 >= {DRAWS} AND n >= 2 AND point IS NOT NULL AS ok FROM found, size)""",
)
def decile_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edge, hit rate and edge over a round trip's cost of each decile of forecasts and of all, with joint intervals."""
    own = deciled(spark, sf).withColumn("day", F.floor(F.col("t") / 24)).withColumn("decile", F.col("decile").cast("long"))
    pay = F.signum("mu") * F.col("r")
    sums = {"pay": pay, "held": F.abs(F.signum("mu")), "hits": (pay > 0).cast("double")}
    edge = F.try_divide(F.col("pay"), F.col("held")) * 10_000
    stats = {"edge_bps": edge, "hit_rate": F.try_divide(F.col("hits"), F.col("held")), "round_trip": edge / (2 * 5.0)}
    found = S.joint_bootstrap(own, "day", "decile", sums, stats, DRAWS)
    return found.select("decile", "stat", *(r6(c).alias(c) for c in ("point", "se", "low", "high")), "blocks", "draws")


SIX = 6 * HOUR


def _six(spark: SparkSession, sf: str) -> DataFrame:
    return N.returns(bars(spark, sf, SIX))


SIX_PANEL = PANEL.replace(bars_sql(), bars_sql(SIX))
_COMMON = f"""{SIX_PANEL}, common AS (
            SELECT * FROM panel WHERE symbol IN (SELECT symbol FROM panel GROUP BY 1 HAVING count(DISTINCT t) = (SELECT count(DISTINCT t) FROM panel)))"""


def _pairwise(source: str, key: str) -> str:
    return f"""moves AS (
            SELECT {key}, t, symbol, (x - avg(x) OVER s) / nullif(stddev_pop(x) OVER s, 0) AS z, stddev_pop(x) OVER s AS sd FROM {source} WINDOW s AS (PARTITION BY {key}, symbol)
        ), per_t AS (SELECT {key}, t, sum(z) AS z, count(*) AS n FROM moves WHERE sd > 0 GROUP BY 1, 2
        ), pairs AS (SELECT {key}, max(n) AS names, CASE WHEN max(n) >= 2 THEN (avg(z * z) - max(n)) / (max(n) * max(n) - max(n)) END AS c FROM per_t GROUP BY 1)"""


@query(
    "horizon_correlation",
    f"""WITH {_COMMON}, instants AS (SELECT ts_ms, ts_ms - (row_number() OVER (ORDER BY ts_ms) - 1) * {SIX} AS run FROM (SELECT DISTINCT ts_ms FROM common)
        ), placed AS (SELECT ts_ms, run, (ts_ms - min(ts_ms) OVER r) // {SIX} AS place, count(*) OVER r AS length FROM instants WINDOW r AS (PARTITION BY run)
        ), ks AS (SELECT unnest([1, 3, 6, 12, 39, 78]) AS horizon
        ), blocked AS (
            SELECT horizon, (run, place // horizon) AS t, symbol, sum(realized_r) AS x FROM common JOIN placed USING (ts_ms), ks WHERE place // horizon < length // horizon GROUP BY 1, 2, 3
        ), counted AS (SELECT horizon, count(DISTINCT t) AS blocks FROM blocked GROUP BY 1), {_pairwise("blocked", "horizon")}
        SELECT horizon, blocks, coalesce(names, 0) AS names, CASE WHEN blocks >= 2 THEN round(c, 5) END AS mean_correlation FROM counted LEFT JOIN pairs USING (horizon)""",
)
def horizon_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """How names move together over 1 to 78 bars of six hours."""
    return Z.horizon_correlation(_six(spark, sf), "realized_r", SIX).withColumn("mean_correlation", F.round("mean_correlation", 5))


@query(
    "monthly_correlation",
    f"""WITH {_COMMON}, monthly AS (SELECT year(make_timestamp(ts_ms * 1000)) * 12 + month(make_timestamp(ts_ms * 1000)) - 1 AS month, t, symbol, realized_r AS x FROM common), {_pairwise("monthly", "month")}
        SELECT month, names, round(c, 5) AS mean_correlation FROM pairs WHERE month IN (SELECT month FROM monthly GROUP BY 1 HAVING count(DISTINCT t) >= 2)""",
)
def monthly_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return Z.monthly_correlation(_six(spark, sf), "realized_r").withColumn("mean_correlation", F.round("mean_correlation", 5))


GRID, PLACES = 0.25, 16


@query(
    "horizon_laws",
    f"""WITH {BARS}, r AS (SELECT symbol, greatest(least(round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms)) / {GRID}), {PLACES}), -{PLACES})::INTEGER AS i FROM bars
        ), one AS MATERIALIZED (SELECT symbol, i, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY symbol) AS p FROM r WHERE i IS NOT NULL GROUP BY 1, 2
        ), two AS MATERIALIZED (SELECT a.symbol, a.i + b.i AS i, sum(a.p * b.p) AS p FROM one a JOIN one b ON a.symbol = b.symbol GROUP BY 1, 2
        ), three AS MATERIALIZED (SELECT a.symbol, a.i + b.i AS i, sum(a.p * b.p) AS p FROM two a JOIN one b ON a.symbol = b.symbol GROUP BY 1, 2
        ), six AS (SELECT a.symbol, a.i + b.i AS i, sum(a.p * b.p) AS p FROM three a JOIN three b ON a.symbol = b.symbol GROUP BY 1, 2)
        SELECT symbol, round(sum(p), 9) AS mass, round(sum(p * i * {GRID}), 6) AS mean, round(sum(p * i * i * {GRID * GRID}), 6) AS second,
               round(sum(CASE WHEN i > 0 THEN p ELSE 0 END), 6) AS rise, round(sum(p * exp(i * {GRID})), 6) AS growth FROM six GROUP BY 1""",
)
def horizon_laws(spark: SparkSession, sf: str) -> DataFrame:
    """The law of the sum of six hourly returns, from each symbol's law of one on a grid."""
    i = F.greatest(F.least(F.round(M.log_return() / GRID), F.lit(PLACES)), F.lit(-PLACES)).cast("int")
    own = bars(spark, sf).select("symbol", i.alias("i")).where("i IS NOT NULL").groupBy("symbol", "i").agg(F.count("*").alias("n"))
    counts = own.groupBy(F.col("symbol").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("n").cast("double")))).alias("n"))
    pmf = F.transform(F.sequence(F.lit(-PLACES), F.lit(PLACES)), lambda k: F.coalesce(F.col("n")[k], F.lit(0.0)))
    laws = Z.horizon_laws(counts.select("key", F.lit(-PLACES * GRID).alias("first"), F.lit(GRID).alias("step"), pmf.alias("pmf")), 6)
    cells = F.transform("pmf", lambda p, k: F.struct(p.alias("p"), (F.col("first") + k * F.col("step")).alias("x")))
    total = lambda f: F.aggregate(cells, F.lit(0.0), lambda a, c: a + c["p"] * f(c["x"]))
    rise = F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.when(c["x"] > 1e-9, c["p"]).otherwise(0.0))
    return laws.select(
        F.col("key").alias("symbol"), F.round(total(lambda x: F.lit(1.0)), 9).alias("mass"), r6(total(lambda x: x) + 0.0).alias("mean"), r6(total(lambda x: x * x)).alias("second"),
        r6(rise).alias("rise"), r6(total(F.exp)).alias("growth"),
    )


@query(
    "pinned_windows",
    f"""WITH {BARS}, capacity AS (SELECT symbol, count(*) AS capacity FROM bars GROUP BY 1
        ), shared AS (SELECT *, (capacity * 100) // sum(capacity) OVER () AS fl, (capacity * 100) % sum(capacity) OVER () AS rest FROM capacity
        ), dealt AS (SELECT symbol, capacity, (fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, symbol) <= 100 - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM shared
        ), turns AS (SELECT *, unnest(range(quota)) AS turn FROM dealt)
        SELECT turn, ('0x' || substr(md5('order:0:' || symbol), 1, 8))::BIGINT AS draw, symbol,
               (((2 * turn + 1) * capacity // (2 * quota)) + ('0x' || substr(md5('phase:0:' || symbol), 1, 8))::BIGINT % capacity) % capacity AS place FROM turns""",
)
def pinned_windows(spark: SparkSession, sf: str) -> DataFrame:
    """100 windows, the same in every run, spread over symbols and their time."""
    return U.pinned(bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("capacity")), 100)


# --- encodings

VOLUMES = recursive_sql(
    "volume AS e, volume AS before, close AS c0", "n.volume * (2 / 21.0::DOUBLE) + (1 - 2 / 21.0::DOUBLE) * p.e AS e, p.e AS before, 0.0::DOUBLE AS c0",
    "n.i, n.open, n.high, n.low, n.close, n.volume, before, lag(n.close) OVER (PARTITION BY n.symbol ORDER BY n.ts_ms) AS prev",
)
DOF = f"""dofs AS (
    SELECT symbol, ts_ms, i, prev, open, high, low, close, ln(close / prev) AS r, ln(high / low) AS s,
           CASE WHEN high > low THEN ln(close / low) / ln(high / low) ELSE 0.5 END AS u,
           CASE WHEN high > low THEN ln(open / low) / ln(high / low) ELSE 0.5 END AS v, ln(volume / before) AS w
    FROM ({VOLUMES}) WHERE prev IS NOT NULL)"""


def dofs(spark: SparkSession, sf: str) -> DataFrame:
    own = M.volume_reference(bars(spark, sf)).withColumn("prev", F.lag("close").over(M.by())).where("prev IS NOT NULL")
    return own.withColumns(P.dof(*(F.col(c) for c in ("prev", "open", "high", "low", "close", "volume", "ema_volume"))))


@query("dof_encode", f"WITH {DOF} SELECT symbol, ts_ms, {', '.join(f'round({c}, 6) AS {c}' for c in 'rsuvw')} FROM dofs")
def dof_encode(spark: SparkSession, sf: str) -> DataFrame:
    return shown(dofs(spark, sf), *"rsuvw")


@query(
    "dof_decode",
    f"""WITH {DOF}, lows AS (SELECT *, prev * exp(r) * exp(-u * s) AS l2 FROM dofs)
        SELECT symbol, ts_ms, round(l2 * exp(v * s), 4) AS open, round(l2 * exp(s), 4) AS high, round(l2, 4) AS low, round(prev * exp(r), 4) AS close FROM lows""",
)
def dof_decode(spark: SparkSession, sf: str) -> DataFrame:
    found = dofs(spark, sf).withColumns(P.undof(*(F.col(c) for c in ("prev", "r", "s", "u", "v"))))
    return found.select("symbol", "ts_ms", *(F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")))


@query(
    "time_ids",
    f"""WITH {BARS}, local AS (
            SELECT symbol, ts_ms, (make_timestamp(ts_ms * 1000) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et,
                   ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS gap FROM bars
        ), minutes AS (SELECT *, hour(et) * 60 + minute(et) AS m, gap // {HOUR} AS n FROM local)
        SELECT symbol, ts_ms, m::INTEGER AS et_minute, (isodow(et) - 1)::INTEGER AS et_weekday,
               CASE WHEN m < 240 THEN 0 WHEN m < 570 THEN 1 WHEN m < 960 THEN 2 WHEN m < 1200 THEN 3 ELSE 4 END AS et_session,
               (CASE WHEN gap IS NULL THEN 0 WHEN n < 1 THEN 1 ELSE least(length(bin(n)), 12) END)::INTEGER AS elapsed
        FROM minutes""",
)
def time_ids(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf)
    gap = F.col("ts_ms") - F.lag("ts_ms").over(M.by())
    ids = P.time_ids(F.col("ts_ms"))
    return own.withColumns(ids | {"elapsed": P.elapsed_bucket(gap, HOUR)}).select("symbol", "ts_ms", "et_minute", "et_weekday", "et_session", "elapsed")


RETURNS = f"""{BARS}, simple AS (SELECT (close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms) - 1) * 100 AS x FROM bars),
    ends AS (SELECT min(x) AS a, max(x) AS b FROM simple)"""


@query(
    "returns_hist",
    f"""WITH {RETURNS} SELECT least(floor((x - a) / (b - a) * 50), 49)::INTEGER AS bin, count(*) AS n FROM simple, ends WHERE x IS NOT NULL GROUP BY 1""",
)
def returns_hist(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.col("close") / F.lag("close").over(M.by()) - 1) * 100
    return B.histogram(bars(spark, sf).select(x.alias("x")).where("x IS NOT NULL"), "x", 50)


EDGES = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0)


@query(
    "bin_masses",
    f"""WITH {DOF}, binned AS (
            SELECT s, CASE WHEN s = 0 THEN 0 ELSE least(greatest(len(list_filter([{", ".join(f"{e}::DOUBLE" for e in EDGES)}], lambda e: e <= s)), 0), {len(EDGES)}) + 1 END AS bin FROM dofs)
        SELECT bin::INTEGER AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS mass, round(avg(s), 6) AS mean, round(greatest(avg(s * s), avg(s) * avg(s)), 6) AS second
        FROM binned GROUP BY 1""",
)
def bin_masses(spark: SparkSession, sf: str) -> DataFrame:
    found = B.moments(B.binned(dofs(spark, sf), "s", (0.0,), EDGES), "s")
    return found.select("bin", "n", *(r6(c).alias(c) for c in ("mass", "mean", "second")))


@query(
    "tail_slopes",
    f"""WITH {RETURNS}, tops AS (
            SELECT abs(x) AS x, row_number() OVER (ORDER BY abs(x) DESC) AS k FROM simple WHERE x IS NOT NULL AND x <> 0
        ), picked AS (SELECT * FROM tops WHERE k IN (10, 30, 100, 300))
        SELECT a.k::INTEGER AS k1, b.k::INTEGER AS k2, round((ln(b.k) - ln(a.k)) / (ln(b.x) - ln(a.x)), 6) AS slope FROM picked a JOIN picked b ON a.k < b.k""",
)
def tail_slopes(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.col("close") / F.lag("close").over(M.by()) - 1) * 100
    found = B.tail_slopes(bars(spark, sf).select(F.abs(x).alias("x")).where("x > 0"), "x", (10, 30, 100, 300))
    return found.withColumn("slope", r6("slope"))


@query(
    "pit_histogram",
    f"""WITH {DOF}, h AS (SELECT least(floor(u * 10), 9)::INTEGER AS bin, count(*) AS n FROM dofs GROUP BY 1)
        SELECT bin, n, round(n * 10 / sum(n) OVER (), 6) AS density, round(sum(abs(n / (SELECT sum(n) FROM h) - 0.1)) OVER () / 2, 6) AS variation FROM h""",
)
def pit_histogram(spark: SparkSession, sf: str) -> DataFrame:
    found = B.pit(dofs(spark, sf), "u", 10)
    return found.select("bin", "n", r6("density").alias("density"), r6("variation").alias("variation"))


# --- reports

LINES = f"""{NUMBERED}, tidy AS (SELECT 'closes' AS report, symbol AS series, i AS idx, close AS value FROM numbered)"""


def tidy(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf)
    return own.select(F.lit("closes").alias("report"), F.col("symbol").alias("series"), M.index().cast("long").alias("idx"), F.col("close").alias("value"))


@query(
    "report_lines",
    f"""WITH {LINES} SELECT idx, idx::VARCHAR || chr(9) || string_agg(series || '=' || printf('%.3f', value), ',' ORDER BY series) AS line FROM tidy GROUP BY idx""",
)
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return R.to_lines(tidy(spark, sf))


@query(
    "topk_min_max",
    f"""WITH {LINES}, rows_ AS (SELECT idx, min(value) AS low, max(value) AS high FROM tidy GROUP BY 1)
        (SELECT 'max' AS side, idx, high AS value FROM rows_ ORDER BY high DESC, idx LIMIT 5)
        UNION ALL (SELECT 'min', idx, low FROM rows_ ORDER BY low, idx LIMIT 5)""",
)
def topk_min_max(spark: SparkSession, sf: str) -> DataFrame:
    return R.extremes(tidy(spark, sf), 5)


@query(
    "line_values",
    f"""WITH {LINES}, texts AS (SELECT idx, string_agg(series || '=' || printf('%.3f', value), ',' ORDER BY series) AS body FROM tidy GROUP BY idx)
        SELECT idx, split_part(p, '=', 1) AS label, split_part(p, '=', 2)::DOUBLE AS value FROM (SELECT idx, unnest(string_split(body, ',')) AS p FROM texts)""",
)
def line_values(spark: SparkSession, sf: str) -> DataFrame:
    return R.from_lines(R.to_lines(tidy(spark, sf)))
