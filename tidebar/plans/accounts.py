"""Accounts, ledgers, rewards by name, samples and small vocabularies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions import calendar as K
from tidebar.operators import accounts as A
from tidebar.operators import evaluate as V
from tidebar.operators import factors as X
from tidebar.operators import momentum as M
from tidebar.operators import quality as Q
from tidebar.operators import universe as U
from tidebar.plans import query
from tidebar.plans.indicators import NUMBERED, r6
from tidebar.plans.markets import DOF, PANEL, SCORED, dofs, panel, weighed
from tidebar.plans.pointintime import CENSUS, MACRO, prior_year, user_days
from tidebar.sources.views import DAY, bars, bars_sql, table

USER_DAYS = bars_sql(DAY, "user_id", name="days")


@query(
    "worst_anomalies",
    f"""WITH {CENSUS} SELECT symbol, bars, holes + splices + ticks + jumps + extreme_range AS anomalies,
        round((holes + splices + ticks + jumps + extreme_range) * 10000.0::DOUBLE / bars, 6) AS per_10k FROM census
        ORDER BY (holes + splices + ticks + jumps + extreme_range) * 10000.0::DOUBLE / bars DESC, symbol LIMIT 10""",
)
def worst_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    found = A.worst(Q.rates(Q.census(user_days(spark, sf), hole_days=5)), 10)
    return found.select("symbol", "bars", "anomalies", r6("per_10k").alias("per_10k"))


@query("event_sample", "SELECT event_id, event_type FROM events ORDER BY sha256('7:' || event_id), event_id LIMIT 100")
def event_sample(spark: SparkSession, sf: str) -> DataFrame:
    return A.sample(table(spark, sf, "events"), "event_id", 100, 7).select("event_id", "event_type")


@query(
    "resolutions",
    """WITH specs AS (SELECT p_partkey, (p_size % 7) AS n, ['m', 'S', ' hr', 'days', '', 'weeks'][(p_partkey % 6 + 1)::INTEGER] AS unit FROM part
        ), secs AS (SELECT p_partkey, n || unit AS spec, nullif(n * CASE unit WHEN 'm' THEN 60 WHEN '' THEN 60 WHEN 'S' THEN 1 WHEN 'days' THEN 86400 END, 0) AS secs FROM specs)
        SELECT p_partkey, spec, secs::BIGINT AS secs,
               coalesce(list_position([60, 300, 900, 1800, 3600, 14400, 86400], secs) - 1, 7)::BIGINT AS class FROM secs""",
)
def resolutions(spark: SparkSession, sf: str) -> DataFrame:
    units = F.array(*map(F.lit, ("m", "S", " hr", "days", "", "weeks")))
    unit = F.element_at(units, (F.col("p_partkey") % 6 + 1).cast("int"))
    specs = table(spark, sf, "part").select("p_partkey", F.concat((F.col("p_size") % 7).cast("string"), unit).alias("spec"))
    secs = specs.withColumn("secs", A.resolution_secs(F.col("spec")))
    return secs.withColumn("class", A.resolution_class(F.col("secs")))


@query(
    "broker_symbols",
    """SELECT DISTINCT replace(p_brand || '.' || p_size, '.', ' ') AS symbol FROM part WHERE ['CS', 'ETF', 'FUND', 'ADRC'][(p_size % 4 + 1)::INTEGER] <> 'FUND'""",
)
def broker_symbols(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("CS", "ETF", "FUND", "ADRC")))
    own = table(spark, sf, "part").withColumn("type", F.element_at(kinds, (F.col("p_size") % 4 + 1).cast("int")))
    kept = own.where(F.col("type").isin(*A.KEPT_TYPES))
    return kept.select(A.broker_symbol(F.concat_ws(".", "p_brand", "p_size")).alias("symbol")).distinct()


#: The centre and the width by which each series is scaled, held to -1..1.
SCALES = {
    "growth": (0.0, 10.0), "unemployment": (5.0, 5.0), "jobs": (0.0, 2.0), "funds": (3.0, 3.0), "ten_year": (3.0, 3.0), "spread": (0.0, 2.0),
    "sentiment": (90.0, 30.0), "claims": (250.0, 200.0),
}


def _held(value: str, centre: float, width: float) -> str:
    return f"round(coalesce(least(greatest(({value} - {centre}) / {width}, -1), 1), 0), 6)"


@query(
    "macro_features",
    f"""WITH {MACRO}, pairs AS (
            SELECT n.period, n.value, CASE WHEN b.available <= n.available THEN b.value END AS p
            FROM macro n LEFT JOIN macro b ON b.period = n.period - INTERVAL 12 MONTH)
        SELECT period, round(coalesce(least(greatest((value / 1000 - 140) / 20, -1), 1), 0), 6) AS level,
               round(coalesce(least(greatest((CASE WHEN abs(p) > 0.001 THEN (value / p - 1) * 100 END - 2) / 5, -1), 1), 0), 6) AS yearly,
               {", ".join(f"{_held(f'({c} + (value / mean - 1) * {4 * w})', c, w)} AS {n}" for n, (c, w) in SCALES.items())} FROM pairs, (SELECT avg(value) AS mean FROM macro)""",
)
def macro_features(spark: SparkSession, sf: str) -> DataFrame:
    """Each month's scaled series, which move around their centres as the month does around all; what is missing is 0."""
    own = prior_year(spark, sf)
    own = own.join(F.broadcast(own.agg(F.avg("value").alias("mean"))))  # one row
    level = A.macro_scaled(F.col("value") / 1000, 140.0, 20.0)
    series = {n: A.macro_scaled(c + (F.col("value") / F.col("mean") - 1) * (4 * w), c, w) for n, (c, w) in SCALES.items()}
    return own.select(
        "period", r6(level).alias("level"), r6(A.yearly_change(F.col("value"), F.col("prior_value"))).alias("yearly"), *(r6(x + 0.0).alias(n) for n, x in series.items())
    )


def _yearly_sql(months: tuple[int, ...], of_month: int) -> str:
    dates = ", ".join(f"make_date(year(day) + {k}, {m}, {of_month})" for k in (0, 1) for m in months)
    return f"(list_min(list_filter([{dates}], lambda d: d > day)) - day)::INTEGER"


@query(
    "days_to_events",
    f"""WITH days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), f AS (
            SELECT *, date_trunc('month', day)::DATE AS m, (date_trunc('month', day) + INTERVAL 1 MONTH)::DATE AS m2 FROM days
        ), g AS (SELECT *, m + ((5 - isodow(m) + 7) % 7)::INTEGER AS friday, m2 + ((5 - isodow(m2) + 7) % 7)::INTEGER AS friday2 FROM f)
        SELECT day, (CASE WHEN friday >= day THEN friday ELSE friday2 END - day)::INTEGER AS to_jobs,
               (CASE WHEN m + 12 >= day THEN m + 12 ELSE m2 + 12 END - day)::INTEGER AS to_prices,
               {_yearly_sql(K.RATE_MONTHS, K.RATE_DAY)} AS to_rates, {_yearly_sql(K.PRODUCT_MONTHS, K.PRODUCT_DAY)} AS to_product FROM g""",
)
def days_to_events(spark: SparkSession, sf: str) -> DataFrame:
    """Days to jobs and prices reports (0 on their day), and to rate decisions and product reports (strictly after)."""
    days, day = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), F.col("day")
    yearly = {"to_rates": (K.RATE_MONTHS, K.RATE_DAY), "to_product": (K.PRODUCT_MONTHS, K.PRODUCT_DAY)}
    return days.select(
        "day", F.datediff(K.first_friday(day), "day").alias("to_jobs"), F.datediff(K.next_day_of_month(day, 13), "day").alias("to_prices"),
        *(F.datediff(K.next_yearly(day, *of), "day").alias(n) for n, of in yearly.items()),
    )


@query(
    "reward_by_name",
    f"""WITH {PANEL}, book AS (SELECT t, symbol, (exp(realized_r) - 1) / count(*) OVER (PARTITION BY t) AS c FROM panel
        ), s AS (SELECT *, sum(c) OVER (PARTITION BY t) AS total FROM book
        ), o AS (SELECT *, ln(1 + total) * 20 AS step_reward, CASE WHEN abs(total) >= 1e-8 THEN ln(1 + total) * 20 * c / total ELSE 0 END AS own FROM s)
        SELECT t, symbol, round(step_reward, 5) AS step_reward, round(own + step_reward - avg(own) OVER (PARTITION BY t), 5) AS reward FROM o""",
)
def reward_by_name(spark: SparkSession, sf: str) -> DataFrame:
    own = F.expm1("realized_r") / F.count("*").over(W.partitionBy("t"))
    found = A.attributed(panel(spark, sf).select("t", "symbol", own.alias("contribution")))
    return found.select(F.col("t").cast("long").alias("t"), "symbol", F.round("step_reward", 5).alias("step_reward"), F.round("reward", 5).alias("reward"))


BAND = 0.02


def banded_sql(band: float) -> str:
    """legs (t, symbol, trade, held, realized_r, adv, sigma, in_slice, banded) of the signed book, and which are priced."""
    return f"""{SCORED}, named AS (
            SELECT t, symbol, signed AS target, realized_r, close * 500 AS adv, CASE WHEN close > 20 THEN abs(realized_r) END AS sigma,
                   lag(t) OVER o AS before, lead(t) OVER o AS later, row_number() OVER o AS n
            FROM weighed WINDOW o AS (PARTITION BY symbol ORDER BY t)
        ), walk AS (
            SELECT t, symbol, n, target, realized_r, adv, sigma, later, 0.0::DOUBLE AS base, CASE WHEN abs(target) <= {band} THEN 0 ELSE target END AS held FROM named WHERE n = 1
            UNION ALL
            SELECT t, symbol, n, target, realized_r, adv, sigma, later, base, CASE WHEN abs(target - base) <= {band} THEN base ELSE target END FROM (
                SELECT c.*, CASE WHEN c.before = c.t - 1 THEN p.held ELSE 0 END AS base FROM walk p JOIN named c ON c.symbol = p.symbol AND c.n = p.n + 1)
        ), legs AS (
            SELECT t, symbol, CASE WHEN abs(target - base) <= {band} THEN 0 ELSE abs(target - base) END AS trade, held, realized_r, adv, sigma, true AS in_slice,
                   abs(target - base) <= {band} AND target <> base AS banded FROM walk
            UNION ALL SELECT t + 1, symbol, abs(held), 0, NULL, adv, sigma, false, false FROM walk WHERE (later IS NULL OR later > t + 1) AND t < (SELECT max(t) FROM walk)
        ), priced AS (
            SELECT *, trade > 0 AND coalesce(adv > 0 AND NOT isnan(adv) AND adv < 'Infinity'::DOUBLE AND sigma > 0 AND NOT isnan(sigma) AND sigma < 'Infinity'::DOUBLE, false) AS priced FROM legs)"""


def legs_panel(spark: SparkSession, sf: str) -> DataFrame:
    return weighed(spark, sf).withColumns({"adv": F.col("close") * 500, "sigma": F.when(F.col("close") > 20, F.abs("realized_r"))})


@query(
    "book_ledger",
    f"""WITH RECURSIVE {banded_sql(BAND)}
        SELECT t, count(*) FILTER (in_slice) AS names, count(*) FILTER (trade > 0) AS legs, count(*) FILTER (banded) AS banded, count(*) FILTER (trade > 0 AND NOT in_slice) AS liquidated,
               count(*) FILTER (trade > 0 AND NOT priced) AS unpriced, round(sum(trade), 6) AS turnover, round(sum(abs(held)), 6) AS exposure,
               round(coalesce(sum(held * (exp(realized_r) - 1)), 0), 6) AS gross, round(sum(trade) * 3 / 10000, 6) AS fixed,
               round(coalesce(sum(CASE WHEN priced THEN trade * 0.5::DOUBLE * sigma * sqrt(trade * 1000 / adv) END), 0), 6) AS impact
        FROM priced GROUP BY 1""",
)
def book_ledger(spark: SparkSession, sf: str) -> DataFrame:
    found = A.ledger(legs_panel(spark, sf), "signed", 1000.0, 3.0, 0.5, BAND)
    return found.select("t", "names", "legs", "banded", "liquidated", "unpriced", *(r6(F.col(c) + 0.0).alias(c) for c in ("turnover", "exposure", "gross", "fixed", "impact")))


@query(
    "book_participation",
    f"""WITH RECURSIVE {banded_sql(BAND)}, p AS (SELECT trade / adv AS p FROM priced WHERE priced)
        SELECT (SELECT count(*) FROM p) AS priced, (SELECT count(*) FROM priced WHERE trade > 0 AND NOT priced) AS unpriced,
               (SELECT round(avg(p), 9) FROM p) AS mean, (SELECT round(list_sort(list(p))[floor((count(*) - 1) * 0.99 + 0.5)::INTEGER + 1], 9) FROM p) AS p99""",
)
def book_participation(spark: SparkSession, sf: str) -> DataFrame:
    found = A.participation(legs_panel(spark, sf), "signed", BAND)
    return found.select("priced", "unpriced", F.round("mean", 9).alias("mean"), F.round("p99", 9).alias("p99"))


@query(
    "last_changes",
    f"""WITH {NUMBERED}, k AS (SELECT symbol, ts_ms, d, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) AS k FROM numbered)
        SELECT symbol, count(*) AS changes, round(sum(d), 6) AS total, round(arg_min(d, ts_ms), 6) AS oldest FROM k WHERE k <= 50 AND d IS NOT NULL GROUP BY 1""",
)
def last_changes(spark: SparkSession, sf: str) -> DataFrame:
    found = A.last_changes(bars(spark, sf), 50)
    total = F.aggregate("changes", F.lit(0.0), lambda a, x: a + x)
    return found.select("symbol", F.size("changes").cast("long").alias("changes"), r6(total).alias("total"), r6(F.get("changes", F.lit(0))).alias("oldest"))


@query(
    "banded_backtest",
    f"""WITH RECURSIVE {banded_sql(0.05)}, steps AS (
            SELECT t, coalesce(sum(held * (exp(realized_r) - 1)), 0) AS gross_r, sum(trade) AS turnover FROM priced GROUP BY 1
        ), net AS (SELECT *, gross_r - turnover * 5 / 10000 AS net_r FROM steps)
        SELECT t, round(gross_r, 6) AS gross_r, round(turnover, 6) AS turnover, round(net_r, 6) AS net_r, round(sum(ln(greatest(1 + net_r, 1e-12))) OVER (ORDER BY t), 5) AS log_wealth FROM net""",
)
def banded_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """The signed book with a band of 5 % of no trade, at 5 basis points."""
    found = V.banded_backtest(weighed(spark, sf), "signed", 5.0, 0.05)
    return found.select("t", *(r6(F.col(c) + 0.0).alias(c) for c in ("gross_r", "turnover", "net_r")), F.round("log_wealth", 5).alias("log_wealth"))


_METRICS = (
    "span_years", "instants_per_year", "final_log_wealth", "final_wealth", "log_growth_per_year", "gross_log_growth_per_year", "sharpe", "vol", "max_drawdown",
    "mean_gross", "max_gross", "mean_net", "max_abs_net", "turnover_per_day", "mean_breadth", "cost_bps_per_instant", "rotation_per_instant", "payoff_bps_per_instant",
    "payoff_sd_bps_per_instant", "payoff_ratio_per_instant", "bar_win_rate", "mean_hold_bars", "trade_win_rate", "sign_agreement", "realized_cost_bps", "mean_participation",
    "max_participation",
)


@query(
    "book_metrics",
    f"""WITH RECURSIVE {banded_sql(BAND)}, steps AS (
            SELECT t, coalesce(sum(held * (exp(realized_r) - 1)), 0) AS payoff, sum(abs(held)) AS gross, sum(held) AS net, sum(trade) AS turnover, count(*) FILTER (in_slice) AS names,
                   sum(trade * 3 / 10000 + coalesce(CASE WHEN priced THEN trade * 0.5::DOUBLE * sigma * sqrt(trade * 1000 / adv) END, 0)) AS cost FROM priced GROUP BY 1
        ), grown AS (SELECT *, payoff - cost AS r, sum(ln(greatest(1 + payoff - cost, 1e-12))) OVER (ORDER BY t) AS lw FROM steps
        ), fallen AS (SELECT *, 1 - exp(lw - greatest(max(lw) OVER (ORDER BY t), 0)) AS fall FROM grown
        ), whole_span AS (SELECT (max(ts_ms) - min(ts_ms)) / (365.25 * 86400000) AS years, count(DISTINCT ts_ms // 86400000) AS days FROM weighed
        ), held_rows AS (SELECT *, sign(held) AS sg FROM priced WHERE in_slice
        ), marked AS (SELECT *, CASE WHEN lag(sg) OVER o = sg AND lag(t) OVER o = t - 1 THEN 0 ELSE 1 END AS fresh FROM held_rows WINDOW o AS (PARTITION BY symbol ORDER BY t)
        ), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY t) AS id FROM marked
        ), trades AS (SELECT symbol, id, count(*) AS bars, sum(held * (exp(realized_r) - 1)) AS pay FROM runs WHERE sg <> 0 GROUP BY 1, 2
        ), sums AS (
            SELECT count(*) AS instants, sum(ln(greatest(1 + r, 1e-12))) AS final_log_wealth, sum(ln(greatest(1 + payoff, 1e-12))) AS free, avg(r) AS mean_r, stddev_samp(r) AS sd,
                   max(fall) AS max_drawdown, avg(gross) AS mean_gross, max(gross) AS max_gross, avg(net) AS mean_net, max(abs(net)) AS max_abs_net, sum(turnover) AS turnover,
                   sum(cost) AS cost, avg(names) AS mean_breadth, avg(payoff) AS pay, stddev_samp(payoff) AS pay_sd, avg((r > 0)::INT) AS bar_win_rate FROM fallen
        ), of_legs AS (
            SELECT avg(CASE WHEN priced THEN trade * 1000 / adv END) AS mean_participation, max(CASE WHEN priced THEN trade * 1000 / adv END) AS max_participation,
                   count(*) FILTER (trade > 0 AND NOT priced) AS unpriced_legs, avg(CASE WHEN held <> 0 AND realized_r <> 0 THEN (sign(held) = sign(realized_r))::INT END) AS sign_agreement FROM priced
        ), of_trades AS (SELECT count(*) AS trades, avg(bars) AS mean_hold_bars, avg((pay > 0)::INT) AS trade_win_rate FROM trades
        ), every AS (
            SELECT *, years AS span_years, instants / years AS instants_per_year, exp(final_log_wealth) AS final_wealth, final_log_wealth / years AS log_growth_per_year,
                   free / years AS gross_log_growth_per_year, mean_r / sd * sqrt(instants / years) AS sharpe, sd * sqrt(instants / years) AS vol, turnover / greatest(days, 1) AS turnover_per_day,
                   cost / instants * 10000 AS cost_bps_per_instant, turnover / instants / mean_gross AS rotation_per_instant, pay * 10000 AS payoff_bps_per_instant,
                   pay_sd * 10000 AS payoff_sd_bps_per_instant, pay / pay_sd AS payoff_ratio_per_instant, cost * 10000 / turnover AS realized_cost_bps FROM sums, whole_span, of_legs, of_trades)
        SELECT instants, days AS trading_days, trades, unpriced_legs, {", ".join(f"round({c}, 5) AS {c}" for c in _METRICS)} FROM every""",
)
def book_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Growth, risk, exposure, costs and trades of the signed book with its band."""
    found = A.book_metrics(legs_panel(spark, sf), "signed", 1000.0, 3.0, 0.5, BAND)
    return found.select("instants", "trading_days", "trades", "unpriced_legs", *(F.round(c, 5).alias(c) for c in _METRICS))


@query(
    "seam_census",
    f"""WITH {DOF}, days AS (SELECT symbol, ts_ms, ts_ms // {DAY} AS day, r, s, w FROM dofs),
             x AS (SELECT *, lag(r) OVER o AS before, lead(r) OVER o AS later, lag(day) OVER o AS day0 FROM days WINDOW o AS (PARTITION BY symbol ORDER BY ts_ms)),
             m AS (SELECT symbol, ts_ms, r, coalesce(day0 <> day, false) AS session_open, s < 0.5 * abs(r) AND abs(w) < ln(2) AS quiet,
                          NOT coalesce(abs(before) > ln(1.5), false) AND NOT coalesce(abs(later) > ln(1.5), false) AS isolated, coalesce(abs(r + later) < 0.5 * abs(r), false) AS reverts
                   FROM x WHERE abs(r) > ln(1.5)),
             q AS (SELECT p.p, q.q FROM (SELECT unnest(range(1, 51)) AS p) p, (SELECT unnest(range(1, 11)) AS q) q WHERE gcd(p.p, q.q) = 1 AND p.p <> q.q),
             o AS (SELECT symbol, ts_ms, min(abs(r - ln(p::DOUBLE / q))) AS off FROM m, q GROUP BY 1, 2)
        SELECT session_open, quiet, isolated, reverts, off <= 0.02 AS simple, count(*) AS events, round(sum(abs(r)), 5) AS moved FROM m JOIN o USING (symbol, ts_ms) GROUP BY 1, 2, 3, 4, 5""",
)
def seam_census(spark: SparkSession, sf: str) -> DataFrame:
    """Moves of more than a half, counted by what they look like."""
    own = dofs(spark, sf).withColumn("day", F.floor(F.col("ts_ms") / DAY))
    found = X.seam_census(own, math.log(1.5), 0.5, math.log(2))
    keys = ("session_open", "quiet", "isolated", "reverts")
    return found.groupBy(*keys, (F.col("off") <= 0.02).alias("simple")).agg(F.count("*").alias("events"), F.round(F.sum(F.abs("r")), 5).alias("moved"))


WINDOW = 64


@query(
    "windowed_reference",
    f"""WITH RECURSIVE {NUMBERED}, spread AS (
            SELECT symbol, i, volume, unnest(range(greatest((i - 1) // {WINDOW}, 0)::BIGINT, ((i + 256) // {WINDOW})::BIGINT + 1)) AS win FROM numbered
        ), begun AS (SELECT *, row_number() OVER (PARTITION BY symbol, win ORDER BY i) AS n FROM spread
        ), walk AS (
            SELECT symbol, win, i, n, NULL::DOUBLE AS before, volume AS e FROM begun WHERE n = 1
            UNION ALL
            SELECT b.symbol, b.win, b.i, b.n, p.e, b.volume * (2 / 21.0::DOUBLE) + (1 - 2 / 21.0::DOUBLE) * p.e FROM walk p JOIN begun b ON b.symbol = p.symbol AND b.win = p.win AND b.n = p.n + 1)
        SELECT symbol, i, win AS "window", round(before, 6) AS ema_volume FROM walk WHERE i >= win * {WINDOW} + 1""",
)
def windowed_reference(spark: SparkSession, sf: str) -> DataFrame:
    """The usual volume before each bar, warmed up on 257 bars before its window of 64."""
    return M.windowed_reference(bars(spark, sf), WINDOW).select("symbol", "i", "window", r6("ema_volume").alias("ema_volume"))


@query(
    "restricted_universe",
    f"""WITH {USER_DAYS}, enough AS (SELECT * FROM days WHERE symbol IN (SELECT symbol FROM days GROUP BY 1 HAVING count(*) >= 10)),
             slots AS (SELECT (ts_ms // {DAY} + 1) * {DAY} AS at_ms, count(*) AS n FROM enough GROUP BY 1),
             running AS (SELECT at_ms, sum(n) OVER (ORDER BY at_ms) AS upto, sum(n) OVER () AS total FROM slots),
             bounds AS (SELECT min(at_ms) FILTER (upto >= floor(total * 0.8::DOUBLE + 0.5)) AS b0, min(at_ms) FILTER (upto >= floor(total * 0.9::DOUBLE + 0.5)) AS b1 FROM running)
        SELECT symbol, CASE WHEN ts_ms < b0 THEN 'train' WHEN ts_ms < b1 THEN 'val' ELSE 'test' END AS split, count(*) AS bars
        FROM enough, bounds WHERE symbol IN (SELECT DISTINCT user_id::VARCHAR FROM events WHERE event_type = 'purchase' AND value > 40) GROUP BY 1, 2""",
)
def restricted_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Users who once bought for more than 40, split where the whole universe is split."""
    few = table(spark, sf, "events").where("event_type = 'purchase' AND value > 40").select(F.col("user_id").cast("string").alias("symbol"))
    return U.restricted(user_days(spark, sf), 10, DAY, few).groupBy("symbol", "split").agg(F.count("*").alias("bars"))


@query(
    "liquidity_order",
    f"""WITH {USER_DAYS}, adv AS (SELECT symbol, CASE WHEN count(*) >= 5 THEN avg(close * volume) ELSE 'NaN'::DOUBLE END AS adv FROM days GROUP BY 1)
        SELECT symbol, CASE WHEN isnan(adv) THEN NULL ELSE round(adv, 6) END AS adv, row_number() OVER (ORDER BY CASE WHEN isnan(adv) THEN '-Infinity'::DOUBLE ELSE round(adv, 9) END, symbol) AS rank FROM adv""",
)
def liquidity_order(spark: SparkSession, sf: str) -> DataFrame:
    """Names by their mean dollars a day; those with too few days have none and come first."""
    own = user_days(spark, sf).groupBy("symbol").agg(F.when(F.count("*") >= 5, F.round(F.avg(F.col("close") * F.col("volume")), 9)).otherwise(float("nan")).alias("adv"))
    return U.by_liquidity(own).select("symbol", F.round(F.when(~F.isnan("adv"), F.col("adv")), 6).alias("adv"), "rank")
