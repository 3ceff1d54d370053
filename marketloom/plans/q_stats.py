"""Queries of statistics and evaluation tables with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import scan
from marketloom.operators import stats as S
from marketloom.plans import views as V

QUERIES, ORACLES = {}, {}
N = 1e-8


def rnd(df, *keep, places=4, nudge=N):
    """Every double column rounded; `keep` first."""
    rest = [f for f in df.schema.fields if f.name not in keep]
    return df.select(*keep, *(F.round(F.col(f.name) + nudge, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in rest))


#: From here on doubles have no four places; results have 13 digits.
LARGE = 1e9


def rnd_large(df, name):
    """run_uid and a rounded column whose values may be large."""
    x = F.col(name)
    return df.select("run_uid", F.when(F.abs(x) < LARGE, F.round(x + N, 4)).otherwise(F.format_string("%.12e", x).cast("double")).alias(name))


def r_large(e: str, name: str) -> str:
    return f"CASE WHEN abs({e}) < {LARGE:.0f} THEN round({e} + {N}, 4) ELSE CAST(printf('%.12e', {e}) AS DOUBLE) END AS {name}"


def r(e: str, name: str, places: int = 4, nudge: float = N) -> str:
    return f"round({e} + {nudge}, {places}) AS {name}"


def rets(s, d):
    """Returns of trades at their exit."""
    b = V.blotter(s, d)
    return b.select("run_uid", F.col("exit_time_ns").alias("event_time_ns"), (F.col("exit_price") / F.col("entry_price") - 1).alias("ret"))


BL = f"WITH {V.sql('v_blotter')}"
DAILY = f"{BL}, db AS (SELECT run_uid, exit_time_ns // 86400000000000 AS day, sum(exit_price / entry_price - 1) AS ret FROM v_blotter GROUP BY 1, 2)"
_sd, _p = "stddev_samp(ret)", "sqrt(252.0)"
_down = "sqrt(sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) / count(*))"
RS = {"cagr": "pow(product(1 + ret), 252.0 / count(*)) - 1", "sharpe": f"avg(ret) / nullif({_sd}, 0) * {_p}", "sortino": f"avg(ret) / nullif({_down}, 0) * {_p}", "volatility": f"{_sd} * {_p}", "risk_return": f"avg(ret) / nullif({_sd}, 0)"}
for _n, _e in RS.items():
    QUERIES[f"stat_{_n}"] = lambda s, d, n=_n: rnd(S.return_stats(rets(s, d)).select("run_uid", n), "run_uid")
    ORACLES[f"stat_{_n}"] = f"{DAILY} SELECT run_uid, {r(_e, _n)} FROM db GROUP BY 1"
# CAGR, drawdown and what builds on them: days summed exactly and multiplied in order, as in the
# operators; a product of doubles in any other order has other last digits, which large results show,
# and a day that loses all must leave exactly nothing, as any rest of it would grow again
XD = f"WITH RECURSIVE {V.sql('v_blotter')}, db AS (SELECT run_uid, exit_time_ns // 86400000000000 AS day, CAST(sum(CAST(exit_price / entry_price - 1 AS DECIMAL(38, 12))) AS DOUBLE) AS ret FROM v_blotter GROUP BY 1, 2), g AS (SELECT run_uid, pow(product(1 + ret ORDER BY day), 252.0 / count(*)) - 1 AS g FROM db GROUP BY 1)"
QUERIES["stat_cagr"] = lambda s, d: rnd_large(S.return_stats(rets(s, d)), "cagr")
ORACLES["stat_cagr"] = f"{XD} SELECT run_uid, {r_large('g', 'cagr')} FROM g"
# x: growth as a share of its peak before that day, so that neither exceeds a double
_DD = """n AS (SELECT *, row_number() OVER (PARTITION BY run_uid ORDER BY day) AS k FROM db WHERE ret IS NOT NULL),
  r AS (SELECT DISTINCT run_uid, 0::BIGINT AS k, 1::DOUBLE AS x FROM db
    UNION ALL SELECT n.run_uid, n.k, least(r.x, 1) * (1 + n.ret) FROM r JOIN n ON n.run_uid = r.run_uid AND n.k = r.k + 1),
  m AS (SELECT run_uid, max(1 - x) AS m FROM r GROUP BY 1)"""
QUERIES["stat_max_drawdown"] = lambda s, d: rnd_large(S.max_drawdown(rets(s, d)), "max_drawdown")
ORACLES["stat_max_drawdown"] = f"{XD}, {_DD} SELECT run_uid, {r_large('(-m)', 'max_drawdown')} FROM m"
QUERIES["stat_calmar"] = lambda s, d: rnd_large(S.calmar(rets(s, d)), "calmar")
ORACLES["stat_calmar"] = f"{XD}, {_DD} SELECT run_uid, {r_large('(g / nullif(m, 0))', 'calmar')} FROM g JOIN m USING (run_uid)"
RA = {"profit_factor": "abs(sum(ret) FILTER (ret > 0) / nullif(sum(ret) FILTER (ret < 0), 0))", "returns_avg": "avg(ret) FILTER (ret <> 0)", "returns_avg_win": "avg(ret) FILTER (ret > 0)", "returns_avg_loss": "avg(ret) FILTER (ret < 0)"}
for _n, _e in RA.items():
    QUERIES[f"stat_{_n}"] = lambda s, d, n=_n: rnd(S.return_averages(rets(s, d)).select("run_uid", n), "run_uid")
    ORACLES[f"stat_{_n}"] = f"{DAILY} SELECT run_uid, {r(_e, _n)} FROM db GROUP BY 1"
_pp = "realized_pnl"
PS = {
    "win_rate": f"count(*) FILTER ({_pp} > 0) / count({_pp})::DOUBLE",
    "expectancy": f"coalesce((coalesce(avg({_pp}) FILTER ({_pp} > 0), 0) * count(*) FILTER ({_pp} > 0) + coalesce(avg({_pp}) FILTER ({_pp} < 0), 0) * count(*) FILTER ({_pp} < 0)) / nullif(count(*) FILTER ({_pp} <> 0), 0), 0)",
    "winner_avg": f"avg({_pp}) FILTER ({_pp} > 0)", "winner_max": f"max({_pp}) FILTER ({_pp} > 0)", "winner_min": f"min({_pp}) FILTER ({_pp} > 0)",
    "loser_avg": f"avg({_pp}) FILTER ({_pp} < 0)", "loser_max": f"min({_pp}) FILTER ({_pp} < 0)", "loser_min": f"max({_pp}) FILTER ({_pp} < 0)",
}
for _n, _e in PS.items():
    QUERIES[f"stat_{_n}"] = lambda s, d, n=_n: rnd(S.pnl_stats(V.blotter(s, d)).select("run_uid", n), "run_uid")
    ORACLES[f"stat_{_n}"] = f"{BL} SELECT run_uid, {r(_e, _n)} FROM v_blotter GROUP BY 1"
QUERIES["stat_long_ratio"] = lambda s, d: S.long_ratio(V.blotter(s, d).withColumn("entry_side", F.when(F.col("trade_id") % 3 == 0, "SELL").otherwise("BUY")))
ORACLES["stat_long_ratio"] = f"{BL} SELECT run_uid, round(avg((trade_id % 3 <> 0)::INT::DOUBLE), 2) AS long_ratio FROM v_blotter GROUP BY 1"
EQ = f"WITH {V.sql('v_equity')}"
QUERIES["portfolio_daily_returns"] = lambda s, d: rnd(S.portfolio_returns(V.equity(s, d)), "run_uid", "day")
ORACLES["portfolio_daily_returns"] = f"""{EQ}, e AS (SELECT run_uid, event_time_ns // 86400000000000 AS day, equity FROM v_equity), b AS (SELECT run_uid, min(day) AS a, max(day) AS z FROM e GROUP BY 1),
  c AS (SELECT run_uid, unnest(range(a, z + 1)) AS day FROM b), f AS (SELECT c.*, last_value(e.equity IGNORE NULLS) OVER (PARTITION BY c.run_uid ORDER BY c.day ROWS UNBOUNDED PRECEDING) AS q FROM c LEFT JOIN e USING (run_uid, day)),
  g AS (SELECT run_uid, day, q / nullif(lag(q) OVER (PARTITION BY run_uid ORDER BY day), 0) - 1 AS ret FROM f) SELECT run_uid, day, {r('ret', 'ret')} FROM g WHERE ret IS NOT NULL"""
_fl = "(arg_max(equity, event_time_ns) - arg_min(equity, event_time_ns))"
QUERIES["total_pnl"] = lambda s, d: rnd(S.total_pnl(V.equity(s, d)).select("run_uid", "total_pnl"), "run_uid", places=2)
ORACLES["total_pnl"] = f"{EQ} SELECT run_uid, {r(_fl, 'total_pnl', 2)} FROM v_equity GROUP BY 1"
QUERIES["total_pnl_pct"] = lambda s, d: rnd(S.total_pnl(V.equity(s, d)).select("run_uid", "total_pnl_pct"), "run_uid")
ORACLES["total_pnl_pct"] = f"{EQ} SELECT run_uid, {r(f'{_fl} / nullif(arg_min(equity, event_time_ns), 0) * 100', 'total_pnl_pct')} FROM v_equity GROUP BY 1"


def run_rows(s, d):
    b = V.blotter(s, d).groupBy("run_uid").agg(F.sum("realized_pnl").alias("net_pnl"))
    f = V.fills(s, d).groupBy("run_uid").agg(F.sum("commission").alias("total_commission"))
    return b.join(f, "run_uid").withColumn("initial_cash", F.lit(S.CASH))


RR = f"WITH {V.sql('v_blotter', 'v_daily', 'v_equity', 'v_fills')}, rr AS (SELECT run_uid, n, c, n + c AS g FROM (SELECT run_uid, sum(realized_pnl) AS n FROM v_blotter GROUP BY 1) JOIN (SELECT run_uid, sum(commission) AS c FROM v_fills GROUP BY 1) USING (run_uid))"
_note = "CASE WHEN g <= 0 THEN 'signal' WHEN n <= 0 THEN 'cost_sensitive' ELSE 'profitable' END"
_lv = (("zero", "0"), ("half", "0.5::DOUBLE"), ("vip", "0.2::DOUBLE"), ("actual", "1"))
QUERIES["ev_fee_scenarios"] = lambda s, d: rnd(S.fee_scenarios(run_rows(s, d)).drop("initial_cash", "net_pnl", "total_commission"), "run_uid", "note", places=2)
ORACLES["ev_fee_scenarios"] = f"{RR} SELECT run_uid, {_note} AS note, {r('g', 'gross', 2)}, {', '.join(r(f'g - c * {k}', f'{n}_net_pnl', 2) + ', ' + r(f'(g - c * {k}) / 100000.0::DOUBLE', f'{n}_total_return', 2) for n, k in _lv)}, {r('CASE WHEN g > 0 AND c > 0 THEN g / c ELSE 0 END', 'break_even_ratio', 2)} FROM rr"
_BEN = "be AS (SELECT run_uid, arg_max(close, event_time_ns) / nullif(arg_min(close, event_time_ns), 0) - 1 AS b FROM v_equity GROUP BY 1)"
QUERIES["ev_fee_impact"] = lambda s, d: rnd(S.fee_impact(run_rows(s, d), S.benchmark(V.equity(s, d))).select("run_uid", "fee_drag_return", *(f"{n}_excess_return" for n, _ in _lv)), "run_uid", places=3)
ORACLES["ev_fee_impact"] = f"{RR}, {_BEN} SELECT run_uid, {r('c / 100000.0::DOUBLE', 'fee_drag_return', 3)}, {', '.join(r(f'(g - c * {k}) / 100000.0::DOUBLE - b', f'{n}_excess_return', 3) for n, k in _lv)} FROM rr LEFT JOIN be USING (run_uid)"
QUERIES["ev_benchmark_return"] = lambda s, d: rnd(S.benchmark(V.equity(s, d)), "run_uid")
ORACLES["ev_benchmark_return"] = f"{EQ}, {_BEN} SELECT run_uid, {r('b', 'benchmark_return')}, CASE WHEN b > 0 THEN 'up' WHEN b < 0 THEN 'down' WHEN b = 0 THEN 'flat' END AS benchmark_direction FROM be"
QUERIES["ev_benchmark_direction"] = lambda s, d: S.benchmark(V.equity(s, d)).select("run_uid", "benchmark_direction")
ORACLES["ev_benchmark_direction"] = f"{EQ}, {_BEN} SELECT run_uid, CASE WHEN b > 0 THEN 'up' WHEN b < 0 THEN 'down' WHEN b = 0 THEN 'flat' END AS benchmark_direction FROM be"


def _annual(s, d):
    b = V.blotter(s, d).groupBy("run_uid").agg((F.sum("realized_pnl") / 1e8).alias("total"), (F.max("exit_time_ns") - F.min("entry_time_ns")).alias("span"))
    return rnd(b.select("run_uid", S.annualized(F.col("total"), F.col("span") / 8.64e13).alias("annualized_return")), "run_uid", places=6)


QUERIES["ev_annualized_return"] = _annual
ORACLES["ev_annualized_return"] = f"{BL}, t AS (SELECT run_uid, sum(realized_pnl) / 1e8 AS t, (max(exit_time_ns) - min(entry_time_ns)) / 8.64e13 AS d FROM v_blotter GROUP BY 1) SELECT run_uid, {r('CASE WHEN d > 0 AND t > -1 THEN pow(1 + t, 365.0::DOUBLE / d) - 1 END', 'annualized_return', 6)} FROM t"
_RET = "er AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY run_uid ORDER BY event_time_ns), 0) - 1 AS ret, max(equity) OVER (PARTITION BY run_uid ORDER BY event_time_ns) AS peak FROM v_equity)"
QUERIES["ev_daily_stats"] = lambda s, d: rnd(S.daily_stats(V.equity(s, d)), "run_uid", places=8)
ORACLES["ev_daily_stats"] = f"{EQ}, {_RET} SELECT run_uid, {r('max(ret)', 'best_day', 8)}, {r('min(ret)', 'worst_day', 8)}, {r('avg(ret)', 'avg_day', 8)}, {r('stddev_pop(ret)', 'std_day', 8)} FROM er GROUP BY 1"
_dn, _a = "sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END))", "sqrt(365.0)"
_es = {"volatility": f"stddev_samp(ret) * {_a}", "sharpe": f"avg(ret) / nullif(stddev_samp(ret), 0) * {_a}", "sortino": f"avg(ret) / nullif({_dn}, 0) * {_a}", "max_drawdown_abs": "max(peak - equity)"}
QUERIES["ev_equity_stats"] = lambda s, d: rnd(S.equity_stats(V.equity(s, d)).drop("downside_volatility"), "run_uid", places=6)
ORACLES["ev_equity_stats"] = f"{EQ}, {_RET} SELECT run_uid, {', '.join(r(e, n, 6) for n, e in _es.items())} FROM er GROUP BY 1"
QUERIES["ev_downside_vol"] = lambda s, d: rnd(S.equity_stats(V.equity(s, d)).select("run_uid", "downside_volatility"), "run_uid", places=6)
ORACLES["ev_downside_vol"] = f"{EQ}, {_RET} SELECT run_uid, {r(f'CASE WHEN count(*) FILTER (ret < 0) >= 2 THEN {_dn} * {_a} END', 'downside_volatility', 6)} FROM er GROUP BY 1"
QUERIES["ev_gross"] = lambda s, d: rnd(S.gross(V.blotter(s, d)), "run_uid", places=2)
_gr = f"{r(f'sum({_pp})', 'gross_pnl', 2)}, {r(f'coalesce(sum({_pp}) FILTER ({_pp} > 0), 0)', 'gross_profit', 2)}, {r(f'coalesce(sum({_pp}) FILTER ({_pp} < 0), 0)', 'gross_loss', 2)}"
ORACLES["ev_gross"] = f"{BL} SELECT run_uid, {_gr} FROM v_blotter GROUP BY 1"
_ISL = f"""sg AS (SELECT run_uid, exit_time_ns, trade_id, realized_pnl, sign({_pp})::INT AS g FROM v_blotter),
  ch AS (SELECT *, coalesce((g <> lag(g) OVER w)::INT, 1) AS c FROM sg WINDOW w AS (PARTITION BY run_uid ORDER BY exit_time_ns, trade_id, realized_pnl)),
  il AS (SELECT *, sum(c) OVER (PARTITION BY run_uid ORDER BY exit_time_ns, trade_id, realized_pnl ROWS UNBOUNDED PRECEDING) AS i FROM ch),
  ln AS (SELECT run_uid, i, g, count(*) AS n FROM il GROUP BY 1, 2, 3), st AS (SELECT run_uid, coalesce(max(n) FILTER (g = 1), 0) AS max_consec_wins, coalesce(max(n) FILTER (g = -1), 0) AS max_consec_losses FROM ln GROUP BY 1)"""
QUERIES["ev_trade_pnl_stats"] = lambda s, d: rnd(S.trade_stats(V.blotter(s, d)), "run_uid")
ORACLES["ev_trade_pnl_stats"] = f"{BL}, {_ISL}, b AS (SELECT run_uid, {r(f'median({_pp})', 'median_pnl')}, {r(f'max({_pp})', 'best_pnl')}, {r(f'min({_pp})', 'worst_pnl')} FROM v_blotter GROUP BY 1) SELECT * FROM b JOIN st USING (run_uid)"
QUERIES["ev_payoff_expectancy"] = lambda s, d: rnd(S.payoff(V.blotter(s, d)), "run_uid")
ORACLES["ev_payoff_expectancy"] = f"{BL}, x AS (SELECT run_uid, {PS['win_rate']} AS w, {PS['winner_avg']} AS a, {PS['loser_avg']} AS l FROM v_blotter GROUP BY 1) SELECT run_uid, {r('a / nullif(abs(l), 0)', 'payoff_ratio')}, {r('w * a + (1 - w) * l', 'expectancy')} FROM x"
_ex = {n: f"avg((position {o} 0)::INT::DOUBLE)" for n, o in (("exposure_pct", "<>"), ("long_pct", ">"), ("short_pct", "<"), ("flat_pct", "="))}
_bias = f"CASE WHEN {_ex['long_pct']} - {_ex['short_pct']} > 1e-9 THEN 'long' WHEN {_ex['long_pct']} - {_ex['short_pct']} < -1e-9 THEN 'short' ELSE 'neutral' END"
QUERIES["ev_exposure"] = lambda s, d: rnd(S.exposure(V.equity(s, d)).drop("bias"), "run_uid")
ORACLES["ev_exposure"] = f"{EQ} SELECT run_uid, {', '.join(r(e, n) for n, e in _ex.items())} FROM v_equity GROUP BY 1"
QUERIES["ev_direction_bias"] = lambda s, d: S.exposure(V.equity(s, d)).select("run_uid", "bias")
ORACLES["ev_direction_bias"] = f"{EQ} SELECT run_uid, {_bias} AS bias FROM v_equity GROUP BY 1"
_h = "(exit_time_ns - entry_time_ns) / 1e9"
QUERIES["ev_holding"] = lambda s, d: rnd(S.holding(V.blotter(s, d)), "run_uid")
ORACLES["ev_holding"] = f"{BL} SELECT run_uid, {r(f'avg({_h}) / 60', 'avg_holding_minutes')}, {r(f'avg({_h}) / 3600', 'avg_holding_bars')}, {r(f'max({_h}) / 60', 'max_holding_minutes')}, {r(f'max({_h}) / 3600', 'max_holding_bars')} FROM v_blotter WHERE exit_time_ns >= entry_time_ns GROUP BY 1"
QUERIES["ev_turnover"] = lambda s, d: rnd(S.turnover(V.blotter(s, d)), "run_uid", places=3)
ORACLES["ev_turnover"] = f"{BL} SELECT run_uid, {r('sum(quantity * entry_price + quantity * exit_price) / 100000.0::DOUBLE', 'turnover', 3)} FROM v_blotter GROUP BY 1"
QUERIES["ev_trade_frequency"] = lambda s, d: rnd(S.trade_frequency(V.blotter(s, d)), "run_uid")
_dy = "(max(exit_time_ns) // 86400000000000 - min(entry_time_ns) // 86400000000000 + 1)"
ORACLES["ev_trade_frequency"] = f"""{BL} SELECT run_uid, count(*) AS trade_count, {_dy} AS trading_days, {r('avg(CASE WHEN exit_time_ns >= entry_time_ns THEN (exit_time_ns - entry_time_ns) / 6e10 END)', 'avg_holding_minutes')},
  {r(f'count(*) / {_dy}::DOUBLE', 'trades_per_day')}, {r(f'count(*) / ({_dy} / 30.4375::DOUBLE)', 'trades_per_month')}, {r(f'count(*) / ({_dy} / 365.25::DOUBLE)', 'trades_per_year')}, {r(f'{_dy} * 1440 / count(*)::DOUBLE', 'avg_minutes_between_trades')} FROM v_blotter GROUP BY 1"""
QUERIES["ev_monthly_trade_counts"] = lambda s, d: S.monthly_counts(V.blotter(s, d))
ORACLES["ev_monthly_trade_counts"] = f"{BL} SELECT run_uid, strftime(make_timestamp(exit_time_ns // 1000), '%Y-%m') AS month, count(*) AS n FROM v_blotter GROUP BY 1, 2"
QUERIES["ev_pnl_curve"] = lambda s, d: rnd(S.pnl_curve(V.equity(s, d)).drop("close", "position"), "run_uid", "event_time_ns", places=2, nudge=3.3e-5)
_fe, _fc = "first_value(equity) OVER w", "first_value(close) OVER w"
ORACLES["ev_pnl_curve"] = f"""{EQ} SELECT run_uid, event_time_ns, {r('equity', 'equity', 2, 3.3e-5)}, {r('coalesce(equity - lag(equity) OVER w, 0)', 'pnl', 2, 3.3e-5)}, {r(f'equity - {_fe}', 'cumulative_pnl', 2, 3.3e-5)}, {r('equity - max(equity) OVER w', 'drawdown', 2, 3.3e-5)},
  {r('(equity - max(equity) OVER w) / nullif(max(equity) OVER w, 0)', 'drawdown_pct', 2, 3.3e-5)}, {r(f'{_fe} * close / {_fc}', 'benchmark_equity', 2, 3.3e-5)}, {r(f'close / {_fc} - 1', 'benchmark_return', 2, 3.3e-5)}, {r(f'equity / {_fe} - 1', 'strategy_return', 2, 3.3e-5)}
  FROM v_equity WINDOW w AS (PARTITION BY run_uid ORDER BY event_time_ns)"""
_tab = ("trade_count", "fill_count", "zero_total_return", "actual_total_return", "win_rate", "max_consec_wins", "turnover", "long_pct", "max_drawdown_abs", "excess_return", "commission_pressure")


def _table(s, d):
    trades = scan.settled(V.blotter(s, d))  # the join is read once for trades and equity
    return rnd(S.table(trades, V.equity(s, d, trades), V.fills(s, d)).select("run_uid", *_tab), "run_uid", places=3)


QUERIES["ev_table"] = _table
ORACLES["ev_table"] = f"""WITH {V.sql('v_blotter', 'v_daily', 'v_equity', 'v_fills')}, {_ISL}, {_BEN}, {_RET}, b AS (SELECT run_uid, count(*) AS n, sum({_pp}) AS g, {PS['win_rate']} AS w, sum(quantity * entry_price + quantity * exit_price) / 100000.0::DOUBLE AS t FROM v_blotter GROUP BY 1),
  f AS (SELECT run_uid, count(*) AS k, sum(commission) AS c FROM v_fills GROUP BY 1), e AS (SELECT run_uid, {_ex['long_pct']} AS lp, max(peak - equity) AS dd FROM er GROUP BY 1)
  SELECT run_uid, n AS trade_count, k AS fill_count, {r('g / 100000.0::DOUBLE', 'zero_total_return', 3)}, {r('(g - c) / 100000.0::DOUBLE', 'actual_total_return', 3)}, {r('w', 'win_rate', 3)}, max_consec_wins, {r('t', 'turnover', 3)}, {r('lp', 'long_pct', 3)},
  {r('dd', 'max_drawdown_abs', 3)}, {r('(g - c) / 100000.0::DOUBLE - b', 'excess_return', 3)}, {r('c / nullif(abs(g), 0)', 'commission_pressure', 3)} FROM b JOIN f USING (run_uid) JOIN e USING (run_uid) JOIN be USING (run_uid) JOIN st USING (run_uid)"""


def _rank_rows(s, d):
    """Runs by brand of part and supplier nation; small groups fail."""
    x = V.table(s, d, "lineitem")
    return x.groupBy((F.col("l_suppkey") % 50).cast("string").alias("run_uid")).agg(
        F.when(F.count("*") % 5 == 0, "failed").otherwise("success").alias("status"), F.round(F.avg(F.col("l_tax") - F.col("l_discount")), 6).alias("excess_return"), F.max("l_discount").alias("max_dd"),
        F.round(F.sum("l_tax") / F.sum("l_discount"), 6).alias("profit_factor"), F.when(F.count("*") % 7 != 0, F.round(F.avg("l_tax"), 6)).alias("commission_pressure"),
    )


QUERIES["ev_rank"] = lambda s, d: S.rank(_rank_rows(s, d)).select("run_uid", "status", F.round(F.col("net_score") + N, 6).alias("net_score"), "rank")


def _norm(c: str, up: bool) -> str:
    lo, hi = f"min({c}) OVER (PARTITION BY status)", f"max({c}) OVER (PARTITION BY status)"
    x = f"({c} - {lo}) / nullif({hi} - {lo}, 0)"
    return f"CASE WHEN {c} IS NULL THEN 0 WHEN {hi} = {lo} THEN 0.5 ELSE {x if up else f'1 - {x}'} END"


ORACLES["ev_rank"] = f"""WITH q AS (SELECT (l_suppkey % 50)::VARCHAR AS run_uid, CASE WHEN count(*) % 5 = 0 THEN 'failed' ELSE 'success' END AS status, round(avg(l_tax - l_discount), 6) AS excess_return, max(l_discount) AS max_dd,
  round(sum(l_tax) / sum(l_discount), 6) AS profit_factor, CASE WHEN count(*) % 7 <> 0 THEN round(avg(l_tax), 6) END AS commission_pressure FROM lineitem GROUP BY 1),
  z AS (SELECT *, CASE WHEN status = 'success' THEN 0.40::DOUBLE * ({_norm('excess_return', True)}) + 0.25::DOUBLE * ({_norm('max_dd', False)}) + 0.20::DOUBLE * ({_norm('profit_factor', True)}) + 0.15::DOUBLE * ({_norm('commission_pressure', False)}) END AS net_score FROM q)
  SELECT run_uid, status, round(net_score + {N}, 6) AS net_score, row_number() OVER (ORDER BY status <> 'success', net_score DESC NULLS LAST, excess_return DESC NULLS LAST, max_dd ASC NULLS LAST, run_uid) AS rank FROM z"""


def _modes(s, d):
    b = V.blotter(s, d)
    base = b.groupBy("run_uid").agg(F.sum("realized_pnl").alias("net_pnl"), F.count("*").cast("double").alias("trades"))
    other = b.where("quantity > 10").groupBy("run_uid").agg(F.sum("realized_pnl").alias("net_pnl"), F.count("*").cast("double").alias("trades"))
    return rnd(S.compare(base, other, ["net_pnl", "trades"]), "run_uid", places=2)


QUERIES["ev_compare_modes"] = _modes
ORACLES["ev_compare_modes"] = f"{BL} SELECT run_uid, {r(f'sum({_pp})', 'net_pnl', 2)}, {r('count(*)::DOUBLE', 'trades', 2)}, {r(f'sum({_pp}) FILTER (quantity > 10) - sum({_pp})', 'net_pnl_delta', 2)}, {r('(count(*) FILTER (quantity > 10) - count(*))::DOUBLE', 'trades_delta', 2)} FROM v_blotter GROUP BY 1"
QUERIES["run_uid"] = lambda s, d: S.run_uid(V.table(s, d, "customer"), ["c_custkey", "c_mktsegment"], ["c_mktsegment"]).select("c_custkey", "run_uid")
ORACLES["run_uid"] = "SELECT c_custkey, regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g') || '_' || substr(sha256('c_custkey=' || c_custkey || '|c_mktsegment=' || c_mktsegment), 1, 6) AS run_uid FROM customer"
