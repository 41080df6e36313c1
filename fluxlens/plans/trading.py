"""Queries over simulated ledgers, and SQL of their own that walks the sessions one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.operators import events, metrics, selection, simulate
from fluxlens.sources import market

#: Pairs of funds: the one that follows the index and the one that goes against it.
PAIRS = {"1x": ("L1", "S1"), "2x": ("L2", "S2")}


def scenarios(costs=(0, 5, 10, 20), exits=(50, 80), policies=simulate.POLICIES, pairs=tuple(PAIRS), max_holding: int = 20) -> list[dict]:
    """A scenario for each combination."""
    return [
        {"scenario_id": f"{pair}-{policy}-{cost}-{exit_}", "pair": pair, "policy": policy, "cost_bps": float(cost), "long_exit": float(exit_), "max_holding": max_holding}
        for pair in pairs for policy in policies for cost in costs for exit_ in exits
    ]


GRID = scenarios()
#: The range of the sliced queries.
START, END = "1995-12-20", "2000-06-30"


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Floating point columns rounded, so that engines agree on them."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both funds' bars of each pair and session, with the day's percentile and extreme entry."""
    daily = market.market_daily(_orders(spark, sf_dir))
    signals = selection.rolling_signals(market.observations(daily)).where("channel = 'main'")
    entries = events.extreme_entries(signals).select("date", F.col("state").alias("entry"))
    prices = market.prices(daily)
    bars = None
    for pair, tickers in PAIRS.items():
        long, other = (prices.where(F.col("ticker") == t).select("date", F.col("open").alias(f"{p}open"), F.col("close").alias(f"{p}close")) for t, p in zip(tickers, ("", "other_")))
        own = long.join(other, "date").withColumn("pair", F.lit(pair))
        bars = own if bars is None else bars.unionByName(own)
    return bars.join(signals.select("date", "percentile"), "date", "left").join(entries, "date", "left")


def ledger_of(spark: SparkSession, sf_dir: str, grid: list[dict] = GRID, **options) -> DataFrame:
    return simulate.run_scenarios(sessions(spark, sf_dir), grid, **options)


def j1_j5_simulated_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ledger_of(spark, sf_dir)).select(
        "scenario_id", "date", "opening_position", "opening_pending", "position", "equity", "buy_hold", "exposure", "action", "reason", "signal_date", "from_price", "to_price", "cost", "sides")


def j2_sliced_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths simulated over all sessions up to the end, then cut at the start and measured from its close."""
    cut = simulate.sliced(ledger_of(spark, sf_dir, end=END), START, END)
    return rounded(cut.select("scenario_id", "date", "position", "equity", "buy_hold", "action", "cost", "sides"))


def j3_closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.trades(ledger_of(spark, sf_dir))).select(
        "scenario_id", "side", "entry_date", "exit_date", "entry_price", "exit_price", "holding_sessions", "entry_reason", "exit_reason", "entry_signal_date", "exit_signal_date", "gross_return", "net_return")


def j7_pending_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending order, position and open trade of each scenario after its last session."""
    return rounded(simulate.standing(ledger_of(spark, sf_dir)))


def j8_exposure_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.exposure_matched(ledger_of(spark, sf_dir)))


def j9_risk_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as logarithms: they may grow beyond what sixteen digits tell apart."""
    found = metrics.risk_matched(ledger_of(spark, sf_dir))
    return rounded(found.select("scenario_id", "date", "scale", F.log("matched").alias("log_matched")), 7)


def f9_ledger_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.holding_segments(ledger_of(spark, sf_dir)).withColumn("segment", F.col("segment").cast("bigint"))


def e6_e7_path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.path_metrics(ledger_of(spark, sf_dir))
    return rounded(found.withColumn("log_risk_matched", F.log1p("risk_matched_return")).drop("risk_matched_return"))


def _grid_table(spark: SparkSession, grid: list[dict]) -> DataFrame:
    return spark.createDataFrame([(g["scenario_id"], f"{g['pair']}-{g['policy']}-{int(g['long_exit'])}", g["cost_bps"]) for g in grid], "scenario_id string, strategy string, cost_bps double")


def e10_cost_break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.break_even(ledger_of(spark, sf_dir), _grid_table(spark, GRID))


COMMON = scenarios(costs=(10,), policies=("long_cash",))


def j11_exit_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both long funds over the sessions that another calendar has too, left at 50 and at 80."""
    other = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("date")).distinct()
    common = sessions(spark, sf_dir).join(other, "date", "left_semi")
    found = metrics.path_metrics(simulate.run_scenarios(common, COMMON))
    return rounded(found.select("scenario_id", "sessions", "total_return", "max_drawdown", "trades", "recovery"))


def j12_common_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of funds on the sessions that all four share."""
    grid = scenarios(costs=(10,), exits=(80,), policies=("long_cash", "long_inverse_cash"))
    days = sessions(spark, sf_dir)
    shared = days.groupBy("date").agg(F.count_distinct("pair").alias("pairs")).where(F.col("pairs") == len(PAIRS))
    ledger = simulate.run_scenarios(days.join(shared, "date", "left_semi"), grid)
    return rounded(metrics.path_metrics(ledger).select("scenario_id", "first_date", "last_date", "total_return", "volatility", "sharpe", "turnover", "inverse_exposure", "cost", "trades", "zero_cost_return", F.log1p("risk_matched_return").alias("log_risk_matched")))


QUERIES = {f.__name__: f for f in (
    j1_j5_simulated_ledgers, j2_sliced_range, j3_closed_trades, j7_pending_orders, j8_exposure_matched, j9_risk_matched, f9_ledger_segments, e6_e7_path_metrics, e10_cost_break_even, j11_exit_thresholds, j12_common_period,
)}


def _values(grid: list[dict]) -> str:
    return ", ".join(f"('{g['scenario_id']}', '{g['pair']}', '{g['policy']}', cast({g['cost_bps']} as double), cast({g['long_exit']} as double), {g['max_holding']})" for g in grid)


def walk_sql(grid: list[dict], where: str = "true") -> str:
    """Named queries up to ``path``: every session of every scenario, by a recursion over session numbers."""
    return f""", pairs as (
  select '1x' as pair, date, open, close, first_value(close) over (order by date) as base from daily union all select '2x', date, open, close, first_value(close) over (order by date) from daily
), bars as (
  select pair, date, 1e2 * case pair when '1x' then open / base else open / base * (open / base) end as o, 1e2 * case pair when '1x' then close / base else close / base * (close / base) end as c,
         1e2 * case pair when '1x' then base / open else base / open * (base / open) end as oo, 1e2 * case pair when '1x' then base / close else base / close * (base / close) end as oc
  from pairs
), days as materialized (
  select b.*, row_number() over (partition by pair order by b.date) as k, s.percentile, e.state as entry
  from bars b left join states s on s.channel = 'main' and s.date = b.date left join entries e on e.channel = 'main' and e.date = b.date where {where}
), grid(scenario_id, pair, policy, bps, long_exit, max_holding) as (values {_values(grid)}
), walk as (
  select g.*, cast(0 as bigint) as k, cast(null as date) as date, 'cash' as opening, cast(null as varchar) as opening_pending, 'cash' as position, cast(0 as bigint) as entered, 1e0 as cash, 0e0 as units,
         cast(null as varchar) as action, cast(null as varchar) as reason, cast(null as date) as signal_date, cast(null as double) as from_price, cast(null as double) as to_price,
         cast(null as double) as left_with, cast(null as double) as entered_with, 0e0 as cost, 0 as sides,
         cast(null as varchar) as kind, cast(null as varchar) as why, cast(null as varchar) as side, cast(null as date) as since,
         0e0 as equity, 0e0 as o, 0e0 as c, 0e0 as oo, 0e0 as oc
  from grid g
  union all
  select scenario_id, pair, policy, bps, long_exit, max_holding, k, date, opening, opening_pending, p2, e2, c2, u2, action, reason, signal_date, from_price, to_price, left_with, entered_with, fee1 + fee2, n1 + n2,
         case when p2 <> 'cash' then case when wanted <> p2 then 'reverse' when left_at or k - e2 + 1 >= max_holding then 'exit' end when wanted is not null then 'enter' end,
         case when p2 <> 'cash' then case when wanted <> p2 then 'opposite_extreme' when left_at then 'recovery' when k - e2 + 1 >= max_holding then 'max_holding' end when wanted is not null then entry || '_entry' end,
         case when p2 = 'cash' or wanted <> p2 then wanted end,
         case when p2 <> 'cash' then case when wanted <> p2 or left_at or k - e2 + 1 >= max_holding then date end when wanted is not null then date end,
         c2 + u2 * case p2 when 'cash' then 0e0 when 'inverse' then oc else c end, o, c, oo, oc
  from (
    select *, coalesce(case when p2 = 'long' then percentile >= long_exit else percentile <= 100 - long_exit end, false) as left_at,
           case entry when 'extreme_fear' then 'long' when 'extreme_greed' then case policy when 'long_short_cash' then 'short' when 'long_inverse_cash' then 'inverse' end end as wanted
    from (
      select *, case when kind in ('enter', 'reverse') then side else p1 end as p2, case when kind in ('enter', 'reverse') then k else entered end as e2, case when kind in ('enter', 'reverse') then 1 else 0 end as n2,
             case when kind in ('enter', 'reverse') then c1 * bps / 1e4 else 0e0 end as fee2, case when kind in ('enter', 'reverse') then to_price end as paid, case when kind in ('enter', 'reverse') then c1 end as entered_with,
             case when kind in ('enter', 'reverse') then (c1 - c1 * bps / 1e4) * case side when 'short' then -1 else 1 end / to_price else u1 end as u2,
             case when kind in ('enter', 'reverse') then (c1 - c1 * bps / 1e4) - (c1 - c1 * bps / 1e4) * case side when 'short' then -1 else 1 end / to_price * to_price else c1 end as c2
      from (
        select w.scenario_id, w.pair, w.policy, w.bps, w.long_exit, w.max_holding, d.k, d.date, d.o, d.c, d.oo, d.oc, d.percentile, d.entry, w.position as opening, w.kind || '_next_open' as opening_pending,
               w.kind, w.side, w.kind as action, w.why as reason, w.since as signal_date, w.entered,
               case when w.kind in ('exit', 'reverse') then case w.position when 'inverse' then d.oo else d.o end end as from_price,
               case when w.kind in ('enter', 'reverse') then case w.side when 'inverse' then d.oo else d.o end end as to_price,
               case when w.kind in ('exit', 'reverse') then abs(w.units) * case w.position when 'inverse' then d.oo else d.o end * w.bps / 1e4 else 0e0 end as fee1,
               case when w.kind in ('exit', 'reverse') then w.cash + w.units * case w.position when 'inverse' then d.oo else d.o end - abs(w.units) * case w.position when 'inverse' then d.oo else d.o end * w.bps / 1e4 else w.cash end as c1,
               case when w.kind in ('exit', 'reverse') then w.cash + w.units * case w.position when 'inverse' then d.oo else d.o end - abs(w.units) * case w.position when 'inverse' then d.oo else d.o end * w.bps / 1e4 end as left_with,
               case when w.kind in ('exit', 'reverse') then 'cash' else w.position end as p1, case when w.kind in ('exit', 'reverse') then 0e0 else w.units end as u1, case when w.kind in ('exit', 'reverse') then 1 else 0 end as n1
        from walk w join days d on d.pair = w.pair and d.k = w.k + 1
      ) opened
    ) entered_
  ) closed
), broken as (select distinct scenario_id from walk where k > 0 and not equity > 0
), path as materialized (
  select w.*, c / first_value(o) over (partition by scenario_id order by k) as buy_hold, case position when 'cash' then 0e0 when 'long' then 1e0 else -1e0 end as exposure
  from walk w where k > 0 and scenario_id not in (select scenario_id from broken)
), refused as (
  select b.scenario_id, min(w.date) as date from broken b join walk w using (scenario_id) group by b.scenario_id
)"""


_CLOSED = """, opened as (
  select scenario_id, k, date, position as side, to_price, entered_with, reason, signal_date from path where action in ('enter', 'reverse')
), closed as (
  select p.scenario_id, o.side, o.date as entry_date, p.date as exit_date, o.to_price as entry_price, p.from_price as exit_price, cast(p.k - o.k as integer) as holding_sessions, o.reason as entry_reason, p.reason as exit_reason,
         o.signal_date as entry_signal_date, p.signal_date as exit_signal_date, case o.side when 'short' then -1 else 1 end * (p.from_price / o.to_price - 1) as gross_return, p.left_with / o.entered_with - 1 as net_return
  from path p asof join opened o on o.scenario_id = p.scenario_id and o.k < p.k where p.action in ('exit', 'reverse')
)"""

_SEGMENTS = """, turned as (
  select *, case when position is distinct from lag(position) over (partition by scenario_id order by k) then 1 else 0 end as turn from path
), segmented as (
  select *, sum(turn) over (partition by scenario_id order by k) as segment from turned
)"""

#: Without costs: each segment's gain at the open that ends it, times that of the segment under way.
_MATCHED = _SEGMENTS + """, bought as (
  select scenario_id, segment, any_value(position) as position, min(k) as k1, max(k) as k2, arg_min(case position when 'inverse' then oo else o end, k) as price from segmented group by scenario_id, segment
), gained as (
  select b.*, n.k1 as next_k, case b.position when 'cash' then 1e0 when 'short' then 2 - p.o / b.price when 'inverse' then p.oo / b.price else p.o / b.price end as gain
  from bought b left join bought n on n.scenario_id = b.scenario_id and n.segment = b.segment + 1 left join path p on p.scenario_id = b.scenario_id and p.k = n.k1
), settled as (
  select scenario_id, segment, coalesce(exp(sum(ln(gain)) over (partition by scenario_id order by segment rows between unbounded preceding and 1 preceding)), 1e0) as settled from gained
), matched as (
  select s.scenario_id, s.date, s.k, s.equity, t.settled * case s.position when 'cash' then 1e0 when 'short' then 2 - s.c / b.price when 'inverse' then s.oc / b.price else s.c / b.price end as matched
  from segmented s join bought b using (scenario_id, segment) join settled t using (scenario_id, segment)
)"""

_RISK = """, stepped as (
  select *, coalesce(equity / lag(equity) over w - 1, 0e0) as own, coalesce(buy_hold / lag(buy_hold) over w - 1, 0e0) as hold from path window w as (partition by scenario_id order by k)
), scaled as (
  select scenario_id, least(1e0, stddev_samp(own) / nullif(stddev_samp(hold), 0)) as scale from stepped group by scenario_id
), risk as (
  select scenario_id, date, k, scale, exp(sum(ln(1 + hold * coalesce(scale, 0))) over (partition by scenario_id order by k)) as matched from stepped join scaled using (scenario_id)
)"""

_METRICS = _CLOSED + _MATCHED + _RISK + """, deep as (
  select scenario_id, min(equity / top - 1) as max_drawdown, min(buy_hold / top_hold - 1) as buy_hold_drawdown
  from (select *, max(equity) over w as top, max(buy_hold) over w as top_hold from path window w as (partition by scenario_id order by k)) x group by scenario_id
), deep_zero as (
  select scenario_id, arg_max(matched, k) - 1 as zero_cost_return, min(matched / top - 1) as zero_cost_drawdown from (select *, max(matched) over (partition by scenario_id order by k) as top from matched) x group by scenario_id
), deep_risk as (
  select scenario_id, arg_max(matched, k) - 1 as risk_matched_return, min(matched / top - 1) as risk_matched_drawdown, max(scale) as risk_matched_scale from (select *, max(matched) over (partition by scenario_id order by k) as top from risk) x group by scenario_id
), closed_by as (
  select scenario_id, count(*) as trades, avg(case when net_return > 0 then 1e0 else 0e0 end) as win_rate, avg(holding_sessions) as mean_holding,
         avg(case when side = 'long' then case when net_return > 0 then 1e0 else 0e0 end end) as long_win_rate, avg(case when side = 'short' then case when net_return > 0 then 1e0 else 0e0 end end) as short_win_rate,
         avg(case when side = 'inverse' then case when net_return > 0 then 1e0 else 0e0 end end) as inverse_win_rate,
         count_if(exit_reason = 'recovery') as recovery, count_if(exit_reason = 'max_holding') as max_holding, count_if(exit_reason = 'opposite_extreme') as opposite_extreme
  from closed group by scenario_id
), totals as (
  select scenario_id, min(date) as first_date, max(date) as last_date, count(*) as sessions, arg_max(equity, k) - 1 as total_return, date_diff('day', min(date), max(date)) / 3652425e-4 as years,
         stddev_samp(own) * sqrt(252) as volatility, avg(own) / nullif(stddev_samp(own), 0) * sqrt(252) as sharpe,
         avg(case when position = 'long' then 1e0 else 0e0 end) as long_exposure, avg(case when position = 'short' then 1e0 else 0e0 end) as short_exposure,
         avg(case when position = 'inverse' then 1e0 else 0e0 end) as inverse_exposure, avg(case when position = 'cash' then 1e0 else 0e0 end) as cash_exposure, avg(abs(exposure)) as gross_exposure, avg(exposure) as net_exposure,
         sum(moved) as moved, sum(sides) as sides, sum(cost) as cost, count_if(action = 'reverse') as reversals, arg_max(buy_hold, k) - 1 as buy_hold_return
  from (select *, abs(exposure - lag(exposure, 1, 0e0) over (partition by scenario_id order by k)) as moved from stepped) x group by scenario_id
), measured as (
  select t.*, case when years > 0 then power(1 + total_return, 1 / years) - 1 end as cagr, case when years > 0 then case when inverse_exposure > 0 then sides else moved end / years end as turnover,
         d.max_drawdown, d.buy_hold_drawdown, z.zero_cost_return, z.zero_cost_drawdown, total_return - zero_cost_return as excess_over_zero_cost, r.risk_matched_return, r.risk_matched_drawdown, r.risk_matched_scale,
         coalesce(c.trades, 0) as trades, coalesce(c.recovery, 0) as recovery, coalesce(c.max_holding, 0) as max_holding, coalesce(c.opposite_extreme, 0) as opposite_extreme,
         c.win_rate, c.long_win_rate, c.short_win_rate, c.inverse_win_rate, c.mean_holding
  from totals t join deep d using (scenario_id) join deep_zero z using (scenario_id) join deep_risk r using (scenario_id) left join closed_by c using (scenario_id)
)"""


def _rounds(*names: str) -> str:
    return ", ".join(f"round({n}, 8) as {n}" for n in names)


_CUT = f""", held as (select * from path where date between date '{START}' and date '{END}'), base as (select scenario_id, min(k) as k0, arg_min(equity, k) as e0, arg_min(buy_hold, k) as h0 from held group by scenario_id having count(*) > 1)"""
_PAIRS = scenarios(costs=(10,), exits=(80,), policies=("long_cash", "long_inverse_cash"))
_SECTION = "first_date, last_date, " + _rounds("total_return", "volatility", "sharpe", "turnover", "inverse_exposure", "cost") + ", trades, round(zero_cost_return, 8) as zero_cost_return, round(ln(1 + risk_matched_return), 8) as log_risk_matched"

SQL = {
    "j1_j5_simulated_ledgers": walk_sql(GRID) + " select scenario_id, date, opening as opening_position, opening_pending, position, " + _rounds("equity", "buy_hold") + ", exposure, action, reason, signal_date, " + _rounds("from_price", "to_price", "cost") + """, cast(sides as integer) as sides from path
        union all select scenario_id, date, null, null, 'unavailable', null, null, null, null, 'equity is not positive', null, null, null, null, null from refused""",
    "j2_sliced_range": walk_sql(GRID, f"b.date <= date '{END}'") + _CUT + """ select h.scenario_id, h.date, h.position, round(h.equity / e0, 8) as equity, round(h.buy_hold / h0, 8) as buy_hold, case when h.k > k0 then h.action end as action,
        round(case when h.k > k0 then h.cost / e0 else 0e0 end, 8) as cost, cast(case when h.k > k0 then h.sides else 0 end as integer) as sides from held h join base using (scenario_id)
        union all select scenario_id, date, 'unavailable', null, null, null, null, null from refused""",
    "j3_closed_trades": walk_sql(GRID) + _CLOSED + " select scenario_id, side, entry_date, exit_date, " + _rounds("entry_price", "exit_price") + ", holding_sessions, entry_reason, exit_reason, entry_signal_date, exit_signal_date, " + _rounds("gross_return", "net_return") + " from closed",
    "j7_pending_orders": walk_sql(GRID) + """, final as (select scenario_id, max(k) as k from path group by scenario_id), started as (select p.scenario_id, max(p.k) as k from path p where p.action in ('enter', 'reverse') group by p.scenario_id)
        select p.scenario_id, p.date, p.position, p.kind || '_next_open' as pending_action, p.why as pending_reason, p.side as pending_side, p.since as pending_signal_date,
        case when p.position <> 'cash' then o.date end as entry_date, round(case when p.position <> 'cash' then p.equity / o.entered_with - 1 end, 8) as unrealized_return
        from path p join final f on f.scenario_id = p.scenario_id and f.k = p.k left join started s on s.scenario_id = p.scenario_id left join path o on o.scenario_id = s.scenario_id and o.k = s.k
        union all select scenario_id, date, 'unavailable', null, null, null, null, null, null from refused""",
    "j8_exposure_matched": walk_sql(GRID) + _MATCHED + " select scenario_id, date, round(matched, 8) as matched from matched union all select scenario_id, date, null from refused",
    "j9_risk_matched": walk_sql(GRID) + _RISK + " select scenario_id, date, round(scale, 7) as scale, round(ln(matched), 7) as log_matched from risk union all select scenario_id, date, null, null from refused",
    "f9_ledger_segments": walk_sql(GRID) + _SEGMENTS + """ select scenario_id, cast(segment as bigint) as segment, any_value(position) as position, min(date) as first_date, max(date) as last_date, count(*) as sessions from segmented group by scenario_id, segment
        union all select scenario_id, 1, 'unavailable', date, date, 1 from refused""",
    "e6_e7_path_metrics": walk_sql(GRID) + _METRICS + " select scenario_id, first_date, last_date, sessions, " + _rounds(
        "total_return", "cagr", "volatility", "sharpe", "max_drawdown", "long_exposure", "short_exposure", "inverse_exposure", "cash_exposure", "gross_exposure", "net_exposure", "turnover", "cost",
        "win_rate", "long_win_rate", "short_win_rate", "inverse_win_rate", "mean_holding", "buy_hold_return", "buy_hold_drawdown", "zero_cost_return", "zero_cost_drawdown", "excess_over_zero_cost",
        "risk_matched_drawdown", "risk_matched_scale") + ", round(ln(1 + risk_matched_return), 8) as log_risk_matched, reversals, trades, recovery, max_holding, opposite_extreme from measured",
    "e10_cost_break_even": walk_sql(GRID) + """, gains as (select scenario_id, pair || '-' || policy || '-' || cast(cast(long_exit as integer) as varchar) as strategy, bps, arg_max(equity, k) - 1 as gain from path group by scenario_id, pair, policy, long_exit, bps),
        pairs_ as (select a.strategy, a.bps, b.bps as nb, a.gain, b.gain as ng from gains a join gains b on a.strategy = b.strategy and b.bps = (select min(c.bps) from gains c where c.strategy = a.strategy and c.bps > a.bps)),
        crossings as (select strategy, min(case when ng = 0 then nb else round(bps + gain / (gain - ng) * (nb - bps), 2) end) as at from pairs_ where ng = 0 or (gain > 0 and ng < 0) group by strategy)
        select g.strategy, case when arg_min(g.gain, g.bps) <= 0 then 0e0 else any_value(c.at) end as break_even_bps from gains g left join crossings c on c.strategy = g.strategy group by g.strategy""",
    "j11_exit_thresholds": walk_sql(COMMON, "b.date in (select date from shipping)") + _METRICS + " select scenario_id, sessions, " + _rounds("total_return", "max_drawdown") + ", trades, recovery from measured",
    "j12_common_period": walk_sql(_PAIRS) + _METRICS + f" select scenario_id, {_SECTION} from measured",
}
