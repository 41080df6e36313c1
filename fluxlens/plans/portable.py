"""Queries written once, in SQL that both the engine and DuckDB read.

A few functions differ in name; they are written @name(...) and spelt out by
:func:`dialect`.  The adapters at the top make daily market tables out of the
order book (see ``fluxlens.sources.market`` for the same as DataFrames).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fluxlens.operators import selection
from fluxlens.sources import market

FORMS = {
    "countif": ("count_if({0})", "cast(count_if({0}) as bigint)"),
    "days": ("datediff({1}, {0})", "date_diff('day', {0}, {1})"),
    "quantile": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "months": ("add_months({0}, {1})", "cast({0} + to_months({1}) as date)"),
    "weekday": ("dayofweek({0}) - 1", "dayofweek({0})"),
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "text": ("format_string({0}, {1})", "printf({0}, {1})"),
    "joined": ("concat_ws({0}, sort_array(collect_list({1})))", "array_to_string(list_sort(list({1})), {0})"),
    "calendar": ("explode(sequence({0}, {1}, interval 1 day))", "unnest(generate_series({0}, {1}, interval 1 day))"),
    "matches": ("{0} rlike {1}", "regexp_matches({0}, {1})"),
    "last_known": ("last_value({0}) ignore nulls", "last_value({0} ignore nulls)"),
    "first_known": ("first_value({0}) ignore nulls", "first_value({0} ignore nulls)"),
}


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    depth, at, out, k, quoted = 1, start, [], start, False
    while depth:
        c = text[k]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            if depth == 1 and c == "," or depth == 0:
                out.append(text[at:k].strip())
                at = k + 1
        k += 1
    return out, k


def dialect(sql: str, which: int) -> str:
    """The text for the engine (0) or DuckDB (1)."""
    while m := re.search(r"@(\w+)\(", sql):
        arguments, end = _arguments(sql, m.end())
        if m[1] == "text":
            arguments = [arguments[0], ", ".join(arguments[1:])]
        sql = sql[: m.start()] + FORMS[m[1]][which].format(*arguments) + sql[end:]
    return sql


BASE = """
with @@RECURSIVE@@ market as (
  select cast(o_orderdate as date) as date, 
         cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) / (1e2 * count(*)) as close,
         (min(o_totalprice) + max(o_totalprice)) / 2e0 as open,
         cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) / 1e2 as trading_value, cast(sum(o_custkey) as bigint) as ck
  from orders group by cast(o_orderdate as date)
), daily as (
  select *, row_number() over (order by date) as pos, close / lag(close) over (order by date) - 1 as return_1d from market
), obs as (
  select c.channel, date, open, close, trading_value, return_1d, -8e-1 * return_1d + (ck % 13 - 6) / c.scale as flow_share
  from daily cross join (select 'main' as channel, 2e2 as scale union all select 'noisy' as channel, 5e0 as scale) c
), shipping as (
  select cast(l_shipdate as date) as date, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) / (1e2 * count(*)) as price from lineitem group by cast(l_shipdate as date)
), funds as (
  select 'IDX' as ticker, date, open, close from daily
  union all select 'L1', date, 1e2 * open / first_value(close) over (order by date), 1e2 * close / first_value(close) over (order by date) from daily
  union all select 'S1', date, 1e2 * first_value(close) over (order by date) / open, 1e2 * first_value(close) over (order by date) / close from daily
@@SIGNALS@@), states as (
  select * from signals
), turns as (
  select *, row_number() over (partition by channel order by date) - 1 as position from states
), entries as (
  select * from (
    select *, lag(state) over (partition by channel order by date) as before from turns where trade_eligible
  ) e where state in ('extreme_fear', 'extreme_greed') and (before is null or state <> before)
)
"""

#: The signals of ``fluxlens.operators.regression.rolling_signals`` in DuckDB's SQL; the engine has them as a view.
SIGNALS = """), framed@@X as (
  select channel, date, return_1d, flow_share, count(return_1d) over w as training_count,
         regr_slope(flow_share, return_1d) over w as b, regr_intercept(flow_share, return_1d) over w as a,
         case when regr_syy(flow_share, return_1d) over w = 0 then 0e0 else regr_r2(flow_share, return_1d) over w end as fit,
         list({'x': return_1d, 'y': flow_share}) over w as past
  from @@SOURCE where return_1d is not null and flow_share is not null
  window w as (partition by channel order by date rows between @@WINDOW preceding and 1 preceding)
), residuals@@X as (
  select *, flow_share - (a + b * return_1d) as own, list_transform(past, lambda p: p.y - (a + b * p.x)) as res
  from framed@@X
), centred@@X as (
  select *, list_aggregate(res, 'median') as center from residuals@@X
), spread@@X as (
  select *, list_aggregate(list_transform(res, lambda r: abs(r - center)), 'median') as mad from centred@@X
), valid@@X as (
  select *, training_count >= @@LEAST and b is not null and coalesce(mad > 0, false) as good from spread@@X
), scored@@X as (
  select channel, date, return_1d, flow_share, cast(training_count as integer) as training_count,
         case when good then a end as alpha, case when good then b end as beta, case when good then fit end as rolling_r2,
         case when good then own end as residual, case when good then (own - center) / (14826e-4 * mad) end as residual_z,
         case when good then 1e2 * len(list_filter(res, lambda r: r <= own)) / len(res) end as percentile,
         case when training_count < @@LEAST then 'insufficient_history' when b is null then 'invalid_regression'
              when not coalesce(mad > 0, false) then 'zero_mad' when not (b < 0 and fit >= @@FIT) then 'low_model_fit' else 'ok' end as quality,
         good and b < 0 and fit >= @@FIT as trade_eligible
  from valid@@X
), signals@@X as (
  select *, case when percentile is null then 'unavailable' when percentile <= @@TAIL then 'extreme_fear' when percentile <= 20 then 'fear'
                 when percentile < 80 then 'neutral' when percentile < 100 - @@TAIL then 'greed' else 'extreme_greed' end as state
  from scored@@X
"""


def signals_sql(source: str = "obs", suffix: str = "", *, window: int = 252, least: int = 200, fit: str = "2e-1", tail: int = 5) -> str:
    """The named queries up to ``signals<suffix>`` over observations of another table or with other settings."""
    for name, value in (("SOURCE", source), ("X", suffix), ("WINDOW", window), ("LEAST", least), ("FIT", fit), ("TAIL", tail)):
        sql = (SIGNALS if name == "SOURCE" else sql).replace(f"@@{name}", str(value))
    return sql


#: Queries on the market tables, by inventory id.
QUERIES = {
    "a2_index_row_lookup": """select p_partkey, p_name from part where lower(replace(p_type, ' ', '')) in (select lower(replace(min(p_type), ' ', '')) from part)""",
    "a3_last_row_per_code": """select code, l_orderkey, l_linenumber from (
        select coalesce(nullif(l_returnflag, ''), nullif(l_linestatus, '')) as code, l_orderkey, l_linenumber,
               row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as k
        from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey < 10)) x where k = 1""",
    "a4_stock_semi_join": """select l_partkey, count(*) as rows_found, round(sum(l_quantity), 4) as quantity from lineitem
        where l_partkey in (select p_partkey from part where p_size <= 10) group by l_partkey""",
    "a6_business_day_scan": """, bounds as (select min(date) as a, max(date) as b from market), stamps as (select @calendar(a, b) as stamp from bounds), days as (select cast(stamp as date) as day from stamps)
        select d.day, m.close is null as is_missing, round(m.close, 8) as close from days d left join market m on m.date = d.day where @weekday(d.day) between 1 and 5""",
    "a8_header_aliases": """select n_nationkey, coalesce(nullif(n_name, ''), 'none') as name, round(sum(c_acctbal), 2) as individual from nation
        join customer on c_nationkey = n_nationkey where c_acctbal is not null group by n_nationkey, coalesce(nullif(n_name, ''), 'none')""",
    "a10_adjusted_scan": """select ticker, date, floor(open * 100 + 5e-1) / 1e2 as open, floor(close * 100 + 5e-1) / 1e2 as close from funds where close is not null and date is not null""",
    "a11_missing_partitions": """select e.ticker, case when count(f.date) = 0 then 'missing' else 'ok' end as state, count(f.date) as sessions
        from (select 'IDX' as ticker union all select 'L1' as ticker union all select 'X9' as ticker) e left join funds f on f.ticker = e.ticker group by e.ticker""",
    "a12_source_fallback": """select a.date, round(case when b.close is null or abs(a.close - b.close) / a.close > 5e-3 then a.close else b.close end, 8) as close,
        case when b.close is null then 'recent' else 'history' end as source
        from daily a left join (select date, close * (1 + (ck % 3) * 4e-3) as close from daily where pos % 5 <> 0) b on a.date = b.date""",
    "a14_typed_records": """select event_id, cast(ts as date) as day, try_cast(value as double) as value from events where try_cast(value as double) is not null and event_type is not null""",
    "a21_source_counts": """select 'orders' as source, count(*) as n from orders union all select 'lineitem', count(*) from lineitem union all select 'customer', count(*) from customer union all select 'events', count(*) from events""",
    "b1_b7_features": """select date, round(return_1d, 8) as return_1d, round(ck * 1e-3 / trading_value, 10) as flow_share, round(ck / 1e12, 14) as raw_flow_trillion,
        round(case when count(close) over w50 = 50 then 100 * close / avg(close) over w50 end, 6) as disparity50,
        round(case when count(close) over w252 = 252 then close / max(close) over w252 - 1 end, 8) as mdd252,
        round(case when count(close) over w252 >= 20 then close / max(close) over w252 - 1 end, 8) as drawdown20
        from daily window w50 as (order by date rows between 49 preceding and current row), w252 as (order by date rows between 251 preceding and current row)""",
    "b4_override_coalesce": """select date, round(coalesce(case when ck % 4 = 0 then ck * 1e-6 end, return_1d), 8) as flow_share from daily""",
    "b9_b11_states": """select channel, date, round(percentile, 6) as percentile, state, case when state in ('fear', 'extreme_fear') then 'fear' when state in ('greed', 'extreme_greed') then 'greed' else 'neutral' end as direction from states""",
    "b10_variable_tail": """select t.tail, case when percentile is null then 'unavailable' when percentile <= t.tail then 'extreme_fear' when percentile <= 20 then 'fear' when percentile < 80 then 'neutral' when percentile < 100 - t.tail then 'greed' else 'extreme_greed' end as state, count(*) as n
        from states cross join (select 1 as tail union all select 2 as tail union all select 5 as tail union all select 20 as tail) t group by 1, 2""",
    "b19_public_rounding": """select l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity - 10, 0), 10) as value from lineitem""",
    "b20_finite_rows": """select date, round(return_1d, 8) as return_1d from daily where return_1d is not null and trading_value is not null and date <= date '1999-12-31'""",
    "b21_as_of_cutoff": """select ticker, date, round(close, 6) as close from funds where date <= date '1998-06-30'""",
    "b22_b23_evaluation_bounds": """, latest as (select max(date) as d from market)
        select 'ytd' as name, cast(date_trunc('year', d) as date) as first_date, d as last_date from latest union all select '1m', @months(d, -1), d from latest
        union all select '3m', @months(d, -3), d from latest union all select '6m', @months(d, -6), d from latest union all select '1y', @months(d, -12), d from latest union all select '3y', @months(d, -36), d from latest""",
    "b24_iso_date_validate": """select text_date, try_cast(text_date as date) is not null and length(text_date) = 10 as is_valid from (
        select concat(cast(year(o_orderdate) as varchar(4)), '-', lpad(cast(o_orderkey % 14 as varchar(2)), 2, '0'), '-', lpad(cast(o_custkey % 33 as varchar(2)), 2, '0')) as text_date from orders) x""",
    "b25_minimum_observations": """select l.lookback, cast(least(l.lookback, greatest(40, least(200, ceil(8e-1 * l.lookback)))) as bigint) as least_rows from (select cast(p_size as bigint) * 10 as lookback from part) l group by l.lookback""",
    "b28_free_text_filter": """select c_custkey, c_name, c_mktsegment from customer where lower(concat_ws(' ', cast(c_custkey as varchar(20)), c_name, c_mktsegment)) like '%build%'""",
    "b29_relative_return": """select ticker, round(max_by(close, date) / nullif(min_by(close, date), 0) - 1, 8) as relative_return from funds group by ticker""",
    "b30_failure_reason": """select event_id, case when @matches(event_type, '^[a-z]+_[a-z]+$') then event_type when lower(event_type) like '%click%' then 'interaction' when lower(event_type) like '%view%' then 'impression' else 'other' end as reason from events""",
    "b31_numeric_text": """select c_custkey, try_cast(replace(trim(t), ',', '') as double) as value from (select c_custkey, concat(' ', cast(c_custkey as varchar(20)), ',', '000 ') as t from customer) x""",
    "c1_core_join": """select m.date, round(m.close, 8) as close, round(s.price, 8) as price from market m join shipping s on s.date = m.date""",
    "c3_pair_bars": """select l.date, round(l.open, 6) as long_open, round(l.close, 6) as long_close, round(s.open, 6) as inverse_open, round(s.close, 6) as inverse_close from funds l join funds s on s.date = l.date where l.ticker = 'L1' and s.ticker = 'S1' and l.close > 0 and s.close > 0""",
    "c4_c5_signals_to_bars": """select f.ticker, f.date, coalesce(s.state, 'missing') as state from funds f left join states s on s.date = f.date and s.channel = 'main'""",
    "c6_common_calendar": """select date from market where date in (select date from shipping)""",
    "c7_all_tickers_calendar": """select date from funds where ticker in ('IDX', 'L1', 'S1') group by date having count(distinct ticker) = 3""",
    "c8_missing_and_extra": """select m.date, 'missing' as side from market m where not exists (select 1 from shipping s where s.date = m.date)
        union all select s.date, 'extra' as side from shipping s where not exists (select 1 from market m where m.date = s.date)""",
    "c10_exposure_align": """select f.date, round(f.close, 6) as close, case when s.state = 'extreme_fear' then 1 else 0 end as exposure from funds f join states s on s.date = f.date where f.ticker = 'L1' and s.channel = 'main'""",
    "c13_reindex_dropna": """select m.date, round(s.price, 8) as price, round(m.close, 8) as close from market m left join shipping s on s.date = m.date where s.price is not null and m.close is not null""",
    "c14_price_columns": """select date, round(max(case when ticker = 'IDX' then close end), 6) as idx_close, round(max(case when ticker = 'L1' then close end), 6) as l1_close, round(max(case when ticker = 'S1' then close end), 6) as s1_close from funds group by date""",
    "c15_c17_hydration": """select d.date, coalesce(s.state, t.state, 'none') as state from daily d left join states s on s.date = d.date and s.channel = 'noisy' and s.trade_eligible left join states t on t.date = d.date and t.channel = 'main'""",
    "c18_anchor_lookup": """, common as (select m.date, row_number() over (order by m.date desc) as k from market m join shipping s on s.date = m.date where m.date < date '1999-01-01') select date from common where k <= 6""",
    "d1_ols_by_channel": """select channel, count(*) as n, round(regr_slope(flow_share, return_1d), 8) as beta, round(regr_intercept(flow_share, return_1d), 8) as alpha, round(regr_r2(flow_share, return_1d), 8) as r2 from obs where return_1d is not null group by channel""",
    "d9_quality_gate": """select channel, date, quality, trade_eligible from states""",
    "d10_rolling_signals": """select channel, date, training_count, round(alpha, 8) as alpha, round(beta, 8) as beta, round(rolling_r2, 8) as rolling_r2, round(residual, 8) as residual, round(residual_z, 6) as residual_z, round(percentile, 8) as percentile, state, quality, trade_eligible from states""",
    "b12_triggers": """select channel, date, case when state = 'unavailable' or not trade_eligible then 'unavailable' when state in ('extreme_fear', 'extreme_greed') then state else 'none' end as trigger from states""",
    "d12_participant_channels": """select c_mktsegment as channel, cast(o_orderdate as date) as date, round(sum(o_totalprice), 2) as flow from orders join customer on c_custkey = o_custkey group by c_mktsegment, cast(o_orderdate as date)""",
    "d14_available_channels": """select channel, count(flow_share) as n, count(flow_share) >= 200 as available from obs group by channel""",
    "e1_unconditional_forward": """, f as (select close, lead(close, 1) over (order by date) / close - 1 as f1, lead(close, 5) over (order by date) / close - 1 as f5, lead(close, 10) over (order by date) / close - 1 as f10, lead(close, 20) over (order by date) / close - 1 as f20 from daily)
        select round(avg(f1), 8) as h1, round(avg(f5), 8) as h5, round(avg(f10), 8) as h10, round(avg(f20), 8) as h20 from f""",
    "e5_input_quality": """, j as (select count(*) as common from market m join shipping s on s.date = m.date), a as (select count(*) as n, min(date) as first_date, max(date) as last_date, @countif(close is null or close <= 0) as invalid from market), b as (select count(*) as n from shipping)
        select a.n as index_rows, b.n as flow_rows, j.common, a.first_date, a.last_date, a.invalid, round(j.common * 1e0 / (a.n + b.n - j.common), 8) as jaccard, round(j.common * 1e0 / a.n, 8) as coverage from a cross join b cross join j""",
    "e8_scatter_counts": """, latest as (select channel, date, state, row_number() over (partition by channel order by date desc) as k from states) select channel, @countif(k = 1) as current_rows, @countif(k > 1 and state in ('extreme_fear', 'extreme_greed')) as extremes, @countif(k > 1) as history_rows from latest where k <= 253 group by channel""",
    "e11_quality_histogram": """select channel, quality, count(*) as n from states group by channel, quality""",
    "e12_e13_coverage": """select channel, count(flow_share) as n, min(case when flow_share is not null then date end) as first_date, max(date) as last_date, case when count(flow_share) >= 200 then 'active' when count(flow_share) > 0 then 'collecting' else 'planned' end as status from obs group by channel""",
    "f4_lead_ratios": """select ticker, date, round(lead(close, 1) over w / close - 1, 8) as r1, round(lead(close, 20) over w / close - 1, 8) as r20 from funds window w as (partition by ticker order by date)""",
    "f5_running_drawdown": """select ticker, date, round(close / max(close) over (partition by ticker order by date rows between unbounded preceding and current row) - 1, 8) as drawdown from funds""",
    "f6_cumulative_product": """select date, round(sum(ln(1 + coalesce(return_1d, 0) * 5e-1)) over (order by date rows between unbounded preceding and current row), 8) as log_path from daily""",
    "f8_previous_eligible_state": """select channel, date, state, lag(state) over (partition by channel order by date) as before from states where trade_eligible""",
    "f9_holding_segments": """, c as (select *, case when lag(state) over (partition by channel order by date) = state then 0 else 1 end as changed from states), s as (select *, sum(changed) over (partition by channel order by date rows between unbounded preceding and current row) as segment from c)
        select channel, cast(segment as bigint) as segment, state, min(date) as first_date, max(date) as last_date, count(*) as sessions from s group by channel, segment, state""",
    "f10_drawdown_to_date": """, d as (select ticker, date, close / max(close) over (partition by ticker order by date rows between unbounded preceding and current row) - 1 as drawdown from funds) select ticker, date, round(min(drawdown) over (partition by ticker order by date rows between unbounded preceding and current row), 8) as deepest from d""",
    "f11_sampling": """, r as (select date, close, pos, max(pos) over () as last_pos from daily) select date, round(close, 8) as close from r where (pos - 1) % 5 = 0 or pos = last_pos""",
    "f12_index_to_100": """select ticker, date, round(100 * close / first_value(close) over (partition by ticker order by date), 6) as indexed from funds""",
    "g2_tails": """select channel, date, round(flow_share, 8) as flow_share from (select *, row_number() over (partition by channel order by date desc) as k from obs) x where k <= 253""",
    "g4_table_sort": """select c_custkey, c_name, cast(row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) as bigint) as place from customer""",
    "g5_nearest_by_ratio": """, r as (select date, abs((pos - 1) / (max(pos) over () - 1e0) - 37e-2) as away from daily) select min(date) as date from r where away = (select min(away) from r)""",
    "g6_snap_bounds": """select min(case when date >= date '1996-02-03' then date end) as first_date, max(case when date <= date '1999-07-04' then date end) as last_date from market""",
    "h1_union_jaccard": """, u as (select date from market union select date from shipping), i as (select date from market intersect select date from shipping) select (select count(*) from i) as common, (select count(*) from u) as whole""",
    "h2_difference": """select date from market except select date from shipping""",
    "h3_keep_last": """, both_rows as (select date, close, 0 as src from daily union all select date, close + 1, 1 as src from daily where pos % 3 = 0) select date, round(close, 8) as close from (select *, row_number() over (partition by date order by src desc) as k from both_rows) x where k = 1""",
    "h4_h5_duplicates": """, rows_ as (select date, pos from daily union all select date, pos from daily where pos % 7 = 0) select date, count(*) > 1 as is_duplicate from rows_ group by date""",
    "h7_frozen_and_mutable": """, k as (select *, row_number() over (order by date desc) as back from daily) select date, round(close, 8) as close, back > 5 as is_frozen from k""",
    "i1_extreme_entries": """select channel, date, state, cast(position as bigint) as position from entries""",
    "i3_event_returns": """, p as (select date, close, lead(close, 1) over (order by date) as c1, lead(close, 5) over (order by date) as c5, lead(close, 10) over (order by date) as c10, lead(close, 20) over (order by date) as c20 from daily)
        select e.channel, e.date, e.state, round(c1 / p.close - 1, 8) as r1, round(c5 / p.close - 1, 8) as r5, round(c10 / p.close - 1, 8) as r10, round(c20 / p.close - 1, 8) as r20 from entries e join p on p.date = e.date""",
    "j15_bar_selection": """select l.date, round(l.close, 6) as close from funds l where l.ticker = 'L1' and l.date in (select date from funds where ticker = 'S1' and date >= date '1997-01-01')""",
    "j16_interval_snapshot": """select a.ticker, round(b.close / nullif(a.close, 0) - 1, 8) as change from funds a join funds b on b.ticker = a.ticker where a.date = (select min(date) from market) and b.date = (select max(date) from market)""",
    "k1_latest_close": """, l as (select ticker, max(date) as d from funds group by ticker) select f.ticker, f.date, case when abs(f.close - g.close) / f.close <= 5e-3 then 'ok' when g.close is null then 'unavailable' else 'mismatch' end as state from funds f join l on l.ticker = f.ticker and l.d = f.date left join (select ticker, date, close * case when ticker = 'S1' then 102e-2 else 1e0 end as close from funds) g on g.ticker = f.ticker and g.date = f.date""",
    "k7_common_latest": """, c as (select least((select max(date) from market), (select max(date) from shipping)) as cut) select m.date, round(m.close, 8) as close from market m cross join c where m.date <= c.cut""",
    "k10_frozen_equality": """select coalesce(a.date, b.date) as date, round(a.close, 8) as was, round(b.close, 8) as now from daily a full outer join (select date, close + case when pos % 400 = 0 then 1 else 0 end as close from daily where pos <> 17) b on a.date = b.date where a.close is null or b.close is null or abs(a.close - b.close) > 1e-6""",
    "k13_date_regression": """select a.d as published, b.d as candidate, b.d < a.d as is_regression from (select max(date) as d from market) a cross join (select max(date) as d from shipping) b""",
    "k15_contract_checks": """select 'duplicate_dates' as rule, count(*) as violations from (select date from market group by date having count(*) > 1) x union all select 'positive_prices', count(*) from market where not close > 0 union all select 'percentile_range', count(*) from states where percentile < 0 or percentile > 100""",
    "l3_scatter": """select channel, date, round(return_1d, 8) as x, round(flow_share, 8) as y, case when k = 1 then 'current' when state in ('extreme_fear', 'extreme_greed') then 'extreme' else 'training' end as role from (select *, row_number() over (partition by channel order by date desc) as k from states) z where k <= 253""",
    "m5_confirmed_supersedes": """, both_rows as (select date, close, 1 as phase from daily union all select date, close * 101e-2, 0 as phase from daily where pos % 2 = 0) select date, round(max_by(close, phase), 8) as close, cast(max(phase) as int) as phase from both_rows group by date""",
    "a7_range_scan": """select cast(o_orderdate as date) as date, o_orderkey, try_cast(o_totalprice as double) as price from orders where cast(o_orderdate as date) between date '1996-01-01' and date '1996-12-31' and o_totalprice is not null""",
    "a9_individual_flow": """select date, round(-8e-1 * return_1d * trading_value, 2) as individual_net_purchase from daily where return_1d is not null""",
    "a13_stock_fallback": """select p.p_partkey, coalesce(a.price, p.p_retailprice) as price, case when a.price is null then 'fallback' else 'history' end as source from part p left join (select l_partkey, round(max(l_extendedprice / nullif(l_quantity, 0)), 10) as price from lineitem where l_returnflag = 'R' group by l_partkey) a on a.l_partkey = p.p_partkey""",
    "a15_iso_records": """select cast(date as varchar(10)) as date, round(close, 8) as close from daily""",
    "c11_c12_paired_returns": """, p as (select ticker, date, close, lead(close, 5) over (partition by ticker order by date) as later from funds)
        select e.channel, e.date, e.state, round(a.later / a.close - 1, 8) as own_return, round(b.later / b.close - 1, 8) as benchmark_return from entries e join p a on a.date = e.date and a.ticker = 'S1' left join p b on b.date = e.date and b.ticker = 'IDX'""",
    "c16_ledger_hydration": """select f.date, f.ticker, coalesce(s.state, 'none') as state, coalesce(f.close, 0) as close from (select date, ticker, round(close, 8) as close from funds) f left join (select date, state from states where channel = 'noisy' and trade_eligible) s on s.date = f.date""",
    "e15_run_counts": """, c as (select channel, date, state, case when lag(state) over (partition by channel order by date) = state then 0 else 1 end as started from states) select channel, state, cast(sum(started) as bigint) as runs, count(*) as sessions from c group by channel, state""",
    "f1_f2_lags_and_frames": """select ticker, date, round(close / nullif(lag(close) over (partition by ticker order by date), 0) - 1, 8) as return_1d, round(max(close) over (partition by ticker order by date rows between 251 preceding and current row), 8) as highest from funds""",
    "f7_regression_frame": """select channel, date, count(return_1d) over w as n, round(regr_slope(flow_share, return_1d) over w, 8) as beta from obs where return_1d is not null window w as (partition by channel order by date rows between 252 preceding and 1 preceding)""",
    "g1_sort_by_date": """select date, cast(row_number() over (order by date) as bigint) as place, round(close, 8) as close from daily""",
    "j6_entry_dates": """select date, state from entries where channel = 'main'""",
    "l4_relative_diagnostics": """, a as (select i.date, i.close as own, f.close as other, row_number() over (order by i.date) as k, count(*) over () as n from funds i join funds f on f.date = i.date and f.ticker = 'S1' where i.ticker = 'IDX'), b as (select *, 100 * own / first_value(own) over (order by date) as own_100, 100 * other / first_value(other) over (order by date) as other_100 from a)
        select date, round(own_100 - other_100, 6) as spread, round(ln(own_100 / other_100), 8) as log_relative from b where (n - k) < 756 and ((n - k) % 5 = 0)""",
    "q_daily_by_nation": """select n_name, cast(o_orderdate as date) as date, count(*) as orders_placed, round(sum(o_totalprice), 2) as trading_value from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by n_name, cast(o_orderdate as date)""",
}
#: Columns of the view of signals.
SIGNAL_COLUMNS = "channel string, date date, return_1d double, flow_share double, training_count int, alpha double, beta double, rolling_r2 double, residual double, residual_z double, percentile double, state string, quality string, trade_eligible boolean"
VIEWS = ("orders", "lineitem", "customer", "nation", "part", "supplier", "events")


def text_of(name: str, which: int) -> str:
    return with_adapters(QUERIES[name], which)


def with_adapters(body: str, which: int) -> str:
    """A query, or further named queries and it after a comma, behind the adapters."""
    body = body.strip()
    return dialect(BASE.rstrip().replace("@@RECURSIVE@@", "recursive" if which else "").replace("@@SIGNALS@@", signals_sql() if which else "") + (body if body.startswith(",") else "\n" + body), which)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query over the tables of a folder."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for v in VIEWS:
        session.read.parquet(f"{sf_dir}/{v}.parquet").createOrReplaceTempView(v)
    if re.search(r"\b(signals|states|turns|entries)\b", QUERIES[name]):
        signals = selection.rolling_signals(market.observations(market.market_daily(session.table("orders"))))
    else:  # the adapters name the view, this query doesn't
        signals = session.createDataFrame([], SIGNAL_COLUMNS)
    signals.createOrReplaceTempView("signals")
    return session.sql(text_of(name, 0))
