"""DuckDB's SQL of the history queries, written from their definitions."""

from __future__ import annotations

from fluxlens.plans import trading
from fluxlens.plans.portable import signals_sql

SAMPLES = 2_000
SEED = 20260715

#: Days with net purchases, features and the two flow channels.
_FEATURES = """, flowing as (
  select date, close, trading_value, ck, (-8e-1 * coalesce(return_1d, 0e0) + (ck % 13 - 6) / 2e2) * trading_value as net from daily
), featured as (
  select date, close, trading_value, net, close / lag(close) over (order by date) - 1 as return_1d, net / trading_value as flow_share, net / 1e12 as raw_flow,
         case when row_number() over (order by date) >= 50 then 1e2 * close / avg(close) over (order by date rows between 49 preceding and current row) end as disparity50,
         case when row_number() over (order by date) >= 252 then close / max(close) over (order by date rows between 251 preceding and current row) - 1 end as mdd252,
         case when ck % 50 = 0 then 'published-' || cast(ck as varchar) else substring(sha256(cast(date as varchar) || '|' || printf('%.10f', close) || '|' || printf('%.4f', trading_value) || '|' || printf('%.4f', net)), 1, 16) end as source_hash
  from flowing
)"""
_LIMITS = """, limited as (
  select date, disparity50, case when count(disparity50) over past = 756 then quantile_cont(disparity50, 1e-1) over past end as disparity_limit from featured window past as (order by date rows between 756 preceding and 1 preceding)
)"""


def _line(source: str) -> str:
    """Adds the weighted line's slope b2 and intercept a2 to rows with xs, ys and w2."""
    at = "list_sum(list_transform(range(1, len(xs) + 1), lambda i: w2[i] * {}))"
    return f"""select *, my - b2 * mx as a2 from (select *, {at.format('(xs[i] - mx) * (ys[i] - my)')} / {at.format('(xs[i] - mx) * (xs[i] - mx)')} as b2
      from (select *, {at.format('xs[i]')} / list_sum(w2) as mx, {at.format('ys[i]')} / list_sum(w2) as my from ({source}) l0) l1) l2"""


def huber_sql(source: str, suffix: str = "") -> str:
    """Named queries up to ``hubers<suffix>``: reweighted lines by recursion, then the same grading as for least squares."""
    x = suffix
    first = f"select channel, date, xs, ys, list_transform(xs, lambda v: 1e0) as w2 from h_ok{x}"
    step = f"""select *, list_transform(away, lambda z: case when z <= 1345e-3 * scale then 1e0 else 1345e-3 * scale / z end) as w2 from (
        select *, 14826e-4 * list_aggregate(away, 'median') as scale from (
          select *, list_transform(r, lambda v: abs(v - list_aggregate(r, 'median'))) as away from (
            select h.channel, h.date, h.it, h.a, h.b, o.xs, o.ys, list_transform(range(1, len(o.xs) + 1), lambda i: o.ys[i] - (h.a + h.b * o.xs[i])) as r
            from h_walk{x} h join h_ok{x} o on o.channel = h.channel and o.date = h.date where not h.done and h.it < 50) s0) s1) s2 where scale > 0"""
    return f""", h_train{x} as materialized (
  select channel, date, return_1d, flow_share, count(return_1d) over w as n, list(return_1d) over w as xs, list(flow_share) over w as ys from {source}
  where return_1d is not null and flow_share is not null window w as (partition by channel order by date rows between 252 preceding and 1 preceding)
), h_ok{x} as materialized (select * from h_train{x} where n >= 200
), h_walk{x} as (
  select channel, date, 0 as it, a2 as a, b2 as b, w2 as w, false as done from ({_line(first)}) f
  union all
  select channel, date, it + 1, a2, b2, w2, greatest(abs(a2 - a), abs(b2 - b)) <= 1e-10 * (1 + greatest(abs(a2), abs(b2))) from ({_line(step)}) g
), h_fit{x} as (select channel, date, arg_max(a, it) as a, arg_max(b, it) as b, arg_max(w, it) as w from h_walk{x} group by channel, date
), h_res{x} as (
  select t.channel, t.date, t.return_1d, t.flow_share, t.n, f.a, f.b, f.w, t.ys, flow_share - (a + b * return_1d) as own, list_transform(range(1, len(t.xs) + 1), lambda i: t.ys[i] - (a + b * t.xs[i])) as res
  from h_train{x} t left join h_fit{x} f on f.channel = t.channel and f.date = t.date
), h_mid{x} as (select *, list_aggregate(res, 'median') as center, list_sum(list_transform(range(1, len(ys) + 1), lambda i: w[i] * ys[i])) / list_sum(w) as wy from h_res{x}
), h_spread{x} as (
  select *, list_aggregate(list_transform(res, lambda r: abs(r - center)), 'median') as mad,
         1 - list_sum(list_transform(res, lambda r: r * r)) / list_sum(list_transform(ys, lambda y: (y - list_avg(ys)) * (y - list_avg(ys)))) as fit,
         1 - list_sum(list_transform(range(1, len(ys) + 1), lambda i: w[i] * res[i] * res[i])) / list_sum(list_transform(range(1, len(ys) + 1), lambda i: w[i] * (ys[i] - wy) * (ys[i] - wy))) as weighted_fit
  from h_mid{x}
), h_good{x} as (select *, n >= 200 and b is not null and coalesce(mad > 0, false) as good from h_spread{x}
), h_graded{x} as (
  select channel, date, return_1d, flow_share, cast(n as integer) as training_count, case when good then a end as alpha, case when good then b end as beta, case when good then fit end as rolling_r2, case when good then weighted_fit end as fit_score,
         case when good then own end as residual, case when good then (own - center) / (14826e-4 * mad) end as residual_z, case when good then 1e2 * len(list_filter(res, lambda r: r <= own)) / len(res) end as percentile,
         case when n < 200 then 'insufficient_history' when b is null then 'invalid_regression' when not coalesce(mad > 0, false) then 'zero_mad' when not (b < 0 and fit >= 2e-1) then 'low_model_fit' else 'ok' end as quality,
         coalesce(good and b < 0 and fit >= 2e-1, false) as trade_eligible
  from h_good{x}
), hubers{x} as (
  select *, case when percentile is null then 'unavailable' when percentile <= 5 then 'extreme_fear' when percentile <= 20 then 'fear' when percentile < 80 then 'neutral' when percentile < 95 then 'greed' else 'extreme_greed' end as state from h_graded{x}
)"""


_CHANNELS = ", channelled as (select 'scaled' as channel, date, return_1d, flow_share from featured union all select 'raw', date, return_1d, raw_flow from featured" + signals_sql("channelled", "_f") + ")"
_ROBUST = ", robust_in as (select 'robust' as channel, date, return_1d, flow_share from featured)" + huber_sql("robust_in")
_MISSING = "coalesce({0}.state, 'unavailable') as {1}_state, coalesce({0}.quality, 'missing') as {1}_quality, coalesce({0}.training_count, 0) as {1}_training_count, coalesce({0}.trade_eligible, false) as {1}_trade_eligible"
_FRAME = _FEATURES + _CHANNELS + _ROBUST + f""", joined as (
  select f.*, h.alpha as robust_alpha, h.beta as robust_beta, h.percentile as robust_percentile, h.fit_score as robust_fit_score, h.rolling_r2 as robust_rolling_r2, h.residual as robust_residual, h.residual_z as robust_residual_z, h.flow_share - h.residual as robust_expected_flow,
         s.percentile as scaled_percentile, s.flow_share - s.residual as scaled_expected_flow, r.percentile as raw_percentile,
         {_MISSING.format('h', 'robust')}, {_MISSING.format('s', 'scaled')}, {_MISSING.format('r', 'raw')}
  from featured f left join hubers h on h.date = f.date left join signals_f s on s.date = f.date and s.channel = 'scaled' left join signals_f r on r.date = f.date and r.channel = 'raw'
), pointed as (
  select *, case when scaled_state like '%fear' then 'fear' when scaled_state like '%greed' then 'greed' else 'neutral' end as sd, case when raw_state like '%fear' then 'fear' when raw_state like '%greed' then 'greed' else 'neutral' end as rd,
         case when robust_state like '%fear' then 'fear' when robust_state like '%greed' then 'greed' else 'neutral' end as bd,
         case when scaled_state = 'unavailable' or not scaled_trade_eligible then 'unavailable' when scaled_state like 'extreme%' then scaled_state else 'none' end as st,
         case when raw_state = 'unavailable' or not raw_trade_eligible then 'unavailable' when raw_state like 'extreme%' then raw_state else 'none' end as rt,
         case when robust_state = 'unavailable' or not robust_trade_eligible then 'unavailable' when robust_state like 'extreme%' then robust_state else 'none' end as bt
  from joined
), agreed as (
  select *, case when scaled_state = 'unavailable' or raw_state = 'unavailable' then 'unavailable' when sd = rd then 'agree' else 'mixed' end as direction_agreement,
         case when st = 'unavailable' or rt = 'unavailable' then 'unavailable' when st = rt and st = 'none' then 'neither' when st = rt then 'both' when st = 'none' then 'raw_only' when rt = 'none' then 'scaled_only' else 'conflict' end as trigger_agreement,
         list_filter([case when bt <> 'unavailable' then bd end, case when st <> 'unavailable' then sd end, case when rt <> 'unavailable' then rd end], lambda v: v is not null) as ways,
         list_filter([case when bt <> 'unavailable' then bt end, case when st <> 'unavailable' then st end, case when rt <> 'unavailable' then rt end], lambda v: v is not null) as pulls
  from pointed
), framed_days as (
  select *, case when scaled_state = 'unavailable' then 'unavailable' when not scaled_trade_eligible then 'low_model_fit' when raw_state = 'unavailable' or not raw_trade_eligible then 'scaled_only'
                 when direction_agreement <> 'agree' then 'mixed' when trigger_agreement in ('scaled_only', 'raw_only', 'conflict') then 'mixed_trigger' else 'high' end as model_confidence,
         case when robust_state = 'unavailable' then 'unavailable' when robust_quality <> 'ok' then 'low_model_fit' when len(ways) < 2 then 'scaled_only' when len(list_distinct(ways)) > 1 then 'mixed' when len(list_distinct(pulls)) > 1 then 'mixed_trigger' else 'high' end as primary_confidence
  from agreed
)"""

#: Events of both samples and forward returns by asset.
_STUDY = """, ordered as (select date, state, position, row_number() over (order by position) as k from entries where channel = 'main'
), kept as (
  select date, state, position, k from ordered where k = 1
  union all
  select o.date, o.state, o.position, o.k from kept p join ordered o on o.k = (select min(n.k) from ordered n where n.position >= p.position + 21)
), chosen as (select 'all' as sample, date, state from ordered union all select 'non_overlapping', date, state from kept
), legs as (select * from (values (1), (5), (10), (20)) h(horizon)
), numbered as (select ticker as asset, date, close, row_number() over (partition by ticker order by date) as k from funds
), ahead as (select n.asset, n.date, l.horizon, m.close / n.close - 1 as value from numbered n cross join legs l join numbered m on m.asset = n.asset and m.k = n.k + l.horizon
), means as (select asset, horizon, avg(value) as usual from ahead group by asset, horizon
), cells as (select s.state, l.horizon from legs l cross join (values ('extreme_fear'), ('extreme_greed')) s(state))"""


def _bootstrap(values: str, keys: tuple[str, ...], name: str, method: str = "moving_block") -> str:
    """Named queries up to ``name``: intervals of the mean of ``value`` by key."""
    by = ", ".join(keys)
    length = "1" if method == "iid" else "least(len(v), greatest(2, cast(round(sqrt(len(v))) as integer)))"
    text = " || ':' || ".join([f"'{SEED}'", *[f"cast({k} as varchar)" for k in keys], "cast(s as varchar)"])
    return f""", {name}_v as (select {by}, list(value order by date) as v from {values} group by {by}
), {name}_b as (select {by}, v, len(v) as n, {length} as width from {name}_v
), {name}_s as (select *, unnest(range(0, {SAMPLES})) as s from {name}_b
), {name}_d as (select {by}, s, n, width, v, unnest(range(0, cast(ceil(n / width) as bigint))) as block from {name}_s
), {name}_t as (select *, cast('0x' || substring(md5({text} || ':' || cast(block as varchar)), 1, 8) as bigint) % n as start, least(width, n - block * width) as here from {name}_d
), {name}_m as (select {by}, s, sum(list_sum(list_slice(v || v, cast(start + 1 as bigint), cast(start + here as bigint)))) / any_value(n) as m from {name}_t group by {by}, s
), {name} as (select {by}, quantile_cont(m, 25e-3) as low, quantile_cont(m, 975e-3) as high from {name}_m group by {by})"""


_ALL = ", valued as (select c.sample, c.date, c.state, a.asset, a.horizon, a.value, m.usual, a.value - m.usual as excess from chosen c join ahead a on a.date = c.date join means m on m.asset = a.asset and m.horizon = a.horizon), excessive as (select sample, asset, state, horizon, date, excess as value from valued)"
_KEYS = ("sample", "asset", "state", "horizon")
_INTERVALS = _bootstrap("valued", _KEYS, "ci") + _bootstrap("excessive", _KEYS, "xi")
_GAINS = "avg(case when v.value > 0 then 1e0 when v.value is not null then 0e0 end)"

_SOURCES = """, official as (
  select 'L1' as ticker, date, 1e2 * close / first_value(close) over (order by date) as close from daily union all select 'L2', date, 1e2 * (close / first_value(close) over (order by date)) * (close / first_value(close) over (order by date)) from daily
  union all select 'S1', date, 1e2 * (first_value(close) over (order by date) / close) from daily
), other as (
  select ticker, date, close * case ticker when 'S1' then 101e-2 else 1001e-3 end as close from official where date_diff('day', date '1995-01-01', date) % 19 <> 7 and (ticker <> 'L2' or date < (select max(date) from official))
)"""


def _r(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) as {n.split('.')[-1]}" for n in names)


def _z(digits: int, **names: str) -> str:
    """As ``_r`` under given names; a negative zero becomes zero."""
    return ", ".join(f"round({v}, {digits}) + 0e0 as {n}" for n, v in names.items())


_POSITION = trading.walk_sql(trading.scenarios(costs=(10,), exits=(80,), policies=("long_cash", "long_inverse_cash"), pairs=("1x",)))

SQL = {
    "b8_source_hash": _FEATURES + " select date, source_hash from featured",
    "b16_residual_signs": """ select a.date, case when a.residual is null or b.residual is null or a.residual = 0 or b.residual = 0 then 'unavailable' when (a.residual < 0) = (b.residual < 0) then 'aligned' else 'mixed' end as state
        from states a left join states b on b.date = a.date and b.channel = 'noisy' where a.channel = 'main'""",
    "b32_effective_status": """ select date, case when ck % 11 = 0 then 'unavailable' when ck % 3 = 0 and ck % 5 = 0 then 'stale' when ck % 4 = 0 then 'stale' when 10 - case when ck % 6 <> 0 then ck % 9 else 0 end > 7 then 'stale' when ck % 7 = 0 then 'degraded' else 'ok' end as status from daily""",
    "d2_d8_huber_signals": huber_sql("obs") + " select channel, date, training_count, state, quality, trade_eligible, " + _r(7, "return_1d", "flow_share", "alpha", "beta", "rolling_r2", "fit_score", "residual", "residual_z", "percentile") + " from hubers",
    "d11_d13_analysis_frame": _FRAME + " select date, " + _r(7, "close", "return_1d", "flow_share", "disparity50", "mdd252", "robust_percentile", "scaled_percentile", "raw_percentile", "robust_fit_score", "scaled_expected_flow") + ", "
        + ", ".join(f"{p}_{c}" for p in ("robust", "scaled", "raw") for c in ("state", "quality", "training_count", "trade_eligible")) + ", direction_agreement, trigger_agreement, model_confidence, primary_confidence from framed_days",
    "b17_b18_snapshot": _FEATURES + _CHANNELS + _ROBUST + ", told as (" + " union all ".join(
        f"select date, {m} as model, alpha, beta, rolling_r2, residual, residual_z, percentile, state, quality, training_count, trade_eligible, flow_share - residual as expected_flow, '{f}' as fit_method, {s} as fit_score from {t}"
        for m, f, s, t in (("'robust'", "huber", "fit_score", "hubers"), ("channel", "ols", "rolling_r2", "signals_f")))
        + ") select date, model, state, quality, training_count, trade_eligible, fit_method, " + _z(6, **{c: c for c in ("alpha", "beta", "rolling_r2", "residual", "residual_z", "percentile", "expected_flow", "fit_score")}) + " from told where date = (select max(date) from featured)",
    "l2_history_rows": _FRAME + _LIMITS + _POSITION + " select f.date, " + _z(6, close="f.close", return_1d="f.return_1d", flow_share="f.flow_share", disparity50="f.disparity50", mdd252="f.mdd252", expected="robust_expected_flow", residual="robust_residual",
        residual_z="robust_residual_z", percentile="robust_percentile", rolling_r2="robust_rolling_r2", fit_score="robust_fit_score", scaled_percentile="scaled_percentile", raw_percentile="raw_percentile",
        L1_open="x.o", L1_close="x.c", S1_open="x.oo", S1_close="x.oc", L2_open="y.o", L2_close="y.c", S2_open="y.oo", S2_close="y.oc") + """, robust_state as state, robust_quality as quality, robust_trade_eligible as trade_eligible, scaled_state, scaled_trade_eligible, raw_state, raw_trade_eligible,
        raw_trade_eligible and not (raw_state = 'extreme_fear' and not coalesce(l.disparity50 <= l.disparity_limit, false)) as disparity_eligible, direction_agreement, trigger_agreement, source_hash, coalesce(p.position, 'unavailable') as position
        from framed_days f join limited l on l.date = f.date left join path p on p.scenario_id = '1x-long_cash-10-80' and p.date = f.date left join bars x on x.pair = '1x' and x.date = f.date left join bars y on y.pair = '2x' and y.date = f.date""",
    "d15_d17_parameter_signals": ", chosen_obs as (select * from obs" + signals_sql("chosen_obs", "_p", window=60, least=48, fit="4e-1", tail=2) + ") select channel, date, round(percentile, 8) as percentile, state, quality, trade_eligible from signals_p",
    "e4_bootstrap": _STUDY + ", own as (select c.date, c.state, a.horizon, a.value from chosen c join ahead a on a.date = c.date and a.asset = 'IDX' where c.sample = 'all')" + _bootstrap("own", ("state", "horizon"), "mb") + _bootstrap("own", ("state", "horizon"), "ii", "iid")
        + " select state, horizon, " + _r(7, "low", "high") + ", 'moving_block' as method from mb union all select state, horizon, " + _r(7, "low", "high") + ", 'iid' from ii",
    "i4_i5_event_study": _STUDY + _ALL + _INTERVALS + f""" select s.sample, m.asset, c.state, c.horizon, count(v.value) as n, round(avg(v.value), 7) as mean, round(quantile_cont(v.value, 5e-1), 7) as median, round({_GAINS}, 7) as positive_rate,
        round(any_value(v.usual), 7) as benchmark, round(avg(v.value) - any_value(v.usual), 7) as excess, case when count(v.value) > 0 then 'fixed_external_mean' else 'unavailable' end as treatment, count(v.value) < 20 as small_sample,
        round(any_value(i.low), 7) as low, round(any_value(i.high), 7) as high, round(any_value(x.low), 7) as excess_low, round(any_value(x.high), 7) as excess_high
        from (values ('all'), ('non_overlapping')) s(sample) cross join (select distinct asset from means) m cross join cells c left join valued v on v.sample = s.sample and v.asset = m.asset and v.state = c.state and v.horizon = c.horizon
        left join ci i on i.sample = s.sample and i.asset = m.asset and i.state = c.state and i.horizon = c.horizon left join xi x on x.sample = s.sample and x.asset = m.asset and x.state = c.state and x.horizon = c.horizon group by all""".replace("group by all", "group by s.sample, m.asset, c.state, c.horizon"),
    "i6_treatments": _STUDY + """, told as (select c.sample, a.asset, count(a.value) as n from chosen c join ahead a on a.date = c.date group by c.sample, a.asset)
        select sample, asset, case when n > 0 then t else 'unavailable' end as treatment, against from told cross join (values ('mean', 'fixed_external_mean'), ('index', 'paired_event_returns')) x(against, t)""",
    "e3_paired_study": _STUDY + f""", v0 as (select c.date, c.state, a.horizon, a.value, b.value as pair from chosen c join ahead a on a.date = c.date and a.asset = 'S1' left join ahead b on b.date = c.date and b.asset = 'IDX' and b.horizon = a.horizon where c.sample = 'all')
        select c.state, c.horizon, count(v.value) as n, round(avg(v.value), 7) as mean, round(quantile_cont(v.value, 5e-1), 7) as median, round({_GAINS}, 7) as positive_rate,
        round(case when count(v.pair) = count(v.value) then avg(v.pair) end, 7) as benchmark, round(case when count(v.pair) = count(v.value) then avg(v.value) - avg(v.pair) end, 7) as excess,
        case when count(v.value) > 0 and count(v.pair) = count(v.value) then 'paired_event_returns' else 'unavailable' end as treatment, count(v.value) < 20 as small_sample from cells c left join v0 v on v.state = c.state and v.horizon = c.horizon group by c.state, c.horizon""",
    "i5_last_events": _STUDY + """, late as (select date, state, row_number() over (order by date desc) as back from kept), assets as (select distinct asset from ahead)
        select s.asset, l.date, l.state, """ + ", ".join(f"round((select a.value from ahead a where a.asset = s.asset and a.date = l.date and a.horizon = {h}), 8) as return_{h}" for h in (1, 5, 10, 20)) + " from late l cross join assets s where l.back <= 12",
    "i7_windowed_study": """, ordered as (select date, state, position, row_number() over (order by position) as k from entries where channel = 'main' and date between date '1996-01-01' and date '1999-06-30'
        ), kept as (select date, state, position, k from ordered where k = 1 union all select o.date, o.state, o.position, o.k from kept p join ordered o on o.k = (select min(n.k) from ordered n where n.position >= p.position + 21)
        ), legs as (select * from (values (1), (5), (10), (20)) h(horizon)), numbered as (select date, close, row_number() over (order by date) as k from funds where ticker = 'L1' and date <= date '1999-06-30')
        , ahead as (select n.date, l.horizon, m.close / n.close - 1 as value from numbered n cross join legs l join numbered m on m.k = n.k + l.horizon), means as (select horizon, avg(value) as usual from ahead group by horizon)
        , v0 as (select e.state, a.horizon, a.value, m.usual from kept e join ahead a on a.date = e.date join means m on m.horizon = a.horizon)
        select s.state, l.horizon, count(v.value) as n, round(avg(v.value), 7) as mean, round(quantile_cont(v.value, 5e-1), 7) as median, round(""" + _GAINS + """, 7) as positive_rate, round(any_value(v.usual), 7) as benchmark,
        round(avg(v.value) - any_value(v.usual), 7) as excess, case when count(v.value) > 0 then 'fixed_external_mean' else 'unavailable' end as treatment, count(v.value) < 20 as small_sample
        from legs l cross join (values ('extreme_fear'), ('extreme_greed')) s(state) left join v0 v on v.state = s.state and v.horizon = l.horizon group by s.state, l.horizon""",
    "f3_rolling_quantile": _FEATURES + _LIMITS + " select date, " + _r(6, "disparity50", "disparity_limit") + " from limited",
    "j10_disparity_filter": _FEATURES + _LIMITS + " select s.channel, s.date, s.state, s.trade_eligible, s.trade_eligible and not (s.state = 'extreme_fear' and not coalesce(l.disparity50 <= l.disparity_limit, false)) as disparity_eligible from states s join limited l on l.date = s.date",
    "k2_anchor_check": _SOURCES + """, common as (select o.ticker, o.date, o.close as a, b.close as b, row_number() over (partition by o.ticker order by o.date) - 1 as place, count(*) over (partition by o.ticker) as n from official o join other b on b.ticker = o.ticker and b.date = o.date)
        , spots as (select distinct c.ticker, round_even(i * (max(c.n) - 1) / 5e0, 0) as place from common c cross join (select unnest(range(0, 6)) as i) g group by c.ticker, i)
        , marks as (select c.ticker, count(*) as anchors, count_if(abs(a / b - 1) > 5e-3) as mismatches, max(abs(a / b - 1)) as widest from common c join spots s on s.ticker = c.ticker and s.place = c.place group by c.ticker)
        , ends as (select o.ticker, max(o.date) as x, (select max(b.date) from other b where b.ticker = o.ticker) as y from official o group by o.ticker)
        select e.ticker, case when x = y then anchors else 0 end as anchors, case when x = y then mismatches else 0 end as mismatches, round(case when x = y then widest end, 8) as widest,
        case when x <> y then 'unavailable' when mismatches > 0 then 'mismatch' else 'ok' end as state, case when x <> y then 'expected_date_not_common' when mismatches > 0 then 'historical_anchor_difference_exceeded' end as reason from ends e left join marks m on m.ticker = e.ticker""",
    "k6_inherited_repairs": _SOURCES + """, gone as (select o.ticker, o.date, o.date >= date '1999-01-01' as recent from official o where not exists (select 1 from other b where b.ticker = o.ticker and b.date = o.date))
        , counted as (select ticker, count_if(recent) as now, count_if(not recent) as was, list(date order by date) as days, list(date order by date) filter (where recent) as new_days from gone group by ticker)
        select ticker, case ticker when 'L2' then 'unavailable' else 'ok' end as state, case when ticker = 'L2' or was = 0 then now else now + was end as filled, case when ticker = 'L2' then 0 else was end as inherited,
        array_to_string(list_transform(list_slice(case when ticker = 'L2' or was = 0 then new_days else list_concat(list_slice(list_filter(days, lambda d: d < date '1999-01-01'), 1, 3), list_slice(new_days, 1, 3)) end, 1, 3), lambda d: cast(d as varchar)), ',') as sample,
        case when ticker = 'L2' or was = 0 then 'current' else 'published_history_plus_current' end as provenance from counted where now > 0""",
    "k8_incremental_seed": " select date, round(close, 8) as close, (select count(*) from daily n where n.date > d.date and n.date <= date '2000-12-31') >= 5 as is_frozen from daily d where date <= date '2000-12-31' and (select count(*) from daily where date <= date '2000-12-31') >= 252",
    "k11_scale_stability": _SOURCES + """, c as (select o.ticker, abs(b.close / o.close - 1) as drift, row_number() over (partition by o.ticker order by o.date desc) as back from official o join other b on b.ticker = o.ticker and b.date = o.date where o.date < date '1999-01-01')
        select ticker, count(*) as anchors, round(max(drift), 8) as drift, case when count(*) < 3 then 'insufficient' when max(drift) > 5e-3 then 'drifted' else 'stable' end as state from c where back <= 6 group by ticker""",
    "k12_unchanged": " select run, run = 'same' as is_unchanged from (values ('same'), ('changed')) r(run)",
    "e14_output_signature": """, lines as (select date_trunc('month', date) as month, date, '{"date":"' || cast(date as varchar) || '","state":"' || state || '","quality":"' || quality || '"}' as line from states where channel = 'main')
        , months as (select month, sha256(string_agg(line, chr(10) order by date)) as hash from lines group by month) select sha256(string_agg(hash, chr(10) order by month)) as signature from months""",
    "h6_ordered_reasons": """ select date, array_to_string(list_filter([case when late = 1 then 'late' end, case when gap = 1 then 'gap' end, case when late = 2 then 'late' end, case when scale then 'scale' end, case when late = 3 then 'late' end], lambda v: v is not null), ',') as reasons
        from (select date, case when ck % 2 = 0 then 1 when ck % 5 = 0 then 2 when ck % 7 = 0 then 3 else 0 end as late, case when ck % 3 = 0 then 1 else 0 end as gap, ck % 4 = 0 as scale from daily) x""",
    "l8_conclusion": _STUDY + _ALL + _bootstrap("excessive", _KEYS, "xi") + _POSITION + trading._METRICS + """, gains as (select bool_and(coalesce(total_return > 0 and sharpe > 0, false)) as good, count(total_return) as told from measured where scenario_id in ('1x-long_cash-10-80', '1x-long_inverse_cash-10-80'))
        , lows as (select s.sample, m.asset, any_value(x.low) as low from (values ('all'), ('non_overlapping')) s(sample) cross join (select distinct asset from means) m left join xi x on x.sample = s.sample and x.asset = m.asset and x.state = 'extreme_fear' and x.horizon = 20 group by s.sample, m.asset)
        select sample, asset, case when coalesce(low > 0, false) and good then 'supportive' when low is null or told < 2 then 'mixed' else 'caution' end as tone from lows cross join gains""",
    "l6_strategy_comparison": trading.walk_sql(trading.GRID) + """, gains as (select pair || '-' || policy || '-' || cast(cast(long_exit as integer) as varchar) as strategy, bps, arg_max(equity, k) - 1 as gain from path group by scenario_id, pair, policy, long_exit, bps)
        , wide as (select strategy, max(case when bps = 0 then gain end) as r0, max(case when bps = 5 then gain end) as r5, max(case when bps = 10 then gain end) as r10, max(case when bps = 20 then gain end) as r20 from gains group by strategy)
        select strategy, round(r0, 8) as return_0bp, round(r5, 8) as return_5bp, round(r10, 8) as return_10bp, round(r20, 8) as return_20bp,
        case when r0 <= 0 then 0e0 when r5 = 0 then 5e0 when r5 < 0 then round(r0 / (r0 - r5) * 5, 2) when r10 = 0 then 10e0 when r10 < 0 then round(5 + r5 / (r5 - r10) * 5, 2) when r20 = 0 then 20e0 when r20 < 0 then round(10 + r10 / (r10 - r20) * 10, 2) end as break_even_bps from wide""",
}
SQL = {name: sql for name, sql in SQL.items() if sql}
