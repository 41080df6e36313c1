"""Queries over sources that are chosen, cut and checked, other traders' signals, relative diagnostics, and live rows on a history that moves on."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.functions import states
from fluxlens.operators import asof, frame, reconcile, regression, scan, selection
from fluxlens.plans import ordered
from fluxlens.plans.portable import signals_sql
from fluxlens.plans.trading import rounded
from fluxlens.sources import landing, market
from fluxlens.streaming import live

PART = ordered.PART


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_daily(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _gap(days: int, at: int):
    return F.pmod(F.datediff("date", F.lit("1995-01-01")), F.lit(days)) == at


def a12_source_by_fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of each fund or, whole, the recent source: S1's disagrees on the last day, X1 has no history, X9 has neither."""
    funds = ordered._funds(spark, sf_dir).select("ticker", "date", "close")
    history = funds.withColumn("close", F.when((F.col("ticker") == "S1") & (F.col("date") >= "2001-07-01"), F.col("close") * 1.02).otherwise(F.col("close")))
    recent = funds.where("date >= date'2001-06-01' and ticker <> 'L1'")
    recent = recent.unionByName(recent.where("ticker = 'IDX'").withColumn("ticker", F.lit("X1")))
    expected = spark.createDataFrame([(t,) for t in ("IDX", "L1", "S1", "X1", "X9")], "ticker string")
    prices, told = reconcile.chosen_source(history, recent, expected)
    counted = prices.groupBy("ticker").agg(F.count("*").alias("sessions"), F.round(F.max_by("close", "date"), 6).alias("last_close"))
    return told.join(counted, "ticker", "left").select("ticker", "source", "reason", F.coalesce("sessions", F.lit(0)).alias("sessions"), "last_close")


def k3_combined_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest close and anchors of two sources as of a day: instants of one are cut by their day in another zone."""
    official = ordered._funds(spark, sf_dir).select("ticker", (F.col("date").cast("timestamp") + F.expr("interval 20 hours")).alias("date"), "close")
    moved = F.col("close") * F.when(F.col("ticker") == "S1", 1.01).otherwise(1.001)
    other = official.withColumn("close", moved).where(~_gap(19, 7) & ((F.col("ticker") != "L1") | (F.col("date") < "1999-06-28")))
    found = reconcile.combined(official, other, expected="1999-06-30", zone="Asia/Seoul")
    return found.select("ticker", "date", F.round("gap", 8).alias("gap"), "state", "anchors", "mismatches", F.round("anchor_gap", 8).alias("anchor_gap"), "anchor_state", "anchor_reason")


def b20_finite_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    ck = F.col("ck")
    value = F.when(ck % 10 == 0, float("nan")).when(ck % 7 == 0, float("inf")).when(ck % 13 == 0, float("-inf")).when(ck % 11 != 0, F.col("close"))
    found = reconcile.finite_rows(_daily(spark, sf_dir).withColumn("value", value), ["value", "trading_value"], end="2000-12-31")
    return found.select("date", F.round("value", 6).alias("value"))


def b21_cutoff_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events up to a day of another zone, which ends nine hours before the day in which they are stamped."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("date"))
    return reconcile.as_of(events, "2024-01-09", zone="Asia/Seoul").select("event_id", F.col("date").alias("day"))


def d12_participant_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of two other groups of traders; of the three that are asked for the table has no third."""
    daily = _daily(spark, sf_dir)
    days = scan.framed(daily, [], ["date"], {"before": lambda w: F.lag("close").over(w)}, preceding=1, rows=PART).withColumn("return_1d", F.col("close") / F.col("before") - 1)
    change, value = F.coalesce("return_1d", F.lit(0.0)), F.col("trading_value")
    flows = {"foreign": (-0.5 * change + (F.col("ck") % 7 - 3) / 300.0) * value, "institution": (0.2 * change + (F.col("ck") % 11 - 5) / 40.0) * value}
    whole = days.select("date", "trading_value", "return_1d", *[v.alias(f"{k}_net_purchase") for k, v in flows.items()])
    found = frame.participant_signals(whole, ("foreign", "institution", "pension"))
    return rounded(found.select("channel", "date", "percentile", "state", "quality", "training_count", "trade_eligible", "expected_flow"), 7)


def l4_relative_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against a foreign price times a rate, each the last strictly before the day: ratios from 100, spread, logarithm, drawdown, every fifth of the last 756 and the last."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / (F.lit(100.0) * F.count("*"))
    rate = 1000 + F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / F.count("*")
    foreign = lines.groupBy(F.to_date("l_shipdate").alias("date")).agg(cents.alias("price"), rate.alias("rate")).withColumn("m", F.lit(1))
    days = _daily(spark, sf_dir).select(F.lit(1).alias("m"), "date", "close")
    priced = asof.strictly_before(days, foreign.where(~_gap(3, 0)), by=["m"], on="date", values=["price"], stamp="price_date", rows=PART)
    both = asof.strictly_before(priced, foreign.where(~_gap(5, 2)), by=["m"], on="date", values=["rate"], stamp="rate_date", rows=PART)
    whole = both.where("price is not null and rate is not null").select("date", "close", (F.col("price") * F.col("rate")).alias("other"))
    based = scan.running(whole, [], ["date"], {"c0": ("first", "close"), "o0": ("first", "other")}, rows=PART)
    ratios = based.select("date", (100 * F.col("close") / F.col("c0")).alias("own"), (100 * F.col("other") / F.col("o0")).alias("foreign")).withColumn("relative", F.col("own") / F.col("foreign"))
    falls = scan.framed(ratios, [], ["date"], {"top": lambda w: F.max("relative").over(w.rowsBetween(-251, 0))}, preceding=251, rows=PART)
    placed = scan.positions(falls, [], ["date"], rows=PART)
    last = placed.agg(F.max("position").alias("last"))
    back = F.col("last") - F.col("position")
    first = F.greatest(F.lit(0), F.col("last") - 755)
    kept = placed.crossJoin(F.broadcast(last)).where((back < 756) & (((F.col("position") - first) % 5 == 0) | (back == 0)))  # one row
    return kept.select("date", F.round("own", 6).alias("own"), F.round("foreign", 6).alias("foreign"), F.round(F.col("own") - F.col("foreign"), 6).alias("spread"), F.round(F.ln("relative"), 8).alias("log_relative"), F.round(F.col("relative") / F.col("top") - 1, 8).alias("drawdown"))


def m3_m4_moving_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows of two months, each against the history up to the session before it; some come late, after a gap, or with another close before them."""
    daily = _daily(spark, sf_dir)
    observed = market.observations(daily)
    fitted = regression.rolling_signals(observed).where("date >= date'2001-06-01' and alpha is not null").select("channel", "date", "alpha", "beta", "residuals")
    # The fit of a day rests on the sessions before it; so do its closes.
    past = {"last_date": lambda w: F.lag("date").over(w), "closes": lambda w: F.collect_list("close").over(w.rowsBetween(-251, -1))}
    known = scan.framed(daily.where("date >= date'2000-06-01'").select("date", "close"), [], ["date"], past, preceding=251, rows=PART).where("date >= date'2001-06-01'")
    fits = landing.stored(fitted.join(known.select("date", "last_date", "closes"), "date"), "fits")
    day = F.dayofmonth("date")
    late = F.when(day % 9 == 0, " 07:10:00").otherwise(" 06:45:00")
    before = known.select("date", F.when(day % 7 == 0, F.date_sub("last_date", 1)).otherwise(F.col("last_date")).alias("previous_date"), (F.element_at("closes", -1) * F.when(day % 5 == 0, 1.02).otherwise(1.001)).alias("previous_close"))
    rows = observed.join(before, "date").select("channel", "date", F.to_timestamp(F.concat(F.col("date").cast("string"), late)).alias("observed_at"), "close", "previous_date", "previous_close", "flow_share")
    base = f"{landing.shared_folder(spark)}/fluxlens/live-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    live.stream_scores(spark, f"{base}/in", fits, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("channel", "date", "phase", *[F.round(c, 6).alias(c) for c in ("return_1d", "percentile", "disparity50", "mdd252")])


def b19_public_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published numbers: rounded to ten digits, null where they aren't finite."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    value = F.when(q % 10 == 0, float("nan")).when(q % 10 == 1, float("inf")).when(q % 10 == 2, float("-inf")).when(q % 10 != 3, p / (q * 64))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", states.public_number(value).alias("value"))


def c10_exposure_and_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a fund on the days that have an exposure: the share of the twenty sessions before that were in fear."""
    found = selection.rolling_signals(market.observations(_daily(spark, sf_dir))).where("channel = 'main' and percentile is not null")
    held = F.col("state").isin("fear", "extreme_fear").cast("double")
    share = {"exposure": lambda w: F.when(F.count("state").over(w.rowsBetween(-20, -1)) == 20, F.avg(held).over(w.rowsBetween(-20, -1)))}
    exposure = scan.framed(found.select("date", "state"), [], ["date"], share, preceding=20, rows=PART).where("exposure is not null").select("date", "exposure")
    bars = ordered._funds(spark, sf_dir).where("ticker = 'L1'").drop("ticker")
    return bars.join(exposure, "date").select("date", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), F.round("exposure", 8).alias("exposure"))


def d15_focus_and_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By channel, at a setting of its own: the fit of the last day up to a focus, and how often each quality occurs."""
    lookback = 120
    found = landing.stored(selection.rolling_signals(market.observations(_daily(spark, sf_dir)), window=lookback, least=states.minimum_observations(lookback), minimum_fit=0.4, tail=3), "signals")
    names = ("alpha", "beta", "rolling_r2", "residual", "residual_z", "percentile", "training_count")
    focus = found.where("date <= date'1999-06-30'").groupBy("channel").agg(F.max_by(F.struct(*names), "date").alias("f")).select("channel", F.lit("focus").alias("part"), F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"f.{n}").cast("double"))])).alias("name", "value"))
    counts = found.groupBy("channel", "quality").agg(F.count("*").cast("double").alias("value")).select("channel", F.lit("quality").alias("part"), F.col("quality").alias("name"), "value")
    return focus.unionByName(counts).withColumn("value", F.round("value", 7))


def k9_rebuilt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rows as columns of text, a document a month, decoded and taken apart into frames again; a row for each frame."""
    funds = ordered._funds(spark, sf_dir).where("ticker <> 'IDX' and (ticker = 'L1' or date >= date'1996-01-01')")
    wide = funds.groupBy("date").agg(*[F.max(F.when(F.col("ticker") == t, F.col(c))).alias(f"p{t}{c.capitalize()}") for t in ("L1", "S1") for c in ("open", "close")])
    rows = _daily(spark, sf_dir).select("date", "close", "trading_value", F.when(F.col("ck") % 9 != 0, (F.col("ck") % 13 - 6) / 200.0).alias("flow_share")).join(wide, "date", "left")
    names, text = landing.encode_columns(rows, ["date", "close"])
    history = landing.decode_columns(text, names, {n: "date" if n == "date" else "double" for n in names})
    bars, flows, prices = landing.rebuilt(history, ["L1", "S1"])
    total = lambda df, name, *columns: df.agg(F.lit(name).alias("frame"), F.count("*").alias("rows_held"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(sum((F.sum(c) for c in columns), F.lit(0.0)), 2).alias("total"))
    kinds = [total(prices.where(F.col("ticker") == t), t, "open", "close") for t in ("L1", "S1")]
    return reduce(DataFrame.unionByName, [total(bars, "bars", "close"), total(flows, "flows", "individual_net_purchase"), *kinds])


QUERIES = {f.__name__: f for f in (a12_source_by_fund, k3_combined_check, b19_public_numbers, b20_finite_fields, b21_cutoff_in_zone, c10_exposure_and_bars, d12_participant_signals, d15_focus_and_histogram, k9_rebuilt_frames, l4_relative_as_of, m3_m4_moving_history)}

SQL = {
    "b19_public_numbers": """select l_orderkey, l_linenumber, case when l_quantity % 10 > 3 then round(l_extendedprice / (l_quantity * 64), 10) end as value from lineitem""",
    "c10_exposure_and_bars": """, e as (select date, case when count(*) over w = 20 then avg(case when state in ('fear', 'extreme_fear') then 1e0 else 0e0 end) over w end as exposure from states where channel = 'main' and percentile is not null window w as (order by date rows between 20 preceding and 1 preceding))
        select f.date, round(f.open, 6) as open, round(f.close, 6) as close, round(exposure, 8) as exposure from funds f join e on e.date = f.date where ticker = 'L1' and exposure is not null""",
    "d15_focus_and_histogram": ", focus_obs as (select * from obs" + signals_sql("focus_obs", "_d", window=120, least=96, fit="4e-1", tail=3) + """), l as (select channel, max(date) as d from signals_d where date <= date '1999-06-30' group by channel), f as (select s.* from signals_d s join l on l.channel = s.channel and l.d = s.date)
        """ + " union all ".join(f"select channel, 'focus' as part, '{n}' as name, round({n}, 7) as value from f" for n in ("alpha", "beta", "rolling_r2", "residual", "residual_z", "percentile", "training_count")) + " union all select channel, 'quality', quality, cast(count(*) as double) from signals_d group by channel, quality",
    "k9_rebuilt_frames": """select 'bars' as frame, count(*) as rows_held, min(date) as first_date, max(date) as last_date, round(sum(round(close, 8)), 2) as total from daily
        union all select 'flows', count(*), min(date), max(date), round(sum(round((ck % 13 - 6) / 2e2, 8) * round(trading_value, 8)), 2) from daily where ck % 9 <> 0
        union all select ticker, count(*), min(date), max(date), round(sum(round(open, 8)) + sum(round(close, 8)), 2) from funds where ticker = 'L1' or (ticker = 'S1' and date >= date '1996-01-01') group by ticker""",
    "a12_source_by_fund": """select t as ticker, s as source, r as reason, n as sessions, round(c, 6) as last_close from (
        select 'IDX' as t, 'history' as s, cast(null as varchar) as r, count(*) as n, arg_max(close, date) as c from funds where ticker = 'IDX'
        union all select 'L1', 'history', null, count(*), arg_max(close, date) from funds where ticker = 'L1'
        union all select 'S1', 'recent', 'provider_disagreement', count(*), arg_max(close, date) from funds where ticker = 'S1' and date >= date '2001-06-01'
        union all select 'X1', 'recent', 'history_unavailable', count(*), arg_max(close, date) from funds where ticker = 'IDX' and date >= date '2001-06-01'
        union all select 'X9', 'none', 'history_unavailable', 0, null) x""",
    "k3_combined_check": """, a as (select ticker, date + 1 as date, close from funds where date + 1 <= date '1999-06-30'),
        b as (select ticker, date + 1 as date, close * case ticker when 'S1' then 101e-2 else 1001e-3 end as close from funds where date + 1 <= date '1999-06-30' and (date - date '1995-01-01') % 19 <> 7 and (ticker <> 'L1' or date < date '1999-06-28')),
        c as (select a.ticker, a.date, a.close as x, b.close as y, row_number() over (partition by a.ticker order by a.date) - 1 as place, count(*) over (partition by a.ticker) as n from a join b on b.ticker = a.ticker and b.date = a.date),
        spots as (select distinct ticker, round_even(i * (n - 1) / 5e0, 0) as place from c cross join (select unnest(range(0, 6)) as i) g),
        marks as (select c.ticker, count(*) as anchors, count_if(abs(x / y - 1) > 5e-3) as mismatches, max(abs(x / y - 1)) as widest from c join spots s on s.ticker = c.ticker and s.place = c.place group by c.ticker),
        ends as (select ticker, max(date) as last_a, arg_max(close, date) as close_a, (select max(b.date) from b where b.ticker = a.ticker) as last_b from a group by ticker)
        select e.ticker, last_a as date, round(abs(close_a - b.close) / close_a, 8) as gap, case when last_a <> date '1999-06-30' or b.close is null then 'unavailable' when abs(close_a - b.close) / close_a <= 5e-3 then 'ok' else 'mismatch' end as state,
        case when last_a = last_b then anchors else 0 end as anchors, case when last_a = last_b then mismatches else 0 end as mismatches, round(case when last_a = last_b then widest end, 8) as anchor_gap,
        case when last_a <> last_b then 'unavailable' when mismatches > 0 then 'mismatch' else 'ok' end as anchor_state, case when last_a <> last_b then 'expected_date_not_common' when mismatches > 0 then 'historical_anchor_difference_exceeded' end as anchor_reason
        from ends e left join b on b.ticker = e.ticker and b.date = e.last_a left join marks m on m.ticker = e.ticker""",
    "b20_finite_fields": """select date, round(close, 6) as value from daily where ck % 10 <> 0 and ck % 7 <> 0 and ck % 13 <> 0 and ck % 11 <> 0 and date <= date '2000-12-31'""",
    "b21_cutoff_in_zone": """select event_id, cast(ts + interval 9 hour as date) as day from events where cast(ts + interval 9 hour as date) <= date '2024-01-09'""",
    "d12_participant_signals": """, parts as (select 'foreign' as channel, date, return_1d, (-5e-1 * coalesce(return_1d, 0e0) + (ck % 7 - 3) / 3e2) * trading_value / trading_value as flow_share from daily
        union all select 'institution', date, return_1d, (2e-1 * coalesce(return_1d, 0e0) + (ck % 11 - 5) / 4e1) * trading_value / trading_value from daily""" + signals_sql("parts", "_q") + """)
        select p.channel, p.date, round(percentile, 7) as percentile, coalesce(state, 'unavailable') as state, coalesce(quality, 'missing') as quality, coalesce(training_count, 0) as training_count, coalesce(trade_eligible, false) as trade_eligible,
        round(q.flow_share - q.residual, 7) as expected_flow from parts p left join signals_q q on q.channel = p.channel and q.date = p.date""",
    "l4_relative_as_of": """, f as (select cast(l_shipdate as date) as date, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) / (1e2 * count(*)) as price, 1000 + cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) / (1e0 * count(*)) as rate from lineitem group by 1),
        p as (select * from f where ((date - date '1995-01-01') % 3 + 3) % 3 <> 0), q as (select * from f where (((date - date '1995-01-01') % 5) + 5) % 5 <> 2),
        w as (select m.date, m.close, p.price * q.rate as other from market m asof join p on m.date > p.date asof join q on m.date > q.date),
        r as (select date, 100 * close / first_value(close) over (order by date) as own, 100 * other / first_value(other) over (order by date) as f100, row_number() over (order by date) - 1 as k, count(*) over () - 1 as last from w),
        d as (select *, own / f100 as rel, max(own / f100) over (order by date rows between 251 preceding and current row) as top from r)
        select date, round(own, 6) as own, round(f100, 6) as "foreign", round(own - f100, 6) as spread, round(ln(rel), 8) as log_relative, round(rel / top - 1, 8) as drawdown from d where last - k < 756 and ((k - greatest(0, last - 755)) % 5 = 0 or k = last)""",
    "m3_m4_moving_history": """, c as (select date, close, return_1d, lag(date) over (order by date) as before, 1e2 * close / avg(close) over (order by date rows between 49 preceding and current row) as disparity50,
          close / max(close) over (order by date rows between 251 preceding and current row) - 1 as mdd252 from daily),
        t as (select s.channel, s.date, c.return_1d, s.percentile, disparity50, mdd252, case when day(s.date) % 9 = 0 then 'outside_window' when day(s.date) % 7 = 0 then 'session_gap' when day(s.date) % 5 = 0 then 'discontinuous' else 'provisional' end as phase
          from states s join c on c.date = s.date where s.date >= date '2001-06-01' and s.alpha is not null)
        select channel, date, phase, """ + ", ".join(f"round(case when phase = 'provisional' then {c} end, 6) as {c}" for c in ("return_1d", "percentile", "disparity50", "mdd252")) + " from t",
}
