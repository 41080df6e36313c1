"""Queries over the DataFrame operators: fits, studies, simulations, repairs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxlens.functions import states
from fluxlens.operators import asof, events, reconcile, regression, selection
from fluxlens.sources import landing, market
from fluxlens.streaming import live


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_daily(_orders(spark, sf_dir))


def _shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.to_date("l_shipdate").alias("date")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / (F.lit(100.0) * F.count("*"))).alias("price"))


def _signals(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return selection.rolling_signals(market.observations(_daily(spark, sf_dir)), **options)


def latest_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty sessions of each channel, scored against their past."""
    found = _signals(spark, sf_dir)
    last = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("date")))
    rounded = [F.round(f.name, 8).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in found.schema.fields]
    return found.withColumn("back", last).where("back <= 20").select(*rounded)


#: Sessions of a part of a daily line: few, so that these lines of some thousands have several.
PART = 512


def c2_strict_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _daily(spark, sf_dir).select(F.lit(1).alias("m"), "date")
    right = _shipping(spark, sf_dir).select(F.lit(1).alias("m"), "date", "price")
    found = asof.strictly_before(left, right, by=["m"], on="date", values=["price"], stamp="price_date", rows=PART)
    return found.select("date", "price_date", F.round("price", 8).alias("price"))


def c9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, known = _shipping(spark, sf_dir), _daily(spark, sf_dir)
    lone = days.join(known, "date", "left_anti").select(F.lit(1).alias("m"), "date")
    found = asof.neighbours(lone, known.select(F.lit(1).alias("m"), "date", "close"), by=["m"], on="date", values=["close"], rows=PART)
    return found.select("date", F.round("before.close", 8).alias("close_before"), F.round("after.close", 8).alias("close_after"))


def e9_state_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of the last training residuals at the bounds of the states."""
    n = F.size("residuals")
    ordered = F.array_sort("residuals")
    low = lambda p: F.get(ordered, F.least(n - 1, F.floor(n * p / 100).cast("int")))
    high = lambda p: F.get(ordered, F.greatest(F.lit(0), (F.ceil(n * p / 100) - 1).cast("int")))
    last = regression.rolling_signals(market.observations(_daily(spark, sf_dir))).where("percentile is not null").groupBy("channel").agg(F.max_by("residuals", "date").alias("residuals"))
    return last.select("channel", *[F.round(f(p), 8).alias(f"at_{p}") for f, p in ((low, 5), (low, 20), (high, 80), (high, 95))])


def b13_b15_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _signals(spark, sf_dir).select("channel", "date", "state", "trade_eligible")
    a, b = (found.where(F.col("channel") == c).select("date", F.col("state").alias(f"{c}_state"), F.col("trade_eligible").alias(f"{c}_eligible")) for c in ("main", "noisy"))
    both = a.join(b, "date")
    s, e, t, f = (F.col(c) for c in ("main_state", "main_eligible", "noisy_state", "noisy_eligible"))
    x, y = states.trigger(s, e), states.trigger(t, f)
    return both.select("date", states.agreed_direction(s, t).alias("direction"), states.agreed_trigger(x, y).alias("trigger"), x.alias("scaled_trigger"), y.alias("raw_trigger"), states.confidence(s, e, t, f).alias("confidence"))


def i2_non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.non_overlapping(events.extreme_entries(_signals(spark, sf_dir)), 20)
    return found.select("channel", "date", "state", F.col("position").cast("bigint").alias("position"))


def _two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Official prices, and an adjusted history that lacks a session in nineteen."""
    official = market.prices(_daily(spark, sf_dir)).where("ticker in ('L1', 'S1')")
    gone = F.pmod(F.datediff("date", F.lit("1995-01-01")), F.lit(19)) == 7
    adjusted = official.where(~gone | (F.col("date") < "1995-02-01")).select("ticker", "date", (F.col("open") * 0.5).alias("open"), (F.col("close") * 0.5).alias("close"))
    return official, adjusted


def k3_k4_latest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    official, adjusted = _two_sources(spark, sf_dir)
    found = reconcile.latest_close(official, adjusted)
    return found.select("ticker", "date", F.round("gap", 8).alias("gap"), "state")


def k5_gap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.repair_gaps(*_two_sources(spark, sf_dir))
    return found.select("ticker", "date", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), "filled")


def k9_k12_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir).select("date", "close")
    recent = daily.where("date >= date'2001-01-01'").withColumn("close", F.col("close") + 1)
    return reconcile.upsert(daily, recent, ["date"]).select("date", F.round("close", 8).alias("close"))


def a16_a17_columnar_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as arrays under hoisted column names, written as JSON text, a document a month, and decoded again."""
    names, rows = landing.encode_columns(_daily(spark, sf_dir).select("close", "trading_value", "date"), ["date", "close"])
    columns = F.array(*[F.lit(n) for n in names]).alias("seriesColumns")
    documents = rows.groupBy(F.substring(F.get("row", F.lit(0)), 1, 7).alias("month")).agg(F.to_json(F.struct(columns, F.collect_list("row").alias("rows"))).alias("document"))
    read = documents.select(F.from_json("document", "seriesColumns array<string>, rows array<array<string>>").alias("d")).where(F.col("d.seriesColumns") == columns)
    return landing.decode_columns(read.select(F.explode("d.rows").alias("row")), names, {"date": "date", "close": "double", "trading_value": "double"})


def m1_m4_live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional rows of the last sessions, streamed from files against the fit of the history before them."""
    cut = "2001-07-01"
    daily = _daily(spark, sf_dir)
    whole = Window.partitionBy(F.lit(1)).orderBy("date")
    observed = market.observations(daily)
    history = observed.where(F.col("date") < cut)
    # The fit that a next session would be scored with.
    after = history.select("channel").distinct().select("channel", F.lit(cut).cast("date").alias("date"), F.lit(0.0).alias("return_1d"), F.lit(0.0).alias("flow_share"))
    fitted = regression.rolling_signals(history.select("channel", "date", "return_1d", "flow_share").unionByName(after)).where(F.col("date") == cut).select("channel", "alpha", "beta", "residuals")
    closes = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]), -251, 251)
    past = daily.where(F.col("date") < cut).agg(F.max("date").alias("last_date"), closes.alias("closes"))
    before = daily.select("date", F.lag("date").over(whole).alias("previous_date"), F.lag("close").over(whole).alias("previous_close"))
    rows = observed.where(F.col("date") >= cut).join(before, "date").select("channel", "date", F.to_timestamp(F.concat(F.col("date").cast("string"), F.lit(" 06:45:00"))).alias("observed_at"), "close", "previous_date", "previous_close", "flow_share")
    base = f"{landing.shared_folder(spark)}/live-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    query = live.stream_scores(spark, f"{base}/in", fitted.crossJoin(F.broadcast(past)), f"{base}/out", f"{base}/state")  # one row
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("channel", "date", "phase", *[F.round(c, 6).alias(c) for c in ("return_1d", "percentile", "disparity50", "mdd252")])


QUERIES = {f.__name__: f for f in (
    latest_signals, c2_strict_as_of, c9_neighbours, e9_state_boundaries, b13_b15_agreement, i2_non_overlapping, k3_k4_latest_check, k5_gap_repair, k9_k12_upsert, a16_a17_columnar_history, m1_m4_live_scores,
)}

#: SQL of those that SQL expresses, to follow the portable adapters.
SQL = {
    "m1_m4_live_scores": """, l as (select max(date) as d from daily where date < date '2001-07-01'), f as (select min(date) as d from daily where date >= date '2001-07-01'),
        c as (select date, close, return_1d, 1e2 * close / avg(close) over (order by date rows between 49 preceding and current row) as disparity50, close / max(close) over (order by date rows between 251 preceding and current row) - 1 as mdd252 from daily)
        select s.channel, s.date, case when s.date = f.d then 'provisional' else 'session_gap' end as phase, round(case when s.date = f.d then c.return_1d end, 6) as return_1d, round(case when s.date = f.d then s.percentile end, 6) as percentile,
        round(case when s.date = f.d then disparity50 end, 6) as disparity50, round(case when s.date = f.d then mdd252 end, 6) as mdd252 from states s join c on c.date = s.date cross join f where s.date >= f.d""",
    "latest_signals": """, l as (select *, row_number() over (partition by channel order by date desc) as back from states)
        select channel, date, round(return_1d, 8) as return_1d, round(flow_share, 8) as flow_share, training_count, round(alpha, 8) as alpha, round(beta, 8) as beta, round(rolling_r2, 8) as rolling_r2, round(residual, 8) as residual,
        round(residual_z, 8) as residual_z, round(percentile, 8) as percentile, state, quality, trade_eligible from l where back <= 20""",
    "c2_strict_as_of": """select m.date, s.date as price_date, round(s.price, 8) as price from market m asof left join shipping s on m.date > s.date""",
    "c9_neighbours": """, lone as (select date from shipping where date not in (select date from market))
        select l.date, round(b.close, 8) as close_before, round(a.close, 8) as close_after from lone l asof left join market b on l.date > b.date asof left join market a on l.date < a.date""",
    "e9_state_boundaries": """, last as (select channel, max_by(res, date) as res from valid where good group by channel), o as (select channel, list_sort(res) as r, len(res) as n from last)
        select channel, round(r[least(n - 1, cast(floor(n * 5 / 1e2) as int)) + 1], 8) as at_5, round(r[least(n - 1, cast(floor(n * 20 / 1e2) as int)) + 1], 8) as at_20,
        round(r[greatest(0, cast(ceil(n * 80 / 1e2) as int) - 1) + 1], 8) as at_80, round(r[greatest(0, cast(ceil(n * 95 / 1e2) as int) - 1) + 1], 8) as at_95 from o""",
    "b13_b15_agreement": """, t as (select channel, date, state, trade_eligible, case when state = 'unavailable' or not trade_eligible then 'unavailable' when state in ('extreme_fear', 'extreme_greed') then state else 'none' end as trig,
          case when state in ('fear', 'extreme_fear') then 'fear' when state in ('greed', 'extreme_greed') then 'greed' else 'neutral' end as dir from states),
        j as (select a.date, a.state as sa, b.state as sb, a.trade_eligible as ea, b.trade_eligible as eb, a.trig as scaled_trigger, b.trig as raw_trigger,
          case when a.state = 'unavailable' or b.state = 'unavailable' then 'unavailable' when a.dir = b.dir then 'agree' else 'mixed' end as direction,
          case when a.trig = 'unavailable' or b.trig = 'unavailable' then 'unavailable' when a.trig = b.trig then case when a.trig = 'none' then 'neither' else 'both' end
               when a.trig = 'none' then 'raw_only' when b.trig = 'none' then 'scaled_only' else 'conflict' end as trigger
          from t a join t b on a.date = b.date and a.channel = 'main' and b.channel = 'noisy')
        select date, direction, trigger, scaled_trigger, raw_trigger, case when sa = 'unavailable' then 'unavailable' when not ea then 'low_model_fit' when sb = 'unavailable' or not eb then 'scaled_only'
          when direction <> 'agree' then 'mixed' when trigger in ('scaled_only', 'raw_only', 'conflict') then 'mixed_trigger' else 'high' end as confidence from j""",
    "i2_non_overlapping": """, e as (select channel, date, state, position, row_number() over (partition by channel order by position) as k from entries),
        walk as (select channel, list(position order by position) as ps from e group by channel),
        kept as (select channel, unnest(list_reduce(list_prepend(cast([] as bigint[]), list_transform(ps, lambda p: [cast(p as bigint)])), lambda acc, p: case when len(acc) = 0 or p[1] >= acc[-1] + 21 then list_concat(acc, p) else acc end)) as position from walk)
        select e.channel, e.date, e.state, e.position from e join kept k on k.channel = e.channel and k.position = e.position""",
    "k5_gap_repair": """, official as (select * from funds where ticker in ('L1', 'S1')), adj as (select ticker, date, open * 5e-1 as open, close * 5e-1 as close from official where date_diff('day', date '1995-01-01', date) % 19 <> 7 or date < date '1995-02-01'),
        common as (select o.ticker, o.date, a.close / o.close as factor from official o join adj a on a.ticker = o.ticker and a.date = o.date),
        gaps as (select o.* from official o where not exists (select 1 from adj a where a.ticker = o.ticker and a.date = o.date)),
        near as (select g.*, b.factor as fb, a.factor as fa from gaps g asof left join common b on g.ticker = b.ticker and g.date > b.date asof left join common a on g.ticker = a.ticker and g.date < a.date),
        done as (select *, case when abs(fb - fa) <= 5e-3 * greatest(abs(fa), abs(fb)) then (fa + fb) / 2 end as f from near),
        bad as (select distinct ticker from done where f is null)
        select ticker, date, round(open, 6) as open, round(close, 6) as close, filled from (select ticker, date, open, close, false as filled from adj union all select ticker, date, open * f, close * f, true from done) x where ticker not in (select ticker from bad)""",
    "k9_k12_upsert": """select date, round(case when date >= date '2001-01-01' then close + 1 else close end, 8) as close from daily""",
    "k3_k4_latest_check": """, l as (select ticker, max(date) as d from funds where ticker in ('L1', 'S1') group by ticker), s as (select f.ticker, f.date, f.close as a, case when date_diff('day', date '1995-01-01', f.date) % 19 <> 7 then f.close * 5e-1 end as b from funds f join l on l.ticker = f.ticker and l.d = f.date)
        select ticker, date, round(abs(a - b) / a, 8) as gap, case when b is null then 'unavailable' when abs(a - b) / a <= 5e-3 then 'ok' else 'mismatch' end as state from s""",
    "a16_a17_columnar_history": """select date, round(close, 8) as close, round(trading_value, 8) as trading_value from daily""",
}
