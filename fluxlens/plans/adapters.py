"""Queries over the adapters of tables under other headers, and over statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.functions import states
from fluxlens.operators import periods, reconcile, selection, status
from fluxlens.sources import headers, market


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_daily(_table(spark, sf_dir, "orders"))


def a2_first_named_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day the first order of one of two priorities, by name without spaces."""
    orders = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderpriority")
    return headers.first_named(orders, "o_orderpriority", ["4-notspecified", "5-low"], by=["day"], order=["o_orderkey"])


def a3_last_row_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each wanted code, which is the first of three fields that isn't blank."""
    n = F.col("l_linenumber")
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"),
        F.when(n % 3 == 0, F.concat(F.lit(" S"), "l_suppkey")).alias("a"), F.when(n % 3 == 1, F.lit("  ")).otherwise(F.concat(F.lit("P"), F.col("l_partkey") % 50)).alias("b"), F.concat(F.lit("L"), n.cast("string")).alias("c"))
    wanted = _table(spark, sf_dir, "supplier").where("s_nationkey < 10").select(F.concat(F.lit("S"), "s_suppkey").alias("code"))
    wanted = wanted.unionByName(spark.createDataFrame([("L1",), ("L4",), ("P7",), ("none",)], "code string"))
    return headers.last_per_code(lines, ["a", "b", "c"], wanted, order=["day", "l_orderkey", "l_linenumber"]).select("code", "day", "l_orderkey", "l_linenumber")


def a8_a9_participant_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows under the headers of their source, as text; of three participants the second goes by its other name and the third is absent."""
    ck = F.col("ck")
    raw = _daily(spark, sf_dir).select(
        F.when(ck % 17 == 0, F.lit("휴장")).otherwise(F.date_format("date", "yyyyMMdd")).alias("날짜"),
        F.when(ck % 11 == 0, F.lit("-")).otherwise(F.concat(F.lit(" "), (ck % 1000).cast("string"), F.lit(",000"))).alias("개인"), F.when(ck % 5 == 0, F.lit("n/a")).otherwise((-ck).cast("string")).alias("외국인"))
    aliases = {"date": ("날짜", "date"), "individual_net_purchase": ("개인",), "foreigner_net_purchase": ("외국인합계", "외국인"), "institutional_net_purchase": ("기관합계",)}
    named = headers.aliased(raw, aliases, required=["date", "individual_net_purchase"])
    return headers.once(headers.typed_flows(named), ["date"])


def a13_source_by_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each small part its returned lines as history, unless the recent lines disagree on their last day."""
    unit = F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity"), 0)
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("date"), unit.alias("close"), "l_returnflag", (F.col("l_partkey") % 4).alias("k"))
    priced = lambda df: df.groupBy("ticker", "date").agg(F.max("close").alias("close"))
    history = priced(lines.where("k <> 3").withColumn("close", F.when(F.col("k") == 2, F.col("close") * 2).otherwise(F.col("close"))))
    recent = priced(lines.where("date >= date'1998-06-01'"))
    expected = _table(spark, sf_dir, "part").where("p_size <= 5").select(F.col("p_partkey").cast("string").alias("ticker"))
    return reconcile.chosen_source(history, recent, expected)[1]


def b24_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    y, m, d = (F.lpad(x.cast("string"), n, "0") for x, n in ((1990 + key % 12, 4), (key % 14, 2), (key % 33, 2)))
    text = F.when(key % 9 == 0, F.concat(y, m, d)).when(key % 9 == 1, F.concat(F.lit(" "), y, F.lit("-"), m, F.lit("-"), d)).when(key % 9 == 2, F.concat_ws("-", y, m, d, F.lit("T00"))).when(key % 9 == 3, F.concat_ws("-", F.lit("0000"), m, d))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", text.otherwise(F.concat_ws("-", y, m, d)).alias("text"))
    return orders.select("o_orderkey", states.iso_date(F.col("text")).alias("day"))


#: Messages of failures, as providers write them.
MESSAGES = (
    " provider_failed ", "Another refresh is running", "KRX_API_KEY is not configured", "KRX login credentials are not configured", "bad Credential", "proxy not configured", "KRX Open API: HTTP 503", "PyKRX changed", "yfinance: no rows", "disk full",
)


def b30_public_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = F.array(*[F.lit(m) for m in MESSAGES])
    events = _table(spark, sf_dir, "events").select("event_id", F.concat(F.get(messages, F.pmod(F.col("event_id"), F.lit(len(MESSAGES))).cast("int")), F.when(F.col("event_id") % 3 == 0, "\n").otherwise("")).alias("message"))
    return events.select("event_id", status.public_reason(F.col("message")).alias("reason"))


def c15_c17_filled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with eligibility, position and state from the first source that has them."""
    daily = _daily(spark, sf_dir).select("date", "ck")
    signals = selection.rolling_signals(market.observations(_daily(spark, sf_dir)))
    own = signals.where("channel = 'main'").select("date", "state", F.col("trade_eligible").alias("eligible"))
    verified = signals.where("channel = 'noisy' and trade_eligible").select("date", "state")
    ledger = daily.where("ck % 3 = 0").select("date", F.when(F.col("ck") % 2 == 0, "long").alias("position"))
    benchmark = daily.where("ck % 5 <> 0").select("date", F.lit("held").alias("position"))
    base = daily.select("date").join(own, "date", "left")
    with_state = status.filled(base, [verified], ["state"], defaults={"state": "none"})
    with_position = status.filled(with_state, [ledger, benchmark], ["position"], defaults={"position": "cash"})
    return status.filled(with_position, [], ["eligible"], defaults={"eligible": False})


def d14_flow_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ck, value = F.col("ck"), F.col("trading_value")
    flows = _daily(spark, sf_dir).select("date", value.alias("individual_net_purchase"), F.when(ck % 100 == 0, value).alias("foreigner_net_purchase"), F.when(ck < 0, value).otherwise(float("nan")).alias("pension_net_purchase"))
    return headers.channels(flows)


def e15_reproduced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs counted from days in the market, against figures that are right, off by a trade, or off in exposure."""
    signals = selection.rolling_signals(market.observations(_daily(spark, sf_dir))).where("channel = 'main'")
    days = signals.select("date", F.when(F.col("state").isin("fear", "extreme_fear"), "long").otherwise("cash").alias("position"))
    names = spark.createDataFrame([("right", 0, 0.0), ("one_more", 1, 0.0), ("exposed", 0, 0.01)], "scenario_id string, more int, off double")
    sessions = days.crossJoin(F.broadcast(names.select("scenario_id")))  # three rows
    totals = days.agg(F.avg((F.col("position") == "long").cast("double")).alias("exposure"), F.max_by("position", "date").alias("last"))
    runs = status.reproduced(days.withColumn("scenario_id", F.lit("x")), totals.select(F.lit("x").alias("scenario_id"), "exposure", F.lit(0).alias("trades"), F.lit(False).alias("is_open"))).select("runs")
    is_open = F.col("last") == "long"
    reported = names.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(runs)).select("scenario_id", (F.col("exposure") + F.col("off")).alias("exposure"), (F.col("runs") - is_open.cast("int") + F.col("more")).alias("trades"), is_open.alias("is_open"))  # one row each
    return status.reproduced(sessions, reported).select("scenario_id", F.round("counted_exposure", 8).alias("counted_exposure"), "runs", "state")


def k14_status_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    ck, day = F.col("ck"), F.col("date")
    prior = _daily(spark, sf_dir).select(
        "date", "ck", F.when(ck % 7 != 0, day).alias("data_as_of"), F.when(ck % 3 == 0, F.date_add(day, 2)).when(ck % 3 == 1, F.date_sub(day, 1)).alias("known_expected"), F.when(ck % 2 == 0, False).when(ck % 5 == 0, True).alias("known_fresh"),
        F.when(ck % 4 == 0, F.array(F.lit("disk"), F.lit("yfinance_unavailable"))).alias("reasons"))
    found = status.after_failure(prior, F.when(ck % 6 == 0, F.lit("YFinance down")).otherwise(F.lit("disk")), F.when(ck % 11 == 0, F.date_add(day, 1)))
    return found.select("date", "state", F.array_join("reasons", ",").alias("reasons"), "known_expected", "known_fresh")


def b22_evaluation_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer asks for a period of its nation's sessions, the days on which orders are placed there."""
    customers, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    k, kinds = F.col("c_custkey"), (*periods.KINDS, "2w")
    window = F.element_at(F.array(*map(F.lit, kinds)), (k % len(kinds)).cast("int") + 1)
    end = F.when(k % 5 != 0, F.date_add(F.lit("1994-06-01").cast("date"), (k * 37 % 3400).cast("int")))
    start = F.when(k % 7 != 0, F.date_add(F.lit("1996-01-01").cast("date"), (k * 53 % 1500).cast("int") - 300))
    requests = customers.select(k, F.when(k % 31 != 0, F.col("c_nationkey")).alias("nation"), window.alias("window"), F.when(k % 3 == 0, "fixed").when(k % 3 == 1, "latest").alias("end_mode"), start.alias("start"), end.alias("end"))
    sessions = orders.join(customers, F.col("o_custkey") == k).select(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("date"))
    return periods.resolved(requests, sessions, key="c_custkey", market="nation")


QUERIES = {f.__name__: f for f in (
    b22_evaluation_periods,
    a2_first_named_row, a3_last_row_of_code, a8_a9_participant_flows, a13_source_by_stock, b24_iso_dates, b30_public_reasons, c15_c17_filled_rows, d14_flow_channels, e15_reproduced_runs, k14_status_after_failure,
)}

_TEXT = "case o_orderkey % 9 when 0 then y || m || d when 1 then ' ' || y || '-' || m || '-' || d when 2 then y || '-' || m || '-' || d || '-T00' when 3 then '0000-' || m || '-' || d else y || '-' || m || '-' || d end"

SQL = {
    "b22_evaluation_periods": """, s as (select distinct c_nationkey as nation, cast(o_orderdate as date) as date from orders join customer on c_custkey = o_custkey), l as (select nation, max(date) as latest from s group by nation),
        r as (select c_custkey, case when c_custkey % 31 <> 0 then c_nationkey end as nation, (['all', 'custom', 'ytd', '1m', '3m', '6m', '1y', '3y', '2w'])[c_custkey % 9 + 1] as win, c_custkey % 3 = 0 as fixed,
          case when c_custkey % 7 <> 0 then date '1996-01-01' + cast(c_custkey * 53 % 1500 - 300 as integer) end as own_start, case when c_custkey % 5 <> 0 then date '1994-06-01' + cast(c_custkey * 37 % 3400 as integer) end as own_end from customer),
        e as (select r.*, latest, case when latest is null then 'no_sessions' when win = '2w' or (win = 'custom' and own_start is null) or (fixed and own_end is null) then 'invalid' end as refused,
          case when (fixed or win = 'custom') and own_end < latest then own_end else latest end as until from r left join l on l.nation = r.nation),
        p as (select *, case win when 'custom' then own_start when 'ytd' then cast(date_trunc('year', until) as date) when '1m' then cast(until - interval 1 month as date) when '3m' then cast(until - interval 3 month as date)
          when '6m' then cast(until - interval 6 month as date) when '1y' then cast(until - interval 1 year as date) when '3y' then cast(until - interval 3 year as date) end as since from e)
        select c_custkey, p.nation, any_value(case when refused is null then since end) as "start", any_value(case when refused is null then until end) as "end", min(s.date) as first_session, max(s.date) as last_session,
          case when any_value(refused) is null then count(s.date) end as sessions, coalesce(any_value(refused), case when count(s.date) > 0 then 'ok' else 'empty' end) as state
        from p left join s on s.nation = p.nation and p.refused is null and (p.since is null or s.date >= p.since) and s.date <= p.until group by c_custkey, p.nation""",
    "a2_first_named_row": """select day, o_orderkey, o_orderpriority from (select cast(o_orderdate as date) as day, o_orderkey, o_orderpriority, row_number() over (partition by cast(o_orderdate as date) order by o_orderkey) as k
        from orders where lower(replace(o_orderpriority, ' ', '')) in ('4-notspecified', '5-low')) x where k = 1""",
    "a3_last_row_of_code": """, coded as (select case when l_linenumber % 3 = 0 then 'S' || l_suppkey when l_linenumber % 3 <> 1 then 'P' || (l_partkey % 50) else 'L' || l_linenumber end as code, cast(l_shipdate as date) as day, l_orderkey, l_linenumber from lineitem),
        placed as (select *, row_number() over (partition by code order by day desc, l_orderkey desc, l_linenumber desc) as k from coded where code in ('L1', 'L4', 'P7') or code in (select 'S' || s_suppkey from supplier where s_nationkey < 10))
        select code, day, l_orderkey, l_linenumber from placed where k = 1""",
    "a8_a9_participant_flows": """select date, cast(ck % 1000 as double) * 1000 as individual_net_purchase, case when ck % 5 <> 0 then cast(-ck as double) end as foreigner_net_purchase from daily where ck % 17 <> 0 and ck % 11 <> 0""",
    "a13_source_by_stock": """, l as (select cast(l_partkey as varchar) as ticker, cast(l_shipdate as date) as date, round(l_extendedprice * 100 / l_quantity, 0) as close, l_partkey % 4 as k from lineitem),
        h as (select ticker, date, max(case when k = 2 then close * 2 else close end) as close from l where k <> 3 group by ticker, date), r as (select ticker, date, max(close) as close from l where date >= date '1998-06-01' group by ticker, date),
        e as (select cast(p_partkey as varchar) as ticker from part where p_size <= 5), n as (select ticker, max(date) as d, arg_max(close, date) as c from r group by ticker),
        t as (select e.ticker, exists (select 1 from h where h.ticker = e.ticker) as old, n.d is not null as new, coalesce(abs(n.c - h2.close) / abs(n.c) <= 5e-3, false) as same from e left join n on n.ticker = e.ticker left join h h2 on h2.ticker = e.ticker and h2.date = n.d)
        select ticker, case when not old and not new then 'none' when not old or (new and not same) then 'recent' else 'history' end as source, case when not old then 'history_unavailable' when new and not same then 'provider_disagreement' end as reason from t""",
    "b24_iso_dates": f""", p as (select o_orderkey, lpad(cast(1990 + o_orderkey % 12 as varchar), 4, '0') as y, lpad(cast(o_orderkey % 14 as varchar), 2, '0') as m, lpad(cast(o_orderkey % 33 as varchar), 2, '0') as d from orders), t as (select o_orderkey, {_TEXT} as text from p)
        select o_orderkey, case when regexp_full_match(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and text[1:4] <> '0000' then try_cast(text as date) end as day from t""",
    "b30_public_reasons": """select event_id, case event_id % 10 when 0 then 'provider_failed' when 1 then 'refresh_already_running' when 2 then 'krx_open_api_key_missing' when 3 then 'krx_login_credentials_missing' when 4 then 'krx_credentials_missing'
        when 5 then 'krx_credentials_missing' when 6 then 'krx_open_api_unavailable' when 7 then 'authenticated_pykrx_unavailable' when 8 then 'yfinance_unavailable' else 'refresh_provider_failed' end as reason from events""",
    "c15_c17_filled_rows": """select d.date, coalesce(n.state, m.state, 'none') as state, coalesce(case when ck % 3 = 0 and ck % 2 = 0 then 'long' end, case when ck % 5 <> 0 then 'held' end, 'cash') as position, coalesce(m.trade_eligible, false) as eligible
        from daily d left join states m on m.channel = 'main' and m.date = d.date left join states n on n.channel = 'noisy' and n.trade_eligible and n.date = d.date""",
    "d14_flow_channels": """, n as (select count(*) as a, count_if(ck % 100 = 0) as b from daily) select 'individual' as channel, a as days, case when a >= 200 then 'active' else 'collecting' end as status from n
        union all select 'foreigner', cast(b as bigint), case when b >= 200 then 'active' when b > 0 then 'collecting' else 'planned' end from n union all select 'pension', 0, 'planned' from n""",
    "e15_reproduced_runs": """, d as (select date, state in ('fear', 'extreme_fear') as held from states where channel = 'main'), r as (select *, held and not coalesce(lag(held) over (order by date), false) as starts from d),
        t as (select avg(case when held then 1e0 else 0e0 end) as x, cast(count_if(starts) as bigint) as runs from r)
        select s as scenario_id, round(x, 8) as counted_exposure, runs, st as state from t cross join (values ('right', 'ok'), ('one_more', 'trades_differ'), ('exposed', 'exposure_differs')) v(s, st)""",
    "k14_status_after_failure": """, p as (select date, ck, case when ck % 7 <> 0 then date end as data_as_of, case when ck % 3 = 0 then date + 2 when ck % 3 = 1 then date - 1 end as known_expected, case when ck % 2 = 0 then false when ck % 5 = 0 then true end as known_fresh,
          case when ck % 4 = 0 then 'disk,yfinance_unavailable' when ck % 6 = 0 then 'yfinance_unavailable' else 'disk' end as reasons from daily),
        e as (select *, greatest(case when ck % 11 = 0 then date + 1 end, case when known_fresh = false then known_expected end) as effective from p)
        select date, case when coalesce(effective > data_as_of, false) then 'stale' else 'degraded' end as state, reasons, cast(case when coalesce(effective > data_as_of, false) then effective else known_expected end as date) as known_expected,
        case when coalesce(effective > data_as_of, false) then false else known_fresh end as known_fresh from e""",
}
