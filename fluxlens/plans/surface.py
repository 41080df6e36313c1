"""Queries over scans of landed files, contracts, calendars, parsed records, SQL functions and the session stream."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.functions import sql
from fluxlens.operators import calendars, contract, selection
from fluxlens.plans import ordered
from fluxlens.sources import dayfiles, landing, market, records, versions
from fluxlens.streaming import supersede

#: Sessions that a batch of the stream brings.
BATCH = 600


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_daily(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.to_date("l_shipdate").alias("date")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / (F.lit(100.0) * F.count("*"))).alias("price"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rolling_signals(market.observations(_daily(spark, sf_dir)))


def a7_a11_day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three funds landed as day files and scanned over a range of days, with one more that was expected and never landed."""
    path = f"{landing.shared_folder(spark)}/fluxlens/days-{uuid.uuid4().hex}"
    dayfiles.land(ordered._funds(spark, sf_dir), path)
    found = dayfiles.read(spark, path, tickers=["IDX", "L1", "S1", "X9"], digits=2)
    return found.where("date >= date'1996-03-04' and date <= date'1998-02-20'")


def a14_accepted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.accepted(_records(spark, sf_dir)).select("event_id", "k", "day")


def a14_refused_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.refused(_records(spark, sf_dir), ["event_id"])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents of several makes: other headers, numbers as text, and some that are broken."""
    kind = F.pmod(F.col("event_id"), F.lit(9))
    day = F.date_format("ts", "yyyy-MM-dd")
    made = F.when(kind == 0, F.expr("left(props, length(props) - 1)")).when(kind == 1, F.lit("[1, 2]")).when(kind == 2, F.lit(" "))
    documents = {3: '{"K": "1,%s", "일자": "%s"}', 4: '{"k": "n/a", "day": "%2$s"}', 5: '{"value": -%s}', 6: '{"k": null, "K": %s, "day": "%s"}', 7: '{"day": "2024-13-01"}', 8: '{"k": {"a": 1}, "day": "%2$s"}'}
    for k, text in documents.items():
        made = made.when(kind == k, F.format_string(text, F.col("event_id").cast("string"), day))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", made.alias("document"))
    aliases = spark.createDataFrame([("k", "k", 1), ("k", "K", 2), ("k", "value", 3), ("day", "day", 1), ("day", "일자", 2)], "field string, alias string, rank int")
    fields = records.with_aliases([records.Field("k", "number"), records.Field("day", "date", required=False)], aliases)
    return records.parsed(events, "document", fields)


STATES = ("unavailable", "extreme_fear", "fear", "neutral", "greed", "extreme_greed")
QUALITIES = ("insufficient_history", "invalid_regression", "zero_mad", "low_model_fit", "ok")


def contract_rules() -> list[contract.Rule]:
    c = F.col
    scored = c("percentile").isNotNull()
    return [
        contract.present("daily", "date"), contract.unique("daily", "date"), contract.positive("daily", "open"), contract.positive("daily", "close"), contract.positive("daily", "trading_value"),
        contract.holds("daily", "open_near_close", F.abs(c("open") / c("close") - 1) <= 0.25), contract.within("daily", ["date"], "shipping", "daily_is_shipped"),
        contract.one_of("funds", "ticker", ["IDX", "L1", "S1"]), contract.unique("funds", "ticker", "date"), contract.positive("funds", "close"), contract.positive("funds", "open"),
        contract.within("funds", ["date"], "daily", "funds_on_sessions"),
        contract.neighbours("funds", "close_continues", ["ticker"], ["date"], ["close"], lambda before: F.abs(c("close") / before["close"] - 1) <= 0.3),
        contract.neighbours("funds", "gap_in_days", ["ticker"], ["date"], ["date"], lambda before: F.datediff("date", before["date"]) <= 1),
        contract.unique("states", "channel", "date"), contract.ranged("states", "percentile", 0, 100), contract.one_of("states", "state", STATES), contract.one_of("states", "quality", QUALITIES),
        contract.holds("states", "eligible_is_ok", ~c("trade_eligible") | (c("quality") == "ok")), contract.holds("states", "unavailable_has_no_percentile", (c("state") == "unavailable") == ~scored),
        contract.ranged("states", "training_count", 0, 252), contract.holds("states", "eligible_falls", ~c("trade_eligible") | (c("beta") < 0)), contract.holds("states", "scored_has_alpha", ~scored | c("alpha").isNotNull()),
        contract.within("states", ["date"], "daily", "states_on_sessions"), contract.matching("states", "channel", "^(main|noisy)$"),
        contract.neighbours("states", "training_grows", ["channel"], ["date"], ["training_count"], lambda before: c("training_count") >= before["training_count"]),
        contract.positive("shipping", "price"), contract.unique("shipping", "date"), contract.within("shipping", ["date"], "daily", "shipped_on_sessions"),
    ]


def k15_contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"daily": _daily(spark, sf_dir), "funds": ordered._funds(spark, sf_dir), "states": _states(spark, sf_dir), "shipping": _shipping(spark, sf_dir)}
    return contract.violations(tables, {"daily": ["date"], "funds": ["ticker", "date"], "states": ["channel", "date"], "shipping": ["date"]}, contract_rules())


def e5_input_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = _shipping(spark, sf_dir).select("date", F.col("price").alias("flow"))
    found = contract.input_quality(_daily(spark, sf_dir), flow, expected="2001-08-10")
    return found.withColumn("issues", F.array_join("issues", ",")).withColumns({c: F.round(c, 8) for c in ("overlap", "flow_coverage", "core_coverage")})


def _bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendars of the market, of shipping and of each fund, all in one aggregate."""
    named = [_daily(spark, sf_dir).select(F.lit("market").alias("name"), "date"), _shipping(spark, sf_dir).select(F.lit("shipping").alias("name"), "date"), ordered._funds(spark, sf_dir).select(F.col("ticker").alias("name"), "date")]
    return calendars.bitmaps(reduce(DataFrame.unionByName, named), ["name"])


def h1_union_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.overlap(_bitmaps(spark, sf_dir), ["market", "shipping"]).select("common", "whole")


def h2_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.differences(_bitmaps(spark, sf_dir), "market", "shipping").where("side = 'missing'").select("date")


def c6_common_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.common_days(_bitmaps(spark, sf_dir), ["market", "shipping"])


def c7_all_tickers_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.common_days(_bitmaps(spark, sf_dir), ["IDX", "L1", "S1"])


def c8_missing_and_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.differences(_bitmaps(spark, sf_dir), "market", "shipping")


def h2_calendar_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.against_rest(_bitmaps(spark, sf_dir))


def _in_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    session = sql.session(spark)
    _states(session, sf_dir).createOrReplaceTempView("states")
    return session.sql(text)


def b9_b11_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_sql(spark, sf_dir, "select channel, date, round(percentile, 6) as percentile, classify_state(percentile, 5) as state, state_direction(classify_state(percentile, 5)) as direction from states")


def b10_variable_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_sql(spark, sf_dir, "select tail, classify_state(percentile, tail) as state, count(*) as n from states cross join (values (1), (2), (5), (20)) as t(tail) group by all")  # four rows


def b12_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_sql(spark, sf_dir, "select channel, date, state_trigger(state, trade_eligible) as trigger from states")


def f9_segments_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_sql(spark, sf_dir, "select * from holding_segments(table (select channel, date, state from states) partition by channel order by date)")


def i1_entries_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_sql(spark, sf_dir, "select * from extreme_entries(table (select channel, date, state, trade_eligible from states) partition by channel order by date)")


def k8_k12_refresh_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental runs over one published history: first, the same again, new days, a corrected day, a rewritten past, and a source that ends early."""
    history = versions.History(spark, f"{landing.shared_folder(spark)}/fluxlens/history-{uuid.uuid4().hex}")
    daily = landing.stored(_daily(spark, sf_dir).select("date", F.round("close", 6).alias("close")), "closes")
    cut = daily.where("date <= date'2001-03-31'")
    until = daily.where("date <= date'2001-04-10'")
    first, last = until.agg(F.min("date"), F.max("date")).first()
    corrected = F.when(F.col("date") == F.lit(last), F.col("close") + 1).otherwise(F.col("close"))
    runs = [
        ("first", cut), ("again", cut), ("new_days", until.where("date >= date'2001-03-29'")), ("corrected", until.where("date >= date'2001-04-01'").withColumn("close", corrected)),
        ("rewritten", until.withColumn("close", F.when(F.col("date") == F.lit(first), 0.0).otherwise(corrected))),
    ]
    told = []
    for name, rows in runs:
        told.append((name, versions.refreshed(history, rows)))
    told.append(("ends_early", history.publish(cut)))
    rows = [(k, name, o.status, o.version, len(o.rewritten), len(o.days)) for k, (name, o) in enumerate(told)]
    found = spark.createDataFrame(rows, "step int, name string, status string, version int, months_written int, days_changed int")
    # What each version holds, read back.
    held = reduce(DataFrame.unionByName, [history.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("rows_held"), F.round(F.sum("close"), 4).alias("sum_close")) for v in history.versions()])
    return found.join(held, "version").select("step", "name", "status", "version", "months_written", "days_changed", "rows_held", "sum_close")


def m5_m6_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional, repeated, late and confirming rows of two funds, batch by batch."""
    base = f"{landing.shared_folder(spark)}/fluxlens/sessions-{uuid.uuid4().hex}"
    placed = ordered.scan.positions(ordered._funds(spark, sf_dir).where("ticker <> 'IDX'"), ["ticker"], ["date"], rows=ordered.PART)
    batch, at = F.floor(F.col("position") / BATCH), F.col("position")
    makes = [
        (F.lit(True), batch, F.col("close") * 1.01, 0), (at % 3 != 0, batch + F.when(at % 7 == 0, 1).otherwise(0), F.col("close"), 1), (at % 5 == 0, batch + 1, F.col("close") * 1.02, 0),
    ]
    rows = landing.stored(reduce(DataFrame.unionByName, [placed.where(w).select("ticker", "date", c.alias("close"), F.lit(p).alias("phase"), b.cast("int").alias("batch")) for w, b, c, p in makes]), "arrivals")
    log = None
    # As many batches as the source sends; each run takes up the state of the one before.
    for b in range(rows.agg(F.max("batch")).first()[0] + 1):
        rows.where(F.col("batch") == b).drop("batch").write.mode("append").parquet(f"{base}/in")
        log = supersede.run(spark, f"{base}/in", f"{base}/out", f"{base}/state", expires_days=2000)
    return supersede.final(log).select("ticker", "date", F.round("close", 6).alias("close"), "phase", "refused")


QUERIES = {f.__name__: f for f in (
    a7_a11_day_files, a14_accepted_records, a14_refused_values, k15_contract_rules, e5_input_report, h1_union_jaccard, h2_difference, c6_common_calendar, c7_all_tickers_calendar, c8_missing_and_extra, h2_calendar_coverage,
    b9_b11_states, b10_variable_tail, b12_triggers, f9_segments_in_sql, i1_entries_in_sql, k8_k12_refresh_runs, m5_m6_session_stream,
)}

_FUNDS_SEEN = "select ticker || '|' || cast(date as varchar) as key, *, lag(close) over (partition by ticker order by date) as close_before, lag(date) over (partition by ticker order by date) as date_before from funds"
_STATES_SEEN = "select channel || '|' || cast(date as varchar) as key, *, lag(training_count) over (partition by channel order by date) as training_before from states"

#: Rule, table and the condition under which a row breaks it, over the tables below; keys of unique rules count once.
_BROKEN = (
    ("date_present", "daily", "date is null"), ("open_positive", "daily", "not coalesce(open > 0, false)"), ("close_positive", "daily", "not coalesce(close > 0, false)"), ("trading_value_positive", "daily", "not coalesce(trading_value > 0, false)"),
    ("open_near_close", "daily", "not coalesce(abs(open / close - 1) <= 25e-2, false)"), ("daily_is_shipped", "daily", "date not in (select date from shipping)"),
    ("ticker_known", "funds", "ticker not in ('IDX', 'L1', 'S1')"), ("close_positive", "funds", "not coalesce(close > 0, false)"), ("open_positive", "funds", "not coalesce(open > 0, false)"), ("funds_on_sessions", "funds", "date not in (select date from daily)"),
    ("close_continues", "funds", "date_before is not null and not coalesce(abs(close / close_before - 1) <= 3e-1, false)"), ("gap_in_days", "funds", "date_before is not null and date - date_before > 1"),
    ("percentile_range", "states", "not (percentile is null or (percentile >= 0 and percentile <= 100))"), ("state_known", "states", "state not in ('unavailable', 'extreme_fear', 'fear', 'neutral', 'greed', 'extreme_greed')"),
    ("quality_known", "states", "quality not in ('insufficient_history', 'invalid_regression', 'zero_mad', 'low_model_fit', 'ok')"), ("eligible_is_ok", "states", "trade_eligible and quality <> 'ok'"),
    ("unavailable_has_no_percentile", "states", "(state = 'unavailable') <> (percentile is null)"), ("training_count_range", "states", "training_count < 0 or training_count > 252"), ("eligible_falls", "states", "trade_eligible and not beta < 0"),
    ("scored_has_alpha", "states", "percentile is not null and alpha is null"), ("states_on_sessions", "states", "date not in (select date from daily)"), ("channel_form", "states", "channel not in ('main', 'noisy')"),
    ("training_grows", "states", "training_before > training_count"), ("price_positive", "shipping", "not coalesce(price > 0, false)"), ("shipped_on_sessions", "shipping", "date not in (select date from daily)"),
)
_TWICE = (("date_unique", "daily", "cast(date as varchar)"), ("ticker_date_unique", "funds", "ticker || '|' || cast(date as varchar)"), ("channel_date_unique", "states", "channel || '|' || cast(date as varchar)"), ("date_unique", "shipping", "cast(date as varchar)"))
_SEEN = {"daily": "select cast(date as varchar) as key, * from daily", "funds": _FUNDS_SEEN, "states": _STATES_SEEN, "shipping": "select cast(date as varchar) as key, * from shipping"}


def _contract_sql() -> str:
    rows = [f"select '{rule}' as rule, '{table}' as table_name, count(*) as violations, min(key) as first_key, max(key) as last_key from seen_{table} where {broken}" for rule, table, broken in _BROKEN]
    rows += [f"select '{rule}', '{table}', count(*), min(key), max(key) from (select {key} as key from {table} group by 1 having count(*) > 1) x" for rule, table, key in _TWICE]
    return ", " + ", ".join(f"seen_{t} as ({q})" for t, q in _SEEN.items()) + " " + " union all ".join(rows)


#: SQL to follow the portable adapters; queries that are named as portable ones are held against the text there.
SQL = {
    "a7_a11_day_files": """select ticker, date, floor(open * 100 + 5e-1) / 1e2 as open, floor(close * 100 + 5e-1) / 1e2 as close, cast(null as varchar) as reason from funds where date between date '1996-03-04' and date '1998-02-20'
        union all select 'X9', date '1996-03-04', null, null, 'missing'""",
    "a14_accepted_records": """select event_id, case event_id % 9 when 3 then cast('1' || event_id as double) when 5 then -cast(event_id as double) else cast(event_id as double) end as k, case when event_id % 9 <> 5 then cast(ts as date) end as day
        from events where event_id % 9 in (3, 5, 6)""",
    "a14_refused_values": """select event_id, case when event_id % 9 in (0, 1, 2) then null else 'k' end as field, case event_id % 9 when 0 then 'invalid_json' when 1 then 'not_an_object' when 2 then 'no_document' when 7 then 'missing' else 'invalid_number' end as code
        from events where event_id % 9 not in (3, 5, 6) union all select event_id, 'day', 'invalid_date' from events where event_id % 9 = 7""",
    "k15_contract_rules": _contract_sql(),
    "e5_input_report": """, a as (select count(*) as n, min(date) as first, max(date) as last, count_if(not coalesce(close > 0 and open > 0, false)) as p, count_if(not coalesce(trading_value > 0, false)) as v from market),
        b as (select count(*) as n, min(date) as first, max(date) as last, count_if(price is null) as f from shipping), j as (select count(*) as c from market m join shipping s on s.date = m.date),
        r as (select a.n as core_rows, b.n as flow_rows, a.first as core_first, a.last as core_last, b.first as flow_first, b.last as flow_last, p as bad_price, v as bad_value, f as bad_flow, c as common, a.n - c as a_only, b.n - c as b_only,
          round(c / (a.n + b.n - c), 8) as overlap, round(c / a.n, 8) as flow_coverage, round(c / b.n, 8) as core_coverage, abs(a.last - b.last) as source_lag, greatest(0, date '2001-08-10' - least(a.last, b.last)) as freshness_lag,
          date '2001-08-10' - least(a.last, b.last) as lag, a.last <> b.last as moved from a, b, j)
        select core_rows, flow_rows, core_first, core_last, flow_first, flow_last, cast(bad_price as bigint) as bad_price, cast(bad_value as bigint) as bad_value, cast(bad_flow as bigint) as bad_flow, common, a_only, b_only, overlap, flow_coverage, core_coverage,
          cast(source_lag as int) as source_lag, cast(freshness_lag as int) as freshness_lag, concat_ws(',', case when bad_price > 0 then 'invalid_price' end, case when bad_value > 0 then 'invalid_trading_value' end, case when bad_flow > 0 then 'invalid_flow' end,
          case when moved then 'latest_source_date_mismatch' end, case when a_only + b_only > 0 then 'source_date_gaps' end, case when lag < 0 then 'source_date_after_expected' when lag > 3 then 'stale_core_sources' end,
          case when common < 200 then 'insufficient_common_history' when overlap < 9e-1 then 'low_source_date_overlap' end) as issues from r""",
    "h2_calendar_coverage": """, named as (select 'market' as name, date from market union all select 'shipping', date from shipping union all select ticker, date from funds), whole as (select count(distinct date) as n from named)
        select name, count(distinct date) as days, max(whole.n) - count(distinct date) as missing from named, whole group by name""",
    "f9_segments_in_sql": """, c as (select *, case when lag(state) over (partition by channel order by date) = state then 0 else 1 end as changed from states), s as (select *, sum(changed) over (partition by channel order by date rows between unbounded preceding and current row) as segment from c)
        select channel, cast(segment as bigint) as segment, state, min(date) as first_date, max(date) as last_date, count(*) as sessions from s group by channel, segment, state""",
    "i1_entries_in_sql": """select channel, date, state, cast(position as bigint) as position from entries""",
    "k8_k12_refresh_runs": """, c as (select date, round(close, 6) as close from daily), v as (
          select 1 as version, count(*) as rows_held, round(sum(close), 4) as sum_close from c where date <= date '2001-03-31'
          union all select 2, count(*), round(sum(close), 4) from c where date <= date '2001-04-10'
          union all select 3, count(*), round(sum(close + case when date = (select max(date) from c where date <= date '2001-04-10') then 1 else 0 end), 4) from c where date <= date '2001-04-10'),
        m as (select count(distinct strftime(date, '%Y-%m')) as months from c where date <= date '2001-03-31'), n as (select count(*) as days from c where date > date '2001-03-31' and date <= date '2001-04-10'),
        s as (select 0 as step, 'first' as name, 'published' as status, 1 as version, months as months_written, 0 as days_changed from m union all select 1, 'again', 'unchanged', 1, 0, 0
          union all select 2, 'new_days', 'published', 2, 1, days from n union all select 3, 'corrected', 'published', 3, 1, 1 union all select 4, 'rewritten', 'frozen_changed', 3, 0, 1 union all select 5, 'ends_early', 'date_regression', 3, 0, 0)
        select step, name, status, s.version, cast(months_written as int) as months_written, cast(days_changed as int) as days_changed, rows_held, sum_close from s join v on v.version = s.version""",
    "m5_m6_session_stream": f""", p as (select ticker, date, close, row_number() over (partition by ticker order by date) - 1 as pos from funds where ticker <> 'IDX'),
        r as (select ticker, date, close * 101e-2 as close, 0 as phase, pos // {BATCH} as batch from p union all select ticker, date, close, 1, pos // {BATCH} + case when pos % 7 = 0 then 1 else 0 end from p where pos % 3 <> 0
          union all select ticker, date, close * 102e-2, 0, pos // {BATCH} + 1 from p where pos % 5 = 0),
        lines as (select r.*, (select count(distinct l.date) from r l where l.ticker = r.ticker and l.date > r.date and l.batch < r.batch) >= 5 as late from r)
        select ticker, date, round(arg_max(close, phase * 1000 + batch) filter (where not late), 6) as close, cast(max(phase) filter (where not late) as int) as phase, cast(count_if(late) as bigint) as refused from lines group by ticker, date""",
}
