"""The analysis frame: bars joined with flows, features, and every channel's signals side by side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fluxlens.functions import states
from fluxlens.operators import regression, scan, selection
from fluxlens.sources.landing import stored

#: Fields of a signal that are put beside a day, in order.
FIELDS = ("alpha", "beta", "rolling_r2", "residual", "residual_z", "percentile", "state", "quality", "training_count", "trade_eligible", "expected_flow", "fit_method", "fit_score")


def full(function: Callable[[Column], Column], value: Column, sessions: int) -> Callable[[WindowSpec], Column]:
    """A function of the last so many sessions of a line, null before there are as many."""

    def over(line: WindowSpec) -> Column:
        last = line.rowsBetween(1 - sessions, 0)
        return F.when(F.count(value).over(last) == sessions, function(value).over(last))

    return over


def overridden(df: DataFrame, name: str, value: Column) -> Column:
    """The published value of ``<name>_override``, where the table has one, else the value."""
    return F.coalesce(F.col(f"{name}_override"), value) if f"{name}_override" in df.columns else value


def source_hash(df: DataFrame) -> Column:
    """Sixteen hex digits that identify a day's inputs; a published one stands."""
    text = F.concat(F.col("date").cast("string"), F.lit("|"), states.fixed(F.col("close"), 10), F.lit("|"), states.fixed(F.col("trading_value"), 4), F.lit("|"), states.fixed(F.col("individual_net_purchase"), 4))
    return overridden(df, "source_hash", F.substring(F.sha2(text, 256), 1, 16))


def features(prices: DataFrame, flows: DataFrame, *, rows: int = scan.ROWS) -> DataFrame:
    """Days that both tables have, with return, flow as a share and in trillions, disparity, drawdown and source hash.

    The joined days are written once and worked on in parts of about so many
    ``rows``, each with the year before it.
    """
    joined = stored(prices.join(flows, "date"), "bars")
    close = F.col("close")
    framed = scan.framed(joined, [], ["date"], {
        "__before": lambda w: F.lag("close").over(w), "__mean50": full(F.avg, close, 50), "__top252": full(F.max, close, 252)}, preceding=251, rows=rows)
    return (
        framed.withColumn("return_1d", close / F.nullif("__before", F.lit(0.0)) - 1)
        .withColumn("flow_share", overridden(joined, "flow_share", F.try_divide("individual_net_purchase", "trading_value")))
        .withColumn("raw_flow_trillion", overridden(joined, "raw_flow_trillion", F.col("individual_net_purchase") / 1e12))
        .withColumn("disparity50", 100 * close / F.col("__mean50"))
        .withColumn("mdd252", close / F.col("__top252") - 1)
        .withColumn("source_hash", source_hash(joined))
        .drop("__before", "__mean50", "__top252")
    )


def channel_signals(frame: DataFrame, value: str, *, method: str = "ols", **options) -> DataFrame:
    """Signals of one flow column, a row for each day of the frame.

    Days without return or flow are left out before the windows run, and come
    back as unavailable with quality 'missing'.
    """
    observed = frame.select(F.lit(value).alias("channel"), "date", "return_1d", F.col(value).alias("flow_share"))
    run = {"ols": selection.rolling_signals, "huber": regression.rolling_huber_signals}[method]
    found = run(observed, **options).withColumn("expected_flow", F.col("flow_share") - F.col("residual")).withColumn("fit_method", F.lit(method))
    found = found.withColumn("fit_score", F.col("rolling_r2") if method == "ols" else F.col("fit_score"))
    filled = {"state": F.coalesce("state", F.lit("unavailable")), "quality": F.coalesce("quality", F.lit("missing")), "training_count": F.coalesce("training_count", F.lit(0)), "trade_eligible": F.coalesce("trade_eligible", F.lit(False)), "fit_method": F.lit(method)}
    return frame.select("date").join(found.select("date", *FIELDS), "date", "left").select("date", *[filled[c].alias(c) if c in filled else F.col(c) for c in FIELDS])


def attached(frame: DataFrame, signals: DataFrame, prefix: str) -> DataFrame:
    """The signal's fields beside each day, under a prefix."""
    return frame.join(signals.select("date", *[F.col(c).alias(f"{prefix}_{c}") for c in FIELDS]), "date", "left")


def participant_signals(frame: DataFrame, participants: tuple[str, ...], **options) -> DataFrame:
    """Signals of other traders' net purchases as a share of the trading value: channel, date and fields.

    Participants that the table has no column of are left out.
    """
    there = [n for n in participants if f"{n}_net_purchase" in frame.columns]
    shares = [frame.withColumn("share", F.try_divide(F.col(f"{n}_net_purchase"), F.col("trading_value"))) for n in there]
    found = [channel_signals(s, "share", **options).withColumn("channel", F.lit(n)) for n, s in zip(there, shares)]
    if not found:
        raise ValueError("none of the participants has a column")
    return reduce(DataFrame.unionByName, found).select("channel", "date", *FIELDS)


def analysis_frame(prices: DataFrame, flows: DataFrame, participants: tuple[str, ...] = (), **options) -> DataFrame:
    """Features with the robust, scaled and raw signals, their agreement and confidence.

    Of ``participants``, columns of net purchases of other traders, the table
    need not have all; their signals stand beside the others and change none.
    """
    frame = features(prices, flows)
    out = frame
    for prefix, value, method in (("robust", "flow_share", "huber"), ("scaled", "flow_share", "ols"), ("raw", "raw_flow_trillion", "ols")):
        out = attached(out, channel_signals(frame, value, method=method, **options), prefix)
    for name in participants:
        if f"{name}_net_purchase" in frame.columns:
            out = attached(out, participant_signals(frame, (name,), **options), name)
    scaled, raw = [(F.col(f"{p}_state"), F.col(f"{p}_trade_eligible")) for p in ("scaled", "raw")]
    three = [(F.col(f"{p}_state"), F.col(f"{p}_trade_eligible")) for p in ("robust", "scaled", "raw")]
    return (
        out.withColumn("direction_agreement", states.agreed_direction(scaled[0], raw[0]))
        .withColumn("trigger_agreement", states.agreed_trigger(states.trigger(*scaled), states.trigger(*raw)))
        .withColumn("model_confidence", states.confidence(*scaled, *raw))
        .withColumn("primary_confidence", states.confidence_of_three(F.col("robust_quality"), three))
    )


def disparity_filter(signals: DataFrame, frame: DataFrame, *, lookback: int = 756, quantile: float = 0.1) -> DataFrame:
    """Extreme fear stays eligible only on days whose disparity is at most the quantile of the ``lookback`` days before.

    ``signals``: date, state, trade_eligible.  The quantile needs as many days
    with a disparity; other states pass as they are.
    """
    limits = selection.sliding_quantile(frame.select("date", "disparity50"), [], ["date"], "disparity50", "disparity_limit", lookback=lookback, quantile=quantile)
    allowed = F.coalesce(F.col("disparity50") <= F.col("disparity_limit"), F.lit(False))
    kept = F.col("trade_eligible") & ((F.col("state") != "extreme_fear") | allowed)
    return signals.join(limits, "date").withColumn("disparity_eligible", kept)
