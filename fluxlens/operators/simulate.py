"""Next-open trading simulated along a path, one scenario in one group.

The order of a session: pending exits and reversals at the open, then a
pending entry; at the close the reasons to leave in the order opposite
extreme, recovery, longest holding; when flat, the day's extreme entry; then
equity is marked.  Scenarios run side by side, sessions one after the other.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("long_cash", "long_short_cash", "long_inverse_cash")
#: What takes the other side under each policy: the fund itself sold short, or the inverse fund bought.
OTHER_SIDE = {"long_cash": None, "long_short_cash": "short", "long_inverse_cash": "inverse"}
PRICES = ("open", "close", "other_open", "other_close")
LEDGER = (
    "scenario_id string, date date, opening_position string, opening_pending string, position string, equity double, buy_hold double, exposure double, "
    "action string, reason string, signal_date date, from_price double, to_price double, left_with double, entered_with double, cost double, sides int, "
    "pending_action string, pending_reason string, pending_side string, pending_signal_date date, open double, close double, other_open double, other_close double"
)
GRID = "scenario_id string, pair string, policy string, cost_bps double, long_exit double, max_holding int"


@dataclass
class Account:
    """Cash and units of one instrument; costs are a share of what is traded."""

    cost: float
    cash: float = 1.0
    units: float = 0.0
    side: str | None = None
    entered: int = -1

    def enter(self, side: str, at: int, price: float) -> float:
        fee = self.cash * self.cost
        capital = self.cash - fee
        self.units = (-capital if side == "short" else capital) / price
        self.cash = capital - self.units * price
        self.side, self.entered = side, at
        return fee

    def leave(self, price: float) -> float:
        fee = abs(self.units) * price * self.cost
        self.cash += self.units * price - fee
        self.units, self.side = 0.0, None
        return fee

    def worth(self, price: float) -> float:
        return self.cash + self.units * price


@dataclass(frozen=True)
class Order:
    """What the next open is to do: enter a side, exit, or reverse to a side."""

    kind: str | None = None
    reason: str | None = None
    side: str | None = None
    signal_date: datetime.date | None = None

    def snapshot(self) -> tuple:
        return (f"{self.kind}_next_open" if self.kind else None, self.reason, self.side, self.signal_date)


def checked(days: pd.DataFrame, *, policy: str, cost_bps: float, long_exit: float, max_holding: int) -> None:
    """Refuses settings and bars that no path can be trusted on."""
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r} is none of {POLICIES}")
    if not np.isfinite(cost_bps) or cost_bps < 0 or max_holding <= 0:
        raise ValueError("costs must not be negative, and the longest holding is one session at least")
    if long_exit != int(long_exit) or not 50 <= long_exit <= 94:
        raise ValueError("the long exit is a whole number from 50 to 94")
    if len(days) < 2:
        raise ValueError("at least two common sessions are required")
    bars = days[list(PRICES)].to_numpy(float)
    if days["date"].duplicated().any() or not np.isfinite(bars).all() or (bars <= 0).any():
        raise ValueError("bars must have unique dates and finite positive prices")


def simulate(days: pd.DataFrame, *, policy: str, cost_bps: float, long_exit: float, max_holding: int) -> pd.DataFrame:
    """A ledger row for each session of date-sorted ``days``.

    Columns: date, open, close, other_open, other_close (the inverse fund,
    used by ``long_inverse_cash``), percentile (null: no signal), entry
    ('extreme_fear', 'extreme_greed' or null).  The other side leaves at the
    percentile that mirrors ``long_exit``.
    """
    checked(days, policy=policy, cost_bps=cost_bps, long_exit=long_exit, max_holding=max_holding)
    other, account, order = OTHER_SIDE[policy], Account(cost_bps / 10_000), Order()
    first_open, rows = float(days["open"].iloc[0]), []
    for k, row in enumerate(days.itertuples(index=False)):

        def price(side: str, when: str, row=row) -> float:
            return float(getattr(row, f"other_{when}" if side == "inverse" else when))

        opening, opened_with = account.side or "cash", order
        done = dict.fromkeys(("action", "reason", "signal_date", "from_price", "to_price", "left_with", "entered_with"))
        cost, sides = 0.0, 0
        if order.kind:
            done |= {"action": order.kind, "reason": order.reason, "signal_date": order.signal_date}
            if order.kind != "enter":
                done["from_price"] = price(account.side, "open")
                cost, sides = account.leave(done["from_price"]), 1
                done["left_with"] = account.cash
            if order.side:
                done |= {"to_price": price(order.side, "open"), "entered_with": account.cash}
                cost, sides = cost + account.enter(order.side, k, done["to_price"]), sides + 1
            order = Order()
        entry = row.entry if isinstance(row.entry, str) else None
        wanted = {"extreme_fear": "long", "extreme_greed": other}.get(entry)
        known = row.percentile is not None and not np.isnan(row.percentile)
        if account.side:
            if wanted and wanted != account.side:
                order = Order("reverse", "opposite_extreme", wanted, row.date)
            elif known and (row.percentile >= long_exit if account.side == "long" else row.percentile <= 100 - long_exit):
                order = Order("exit", "recovery", None, row.date)
            elif k - account.entered + 1 >= max_holding:
                order = Order("exit", "max_holding", None, row.date)
        elif wanted:
            order = Order("enter", f"{entry}_entry", wanted, row.date)
        equity = account.worth(price(account.side, "close") if account.side else 0.0)
        if not np.isfinite(equity) or equity <= 0:
            raise ValueError("equity is not positive")
        exposure = {"long": 1.0, None: 0.0}.get(account.side, -1.0)
        rows.append((row.date, opening, opened_with.snapshot()[0], account.side or "cash", equity, float(row.close) / first_open, exposure, *done.values(), cost, sides, *order.snapshot(), *(float(getattr(row, p)) for p in PRICES)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in LEDGER.split(", ")][1:])


def run_scenarios(days: DataFrame, grid: list[dict], *, end: str | None = None) -> DataFrame:
    """Runs a grid of scenarios over the sessions of their pair of funds; a group is one scenario's sessions.

    ``days`` has a row for each pair and session; those after ``end`` never
    enter.  A scenario that can't be carried through gives one row with
    position 'unavailable' and the reason, never a path in cash.
    """
    names = [c.split()[0] for c in GRID.split(", ")]
    scenarios = days.sparkSession.createDataFrame([tuple(g[c] for c in names) for g in grid], GRID)
    days = days if end is None else days.where(F.col("date") <= F.lit(end).cast("date"))
    # The grid is written down by hand: a few rows.
    work = days.join(F.broadcast(scenarios), "pair")

    def one(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("date")
        g = df.iloc[0]
        try:
            out = simulate(df, policy=g["policy"], cost_bps=g["cost_bps"], long_exit=g["long_exit"], max_holding=int(g["max_holding"]))
        except ValueError as e:
            out = pd.DataFrame([{c.split()[0]: None for c in LEDGER.split(", ")[1:]} | {"date": g["date"], "position": "unavailable", "reason": str(e)}])
        out.insert(0, "scenario_id", key[0])
        return out

    return work.groupBy("scenario_id").applyInPandas(one, LEDGER)


def _line() -> Window:
    return Window.partitionBy("scenario_id").orderBy("date")


def sliced(ledger: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A range of full paths: equity, index and costs in units of the equity at the close of its first session.

    Actions of the first session happened before that close and are blanked.
    Ranges of fewer than two sessions are unavailable; unavailable scenarios stay.
    """
    inside = ledger.where((F.col("position") == "unavailable") | (F.col("date") >= F.lit(start or "0001-01-01").cast("date")) & (F.col("date") <= F.lit(end or "9999-12-31").cast("date")))
    whole = Window.partitionBy("scenario_id")
    inside = inside.withColumn("first", F.min("date").over(whole)).withColumn("base", F.min_by("equity", "date").over(whole)).withColumn("base_hold", F.min_by("buy_hold", "date").over(whole)).withColumn("held", F.count("*").over(whole))
    first = F.col("date") == F.col("first")
    blank = {c: F.when(~first, F.col(c)).alias(c) for c in ("action", "reason", "signal_date", "from_price", "to_price")}
    scaled = {c: (F.col(c) / F.col(b)).alias(c) for c, b in (("equity", "base"), ("buy_hold", "base_hold"))}
    moved = {c: F.when(~first, F.col(c) / F.col("base")).alias(c) for c in ("left_with", "entered_with")} | {"cost": F.when(first, 0.0).otherwise(F.col("cost") / F.col("base")).alias("cost"), "sides": F.when(first, 0).otherwise(F.col("sides")).alias("sides")}
    changed = blank | scaled | moved
    gone = F.col("position") == "unavailable"
    rows = inside.where((F.col("held") > 1) | gone)
    return rows.select(*[F.when(gone, F.col(c)).otherwise(changed[c]).alias(c) if c in changed else F.col(c) for c in ledger.columns])


def trades(ledger: DataFrame) -> DataFrame:
    """Closed trades: each exit or reversal with the entry before it that is in the ledger too."""
    before = _line().rowsBetween(Window.unboundedPreceding, -1)
    entered = F.col("action").isin("enter", "reverse")
    placed = ledger.where("position <> 'unavailable'").withColumn("place", F.row_number().over(_line()))
    last = F.when(entered, F.struct(F.col("position").alias("side"), F.col("date").alias("entry_date"), F.col("to_price").alias("entry_price"), F.col("entered_with"), F.col("reason").alias("entry_reason"), F.col("signal_date").alias("entry_signal_date"), F.col("place").alias("entry_place")))
    closing = placed.withColumn("opened", F.last(last, ignorenulls=True).over(before)).where(F.col("action").isin("exit", "reverse") & F.col("opened").isNotNull())
    sign = F.when(F.col("opened.side") == "short", -1.0).otherwise(1.0)
    return closing.select(
        "scenario_id", "opened.side", "opened.entry_date", F.col("date").alias("exit_date"), "opened.entry_price", F.col("from_price").alias("exit_price"),
        (F.col("place") - F.col("opened.entry_place")).cast("int").alias("holding_sessions"), F.col("reason").alias("exit_reason"), "opened.entry_reason", "opened.entry_signal_date", F.col("signal_date").alias("exit_signal_date"),
        (sign * (F.col("from_price") / F.col("opened.entry_price") - 1)).alias("gross_return"), (F.col("left_with") / F.col("opened.entered_with") - 1).alias("net_return"),
    )


def standing(ledger: DataFrame) -> DataFrame:
    """Where each scenario stands after its last session: position, pending order and the open trade's result so far."""
    so_far = _line().rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("action").isin("enter", "reverse"), F.struct("date", "entered_with")), ignorenulls=True).over(so_far)
    held = F.col("position").isin("long", "short", "inverse")
    last = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.desc("date")))
    return ledger.withColumn("opened", opened).withColumn("back", last).where("back = 1").select(
        "scenario_id", "date", "position", "pending_action", "pending_reason", "pending_side", "pending_signal_date",
        F.when(held, F.col("opened.date")).alias("entry_date"), F.when(held, F.col("equity") / F.col("opened.entered_with") - 1).alias("unrealized_return"))


def zero_cost(ledger: DataFrame) -> DataFrame:
    """The path that the same positions give without costs: bought and left at opens, marked at closes.

    A session's factor is, of the position that it opened with, open over the
    last close, and of the one that it closes with, close over open; without a
    change it is close over close.  Of a short position of one unit's worth,
    the path is linear in the price, so it is taken from its entry on.
    """
    known = ledger.where("position <> 'unavailable'")
    was = F.coalesce(F.lag("position").over(_line()), F.lit("cash"))
    placed = known.withColumn("was", was).withColumn("turn", (F.col("was") != F.col("position")).cast("int")).withColumn("segment", F.sum("turn").over(_line().rowsBetween(Window.unboundedPreceding, 0)))

    def of(side: str, when: str):
        return F.when(F.col(side) == "inverse", F.col(f"other_{when}")).otherwise(F.col(when))

    segment = Window.partitionBy("scenario_id", "segment").orderBy("date")
    bought = F.first(of("position", "open")).over(segment.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("bought", bought)

    def grown(price, side, entry):
        return F.when(F.col(side) == "cash", 1.0).when(F.col(side) == "short", 2 - price / entry).otherwise(price / entry)

    # What a segment made in all is known at the open that ends it.
    ended = F.when(F.col("turn") == 1, grown(of("was", "open"), "was", F.lag("bought").over(_line()))).otherwise(1.0)
    settled = F.product(F.coalesce(ended, F.lit(1.0))).over(_line().rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("scenario_id", "date", "equity", (settled * grown(of("position", "close"), "position", F.col("bought"))).alias("matched"))
