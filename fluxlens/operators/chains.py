"""Greedy choices along a line: each kept event names the first that may be kept after it.

Which events are kept depends on the one kept before, so a channel's events
can't be chosen row by row.  But every event knows where the choice would go
on from it, whether it is kept or not.  These pointers are followed inside
blocks of the line first, each block by itself, which leaves one exit for
each event.  Exits are then doubled until every block knows the event by
which the chain enters it, and a block's own pointers tell the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.operators import scan
from fluxlens.sources.landing import stored

#: Events of a block.
ROWS = 1 << 16


def exits(position: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ordered events and the positions that follow each (-1: none): where the chain from each leaves them, and in how many steps.

    Pointers lead on, so going back from the end each event's exit is known
    when it is asked for.
    """
    out, steps = following.copy(), np.ones(len(position), np.int64)
    at = np.searchsorted(position, following)
    inside = (following >= 0) & (at < len(position))
    for k in range(len(position) - 1, -1, -1):
        if inside[k]:
            out[k], steps[k] = out[at[k]], steps[at[k]] + 1
    return out, steps


def walked(position: np.ndarray, following: np.ndarray, entry: int) -> np.ndarray:
    """Which of the ordered events the chain from the entry keeps."""
    kept = np.zeros(len(position), bool)
    at = int(np.searchsorted(position, entry))
    while at < len(position):
        kept[at] = True
        if following[at] < 0:
            break
        at = int(np.searchsorted(position, following[at]))
    return kept


def next_permitted(events: DataFrame, by: Sequence[str], on: str, gap: int, *, rows: int = ROWS) -> DataFrame:
    """``by``, ``on`` and ``following``: the first event at least ``gap`` after each, null if there is none.

    An as-of join on the line of all events, cut into parts.
    """
    own = events.select(*by, F.col(on).cast("long").alias(on)).distinct()
    asked = own.select(*by, (F.col(on) + gap).alias("at"), F.lit(1).alias("asks"), F.col(on).alias("of"), F.lit(None).cast("long").alias("event"))
    there = own.select(*by, F.col(on).alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("of"), F.col(on).alias("event"))
    # Backwards an asking row stands after an event at its very place only if events sort after it.
    line = asked.unionByName(there).withColumn("turn", -F.col("asks"))
    found = scan.running(line, by, ["at", "turn"], {"following": ("last", "event")}, strict=True, backwards=True, rows=rows)
    return found.where("asks = 1").select(*by, F.col("of").alias(on), "following")


def greedy(events: DataFrame, by: Sequence[str], on: str, gap: int, *, rows: int = ROWS) -> DataFrame:
    """``by`` and ``on`` of the events that are kept: the first of each group, then always the first at least ``gap`` after the last kept.

    Repeated positions count once; rows without one take no part; groups may
    have null keys.  A task holds one block of one group, of about ``rows``
    events.  Rounds grow with the logarithm of the number of blocks, not with
    that of the events or of the chain's steps.
    """
    known = events.where(F.col(on).isNotNull())
    at = scan.cuts(known, on, rows)
    linked = stored(scan.parted(next_permitted(known, by, on, gap, rows=rows), by, on, at).withColumnRenamed("__part", "block").withColumnRenamed("__by", "g"), "links")
    kind = linked.schema["g"].dataType.simpleString()

    def arrays(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        line = group.sort_by(on)
        return line, line.column(on).to_numpy(), line.column("following").fill_null(-1).to_numpy()

    def leave(group: pa.Table) -> pa.Table:
        line, position, following = arrays(group)
        out, _ = exits(position, following)
        return pa.table({"g": line.column("g"), "from": position, "to": pa.array(np.where(out < 0, 0, out), pa.int64(), mask=out < 0)})

    first = linked.groupBy("g").agg(F.min(on).alias("from"))
    jumps = linked.groupBy("g", "block").applyInArrow(leave, f"g {kind}, from long, to long")
    if at:
        # Only what some exit leads to can be entered; the first events are entered from outside.
        jumps = stored(jumps, "exits")
        goals = first.unionByName(jumps.where("to is not null").select("g", F.col("to").alias("from"))).distinct()
        jumps = stored(jumps.join(goals, ["g", "from"], "left_semi"), "jumps")
        reached = stored(first, "reached")
        # Each round reaches what is up to twice as many jumps away; there are at most as many jumps as blocks.
        for _ in range(len(at).bit_length()):
            live = jumps.where("to is not null")
            reached = stored(reached.unionByName(reached.join(live, ["g", "from"]).select("g", F.col("to").alias("from"))).distinct(), "reached")
            on_from = jumps.select("g", F.col("from").alias("to"), F.col("to").alias("beyond"))
            jumps = stored(live.join(on_from, ["g", "to"]).select("g", "from", F.col("beyond").alias("to")), "jumps")
        first = reached
    entered = scan.parted(first.withColumnRenamed("from", on), [], on, at).select(F.col("g"), F.col(on).alias("entry"), F.col("__part").alias("block"))
    opened = linked.join(entered.groupBy("g", "block").agg(F.min("entry").alias("entry")), ["g", "block"])

    def keep(group: pa.Table) -> pa.Table:
        line, position, following = arrays(group)
        kept = walked(position, following, line.column("entry")[0].as_py())
        return pa.table({"g": line.column("g"), on: position}).filter(pa.array(kept))

    found = opened.groupBy("g", "block").applyInArrow(keep, f"g {kind}, {on} long")
    return found.select(*[F.col(f"g.{c}").alias(c) for c in by], on)
