"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from fluxlens.plans import adapters, checked, history, history_sql, ordered, portable, research, surface, trading

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return research.QUERIES | trading.QUERIES | history.QUERIES | {name: partial(portable.run, name) for name in portable.QUERIES} | ordered.QUERIES | surface.QUERIES | checked.QUERIES | adapters.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: portable.with_adapters(sql, 1) for name, sql in (research.SQL | trading.SQL | history_sql.SQL | surface.SQL | checked.SQL | adapters.SQL).items()} | {name: portable.text_of(name, 1) for name in portable.QUERIES}
