"""Landed day files as a data source: a partition for each ticker and span of months, filters pushed to the listing.

Files lie at ``<path>/ticker=<t>/month=<yyyy-MM>/``; each line of a file is a
document whose ``OutBlock_1`` holds a row for each session, under headers that
``HEADERS`` names.  What goes wrong in a partition becomes a row with a reason
in place of that partition's rows; the others are read as ever.
"""

from __future__ import annotations

import calendar
import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

NAME = "fluxlens_days"
SCHEMA = "ticker string, date date, open double, close double, reason string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: Headers by which a field may be called, the first found counts.
HEADERS = {
    "date": ("BAS_DD", "날짜", "일자", "date"),
    "open": ("OPNPRC_IDX", "TDD_OPNPRC", "시가", "open"),
    "close": ("CLSPRC_IDX", "TDD_CLSPRC", "종가", "close", "adj close"),
}


class Refused(Exception):
    """A partition that can't be read; the message is its reason."""


@dataclass
class Span(InputPartition):
    """Months of a ticker, and the days of them that are asked for."""

    ticker: str
    files: tuple[str, ...]
    first: dt.date
    last: dt.date


def number(text: object) -> float | None:
    """A number, from text with thousands separators too; null where there is none."""
    if text is None or isinstance(text, bool):
        return None
    cleaned = str(text).strip().replace(",", "")
    if cleaned in ("", "-"):
        return None
    try:
        value = float(cleaned)
    except ValueError as e:
        raise Refused("invalid_number") from e
    return value if value - value == 0 else None


def day(text: object) -> dt.date | None:
    digits = str(text or "").strip().replace("-", "").replace("/", "")
    try:
        return dt.datetime.strptime(digits, "%Y%m%d").date()
    except ValueError:
        return None


def rows_of(text: str, digits: int) -> Iterator[tuple[dt.date, float, float]]:
    """Complete rows of a file; entries that are no objects, and days or prices that are missing, are left out."""
    for line in filter(str.strip, text.splitlines()):
        try:
            document = json.loads(line)
        except ValueError as e:
            raise Refused("invalid_json") from e
        block = document.get("OutBlock_1") if isinstance(document, dict) else None
        if not isinstance(block, list):
            raise Refused("missing_block")
        for row in block:
            if not isinstance(row, dict):
                continue
            plain = {str(k).strip().lower(): v for k, v in row.items()}
            found = {}
            for field, names in HEADERS.items():
                name = next((n for n in names if n.lower() in plain), None)
                if name is None:
                    raise Refused(f"missing_{field}")
                found[field] = plain[name.lower()]
            at, opened, closed = day(found["date"]), number(found["open"]), number(found["close"])
            if at is not None and opened is not None and closed is not None:
                yield at, _rounded(opened, digits), _rounded(closed, digits)


def _rounded(x: float, digits: int) -> float:
    """Half up, as prices are quoted."""
    unit = 10**digits
    return (x * unit + 0.5) // 1 / unit


class DayFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.digits, self.months = options["path"].rstrip("/"), int(options.get("digits", 2)), int(options.get("months", 12))
        listed = options.get("tickers")
        self.expected = None if listed is None else [t for t in listed.split(",") if t]
        self.tickers: set[str] | None = None
        self.first, self.last = dt.date.min, dt.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of the date and equality of the ticker; gives back all else."""
        for f in filters:
            on, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if on == ("ticker",) and isinstance(f, (EqualTo, In)):
                these = set(value if isinstance(f, In) else [value])
                self.tickers = these if self.tickers is None else self.tickers & these
            elif on == ("date",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(value, dt.date):
                step = dt.timedelta(days=1)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, value + step if isinstance(f, GreaterThan) else value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, value - step if isinstance(f, LessThan) else value)
            elif on in (("ticker",), ("date",)) and isinstance(f, IsNotNull):
                continue  # neither is ever null
            else:
                yield f

    def _system(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.path)

    def _months(self, system: pa.fs.FileSystem, root: str, ticker: str) -> list[str]:
        found = system.get_file_info(pa.fs.FileSelector(f"{root}/ticker={ticker}", allow_not_found=True))
        return sorted(f.base_name.removeprefix("month=") for f in found if f.type == pa.fs.FileType.Directory and f.base_name.startswith("month="))

    def partitions(self) -> list[Span]:
        """Spans of the months that hold a day that is asked for; a ticker without any month gets an empty one."""
        system, root = self._system()
        listed = self.expected
        if listed is None:
            listed = sorted(f.base_name.removeprefix("ticker=") for f in system.get_file_info(pa.fs.FileSelector(root)) if f.base_name.startswith("ticker="))
        out = []
        for ticker in listed if self.first <= self.last else []:
            if self.tickers is not None and ticker not in self.tickers:
                continue
            months = self._months(system, root, ticker)
            if not months:
                out.append(Span(ticker, (), self.first, self.last))
            asked = [m for m in months if f"{self.first:%Y-%m}" <= m <= f"{self.last:%Y-%m}"]
            for k in range(0, len(asked), self.months):
                some = asked[k : k + self.months]
                low, high = (dt.date(int(m[:4]), int(m[5:7]), 1) for m in (some[0], some[-1]))
                end = high.replace(day=calendar.monthrange(high.year, high.month)[1])
                out.append(Span(ticker, tuple(f"ticker={ticker}/month={m}" for m in some), max(self.first, low), min(self.last, end)))
        return out

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:  # nothing is asked for
            return
        rows, reason = [], None
        try:
            rows = self._rows(span)
        except Refused as e:
            reason = str(e)
        except (OSError, UnicodeDecodeError):
            reason = "unreadable"
        if reason is not None:
            rows = [(span.first if span.first > dt.date.min else None, None, None)]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([
            pa.array([span.ticker] * len(rows), pa.string()), pa.array(columns[0], pa.date32()), pa.array(columns[1], pa.float64()),
            pa.array(columns[2], pa.float64()), pa.array([reason] * len(rows), pa.string()),
        ], names=["ticker", "date", "open", "close", "reason"])

    def _rows(self, span: Span) -> list[tuple]:
        if not span.files:
            raise Refused("missing")
        system, root = self._system()
        found = []
        for folder in span.files:
            for f in system.get_file_info(pa.fs.FileSelector(f"{root}/{folder}")):
                if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", ".")):
                    with system.open_input_stream(f.path) as stream:
                        found += rows_of(stream.read().decode(), self.digits)
        found = sorted(r for r in found if span.first <= r[0] <= span.last)
        if any(a[0] == b[0] for a, b in zip(found, found[1:])):
            raise Refused("duplicate_dates")
        return found


class DayFiles(DataSource):
    """Options: ``path``; ``tickers`` that are expected, with commas (those that are there); ``digits`` of prices (2); ``months`` of a partition (12)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DayFilesReader:
        return DayFilesReader(self.options)


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """ticker, date, open, close of landed files, with rows of a reason for what couldn't be read.

    Comes in a session of its own, in which filters are pushed to the source;
    so bounds on date and ticker decide which files are listed and opened, and
    a row with a reason, dated by the first day asked for of its partition,
    passes them like the rows that it stands for.
    """
    session = spark.newSession()
    session.conf.set(PUSHDOWN, "true")
    session.dataSource.register(DayFiles)
    return session.read.format(NAME).options(path=path, **{k: ",".join(v) if isinstance(v, (list, tuple)) else str(v) for k, v in options.items()}).load()


def land(bars: DataFrame, path: str) -> None:
    """Writes ticker, date, open, close as day files, one for each ticker and month."""
    text = lambda c: F.col(c).cast("string")
    fields: list[Column] = [F.date_format("date", "yyyyMMdd").alias("BAS_DD"), text("open").alias("TDD_OPNPRC"), text("close").alias("TDD_CLSPRC")]
    # A month of one ticker has 31 rows at most.
    months = bars.groupBy("ticker", F.date_format("date", "yyyy-MM").alias("month")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("OutBlock_1"))
    months.select("ticker", "month", F.to_json(F.struct("OutBlock_1")).alias("value")).write.partitionBy("ticker", "month").text(path)
