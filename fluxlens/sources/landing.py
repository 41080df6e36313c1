"""Landing zones and sinks: JSON day files, a day cache, CSV and JSON documents."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; one of our own in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="fluxlens-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read from there: worked out once, and not lost with an executor."""
    path = f"{shared_folder(df.sparkSession)}/fluxlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_day_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the ``OutBlock_1`` arrays of JSON day files; entries that are no objects are dropped."""
    files = spark.read.option("multiLine", True).schema(f"OutBlock_1 array<struct<{schema}>>").json(path)
    return files.select(F.explode("OutBlock_1").alias("row")).where("row is not null").select("row.*")


def write_day_cache(df: DataFrame, path: str, boundary: str) -> None:
    """Writes days to a table partitioned by date; days from the boundary on are overwritten, older ones are left as they are."""
    fresh = df.where(F.col("date") >= F.lit(boundary).cast("date"))
    try:
        there = bool(df.sparkSession.read.parquet(path).columns)
    except AnalysisException:  # no table yet
        there = False
    target = fresh if there else df
    target.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, with a header, and a byte order mark before it in each file."""
    if df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json_whole(document: dict, path: str) -> int:
    """Writes a document beside its place and moves it there; returns its bytes.  NaN is refused."""
    text = json.dumps(document, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)
    return len(text.encode())


def write_documents_whole(documents: dict[str, dict]) -> dict[str, int]:
    """Writes several documents (by path) beside their places, and moves them there only when all are written; returns their bytes.

    If one can't be written, none is moved.
    """
    texts = {path: json.dumps(d, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":")).encode() for path, d in documents.items()}
    waiting = {}
    try:
        for path, text in texts.items():
            handle, waiting[path] = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
            with os.fdopen(handle, "wb") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
        for path in texts:
            os.replace(waiting.pop(path), path)
    finally:
        for name in waiting.values():
            os.unlink(name)
    return {path: len(text) for path, text in texts.items()}


def encode_columns(df: DataFrame, preferred: list[str], digits: int = 8) -> tuple[list[str], DataFrame]:
    """Column names, the preferred ones first and the others sorted, and (row,) arrays of their values as text; numbers rounded."""
    names = [c for c in preferred if c in df.columns] + sorted(c for c in df.columns if c not in preferred)
    kinds = dict(df.dtypes)
    return names, df.select(F.array(*[(F.round(c, digits) if kinds[c] == "double" else F.col(c)).cast("string") for c in names]).alias("row"))


def decode_columns(rows: DataFrame, names: list[str], types: dict[str, str]) -> DataFrame:
    """Rows of arrays as columns again; refuses repeated names, and fails on rows of another width."""
    if not names or len(set(names)) != len(names):
        raise ValueError("column names must be there, and differ")
    sound = F.when(F.size("row") == len(names), F.col("row")).otherwise(F.raise_error(F.lit("a row of another width")).cast("array<string>"))
    return rows.select(sound.alias("row")).select(*[F.get("row", F.lit(k)).try_cast(types.get(c, "string")).alias(c) for k, c in enumerate(names)])


def rebuilt(history: DataFrame, tickers: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames out of published rows of a day each: bars (date, close, trading_value), flows (date, individual_net_purchase), and prices (ticker, date, open, close).

    A ticker's open and close stand under ``p<ticker>Open`` and ``p<ticker>Close``;
    days on which it has neither are left out, one with only one of them is
    refused.  The net purchase is what its share and the trading value give.
    """
    bars = history.where("close is not null").select("date", "close", "trading_value")
    flows = history.where("flow_share is not null and trading_value is not null").select("date", (F.col("flow_share") * F.col("trading_value")).alias("individual_net_purchase"))
    legs = F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), F.col(f"p{t}Open").alias("open"), F.col(f"p{t}Close").alias("close")) for t in tickers])).alias("leg")
    prices = history.select("date", legs).select("leg.ticker", "date", "leg.open", "leg.close").where("open is not null or close is not null")
    whole = F.when(F.col("open").isNotNull() & F.col("close").isNotNull(), True).otherwise(F.raise_error(F.lit("half a bar")).cast("boolean"))
    return bars, flows, prices.where(whole)


def within_limits(sizes: dict[str, int], limits: dict[str, int]) -> list[str]:
    """Names of outputs that are larger than they may be."""
    return sorted(n for n, size in sizes.items() if size > limits.get(n, size))
