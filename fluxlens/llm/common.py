"""What the operators share: batches of texts, the shared folder, written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Words of the contracts: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text that are handled together in one worker.
BATCH_CHARS = 4_000_000
#: Bytes of a batch on its way to a worker; rows of long texts make the engine's default four times as large.
BATCH_BYTES = "16m"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where it is unset, as in local tests, a folder of our own is made and
    used for checkpoints too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = _own_dirs.get(spark.sparkContext.applicationId)
        if found is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = _own_dirs[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="fluxlens-")
    return found.rstrip("/")


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """The rows written as a table to the shared folder, and read from there.

    Cuts the lineage in a way that outlives the executors that did the work.
    """
    path = f"{shared_dir(df.sparkSession)}/fluxlens/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterable[pa.RecordBatch], text: int = 1, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of the text column, one row at least."""
    for batch in batches:
        start, held = 0, 0
        column = batch.column(text)
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for k, n in enumerate(sizes):
            if held and held + n > chars:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; batches of them are kept to ``BATCH_BYTES`` in this session, unless it says otherwise itself."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) in ("67108864b", "64m", "67108864"):
        conf.set(name, BATCH_BYTES)
    return df


def by_texts(df: DataFrame, columns: list, function: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """Maps slices of (columns...), of which the second is the text, to rows of the schema."""

    wanted = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            found = function(part)
            arrays = [v.cast(f.type) if isinstance(v := found[f.name], pa.Array) else pa.array(v, f.type) for f in wanted]
            yield pa.RecordBatch.from_arrays(arrays, schema=wanted)

    return small_batches(df.select(*columns)).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, at: int = 1) -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(at).to_pylist()]


def quoted(name: str) -> str:
    """A column's name, whatever characters it has, as column expressions take it."""
    return "`" + name.replace("`", "``") + "`"


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
