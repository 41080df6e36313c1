"""Line dedup over levelled sorted runs of line keys."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fluxlens.llm.common import by_texts, quoted, shared_dir, texts_of, written

BLANK = b" \t\n\x0b\x0c\r"
#: Keys of a batch, about: a larger corpus has more batches, not larger ones.
BATCH_KEYS = 1 << 28


def key_of(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def hash_of(key: bytes) -> bytes:
    """128 bits of a key: two different keys of even 10^15 hardly ever share them."""
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame, row_key, *, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """(row, key) once for each distinct key of at least ``min_chars`` code points in each row."""

    def keys(batch) -> dict:
        rows, hashes = [], []
        for row, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
            found = {k for k in map(key_of, text.encode().split(b"\n")) if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars)}
            rows += [row] * len(found)
            hashes += map(hash_of, found)
        return {"row": rows, "key": hashes}

    return by_texts(docs, [row_key.alias("row"), F.col(text_col).alias("text")], keys, "row long, key binary")


class LineRuns:
    """Levelled sorted runs of line keys, which tell the keys that enough documents have.

    A run is a table of (key, docs), bucketed by key and sorted in each
    bucket, so that runs are merged and anti-joined bucket by bucket without
    being shuffled.  A new batch is shuffled once, to its buckets; keys that a
    run of frequent ones has are anti-joined out of it, as nothing about them
    is open any more, and what is left becomes a run of level 0.  When a level
    holds ``fanout`` runs they are merged, adding up their documents: keys
    that reach ``min_docs`` make a frequent run, the others one run of the
    next level.  So there are at most ``fanout - 1`` open runs in each of a
    logarithmic number of levels; frequent runs, whose keys are all different,
    are levelled in the same way, so a batch meets a logarithmic number of
    those too.  Runs lie in the shared folder: a lost executor loses none.
    ``close`` drops the tables' names, also after a failure.
    """

    def __init__(self, spark: SparkSession, *, min_docs: int = 10, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._name = f"line_runs_{uuid.uuid4().hex}"
        self._path = f"{shared_dir(spark)}/fluxlens/{self._name}"
        self.levels: list[list[str]] = []
        self.settled: list[list[str]] = []
        self._made = 0

    @property
    def frequent(self) -> list[str]:
        """The runs of frequent keys of all levels."""
        return [run for level in self.settled for run in level]

    def _run(self, counts: DataFrame) -> str:
        table = f"{self._name}_{self._made}"
        self._made += 1
        # Sums and merges are dealt by the hash that deals rows to buckets, so each bucket is one file.
        counts.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self._path}/{table}").format("parquet").saveAsTable(table)
        return table

    def _without_frequent(self, counts: DataFrame) -> DataFrame:
        for run in self.frequent:
            counts = counts.hint("merge").join(self.spark.table(run).hint("merge"), "key", "left_anti")
        return counts

    def _merged(self, runs: list[str]) -> DataFrame:
        """The sum of runs, by outer merge joins."""
        first, *others = runs
        total = self.spark.table(first)
        for run in others:
            more = self.spark.table(run).withColumnRenamed("docs", "more")
            total = total.hint("merge").join(more.hint("merge"), "key", "full").select("key", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
        return total

    def add(self, keys: DataFrame) -> None:
        """Adds the keys of a batch, a row for each document that has one, and compacts."""
        counts = keys.groupBy("key").agg(F.count("*").alias("docs"))
        self._place(self.levels, self._run(self._without_frequent(counts)), 0, self._compact)

    def _place(self, levels: list[list[str]], run: str, level: int, merge: Callable[[list[str]], str]) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) >= self.fanout:
            merged, levels[level] = merge(levels[level]), []
            self._place(levels, merged, level + 1, merge)

    def _compact(self, runs: list[str]) -> str:
        """Moves keys with enough documents to a frequent run; the run of the others."""
        total = self._without_frequent(self._merged(runs))
        often = self._run(total.where(F.col("docs") >= self.min_docs))
        rest = self._run(total.where(F.col("docs") < self.min_docs))
        self._place(self.settled, often, 0, lambda runs: self._run(self._merged(runs)))
        return rest

    def close(self) -> None:
        """Drops the tables' names; their files are those of the shared folder."""
        for k in range(self._made):
            self.spark.sql(f"drop table if exists {self._name}_{k}")

    def keys(self) -> DataFrame:
        """The keys that ``min_docs`` documents or more have; ends the runs."""
        open_ = [run for level in self.levels for run in level]
        if open_:
            self.levels = [[self._compact(open_)]]
        found = self.spark.createDataFrame([], "key binary")
        for run in self.frequent:
            found = found.unionAll(self.spark.table(run).select("key"))
        found = written(found, "frequent")
        self.close()
        return found

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The distinct keys of a batch that no run has."""
        counts = self._without_frequent(keys.select("key").distinct())
        for run in (run for level in self.levels for run in level):
            counts = counts.hint("merge").join(self.spark.table(run).hint("merge"), "key", "left_anti")
        return counts


def _together(columns: list[str]):
    """The columns in one, so that none clashes with an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in columns]) if columns else F.struct(F.lit(0).alias("none"))


def drop_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, keep_first: bool = False, keep_text: bool = False, text_col: str = "text") -> DataFrame:
    """Drops every line whose key is found in at least ``min_docs`` documents.

    The corpus is added to the runs (see :class:`LineRuns`) in ``batches``, or
    in as many as hold ``BATCH_KEYS`` keys each;
    keys that have proved frequent are joined to the documents that have them.
    Keys count once in a document and are summed before they are shuffled; a key in
    very many documents is spread by the engine's splitting of skewed joins.

    With ``keep_first`` one document, that of the smallest row hash, keeps
    such a line: of many copies of a text one stays whole.

    Returns the columns of ``docs``, or without ``keep_text`` all but the
    text, and n_lines, n_dropped, kept_sha256; an own column of such a name
    gives way.  Null and empty texts are one empty line and are kept (null as
    empty).  Each row counts as a document, repeated rows and rows without id
    too.  An empty table gives no rows.
    """
    outputs = ("n_lines", "n_dropped", "kept_sha256")
    others = [c for c in docs.columns if c != text_col and c not in outputs]
    rest = _together(others)
    # Rows that share a hash by chance only look for each other's frequent keys too.
    row_key = F.xxhash64(*[F.col(c) for c in docs.columns if c == "doc_id"], F.coalesce(F.col(text_col), F.lit("")))
    keys = written(line_keys(docs, row_key, min_chars=min_chars, text_col=text_col), "lines")
    runs = LineRuns(docs.sparkSession, min_docs=min_docs, fanout=fanout)
    batches = max(batches, -(-keys.count() // BATCH_KEYS))
    try:
        for k in range(batches):
            runs.add(keys.where(F.pmod("row", F.lit(batches)) == k))
        frequent = runs.keys()
    finally:
        runs.close()
    hits = keys.join(frequent, "key", "left_semi")
    if keep_first:
        first = written(hits.groupBy("key").agg(F.min("row").alias("first")), "first")
        hits = keys.join(first, "key").where("row <> first")
    found = hits.groupBy("row").agg(F.collect_set("key").alias("keys"))
    joined = docs.select(row_key.alias("row"), F.col(text_col).alias("text"), rest.alias("rest")).join(found, "row", "left")

    def drop(batch) -> dict:
        out = {"rest": batch.column(2), "text": []} | {c: [] for c in outputs}
        for text, frequent_keys in zip(texts_of(batch), batch.column(0).to_pylist()):
            raw = text.encode()
            lines = raw.split(b"\n")
            kept = lines
            if frequent_keys:
                gone = set(frequent_keys)
                kept = [x for x in lines if not (k := key_of(x)) or hash_of(k) not in gone]
            joined = b"\n".join(kept)
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
            out["text"].append(joined.decode() if keep_text else None)
        return out

    schema = StructType([StructField("rest", docs.select(rest).schema[0].dataType), StructField("text", StringType()), *[StructField(c, LongType()) for c in outputs[:2]], StructField(outputs[2], StringType())])
    done = by_texts(joined, ["keys", "text", "rest"], drop, schema)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.{quoted(c)}").alias(c) for c in docs.columns if c in others or (c == text_col and keep_text)], *outputs)


def without_repeated_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """The rows without lines of ``min_docs`` documents or more, but for one document of each such line.

    Rows of which no line is left go.  All columns stay, of whatever name and
    type; n_chars, where it is one, is counted again where lines went.
    """
    box = docs.select("text", *(["doc_id"] if "doc_id" in docs.columns else []), _together([c for c in docs.columns if c != "text"]).alias("box"))
    kept = drop_lines(box, min_docs=min_docs, min_chars=min_chars, batches=batches, keep_first=True, keep_text=True).where("n_dropped < n_lines")
    out = [F.col("text") if c == "text" else F.col(f"box.{quoted(c)}").alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("box.n_chars"))
        out[docs.columns.index("n_chars")] = counted.alias("n_chars")
    return kept.select(*out)
