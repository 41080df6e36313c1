"""Typed records out of JSON text, and what was refused with its reason: every row is in exactly one of both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("number", "date", "text")


@dataclass(frozen=True)
class Field:
    """A field, its kind, the names it goes by (the first that is there counts) and whether a record needs it."""

    name: str
    kind: str = "text"
    aliases: tuple[str, ...] = ()
    required: bool = True
    pattern: str = "yyyy-MM-dd"


def with_aliases(fields: Sequence[Field], aliases: DataFrame) -> list[Field]:
    """Fields with the names of a table (field, alias, rank), which is a list made by hand."""
    found: dict[str, list[str]] = {}
    for r in aliases.orderBy("field", "rank").collect():
        found.setdefault(r["field"], []).append(r["alias"])
    return [Field(f.name, f.kind, tuple(found.get(f.name, f.aliases)), f.required, f.pattern) for f in fields]


def _text(document: str, field: Field) -> Column:
    """The first of the field's names that holds a value, as text; objects and lists stay JSON."""
    names = field.aliases or (field.name,)
    paths = ["$['" + n.replace("'", "\\'") + "']" for n in names]
    return F.coalesce(*[F.try_variant_get(document, p, "string") for p in paths])


def _value(text: Column, field: Field) -> Column:
    if field.kind == "number":
        number = F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    if field.kind == "date":
        return F.try_to_date(F.trim(text), field.pattern) if hasattr(F, "try_to_date") else F.trim(text).try_cast("date")
    return text


def parsed(df: DataFrame, column: str, fields: Sequence[Field]) -> DataFrame:
    """The rows with their fields, and ``errors``: a list of (field, code), empty where the record holds.

    A document ends where its value does: what follows it isn't looked at.
    Codes: ``no_document`` (null or blank), ``invalid_json``, ``not_an_object``
    for the whole (field null); ``missing`` for a required field that is
    absent, null or blank; ``invalid_number`` and ``invalid_date`` for one
    that is there and can't be read, required or not.  Fields of a refused
    record keep what could be read.
    """
    if any(f.kind not in KINDS for f in fields):
        raise ValueError(f"kinds are {KINDS}")
    document = df.withColumn("__doc", F.try_parse_json(F.col(column)))
    text = {f.name: _text("__doc", f) for f in fields}
    texts = document.withColumn("__text", F.struct(*[F.nullif(F.trim(t), F.lit("")).alias(n) for n, t in text.items()]))
    values = texts.withColumn("__value", F.struct(*[_value(F.col(f"__text.`{f.name}`"), f).alias(f.name) for f in fields]))
    blank = F.col(column).isNull() | (F.trim(column) == "")
    whole = F.when(blank, "no_document").when(F.col("__doc").isNull(), "invalid_json").when(~F.startswith(F.schema_of_variant("__doc"), F.lit("OBJECT")), "not_an_object")
    found = values.withColumn("__whole", whole)
    error = lambda name, code: F.array(F.struct(F.lit(name).cast("string").alias("field"), code.alias("code")))
    none = F.array().cast("array<struct<field: string, code: string>>")
    own = []
    for f in fields:
        t, v = F.col(f"__text.`{f.name}`"), F.col(f"__value.`{f.name}`")
        wrong = F.when(t.isNotNull() & v.isNull(), error(f.name, F.lit(f"invalid_{f.kind}"))).otherwise(none)
        own.append(F.when(t.isNull(), error(f.name, F.lit("missing"))).otherwise(wrong) if f.required else wrong)
    errors = F.when(F.col("__whole").isNotNull(), error(None, F.col("__whole"))).otherwise(F.concat(none, *own))
    # A list of one, taken apart: conditions on what it holds stay above it, else the whole would be parsed anew at each place that they name.
    made = F.struct(*[F.col(f"__value.`{f.name}`").alias(f.name) for f in fields], F.col("__errors").alias("errors"))
    return found.withColumn("__errors", errors).select(*df.columns, F.inline(F.array(made)))


def accepted(rows: DataFrame) -> DataFrame:
    """Records without errors."""
    return rows.where(F.size("errors") == 0).drop("errors")


def refused(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each refused value: the keys, field and code."""
    return rows.where(F.size("errors") > 0).select(*keys, F.explode("errors").alias("e")).select(*keys, "e.field", "e.code")
