"""Loading: casts with rejects kept aside, computed columns, partitions, identities, and text for bulk import."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical
from ..model import Relation, Span
from ..sqltext import translate_expression
from ..types import to_spark
from .verify import number_rows

WIDE = ("max", "text", "ntext", "image", "xml", "json", "jsonb", "bytea", "varbinary")
REJECT_SAMPLE = 20


def batch_size(table: Relation) -> int:
    """25,000 rows a batch for JDBC; 5,000 for tables with long values."""
    return 5_000 if any(w in c.native.lower() for c in table.fields for w in WIDE) else 25_000


def copied_columns(table: Relation, dialect: str) -> tuple[list[str], list[str]]:
    """(columns that are copied, warnings): computed columns and those without a counterpart stay behind."""
    names, warnings = [], []
    for c in table.fields:
        kind, warning = to_spark(c.native, dialect)
        if kind is None:
            warnings.append(f"{table.name}.{c.name}: {warning}")
        elif not c.filled_by("computed"):
            names.append(c.name)
    return names, warnings


def cast_with_rejects(df: DataFrame, types: Mapping[str, T.DataType], not_null: Sequence[str] = (), checks: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): rows whose values fit, cast; and the others as (row_json, reason) with all reasons.

    A value does not fit if its cast gives null, if it is longer than its column, or if it is null where none may be.
    """
    reasons, out = [], []
    for f in df.schema:
        name, c = f.name, F.col(f"`{f.name}`")
        kind = types.get(name)
        if kind is None:
            out.append(c)
            continue
        sized = isinstance(kind, (T.VarcharType, T.CharType))
        cast = c.cast("string") if sized else c.try_cast(kind)
        reasons.append(F.when(c.isNotNull() & cast.isNull(), F.lit(f"{name}: not a {kind.simpleString()}")))
        if sized:
            reasons.append(F.when(F.char_length(cast) > kind.length, F.lit(f"{name}: longer than {kind.length}")))
        out.append(cast.alias(name))
    reasons += [F.when(F.col(f"`{n}`").isNull(), F.lit(f"{n}: null")) for n in not_null]
    reasons += [F.when(~cond, F.lit(f"check {n}")) for n, cond in (checks or {}).items()]
    reason = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    good = df.filter(reason == "").select(*out)
    rejects = df.filter(reason != "").select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("row_json"), reason.alias("reason"))
    return good, rejects


def with_computed(df: DataFrame, table: Relation, dialect: str) -> DataFrame:
    """Computed columns from their expressions, cast to their types."""
    integers = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType))]
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for c in table.fields:
        if rule := c.filled_by("computed"):
            kind, _ = to_spark(c.native, dialect)
            value = F.expr(translate_expression(rule.text, dialect, "spark", integers=integers, strings=strings)[0])
            df = df.withColumn(c.name, value.cast(kind) if kind else value)
    return df


def partition_of(column: Column, partitions: Sequence[Span]) -> Column:
    """The partition that a value falls in, by half-open ranges; null: a value outside all, or null."""
    out = F.lit(None).cast("string")
    for p in reversed(partitions):
        cond = F.lit(True) if p.low is None else column >= F.lit(p.low)
        cond = cond if p.high is None else cond & (column < F.lit(p.high))
        out = F.when(column.isNotNull() & cond, p.name).otherwise(out)
    return out


def range_right(table: str, boundaries: Sequence[object]) -> list[Span]:
    """n boundaries make n + 1 half-open ranges, the first and last unbounded."""
    edges = [None, *boundaries, None]
    return [Span(f"{table}_p{i}", lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False), 1)]


def with_identity(df: DataFrame, name: str, order: Sequence[str], start: int = 1, increment: int = 1) -> DataFrame:
    """Values of a sequence in the order of `order`, numbered without one task seeing all rows."""
    return number_rows(df, order, "__n").withColumn(name, F.lit(start) + F.lit(increment) * (F.col("__n") - 1)).drop("__n")


def next_identity(df: DataFrame, column: str) -> DataFrame:
    """One row: next_value, one more than the largest (1 in an empty table)."""
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("long").alias("next_value"))


def copy_text(df: DataFrame) -> DataFrame:
    r"""(line): rows as tab-separated text. Null is \N; backslash, tab, line feed and carriage return are escaped; bytes are \\x and hex."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            text = F.concat(F.lit("\\\\x"), F.lower(F.hex(c)))
        elif isinstance(f.dataType, T.BooleanType):
            text = F.when(c, "True").otherwise("False")
        elif isinstance(f.dataType, T.StringType):
            text = c
            for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                text = F.replace(text, F.lit(raw), F.lit(escaped))
        else:
            text = canonical(c, f.dataType)
        return F.when(c.isNull(), F.lit("\\N")).otherwise(text)

    return df.select(F.concat_ws("\t", *[cell(f) for f in df.schema]).alias("line"))


def sample_rejects(rejects: DataFrame, n: int = REJECT_SAMPLE) -> DataFrame:
    return rejects.orderBy("row_json").limit(n)


def latest(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(order))).filter("__r = 1").drop("__r")
