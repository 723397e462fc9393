"""Constraints as queries for rows that break them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Catalog
from ..sqltext import translate_expression


def duplicate_keys(df: DataFrame, key: Sequence[str], nulls_count: bool = False) -> DataFrame:
    """(key, n) of keys that come more than once. Rows with a null in the key count only if asked (a primary key's do)."""
    if not nulls_count:
        df = df.dropna(subset=list(key))
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def null_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def orphans(child: DataFrame, columns: Sequence[str], parent: DataFrame, ref_columns: Sequence[str]) -> DataFrame:
    """Rows of child without a parent; a null in the key is no orphan."""
    p = parent.select(*[F.col(r).alias(f"__{i}") for i, r in enumerate(ref_columns)]).distinct()
    return child.dropna(subset=list(columns)).join(p, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)]), "left_anti")


def check_violations(df: DataFrame, condition: str | Column, dialect: str = "spark") -> DataFrame:
    """Rows for which a check is false; unknown passes."""
    if isinstance(condition, str):
        bits = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
        condition = F.expr(translate_expression(condition, dialect, "spark", bits=bits)[0] if dialect != "spark" else condition)
    return df.filter(~condition)


def violations(tables: dict[str, DataFrame], db: Catalog) -> DataFrame:
    """(table_name, constraint_name, kind, n) for every constraint of the model, broken or not."""
    out = []
    for t in db.tables:
        df = tables[t.name]
        add = lambda name, kind, bad, t=t: out.append(bad.agg(F.count("*").alias("n")).select(F.lit(t.name).alias("table_name"), F.lit(name).alias("constraint_name"), F.lit(kind).alias("kind"), "n"))
        for r in t.of("primary"):
            add(r.name, "primary_key", duplicate_keys(df, r.fields, True))
            add(r.name, "not_null", null_keys(df, r.fields))
        for u in t.of("unique"):
            add(u.name, "unique", duplicate_keys(df, u.fields))
        for fk in t.of("foreign"):
            add(fk.name, "foreign_key", orphans(df, fk.fields, tables[fk.other], fk.other_fields))
        for c in t.of("check"):
            add(c.name, "check", check_violations(df, c.condition, db.dialect))
    return reduce(DataFrame.unionByName, out)
