"""Comparing two sides: objects, row counts, rows by key, rows by position, whole tables by fingerprint."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import canonical
from ..storage import written

MATCH, DIFFERENT, SOURCE_ONLY, TARGET_ONLY = "match", "different", "source_only", "target_only"
ALGORITHM = "tarnbridge-row-multiset-sha256-1"


def _by_lower(df: DataFrame) -> dict[str, str]:
    return {c.lower(): c for c in df.columns}


def common_columns(source: DataFrame, target: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """(common in the source's order, only in source, only in target), whatever their case."""
    s, t = _by_lower(source), _by_lower(target)
    return [c for c in s if c in t], [s[c] for c in s if c not in t], [t[c] for c in t if c not in s]


def has_shared_key(key: Sequence[str], source: DataFrame, target: DataFrame) -> bool:
    common = set(common_columns(source, target)[0])
    return bool(key) and all(k.lower() in common for k in key)


def _status(in_source: Column, in_target: Column, same: Column) -> Column:
    return F.when(in_target.isNull(), SOURCE_ONLY).when(in_source.isNull(), TARGET_ONLY).when(same, MATCH).otherwise(DIFFERENT)


def pair(source: DataFrame, target: DataFrame) -> DataFrame:
    """Two metadata frames (section, key, definition) as (section, key, status, source_definition, target_definition)."""
    s = source.select("section", "key", F.col("definition").alias("source_definition"), F.lit(True).alias("__s"))
    t = target.select("section", "key", F.col("definition").alias("target_definition"), F.lit(True).alias("__t"))
    same = F.col("source_definition").eqNullSafe(F.col("target_definition"))
    return s.join(t, ["section", "key"], "full_outer").select("section", "key", _status(F.col("__s"), F.col("__t"), same).alias("status"), "source_definition", "target_definition")


def tally(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return compared.groupBy(*by, "status").agg(F.count("*").alias("n"))


def all_match(compared: DataFrame) -> bool:
    return compared.filter(F.col("status") != MATCH).isEmpty()


def _sides(source: DataFrame, target: DataFrame, key: Sequence[str], columns: Sequence[str] | None) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    keys = [k.lower() for k in key]
    common = [c for c in (columns or common_columns(source, target)[0]) if c.lower() not in keys]
    values = [c.lower() for c in common]

    def side(df: DataFrame, mark: str) -> DataFrame:
        names = _by_lower(df)
        cols = [canonical(F.col(f"`{names[c]}`"), df.schema[names[c]].dataType).alias(f"{mark}_{c}") for c in values]
        return df.select(*[F.col(f"`{names[k]}`").alias(k) for k in keys], *cols, F.lit(True).alias(f"__{mark}"))

    return side(source, "source"), side(target, "target"), keys, values


def row_diff(source: DataFrame, target: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of both sides by key: (key, status, source_<c>, target_<c>, changed: names of the columns that differ).

    One full outer join. Values are compared in canonical form; null equals null. Keys are compared as they are; a null
    in a key matches a null.
    """
    s, t, keys, values = _sides(source, target, key, columns)
    on = reduce(lambda a, b: a & b, [s[k].eqNullSafe(t[k]) for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(f"source_{c}").eqNullSafe(F.col(f"target_{c}")) for c in values], F.lit(True))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"source_{c}").eqNullSafe(F.col(f"target_{c}")), F.lit(c)) for c in values])) if values else F.array().cast("array<string>")
    status = _status(F.col("__source"), F.col("__target"), same)
    joined = s.join(t, on, "full_outer")
    out = [F.when(F.col("__source"), s[k]).otherwise(t[k]).alias(k) for k in keys]
    return joined.select(*out, status.alias("status"), *[f"source_{c}" for c in values], *[f"target_{c}" for c in values], F.when(status == DIFFERENT, changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def number_rows(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """df with each row's place from 1 on in the order of `order`, without bringing all rows to one task.

    Rows are dealt by ranges and written with their place in their range; only then are ranges counted, so that sizes and
    places come from the same deal. The sizes (one row a range, 4096 at most) are summed. Rows of equal order get
    different places. An empty table stays empty.
    """
    parts = max(1, min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # the identifier holds the partition above 33 bits and the row below
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(ranged).withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sized = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sized.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before", "__at")


def positional_diff(source: DataFrame, target: DataFrame, source_order: Sequence[str], target_order: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a shared key, by their places in an order: (position, status, ...), as row_diff."""
    cols = list(columns or common_columns(source, target)[0])
    return row_diff(number_rows(source, source_order), number_rows(target, target_order or source_order), ["position"], cols)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) in one job."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def compare_counts(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """(table_name, source_n, target_n, status). A table that one side lacks never matches."""
    s, t = row_counts(source).withColumnRenamed("n", "source_n"), row_counts(target).withColumnRenamed("n", "target_n")
    return s.join(t, "table_name", "full_outer").select("table_name", "source_n", "target_n", _status(F.col("source_n"), F.col("target_n"), F.col("source_n") == F.col("target_n")).alias("status"))


def with_total(counts: DataFrame) -> DataFrame:
    return counts.union(counts.agg(F.lit("TOTAL"), F.sum("n")))


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row as one text: each value with its length before it, null as a dash, so that different rows have different texts."""
    names = _by_lower(df)
    cells = [canonical(F.col(f"`{names[c.lower()]}`"), df.schema[names[c.lower()]].dataType) for c in (columns or df.columns)]
    return F.concat(*[F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]) if cells else F.lit("")


def fingerprint_parts(df: DataFrame, columns: Sequence[str] | None = None, text: Column | None = None) -> DataFrame:
    """One row: n, and eight sums and eight exclusive ors of the 32-bit parts of the rows' SHA-256. Two-phase aggregation, no order."""
    digest = F.sha2(text if text is not None else row_text(df, columns), 256)
    parts = df.select(digest.alias("h")).select(*[F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"p{i}") for i in range(8)])
    # sums of halves of 16 bits fit in a long up to 2 ** 47 rows; the total is put together once
    halves = [F.sum(x).alias(f"{end}{i}") for i in range(8) for end, x in (("high", F.shiftright(f"p{i}", 16)), ("low", F.col(f"p{i}").bitwiseAND(F.lit(0xFFFF))))]
    counted = parts.agg(F.count("*").alias("n"), *halves, *[F.coalesce(F.bit_xor(f"p{i}"), F.lit(0)).alias(f"xor{i}") for i in range(8)])
    total = lambda i: (F.coalesce(f"high{i}", F.lit(0)).cast("decimal(20,0)") * F.lit(65536) + F.coalesce(f"low{i}", F.lit(0))).cast("decimal(38,0)")
    return counted.select("n", *[total(i).alias(f"sum{i}") for i in range(8)], *[f"xor{i}" for i in range(8)])


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, text: Column | None = None) -> DataFrame:
    """(n, digest): one row, equal for equal multisets of rows in any order."""
    parts = fingerprint_parts(df, columns, text)
    return parts.select("n", F.sha2(F.concat_ws("|", F.lit(ALGORITHM), *[F.col(c).cast("string") for c in parts.columns]), 256).alias("digest"))


def verify_table(source: DataFrame, target: DataFrame, key: Sequence[str] = ()) -> dict:
    """Whether both sides hold the same rows: exact only where neither has columns of its own."""
    common, only_s, only_t = common_columns(source, target)
    s, t = fingerprint(source, common).first(), fingerprint(target, common).first()
    same = tuple(s) == tuple(t)
    return {"algorithm": ALGORITHM, "common_columns": common, "source_only_columns": only_s, "target_only_columns": only_t, "has_shared_key": has_shared_key(key, source, target), "source_rows": s["n"], "target_rows": t["n"], "rows_match": same, "exact_match": same and not only_s and not only_t}


def page(df: DataFrame, order: Sequence[str], number: int, size: int = 50) -> DataFrame:
    """Page `number` (from 1) by order; size is held to 1..100. Without an order all columns order the rows."""
    size = max(1, min(100, size))
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in (order or df.columns)]).offset((max(1, number) - 1) * size).limit(size)


def after_key(df: DataFrame, key: Sequence[str], last: Sequence[object] | None, size: int) -> DataFrame:
    """The next `size` rows behind key values `last`: the lexicographic condition in the form that sources can push down. Nulls come first."""
    if last is not None:
        cond = F.lit(False)
        for i in range(len(key)):
            equal = reduce(lambda a, b: a & b, [F.col(k).isNull() if v is None else F.col(k) == F.lit(v) for k, v in zip(key[:i], last[:i], strict=True)], F.lit(True))
            behind = F.col(key[i]).isNotNull() if last[i] is None else F.col(key[i]) > F.lit(last[i])
            cond = cond | (equal & behind)
        df = df.filter(cond)
    return df.orderBy(*[F.col(k).asc_nulls_first() for k in key]).limit(size)


def diff_page(source: DataFrame, target: DataFrame, key: Sequence[str], number: int, size: int = 50) -> DataFrame:
    """A page of the row diff over the joined keys, so that missing rows do not shift it."""
    return page(row_diff(source, target, key), [k.lower() for k in key], number, size)
