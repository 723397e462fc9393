"""Statement-level change batches: upserts, deletes, and triggers as handlers over the sets `inserted` and `deleted`."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sqltext import translate_query
from ..sqltext.tokens import text_of, tokenize


def _same(key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"t.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in key])


def upsert(target: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """target with rows of changes replaced or added by key; null keys are equal.

    Of several changes for one key the last by `order` counts; without an order they are an error when the rows are read.
    """
    same = W.partitionBy(*key)
    if order:
        changes = changes.withColumn("__r", F.row_number().over(same.orderBy(*[F.col(c).desc_nulls_last() for c in order]))).filter("__r = 1")
    else:
        only = F.assert_true(F.col("__n") == 1, F.lit("several changes for one key: give their order"))
        changes = changes.withColumn("__n", F.count("*").over(same)).filter(only.isNull())
    kept = target.alias("t").join(changes.select(*key).alias("c"), _same(key), "left_anti").select(*target.columns)
    return kept.unionByName(changes.select(*target.columns))


def delete(target: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """target without the rows of these keys; null keys are equal."""
    return target.alias("t").join(keys.select(*key).distinct().alias("c"), _same(key), "left_anti").select(*target.columns)


@dataclass
class Handler:
    """A trigger: for these events ('INSERT', 'UPDATE', 'DELETE'), what it does. timing INSTEAD replaces the write."""

    events: frozenset[str]
    action: Callable[[ChangeBatch], None]
    timing: str = "AFTER"


@dataclass
class ChangeBatch:
    """One statement's change to a table: inserted and deleted rows, and rows that handlers add to other tables."""

    table: str
    event: str
    inserted: DataFrame
    deleted: DataFrame
    added: dict[str, DataFrame] = field(default_factory=dict)
    depth: int = 0

    def add(self, table: str, rows: DataFrame) -> None:
        self.added[table] = self.added[table].unionByName(rows) if table in self.added else rows

    def sql(self, query: str, dialect: str = "tsql") -> DataFrame:
        """A query of the trigger's body over inserted and deleted. Only these two tables are put in, never parts of names or strings."""
        text, _ = translate_query(query, dialect, "spark") if dialect != "spark" else (query, [])
        return self.inserted.sparkSession.sql(with_pseudo_tables(text), inserted=self.inserted, deleted=self.deleted)

    def then(self, target: DataFrame, change: ChangeBatch, key: Sequence[str], handlers: Sequence[Handler]) -> DataFrame:
        """What a handler does to another table, with that table's handlers, one level deeper; returns the table after it."""
        change.depth = self.depth + 1
        after, added = apply_change(target, change, key, handlers)
        for table, rows in added.items():
            self.add(table, rows)
        return after


#: Words that follow a table's name in a FROM clause and are no alias.
_NO_ALIAS = frozenset("ON WHERE JOIN INNER LEFT RIGHT FULL CROSS OUTER GROUP ORDER HAVING UNION INTERSECT EXCEPT LIMIT LATERAL WINDOW NATURAL USING".split())


def with_pseudo_tables(query: str) -> str:
    """The query with placeholders where inserted and deleted stand as tables; without an alias they get their own name as one."""
    out, tokens, listed = [], tokenize(query), False
    for i, t in enumerate(tokens):
        if t.upper in ("FROM", "JOIN"):
            listed = True
        elif t.upper in ("WHERE", "ON", "GROUP", "ORDER", "SELECT", "HAVING", "SET"):
            listed = False
        before, behind = tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None
        is_table = t.kind in ("word", "quoted") and t.name.lower() in ("inserted", "deleted") and before is not None and (before.upper in ("FROM", "JOIN") or before.text == "," and listed)
        if is_table:
            aliased = behind is not None and (behind.upper == "AS" or behind.kind in ("word", "quoted") and behind.upper not in _NO_ALIAS)
            text = f"{{{t.name.lower()}}}" + ("" if aliased else f" AS {t.name.lower()}")
            t = replace(t, text=text)
        out.append(t)
    return text_of(out)


#: Changes that handlers cause nest at most so deep.
MAX_DEPTH = 32


def apply_change(target: DataFrame, batch: ChangeBatch, key: Sequence[str], handlers: Sequence[Handler] = ()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(the table after the statement, rows added to other tables). A handler that raises aborts the whole batch."""
    if batch.depth > MAX_DEPTH:
        raise RecursionError(f"changes of {batch.table} nest deeper than {MAX_DEPTH}")
    mine = [h for h in handlers if batch.event in h.events]
    instead = [h for h in mine if h.timing == "INSTEAD"]
    after = target
    if not instead:
        after = delete(target, batch.deleted, key) if batch.event != "INSERT" else target
        after = after.unionByName(batch.inserted.select(*target.columns)) if batch.event != "DELETE" else after
    for h in instead or mine:
        h.action(batch)
    return after, batch.added


def insert_batch(table: str, rows: DataFrame) -> ChangeBatch:
    return ChangeBatch(table, "INSERT", rows, rows.limit(0))


def update_batch(table: str, target: DataFrame, rows: DataFrame, key: Sequence[str]) -> ChangeBatch:
    return ChangeBatch(table, "UPDATE", rows, target.join(rows.select(*key), list(key), "left_semi"))


def delete_batch(table: str, target: DataFrame, keys: DataFrame, key: Sequence[str]) -> ChangeBatch:
    gone = target.join(keys.select(*key), list(key), "left_semi")
    return ChangeBatch(table, "DELETE", gone.limit(0), gone)


def changed_columns(batch: ChangeBatch, key: Sequence[str]) -> DataFrame:
    """(key, column_name, old_value, new_value) for an update."""
    values = [c for c in batch.inserted.columns if c not in key]
    new = batch.inserted.select(*key, *[F.col(c).cast("string").alias(f"__n_{c}") for c in values])
    old = batch.deleted.select(*key, *[F.col(c).cast("string").alias(f"__o_{c}") for c in values])
    joined = new.alias("t").join(old.alias("c"), _same(key)).select(*[F.col(f"t.`{k}`").alias(k) for k in key], *[F.col(f"__n_{c}") for c in values], *[F.col(f"__o_{c}") for c in values])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"__o_{c}").alias("old_value"), F.col(f"__n_{c}").alias("new_value")) for c in values]
    flat = joined.select(*key, F.explode(F.array(*cells)).alias("x")).select(*key, "x.*")
    return flat.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
