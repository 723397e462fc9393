"""Moving a whole database: tables in dependency order, rejects kept aside, then its other objects; constraints checked, counts compared."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..model import Catalog, Relation
from ..operators.load import cast_with_rejects, copied_columns, sample_rejects, with_computed
from ..operators.quality import violations
from ..operators.verify import compare_counts
from ..sqltext.tokens import text_of, tokenize
from ..types import to_spark
from .ddl import ORDER, Step, plan_ddl


@dataclass
class ObjectResult:
    kind: str
    name: str
    status: str  # success, failed, skipped
    detail: str = ""
    rows: int | None = None
    rejected: int | None = None
    seconds: float = 0.0


@dataclass
class Report:
    results: list[ObjectResult] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    counts: list[dict] = field(default_factory=list)
    rejects: dict[str, list[dict]] = field(default_factory=dict)
    violations: list[dict] = field(default_factory=list)
    cancelled: bool = False

    @property
    def success(self) -> bool:
        """No failed or skipped object, every count compared and equal but for rejected rows, no broken constraint."""
        return not self.cancelled and not any(r.status in ("failed", "skipped") for r in self.results) and all(c["status"] == "match" for c in self.counts) and not any(v["n"] for v in self.violations)

    def summary(self) -> dict:
        by = {s: sum(r.status == s for r in self.results) for s in ("success", "failed", "skipped")}
        return {**by, "tables": sum(r.kind == "table" for r in self.results), "rows": sum(r.rows or 0 for r in self.results), "rejected": sum(r.rejected or 0 for r in self.results), "warnings": len(self.warnings), "success": self.success}

    def errors_frame(self, spark: SparkSession, job: str) -> DataFrame:
        """(job, kind, name, detail): writing it over the rows of the same job makes a second run repeat nothing."""
        return spark.createDataFrame([(job, r.kind, r.name, r.detail) for r in self.results if r.status == "failed"], "job string, kind string, name string, detail string")


class Cancelled(Exception):
    pass


def worker_count() -> int:
    """min(4, half the cores), at least 1; MIGRATION_WORKERS overrides."""
    said = os.environ.get("MIGRATION_WORKERS", "")
    return max(1, int(said)) if said.isdigit() else max(1, min(4, (os.cpu_count() or 2) // 2))


def copy_table(source, target, table: Relation, db: Catalog) -> tuple[DataFrame, DataFrame, list[str]]:
    """Reads, casts and writes one table; returns (written rows, rejects, warnings)."""
    names, warnings = copied_columns(table, db.dialect)
    types = {n: to_spark(table.field(n).native, db.dialect)[0] for n in names}
    good, rejects = cast_with_rejects(source.table(table.name).select(*names), types, [c.name for c in table.fields if not c.nullable and c.name in names])
    target.write(table.name, with_computed(good, table, db.dialect), table)
    return target.table(table.name), rejects, warnings


#: Schemas whose names Spark does not need: their objects go to the target's own namespace.
DEFAULT_SCHEMAS = ("dbo", "public")


def _without_default_schemas(sql: str) -> tuple[str, set[str]]:
    """The statement with names of default schemas left unqualified, and all its names in lower case."""
    tokens, out, i = tokenize(sql), [], 0
    while i < len(tokens):
        t, spaced = tokens[i], tokens[i].spaced
        qualifies = i + 2 < len(tokens) and tokens[i + 1].text == "." and not (i and tokens[i - 1].text == ".")
        if qualifies and t.kind in ("word", "quoted") and t.name.lower() in DEFAULT_SCHEMAS:
            i += 2
            t = replace(tokens[i], spaced=spaced)
        out.append(t)
        i += 1
    return text_of(out), {t.name.lower() for t in tokens if t.kind in ("word", "quoted")}


def apply_objects(target, db: Catalog, absent: set[str]) -> list[ObjectResult]:
    """Creates what is not a table: schemas, views, synonyms, routines, in the order of the plan, each with its own result.

    absent: tables that were not copied. What names one of them, or an object that failed, is skipped, as are objects that
    the target cannot hold. A view that rests on a later one is tried again until nothing more succeeds.
    """
    steps, results, gone = plan_ddl(db, "spark")[0], {}, {n.rsplit(".", 1)[-1].lower() for n in absent}
    todo = [x for x in steps if x.kind != "table"]
    planned = {(x.kind, x.name) for x in todo}
    others = [("view", v.name, "its query was not translated") for v in db.views] + [("synonym", e.name, f"a {e.target_kind or 'table'} has no other name here") for e in db.entries_of("synonym")]
    others += [("routine", c.name, "its body was not translated") for c in db.routines] + [("trigger", c.name, "it runs as a change handler") for c in db.triggers] + [("sequence", e.name, "identities go on from the largest value") for e in db.entries_of("sequence")]
    for kind, name, why in others:
        if (kind, name) not in planned:
            results[kind, name] = ObjectResult(kind, name, "skipped", why)
    if not hasattr(target, "execute"):
        return [*results.values(), *(ObjectResult(x.kind, x.name, "skipped", "the target takes tables only") for x in todo if x.kind != "schema")]
    while todo:
        later: list[Step] = []
        for x in todo:
            sql, names = _without_default_schemas(x.sql)
            own = x.name.rsplit(".", 1)[-1].lower()
            if missing := sorted((names - {own}) & gone):
                results[x.kind, x.name] = ObjectResult(x.kind, x.name, "skipped", f"{', '.join(missing)} is not there")
                gone.add(own)
                continue
            began = time.monotonic()
            try:
                target.execute(sql)
                results[x.kind, x.name] = ObjectResult(x.kind, x.name, "success", seconds=time.monotonic() - began)
            except Exception as e:  # the other objects go on
                results[x.kind, x.name] = ObjectResult(x.kind, x.name, "failed", str(e).split("\n")[0], seconds=time.monotonic() - began)
                later.append(x)
        if len(later) == len(todo):
            break
        todo = later
    return sorted(results.values(), key=lambda r: ORDER.index(r.kind))


def run_migration(spark: SparkSession, source, target, db: Catalog, workers: int | None = None, progress: Callable[[str, float], None] | None = None, cancelled: Callable[[], bool] = lambda: False, reset: bool = False, objects: bool = True) -> Report:
    """Copies every table of the model from source to target, creates its other objects, and proves the result.

    Tables are copied side by side by driver threads, each in a scheduler pool of its own. With objects, views, synonyms
    and routines follow; the report has a result for each object, and one that was not created makes the run no success.
    """
    report = Report()
    report.warnings = plan_ddl(db, "spark")[1]
    order, done, lock = db.by_dependency(), [0], threading.Lock()
    have = set(source.table_names())
    if reset:
        for t in reversed(order):
            target.drop(t.name)

    def one(table: Relation) -> None:
        began = time.monotonic()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"copy of {table.name}")
        if cancelled():
            with lock:
                report.cancelled = True
                report.results.append(ObjectResult("table", table.name, "skipped", "cancelled"))
            return
        if table.name not in have:
            with lock:
                report.results.append(ObjectResult("table", table.name, "skipped", "not in the source"))
            return
        try:
            written, rejects, warnings = copy_table(source, target, table, db)
            sample = [r.asDict() for r in sample_rejects(rejects).collect()]
            bad = rejects.count() if sample else 0
            result = ObjectResult("table", table.name, "success", "", written.count(), bad)
        except Exception as e:  # the other tables go on
            result, sample, warnings = ObjectResult("table", table.name, "failed", str(e).split("\n")[0]), [], []
        result.seconds = time.monotonic() - began
        with lock:
            report.results.append(result)
            report.warnings += [w for w in warnings if w not in report.warnings]
            if sample:
                report.rejects[table.name] = sample
            done[0] += 1
            if progress:
                progress(table.name, 100 * done[0] / max(1, len(order)))

    with ThreadPoolExecutor(workers or worker_count()) as pool:
        list(pool.map(one, order))
    good = {r.name: r for r in report.results if r.status == "success"}
    if good and not report.cancelled:
        rejected = {n: r.rejected or 0 for n, r in good.items()}
        for row in compare_counts({n: source.table(n) for n in good}, {n: target.table(n) for n in good}).collect():
            d = row.asDict()
            if d["status"] != "match" and d["source_n"] == (d["target_n"] or 0) + rejected[d["table_name"]] and rejected[d["table_name"]]:
                d["status"] = "rejected_rows"
            report.counts.append(d)
        if len(good) == len(db.tables) and any(t.rules for t in db.tables):
            report.violations = [r.asDict() for r in violations({n: target.table(n) for n in good}, db).collect()]
    if objects and not report.cancelled:
        report.results += apply_objects(target, db, {t.name for t in db.tables} - set(good))
    return report
