"""A server's catalog as a model: listing queries for both servers, and the model from the rows they give.

Every listing gives one of the frames of FRAMES, whichever server it is from, so the model is made in one way. The rows
can come from anywhere: a JDBC endpoint, or files of an earlier listing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FACTS, Access, Catalog, Code, Entry, Field, Filling, Relation, Rule, Span
from ..plans.ddl import view_select
from ..sqltext.tokens import tokenize
from ..types import rebuild_type

#: What each frame holds. A row of fields, rules, accesses or spans is one part of its object, in the order of `ordinal`.
FRAMES = {
    "relations": "relation string, kind string, query string, split_by string, temporal boolean, graph boolean",
    "fields": "relation string, ordinal int, name string, native string, length int, digits int, scale int, nullable boolean, default string, start long, step long, computed string, stored boolean, collation string, note string",
    "rules": "relation string, kind string, name string, ordinal int, field string, condition string, other string, other_field string, on_delete string, on_update string",
    "accesses": "relation string, name string, ordinal int, field string, carried boolean, method string, filter string, is_unique boolean, clustered boolean",
    "spans": "relation string, ordinal int, name string, bounds string",
    "code": "kind string, name string, source string, relation string, timing string, events string",
    "entries": "kind string, name string, facts map<string,string>",
}

_PG_NAME = "n.nspname || '.' || c.relname"
_PG_OWN = "n.nspname NOT IN ('pg_catalog', 'information_schema', 'pg_toast')"
_MS_NAME = "SCHEMA_NAME(o.schema_id) + '.' + o.name"
#: Listing queries of both servers. Names of system views and their columns are fixed values.
LISTINGS = {
    "postgres": {
        "relations": f"SELECT {_PG_NAME} AS relation, CASE c.relkind WHEN 'v' THEN 'view' WHEN 'm' THEN 'stored_view' ELSE 'table' END AS kind, CASE WHEN c.relkind IN ('v', 'm') THEN pg_get_viewdef(c.oid) END AS query, CASE WHEN c.relkind = 'p' THEN pg_get_partkeydef(c.oid) END AS split_by, FALSE AS temporal, FALSE AS graph FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p', 'v', 'm') AND NOT c.relispartition AND {_PG_OWN}",
        "fields": f"SELECT {_PG_NAME} AS relation, a.attnum AS ordinal, a.attname AS name, format_type(a.atttypid, a.atttypmod) AS native, NULL::int AS length, NULL::int AS digits, NULL::int AS scale, NOT a.attnotnull AS nullable, CASE WHEN a.attgenerated = '' THEN pg_get_expr(d.adbin, d.adrelid) END AS default, CASE WHEN a.attidentity <> '' THEN s.seqstart END AS start, CASE WHEN a.attidentity <> '' THEN s.seqincrement END AS step, CASE WHEN a.attgenerated <> '' THEN pg_get_expr(d.adbin, d.adrelid) END AS computed, a.attgenerated = 's' AS stored, CASE WHEN a.attcollation <> t.typcollation THEN l.collname END AS collation, col_description(c.oid, a.attnum) AS note FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_type t ON t.oid = a.atttypid LEFT JOIN pg_attrdef d ON d.adrelid = c.oid AND d.adnum = a.attnum LEFT JOIN pg_collation l ON l.oid = a.attcollation LEFT JOIN pg_depend p ON p.refobjid = c.oid AND p.refobjsubid = a.attnum AND p.deptype = 'i' LEFT JOIN pg_sequence s ON s.seqrelid = p.objid WHERE a.attnum > 0 AND NOT a.attisdropped AND c.relkind IN ('r', 'p') AND NOT c.relispartition AND {_PG_OWN}",
        "rules": f"SELECT {_PG_NAME} AS relation, CASE k.contype WHEN 'p' THEN 'primary' WHEN 'u' THEN 'unique' WHEN 'f' THEN 'foreign' ELSE 'check' END AS kind, k.conname AS name, u.place AS ordinal, a.attname AS field, CASE WHEN k.contype = 'c' THEN pg_get_expr(k.conbin, k.conrelid) END AS condition, CASE WHEN k.contype = 'f' THEN k.confrelid::regclass::text END AS other, f.attname AS other_field, CASE k.confdeltype WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' WHEN 'r' THEN 'RESTRICT' ELSE 'NO ACTION' END AS on_delete, CASE k.confupdtype WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' WHEN 'r' THEN 'RESTRICT' ELSE 'NO ACTION' END AS on_update FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace CROSS JOIN LATERAL unnest(k.conkey) WITH ORDINALITY u(num, place) JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = u.num LEFT JOIN pg_attribute f ON f.attrelid = k.confrelid AND f.attnum = k.confkey[u.place] WHERE k.contype IN ('p', 'u', 'f', 'c') AND {_PG_OWN}",
        "accesses": f"SELECT {_PG_NAME} AS relation, i.relname AS name, u.place AS ordinal, a.attname AS field, u.place > x.indnkeyatts AS carried, m.amname AS method, pg_get_expr(x.indpred, x.indrelid) AS filter, x.indisunique AS is_unique, x.indisclustered AS clustered FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_am m ON m.oid = i.relam JOIN pg_class c ON c.oid = x.indrelid JOIN pg_namespace n ON n.oid = c.relnamespace CROSS JOIN LATERAL unnest(x.indkey::int[]) WITH ORDINALITY u(num, place) JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = u.num WHERE NOT x.indisprimary AND NOT EXISTS (SELECT 1 FROM pg_constraint k WHERE k.conindid = x.indexrelid AND k.contype IN ('p', 'u')) AND {_PG_OWN}",
        "spans": f"SELECT {_PG_NAME} AS relation, row_number() OVER (PARTITION BY c.oid ORDER BY p.relname)::int AS ordinal, p.relname AS name, pg_get_expr(p.relpartbound, p.oid) AS bounds FROM pg_inherits h JOIN pg_class p ON p.oid = h.inhrelid JOIN pg_class c ON c.oid = h.inhparent JOIN pg_namespace n ON n.oid = c.relnamespace WHERE p.relispartition AND {_PG_OWN}",
        "code": f"SELECT CASE WHEN r.prokind = 'p' THEN 'procedure' WHEN r.proretset THEN 'table' ELSE 'scalar' END AS kind, n.nspname || '.' || r.proname AS name, pg_get_functiondef(r.oid) AS source, NULL AS relation, NULL AS timing, NULL AS events FROM pg_proc r JOIN pg_namespace n ON n.oid = r.pronamespace WHERE r.prokind IN ('f', 'p') AND {_PG_OWN} UNION ALL SELECT 'trigger', n.nspname || '.' || g.tgname, pg_get_triggerdef(g.oid), {_PG_NAME}, CASE WHEN g.tgtype & 64 <> 0 THEN 'INSTEAD OF' WHEN g.tgtype & 2 <> 0 THEN 'BEFORE' ELSE 'AFTER' END, concat_ws(',', CASE WHEN g.tgtype & 4 <> 0 THEN 'INSERT' END, CASE WHEN g.tgtype & 16 <> 0 THEN 'UPDATE' END, CASE WHEN g.tgtype & 8 <> 0 THEN 'DELETE' END) FROM pg_trigger g JOIN pg_class c ON c.oid = g.tgrelid JOIN pg_namespace n ON n.oid = c.relnamespace WHERE NOT g.tgisinternal",
    },
    "tsql": {
        "relations": f"SELECT {_MS_NAME} AS relation, CASE WHEN o.type = 'V' THEN CASE WHEN EXISTS (SELECT 1 FROM sys.indexes i WHERE i.object_id = o.object_id) THEN 'stored_view' ELSE 'view' END ELSE 'table' END AS kind, m.definition AS query, (SELECT MAX(c.name) FROM sys.index_columns k JOIN sys.columns c ON c.object_id = k.object_id AND c.column_id = k.column_id WHERE k.object_id = o.object_id AND k.partition_ordinal = 1) AS split_by, CAST(CASE WHEN t.temporal_type = 2 THEN 1 ELSE 0 END AS BIT) AS temporal, CAST(CASE WHEN t.is_node = 1 OR t.is_edge = 1 THEN 1 ELSE 0 END AS BIT) AS graph FROM sys.objects o LEFT JOIN sys.tables t ON t.object_id = o.object_id LEFT JOIN sys.sql_modules m ON m.object_id = o.object_id WHERE o.type IN ('U', 'V') AND o.is_ms_shipped = 0",
        "fields": f"SELECT {_MS_NAME} AS relation, c.column_id AS ordinal, c.name, y.name AS native, c.max_length AS length, c.precision AS digits, c.scale, c.is_nullable AS nullable, d.definition AS [default], CAST(i.seed_value AS BIGINT) AS start, CAST(i.increment_value AS BIGINT) AS step, e.definition AS computed, e.is_persisted AS stored, c.collation_name AS collation, CAST(p.value AS NVARCHAR(4000)) AS note FROM sys.columns c JOIN sys.objects o ON o.object_id = c.object_id JOIN sys.types y ON y.user_type_id = c.user_type_id LEFT JOIN sys.default_constraints d ON d.object_id = c.default_object_id LEFT JOIN sys.identity_columns i ON i.object_id = c.object_id AND i.column_id = c.column_id LEFT JOIN sys.computed_columns e ON e.object_id = c.object_id AND e.column_id = c.column_id LEFT JOIN sys.extended_properties p ON p.major_id = c.object_id AND p.minor_id = c.column_id AND p.name = 'MS_Description' WHERE o.type = 'U' AND o.is_ms_shipped = 0",
        "rules": f"SELECT {_MS_NAME} AS relation, CASE k.type WHEN 'PK' THEN 'primary' ELSE 'unique' END AS kind, k.name, x.key_ordinal AS ordinal, c.name AS field, NULL AS condition, NULL AS other, NULL AS other_field, NULL AS on_delete, NULL AS on_update FROM sys.key_constraints k JOIN sys.objects o ON o.object_id = k.parent_object_id JOIN sys.index_columns x ON x.object_id = o.object_id AND x.index_id = k.unique_index_id JOIN sys.columns c ON c.object_id = o.object_id AND c.column_id = x.column_id UNION ALL SELECT {_MS_NAME}, 'check', k.name, 1, NULL, k.definition, NULL, NULL, NULL, NULL FROM sys.check_constraints k JOIN sys.objects o ON o.object_id = k.parent_object_id UNION ALL SELECT {_MS_NAME}, 'foreign', k.name, x.constraint_column_id, c.name, NULL, OBJECT_SCHEMA_NAME(k.referenced_object_id) + '.' + OBJECT_NAME(k.referenced_object_id), r.name, REPLACE(k.delete_referential_action_desc, '_', ' '), REPLACE(k.update_referential_action_desc, '_', ' ') FROM sys.foreign_keys k JOIN sys.objects o ON o.object_id = k.parent_object_id JOIN sys.foreign_key_columns x ON x.constraint_object_id = k.object_id JOIN sys.columns c ON c.object_id = o.object_id AND c.column_id = x.parent_column_id JOIN sys.columns r ON r.object_id = k.referenced_object_id AND r.column_id = x.referenced_column_id",
        "accesses": f"SELECT {_MS_NAME} AS relation, i.name, CASE WHEN x.is_included_column = 1 THEN 1000 + x.index_column_id ELSE x.key_ordinal END AS ordinal, c.name AS field, x.is_included_column AS carried, CASE WHEN i.type IN (1, 2) THEN 'rowstore' ELSE LOWER(i.type_desc) END AS method, i.filter_definition AS filter, i.is_unique, CAST(CASE WHEN i.type = 1 THEN 1 ELSE 0 END AS BIT) AS clustered FROM sys.indexes i JOIN sys.objects o ON o.object_id = i.object_id JOIN sys.index_columns x ON x.object_id = i.object_id AND x.index_id = i.index_id JOIN sys.columns c ON c.object_id = i.object_id AND c.column_id = x.column_id WHERE o.type = 'U' AND o.is_ms_shipped = 0 AND i.is_primary_key = 0 AND i.is_unique_constraint = 0 AND i.name IS NOT NULL",
        "code": f"SELECT CASE o.type WHEN 'P' THEN 'procedure' WHEN 'FN' THEN 'scalar' WHEN 'IF' THEN 'inline_table' WHEN 'TF' THEN 'table' ELSE 'trigger' END AS kind, {_MS_NAME} AS name, m.definition AS source, OBJECT_SCHEMA_NAME(o.parent_object_id) + '.' + OBJECT_NAME(o.parent_object_id) AS relation, CASE WHEN g.is_instead_of_trigger = 1 THEN 'INSTEAD OF' WHEN g.object_id IS NOT NULL THEN 'AFTER' END AS timing, (SELECT STRING_AGG(e.type_desc, ',') FROM sys.trigger_events e WHERE e.object_id = o.object_id) AS events FROM sys.objects o JOIN sys.sql_modules m ON m.object_id = o.object_id LEFT JOIN sys.triggers g ON g.object_id = o.object_id WHERE o.type IN ('P', 'FN', 'IF', 'TF', 'TR') AND o.is_ms_shipped = 0",
    },
}


def list_catalog(query: Callable[[str], DataFrame], dialect: str) -> tuple[dict[str, DataFrame], list[str]]:
    """(frames, warnings): the listings run through `query`; one that fails is left out with a warning."""
    frames, warnings = {}, []
    for name, sql in LISTINGS[dialect].items():
        try:
            frames[name] = query(sql)
        except Exception as e:  # without the right to read a part, the rest is of use
            warnings.append(f"{name} could not be listed: {str(e).splitlines()[0]}")
    return frames, warnings


def empty_frames(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in FRAMES.items()}


def _grouped(frame: DataFrame, by: list[str], first: list[str], parts: list[str]) -> list[dict]:
    """One dict for each object: what all its rows say, and its parts in order."""
    rows = frame.groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in first], F.array_sort(F.collect_list(F.struct("ordinal", *parts))).alias("parts"))
    return [r.asDict(recursive=True) for r in rows.orderBy(*by).collect()]


def parse_bounds(bounds: str | None) -> tuple[object, object]:
    """(low, high) of FOR VALUES FROM (...) TO (...); an open end, a list or the default partition is None."""
    m = re.search(r"FROM \((.*?)\) TO \((.*?)\)", bounds or "", re.I | re.S)
    end = lambda text: None if text.upper() in ("MINVALUE", "MAXVALUE") else text.strip("'").replace("''", "'")
    return (end(m[1].strip()), end(m[2].strip())) if m else (None, None)


def renames(query: str) -> str | None:
    """The relation that a view gives another name: SELECT of * or plain columns from one relation and nothing else."""
    tokens = tokenize(view_select(query))
    if not tokens or tokens[0].upper != "SELECT" or any(t.text == "(" for t in tokens):
        return None
    at = next((i for i, t in enumerate(tokens) if t.upper == "FROM"), None)
    if at is None:
        return None
    plain = all(t.text in (",", ".", "*") or t.kind == "quoted" or t.kind == "word" and t.upper not in ("AS", "DISTINCT", "TOP", "CASE", "ALL") for t in tokens[1:at])
    name = [t for t in tokens[at + 1 :] if t.text != ";"]
    lone = all(t.text == "." if i % 2 else t.kind in ("word", "quoted") for i, t in enumerate(name))
    commas = sum(t.text == "," for t in tokens[1:at])
    columns = sum(t.kind in ("word", "quoted") or t.text == "*" for t in tokens[1:at]) - sum(t.text == "." for t in tokens[1:at])
    return ".".join(t.name for t in name if t.text != ".") if name and len(name) % 2 and lone and plain and columns == commas + 1 else None


def catalog_from_frames(frames: dict[str, DataFrame], name: str, dialect: str, warnings: list[str] | None = None) -> Catalog:
    """The model of what the frames of FRAMES list; missing frames list nothing. One row for each object comes to the driver.

    A PostgreSQL view that only gives another relation a new name becomes a synonym. Entries of unknown kinds or facts,
    and types, rules or code of relations that are not listed, become warnings.
    """
    db = Catalog(name, dialect, warnings=list(warnings or []))
    by_name: dict[str, Relation] = {}
    if "relations" in frames:
        for r in frames["relations"].orderBy("relation").collect():
            target = renames(r["query"]) if r["kind"] == "view" and dialect == "postgres" else None
            if target:
                db.entries.append(Entry("synonym", r["relation"], target=target, target_kind="table"))
                continue
            split = re.sub(r"(?i)^\s*range\s*\(|\)\s*$", "", r["split_by"]).strip('" ') if r["split_by"] else None
            traits = frozenset(t for t in ("temporal", "graph") if r[t])
            by_name[r["relation"]] = Relation(r["relation"], query=r["query"] or "" if r["kind"] != "table" else None, stored=r["kind"] == "stored_view", split_by=split, traits=traits)
    db.relations = list(by_name.values())

    def each(frame: str, by: list[str], first: list[str], parts: list[str]):
        for g in _grouped(frames[frame], by, first, parts) if frame in frames else []:
            if g["relation"] in by_name:
                yield by_name[g["relation"]], g
            else:
                db.warnings.append(f"{frame} of {g['relation']}, which is not listed, are left out")

    for relation, g in each("fields", ["relation"], [], ["name", "native", "length", "digits", "scale", "nullable", "default", "start", "step", "computed", "stored", "collation", "note"]):
        for f in g["parts"]:
            filling = Filling("computed", f["computed"], stored=bool(f["stored"])) if f["computed"] is not None else Filling("identity", start=f["start"], step=f["step"] or 1) if f["start"] is not None else Filling("default", f["default"]) if f["default"] is not None else None
            native = rebuild_type(f["native"], f["length"], f["digits"], f["scale"]) if dialect == "tsql" else f["native"]
            relation.fields.append(Field(f["name"], native, bool(f["nullable"]), filling, f["collation"], f["note"]))
    for relation, g in each("rules", ["relation", "kind", "name"], ["condition", "other", "on_delete", "on_update"], ["field", "other_field"]):
        on = {k: g[f"on_{k}"] for k in ("delete", "update") if g[f"on_{k}"] not in (None, "NO ACTION")}
        fields = [p["field"] for p in g["parts"] if p["field"]] if g["kind"] != "check" else []
        relation.rules.append(Rule(g["kind"], g["name"], fields, g["condition"] or "", g["other"] or "", [p["other_field"] for p in g["parts"] if p["other_field"]], on))
    for relation, g in each("accesses", ["relation", "name"], ["method", "filter", "is_unique", "clustered"], ["field", "carried"]):
        split = lambda carried, g=g: [p["field"] for p in g["parts"] if bool(p["carried"]) == carried]
        relation.accesses.append(Access(g["name"], split(False), g["method"] or "btree", g["filter"], split(True), bool(g["is_unique"]), bool(g["clustered"])))
    for relation, g in each("spans", ["relation"], [], ["name", "bounds"]):
        relation.spans += [Span(p["name"], *parse_bounds(p["bounds"])) for p in g["parts"]]
    if "code" in frames:
        db.code = [Code(r["kind"], r["name"], r["source"], r["relation"] or "", r["timing"] or "", tuple(sorted((r["events"] or "").split(","))) if r["events"] else ()) for r in frames["code"].orderBy("kind", "name").collect()]
    numbers = {"start", "increment", "current"}
    flags = {"cycle", "grantable", "on_schema"}
    lists = {"labels", "member_of", "checks"}
    for r in frames["entries"].orderBy("kind", "name").collect() if "entries" in frames else []:
        facts = {k: int(v) if k in numbers else v.lower() in ("t", "true", "1") if k in flags else v.split(",") if k in lists else v for k, v in (r["facts"] or {}).items() if v is not None}
        if r["kind"] not in FACTS or set(facts) - set(FACTS[r["kind"]]):
            db.warnings.append(f"{r['kind']} {r['name']} is not known and left out")
        else:
            db.entries.append(Entry(r["kind"], r["name"], **facts))
    return db
