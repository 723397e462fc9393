"""DDL for a database model, as ordered steps with a kind each, for Spark, PostgreSQL or SQL Server."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from ..model import TYPES, Catalog, Entry, Field, Relation
from ..sqltext import translate_expression, translate_query, translate_routine
from ..sqltext.expressions import Untranslatable, quote_path
from ..sqltext.tokens import text_of, tokenize
from ..types import convert_collation, convert_type, to_spark

#: The order in which steps are applied; data moves between 'table' and 'unique'.
ORDER = ("schema", "type", "sequence", "table", "unique", "index", "foreign_key", "check", "view", "routine", "trigger", "synonym", "security")
BEFORE_DATA = frozenset(("schema", "type", "sequence", "table"))


@dataclass(frozen=True)
class Step:
    kind: str
    name: str
    sql: str


VOLATILE = frozenset("GETDATE SYSDATETIME GETUTCDATE NEWID NEWSEQUENTIALID RAND NOW RANDOM CURRENT_TIMESTAMP CURRENT_USER SYSTEM_USER".split())


def is_immutable(expression: str) -> bool:
    """Whether an expression has no function call and nothing that changes from row to row or time to time."""
    tokens = tokenize(expression)
    calls = any(t.kind == "word" and i + 1 < len(tokens) and tokens[i + 1].text == "(" and t.upper not in ("AND", "OR", "NOT", "IN", "CASE", "WHEN", "THEN", "ELSE") for i, t in enumerate(tokens))
    return not calls and not any(t.upper in VOLATILE for t in tokens)


def short_name(name: str, limit: int = 63) -> str:
    """A name within PostgreSQL's limit of bytes: the rest is replaced by a hash."""
    raw = name.encode()
    if len(raw) <= limit:
        return name
    return raw[: limit - 9].decode(errors="ignore") + "_" + hashlib.md5(raw).hexdigest()[:8]


def strip_default(default: str) -> str:
    """A default without parentheses that enclose all of it."""
    text = default.strip()
    while text.startswith("(") and text.endswith(")"):
        depth = 0
        for i, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if depth == 0 and i < len(text) - 1:
                return text
        text = text[1:-1].strip()
    return text


def translate_default(default: str, source: str, target: str, boolean: bool = False) -> str | None:
    """A column default; None: it belongs to an identity. Sequence defaults change form."""
    text = strip_default(default)
    if m := re.fullmatch(r"(?i)nextval\s*\(\s*'([^']+)'(?:::\w+)?\s*\)", text):
        return f"NEXT VALUE FOR {quote_path(m[1].replace(chr(34), ''), 'tsql')}" if target == "tsql" else text
    if m := re.fullmatch(r"(?i)NEXT\s+VALUE\s+FOR\s+(.+)", text):
        name = ".".join(t.name for t in tokenize(m[1]) if t.text != ".")
        return f"nextval('{name}')" if target == "postgres" else None
    if boolean and text in ("0", "1"):
        return {"0": "FALSE", "1": "TRUE"}[text]
    if source == "postgres":
        text = re.sub(r"^('(?:[^']|'')*')::[\w ]+(?:\(\d+(?:,\d+)?\))?(?:\[\])?$", r"\1", text)
    return translate_expression(text, source, target)[0]


def _type_of(c: Field, db: Catalog, target: str, warnings: list[str], where: str) -> str | None:
    user = db.type(re.sub(r"[\[\]\"]", "", c.native))
    native = c.native
    if user:
        if user.kind in ("alias", "domain"):
            native = user.base or "text"
            if user.checks and target != "postgres":
                warnings.append(f"{where}: checks of {user.name} are not carried over")
            elif target != "spark":
                return quote_path(user.name, target)
        elif user.kind in ("enum", "composite"):
            warnings.append(f"{where}: {user.kind} {user.name} becomes text")
            return {"tsql": "NVARCHAR(MAX)", "postgres": "TEXT", "spark": "STRING"}[target]
    if target == db.dialect:
        return native
    out, warning = convert_type(native, db.dialect, target)
    if warning:
        warnings.append(f"{where}: {warning}")
    return out


def column_ddl(c: Field, db: Catalog, target: str, where: str, warnings: list[str]) -> str | None:
    """One column; None: it has no counterpart."""
    kind = _type_of(c, db, target, warnings, where)
    if kind is None:
        return None
    parts = [quote_path(c.name, target), kind.removesuffix(" IDENTITY(1,1)")]
    spark_kind, _ = to_spark(c.native, db.dialect)
    boolean = spark_kind is not None and spark_kind.typeName() == "boolean"
    if c.collation and c.collation != db.collation:
        collation, warning = convert_collation(c.collation, db.dialect)
        if target == "spark" and collation and spark_kind is not None and spark_kind.typeName() == "string":
            parts.append(f"COLLATE {collation}")
        elif target == "tsql" and db.dialect == "postgres" and collation:
            parts.append("COLLATE Latin1_General_CS_AS" if collation == "UTF8_BINARY" else "COLLATE Latin1_General_CI_AS")
        elif target == "postgres":
            warnings.append(f"{where}: collation {c.collation} is left out")
        if warning:
            warnings.append(f"{where}: {warning}")
    if rule := c.filled_by("computed"):
        expression = translate_expression(strip_default(rule.text), db.dialect, target)[0]
        if target == "tsql":
            return f"{parts[0]} AS ({expression})" + (" PERSISTED" if rule.stored else "")
        if target == "postgres" and is_immutable(rule.text):
            return f"{' '.join(parts)} GENERATED ALWAYS AS ({expression}) STORED"
        return " ".join(parts)  # filled when rows are written
    if c.filled_by("identity") or kind.endswith("IDENTITY(1,1)"):
        start, step = (c.filling.start, c.filling.step) if c.filled_by("identity") else (1, 1)
        parts += {"tsql": [f"IDENTITY({start},{step})"], "postgres": [f"GENERATED BY DEFAULT AS IDENTITY (START WITH {start} INCREMENT BY {step})"], "spark": []}[target]
    elif given := c.filled_by("default"):
        default = translate_default(given.text, db.dialect, target, boolean and target != "tsql")
        if default is not None and (target != "spark" or is_immutable(default)):
            parts.append(f"DEFAULT {default}")
        elif target == "spark":
            warnings.append(f"{where}: default {given.text} is applied when rows are written")
    if not c.nullable:
        parts.append("NOT NULL")
    return " ".join(parts)


def table_ddl(t: Relation, db: Catalog, target: str, warnings: list[str]) -> list[str]:
    columns = [x for c in t.fields if (x := column_ddl(c, db, target, f"{t.name}.{c.name}", warnings))]
    if "temporal" in t.traits:
        warnings.append(f"{t.name}: history of a temporal table is not carried over")
    if "graph" in t.traits:
        warnings.append(f"{t.name}: a graph table becomes a plain one")
    if target == "spark":
        return [f"CREATE TABLE {quote_path(t.name, target)} ({', '.join(columns)}) USING parquet"]
    if t.key:
        columns.append(f"CONSTRAINT {quote_path(short_name(t.key.name), target)} PRIMARY KEY ({', '.join(quote_path(c, target) for c in t.key.fields)})")
    out = [f"CREATE TABLE {quote_path(t.name, target)} ({', '.join(columns)})"]
    if target == "postgres" and t.spans:
        if t.key and t.split_by not in t.key.fields:
            warnings.append(f"{t.name}: the partition column is not part of the primary key")
        out[0] += f" PARTITION BY RANGE ({quote_path(t.split_by or '', target)})"
        edge = lambda v, word: word if v is None else "'" + str(v) + "'"
        out += [f"CREATE TABLE {quote_path(p.name, target)} PARTITION OF {quote_path(t.name, target)} FOR VALUES FROM ({edge(p.low, 'MINVALUE')}) TO ({edge(p.high, 'MAXVALUE')})" for p in t.spans]
    return out


def _type_ddl(u: Entry, db: Catalog, target: str, warnings: list[str]) -> str | None:
    if target == "spark" or u.kind == "enum":
        return None
    name = quote_path(u.name, target)
    if u.kind in ("alias", "domain"):
        base, warning = convert_type(u.base or "text", db.dialect, target)
        if warning:
            warnings.append(f"{u.name}: {warning}")
        return None if base is None else f"CREATE TYPE {name} FROM {base}" if target == "tsql" else f"CREATE DOMAIN {name} AS {base}"
    if u.kind in ("table_type", "composite"):
        cols = ", ".join(f"{quote_path(c.name, target)} {convert_type(c.native, db.dialect, target)[0]}" for c in u.fields or [])
        return f"CREATE TYPE {name} AS TABLE ({cols})" if target == "tsql" else f"CREATE TYPE {name} AS ({cols})"
    warnings.append(f"type {u.name} ({u.kind}) needs review")
    return None


def view_select(definition: str) -> str:
    """The query of a view: what follows the first AS at the top level, WITH included."""
    tokens, depth = tokenize(definition), 0
    if not tokens or tokens[0].upper not in ("CREATE", "ALTER"):
        return definition.strip().rstrip(";")
    for i, t in enumerate(tokens):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.upper == "AS" and i + 1 < len(tokens) and (tokens[i + 1].upper in ("SELECT", "WITH") or tokens[i + 1].text == "("):
            return text_of(tokens[i + 1 :]).strip().rstrip(";")
    return definition


def plan_ddl(db: Catalog, target: str = "spark") -> tuple[list[Step], list[str]]:
    """(steps in the order of ORDER, warnings without repeats). Constraints that Spark tables do not take become quality checks, not steps."""
    steps, warnings = [], list(db.warnings)
    bits = frozenset(c.name.lower() for t in db.tables for c in t.fields if c.native.lower() == "bit")
    q = lambda n: quote_path(n, target)
    schemas = sorted({n.rsplit(".", 1)[0] for n in [r.name for r in db.relations] if "." in n})
    steps += [Step("schema", s, f"CREATE SCHEMA IF NOT EXISTS {q(s)}" if target != "tsql" else f"CREATE SCHEMA {q(s)}") for s in schemas if s not in ("dbo", "public")]
    steps += [Step("type", u.name, x) for u in db.entries_of(*TYPES) if (x := _type_ddl(u, db, target, warnings))]
    if target != "spark":
        for s in db.entries_of("sequence"):
            first, step = 1 if s.start is None else s.start, s.increment or 1
            start = max(1, first) if target == "postgres" else first
            steps.append(Step("sequence", s.name, f"CREATE SEQUENCE {q(s.name)} START WITH {start} INCREMENT BY {step}" + (" CYCLE" if s.cycle else "")))
            if s.current is not None and s.current != first:
                steps.append(Step("sequence", s.name, f"SELECT setval('{s.name}', {s.current})" if target == "postgres" else f"ALTER SEQUENCE {q(s.name)} RESTART WITH {s.current + step}"))
    for t in db.by_dependency():
        steps += [Step("table", t.name, x) for x in table_ddl(t, db, target, warnings)]
    names = lambda cols: ", ".join(q(c) for c in cols)
    for t in db.tables if target != "spark" else []:
        own = frozenset(c.name.lower() for c in t.fields if c.native.lower() == "bit")
        steps += [Step("unique", u.name, f"ALTER TABLE {q(t.name)} ADD CONSTRAINT {q(short_name(u.name))} UNIQUE ({names(u.fields)})") for u in t.of("unique")]
        for i in t.accesses:
            if i.method not in ("btree", "rowstore"):
                warnings.append(f"index {i.name} of {t.name} ({i.method}) is left out")
                continue
            if i.clustered and target == "postgres":
                warnings.append(f"index {i.name} of {t.name} is not clustered")
            where = f" WHERE {translate_expression(i.where, db.dialect, target, bits=own)[0]}" if i.where else ""
            include = f" INCLUDE ({names(i.carries)})" if i.carries else ""
            steps.append(Step("index", i.name, f"CREATE {'UNIQUE ' if i.unique else ''}{'CLUSTERED ' if i.clustered and target == 'tsql' else ''}INDEX {q(short_name(i.name))} ON {q(t.name)} ({names(i.fields)}){include}{where}"))
        for k in t.of("foreign"):
            actions = "".join(f" ON {w.upper()} {a}" for w, a in sorted(k.on.items()) if not (a == "RESTRICT" and target == "tsql"))
            steps.append(Step("foreign_key", k.name, f"ALTER TABLE {q(t.name)} ADD CONSTRAINT {q(short_name(k.name))} FOREIGN KEY ({names(k.fields)}) REFERENCES {q(k.other)} ({names(k.other_fields)}){actions}"))
        steps += [Step("check", c.name, f"ALTER TABLE {q(t.name)} ADD CONSTRAINT {q(short_name(c.name or 'ck_' + hashlib.md5(c.condition.encode()).hexdigest()[:8]))} CHECK ({translate_expression(strip_default(c.condition), db.dialect, target, bits=own)[0]})") for c in t.of("check")]
    for v in db.views:
        try:
            select, notes = translate_query(view_select(v.query), db.dialect, target, bits=bits) if db.dialect != target else (view_select(v.query), [])
        except Untranslatable as e:
            warnings.append(f"view {v.name} is left out: {e}")
            continue
        warnings += notes
        if v.stored and target == "postgres":
            steps.append(Step("view", v.name, f"CREATE MATERIALIZED VIEW {q(v.name)} AS {select}"))
        elif v.stored and target == "spark":
            steps.append(Step("view", v.name, f"CREATE OR REPLACE TABLE {q(v.name)} USING parquet AS {select}"))
        else:
            bound = " WITH SCHEMABINDING" if v.stored and target == "tsql" else ""
            steps.append(Step("view", v.name, f"CREATE {'OR REPLACE ' if target != 'tsql' else ''}VIEW {q(v.name)}{bound} AS {select}"))
    for r in db.routines:
        if db.dialect == "tsql" and target == "spark":
            done = translate_routine(r.source, bits)
            warnings += done.warnings
            if done.kind != "refused":
                steps.append(Step("routine", r.name, done.sql))
        else:
            warnings.append(f"routine {r.name} needs review")
    warnings += [f"trigger {t.name} runs as a change handler" for t in db.triggers]
    for s in db.entries_of("synonym"):
        if (s.target_kind or "table") in ("table", "view"):
            name = ".".join(t.name for t in tokenize(s.target) if t.text != ".").split(".")[-2:]
            steps.append(Step("synonym", s.name, f"CREATE VIEW {q(s.name)} AS SELECT * FROM {q('.'.join(name))}"))
        else:
            warnings.append(f"synonym {s.name} of a {s.target_kind} is left out")
    if target != "spark":
        steps += security_steps(db, target, warnings)
    return sorted(steps, key=lambda s: ORDER.index(s.kind)), list(dict.fromkeys(warnings))


def security_steps(db: Catalog, target: str, warnings: list[str]) -> list[Step]:
    q, out = (lambda n: quote_path(n, target)), []
    for p in db.entries_of("user", "role"):
        if p.name.lower() == "public":
            continue
        create = f"CREATE ROLE {q(p.name)}" + (" LOGIN" if target == "postgres" and p.kind == "user" else "") if target == "postgres" or p.kind == "role" else f"CREATE USER {q(p.name)} WITHOUT LOGIN"
        out.append(Step("security", p.name, create))
    out += [Step("security", p.name, f"GRANT {q(r)} TO {q(p.name)}" if target == "postgres" else f"ALTER ROLE {q(r)} ADD MEMBER {q(p.name)}") for p in db.entries_of("user", "role") for r in p.member_of or []]
    for g in db.entries_of("grant"):
        if g.state == "DENY":
            warnings.append(f"DENY {g.action} on {g.securable} has no counterpart")
            continue
        action = "USAGE" if g.on_schema and target == "postgres" else g.action
        on = f" ON {'SCHEMA ' if g.on_schema and target == 'postgres' else 'SCHEMA::' if g.on_schema else ''}{q(g.securable)}" if g.securable else ""
        out.append(Step("security", g.name, f"GRANT {action}{on} TO {q(g.name)}" + (" WITH GRANT OPTION" if g.grantable else "")))
    return out


def assess(db: Catalog, target: str = "spark") -> dict:
    """Counts, blockers and readiness: 'blocked' if a table has no column left, 'review' if there are warnings, else 'ready'."""
    steps, warnings = plan_ddl(db, target)
    blockers = [f"{t.name}: no column can be carried over" for t in db.tables if t.fields and not any(to_spark(c.native, db.dialect)[0] for c in t.fields)]
    counts = {"tables": len(db.tables), "views": len(db.views), "routines": len(db.routines), "triggers": len(db.triggers), "sequences": len(db.entries_of("sequence")), "types": len(db.entries_of(*TYPES)), "synonyms": len(db.entries_of("synonym"))}
    return {"counts": counts, "blockers": blockers, "warnings": warnings, "readiness": "blocked" if blockers else "review" if warnings else "ready", "ddl": [s.sql for s in steps]}
