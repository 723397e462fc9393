"""What a database holds, in the few kinds of records that loading, checking and DDL work with, and the same as DataFrames.

A relation is a table or a view; what restricts it is a list of rules, what fills a field by itself is a filling. Code is
anything with a body that runs. Everything small (sequences, types, synonyms, principals, grants) is an entry with facts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Filling:
    """Where a field's value comes from if none is given: 'default' and 'computed' have a text, 'identity' a start and a step."""

    kind: str
    text: str = ""
    start: int = 1
    step: int = 1
    stored: bool = False


def default(text: str) -> Filling:
    return Filling("default", text)


def identity(start: int = 1, step: int = 1) -> Filling:
    return Filling("identity", start=start, step=step)


def computed(text: str, stored: bool = False) -> Filling:
    return Filling("computed", text, stored=stored)


@dataclass
class Field:
    """native is the type as the database writes it; types.to_spark knows its Spark type."""

    name: str
    native: str
    nullable: bool = True
    filling: Filling | None = None
    collation: str | None = None
    note: str | None = None

    def filled_by(self, kind: str) -> Filling | None:
        return self.filling if self.filling and self.filling.kind == kind else None


@dataclass
class Rule:
    """What rows must hold to. kind: 'primary', 'unique', 'check' (a condition) or 'foreign' (fields of another relation)."""

    kind: str
    name: str
    fields: list[str] = field(default_factory=list)
    condition: str = ""
    other: str = ""
    other_fields: list[str] = field(default_factory=list)
    on: dict[str, str] = field(default_factory=dict)  # 'delete' and 'update', where they do something

    def describe(self) -> str:
        """What it says, without its name, so that rules of two databases compare."""
        fields = ",".join(self.fields).casefold()
        if self.kind == "check":
            return self.condition
        if self.kind == "foreign":
            return f"{fields} -> {object_key(self.other)}({','.join(self.other_fields).casefold()})" + "".join(f" {k}={v}" for k, v in sorted(self.on.items()))
        return fields


@dataclass
class Access:
    """An index."""

    name: str
    fields: list[str]
    method: str = "btree"
    where: str | None = None
    carries: list[str] = field(default_factory=list)
    unique: bool = False
    clustered: bool = False


@dataclass(frozen=True)
class Span:
    """A half-open range [low, high) of a split relation; None is unbounded."""

    name: str
    low: object = None
    high: object = None


@dataclass
class Relation:
    """A table, or with a query a view; stored then means that its rows are kept. traits: 'temporal', 'graph'."""

    name: str
    fields: list[Field] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    accesses: list[Access] = field(default_factory=list)
    query: str | None = None
    stored: bool = False
    split_by: str | None = None
    spans: list[Span] = field(default_factory=list)
    traits: frozenset[str] = frozenset()

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name.casefold() == name.casefold()), None)

    def of(self, *kinds: str) -> list[Rule]:
        return [r for r in self.rules if r.kind in kinds]

    @property
    def key(self) -> Rule | None:
        return next(iter(self.of("primary")), None)


@dataclass
class Code:
    """kind: 'procedure', 'scalar', 'inline_table', 'table', or 'trigger' with the relation, the time and the events."""

    kind: str
    name: str
    source: str
    on: str = ""
    when: str = ""
    events: tuple[str, ...] = ()


#: Kinds of entries and the facts they may have.
FACTS = {
    "sequence": ("start", "increment", "current", "native", "cycle"),
    "alias": ("base", "checks"), "domain": ("base", "checks"), "enum": ("labels",), "composite": ("fields",), "table_type": ("fields",), "clr": (),
    "synonym": ("target", "target_kind"),
    "user": ("member_of",), "role": ("member_of",), "grant": ("action", "securable", "state", "grantable", "on_schema"),
}
TYPES = ("alias", "domain", "enum", "composite", "table_type", "clr")


class Entry:
    """A small object: its kind, its name (of a grant: the principal's) and facts, read as attributes; a missing one is None."""

    def __init__(self, kind: str, name: str, **facts: object):
        if unknown := set(facts) - set(FACTS[kind]):
            raise TypeError(f"a {kind} has no {', '.join(sorted(unknown))}")
        self.kind, self.name, self.facts = kind, name, facts

    def __getattr__(self, fact: str):
        if fact.startswith("_") or fact not in FACTS[self.__dict__["kind"]]:
            raise AttributeError(fact)
        return self.facts.get(fact)

    def describe(self) -> str:
        return " ".join(f"{k}={v}" for k, v in sorted(self.facts.items()) if v not in (None, False, [], "") and k not in ("current", "fields"))


@dataclass
class Catalog:
    """A database. dialect: 'tsql', 'postgres' or 'spark'."""

    name: str
    dialect: str
    relations: list[Relation] = field(default_factory=list)
    code: list[Code] = field(default_factory=list)
    entries: list[Entry] = field(default_factory=list)
    collation: str | None = None
    warnings: list[str] = field(default_factory=list)

    @property
    def tables(self) -> list[Relation]:
        return [r for r in self.relations if r.query is None]

    @property
    def views(self) -> list[Relation]:
        return [r for r in self.relations if r.query is not None]

    @property
    def routines(self) -> list[Code]:
        return [c for c in self.code if c.kind != "trigger"]

    @property
    def triggers(self) -> list[Code]:
        return [c for c in self.code if c.kind == "trigger"]

    def entries_of(self, *kinds: str) -> list[Entry]:
        return [e for e in self.entries if e.kind in kinds]

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.relations if r.name.casefold() == name.casefold()), None)

    def type(self, name: str) -> Entry | None:
        """By full name, else by its last part."""
        low = name.casefold()
        last = lambda n: n.casefold().rsplit(".", 1)[-1]
        known = self.entries_of(*TYPES)
        return next((t for t in known if t.name.casefold() == low), None) or next((t for t in known if last(t.name) == last(low)), None)

    def by_dependency(self) -> list[Relation]:
        """Tables, referenced ones first; cycles are broken at the edge that closes them; ties keep their order."""
        known, out, state = {t.name.casefold(): t for t in self.tables}, [], {}
        for start in self.tables:
            trail: list[tuple[Relation, Iterator[Rule]]] = []
            if state.setdefault(start.name.casefold(), start) is start and start not in out:
                trail.append((start, iter(start.of("foreign"))))
            while trail:
                table, rules = trail[-1]
                needed = next((t for r in rules if (t := known.get(r.other.casefold())) and t.name.casefold() not in state), None)
                if needed is None:
                    out.append(table)
                    trail.pop()
                else:
                    state[needed.name.casefold()] = needed
                    trail.append((needed, iter(needed.of("foreign"))))
        return out

    def to_dict(self) -> dict:
        return {**asdict(self), "entries": [{"kind": e.kind, "name": e.name, **e.facts} for e in self.entries]}


def object_key(name: str) -> str:
    """The name without quotes, in lower case; its schema stays, but the two default schemas are one."""
    parts = [p.strip('[]"`').casefold() for p in name.split(".")]
    return ".".join(["default" if p in ("dbo", "public") and len(parts) > 1 and i == 0 else p for i, p in enumerate(parts)])


SECTION = T.StructType([T.StructField(n, T.StringType()) for n in ("section", "key", "definition")])


def columns_frame(spark: SparkSession, db: Catalog) -> DataFrame:
    """(section, key, definition): a row for each field of a table, with its neutral type, nullability and what fills it."""
    from .types import to_spark

    rows = []
    for t in db.tables:
        for f in t.fields:
            kind, _ = to_spark(f.native, db.dialect)
            rows.append(("columns", f"{object_key(t.name)}.{f.name.casefold()}", f"{kind.simpleString() if kind else 'skipped'} null={f.nullable} identity={bool(f.filled_by('identity'))} computed={bool(f.filled_by('computed'))}"))
    return spark.createDataFrame(rows, SECTION)


def ordinals_frame(spark: SparkSession, db: Catalog) -> DataFrame:
    """(section, key, definition): the place of each field."""
    return spark.createDataFrame([("ordinals", f"{object_key(t.name)}.{f.name.casefold()}", str(i)) for t in db.tables for i, f in enumerate(t.fields, 1)], SECTION)


def _neutral(sql: str, dialect: str, query: bool) -> str:
    """A condition or query in Spark's words, as one text without needless marks, so that both dialects' compare."""
    from .sqltext import translate_expression, translate_query
    from .sqltext.tokens import tokenize

    text = (translate_query if query else translate_expression)(sql, dialect, "spark")[0] if dialect != "spark" else sql
    tokens = [t.name.casefold() if t.kind in ("word", "quoted") else t.text for t in tokenize(text)]
    return " ".join(t for t in tokens if t not in ("(", ")", "dbo", "public", ";"))


def objects_frame(spark: SparkSession, db: Catalog) -> DataFrame:
    """(section, key, definition) for every kind of object but fields. Conditions, queries and bodies are part of the definition.

    Routines of two dialects differ in every body, so theirs is the kind alone.
    """
    from .plans.ddl import view_select

    rows = []
    for t in db.tables:
        k = object_key(t.name)
        rows.append(("tables", k, ""))
        for r in t.rules:
            said = _neutral(r.condition, db.dialect, False) if r.kind == "check" else r.describe()
            where = k if r.kind == "primary" else f"{k}.{r.name.casefold()}" if r.kind == "check" else f"{k}({','.join(r.fields).casefold()})"
            rows.append(({"primary": "primary_keys", "unique": "unique", "foreign": "foreign_keys", "check": "checks"}[r.kind], where, said))
        rows += [("indexes", f"{k}.{a.name.casefold()}", f"{','.join(a.fields).casefold()} unique={a.unique} where={_neutral(a.where, db.dialect, False) if a.where else ''}") for a in t.accesses]
        rows += [("defaults", f"{k}.{f.name.casefold()}", _neutral(d.text, db.dialect, False)) for f in t.fields if (d := f.filled_by("default"))]
    rows += [("views", object_key(v.name), f"stored={v.stored} {_neutral(view_select(v.query), db.dialect, True)}") for v in db.views]
    rows += [("routines", object_key(c.name), c.kind) for c in db.routines] + [("triggers", object_key(c.name), f"{object_key(c.on)} {c.when} {','.join(sorted(c.events))}") for c in db.triggers]
    rows += [("sequences", object_key(e.name), f"increment={e.increment or 1}") for e in db.entries_of("sequence")] + [("types", object_key(e.name), e.kind) for e in db.entries_of(*TYPES)]
    rows += [("synonyms", object_key(e.name), object_key(".".join(p for p in str(e.target).split(".")[-2:]))) for e in db.entries_of("synonym")]
    rows += [("security", f"{e.kind} {e.name.casefold()}" + (f" {e.action} {object_key(e.securable or '')}" if e.kind == "grant" else ""), "" if e.kind == "grant" else e.describe()) for e in db.entries_of("user", "role", "grant")]
    return spark.createDataFrame(rows, SECTION)
