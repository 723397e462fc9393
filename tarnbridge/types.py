"""Native types of the two dialects, their Spark types, and how each dialect writes the other's."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: T-SQL type -> what PostgreSQL calls it. None: no counterpart; the column is left out with a warning.
TSQL_TO_PG = {
    "int": "INTEGER", "integer": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "SMALLINT", "bit": "BOOLEAN", "money": "NUMERIC(19,4)", "smallmoney": "NUMERIC(10,4)", "decimal": "NUMERIC", "numeric": "NUMERIC",
    "float": "DOUBLE PRECISION", "real": "REAL", "date": "DATE", "time": "TIME", "datetime": "TIMESTAMP", "smalldatetime": "TIMESTAMP", "datetime2": "TIMESTAMP", "datetimeoffset": "TIMESTAMPTZ", "varchar": "VARCHAR", "nvarchar": "VARCHAR",
    "char": "CHAR", "nchar": "CHAR", "text": "TEXT", "ntext": "TEXT", "sysname": "VARCHAR(128)", "binary": "BYTEA", "varbinary": "BYTEA", "image": "BYTEA", "uniqueidentifier": "UUID", "xml": "XML", "sql_variant": None, "geography": None,
    "geometry": None, "hierarchyid": None, "rowversion": None, "timestamp": None, "cursor": None,
}
#: PostgreSQL type -> what T-SQL calls it.
PG_TO_TSQL = {
    "integer": "INT", "int": "INT", "int4": "INT", "bigint": "BIGINT", "int8": "BIGINT", "smallint": "SMALLINT", "int2": "SMALLINT", "boolean": "BIT", "bool": "BIT", "numeric": "NUMERIC", "decimal": "NUMERIC", "double precision": "FLOAT", "real": "REAL",
    "money": "MONEY", "character varying": "NVARCHAR", "varchar": "NVARCHAR", "character": "NCHAR", "char": "NCHAR", "bpchar": "NCHAR", "text": "NVARCHAR(MAX)", "bytea": "VARBINARY(MAX)", "uuid": "UNIQUEIDENTIFIER", "date": "DATE", "time": "TIME",
    "time with time zone": "TIME", "time without time zone": "TIME", "timetz": "TIME", "timestamp": "DATETIME2", "timestamp without time zone": "DATETIME2", "timestamp with time zone": "DATETIMEOFFSET", "timestamptz": "DATETIMEOFFSET", "json": "NVARCHAR(MAX)",
    "jsonb": "NVARCHAR(MAX)", "xml": "XML", "serial": "INT IDENTITY(1,1)", "bigserial": "BIGINT IDENTITY(1,1)", "smallserial": "SMALLINT IDENTITY(1,1)",
    "hstore": None, "int4range": None, "int8range": None, "numrange": None, "tsrange": None, "tstzrange": None, "daterange": None, "inet": None, "cidr": None, "macaddr": None, "point": None,
}

#: Native name -> Spark type, for both dialects; those with parameters are made below.
_SPARK = {
    "int": T.IntegerType(), "integer": T.IntegerType(), "int4": T.IntegerType(), "serial": T.IntegerType(), "bigint": T.LongType(), "int8": T.LongType(), "bigserial": T.LongType(), "smallint": T.ShortType(), "int2": T.ShortType(),
    "smallserial": T.ShortType(), "tinyint": T.ShortType(), "bit": T.BooleanType(), "boolean": T.BooleanType(), "bool": T.BooleanType(), "money": T.DecimalType(19, 4), "smallmoney": T.DecimalType(10, 4), "float": T.DoubleType(),
    "double precision": T.DoubleType(), "real": T.FloatType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "smalldatetime": T.TimestampNTZType(), "datetime2": T.TimestampNTZType(), "timestamp without time zone": T.TimestampNTZType(),
    "datetimeoffset": T.TimestampType(), "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(), "binary": T.BinaryType(), "varbinary": T.BinaryType(), "image": T.BinaryType(), "bytea": T.BinaryType(),
    
}
#: A time of day stays text: a Spark type for it is not on by default.
_TEXT = frozenset("time timetz varchar nvarchar char nchar text ntext sysname uniqueidentifier uuid xml json jsonb bpchar".split()) | {"character varying", "character", "time with time zone", "time without time zone"}
_SIZED = {"varchar": T.VarcharType, "nvarchar": T.VarcharType, "character varying": T.VarcharType, "char": T.CharType, "nchar": T.CharType, "character": T.CharType, "bpchar": T.CharType}


def split_type(native: str) -> tuple[str, list[str], bool]:
    """(name in lower case, parameters, is an array). 'timestamp(3) without time zone' is 'timestamp without time zone', ['3']."""
    text = re.sub(r"[\[\]\"](?!\])", "", native.strip()) if not native.strip().endswith("[]") else native.strip()[:-2]
    array = native.strip().endswith("[]")
    m = re.search(r"\(([^)]*)\)", text)
    params = [p.strip() for p in m[1].split(",")] if m else []
    name = " ".join((text[: m.start()] + " " + text[m.end() :] if m else text).split()).lower()
    return name.removesuffix(" identity").removeprefix("sys.").removeprefix("pg_catalog."), params, array


def to_spark(native: str, dialect: str, allow_review: bool = False) -> tuple[T.DataType | None, str | None]:
    """(Spark type, warning). None: no counterpart, leave the column out. With allow_review such values are kept as text or arrays."""
    name, params, array = split_type(native)
    if array:
        inner, warning = to_spark(native.strip()[:-2], dialect, allow_review)
        return (T.ArrayType(inner), warning) if allow_review and inner else (None, f"type {native} needs review; the column is left out")
    if name == "timestamp":
        if dialect == "postgres":
            return T.TimestampNTZType(), None
        return (T.BinaryType() if allow_review else None), f"type {native} needs review; the column is left out"
    if name in ("decimal", "numeric"):
        if params:
            p, s = int(params[0]), int(params[1]) if len(params) > 1 else 0
            return (T.DecimalType(p, s), None) if p <= 38 else (T.DecimalType(38, min(s, 38)), f"precision of {native} exceeds 38")
        return (T.DecimalType(18, 0), None) if dialect == "tsql" else (T.DecimalType(38, 18), f"{native} has no precision; 38,18 is used")
    if name in _SIZED and params and params[0].lower() != "max":
        return _SIZED[name](int(params[0])), None
    if name in ("char", "nchar", "character", "bpchar") and not params:
        return _SIZED[name](1), None
    if name == "sysname":
        return T.VarcharType(128), None
    if name in _TEXT:
        return T.StringType(), None
    if name in _SPARK:
        return _SPARK[name], None
    return (T.StringType() if allow_review else None), f"type {native} needs review; the column is left out"


def convert_type(native: str, source: str, target: str) -> tuple[str | None, str | None]:
    """(the target dialect's type, warning) between 'tsql' and 'postgres', or to 'spark'."""
    if target == "spark":
        kind, warning = to_spark(native, source)
        return (kind.simpleString().upper() if kind else None), warning
    name, params, array = split_type(native)
    table = TSQL_TO_PG if source == "tsql" else PG_TO_TSQL
    out = None if array else table.get(name)
    if out is None:
        return None, f"type {native} needs review; the column is left out"
    unbounded = not params or params[0].lower() == "max"
    if out == "VARCHAR":
        return ("TEXT" if unbounded else f"VARCHAR({params[0]})"), None
    if out == "NVARCHAR":
        return ("NVARCHAR(MAX)" if unbounded else f"NVARCHAR({params[0]})"), None
    if out in ("CHAR", "NCHAR", "NUMERIC") and params:
        return f"{out}({','.join(params)})", None
    if out in ("DATETIME2", "DATETIMEOFFSET", "TIME") and params and target == "tsql":
        return f"{out}({params[0]})", None
    return out, None


def rebuild_type(name: str, max_length: int | None = None, precision: int | None = None, scale: int | None = None) -> str:
    """A T-SQL type from catalog parts: length -1 is MAX (in bytes for n-types, two a character), time precision 7 is the default."""
    low = name.lower()
    if low in ("varchar", "char", "varbinary", "binary", "nvarchar", "nchar"):
        if max_length in (None, -1):
            return f"{name}(MAX)"
        return f"{name}({max_length // 2 if low[0] == 'n' else max_length})"
    if low in ("decimal", "numeric"):
        return f"{name}({precision},{scale or 0})"
    if low in ("datetime2", "datetimeoffset", "time") and scale is not None and scale != 7:
        return f"{name}({scale})"
    return name


#: Collation name parts -> Spark collation.
LOCALES = {"latin1_general": "UNICODE", "sql_latin1_general_cp1": "UNICODE", "german": "de", "french": "fr", "modern_spanish": "es", "turkish": "tr", "polish": "pl", "japanese": "ja"}


def convert_collation(collation: str | None, source: str) -> tuple[str | None, str | None]:
    """(Spark collation, warning)."""
    if not collation or collation.lower() in ("default", "c", "posix", "ucs_basic"):
        return (None if not collation or collation.lower() == "default" else "UTF8_BINARY"), None
    low = collation.lower()
    if source == "tsql":
        if "_bin" in low or "_cs" in low:
            return "UTF8_BINARY", None
        stem = re.sub(r"_(ci|cs|as|ai|ks|ws|sc|utf8|\d+)(?=_|$)", "", low)
        locale = LOCALES.get(stem)
        tail = "_CI_AI" if "_ai" in low else "_CI"
        return (f"{locale or 'UNICODE'}{tail}", None if locale else f"collation {collation} is taken as the general one")
    m = re.match(r"([a-z]{2})[_-]", low)
    return (m[1], None) if m else (None, f"collation {collation} has no counterpart")
