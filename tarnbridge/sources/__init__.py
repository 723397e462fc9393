"""Endpoints: where tables live. Parquet folders, the Spark catalog, JDBC, and frames in memory."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair_integer
from ..model import Catalog, Field, Relation, Rule
from ..operators.load import batch_size


@dataclass
class MemoryEndpoint:
    """Frames by name."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table_names(self) -> list[str]:
        return list(self.tables)

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def write(self, name: str, rows: DataFrame, table: Relation | None = None) -> None:
        self.tables[name] = rows

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)


@dataclass
class ParquetEndpoint:
    """A folder with one parquet dataset for each table; a manifest.json beside them may describe keys."""

    spark: SparkSession
    path: str

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def table_names(self) -> list[str]:
        fs, root = self._files()
        return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(root) if s.getPath().getName().endswith(".parquet")) if fs.exists(root) else []

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def write(self, name: str, rows: DataFrame, table: Relation | None = None) -> None:
        writer = rows.write.mode("overwrite")
        if table and table.split_by and table.split_by in rows.columns:
            writer = writer.partitionBy(table.split_by)
        writer.parquet(f"{self.path}/{name}.parquet")

    def drop(self, name: str) -> None:
        fs, _ = self._files()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.parquet"), True)

    def manifest(self) -> dict:
        fs, _ = self._files()
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json")):
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest.json", wholetext=True).first()[0])


@dataclass
class CatalogEndpoint:
    """A namespace of the Spark catalog."""

    spark: SparkSession
    namespace: str = "default"

    def table_names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.namespace) if t.tableType != "TEMPORARY" and t.tableType != "VIEW")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"`{self.namespace}`.`{name}`")

    def write(self, name: str, rows: DataFrame, table: Relation | None = None) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.namespace}`")
        rows.write.mode("overwrite").format("parquet").saveAsTable(f"`{self.namespace}`.`{name}`")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*self.table(name).columns).write.mode("append").insertInto(f"`{self.namespace}`.`{name}`")

    def execute(self, sql: str) -> DataFrame:
        """A statement whose unqualified names are of this namespace."""
        before = self.spark.catalog.currentDatabase()
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.namespace}`")
        self.spark.catalog.setCurrentDatabase(self.namespace)
        try:
            return self.spark.sql(sql)
        finally:
            self.spark.catalog.setCurrentDatabase(before)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.namespace}`.`{name}`")


@dataclass
class JdbcEndpoint:
    """A database behind a JDBC url. Reads split by a numeric column; credentials are not kept in the description."""

    spark: SparkSession
    url: str
    dialect: str = "postgres"
    options: dict[str, str] = field(default_factory=dict, repr=False)
    listing: str = ""

    def table_names(self) -> list[str]:
        query = self.listing or "SELECT table_schema || '.' || table_name AS name FROM information_schema.tables WHERE table_type = 'BASE TABLE'"
        return [r[0] for r in self.query(query).collect()]

    def test(self) -> str:
        """The server's version; an error says why it cannot be reached."""
        return self.query("SELECT @@VERSION AS v" if self.dialect == "tsql" else "SELECT version() AS v").first()[0]

    def execute(self, *statements: str) -> None:
        """Statements without rows, in one transaction."""
        manager, properties = self.spark._jvm.java.sql.DriverManager, self.spark._jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        connection = manager.getConnection(self.url, properties)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for sql in statements:
                statement.execute(sql)
            connection.commit()
        finally:
            connection.close()

    def catalog(self, name: str = "database") -> Catalog:
        """The model of the server's own catalog; parts that cannot be listed are warnings."""
        from .catalogs import catalog_from_frames, list_catalog

        frames, warnings = list_catalog(self.query, self.dialect)
        return catalog_from_frames(frames, name, self.dialect, warnings)

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, query=sql, **self.options).load()

    def table(self, name: str, split_on: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, table: Relation | None = None) -> DataFrame:
        options = {"url": self.url, "dbtable": name, "fetchsize": str(batch_size(table) if table else 25_000), **self.options}
        if split_on:
            if bounds is None:
                lo, hi = self.query(f"SELECT MIN({split_on}), MAX({split_on}) FROM {name}").first()
                bounds = (lo or 0, hi or 0)
            options |= {"partitionColumn": split_on, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1] + 1), "numPartitions": str(parts)}
        return self.spark.read.format("jdbc").options(**options).load()

    def write(self, name: str, rows: DataFrame, table: Relation | None = None) -> None:
        rows.write.format("jdbc").mode("append").options(url=self.url, dbtable=name, batchsize=str(batch_size(table) if table else 25_000), **self.options).save()


#: name -> (maker, default port)
_KINDS: dict[str, tuple[Callable[..., object], int | None]] = {"parquet": (ParquetEndpoint, None), "catalog": (CatalogEndpoint, None), "memory": (MemoryEndpoint, None)}
_DRIVERS = {"mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433, "tsql"), "tsql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433, "tsql"), "postgres": ("jdbc:postgresql://{host}:{port}/{database}", 5432, "postgres")}


def endpoint(kind: str, spark: SparkSession, **options):
    """An endpoint by kind: parquet, catalog, memory, or mssql, tsql and postgres with host, port, database, user, password."""
    if kind in _KINDS:
        return _KINDS[kind][0](spark, **options)
    if kind in _DRIVERS:
        url, port, dialect = _DRIVERS[kind]
        login = {k: options[k] for k in ("user", "password", "driver") if k in options}
        return JdbcEndpoint(spark, url.format(host=options.get("host", "localhost"), port=options.get("port") or port, database=options.get("database", "")), dialect, {**login, "loginTimeout": "10"})
    raise ValueError(f"unknown kind of endpoint: {kind}")


def scan(df: DataFrame, columns: Sequence[str], integers: Sequence[str] = ()) -> DataFrame:
    """The named columns; those in integers are repaired where a source delivers numbers as bytes."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(*[repair_integer(F.col(c)).alias(c) if c in integers and kinds[c] == "binary" else F.col(c) for c in columns])


#: Spark type name -> native names
_NATIVE = {
    "tsql": {"integer": "INT", "long": "BIGINT", "short": "SMALLINT", "byte": "SMALLINT", "boolean": "BIT", "double": "FLOAT", "float": "REAL", "date": "DATE", "timestamp_ntz": "DATETIME2", "timestamp": "DATETIMEOFFSET", "binary": "VARBINARY(MAX)", "string": "NVARCHAR(MAX)"},
    "postgres": {"integer": "integer", "long": "bigint", "short": "smallint", "byte": "smallint", "boolean": "boolean", "double": "double precision", "float": "real", "date": "date", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp with time zone", "binary": "bytea", "string": "text"},
}


def extract_model(source, name: str = "database", dialect: str = "postgres", manifest: dict | None = None) -> Catalog:
    """The model of an endpoint's tables; a manifest {table: {primary_key, unique, checks, foreign_keys}, __views__: {name: query}} adds what files do not say.

    A part of the manifest that cannot be read becomes a warning; the rest goes on.
    """
    db = Catalog(name, dialect)
    notes = manifest if manifest is not None else (source.manifest() if hasattr(source, "manifest") else {})
    for t in source.table_names():
        table = Relation(t)
        for f in source.table(t).schema:
            kind = f.dataType.typeName()
            native = f"DECIMAL({f.dataType.precision},{f.dataType.scale})" if kind == "decimal" else _NATIVE[dialect].get(kind)
            if native is None:
                db.warnings.append(f"{t}.{f.name}: {f.dataType.simpleString()} needs review")
                native = f.dataType.simpleString()
            table.fields.append(Field(f.name, native, f.nullable))
        try:
            said = notes.get(t, {})
            if "primary_key" in said:
                table.rules.append(Rule("primary", f"pk_{t}", list(said["primary_key"])))
            table.rules += [Rule("unique", f"uq_{t}_{i}", list(k)) for i, k in enumerate(said.get("unique", []))]
            table.rules += [Rule("check", f"ck_{t}_{i}", condition=k) for i, k in enumerate(said.get("checks", []))]
            table.rules += [Rule("foreign", f"fk_{t}_{i}", list(k["columns"]), other=k["ref_table"], other_fields=list(k["ref_columns"]), on=dict(k.get("on", {}))) for i, k in enumerate(said.get("foreign_keys", []))]
        except (KeyError, TypeError) as e:
            db.warnings.append(f"the manifest of {t} could not be read: {e}")
        db.relations.append(table)
    db.relations += [Relation(v, query=text) for v, text in notes.get("__views__", {}).items()]
    return db
