"""Model, types, translators, DDL, migration: behaviour that no query shows."""

from uuid import uuid4

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbridge.functions import canonical, repair_integer
from tarnbridge.model import Access, Catalog, Code, Entry, Field, Relation, Rule, columns_frame, computed, default, identity, object_key, objects_frame, ordinals_frame
from tarnbridge.operators import changes, load, quality, verify
from tarnbridge.plans.convert import UnsupportedStatement, convert_sql
from tarnbridge.plans.ddl import assess, plan_ddl, short_name, strip_default, translate_default, view_select
from tarnbridge.plans.migrate import run_migration
from tarnbridge.sources import CatalogEndpoint, MemoryEndpoint, ParquetEndpoint, endpoint, extract_model
from tarnbridge.sqltext import split_statements, translate_expression, translate_query, translate_routine
from tarnbridge.types import convert_type, rebuild_type, to_spark


def shop() -> Catalog:
    items = Relation("dbo.Items", [Field("ItemID", "INT", False, identity()), Field("OrderID", "INT"), Field("Qty", "INT"), Field("Price", "DECIMAL(18,2)"), Field("Total", "DECIMAL(18,2)", filling=computed("([Qty]*[Price])")), Field("Odd", "SQL_VARIANT"), Field("On", "BIT", filling=default("((1))"))])
    items.rules = [Rule("primary", "PK_Items", ["ItemID"]), Rule("foreign", "FK_o", ["OrderID"], other="dbo.Orders", other_fields=["OrderID"], on={"delete": "CASCADE"}), Rule("check", "CK_q", condition="([Qty]>(0))")]
    items.accesses = [Access("IX_on", ["Qty"], where="[On]=(1)", carries=["Price"]), Access("CS", ["Qty"], "columnstore")]
    orders = Relation("dbo.Orders", [Field("OrderID", "INT", False), Field("At", "DATETIME", filling=default("(getdate())")), Field("Note", "NVARCHAR(MAX)", collation="SQL_Latin1_General_CP1_CI_AS")], [Rule("primary", "PK_Orders", ["OrderID"])])
    view = Relation("dbo.vOn", query="CREATE VIEW dbo.vOn AS WITH q AS (SELECT ItemID FROM dbo.Items WHERE [On] = 1) SELECT TOP 3 ItemID AS 'the id' FROM q")
    db = Catalog("shop", "tsql", [items, orders, view])
    db.entries += [Entry("sequence", "dbo.Seq", start=1, increment=1, current=500), Entry("synonym", "dbo.Its", target="[shop].[dbo].[Items]"), Entry("synonym", "dbo.P", target="dbo.proc", target_kind="procedure"), Entry("alias", "dbo.Phone", base="VARCHAR(11)")]
    db.entries += [Entry("role", "readers"), Entry("user", "app", member_of=["readers"]), Entry("role", "public")]
    db.entries += [Entry("grant", "readers", action="SELECT", securable="dbo.Orders", grantable=True), Entry("grant", "app", action="DELETE", securable="dbo.Orders", state="DENY")]
    return db


def test_types():
    assert convert_type("NVARCHAR(MAX)", "tsql", "postgres") == ("TEXT", None) and convert_type("nvarchar(50)", "tsql", "postgres") == ("VARCHAR(50)", None)
    assert convert_type("numeric(10,2)", "postgres", "tsql") == ("NUMERIC(10,2)", None) and convert_type("timestamp(3) without time zone", "postgres", "tsql") == ("DATETIME2(3)", None)
    assert convert_type("GEOGRAPHY", "tsql", "postgres")[0] is None and convert_type("inet", "postgres", "tsql")[1]
    assert to_spark("TINYINT", "tsql")[0] == T.ShortType() and to_spark("MONEY", "tsql")[0] == T.DecimalType(19, 4) and to_spark("timestamp", "tsql")[0] is None
    assert to_spark("timestamp", "postgres")[0] == T.TimestampNTZType() and to_spark("integer[]", "postgres", True)[0] == T.ArrayType(T.IntegerType())
    assert rebuild_type("nvarchar", -1) == "nvarchar(MAX)" and rebuild_type("nvarchar", 100) == "nvarchar(50)" and rebuild_type("datetime2", scale=7) == "datetime2"


def test_defaults_and_names():
    assert strip_default("((a)+(b))") == "(a)+(b)" and strip_default("(a)+(b)") == "(a)+(b)"
    assert translate_default("nextval('public.s'::regclass)", "postgres", "tsql") == "NEXT VALUE FOR [public].[s]"
    assert translate_default("'new'::character varying", "postgres", "tsql") == "'new'" and translate_default("((1))", "tsql", "postgres", True) == "TRUE"
    assert len(short_name("x" * 80).encode()) <= 63 and short_name("y" * 80) != short_name("y" * 81)
    assert object_key("[dbo].[T]") == object_key("public.t") != object_key("sales.t")
    assert view_select("CREATE VIEW v AS WITH a AS (SELECT 1 AS x) SELECT x FROM a").startswith("WITH")


def test_strings_and_comments_are_never_rewritten():
    assert translate_expression("'GETDATE() + [x]' + N'a'")[0] == "'GETDATE() + [x]' || 'a'"
    assert translate_query("SELECT a -- TOP 5\nFROM t")[0] == "SELECT a FROM t"


def test_top_and_bits():
    assert translate_query("SELECT TOP(5) a FROM t")[0] == translate_query("SELECT TOP 5 a FROM t")[0] == "SELECT a FROM t LIMIT 5"
    assert translate_query("SELECT TOP 5 PERCENT a FROM t")[0] == "SELECT * EXCEPT (__rank, __rows) FROM (SELECT a, ROW_NUMBER() OVER (ORDER BY NULL) AS __rank, COUNT(*) OVER () AS __rows FROM t) WHERE __rank <= CEIL(__rows * 5 / 100.0) ORDER BY __rank"
    assert translate_expression("b <> 1 AND b IN (0, 1)", bits=["b"])[0] == "b <> TRUE AND b IN (FALSE, TRUE)"
    assert translate_expression("a + 1 + b", integers=["a", "b"])[0] == "a + 1 + b"


def test_statements_without_semicolons():
    sql = "SET @x = 1 SELECT a FROM t UNION SELECT b FROM u INSERT INTO t (a) SELECT 1 UPDATE t SET a = 2 WHERE b = 3 SET NOCOUNT ON DECLARE @y INT ;WITH c AS (SELECT 1 AS z) SELECT z FROM c RETURN"
    assert [s[0].upper for s in split_statements(sql)] == ["SET", "SELECT", "INSERT", "UPDATE", "SET", "DECLARE", "WITH", "RETURN"]


def test_procedure_runs(spark):
    spark.range(10).createOrReplaceTempView("tb_t")
    p = translate_routine("CREATE PROCEDURE [dbo].[p] AS BEGIN SET NOCOUNT ON DECLARE @n INT = 2, @m INT SELECT @m = COUNT(*) FROM tb_t IF @m > 5 SET @n = 4 ELSE BEGIN SET @n = 1 END BEGIN TRY SELECT @n = @n + 1 END TRY BEGIN CATCH SET @n = 0 END CATCH SELECT id FROM tb_t WHERE id < @n END")
    assert spark.sql(p.sql).count() == 5 and len(p.results) == 1
    assert translate_routine("CREATE FUNCTION f() RETURNS INT AS BEGIN RETURN (SELECT COUNT(*) FROM master..spt_values) END").kind == "refused"


def test_ddl_plan(spark):
    steps, warnings = plan_ddl(shop(), "postgres")
    kinds = [s.kind for s in steps]
    assert kinds == sorted(kinds, key=lambda k: "schema type sequence table unique index foreign_key check view routine trigger synonym security".split().index(k))
    tables = [s.name for s in steps if s.kind == "table"]
    assert tables == ["dbo.Orders", "dbo.Items"]
    text = "\n".join(s.sql for s in steps)
    assert "GENERATED ALWAYS AS" in text and 'WHERE "On" = (1)' not in text and "ON DELETE CASCADE" in text and "setval('dbo.Seq', 500)" in text and "WITH GRANT OPTION" in text
    assert any("SQL_VARIANT" in w for w in warnings) and any("columnstore" in w for w in warnings) and any("DENY" in w for w in warnings) and any("procedure" in w for w in warnings)
    for s in plan_ddl(shop(), "spark")[0]:
        if s.kind in ("table", "view"):
            spark._jsparkSession.sessionState().sqlParser().parsePlan(s.sql)
    assert assess(shop())["readiness"] == "review"


def test_text_conversion():
    ddl = "CREATE TABLE [dbo].[E] ([Id] INT IDENTITY(1,1) NOT NULL PRIMARY KEY, [Pay] MONEY, [On] BIT DEFAULT 1, G UNIQUEIDENTIFIER DEFAULT NEWID(), N NVARCHAR(MAX), T TINYINT)"
    out = convert_sql(ddl, "mssql_to_postgres")
    for part in ('"Id" INTEGER', "NUMERIC(19,4)", "BOOLEAN DEFAULT TRUE", "UUID DEFAULT gen_random_uuid()", "TEXT", "SMALLINT", "PRIMARY KEY"):
        assert part in out.sql, (part, out.sql)
    back = convert_sql("CREATE TABLE o (id integer PRIMARY KEY, s varchar(20) DEFAULT 'new'::character varying, at timestamp DEFAULT now(), p numeric(19,4), c integer REFERENCES u (id) ON DELETE CASCADE)", "postgres_to_mssql")
    for part in ("NVARCHAR(20) DEFAULT 'new'", "DATETIME2 DEFAULT GETDATE()", "NUMERIC(19,4)", "FOREIGN KEY ([c]) REFERENCES [u] ([id]) ON DELETE CASCADE"):
        assert part in back.sql, (part, back.sql)
    assert convert_sql("SELECT TOP 2 [a] FROM t", "mssql_to_spark", "dml").sql == "SELECT `a` FROM t LIMIT 2;"
    for bad in (("x", "ddl"), ("mssql_to_postgres", "procedure")):
        with pytest.raises(UnsupportedStatement):
            convert_sql("CREATE TABLE t (a INT)", *bad)


def test_dependency_order_survives_cycles():
    a, b, c = (Relation(n) for n in "abc")
    refers = lambda to: Rule("foreign", f"to_{to}", ["x"], other=to, other_fields=["x"])
    a.rules, b.rules = [refers("b")], [refers("a"), refers("c")]
    order = [t.name for t in Catalog("d", "tsql", [a, b, c]).by_dependency()]
    assert sorted(order) == ["a", "b", "c"] and order.index("c") < order.index("b") < order.index("a")


def test_canonical_and_repair(spark):
    df = spark.sql("SELECT CAST(1.50 AS DECIMAL(10,2)) d, 1e7 f, CAST('2024-01-02 03:04:05.6' AS TIMESTAMP_NTZ) t, X'ff00' b, CAST(NULL AS INT) n, -0.0D z")
    got = df.select(*[canonical(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert tuple(got) == ("1.5", "10000000", "2024-01-02T03:04:05.600000", "base64:/wA=", None, "0")
    raw = spark.createDataFrame([(i.to_bytes(n, "little", signed=True), i) for i, n in ((1, 4), (-2, 4), (300, 2), (-1, 8), (2**40, 8))], "b binary, i long")
    assert all(r[0] == r[1] for r in raw.select(repair_integer(F.col("b")), "i").collect())


def test_fingerprint_detects_each_kind_of_change(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (2, "x:y", "")], "k int, u string, v string")
    base = tuple(verify.fingerprint(df).first())
    assert tuple(verify.fingerprint(df.orderBy(F.desc("k"), "v")).first()) == base
    others = [df.limit(2), df.union(df.limit(1)), df.withColumn("u", F.when(F.col("k") == 1, "b").otherwise(F.col("u"))), df.select("k", F.col("v").alias("u"), F.col("u").alias("v")), df.fillna("")]
    assert all(tuple(verify.fingerprint(o).first()) != base for o in others)
    assert verify.verify_table(df, df.withColumn("extra", F.lit(1)))["exact_match"] is False


def test_rejects_and_copy_text(spark):
    raw = spark.createDataFrame([("1", "ok"), ("x", "ok"), ("3", "too long"), (None, None)], "n string, s string")
    good, bad = load.cast_with_rejects(raw, {"n": T.IntegerType(), "s": T.VarcharType(4)}, ["n"])
    assert [tuple(r) for r in good.collect()] == [(1, "ok")] and sorted(r["reason"] for r in bad.collect()) == ["n: not a int", "n: null", "s: longer than 4"]
    line = load.copy_text(spark.createDataFrame([("a\tb\nc\\", bytearray(b"\xff\xd8"), True, None)], "s string, b binary, t boolean, n int")).first()[0]
    assert line == "a\\tb\\nc\\\\\t\\\\xffd8\tTrue\t\\N"


def test_migration(spark, tmp_path):
    db = shop()
    db.relations, db.entries = db.tables, []
    for t in db.tables:
        t.name = t.name.removeprefix("dbo.")
        for r in t.of("foreign"):
            r.other = "Orders"
    source = MemoryEndpoint(spark, {
        "Orders": spark.createDataFrame([(1, "x"), (2, "y")], "OrderID int, Note string").withColumn("At", F.lit("2024-01-01").cast("timestamp_ntz")),
        "Items": spark.createDataFrame([(1, 1, 2, 1.5, True), (2, 2, 3, 2.0, False), (3, 9, 0, 1.0, True)], "ItemID int, OrderID int, Qty int, Price double, On boolean"),
    })
    target = ParquetEndpoint(spark, str(tmp_path))
    report = run_migration(spark, source, target, db, workers=2)
    assert report.summary()["success"] is False and {(v["constraint_name"], v["kind"]): v["n"] for v in report.violations}[("FK_o", "foreign_key")] == 1
    assert {c["status"] for c in report.counts} == {"match"} and float(target.table("Items").filter("ItemID = 2").first()["Total"]) == 6.0
    source.tables["Items"] = source.tables["Items"].filter("ItemID < 3")
    assert run_migration(spark, source, target, db, reset=True).success
    assert run_migration(spark, source, target, db, cancelled=lambda: True).cancelled
    del source.tables["Orders"]
    assert {r.name: r.status for r in run_migration(spark, source, target, db).results} == {"Orders": "skipped", "Items": "success"}


def test_migration_tells_what_is_not_created(spark, tmp_path):
    table = Relation("T", [Field("a", "int")])
    source = MemoryEndpoint(spark, {"T": spark.createDataFrame([(1,)], "a int")})
    run = lambda *more: run_migration(spark, source, ParquetEndpoint(spark, str(tmp_path)), Catalog("d", "tsql", [table, *more]), reset=True)
    assert run().success
    with_view = run(Relation("V", query="SELECT a FROM T"))
    assert not with_view.success and {(r.kind, r.name): (r.status, r.detail) for r in with_view.results}["view", "V"] == ("skipped", "the target takes tables only")
    assert not run(Relation("Absent", [Field("a", "int")])).success


def test_migration_creates_objects_and_says_what_failed(spark):
    namespace = f"tb_moved_{uuid4().hex}"
    db = Catalog("shop", "tsql", [
        Relation("Lines", [Field("Id", "INT"), Field("Qty", "INT")]), Relation("Gone", [Field("Id", "INT")]),
        Relation("dbo.Outer1", query="CREATE VIEW dbo.Outer1 AS SELECT COUNT(*) AS n FROM dbo.Big"), Relation("dbo.Big", query="CREATE VIEW dbo.Big AS SELECT [Id] FROM [dbo].[Lines] WHERE Qty > 5"),
        Relation("dbo.OfGone", query="SELECT Id FROM dbo.Gone"), Relation("dbo.Broken", query="SELECT NoSuch FROM dbo.Lines"),
    ])
    db.code = [Code("scalar", "dbo.twice", "CREATE FUNCTION dbo.twice(@n INT) RETURNS INT AS BEGIN RETURN @n * 2 END"), Code("trigger", "dbo.tr", "...", "dbo.Lines", "AFTER", ("INSERT",))]
    db.entries = [Entry("synonym", "dbo.L", target="[shop].[dbo].[Lines]"), Entry("synonym", "dbo.P", target="dbo.proc", target_kind="procedure"), Entry("sequence", "dbo.S", start=1)]
    source = MemoryEndpoint(spark, {"Lines": spark.createDataFrame([(i, i) for i in range(10)], "Id int, Qty int")})
    target = CatalogEndpoint(spark, namespace)
    report = run_migration(spark, source, target, db)
    got = {(r.kind, r.name): r.status for r in report.results}
    assert got == {
        ("table", "Lines"): "success", ("table", "Gone"): "skipped", ("view", "dbo.Outer1"): "success", ("view", "dbo.Big"): "success", ("view", "dbo.OfGone"): "skipped", ("view", "dbo.Broken"): "failed",
        ("routine", "dbo.twice"): "success", ("trigger", "dbo.tr"): "skipped", ("synonym", "dbo.L"): "success", ("synonym", "dbo.P"): "skipped", ("sequence", "dbo.S"): "skipped",
    }
    assert target.execute("SELECT n FROM Outer1").first()[0] == 4 and target.execute("SELECT count(*) FROM L").first()[0] == 10 and target.execute("SELECT twice(21)").first()[0] == 42
    target.append("Lines", spark.createDataFrame([(6, 60)], "Qty int, Id int"))
    assert target.execute("SELECT n FROM Outer1").first()[0] == 5
    spark.sql(f"DROP DATABASE {namespace} CASCADE")


def test_objects_compare_with_their_bodies(spark):
    def pg(condition, query):
        t = Relation("public.items", [Field("qty", "integer", filling=default("0"))], [Rule("check", "ck", condition=condition), Rule("foreign", "f", ["qty"], other="public.o", other_fields=["id"], on={"delete": "CASCADE"})])
        return Catalog("p", "postgres", [t, Relation("public.v", query=query)], entries=[Entry("role", "r"), Entry("grant", "r", action="SELECT", securable="public.items")])

    s = Catalog("s", "tsql", [Relation("dbo.Items", [Field("Qty", "INT", filling=default("((0))"))], [Rule("check", "CK", condition="([Qty]>(0))"), Rule("foreign", "g", ["Qty"], other="dbo.O", other_fields=["Id"], on={"delete": "CASCADE"})]), Relation("dbo.V", query="CREATE VIEW dbo.V AS SELECT [Qty] FROM [dbo].[Items]")])
    s.entries = [Entry("role", "R"), Entry("grant", "R", action="SELECT", securable="dbo.Items")]
    status = lambda t: {r["section"]: r["status"] for r in verify.pair(objects_frame(spark, s), objects_frame(spark, t)).collect()}
    assert set(status(pg("qty > 0", "SELECT qty FROM public.items")).values()) == {"match"}
    other = status(pg("qty > 1", "SELECT qty + 1 AS qty FROM public.items"))
    assert other["checks"] == other["views"] == "different" and other["tables"] == "match"
    assert ordinals_frame(spark, s).first()["definition"] == "1"


def test_endpoints_and_models(spark, tmp_path):
    cat = CatalogEndpoint(spark, "tb_ns")
    cat.write("t1", spark.range(3))
    assert cat.table_names() == ["t1"] and cat.table("t1").count() == 3
    db = extract_model(cat, manifest={"t1": {"primary_key": ["id"]}})
    assert db.tables[0].key.fields == ["id"] and db.tables[0].fields[0].native == "bigint"
    cat.drop("t1")
    with pytest.raises(ValueError):
        endpoint("oracle", spark)
    url = endpoint("postgres", spark, host="h", database="d", user="u", password="secret")
    assert url.url == "jdbc:postgresql://h:5432/d" and "secret" not in repr(url)
    s = shop()
    assert verify.all_match(verify.pair(objects_frame(spark, s), objects_frame(spark, s))) and columns_frame(spark, s).count() == 10
    assert quality.duplicate_keys(spark.createDataFrame([(1,), (1,), (None,), (None,)], "a int"), ["a"]).count() == 1


def test_instead_of_trigger_and_abort(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    seen = []
    batch = changes.delete_batch("t", t, t.filter("k = 1"), ["k"])
    after, _ = changes.apply_change(t, batch, ["k"], [changes.Handler(frozenset({"DELETE"}), lambda b: seen.append(b.deleted.count()), "INSTEAD")])
    assert seen == [1] and after.count() == 2

    def refuse(batch):
        raise ValueError("no")

    with pytest.raises(ValueError):
        changes.apply_change(t, changes.insert_batch("t", t), ["k"], [changes.Handler(frozenset({"INSERT"}), refuse)])
    batch = changes.update_batch("t", t, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"])
    assert [tuple(r) for r in changes.changed_columns(batch, ["k"]).collect()] == [(1, "v", "a", "z")]


def test_break_and_continue_leave_and_repeat_the_innermost_loop(spark):
    p = translate_routine("CREATE PROCEDURE dbo.p AS BEGIN DECLARE @i INT = 0, @odd INT = 0; WHILE 1 = 1 BEGIN SET @i = @i + 1; IF @i > 6 BREAK; IF @i % 2 = 0 CONTINUE; SET @odd = @odd + @i END SELECT @i AS i, @odd AS odd END")
    assert not p.warnings
    assert tuple(spark.sql(p.sql).first()) == (7, 9)


def test_postgres_queries_for_sql_server():
    to = lambda q: translate_query(q, "postgres", "tsql", strings=["s"])[0]
    assert to("SELECT a FROM t ORDER BY a LIMIT 10") == "SELECT TOP (10) a FROM t ORDER BY a" and to("SELECT DISTINCT a FROM t LIMIT 3") == "SELECT DISTINCT TOP (3) a FROM t"
    assert to("SELECT a FROM t ORDER BY a LIMIT 10 OFFSET 20") == "SELECT a FROM t ORDER BY a OFFSET 20 ROWS FETCH NEXT 10 ROWS ONLY"
    assert to("SELECT a FROM t OFFSET 5") == "SELECT a FROM t ORDER BY (SELECT NULL) OFFSET 5 ROWS" and to("SELECT a FROM t LIMIT ALL") == "SELECT a FROM t"
    assert to("SELECT a FROM t UNION SELECT b FROM u ORDER BY a LIMIT 4") == "SELECT TOP (4) * FROM (SELECT a FROM t UNION SELECT b FROM u) AS limited ORDER BY a"
    assert to("WITH RECURSIVE q AS (SELECT 1 AS x LIMIT 1) SELECT x FROM q LIMIT 2") == "WITH q AS (SELECT TOP (1) 1 AS x) SELECT TOP (2) x FROM q"
    assert to("SELECT a::text, x.b::numeric(10,2), 'p' || s FROM x WHERE s ilike 'q%'") == "SELECT CAST(a AS NVARCHAR(MAX)), CAST(x.b AS NUMERIC(10,2)), 'p' + s FROM x WHERE s LIKE 'q%'"
    e = lambda q, target="tsql": translate_expression(q, "postgres", target)[0]
    assert e("position('a' in f(b, 'x in y'))") == "CHARINDEX('a', f(b, 'x in y'))" and e("overlay(a placing 'x' from 1 for 2)") == "STUFF(a, 1, 2, 'x')" and e("OVERLAY(a PLACING 'xy' FROM 3)") == "STUFF(a, 3, LEN('xy'), 'xy')"
    assert e("substring(a from 2 for 3)") == "SUBSTRING(a, 2, 3)" and e("extract(year from at)") == "DATEPART(YEAR, at)" and "DATEDIFF_BIG(MICROSECOND" in e("EXTRACT(EPOCH FROM at)") and e("strpos(a, 'b')") == "CHARINDEX('b', a)"
    assert e("CAST(a AS timestamp without time zone)", "spark") == "CAST(a AS TIMESTAMP_NTZ)" and e("extract(dow from at)", "spark") == "(DAYOFWEEK(at) - 1)"


def test_what_has_no_counterpart_is_refused():
    for body in ("BEGIN DECLARE c CURSOR FOR SELECT a FROM t OPEN c END", "BEGIN SELECT 1 AS x GOTO done END"):
        t = translate_routine(f"CREATE PROCEDURE dbo.p AS {body}")
        assert (t.kind, t.sql) == ("refused", "") and t.warnings
    assert translate_routine("CREATE FUNCTION dbo.f(@n INT) RETURNS @r TABLE (a INT) AS BEGIN IF @n > 1 INSERT INTO @r SELECT 1 RETURN END").kind == "refused"
    with pytest.raises(UnsupportedStatement):
        convert_sql("SELECT DISTINCT TOP 5 PERCENT a FROM t", "mssql_to_spark", "dml")
    assert translate_expression("FORMAT(a, 'N2')")[1]


def test_names_and_times():
    assert translate_expression("[a]]b] + 1")[0] == "`a]b` + 1" and to_spark("time", "tsql")[0] == T.StringType()
    assert "DATEADD" not in translate_expression("DATEADD(ms, 5, a)")[0] and not translate_expression("DATEDIFF(millisecond, a, b)")[1]
    t = convert_sql("CREATE TABLE t (a text[], b int)", "postgres_to_mssql")
    assert any("text[]" in w for w in t.warnings) and "[a]" not in t.sql
