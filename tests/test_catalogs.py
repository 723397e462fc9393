"""Models from the rows of both servers' catalogs."""

from tarnbridge.model import objects_frame
from tarnbridge.operators import verify
from tarnbridge.plans.ddl import plan_ddl
from tarnbridge.sources.catalogs import FRAMES, LISTINGS, catalog_from_frames, list_catalog, parse_bounds, renames


def frames(spark, **rows):
    return {k: spark.createDataFrame(v, FRAMES[k]) for k, v in rows.items()}


def sales(spark):
    return frames(
        spark,
        relations=[("dbo.Orders", "table", None, "At", True, False), ("dbo.Lines", "table", None, None, False, False), ("dbo.vBig", "stored_view", "CREATE VIEW dbo.vBig AS SELECT Id FROM dbo.Orders WHERE Total > 5", None, False, False)],
        fields=[
            ("dbo.Orders", 2, "At", "datetime2", 8, 27, 7, False, "(sysdatetime())", None, None, None, None, None, "when"), ("dbo.Orders", 1, "Id", "int", 4, 10, 0, False, None, 100, 5, None, None, None, None),
            ("dbo.Orders", 3, "Total", "decimal", 9, 18, 2, True, "((0))", None, None, None, None, None, None), ("dbo.Orders", 4, "Twice", "decimal", 9, 18, 2, True, None, None, None, "([Total]*(2))", True, None, None),
            ("dbo.Lines", 1, "OrderId", "int", 4, 10, 0, True, None, None, None, None, None, None, None), ("dbo.Lines", 2, "Text", "nvarchar", 100, 0, 0, True, None, None, None, None, None, "Latin1_General_CI_AS", None), ("dbo.Nowhere", 1, "x", "int", 4, 10, 0, True, None, None, None, None, None, None, None),
        ],
        rules=[
            ("dbo.Orders", "primary", "PK_O", 1, "Id", None, None, None, None, None), ("dbo.Orders", "unique", "UQ_O", 2, "Total", None, None, None, None, None), ("dbo.Orders", "unique", "UQ_O", 1, "At", None, None, None, None, None),
            ("dbo.Orders", "check", "CK_O", 1, None, "([Total]>=(0))", None, None, None, None), ("dbo.Lines", "foreign", "FK_L", 1, "OrderId", None, "dbo.Orders", "Id", "CASCADE", "NO ACTION"),
        ],
        accesses=[("dbo.Lines", "IX_L", 1, "OrderId", False, "rowstore", "([Text] IS NOT NULL)", False, False), ("dbo.Lines", "IX_L", 1002, "Text", True, "rowstore", "([Text] IS NOT NULL)", False, False)],
        code=[("trigger", "dbo.tr", "CREATE TRIGGER ...", "dbo.Orders", "AFTER", "UPDATE,INSERT"), ("scalar", "dbo.f", "CREATE FUNCTION dbo.f() ...", None, None, None)],
        entries=[("sequence", "dbo.S", {"start": "10", "increment": "2", "cycle": "1"}), ("synonym", "dbo.O", {"target": "[shop].[dbo].[Orders]", "target_kind": "table"}), ("user", "app", {"member_of": "readers,writers"}), ("role", "readers", None), ("grant", "readers", {"action": "SELECT", "securable": "dbo.Orders", "grantable": "1"}), ("assembly", "x", None)],
    )


def test_sql_server_rows(spark):
    db = catalog_from_frames(sales(spark), "shop", "tsql", ["spans could not be listed"])
    orders, lines = db.relation("dbo.orders"), db.relation("dbo.Lines")
    assert [(f.name, f.native, f.nullable) for f in orders.fields] == [("Id", "int", False), ("At", "datetime2", False), ("Total", "decimal(18,2)", True), ("Twice", "decimal(18,2)", True)]
    assert (orders.fields[0].filling.start, orders.fields[0].filling.step) == (100, 5) and orders.fields[3].filled_by("computed").stored and orders.fields[1].note == "when" and lines.fields[1].native == "nvarchar(50)"
    assert orders.key.fields == ["Id"] and orders.of("unique")[0].fields == ["At", "Total"] and orders.of("check")[0].condition == "([Total]>=(0))" and orders.traits == {"temporal"} and orders.split_by == "At"
    assert (lines.of("foreign")[0].other, lines.of("foreign")[0].other_fields, lines.of("foreign")[0].on) == ("dbo.Orders", ["Id"], {"delete": "CASCADE"})
    assert (lines.accesses[0].fields, lines.accesses[0].carries, lines.accesses[0].where) == (["OrderId"], ["Text"], "([Text] IS NOT NULL)")
    assert db.views[0].stored and db.triggers[0].events == ("INSERT", "UPDATE") and db.routines[0].kind == "scalar"
    assert db.entries_of("sequence")[0].increment == 2 and db.entries_of("user")[0].member_of == ["readers", "writers"] and db.entries_of("grant")[0].grantable is True
    assert len(db.warnings) == 3 and any("Nowhere" in w for w in db.warnings) and any("assembly" in w for w in db.warnings)
    text = "\n".join(s.sql for s in plan_ddl(db, "postgres")[0])
    for part in ("START WITH 100 INCREMENT BY 5", "FOREIGN KEY", "CHECK", "CREATE MATERIALIZED VIEW", "CREATE SEQUENCE", "INCLUDE"):
        assert part in text, part


def test_postgres_rows_and_comparison(spark):
    pg = catalog_from_frames(frames(
        spark,
        relations=[("public.orders", "table", None, "RANGE (at)", False, False), ("public.o", "view", " SELECT orders.id,\n    orders.at\n   FROM public.orders;", None, False, False), ("public.v", "view", "SELECT id FROM public.orders WHERE id > 5", None, False, False)],
        fields=[("public.orders", 1, "id", "integer", None, None, None, False, None, 1, 1, None, False, None, None), ("public.orders", 2, "at", "timestamp without time zone", None, None, None, True, "now()", None, None, None, False, None, None)],
        spans=[("public.orders", 1, "o_1", "FOR VALUES FROM (MINVALUE) TO ('2024-01-01 00:00:00')"), ("public.orders", 2, "o_2", "FOR VALUES FROM ('2024-01-01 00:00:00') TO (MAXVALUE)")],
    ), "shop", "postgres")
    assert [(s.low, s.high) for s in pg.relation("public.orders").spans] == [(None, "2024-01-01 00:00:00"), ("2024-01-01 00:00:00", None)] and pg.relation("public.orders").split_by == "at"
    assert [(e.name, e.target) for e in pg.entries_of("synonym")] == [("public.o", "public.orders")] and [v.name for v in pg.views] == ["public.v"]
    got = {(r["section"], r["key"]): r["status"] for r in verify.pair(objects_frame(spark, catalog_from_frames(sales(spark), "s", "tsql")), objects_frame(spark, pg)).collect()}
    assert got["tables", "default.orders"] == "match" and got["tables", "default.lines"] == "source_only" and got["synonyms", "default.o"] == "match" and got["views", "default.v"] == "target_only"


def test_listing_goes_on_without_a_part(spark):
    def query(sql):
        if "pg_trigger" in sql:
            raise PermissionError("no right\nto read")
        return sql

    for dialect in LISTINGS:
        assert set(LISTINGS[dialect]) <= set(FRAMES)
    got, warnings = list_catalog(query, "postgres")
    assert "code" not in got and "fields" in got and warnings == ["code could not be listed: no right"]


def test_small_parts():
    assert parse_bounds("DEFAULT") == (None, None) and parse_bounds("FOR VALUES FROM (1) TO (10)") == ("1", "10")
    assert renames("SELECT * FROM a.b") == "a.b" and renames("SELECT x AS y FROM b") is None and renames("SELECT x FROM b WHERE x > 1") is None and renames("SELECT x + 1 FROM b") is None and renames("SELECT x y FROM b") is None
