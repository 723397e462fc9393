"""Queries over the shared tables, one for each operator that has rows, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import date_diff, elapsed_diff
from .model import Catalog, Field, Relation, Span, columns_frame, computed
from .operators import changes, load, quality, triggers, verify
from .sources import ParquetEndpoint, extract_model, scan
from .sqltext import translate_expression, translate_query, translate_routine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_source(spark, d):
    return read(spark, d, "orders").filter("o_orderkey % 97 <> 3")


def orders_target(spark, d):
    return read(spark, d, "orders").filter("o_orderkey % 89 <> 7").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 101 == 5, "X").otherwise(F.col("o_orderstatus")))


_S = "(SELECT * FROM orders WHERE o_orderkey % 97 <> 3)"
_T = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 101 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 89 <> 7)"
_STATUS = "CASE WHEN t.o_orderkey IS NULL THEN 'source_only' WHEN s.o_orderkey IS NULL THEN 'target_only' WHEN s.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus AND s.o_orderpriority IS NOT DISTINCT FROM t.o_orderpriority THEN 'match' ELSE 'different' END"


# ---- verification ----


@query(f"SELECT {_STATUS} AS status, count(*) AS n FROM {_S} s FULL JOIN {_T} t ON s.o_orderkey = t.o_orderkey GROUP BY 1")
def v08_row_diff_orders(spark, d):
    return verify.tally(verify.row_diff(orders_source(spark, d), orders_target(spark, d), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]))


@query(f"SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, {_STATUS} AS status FROM {_S} s FULL JOIN {_T} t ON s.o_orderkey = t.o_orderkey WHERE {_STATUS} <> 'match'")
def v08_row_diff_changed_keys(spark, d):
    return verify.row_diff(orders_source(spark, d), orders_target(spark, d), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]).filter("status <> 'match'").select("o_orderkey", "status")


@query("""SELECT CASE WHEN t.conv_id IS NULL THEN 'source_only' WHEN s.conv_id IS NULL THEN 'target_only' WHEN s.role IS NOT DISTINCT FROM t.role AND s.text IS NOT DISTINCT FROM t.text THEN 'match' ELSE 'different' END AS status, count(*) AS n
FROM (SELECT * FROM conversations WHERE turn % 7 <> 3) s FULL JOIN (SELECT conv_id, turn, role, nullif(text, CASE WHEN conv_id % 5 = 0 THEN text END) AS text FROM conversations WHERE conv_id % 11 <> 2) t ON s.conv_id = t.conv_id AND s.turn = t.turn GROUP BY 1""")
def v08_row_diff_composite_key(spark, d):
    c = read(spark, d, "conversations")
    target = c.filter("conv_id % 11 <> 2").withColumn("text", F.when(F.col("conv_id") % 5 != 0, F.col("text")))
    return verify.tally(verify.row_diff(c.filter("turn % 7 <> 3"), target, ["conv_id", "turn"]))


@query("""SELECT c_custkey, 'different' AS status FROM customer WHERE c_custkey % 13 = 4""")
def v08_row_diff_null_swap(spark, d):
    c = read(spark, d, "customer")
    swapped = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 13 != 4, F.col("c_mktsegment")))
    return verify.row_diff(c, swapped, ["C_CUSTKEY"]).filter("status <> 'match'").select("c_custkey", "status")


@query(f"""SELECT o_orderkey, status FROM (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, {_STATUS} AS status FROM {_S} s FULL JOIN {_T} t ON s.o_orderkey = t.o_orderkey) ORDER BY o_orderkey LIMIT 50 OFFSET 100""")
def v08_row_diff_page(spark, d):
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    return verify.diff_page(orders_source(spark, d).select(*cols), orders_target(spark, d).select(*cols), ["o_orderkey"], 3, 50).select("o_orderkey", "status")


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY event_id) AS position, event_id, event_type FROM events),
t AS (SELECT row_number() OVER (ORDER BY event_id) AS position, event_id, event_type FROM events WHERE event_id % 1000 <> 500)
SELECT CASE WHEN t.position IS NULL THEN 'source_only' WHEN s.position IS NULL THEN 'target_only' WHEN s.event_id = t.event_id AND s.event_type IS NOT DISTINCT FROM t.event_type THEN 'match' ELSE 'different' END AS status, count(*) AS n FROM s FULL JOIN t ON s.position = t.position GROUP BY 1""")
def v09_positional_diff_events(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type")
    return verify.tally(verify.positional_diff(e, e.filter("event_id % 1000 <> 500"), ["event_id"]))


_FIELDS = "l_orderkey l_partkey l_suppkey l_linenumber".split()
_MONEY = "l_quantity l_extendedprice l_discount l_tax".split()
_ROW_SQL = " || '|' || ".join([*(f"CAST({c} AS VARCHAR)" for c in _FIELDS), *(f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)" for c in _MONEY), "l_returnflag", "l_linestatus", "strftime(l_shipdate, '%Y-%m-%d')"])


@query("WITH h AS (SELECT sha256(" + _ROW_SQL + ") AS h FROM lineitem), p AS (SELECT " + ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS p{i}" for i in range(8)) + " FROM h) SELECT count(*) AS n, " + ", ".join(f"CAST(sum(p{i}) AS VARCHAR) AS sum{i}, bit_xor(p{i}) AS xor{i}" for i in range(8)) + " FROM p")
def v12_fingerprint_lineitem(spark, d):
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in _FIELDS], *[F.col(c).cast("decimal(18,2)").cast("string") for c in _MONEY], "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd"))
    parts = verify.fingerprint_parts(read(spark, d, "lineitem"), text=text)
    return parts.select("n", *[F.col(f"sum{i}").cast("string").alias(f"sum{i}") for i in range(8)], *[f"xor{i}" for i in range(8)])


@query("SELECT 'shuffled' AS side, true AS equal UNION ALL SELECT 'one row twice', false UNION ALL SELECT 'one value changed', false")
def v13_fingerprint_detects_changes(spark, d):
    o = read(spark, d, "orders")
    base = verify.fingerprint(o).select(F.col("digest").alias("base"))
    one = o.agg(F.min("o_orderkey").alias("k"))
    first = o.join(F.broadcast(one), o["o_orderkey"] == one["k"], "left_semi")
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(F.col("o_custkey").isNotNull() & (F.col("o_orderkey") % 2 == 0), "?").otherwise(F.col("o_orderstatus")))
    sides = {"shuffled": o.orderBy(F.desc("o_custkey"), "o_orderkey"), "one row twice": o.unionByName(first.limit(1)), "one value changed": changed}
    out = None
    for name, df in sides.items():
        row = verify.fingerprint(df).join(F.broadcast(base)).select(F.lit(name).alias("side"), (F.col("digest") == F.col("base")).alias("equal"))
        out = row if out is None else out.union(row)
    return out


_TABLES = "region nation customer supplier part orders lineitem events".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES) + " UNION ALL SELECT 'TOTAL', " + " + ".join(f"(SELECT count(*) FROM {t})" for t in _TABLES))
def vs08_row_counts(spark, d):
    return verify.with_total(verify.row_counts({t: read(spark, d, t) for t in _TABLES}))


@query("SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_n, (SELECT count(*) FROM orders WHERE o_orderkey % 89 <> 7) AS target_n, 'different' AS status UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer), 'match' UNION ALL SELECT 'part', (SELECT count(*) FROM part), NULL, 'source_only' UNION ALL SELECT 'supplier', NULL, (SELECT count(*) FROM supplier), 'target_only'")
def o06_compare_counts(spark, d):
    r = lambda t: read(spark, d, t)
    return verify.compare_counts({"orders": r("orders"), "customer": r("customer"), "part": r("part")}, {"orders": orders_target(spark, d), "customer": r("customer"), "supplier": r("supplier")})


def _two_models() -> tuple[Catalog, Catalog]:
    s = Catalog("s", "tsql", [Relation("dbo.Products", [Field("Id", "INT", False), Field("Name", "NVARCHAR(50)"), Field("Price", "MONEY"), Field("Old", "INT")])])
    t = Catalog("t", "postgres", [Relation("public.products", [Field("id", "integer", False), Field("name", "character varying(50)"), Field("price", "numeric(10,2)"), Field("new", "text")])])
    return s, t


@query("SELECT * FROM (VALUES ('default.products.id', 'match'), ('default.products.name', 'match'), ('default.products.price', 'different'), ('default.products.old', 'source_only'), ('default.products.new', 'target_only')) AS v(key, status)")
def v04_pair_columns(spark, d):
    s, t = _two_models()
    return verify.pair(columns_frame(spark, s), columns_frame(spark, t)).select("key", "status")


@query("SELECT table_name, CAST(count(*) AS INTEGER) AS n_columns FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{t}'" for t in _TABLES) + ") AND NOT internal GROUP BY table_name")
def vs09_column_counts(spark, d):
    db = extract_model(ParquetEndpoint(spark, d), manifest={})
    rows = [(t.name, c.name) for t in db.tables for c in t.fields if t.name in _TABLES]
    return spark.createDataFrame(rows, "table_name string, c string").groupBy("table_name").agg(F.count("*").cast("int").alias("n_columns"))


# ---- scans and pages ----


@query("SELECT c_nationkey, c_custkey, c_name FROM customer WHERE (c_nationkey, c_custkey) > (7, 100) ORDER BY c_nationkey, c_custkey LIMIT 200")
def s10_keyset_page(spark, d):
    return verify.after_key(read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey", "c_custkey"], [7, 100], 200)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 150")
def s22_offset_page(spark, d):
    return verify.page(read(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], 4, 50)


@query("SELECT max(o_orderkey) + 1 AS next_value FROM orders")
def s15_next_identity(spark, d):
    return load.next_identity(read(spark, d, "orders"), "o_orderkey")


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def s11_integers_from_bytes(spark, d):
    # little-endian bytes of each key, as some servers deliver them
    raw = read(spark, d, "supplier").select(F.reverse(F.hex(F.lit(0))).alias("x"), "s_suppkey", "s_nationkey")
    hexed = F.lpad(F.hex("s_suppkey"), 8, "0")
    little = F.unhex(F.concat(*[F.substring(hexed, i, 2) for i in (7, 5, 3, 1)]))
    return scan(raw.select(little.alias("s_suppkey"), "s_nationkey"), ["s_suppkey", "s_nationkey"], ["s_suppkey"])


@query("""SELECT concat_ws(chr(9), CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 5 = 0 THEN '\\N' ELSE replace(n_name, 'A', '\\t') END, CAST(n_regionkey AS VARCHAR)) AS line FROM nation""")
def s18_copy_text(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 0, F.replace("n_name", F.lit("A"), F.lit("\t"))).alias("n_name"), "n_regionkey")
    return load.copy_text(n)


# ---- constraints ----


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d08_duplicate_keys(spark, d):
    return quality.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def d10_orphans(spark, d):
    parent = read(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'")
    return quality.orphans(read(spark, d, "orders"), ["o_custkey"], parent, ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size BETWEEN 5 AND 40 AND p_retailprice > 0)")
def d11_check_violations(spark, d):
    return quality.check_violations(read(spark, d, "part"), "([p_size] BETWEEN 5 AND 40 AND [p_retailprice] > 0)", "tsql").select("p_partkey", "p_size")


# ---- loading ----


@query("SELECT CASE WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'o_p1' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'o_p2' ELSE 'o_p3' END AS partition_name, count(*) AS n FROM orders GROUP BY 1")
def x22_partition_assignment(spark, d):
    bounds = [F.lit(x).cast("timestamp_ntz") for x in ("1994-01-01", "1996-01-01")]
    parts = [Span("o_p1", None, bounds[0]), Span("o_p2", bounds[0], bounds[1]), Span("o_p3", bounds[1], None)]
    return read(spark, d, "orders").groupBy(load.partition_of(F.col("o_orderdate"), parts).alias("partition_name")).agg(F.count("*").alias("n"))


@query("SELECT 'good' AS side, count(*) AS n FROM part WHERE TRY_CAST(substr(p_name, 1, 2) AS INTEGER) IS NOT NULL AND length(p_brand) <= 8 UNION ALL SELECT 'rejected', count(*) FROM part WHERE NOT (TRY_CAST(substr(p_name, 1, 2) AS INTEGER) IS NOT NULL AND length(p_brand) <= 8)")
def m07_rejects(spark, d):
    raw = read(spark, d, "part").select("p_partkey", F.substring("p_name", 1, 2).alias("code"), "p_brand")
    good, rejects = load.cast_with_rejects(raw, {"code": T.IntegerType(), "p_brand": T.VarcharType(8)})
    return good.agg(F.lit("good").alias("side"), F.count("*").alias("n")).union(rejects.agg(F.lit("rejected"), F.count("*")))


@query("SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))), 2) AS DECIMAL(18,2)) AS net FROM lineitem")
def d04_computed_column(spark, d):
    money = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_discount").cast("decimal(18,2)").alias("discount"))
    table = Relation("l", [Field("net", "DECIMAL(18,2)", filling=computed("([price]*(1-[discount]))"))])
    return load.with_computed(money, table, "tsql").select("l_orderkey", "l_linenumber", "net")


@query("SELECT s_suppkey, 1000 + 5 * (row_number() OVER (ORDER BY s_name, s_suppkey) - 1) AS id FROM supplier")
def d14_sequence_values(spark, d):
    return load.with_identity(read(spark, d, "supplier").select("s_suppkey", "s_name"), "id", ["s_name", "s_suppkey"], 1000, 5).select("s_suppkey", "id")


# lineitem holds rows of one key twice, so that only the set of identities is certain
@query("SELECT count(*) AS n, count(*) AS n_distinct, min(id) AS low, max(id) AS high, sum(CASE WHEN id = k THEN 1 ELSE 0 END) AS in_order FROM (SELECT 7 * row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, 7 * row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)")
def d14_identity_of_lineitem(spark, d):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    numbered = load.with_identity(read(spark, d, "lineitem"), "id", order, 7, 7)
    # whoever comes behind in order has the next identity
    near = F.struct(*order) >= F.lag(F.struct(*order)).over(W.partitionBy(F.floor(F.col("id") / 70_000)).orderBy("id"))
    checked = numbered.withColumn("ok", F.coalesce(near, F.lit(True)))
    return checked.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_distinct"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.col("ok").cast("long")).alias("in_order"))


@query("SELECT k, CASE WHEN a = b OR (isnan(a) AND isnan(b)) THEN 'match' ELSE 'different' END AS status FROM (SELECT event_id AS k, x / 3 AS a, CASE event_id % 5 WHEN 0 THEN x / 3 WHEN 1 THEN x / 3 + 1e-8 WHEN 2 THEN (x / 3) * 1e16 WHEN 3 THEN 'nan'::DOUBLE ELSE -0.0 END AS b FROM (SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0.0 WHEN event_id % 15 = 3 THEN 'nan'::DOUBLE ELSE 1.0 * event_id END AS x FROM events))")
def v07_doubles_as_they_are(spark, d):
    e, nan = read(spark, d, "events").select(F.col("event_id").alias("k")), F.lit(float("nan"))
    x = F.when(F.col("k") % 5 == 4, F.lit(0.0)).when(F.col("k") % 15 == 3, nan).otherwise(F.col("k").cast("double")) / 3
    kind = F.col("k") % 5
    b = F.when(kind == 0, x).when(kind == 1, x + F.lit(1e-8)).when(kind == 2, x * F.lit(1e16)).when(kind == 3, nan).otherwise(F.lit(-0.0))
    return verify.row_diff(e.withColumn("a", x), e.withColumn("a", b), ["k"]).select("k", "status")


# ---- expressions: T-SQL in, rows out ----


def _tsql(spark, d, table: str, columns: dict[str, str], extra: dict | None = None) -> DataFrame:
    df = read(spark, d, table)
    integers = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType))]
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.select(*[F.expr(translate_expression(sql, "tsql", "spark", integers=integers, strings=strings, **(extra or {}))[0]).alias(name) for name, sql in columns.items()])


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS sign, c_name || ' (' || c_mktsegment || ')' AS label, length(c_name) AS len FROM customer")
def f04_isnull_iif_concat(spark, d):
    return _tsql(spark, d, "customer", {"c_custkey": "[c_custkey]", "segment": "ISNULL(NULLIF(c_mktsegment, N'BUILDING'), 'none')", "sign": "IIF(c_acctbal > 0, 'plus', 'minus')", "label": "c_name + N' (' + [c_mktsegment] + ')'", "len": "LEN(c_name)"})


@query("SELECT c_custkey, position('0' IN c_name) AS at, overlay AS stuffed, repeat(' ', 3) || 'x' AS spaced, ceil(c_acctbal) AS up, power(c_nationkey, 2) AS squared FROM (SELECT *, 'Z' || substr(c_name, 4) AS overlay FROM customer)")
def f14_string_functions(spark, d):
    return _tsql(spark, d, "customer", {"c_custkey": "c_custkey", "at": "CHARINDEX('0', c_name)", "stuffed": "STUFF(c_name, 1, 3, 'Z')", "spaced": "SPACE(3) + 'x'", "up": "CAST(CEILING(c_acctbal) AS FLOAT)", "squared": "SQUARE(c_nationkey)"})


@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS plus_month, o_orderdate - INTERVAL 10 DAY AS minus_days, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dw, CAST(weekofyear(o_orderdate) AS INTEGER) AS wk FROM orders")
def f09_dateadd_datepart(spark, d):
    return _tsql(spark, d, "orders", {"o_orderkey": "o_orderkey", "plus_month": "DATEADD(mm, 1, o_orderdate)", "minus_days": "DATEADD(day, -10, o_orderdate)", "y": "YEAR(o_orderdate)", "m": "DATEPART(month, o_orderdate)", "dw": "DATEPART(dw, o_orderdate)", "wk": "DATEPART(week, o_orderdate)"})


_SHIP = "TIMESTAMP '1998-09-02 23:30:00'"


@query("SELECT event_id, " + ", ".join(f"CAST(datediff('{p}', ts, TIMESTAMP '2024-03-05 23:30:00') AS INTEGER) AS in_{p}" for p in ("year", "quarter", "month", "day", "hour", "minute", "second")) + " FROM events")
def f10_datediff_boundaries(spark, d):
    to = F.lit("2024-03-05 23:30:00").cast("timestamp_ntz")
    return read(spark, d, "events").select("event_id", *[date_diff(p, F.col("ts"), to).cast("int").alias(f"in_{p}") for p in ("year", "quarter", "month", "day", "hour", "minute", "second")])


@query("SELECT event_id, CAST(sign(t) * floor(abs(t) + 0.5) AS INTEGER) AS days FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-03-05 23:30:00') - epoch_us(ts)) / 86400000000.0 AS t FROM events)")
def f10_datediff_elapsed(spark, d):
    to = F.lit("2024-03-05 23:30:00").cast("timestamp_ntz")
    return read(spark, d, "events").select("event_id", elapsed_diff("day", F.col("ts"), to).alias("days"))


@query("SELECT o_orderkey, CAST(datediff('month', o_orderdate, TIMESTAMP '1998-09-02') AS INTEGER) AS months, CAST(datediff('day', o_orderdate, TIMESTAMP '1998-09-02') AS INTEGER) AS days FROM orders")
def f10_datediff_translated(spark, d):
    return _tsql(spark, d, "orders", {"o_orderkey": "o_orderkey", "months": "DATEDIFF(month, o_orderdate, CAST('1998-09-02' AS DATETIME2))", "days": "DATEDIFF(dd, o_orderdate, CAST('1998-09-02' AS DATETIME2))"})


@query("SELECT l_orderkey, l_linenumber, l_partkey // 7 AS whole, CAST(l_quantity AS DECIMAL(10,1)) AS q, left(CAST(l_orderkey AS VARCHAR), 2) AS two FROM lineitem")
def f16_convert_and_integer_division(spark, d):
    return _tsql(spark, d, "lineitem", {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "whole": "l_partkey / 7", "q": "CONVERT(DECIMAL(10,1), l_quantity)", "two": "CONVERT(VARCHAR(2), l_orderkey)"})


def _run_tsql(spark, d, sql: str, tables: list[str], **names) -> DataFrame:
    text, _ = translate_query(sql, "tsql", "spark", **names)
    for t in tables:
        text = text.replace(f"dbo.{t}", f"{{{t}}}")
    return spark.sql(text, **{t: read(spark, d, t) for t in tables})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def e01_top(spark, d):
    return _run_tsql(spark, d, "SELECT TOP (25) [o_orderkey], o_totalprice FROM dbo.orders WITH (NOLOCK) ORDER BY o_totalprice DESC, o_orderkey", ["orders"])


@query("SELECT c.c_custkey, x.o_orderkey FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) x ON x.o_custkey = c.c_custkey")
def e08_outer_apply(spark, d):
    return _run_tsql(spark, d, "SELECT c.c_custkey, x.o_orderkey FROM dbo.customer c OUTER APPLY (SELECT MAX(o.o_orderkey) AS o_orderkey FROM dbo.orders o WHERE o.o_custkey = c.c_custkey) x", ["customer", "orders"])


@query("SELECT p_partkey FROM (SELECT p_partkey, p_size > 25 AS is_large FROM part) WHERE is_large = true")
def e09_bit_predicate(spark, d):
    part = read(spark, d, "part").withColumn("is_large", F.col("p_size") > 25)
    text, _ = translate_query("SELECT p_partkey FROM part WHERE [is_large] = 1", bits=["is_large"])
    return spark.sql(text.replace("FROM part", "FROM {part}"), part=part)


@query("(SELECT s_suppkey AS k FROM supplier ORDER BY s_suppkey LIMIT 5) UNION ALL SELECT n_nationkey FROM nation")
def e01_top_in_one_arm(spark, d):
    return _run_tsql(spark, d, "SELECT k FROM (SELECT TOP 5 s_suppkey AS k FROM dbo.supplier ORDER BY s_suppkey) a UNION ALL SELECT n_nationkey FROM dbo.nation", ["supplier", "nation"])


@query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'O') WHERE r <= ceil(n * 10 / 100.0)")
def e01_top_percent(spark, d):
    return _run_tsql(spark, d, "SELECT TOP 10 PERCENT o_orderkey, o_custkey FROM dbo.orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey", ["orders"])


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 7")
def e01_top_with_ties(spark, d):
    return _run_tsql(spark, d, "SELECT TOP (7) WITH TIES p_partkey, p_size FROM dbo.part ORDER BY p_size DESC", ["part"])


@query("SELECT event_id, ts + INTERVAL 250 MILLISECOND AS later, datediff('millisecond', ts, TIMESTAMP '2024-03-05 23:30:00') AS ms, CAST(dayofweek(ts) AS INTEGER) AS dow FROM events")
def f10_milliseconds(spark, d):
    e = _tsql(spark, d, "events", {"event_id": "event_id", "later": "DATEADD(ms, 250, ts)", "ms": "DATEDIFF(millisecond, ts, CAST('2024-03-05 23:30:00' AS DATETIME2))", "ts": "ts"})
    return e.select("event_id", "later", "ms", F.expr(translate_expression("extract(dow from ts)::integer", "postgres", "spark")[0]).alias("dow"))


# ---- routines and triggers ----


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'some' END AS class FROM customer")
def r02_scalar_function(spark, d):
    f = translate_routine("CREATE FUNCTION dbo.class_of(@bal FLOAT) RETURNS NVARCHAR(10) AS BEGIN RETURN CASE WHEN @bal < 0 THEN N'debt' WHEN @bal > 5000 THEN N'rich' ELSE N'some' END END")
    spark.sql(f.sql)
    return read(spark, d, "customer").selectExpr("c_custkey", "c_acctbal", "class_of(c_acctbal) AS class")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def r03_table_function(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("tb_orders")
    f = translate_routine("CREATE FUNCTION dbo.orders_of(@cust INT, @least FLOAT = 0) RETURNS TABLE AS RETURN (SELECT o_orderkey, o_totalprice FROM tb_orders WHERE o_custkey = @cust AND o_totalprice > @least)")
    spark.sql(f.sql)
    return spark.sql("SELECT * FROM orders_of(7, 1000)")


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey < 3 GROUP BY 1")
def r07_procedure_script(spark, d):
    read(spark, d, "nation").createOrReplaceTempView("tb_nation")
    p = translate_routine("CREATE PROCEDURE dbo.per_region AS BEGIN SET NOCOUNT ON; DECLARE @i INT = 0; WHILE @i < 3 BEGIN SET @i = @i + 1 END SELECT n_regionkey, COUNT(*) AS n FROM tb_nation WHERE n_regionkey < @i GROUP BY n_regionkey END")
    return spark.sql(p.sql)


_TRIGGER = """CREATE TRIGGER dbo.tr ON dbo.orders AFTER UPDATE, DELETE AS BEGIN SET NOCOUNT ON
IF UPDATE(o_orderstatus) INSERT INTO audit (o_orderkey, action, old_status, new_status) SELECT i.o_orderkey, N'U', d.o_orderstatus, i.o_orderstatus FROM inserted i JOIN deleted d ON d.o_orderkey = i.o_orderkey
IF NOT EXISTS (SELECT 1 FROM inserted) INSERT INTO audit (o_orderkey, action, old_status, new_status) SELECT o_orderkey, 'D', o_orderstatus, NULL FROM deleted END"""
_ROW_TRIGGER = (
    "CREATE TRIGGER tr AFTER UPDATE OR DELETE ON public.orders FOR EACH ROW EXECUTE FUNCTION note()",
    """CREATE FUNCTION note() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN
IF TG_OP = 'UPDATE' THEN INSERT INTO audit (o_orderkey, action, old_status, new_status) VALUES (NEW.o_orderkey, 'U', OLD.o_orderstatus, NEW.o_orderstatus);
ELSE INSERT INTO audit (o_orderkey, action, old_status, new_status) VALUES (OLD.o_orderkey, 'D', OLD.o_orderstatus, NULL); END IF; RETURN NULL; END $$""",
)


def _audited(spark, d, trigger) -> DataFrame:
    """What the trigger notes of an update and a delete."""
    orders = read(spark, d, "orders")
    rows = orders.filter("o_orderkey % 101 = 5").withColumn("o_orderstatus", F.lit("X"))
    out = []
    for batch in (changes.update_batch("orders", orders, rows, ["o_orderkey"]), changes.delete_batch("orders", orders, orders.filter("o_orderkey % 50 = 7"), ["o_orderkey"])):
        out.append(changes.apply_change(orders, batch, ["o_orderkey"], [trigger.handler])[1]["audit"])
    return out[0].union(out[1])


_AUDIT = "SELECT o_orderkey, 'U' AS action, o_orderstatus AS old_status, 'X' AS new_status FROM orders WHERE o_orderkey % 101 = 5 UNION ALL SELECT o_orderkey, 'D', o_orderstatus, NULL FROM orders WHERE o_orderkey % 50 = 7"


@query(_AUDIT)
def g01_audit_trigger(spark, d):
    return _audited(spark, d, triggers.tsql_trigger(_TRIGGER, ["o_orderkey"]))


@query(_AUDIT)
def g07_row_trigger(spark, d):
    return _audited(spark, d, triggers.postgres_trigger(*_ROW_TRIGGER, ["o_orderkey"]))


@query("SELECT o_orderstatus, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 101 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def r31_upsert(spark, d):
    orders = read(spark, d, "orders")
    rows = orders.filter("o_orderkey % 101 = 5").withColumn("o_orderstatus", F.lit("X"))
    return changes.upsert(orders, rows, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'closed', count(*) FROM orders WHERE o_orderkey % 50 = 0 AND o_orderstatus <> 'F'")
def g02_instead_of_delete(spark, d):
    """The trigger stands in for the delete: nothing goes, and what is open is noted."""
    orders = read(spark, d, "orders")

    def note(batch: changes.ChangeBatch) -> None:
        batch.add("closed", batch.sql("SELECT deleted.o_orderkey AS deleted_key, 'deleted' AS why FROM deleted WHERE deleted.o_orderstatus <> N'F'"))

    batch = changes.delete_batch("orders", orders, orders.filter("o_orderkey % 50 = 0"), ["o_orderkey"])
    after, added = changes.apply_change(orders, batch, ["o_orderkey"], [changes.Handler(frozenset({"DELETE"}), note, "INSTEAD")])
    return verify.row_counts({"orders": after, "closed": added["closed"]})


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey % 50 <> 0")
def g02_delete(spark, d):
    orders = read(spark, d, "orders")
    batch = changes.delete_batch("orders", orders, orders.filter("o_orderkey % 50 = 0"), ["o_orderkey"])
    after, _ = changes.apply_change(orders, batch, ["o_orderkey"])
    return after.agg(F.count("*").alias("n"))


@query("(SELECT c_mktsegment AS k, c_custkey AS n FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 3) UNION ALL SELECT * FROM (SELECT c_mktsegment, c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE' ORDER BY c_custkey LIMIT 2)")
def s09_keyset_page_behind_nulls(spark, d):
    """Keys with nulls: the page behind a null value goes on with the rows that have one, and nothing is left out."""
    c = read(spark, d, "customer").filter("c_mktsegment IN ('BUILDING', 'FURNITURE')").select(F.col("c_mktsegment").alias("k"), F.col("c_custkey").alias("n"))
    hidden = c.withColumn("k", F.when(F.col("k") != "BUILDING", F.col("k")))
    some = hidden.filter("k IS NULL").orderBy("n").limit(3).unionByName(hidden.filter("k IS NOT NULL").orderBy("n").limit(2))
    first = verify.after_key(some, ["k", "n"], None, 2)
    at = first.agg(F.max("n")).first()[0]
    return first.unionByName(verify.after_key(some, ["k", "n"], [None, at], 10)).select(F.coalesce("k", F.lit("BUILDING")).alias("k"), "n")
