"""The registered queries over the driver's tables, and the SQL that each must equal.

Answers carry an explicit position where order matters, and children flat: the
parent's key, the child's position, the child's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ordering
from ..operators import deltas, view
from ..schema import Catalog, Relation, Table
from . import ir, lower
from .compile import compile_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Keys of the driver's tables, and which belong to which.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id"}
RELATIONS = (
    Relation("nations", "region", "nation", "r_regionkey", "n_regionkey"),
    Relation("customers", "nation", "customer", "n_nationkey", "c_nationkey"),
    Relation("orders", "customer", "orders", "c_custkey", "o_custkey"),
    Relation("events", "customer", "events", "c_custkey", "user_id"),
    Relation("siblings", "customer", "supplier", "c_nationkey", "s_nationkey"),
    Relation("labels", "documents", "labels", "doc_id", "doc_id"),
)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def catalog(frames: dict[str, DataFrame]) -> Catalog:
    out = Catalog()
    for name, frame in frames.items():
        out.add(Table(name, frame.schema, KEYS[name]))
    for r in RELATIONS:
        if r.parent in frames and r.child in frames:
            out.relate(r)
    return out


def _register(name: str, sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


def answer(spark: SparkSession, sf_dir: str, query: ir.Query, nested: bool = False) -> DataFrame:
    """The query's rows, with their place in the list as ``pos``."""
    frames = tables(spark, sf_dir, *_named(query))
    compiled = compile_query(query, catalog(frames), nested)
    return _numbered(lower.evaluate(compiled, frames), compiled)


def _named(query: ir.Query) -> set[str]:
    return {query.table}.union(*(_named(r.query) for r in query.related))


def _numbered(rows: DataFrame, compiled) -> DataFrame:
    """Only for bounded lists: their rows fit in one task."""
    order = Window.orderBy(*ordering.order_columns(compiled.order, compiled.table.key))
    return rows.withColumn("pos", F.row_number().over(order))


def _plain(name: str, sql: str, query: ir.Query, *columns: str) -> None:
    """A list without children; without a limit it has no positions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = tables(spark, sf_dir, query.table)
        compiled = compile_query(query, catalog(frames))
        rows = lower.evaluate(compiled, frames)
        return _numbered(rows, compiled).select(*columns, "pos") if query.limit else rows.select(*columns)

    _register(name, sql)(run)


def _filter(name: str, table: str, where: ir.Predicate, sql: str, *columns: str, params: tuple = ()) -> None:
    _plain(name, f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}", ir.Query(table, where, allow_unbounded=True, params=params), *columns)


def _flat(rows: DataFrame, parent: str, array: str, *columns: str) -> DataFrame:
    """One row for each child: the parent's key and position, the child's position, the child's columns."""
    return rows.select(parent, "pos", F.posexplode_outer(array).alias("child_pos", "child")).select(parent, "pos", (F.col("child_pos") + 1).alias("child_pos"), *[F.col(f"child.{c}").alias(c) for c in columns])


c, v = ir.Col, ir.Lit

# -- source


@_register("scan_pk_order", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation")
def _(spark, sf_dir):
    frames = tables(spark, sf_dir, "nation")
    compiled = compile_query(ir.Query("nation", allow_unbounded=True), catalog(frames))
    return _numbered(lower.scan(compiled, frames), compiled).select("n_nationkey", "n_name", "pos")


@_register("scan_limit", "SELECT c_custkey, c_name FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 37)")
def _(spark, sf_dir):
    frames = tables(spark, sf_dir, "customer")
    return lower.scan(compile_query(ir.Query("customer", allow_unbounded=True), catalog(frames)), frames, limit=37).select("c_custkey", "c_name")


@_register("scan_limit_zero", "SELECT c_custkey FROM customer LIMIT 0")
def _(spark, sf_dir):
    frames = tables(spark, sf_dir, "customer")
    return lower.scan(compile_query(ir.Query("customer", allow_unbounded=True), catalog(frames)), frames, limit=0).select("c_custkey")


@_register("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 100, -5)")
def _(spark, sf_dir):
    frames = tables(spark, sf_dir, "orders")
    return frames["orders"].where(F.col("o_orderkey").isin([1, 7, 100, -5])).select("o_orderkey", "o_custkey", "o_totalprice")


# -- predicates

_O = ("o_orderkey", "o_totalprice")
for _name, _op, _sql in (("eq", "=", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):
    _filter(f"filter_{_name}", "orders", ir.Cmp(c("o_custkey"), _op, v(75)), f"o_custkey {_sql} 75", *_O)
_filter("filter_true", "nation", ir.Always(), "true", "n_nationkey", "n_name")
_filter("filter_param", "customer", ir.And((ir.Cmp(c("c_mktsegment"), "=", ir.Param(0)), ir.Cmp(c("c_acctbal"), ">", ir.Param(1)))), "c_mktsegment = 'BUILDING' AND c_acctbal > 1000", "c_custkey", "c_acctbal", params=("BUILDING", 1000.0))
_filter("filter_col_col", "customer", ir.Cmp(c("c_custkey"), "<", c("c_nationkey")), "c_custkey < c_nationkey", "c_custkey", "c_nationkey")
_filter("filter_in", "nation", ir.In(c("n_name"), ("NATION_1", "NATION_17", "none such")), "n_name IN ('NATION_1', 'NATION_17', 'none such')", "n_nationkey", "n_name")
_filter("filter_in_null", "orders", ir.Not(ir.In(c("o_orderstatus"), ("F", None))), "NOT (o_orderstatus IN ('F', NULL))", *_O)
_filter("filter_in_null_match", "orders", ir.In(c("o_orderstatus"), ("F", None)), "o_orderstatus IN ('F', NULL)", *_O)
_filter("filter_in_empty", "orders", ir.In(c("o_orderkey"), ()), "false", *_O)
_filter("filter_in_mixed", "orders", ir.In(c("o_custkey"), (3, 7.0, 8.5, "9")), "o_custkey IN (3, 7)", *_O)
_filter("filter_between", "orders", ir.Between(c("o_totalprice"), v(1000.0), v(50000.0)), "o_totalprice BETWEEN 1000 AND 50000", *_O)
_filter("filter_between_null", "orders", ir.Not(ir.Between(c("o_totalprice"), v(1000.0), v(None))), "NOT (o_totalprice >= 1000 AND o_totalprice <= CAST(NULL AS DOUBLE))", *_O)
_filter("filter_like_prefix", "part", ir.Prefix(c("p_name"), "small"), "starts_with(p_name, 'small')", "p_partkey", "p_name")
_filter("filter_like_prefix_empty", "part", ir.Prefix(c("p_name"), ""), "p_name IS NOT NULL", "p_partkey", "p_name")
_filter("filter_like_prefix_number", "part", ir.Not(ir.Prefix(c("p_size"), "1")), "p_size IS NOT NULL", "p_partkey", "p_size")
_filter(
    "filter_and_or_not",
    "orders",
    ir.And((ir.Or((ir.Cmp(c("o_orderstatus"), "=", v("F")), ir.Cmp(c("o_totalprice"), ">", v(200000.0)))), ir.Not(ir.Cmp(c("o_custkey"), "<", v(20))))),
    "(o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_custkey < 20)",
    *_O,
)
_filter("filter_and_empty", "nation", ir.And(()), "true", "n_nationkey")
_filter("filter_or_empty", "nation", ir.Or(()), "false", "n_nationkey")
_filter("filter_not_unknown", "orders", ir.Not(ir.Cmp(c("o_totalprice"), "<", v(None))), "NOT (o_totalprice < CAST(NULL AS DOUBLE))", *_O)
_filter("filter_or_unknown", "orders", ir.Or((ir.Cmp(c("o_custkey"), "<", v(None)), ir.Cmp(c("o_custkey"), "=", v(7)))), "o_custkey < CAST(NULL AS BIGINT) OR o_custkey = 7", *_O)
_filter("filter_mixed_numeric", "part", ir.And((ir.Cmp(c("p_size"), ">", v(10.5)), ir.Cmp(c("p_size"), "<=", v(20.0)), ir.Cmp(c("p_retailprice"), ">", v(950)))), "p_size > 10.5 AND p_size <= 20.0 AND p_retailprice > 950", "p_partkey", "p_size", "p_retailprice")
_filter("filter_mixed_columns", "part", ir.Cmp(c("p_partkey"), "<", c("p_retailprice")), "p_partkey < p_retailprice", "p_partkey", "p_retailprice")
_filter("filter_cross_class", "part", ir.And((ir.Cmp(c("p_name"), ">", v(5)), ir.Cmp(c("p_size"), "<", v("a")), ir.Not(ir.Cmp(c("p_size"), "=", v("5"))))), "p_name IS NOT NULL AND p_size IS NOT NULL", "p_partkey", "p_name")


def _with_nulls(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], Catalog]:
    """Orders with a nullable ``status``: null for one of three."""
    orders = tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_custkey", "o_totalprice", F.expr("nullif(o_orderstatus, 'F')").alias("status"), F.expr("nullif(o_orderkey % 5, 0)").alias("bucket"))
    frames = {"orders": orders}
    return frames, catalog(frames)


_NULLS = "(SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderstatus, 'F') AS status, nullif(o_orderkey % 5, 0) AS bucket FROM orders)"


def _nullable(name: str, where: ir.Predicate, sql: str) -> None:
    @_register(name, f"SELECT o_orderkey, status, bucket FROM {_NULLS} WHERE {sql}")
    def _(spark, sf_dir):
        frames, known = _with_nulls(spark, sf_dir)
        return lower.evaluate(compile_query(ir.Query("orders", where, allow_unbounded=True), known), frames).select("o_orderkey", "status", "bucket")


_nullable("filter_is_null", ir.IsNull(c("status")), "status IS NULL")
_nullable("filter_is_not_null", ir.IsNotNull(c("status")), "status IS NOT NULL")
_nullable("filter_not_in_empty_null", ir.Not(ir.In(c("status"), ())), "status IS NOT NULL")
_nullable("filter_three_valued", ir.Not(ir.And((ir.Cmp(c("status"), "=", v("O")), ir.Cmp(c("bucket"), "<", v(3))))), "NOT (status = 'O' AND bucket < 3)")
_nullable("filter_prefix_null", ir.Not(ir.Prefix(c("status"), "O")), "NOT starts_with(status, 'O')")

# -- project

_plain("project_subset_reorder", "SELECT p_size, p_name, p_partkey FROM part", ir.Query("part", select=("p_size", "p_name", "p_partkey"), allow_unbounded=True), "p_size", "p_name", "p_partkey")


@_register("project_duplicate_absent", "SELECT p_size AS a, p_size AS b, CAST(NULL AS VARCHAR) AS missing FROM part")
def _(spark, sf_dir):
    part = tables(spark, sf_dir, "part")["part"]
    return part.select(F.col("p_size").alias("a"), F.col("p_size").alias("b"), F.lit(None).cast("string").alias("missing"))


# -- ordered and bounded lists


def _topk(name: str, table: str, order: tuple[ir.Order, ...], sql_order: str, limit: int, *columns: str, where: ir.Predicate | None = None, sql_where: str = "true", after: ir.Cursor | None = None) -> None:
    query = ir.Query(table, where or ir.Always(), order, limit, start_after=after)
    names = ", ".join(columns)
    _plain(name, f"SELECT {names}, row_number() OVER (ORDER BY {sql_order}) AS pos FROM (SELECT * FROM {table} WHERE {sql_where} ORDER BY {sql_order} LIMIT {limit})", query, *columns)


_topk("topk_asc", "customer", (ir.Order("c_acctbal"),), "c_acctbal ASC NULLS FIRST, c_custkey", 25, "c_custkey", "c_acctbal")
_topk("topk_desc", "orders", (ir.Order("o_totalprice", True),), "o_totalprice DESC NULLS LAST, o_orderkey", 40, "o_orderkey", "o_totalprice")
_topk(
    "topk_three_cols",
    "orders",
    (ir.Order("o_orderpriority"), ir.Order("o_orderstatus", True), ir.Order("o_totalprice", True)),
    "o_orderpriority NULLS FIRST, o_orderstatus DESC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey",
    60,
    "o_orderkey",
    "o_orderpriority",
    "o_orderstatus",
)
_topk("topk_tie_pk", "orders", (ir.Order("o_orderpriority", True),), "o_orderpriority DESC NULLS LAST, o_orderkey", 30, "o_orderkey", "o_orderpriority")
_topk("topk_filtered", "customer", (ir.Order("c_acctbal", True),), "c_acctbal DESC NULLS LAST, c_custkey", 20, "c_custkey", "c_acctbal", where=ir.Cmp(c("c_mktsegment"), "=", v("BUILDING")), sql_where="c_mktsegment = 'BUILDING'")
_topk("topk_past_end", "nation", (ir.Order("n_name", True),), "n_name DESC NULLS LAST, n_nationkey", 500, "n_nationkey", "n_name")
_plain("unbounded_list", "SELECT s_suppkey, s_name, s_acctbal FROM supplier", ir.Query("supplier", order=(ir.Order("s_acctbal"),), allow_unbounded=True), "s_suppkey", "s_name", "s_acctbal")
_topk(
    "page_after_cursor",
    "orders",
    (ir.Order("o_orderpriority"), ir.Order("o_totalprice", True)),
    "o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey",
    30,
    "o_orderkey",
    "o_totalprice",
    after=ir.Cursor(("2-HIGH", 150000.0), 500),
    sql_where="o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND (o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 500)))",
)


def _null_order(name: str, desc: bool, sql: str, after: ir.Cursor | None = None, past: str = "true") -> None:
    @_register(name, f"SELECT o_orderkey, bucket, row_number() OVER (ORDER BY {sql}, o_orderkey) AS pos FROM (SELECT * FROM {_NULLS} WHERE {past} ORDER BY {sql}, o_orderkey LIMIT 3100)")
    def _(spark, sf_dir):
        frames, known = _with_nulls(spark, sf_dir)
        compiled = compile_query(ir.Query("orders", order=(ir.Order("bucket", desc),), limit=3100, start_after=after), known)
        return _numbered(lower.evaluate(compiled, frames), compiled).select("o_orderkey", "bucket", "pos")


_null_order("topk_null_order", False, "bucket ASC NULLS FIRST")
_null_order("topk_null_order_desc", True, "bucket DESC NULLS LAST")
_null_order("page_after_null_cursor_asc", False, "bucket ASC NULLS FIRST", ir.Cursor((None,), 5000), "bucket IS NOT NULL OR o_orderkey > 5000")
_null_order("page_after_null_cursor_desc", True, "bucket DESC NULLS LAST", ir.Cursor((None,), 5000), "bucket IS NULL AND o_orderkey > 5000")

# -- lists with children

_BALANCE = (ir.Order("c_acctbal", True),)
_NEWEST = (ir.Order("o_orderdate", True),)


def _parents(where: str, order: str, limit: int, table: str = "customer") -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY {order}) AS pos FROM (SELECT * FROM {table} WHERE {where} ORDER BY {order} LIMIT {limit}))"


def _nest_sql(parents: str, parent_key: str, join: str, child: str, child_order: str, limit: int, columns: str, child_where: str = "true") -> str:
    kids = f"(SELECT *, row_number() OVER (PARTITION BY {join.split(' = ')[1]} ORDER BY {child_order}) AS child_pos FROM {child} WHERE {child_where})"
    return f"SELECT p.{parent_key}, p.pos, k.child_pos, {columns} FROM {parents} p LEFT JOIN (SELECT * FROM {kids} WHERE child_pos <= {limit}) k ON p.{join.split(' = ')[0]} = k.{join.split(' = ')[1]}"


_RICHEST = _parents("c_mktsegment = 'BUILDING'", "c_acctbal DESC NULLS LAST, c_custkey", 50)


@_register("flagship_live_list", _nest_sql(_RICHEST, "c_custkey", "c_custkey = o_custkey", "orders", "o_orderdate DESC NULLS LAST, o_orderkey", 3, "k.o_orderkey, k.o_totalprice"))
def _(spark, sf_dir):
    recent = ir.Query("orders", order=_NEWEST, limit=3)
    query = ir.Query("customer", ir.Cmp(c("c_mktsegment"), "=", ir.Param(0)), _BALANCE, 50, (ir.Related("orders", recent),), params=("BUILDING",))
    return _flat(answer(spark, sf_dir, query), "c_custkey", "orders", "o_orderkey", "o_totalprice")


@_register("nest_children", _nest_sql(_parents("true", "c_custkey", 200), "c_custkey", "c_custkey = o_custkey", "orders", "o_totalprice DESC NULLS LAST, o_orderkey", 5, "k.o_orderkey, k.o_totalprice"))
def _(spark, sf_dir):
    best = ir.Query("orders", order=(ir.Order("o_totalprice", True),), limit=5)
    query = ir.Query("customer", order=(ir.Order("c_custkey"),), limit=200, related=(ir.Related("orders", best, "best"),))
    return _flat(answer(spark, sf_dir, query), "c_custkey", "best", "o_orderkey", "o_totalprice")


@_register("nest_children_filtered", _nest_sql(_parents("true", "c_acctbal NULLS FIRST, c_custkey", 100), "c_custkey", "c_custkey = o_custkey", "orders", "o_totalprice NULLS FIRST, o_orderkey", 4, "k.o_orderkey, k.o_totalprice", "o_orderstatus = 'O' AND o_totalprice > 60000"))
def _(spark, sf_dir):
    dear = ir.Query("orders", ir.And((ir.Cmp(c("o_orderstatus"), "=", v("O")), ir.Cmp(c("o_totalprice"), ">", v(60000)))), (ir.Order("o_totalprice"),), 4)
    query = ir.Query("customer", order=(ir.Order("c_acctbal"),), limit=100, related=(ir.Related("orders", dear),))
    return _flat(answer(spark, sf_dir, query), "c_custkey", "orders", "o_orderkey", "o_totalprice")


@_register("nest_empty_children", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal NULLS FIRST, c_custkey) AS pos, CAST(0 AS INTEGER) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 30)")
def _(spark, sf_dir):
    none = ir.Query("orders", ir.Cmp(c("o_totalprice"), "<", v(0)), _NEWEST, 3)
    rows = answer(spark, sf_dir, ir.Query("customer", order=(ir.Order("c_acctbal"),), limit=30, related=(ir.Related("orders", none),)))
    return rows.select("c_custkey", "pos", F.size("orders").alias("n"))


@_register(
    "nest_two_relations",
    f"""WITH p AS (SELECT * FROM {_RICHEST}),
     o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS child_pos FROM orders),
     e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS child_pos FROM events)
     SELECT c_custkey, pos, 'order' AS kind, child_pos, o_orderkey AS child FROM p JOIN o ON c_custkey = o_custkey WHERE child_pos <= 2
     UNION ALL SELECT c_custkey, pos, 'event' AS kind, child_pos, event_id AS child FROM p JOIN e ON c_custkey = user_id WHERE child_pos <= 3""",
)
def _(spark, sf_dir):
    recent = ir.Query("orders", order=_NEWEST, limit=2)
    large = ir.Query("events", order=(ir.Order("value", True),), limit=3)
    rows = answer(spark, sf_dir, ir.Query("customer", ir.Cmp(c("c_mktsegment"), "=", v("BUILDING")), _BALANCE, 50, (ir.Related("orders", recent), ir.Related("events", large))))

    def side(array: str, kind: str, key: str) -> DataFrame:
        return rows.select("c_custkey", "pos", F.lit(kind).alias("kind"), F.posexplode(array).alias("p", "x")).select("c_custkey", "pos", "kind", (F.col("p") + 1).alias("child_pos"), F.col(f"x.{key}").alias("child"))

    return side("orders", "order", "o_orderkey").unionByName(side("events", "event", "event_id"))


@_register("nest_non_pk_key", _nest_sql(_parents("true", "c_acctbal DESC NULLS LAST, c_custkey", 60), "c_custkey", "c_nationkey = s_nationkey", "supplier", "s_acctbal DESC NULLS LAST, s_suppkey", 2, "k.s_suppkey, k.s_acctbal"))
def _(spark, sf_dir):
    near = ir.Query("supplier", order=(ir.Order("s_acctbal", True),), limit=2)
    query = ir.Query("customer", order=_BALANCE, limit=60, related=(ir.Related("siblings", near),))
    return _flat(answer(spark, sf_dir, query), "c_custkey", "siblings", "s_suppkey", "s_acctbal")


@_register(
    "nest_mixed_key",
    _nest_sql(_parents("true", "c_custkey", 50), "c_custkey", "c_custkey = fk", "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 0.5 ELSE CAST(o_custkey AS DOUBLE) END AS fk FROM orders)", "o_orderkey", 2, "k.o_orderkey"),
)
def _(spark, sf_dir):
    frames = tables(spark, sf_dir, "customer", "orders")
    frames["orders"] = frames["orders"].select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 0.5D ELSE CAST(o_custkey AS DOUBLE) END").alias("fk"))
    known = Catalog().add(Table("customer", frames["customer"].schema, "c_custkey")).add(Table("orders", frames["orders"].schema, "o_orderkey"))
    known.relate(Relation("orders", "customer", "orders", "c_custkey", "fk"))
    query = ir.Query("customer", order=(ir.Order("c_custkey"),), limit=50, related=(ir.Related("orders", ir.Query("orders", order=(ir.Order("o_orderkey"),), limit=2)),))
    compiled = compile_query(query, known)
    return _flat(_numbered(lower.evaluate(compiled, frames), compiled), "c_custkey", "orders", "o_orderkey")


@_register(
    "nest_two_levels",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name NULLS FIRST, n_nationkey) AS nation_pos FROM nation),
     k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS customer_pos FROM customer)
     SELECT r_regionkey, n_nationkey, nation_pos, c_custkey, customer_pos FROM region JOIN n ON r_regionkey = n_regionkey JOIN k ON c_nationkey = n_nationkey WHERE nation_pos <= 3 AND customer_pos <= 4""",
)
def _(spark, sf_dir):
    rich = ir.Query("customer", order=_BALANCE, limit=4)
    nations = ir.Query("nation", order=(ir.Order("n_name"),), limit=3, related=(ir.Related("customers", rich),))
    rows = answer(spark, sf_dir, ir.Query("region", order=(ir.Order("r_regionkey"),), limit=10, related=(ir.Related("nations", nations),)), nested=True)
    rows = rows.select("r_regionkey", F.posexplode("nations").alias("p", "n"))
    rows = rows.select("r_regionkey", F.col("n.n_nationkey").alias("n_nationkey"), (F.col("p") + 1).alias("nation_pos"), F.posexplode("n.customers").alias("q", "k"))
    return rows.select("r_regionkey", "n_nationkey", "nation_pos", F.col("k.c_custkey").alias("c_custkey"), (F.col("q") + 1).alias("customer_pos"))


# -- changes: keys of remainder 0 go, 1 get another price, and as many come anew

_NEW = """(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 NOT IN (0, 1)
    UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1000 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 1
    UNION ALL SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 2)"""
_OLD = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_custkey", "o_totalprice")
    rest = F.col("o_orderkey") % 10
    new = old.where(~rest.isin(0, 1)).unionByName(old.where(rest == 1).withColumn("o_totalprice", F.col("o_totalprice") + 1000)).unionByName(old.where(rest == 2).withColumn("o_orderkey", F.col("o_orderkey") + 10000000))
    return old, new


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change set from the old to the new orders."""
    return deltas.diff(*_old_new(spark, sf_dir), "o_orderkey")


def _shown(batch: DataFrame) -> DataFrame:
    """Flat: the key, the kind, and the price before and after."""
    return batch.select("key", deltas.kind().alias("op"), F.col("before.o_totalprice").alias("was"), F.col("after.o_totalprice").alias("becomes"))


def _shown_sql(old: str, new: str) -> str:
    return f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS key, CASE WHEN a.o_orderkey IS NULL THEN 'I' WHEN b.o_orderkey IS NULL THEN 'D' ELSE 'U' END AS op, a.o_totalprice AS was, b.o_totalprice AS becomes
    FROM {old} a FULL JOIN {new} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice IS DISTINCT FROM b.o_totalprice"""


@_register("diff_relations", _shown_sql(_OLD, _NEW))
def _(spark, sf_dir):
    return _shown(_feed(spark, sf_dir))


@_register("apply_batch", f"SELECT * FROM {_NEW}")
def _(spark, sf_dir):
    return deltas.apply(_old_new(spark, sf_dir)[0], _feed(spark, sf_dir), "o_orderkey")


@_register("zset_form", f"SELECT o_orderkey AS key, o_totalprice, -1 AS weight FROM (SELECT * FROM {_OLD} EXCEPT SELECT * FROM {_NEW}) UNION ALL SELECT o_orderkey AS key, o_totalprice, 1 AS weight FROM (SELECT * FROM {_NEW} EXCEPT SELECT * FROM {_OLD})")
def _(spark, sf_dir):
    return deltas.to_zset(_feed(spark, sf_dir)).select("key", "row.o_totalprice", "weight")


@_register("zset_back", _shown_sql(_OLD, _NEW))
def _(spark, sf_dir):
    """Weighted rows of two batches added up are the batch of both steps: what the first one adds the second takes away."""
    old, new = _old_new(spark, sf_dir)
    there, back = deltas.diff(old, new, "o_orderkey"), deltas.diff(new, old, "o_orderkey")
    weighted = deltas.to_zset(there).unionByName(deltas.to_zset(back)).unionByName(deltas.to_zset(there))
    return _shown(deltas.from_zset(weighted))


@_register("union_batches", _shown_sql(_OLD, _NEW))
def _(spark, sf_dir):
    """The batches of three writers, who insert, update and delete different keys, as one."""
    feed = _feed(spark, sf_dir)
    return _shown(deltas.union_changes(*[feed.where(deltas.kind() == k) for k in (deltas.INSERT, deltas.UPDATE, deltas.DELETE)]))


@_register("compose_batches", _shown_sql(_OLD, "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey + 20000000 AS o_orderkey, o_custkey, o_totalprice + 5 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 4)"))
def _(spark, sf_dir):
    """Three changes of some keys: deleted rows that came back vanish, an insert that was changed is one insert, an update that was deleted one delete."""
    old = _old_new(spark, sf_dir)[0]
    row = F.struct("o_orderkey", "o_custkey", "o_totalprice")
    none = F.lit(None).cast(old.select(row.alias("r")).schema["r"].dataType)
    rest = F.col("o_orderkey") % 10
    more = F.struct("o_orderkey", "o_custkey", (F.col("o_totalprice") + 5).alias("o_totalprice"))

    def step(rows: DataFrame, seq: int, before, after) -> DataFrame:
        return rows.select(F.col("o_orderkey").alias("key"), F.lit(seq).alias("seq"), before.alias("before"), after.alias("after"))

    away, back = old.where(rest == 2), old.where(rest == 3)
    fresh = old.where(rest == 4).withColumn("o_orderkey", F.col("o_orderkey") + 20000000)
    feed = step(away, 1, row, none).unionByName(step(away, 2, none, row))
    feed = feed.unionByName(step(back, 1, row, more)).unionByName(step(back, 2, more, none))
    feed = feed.unionByName(step(fresh, 1, none, row)).unionByName(step(fresh, 2, row, more))
    return _shown(deltas.compose(feed))


@_register("delta_filter", _shown_sql(f"(SELECT * FROM {_OLD} WHERE o_totalprice > 150000)", f"(SELECT * FROM {_NEW} WHERE o_totalprice > 150000)"))
def _(spark, sf_dir):
    return _shown(deltas.filter_changes(_feed(spark, sf_dir), ir.Cmp(c("o_totalprice"), ">", v(150000))))


@_register("delta_project", f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS key, CASE WHEN a.o_orderkey IS NULL THEN 'I' ELSE 'D' END AS op, a.o_custkey AS was, b.o_custkey AS becomes
    FROM {_OLD} a FULL JOIN {_NEW} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL""")
def _(spark, sf_dir):
    batch = deltas.project_changes(_feed(spark, sf_dir), ["o_custkey", "o_orderkey"])
    return batch.select("key", deltas.kind().alias("op"), F.col("before.o_custkey").alias("was"), F.col("after.o_custkey").alias("becomes"))


_TOP = "ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40"


def _maintained(spark: SparkSession, sf_dir: str, query: ir.Query, known: Catalog, before: dict[str, DataFrame], after: dict[str, DataFrame], batches: dict[str, DataFrame]):
    """A list hydrated on the old tables and taken over the batches."""
    from ..operators.incremental import LiveList

    live = LiveList(compile_query(query, known))
    old = list(live.hydrate(before))
    return live, old, live.apply(batches, after)


@_register("delta_topk", f"SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS pos FROM (SELECT * FROM {_NEW} {_TOP})")
def _(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    known = Catalog().add(Table("orders", old.schema, "o_orderkey"))
    query = ir.Query("orders", order=(ir.Order("o_totalprice", True),), limit=40)
    _, _, rows = _maintained(spark, sf_dir, query, known, {"orders": old}, {"orders": new}, {"orders": _feed(spark, sf_dir)})
    return spark.createDataFrame([(k, r[2], i) for i, (k, r) in enumerate(rows, 1)], "o_orderkey long, o_totalprice double, pos int")


@_register("delta_nest", f"""SELECT p.c_custkey, p.pos, k.child_pos, k.o_orderkey FROM {_RICHEST} p JOIN
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS child_pos FROM {_NEW}) k ON c_custkey = o_custkey WHERE child_pos <= 3""")
def _(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    customer = tables(spark, sf_dir, "customer")["customer"]
    known = Catalog().add(Table("customer", customer.schema, "c_custkey")).add(Table("orders", old.schema, "o_orderkey")).relate(RELATIONS[2])
    best = ir.Query("orders", order=(ir.Order("o_totalprice", True),), limit=3)
    query = ir.Query("customer", ir.Cmp(c("c_mktsegment"), "=", v("BUILDING")), _BALANCE, 50, (ir.Related("orders", best),))
    _, _, rows = _maintained(spark, sf_dir, query, known, {"customer": customer, "orders": old}, {"customer": customer, "orders": new}, {"orders": _feed(spark, sf_dir)})
    flat = [(k, i, j, x["o_orderkey"]) for i, (k, r) in enumerate(rows, 1) for j, x in enumerate(r[-1], 1)]
    return spark.createDataFrame(flat, "c_custkey long, pos int, child_pos int, o_orderkey long")


@_register("view_positional_diff", f"SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS pos FROM (SELECT * FROM {_NEW} {_TOP})")
def _(spark, sf_dir):
    """The old list with the positional changes replayed is the new one."""
    old, new = _old_new(spark, sf_dir)
    known = Catalog().add(Table("orders", old.schema, "o_orderkey"))
    query = ir.Query("orders", order=(ir.Order("o_totalprice", True),), limit=40)
    _, before, rows = _maintained(spark, sf_dir, query, known, {"orders": old}, {"orders": new}, {"orders": _feed(spark, sf_dir)})
    replayed = view.replay([r for _, r in before], view.positional_diff(before, rows))
    return spark.createDataFrame([(r[0], i) for i, r in enumerate(replayed, 1)], "o_orderkey long, pos int")


@_register(
    "mutate_insert_update_delete",
    """SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey NOT IN (2, 3) UNION ALL SELECT s_suppkey, 'renamed' AS s_name, CAST(NULL AS DOUBLE) AS s_acctbal FROM supplier WHERE s_suppkey = 2
    UNION ALL SELECT 900001 AS s_suppkey, 'new' AS s_name, CAST(12.5 AS DOUBLE) AS s_acctbal""",
)
def _(spark, sf_dir):
    from ..engine import Engine

    supplier = tables(spark, sf_dir, "supplier")["supplier"]
    engine = Engine(spark, catalog({"supplier": supplier}))
    engine.load("supplier", supplier)
    batches = engine._resolve([ir.Insert("supplier", (900001, "to be changed", 0, 0.0)), ir.Update("supplier", 900001, (("s_name", "new"), ("s_acctbal", 12.5))), ir.Update("supplier", 2, (("s_name", "renamed"),)), ir.Update("supplier", 2, (("s_acctbal", None),)), ir.Delete("supplier", 3)])
    return deltas.apply(supplier, batches["supplier"], "s_suppkey").select("s_suppkey", "s_name", "s_acctbal")


@_register("stream_feed", f"SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS pos FROM (SELECT * FROM {_NEW} {_TOP})")
def _(spark, sf_dir):
    """The same list, kept up to date by micro-batches of a change feed."""
    from ..engine import Engine
    from ..streaming.feed import Feed

    old, _ = _old_new(spark, sf_dir)
    known = Catalog().add(Table("orders", old.schema, "o_orderkey"))
    engine = Engine(spark, known)
    engine.load("orders", old)
    live = engine.subscribe(ir.Query("orders", order=(ir.Order("o_totalprice", True),), limit=40))
    feed = Feed(engine, "orders")
    changes = _feed(spark, sf_dir).select(F.lit(1).cast("long").alias("seq"), deltas.kind().alias("op"), "key", F.col("after").alias("row"))
    for number, part in enumerate((changes.where("op = 'D'"), changes.where("op <> 'D'"))):
        feed.apply(part, number)
    return spark.createDataFrame([(r[0], r[2], i) for i, r in enumerate(live.rows, 1)], "o_orderkey long, o_totalprice double, pos int")


@_register("nest_clashing_names", f"""SELECT p.c_custkey, p.pos, k.child_pos, k.rank, k.parent FROM {_RICHEST} p JOIN
    (SELECT o_custkey, o_orderkey AS rank, o_orderpriority AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS child_pos FROM orders) k ON c_custkey = o_custkey WHERE child_pos <= 3""")
def _(spark, sf_dir):
    """Children with columns that are called as if they said where a child belongs."""
    found = tables(spark, sf_dir, "customer", "orders")
    customer, orders = found["customer"], found["orders"].select(F.col("o_orderkey").alias("rank"), F.col("o_orderpriority").alias("parent"), "o_custkey", "o_totalprice")
    known = Catalog().add(Table("customer", customer.schema, "c_custkey")).add(Table("orders", orders.schema, "rank")).relate(RELATIONS[2])
    best = ir.Query("orders", order=(ir.Order("o_totalprice", True),), limit=3)
    query = compile_query(ir.Query("customer", ir.Cmp(c("c_mktsegment"), "=", v("BUILDING")), _BALANCE, 50, (ir.Related("orders", best),)), known)
    rows = lower.evaluate(query, {"customer": customer, "orders": orders})
    numbered = rows.withColumn("pos", F.row_number().over(Window.orderBy(*ordering.order_columns(query.order, "c_custkey"))))
    return numbered.select("c_custkey", "pos", F.posexplode("orders").alias("i", "x")).select("c_custkey", "pos", (F.col("i") + 1).alias("child_pos"), "x.rank", "x.parent")


_CHURNED = """(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 6) THEN 600000.5 + o_orderkey ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 3)
    UNION ALL SELECT 90000001 AS o_orderkey, 1 AS o_custkey, CAST(700000.25 AS DOUBLE) AS o_totalprice UNION ALL SELECT 90000002 AS o_orderkey, 2 AS o_custkey, CAST(NULL AS DOUBLE) AS o_totalprice)"""


@_register("engine_churn", f"SELECT o_orderkey, o_totalprice, row_number() OVER ({_TOP.replace(' LIMIT 40', '')}) AS pos FROM (SELECT * FROM {_CHURNED} {_TOP})")
def _(spark, sf_dir):
    """What a host shows that has only been sent changes: mutations of an engine, a subscription, and its events replayed."""
    from ..engine import Engine

    old, _ = _old_new(spark, sf_dir)
    engine = Engine(spark, Catalog().add(Table("orders", old.schema, "o_orderkey")))
    engine.load("orders", old)
    live = engine.subscribe(ir.Query("orders", order=(ir.Order("o_totalprice", True),), limit=40))
    shown, events = [x.row for x in live.initial.changes], []
    engine.on_delta(events.append)
    lowest = [r[0] for r in old.select("o_orderkey").orderBy("o_orderkey").limit(6).collect()]
    best = [r[0] for r in live.rows[:3]]
    engine.mutate([ir.Delete("orders", k) for k in best], ("host", 1))
    engine.mutate([ir.Update("orders", k, (("o_totalprice", 600000.5 + k),)) for k in lowest if k not in best], ("host", 2))
    engine.mutate([ir.Insert("orders", (90000001, 1, 1.0)), ir.Insert("orders", (90000002, 2, None)), ir.Update("orders", 90000001, (("o_totalprice", 700000.25),))], ("host", 3))
    engine.mutate([ir.Insert("orders", (90000003, 3, 900000.0))], ("host", 4))
    engine.mutate([ir.Delete("orders", 90000003)], ("host", 5))
    engine.mutate([ir.Delete("orders", 90000001)], ("host", 3))  # has been applied
    for e in events:
        shown = view.replay(shown, e.changes)
    return spark.createDataFrame([(r[0], r[2], i) for i, r in enumerate(shown, 1)], "o_orderkey long, o_totalprice double, pos int")
