"""Predicates and orders against the plain-Python oracle, many cases in one job."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests import oracle
from tidepool.functions import ordering, predicates
from tidepool.plans import ir

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("i", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("t", T.StringType()), T.StructField("b", T.BinaryType())])
BIG = 2**53

ROWS = [
    (1, 1, 1.0, "a", b"a"),
    (2, None, None, None, None),
    (3, BIG + 1, float(BIG), "5", b"\x80"),
    (4, -3, -2.5, "", b""),
    (5, 2**63 - 1, 9.3e18, "ab", b"\x7f"),
    (6, -(2**63), -9.3e18, "b", b"ab"),
    (7, 0, math.inf, "é", None),
    (8, 7, math.nan, "ba", b"b"),
    (9, 3, 3.0, "abc", b"a"),
    (10, -2, -math.inf, "Z", b"z"),
    (11, 2, 1.5, None, b"q"),
]


def _dict(row):
    return dict(zip(SCHEMA.names, row))


def _random_expr(rng):
    kind = rng.random()
    if kind < 0.5:
        return ir.Col(rng.choice(["i", "r", "t", "b", "absent"]))
    v = rng.choice([None, 0, 1, 3, -3, BIG, BIG + 1, 2**63 - 1, 1.0, 1.5, -2.5, float(BIG), 9.3e18, math.inf, math.nan, "a", "ab", "", "5", b"a", b"\x80"])
    return ir.Lit(v) if kind < 0.9 else ir.Param(rng.randrange(2))


def _random_predicate(rng, depth=3):
    k = rng.randrange(10 if depth else 6)
    e = lambda: _random_expr(rng)
    if k < 2:
        return ir.Cmp(e(), rng.choice(["=", "!=", "<", "<=", ">", ">="]), e())
    if k == 2:
        return ir.In(e(), tuple(rng.choice([None, 1, 3.0, 1.5, "a", b"a", BIG]) for _ in range(rng.randrange(3))))
    if k == 3:
        return ir.Between(e(), e(), e())
    if k == 4:
        return rng.choice([ir.IsNull, ir.IsNotNull])(e())
    if k == 5:
        return ir.Prefix(e(), rng.choice(["", "a", "ab", "é"]))
    if k < 8:
        return rng.choice([ir.And, ir.Or])(tuple(_random_predicate(rng, depth - 1) for _ in range(rng.randrange(3))))
    return ir.Not(_random_predicate(rng, depth - 1))


def test_random_predicates_equal_the_oracle(spark):
    rng = random.Random(0x1571CE)
    params = (3, "ab")
    cases = [_random_predicate(rng) for _ in range(240)]
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for at in range(0, len(cases), 40):
        part = cases[at : at + 40]
        got = frame.select("id", *[predicates.lower(p, SCHEMA, params).alias(f"p{i}") for i, p in enumerate(part)]).collect()
        for r, row in zip(got, ROWS):
            for i, p in enumerate(part):
                assert r[f"p{i}"] == oracle.test3(p, _dict(row), params), (p, row)


@pytest.mark.parametrize(
    "predicate,ids",
    [
        (ir.Cmp(ir.Col("i"), ">", ir.Col("r")), None),
        (ir.Cmp(ir.Col("t"), ">", ir.Lit(5)), {1, 3, 4, 5, 6, 7, 8, 9, 10}),
        (ir.Not(ir.Cmp(ir.Col("i"), "<", ir.Lit(None))), set()),
        (ir.Not(ir.In(ir.Col("i"), ())), {1, 3, 4, 5, 6, 7, 8, 9, 10, 11}),
        (ir.In(ir.Col("i"), (1, None)), {1}),
        (ir.And(()), set(range(1, 12))),
        (ir.Or(()), set()),
        (ir.Between(ir.Col("i"), ir.Lit(1), ir.Lit(3)), {1, 9, 11}),
        (ir.Prefix(ir.Col("t"), ""), {1, 3, 4, 5, 6, 7, 8, 9, 10}),
        (ir.Cmp(ir.Col("i"), "=", ir.Lit(float(BIG))), set()),
    ],
)
def test_named_cases(spark, predicate, ids):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["id"] for r in frame.where(predicates.lower(predicate, SCHEMA)).collect()}
    assert got == {r[0] for r in ROWS if oracle.test3(predicate, _dict(r)) is True}
    assert ids is None or got == ids


def test_comparison_with_a_fractional_constant_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    plan = frame.where(predicates.lower(ir.Cmp(ir.Col("i"), ">", ir.Lit(1.5)), SCHEMA))._jdf.queryExecution().toString()
    assert "GreaterThan(i,1)" in plan


ORDERS = [(ir.Order("t"),), (ir.Order("t", True),), (ir.Order("i", True), ir.Order("t")), (ir.Order("r"), ir.Order("i", True)), ()]


@pytest.mark.parametrize("order", ORDERS)
def test_order_and_paging_visit_every_row_once(spark, order):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, 1.0, 1.5]), rng.choice([None, "a", "b"]), None) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = [r["id"] for r in sorted(map(_dict, rows), key=oracle.order_key(order, "id"))]
    columns = ordering.order_columns(order, "id")
    assert [r["id"] for r in frame.orderBy(*columns).collect()] == want
    seen, cursor = [], None
    while True:
        page = frame if cursor is None else frame.where(ordering.after_cursor(cursor, order, "id", SCHEMA))
        got = page.orderBy(*columns).limit(15).collect()
        if not got:
            break
        seen += [r["id"] for r in got]
        cursor = ordering.cursor_of(got[-1], order, "id")
    assert seen == want


def test_cursor_anywhere_equals_the_oracle(spark):
    order = (ir.Order("i"), ir.Order("t", True))
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for values, key in [((None, None), 2), ((None, "zz"), 0), ((3, "abc"), 9), ((3, None), 100), ((2, "x"), 5)]:
        at = {"i": values[0], "t": values[1], "id": key}
        want = {r[0] for r in ROWS if oracle.order_key(order, "id")(at) < oracle.order_key(order, "id")(_dict(r))}
        got = {r["id"] for r in frame.where(ordering.after_cursor(ir.Cursor(values, key), order, "id", SCHEMA)).select(F.col("id")).collect()}
        assert got == want, (values, key)
