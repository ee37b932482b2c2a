"""Comparing values of different kinds as the query language does.

Numbers compare by value, exactly, even where a long has no double; any text is
greater than any number, and any bytes than any text; a comparison with null is
unknown.  Kinds are known before a query runs, so all of it is decided while
the columns are built, and what can be is left to plain comparisons that reach
the scan.
"""

from __future__ import annotations

import datetime
import decimal
import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which values of different kinds compare.
RANK = {"int": 0, "real": 0, "decimal": 0, "text": 1, "blob": 2}

_LONG = 2**63
#: Longs up to this size are all doubles too.
_EXACT = 2**53


@dataclass(frozen=True)
class Operand:
    """A column with its kind; value: what it is, if constant."""

    column: Column
    kind: str
    constant: bool = False
    value: Any = None


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "real"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.BinaryType):
        return "blob"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "rows" if isinstance(data_type, T.ArrayType) else "other"


def column(name: str, schema: T.StructType) -> Operand:
    """A column of a table; one that isn't there reads as null."""
    if name not in schema.names:
        return constant(None)
    data_type = schema[name].dataType
    c = F.col(f"`{name}`")
    return Operand(c.cast("long") if isinstance(data_type, T.BooleanType) else c, kind_of(data_type))


def constant(value: Any) -> Operand:
    if value is None:
        return Operand(F.lit(None), "null", True, None)
    if isinstance(value, bool):
        value = int(value)
    if isinstance(value, int):
        return Operand(F.lit(value).cast("long"), "int", True, value)
    if isinstance(value, float):
        return Operand(F.lit(value).cast("double"), "real", True, value)
    if isinstance(value, str):
        return Operand(F.lit(value), "text", True, value)
    if isinstance(value, (bytes, bytearray)):
        return Operand(F.lit(bytes(value)), "blob", True, bytes(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return Operand(F.lit(value), "time", True, value)
    if isinstance(value, decimal.Decimal):
        return Operand(F.lit(value), "decimal", True, value)
    raise TypeError(f"no constant of the query language: {value!r}")


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def _native(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _by_sign(op: str, sign: Column) -> Column:
    return _native(op, sign, F.lit(0))


def _unless_null(*operands: Operand, value: bool) -> Column:
    missing = [x.column.isNull() for x in operands if not x.constant]
    if not missing:
        return F.lit(value)
    some = missing[0]
    for m in missing[1:]:
        some = some | m
    return F.when(some, unknown()).otherwise(F.lit(value))


_FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_HOLDS = {"=": lambda s: s == 0, "!=": lambda s: s != 0, "<": lambda s: s < 0, "<=": lambda s: s <= 0, ">": lambda s: s > 0, ">=": lambda s: s >= 0}


def exact_sign(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as the long a is below, equal to or above the double b; NaN is above every long.  Null if either is."""
    floor = F.floor(b)
    sign = F.when(b >= F.lit(float(_LONG)), -1).when(b < F.lit(-float(_LONG)), 1).when(a < floor, -1).when(a > floor, 1).when(b > floor.cast("double"), -1).otherwise(0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).otherwise(sign)


def _int_with_real(op: str, a: Operand, b: Operand) -> Column:
    """The long a against the double b; with one of them constant, a comparison that the scan can use."""
    if b.constant:
        v = b.value
        if math.isnan(v) or v >= _LONG:
            return _unless_null(a, value=_HOLDS[op](-1))
        if v < -_LONG:
            return _unless_null(a, value=_HOLDS[op](1))
        floor = math.floor(v)
        if floor == v:
            return _native(op, a.column, F.lit(floor).cast("long"))
        if op in ("=", "!="):
            return _unless_null(a, value=op == "!=")
        return _native("<=" if op in ("<", "<=") else ">", a.column, F.lit(floor).cast("long"))
    if a.constant and abs(a.value) <= _EXACT:
        return _native(op, F.lit(float(a.value)), b.column)
    return _by_sign(op, exact_sign(a.column, b.column))


def compare(op: str, a: Operand, b: Operand) -> Column:
    """a op b; unknown with a null or with nested rows."""
    if "null" in (a.kind, b.kind) or "rows" in (a.kind, b.kind):
        return unknown()
    if a.kind == b.kind and a.kind != "other":
        return _native(op, a.column, b.column)
    if (a.kind, b.kind) == ("int", "real"):
        return _int_with_real(op, a, b)
    if (a.kind, b.kind) == ("real", "int"):
        return _int_with_real(_FLIP[op], b, a)
    if a.kind not in RANK or b.kind not in RANK:
        raise TypeError(f"{a.kind} and {b.kind} can't be compared")
    if RANK[a.kind] == RANK[b.kind]:
        return _native(op, a.column, b.column)
    return _unless_null(a, b, value=_HOLDS[op](RANK[a.kind] - RANK[b.kind]))


def join_keys(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> tuple[Column, Column]:
    """Both sides of an equi-join such that equal values, and only they, meet; null meets nothing."""
    kinds = kind_of(a_type), kind_of(b_type)

    def whole(x: Column) -> Column:
        fits = (x == F.floor(x)) & (x >= F.lit(-float(_LONG))) & (x < F.lit(float(_LONG)))
        return F.when(fits, x.cast("long"))

    if kinds == ("int", "real"):
        return a.cast("long"), whole(b)
    if kinds == ("real", "int"):
        return whole(a), b.cast("long")
    if kinds[0] != kinds[1] and (kinds[0] not in RANK or kinds[1] not in RANK or RANK[kinds[0]] != RANK[kinds[1]]):
        return F.lit(None).cast("long"), F.lit(None).cast("long")  # never equal
    return a, b
