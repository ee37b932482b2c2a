"""Predicates as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import ir
from . import values as V


def operand(expr: ir.Expr, schema: T.StructType, params: tuple) -> V.Operand:
    match expr:
        case ir.Col(name):
            return V.column(name, schema)
        case ir.Lit(value):
            return V.constant(value)
        case ir.Param(index):
            return V.constant(params[index] if index < len(params) else None)
    raise TypeError(f"no expression: {expr!r}")


def _either(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _in(left: V.Operand, listed: tuple) -> Column:
    if left.kind == "null":
        return V.unknown()
    items = [V.constant(v) for v in listed]
    known = [x for x in items if x.kind != "null"]
    same = [x for x in known if x.kind == left.kind]
    parts = [left.column.isin([x.value for x in same])] if same else []
    parts += [V.compare("=", left, x) for x in known if x.kind != left.kind]
    if len(known) < len(items):
        parts.append(V.unknown())
    if not parts:
        return F.when(left.column.isNull(), V.unknown()).otherwise(F.lit(False))
    return _either(parts)


def lower(predicate: ir.Predicate, schema: T.StructType, params: tuple = ()) -> Column:
    """The predicate over rows of this schema: true, false or null; ``where`` keeps what is true."""

    def read(expr: ir.Expr) -> V.Operand:
        return operand(expr, schema, params)

    match predicate:
        case ir.Always():
            return F.lit(True)
        case ir.Cmp(left, op, right):
            return V.compare(op, read(left), read(right))
        case ir.In(left, listed):
            return _in(read(left), listed)
        case ir.Between(left, low, high):
            return V.compare(">=", read(left), read(low)) & V.compare("<=", read(left), read(high))
        case ir.IsNull(expr):
            return read(expr).column.isNull()
        case ir.IsNotNull(expr):
            return read(expr).column.isNotNull()
        case ir.Prefix(left, prefix):
            x = read(left)
            if x.kind == "null":
                return V.unknown()
            if x.kind != "text":
                return F.when(x.column.isNull(), V.unknown()).otherwise(F.lit(False))
            return x.column.startswith(prefix)
        case ir.And(parts):
            return reduce(lambda a, b: a & b, [lower(p, schema, params) for p in parts]) if parts else F.lit(True)
        case ir.Or(parts):
            return _either([lower(p, schema, params) for p in parts]) if parts else F.lit(False)
        case ir.Not(part):
            return ~lower(part, schema, params)
    raise TypeError(f"no predicate: {predicate!r}")


def columns_of(predicate: ir.Predicate) -> set[str]:
    return {e.name for e in expressions(predicate) if isinstance(e, ir.Col)}


def params_of(predicate: ir.Predicate) -> set[int]:
    return {e.index for e in expressions(predicate) if isinstance(e, ir.Param)}


def expressions(predicate: ir.Predicate) -> list[ir.Expr]:
    match predicate:
        case ir.Cmp(left, _, right):
            return [left, right]
        case ir.In(left, _) | ir.Prefix(left, _):
            return [left]
        case ir.Between(left, low, high):
            return [left, low, high]
        case ir.IsNull(expr) | ir.IsNotNull(expr):
            return [expr]
        case ir.And(parts) | ir.Or(parts):
            return [e for p in parts for e in expressions(p)]
        case ir.Not(part):
            return expressions(part)
    return []
