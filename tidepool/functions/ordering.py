"""Orders and cursors as Spark columns: nulls first going up and last going down, and the key, always going up, last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import ir
from . import values as V


def order_columns(order: tuple[ir.Order, ...], key: str, prefix: str = "") -> list[Column]:
    """Sort columns; prefix: where the row's columns are, as in ``after.``."""
    col = lambda name: F.col(f"{prefix}`{name}`")
    return [col(o.column).desc_nulls_last() if o.desc else col(o.column).asc_nulls_first() for o in order] + [col(key).asc_nulls_first()]


def cursor_of(row, order: tuple[ir.Order, ...], key: str) -> ir.Cursor:
    """The place of a row."""
    return ir.Cursor(tuple(row[o.column] for o in order), row[key])


def _strictly_after(x: V.Operand, value, desc: bool) -> Column:
    if value is None:
        return F.lit(False) if desc else x.column.isNotNull()
    at = V.constant(value)
    return (x.column.isNull() | V.compare("<", x, at)) if desc else F.coalesce(V.compare(">", x, at), F.lit(False))


def _tied(x: V.Operand, value) -> Column:
    return x.column.isNull() if value is None else F.coalesce(V.compare("=", x, V.constant(value)), F.lit(False))


def after_cursor(cursor: ir.Cursor, order: tuple[ir.Order, ...], key: str, schema: T.StructType) -> Column:
    """Rows strictly after a place: beyond it in the first column, or tied there and beyond it in the next, down to the key."""
    parts, tied = [], F.lit(True)
    for o, value in [*zip(order, cursor.values, strict=True), (ir.Order(key), cursor.key)]:
        x = V.column(o.column, schema)
        parts.append(tied & _strictly_after(x, value, o.desc))
        tied = tied & _tied(x, value)
    return reduce(lambda a, b: a | b, parts)
