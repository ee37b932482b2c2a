"""Compiled queries as DataFrames: the shape is chosen here, the rest by Catalyst.

The top rows are taken first, so children are read for them only: their keys,
bounded by the list's limit, restrict the child scan before the children are
ranked.  Lists without a bound are joined without broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ordering, predicates
from ..functions.values import join_keys
from . import ir
from .compile import Child, Compiled

#: Parents whose keys, and whose children, may be broadcast; a longer list is joined by shuffle.
BROADCAST_ROWS = 10_000

Tables = Mapping[str, DataFrame]


def bounded(frame: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(frame) if rows is not None and rows <= BROADCAST_ROWS else frame


def filtered(query: Compiled, tables: Tables) -> DataFrame:
    """The rows of the root table that the query's predicate keeps."""
    frame = tables[query.table.name]
    if isinstance(query.where, ir.Always):
        return frame
    return frame.where(predicates.lower(query.where, frame.schema, query.params))


def scan(query: Compiled, tables: Tables, after: ir.Cursor | None = None, limit: int | None = None) -> DataFrame:
    """The bounded ordered scan: filtered rows after a place, in order, at most limit of them."""
    rows = filtered(query, tables)
    if after is not None:
        rows = rows.where(ordering.after_cursor(after, query.order, query.table.key, rows.schema))
    rows = rows.orderBy(*ordering.order_columns(query.order, query.table.key))
    return rows if limit is None else rows.limit(limit)


def top(query: Compiled, tables: Tables) -> DataFrame:
    """The list's own rows, unordered if it has no bound."""
    if query.limit is None:
        rows = filtered(query, tables)
        if query.start_after is not None:
            rows = rows.where(ordering.after_cursor(query.start_after, query.order, query.table.key, rows.schema))
        return rows
    return scan(query, tables, query.start_after, query.limit)


def free_column(name: str, taken: list[str]) -> str:
    """The name, or one made from it that isn't taken (in any case of letters)."""
    lower = {t.lower() for t in taken}
    while name in lower:
        name += "_"
    return name


def children_of(parents: DataFrame, bound: int | None, child: Child, tables: Tables, values: list | None = None) -> tuple[DataFrame, str, str]:
    """The wanted children of these parents, nested lists included, and the names of two more columns: the join key and the rank.

    values: of the parents' column, where they are known, so that the scan skips other children.
    """
    relation, query = child.relation, child.query
    kids = filtered(query, tables)
    names = list(query.select or query.table.columns) + [nested.name for nested in query.children]
    parent, rank = (free_column(n, [*kids.columns, *names]) for n in ("parent", "rank"))
    own_type, kind = parents.schema[relation.parent_column].dataType, kids.schema[relation.child_column].dataType
    if values is not None and own_type == kind and isinstance(kind, (T.IntegralType, T.StringType)) and len(values) <= BROADCAST_ROWS:
        kids = kids.where(F.col(f"`{relation.child_column}`").isin([x for x in dict.fromkeys(values) if x is not None]))
    own, theirs = join_keys(F.col(f"`{relation.parent_column}`"), own_type, F.col(f"`{relation.child_column}`"), kind)
    keys = parents.select(own.alias(parent)).where(F.col(parent).isNotNull()).distinct()
    kids = kids.withColumn(parent, theirs).join(bounded(keys, bound), parent, "left_semi")
    window = Window.partitionBy(parent).orderBy(*ordering.order_columns(query.order, query.table.key))
    kids = kids.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= query.limit)
    for nested in query.children:
        kids = attach(kids, None if bound is None else bound * query.limit, nested, tables)
    return kids.select(parent, rank, *[f"`{n}`" for n in names]), parent, rank


def attach(parents: DataFrame, bound: int | None, child: Child, tables: Tables, values: list | None = None) -> DataFrame:
    """The parents with one more column, the ordered array of their children; empty where there are none."""
    kids, parent, rank = children_of(parents, bound, child, tables, values)
    names = [n for n in kids.columns if n not in (parent, rank)]
    item = F.struct(F.col(rank).alias("rank"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    lists = kids.groupBy(parent).agg(F.array_sort(F.collect_list(item), lambda a, b: a["rank"] - b["rank"]).alias("items"))
    own_key, list_key = (free_column(n, [*parents.columns, child.name]) for n in ("parent_key_", "list_key_"))
    lists = lists.select(F.col(parent).alias(list_key), F.transform("items", lambda x: x["row"]).alias(child.name))
    own, _ = join_keys(F.col(f"`{child.relation.parent_column}`"), parents.schema[child.relation.parent_column].dataType, F.col(list_key), lists.schema[list_key].dataType)
    keyed = parents.withColumn(own_key, own)
    joined = keyed.join(bounded(lists, bound), F.col(own_key) == F.col(list_key), "left").drop(list_key, own_key)
    empty = F.array().cast(lists.schema[child.name].dataType)
    return joined.withColumn(child.name, F.coalesce(F.col(f"`{child.name}`"), empty))


def evaluate(query: Compiled, tables: Tables) -> DataFrame:
    """The whole answer.  After a join rows are in no order; ``ordered`` puts them in the list's."""
    rows = top(query, tables)
    for child in query.children:
        rows = attach(rows, query.limit, child, tables)
    if query.select:
        names = [*query.select, *(c.name for c in query.children)]
        rows = rows.select(*[f"`{n}`" for n in names])
    return rows


def ordered(query: Compiled, rows: DataFrame) -> DataFrame:
    return rows.orderBy(*ordering.order_columns(query.order, query.table.key))


def explain(frame: DataFrame) -> str:
    """The formatted physical plan."""
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
