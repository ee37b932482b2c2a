"""Checking a query against a catalog, before it touches data."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import NotYet, RelationTable, TooManyOrderColumns, Unbounded, UnboundParam, UnknownColumn, UnorderedWindow
from ..functions import predicates
from ..schema import Catalog, Relation, Table
from . import ir

#: Each sort column is one the storage has to be laid out for.
MAX_ORDER_COLUMNS = 3
#: Levels of relations below the root, where nesting is switched on.
MAX_DEPTH = 3


@dataclass(frozen=True)
class Child:
    """A relation of a compiled query and what is attached."""

    relation: Relation
    query: Compiled
    name: str


@dataclass(frozen=True)
class Compiled:
    """A query whose names are all known.  limit: None without bound."""

    table: Table
    where: ir.Predicate
    params: tuple
    order: tuple[ir.Order, ...]
    limit: int | None
    children: tuple[Child, ...] = ()
    select: tuple[str, ...] | None = None
    start_after: ir.Cursor | None = None

    @property
    def tables(self) -> set[str]:
        return {self.table.name}.union(*(c.query.tables for c in self.children))


def compile_query(query: ir.Query, catalog: Catalog, nested: bool = False) -> Compiled:
    """Resolves a query or says what is wrong with it.  nested: allow relations of relations, an extension."""
    return _compile(query, catalog, nested, 0, query.params)


def _compile(query: ir.Query, catalog: Catalog, nested: bool, depth: int, params: tuple) -> Compiled:
    table = catalog.table(query.table)
    for name in sorted(predicates.columns_of(query.where)):
        _check_column(table, name)
    for index in sorted(predicates.params_of(query.where)):
        if index >= len(params):
            raise UnboundParam(index, len(params))
    if len(query.order) > MAX_ORDER_COLUMNS:
        raise TooManyOrderColumns(table.name, len(query.order))
    for o in query.order:
        _check_column(table, o.column)
    for name in query.select or ():
        _check_column(table, name)
    if not query.limit and not (query.allow_unbounded and depth == 0):
        raise Unbounded(table.name)
    if query.limit and not query.order:
        raise UnorderedWindow(table.name)
    if depth and query.related and not nested:
        raise NotYet("relations of relations; compile with nested=True")
    if depth >= MAX_DEPTH and query.related:
        raise NotYet(f"more than {MAX_DEPTH} levels of relations")
    children = []
    for r in query.related:
        relation = catalog.relation(table.name, r.relation)
        if r.query.table != relation.child:
            raise RelationTable(r.relation, relation.child, r.query.table)
        # A sub-query without parameters of its own reads the root's.
        own = _compile(r.query, catalog, nested, depth + 1, r.query.params or params)
        children.append(Child(relation, own, r.name or relation.name))
    return Compiled(table, query.where, params, query.order, query.limit or None, tuple(children), query.select, query.start_after)


def _check_column(table: Table, name: str) -> None:
    if name not in table.columns:
        raise UnknownColumn(table.name, name)
