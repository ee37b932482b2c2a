"""Queries and mutations as plain values; names are resolved later."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace
from typing import Any


# -- expressions: a column, a constant or a parameter; they don't nest


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    index: int


Expr = Col | Lit | Param


# -- predicates, three-valued until a row is kept or not


@dataclass(frozen=True)
class Always:
    """Every row."""


@dataclass(frozen=True)
class Cmp:
    left: Expr
    op: str  # = != < <= > >=
    right: Expr


@dataclass(frozen=True)
class In:
    left: Expr
    values: tuple


@dataclass(frozen=True)
class Between:
    left: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class IsNull:
    expr: Expr


@dataclass(frozen=True)
class IsNotNull:
    expr: Expr


@dataclass(frozen=True)
class Prefix:
    left: Expr
    prefix: str


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


@dataclass(frozen=True)
class Not:
    part: Any


Predicate = Always | Cmp | In | Between | IsNull | IsNotNull | Prefix | And | Or | Not


# -- lists


@dataclass(frozen=True)
class Order:
    column: str
    desc: bool = False


@dataclass(frozen=True)
class Cursor:
    """A place in an ordered list: the sort values and the key of a row; what follows starts after it."""

    values: tuple
    key: Any


@dataclass(frozen=True)
class Related:
    """Each row's children by a declared relation, as an array column."""

    relation: str
    query: Query
    name: str | None = None  # the relation's own name if absent


@dataclass(frozen=True)
class Query:
    """One table, filtered, ordered and cut, with its rows' children.

    ``select`` and ``start_after`` are extensions: a choice of root columns, and a cursor.
    """

    table: str
    where: Predicate = field(default_factory=Always)
    order: tuple[Order, ...] = ()
    limit: int = 0
    related: tuple[Related, ...] = ()
    allow_unbounded: bool = False
    params: tuple = ()
    select: tuple[str, ...] | None = None
    start_after: Cursor | None = None


def shape_hash(query: Query) -> str:
    """Equal for queries that differ in their parameters only."""
    return hashlib.sha256(repr(replace(query, params=())).encode()).hexdigest()


def view_hash(query: Query) -> str:
    """Equal for queries with equal parameters too."""
    return hashlib.sha256(repr(query).encode()).hexdigest()


# -- mutations


@dataclass(frozen=True)
class Insert:
    """A whole row, in column order; a key that is there is overwritten."""

    table: str
    row: tuple


@dataclass(frozen=True)
class Update:
    """Columns of an existing row; a column set to None becomes null."""

    table: str
    key: Any
    values: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class Delete:
    table: str
    key: Any


Op = Insert | Update | Delete
