"""Tables, their keys, and the one-to-many relations between them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import UnknownRelation, UnknownTable


@dataclass(frozen=True)
class Table:
    """A keyed table: one row for each value of the key column."""

    name: str
    schema: T.StructType
    key: str

    def __post_init__(self):
        if self.key not in self.schema.names:
            raise ValueError(f"key {self.key!r} is no column of {self.name!r}")

    @property
    def columns(self) -> list[str]:
        return self.schema.names


@dataclass(frozen=True)
class Relation:
    """Rows of ``child`` belong to the rows of ``parent`` where child_column equals parent_column (which needn't be the key)."""

    name: str
    parent: str
    child: str
    parent_column: str
    child_column: str


@dataclass
class Catalog:
    """Tables by name, and relations by parent and name."""

    tables: dict[str, Table] = field(default_factory=dict)
    relations: dict[tuple[str, str], Relation] = field(default_factory=dict)

    def add(self, table: Table) -> Catalog:
        self.tables[table.name] = table
        return self

    def relate(self, relation: Relation) -> Catalog:
        self.table(relation.parent), self.table(relation.child)
        self.relations[relation.parent, relation.name] = relation
        return self

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise UnknownTable(name)
        return self.tables[name]

    def relation(self, parent: str, name: str) -> Relation:
        if (parent, name) not in self.relations:
            raise UnknownRelation(parent, name)
        return self.relations[parent, name]
