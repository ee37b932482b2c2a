"""The engine: tables, subscriptions, and mutations that reach both."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from .errors import Closed, MutationError, UnsupportedOps
from .operators import deltas, view
from .operators.incremental import LiveList, bytes_of
from .plans import ir, lower
from .plans.compile import Compiled, compile_query
from .schema import Catalog, Table
from .sources.local import frame_of
from .sources.snapshots import SnapshotStore


@dataclass(frozen=True)
class Stats:
    """Counters of an engine."""

    subscriptions: int
    view_rows: int
    view_bytes: int
    graph_bytes: int
    version: int
    mutations: int
    events: int
    window_refills: int
    window_refill_rows: int
    child_refills: int
    child_refill_rows: int


class Subscription:
    """One query kept up to date; ``initial`` is the list as it was at the start."""

    def __init__(self, engine: Engine, number: int, compiled: Compiled, slack: int):
        self._engine, self.number, self.compiled = engine, number, compiled
        self.live = LiveList(compiled, slack)
        self.initial = view.ViewDelta(number, engine.version, tuple(view.Added(i, row) for i, (_, row) in enumerate(self.live.hydrate(engine.tables))))
        self.closed = False

    @property
    def rows(self) -> list[tuple]:
        return [row for _, row in self.live.rows]

    def close(self) -> None:
        self.closed = True
        self._engine._subscriptions.pop(self.number, None)

    def __enter__(self) -> Subscription:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class _Tables(Mapping):
    def __init__(self, store: SnapshotStore):
        self._store = store

    def __getitem__(self, name: str) -> DataFrame:
        return self._store.read(name)

    def __iter__(self):
        return iter(self._store.catalog.tables)

    def __len__(self) -> int:
        return len(self._store.catalog.tables)


class Engine:
    """Opens the tables of a catalog, in a folder or in memory."""

    def __init__(self, spark: SparkSession, catalog: Catalog, path: str | None = None, nested: bool = False):
        self.spark, self.catalog, self.nested = spark, catalog, nested
        self.store = SnapshotStore(spark, catalog, path)
        self.tables = _Tables(self.store)
        self._mutations = self._events = 0
        self._numbers = 0
        self._subscriptions: dict[int, Subscription] = {}
        self._sink: Callable[[view.ViewDelta], None] | None = None
        self._closed = False

    @property
    def version(self) -> int:
        """Transactions so far, also those before the database was opened again."""
        return self.store.database_version

    # -- queries

    def query(self, query: ir.Query) -> DataFrame:
        """One answer, not kept up to date."""
        self._open()
        compiled = compile_query(query, self.catalog, self.nested)
        return lower.ordered(compiled, lower.evaluate(compiled, self.tables)) if not query.select else lower.evaluate(compiled, self.tables)

    def subscribe(self, query: ir.Query, slack: int = -1) -> Subscription:
        self._open()
        compiled = compile_query(query, self.catalog, self.nested)
        self._numbers += 1
        subscription = Subscription(self, self._numbers, compiled, slack)
        self._subscriptions[subscription.number] = subscription
        return subscription

    def on_delta(self, sink: Callable[[view.ViewDelta], None] | None) -> None:
        """Who gets the changes; None for nobody."""
        self._sink = sink

    # -- mutations

    def mutate(self, ops: list[ir.Op], mutation_id: tuple[str, int] | None = None) -> int:
        """Applies operations in their order, all or none, and returns the version.

        Later operations see what earlier ones did.  mutation_id: of a client and
        a number; one that has been applied is not applied again, also when the
        database has been opened anew since.
        """
        self._open()
        if mutation_id is not None and self.store.has_applied(mutation_id):
            return self.version
        batches = self._resolve(ops)
        version = self._advance(batches, mutation_id)
        self._mutations += 1
        return version

    def _resolve(self, ops: list[ir.Op]) -> dict[str, DataFrame]:
        unknown = sum(not isinstance(op, (ir.Insert, ir.Update, ir.Delete)) for op in ops)
        if unknown:
            raise UnsupportedOps(unknown)
        keys: dict[str, list] = {}
        for op in ops:
            if op.table not in self.catalog.tables:
                raise MutationError(f"there is no table {op.table!r}")
            table = self.catalog.table(op.table)
            if isinstance(op, ir.Insert):
                if len(op.row) != len(table.columns):
                    raise MutationError(f"a row of {op.table!r} has {len(table.columns)} values, not {len(op.row)}")
                keys.setdefault(op.table, []).append(op.row[table.columns.index(table.key)])
            else:
                keys.setdefault(op.table, []).append(op.key)
        first = {name: self.store.lookup(name, list(dict.fromkeys(k))) for name, k in keys.items()}
        now = {name: dict(rows) for name, rows in first.items()}
        for op in ops:
            table, rows = self.catalog.table(op.table), now[op.table]
            match op:
                case ir.Insert(_, row):
                    rows[row[table.columns.index(table.key)]] = Row(*table.columns)(*row)
                case ir.Update(_, key, values):
                    if rows.get(key) is None:
                        raise MutationError(f"{op.table!r} has no row {key!r}")
                    changed = rows[key].asDict()
                    for column, value in values:
                        if column not in changed:
                            raise MutationError(f"{op.table!r} has no column {column!r}")
                        if column == table.key and value != key:
                            raise MutationError(f"the key of {op.table!r} can't be changed")
                        changed[column] = value
                    rows[key] = Row(*table.columns)(*[changed[c] for c in table.columns])
                case ir.Delete(_, key):
                    if rows.get(key) is None:
                        raise MutationError(f"{op.table!r} has no row {key!r}")
                    rows[key] = None
        out = {}
        for name, rows in now.items():
            table = self.catalog.table(name)
            changes = [(k, first[name].get(k), after) for k, after in rows.items() if tuple(first[name].get(k) or ()) != tuple(after or ())]
            if changes:
                try:
                    out[name] = frame_of(self.spark, changes, deltas.schema(_nullable(table.schema), table.key))
                except Exception as e:
                    raise MutationError(f"values don't fit the columns of {name!r}: {e}") from e
        return out

    def apply_changes(self, batches: Mapping[str, DataFrame], stream: tuple[str, int] | None = None) -> int:
        """Commits composed batches of any size, as a stream brings them, and returns the version; stream: which one, and its micro-batch."""
        self._open()
        return self._advance(dict(batches), stream=stream)

    def _advance(self, batches: dict[str, DataFrame], mutation_id: tuple[str, int] | None = None, stream: tuple[str, int] | None = None) -> int:
        if not batches and mutation_id is None and stream is None:
            return self.version
        self.store.transact(batches, mutation_id, stream)  # the tables first: what is read again must see the batches
        if not batches:
            return self.version
        for s in list(self._subscriptions.values()):
            if not s.live.touched(batches):
                continue
            old = s.live.rows
            changes = tuple(view.positional_diff(old, s.live.apply(batches, self.tables)))
            if changes and self._sink is not None:
                self._events += 1
                self._sink(view.ViewDelta(s.number, self.version, changes))
        return self.version

    # -- housekeeping

    def stats(self) -> Stats:
        lists = [s.live for s in self._subscriptions.values()]
        return Stats(
            len(lists),
            sum(len(x.rows) for x in lists),
            sum(bytes_of(r for _, r in x.rows) for x in lists),
            sum(n for x in lists for _, n in x.state_report()),
            self.version,
            self._mutations,
            self._events,
            sum(x.counters.window_refills for x in lists),
            sum(x.counters.window_rows for x in lists),
            sum(x.counters.child_refills for x in lists),
            sum(x.counters.child_rows for x in lists),
        )

    def degrade(self) -> int:
        """Under memory pressure: every list gives up its slack; how many rows that sheds."""
        return sum(s.live.degrade() for s in self._subscriptions.values())

    def inspect(self) -> dict[int, list[tuple[str, int]]]:
        """For each subscription its operators, sources first, with the bytes that they hold."""
        return {n: s.live.state_report() for n, s in self._subscriptions.items()}

    def close(self) -> None:
        for s in list(self._subscriptions.values()):
            s.close()
        self._closed = True

    def _open(self) -> None:
        if self._closed:
            raise Closed("the engine is closed")

    def load(self, name: str, rows: DataFrame) -> None:
        """Fills a table before anyone subscribes to it."""
        self._open()
        self.store.load(name, rows)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
