"""Keeping a list up to date from changes.

The law: what ``apply`` keeps always equals the query evaluated from scratch.

A bounded list keeps a window of its first ``limit + slack`` rows.  A batch
takes changed rows out and puts new images in that come before the window's
end; only if fewer than ``limit`` rows are left is the table read again, after
the window's last row.  Spark orders the rows and does the scans, and each scan
is bounded by the window, so the driver holds the window and nothing else.

Children are kept likewise, a window for each visible parent: a batch of the
driver's rows changes the windows it touches, and the table is read again, in
one job, only for parents that are new on screen or have too few children left.
Batches of a stream, and children with children of their own, have their
touched parents read again.  An unbounded list is evaluated anew and compared.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ordering
from ..functions.values import join_keys
from ..plans import ir, lower
from ..plans.compile import Child, Compiled
from ..sources.local import frame_of, is_local
from . import deltas

# How the slack of a window starts and grows.

#: After so many refills the slack doubles.
REFILLS_PER_GROWTH = 8


def first_slack(k: int) -> int:
    return max(16, k // 4)


def largest_slack(k: int) -> int:
    return max(4 * k, 64)


@dataclass(frozen=True)
class Outcome:
    """What an operator did when asked to give up state: "stateless", "shed" with the bytes freed, or "pinned" where the answer needs all of it."""

    kind: str
    freed_bytes: int = 0


def bytes_of(rows: Iterable[tuple]) -> int:
    return sum(sys.getsizeof(r) + sum(map(sys.getsizeof, r)) for r in rows)


@dataclass
class Counters:
    """What the refills of a list have read."""

    window_refills: int = 0
    window_rows: int = 0
    child_refills: int = 0
    child_rows: int = 0


@dataclass
class TopK:
    """The window of one bounded list.  full: it holds every row there is."""

    query: Compiled
    slack: int = -1
    rows: list[Row] = field(default_factory=list)
    full: bool = True
    since_growth: int = 0
    counters: Counters = field(default_factory=Counters)

    def __post_init__(self):
        if self.slack < 0:
            self.slack = first_slack(self.query.limit)
        self.most = largest_slack(self.query.limit)

    @property
    def visible(self) -> list[Row]:
        return self.rows[: self.query.limit]

    def _cut(self, rows: list[Row]) -> None:
        """Keeps the window's size; what is cut off makes it a part of the table."""
        size = self.query.limit + self.slack
        if len(rows) > size:
            self.full = False
        self.rows = rows[:size]

    def hydrate(self, tables: lower.Tables) -> None:
        size = self.query.limit + self.slack
        rows = lower.scan(self.query, tables, self.query.start_after, size + 1).collect()
        self.full = True
        self._cut(rows)

    def apply(self, batch: DataFrame, tables: lower.Tables) -> None:
        """batch: changes of the root table that have passed the filter; tables: as they are after the batch."""
        query, spark = self.query, batch.sparkSession
        key, order = query.table.key, query.order
        schema = batch.schema["after"].dataType
        size = query.limit + self.slack
        # Changed rows go out, and come back if their new images belong: one plan, and only the window comes to the driver.
        if is_local(batch):  # made by the driver, so its keys are there
            gone = {r["key"] for r in batch.select("key").collect()}
            kept = frame_of(spark, [r for r in self.rows if r[key] not in gone], schema)
        else:
            held = frame_of(spark, self.rows, schema)
            ours = F.broadcast(held.select(F.col(f"`{key}`").alias("key")))
            touched = F.broadcast(batch.join(ours, "key", "left_semi").select(F.col("key").alias("touched_")))
            kept = held.join(touched, F.col(f"`{key}`") == F.col("touched_"), "left_anti")
        if self.full or self.rows:
            fresh = batch.where("after IS NOT NULL").select("after.*")
            if query.start_after is not None:
                fresh = fresh.where(ordering.after_cursor(query.start_after, order, key, schema))
            if not self.full:
                last = ordering.cursor_of(self.rows[-1], order, key)
                fresh = fresh.where(~ordering.after_cursor(last, order, key, schema))
            kept = kept.unionByName(fresh)
        kept = kept.orderBy(*ordering.order_columns(order, key)).limit(size + 1).collect()
        self._cut(kept)
        self._refill(tables)

    def _refill(self, tables: lower.Tables) -> None:
        query = self.query
        if self.full or len(self.rows) >= query.limit:
            return
        want = query.limit + self.slack - len(self.rows)
        at = ordering.cursor_of(self.rows[-1], query.order, query.table.key) if self.rows else query.start_after
        more = lower.scan(query, tables, at, want).collect()
        self.full = len(more) < want
        self.rows += more
        self.counters.window_refills += 1
        self.counters.window_rows += len(more)
        self.since_growth += 1
        if self.since_growth >= REFILLS_PER_GROWTH:
            self.slack, self.since_growth = min(self.most, max(1, self.slack * 2)), 0

    def degrade(self) -> int:
        """Gives up the slack; how many rows that sheds."""
        before = len(self.rows)
        self.slack = 0
        self._cut(self.rows)
        return before - len(self.rows)


@dataclass
class Kids:
    """The first children of one parent, in order, with all their columns.  full: there are no more."""

    rows: list[Row]
    full: bool


@dataclass
class ChildWindows:
    """The windows of one relation, by the parent's key.  Children with children of their own are held as they are shown."""

    child: Child
    slack: int = -1
    held: dict[Any, Kids] = field(default_factory=dict)
    since_growth: int = 0

    def __post_init__(self):
        self.limit = self.child.query.limit
        self.plain = not self.child.query.children
        if self.slack < 0:
            self.slack = first_slack(self.limit)

    @property
    def read(self) -> Child:
        """What is read of the table: one row more than the window holds tells whether there are more."""
        query = self.child.query
        return replace(self.child, query=replace(query, select=None, limit=self.limit + self.slack + 1)) if self.plain else self.child

    def take(self, key: Any, rows: list[Row]) -> None:
        size = self.limit + self.slack
        self.held[key] = Kids(rows[:size], len(rows) <= size) if self.plain else Kids(rows, True)

    def shown(self, key: Any) -> list[Row]:
        rows = self.held[key].rows[: self.limit]
        chosen = self.child.query.select if self.plain else None
        return [Row(*chosen)(*[r[c] for c in chosen]) for r in rows] if chosen else rows

    def change(self, batch: DataFrame, parents: Mapping[Any, list]) -> set:
        """Takes a batch of the driver's rows into the windows of parents, keys by the value that children name; returns the keys whose windows are short."""
        query, fk = self.child.query, self.child.relation.child_column
        key, schema = query.table.key, batch.schema["after"].dataType
        changes = deltas.filter_changes(batch, query.where, query.params).collect()
        gone = {r["key"] for r in changes}
        fresh: dict[Any, list[Row]] = {}
        for r in changes:
            for image, comes in ((r["before"], False), (r["after"], True)):
                if image is not None and image[fk] in parents:
                    fresh.setdefault(image[fk], []).extend([image] if comes else [])
        now: dict[Any, list[Row]] = {}
        rows: list[tuple] = []
        keys: list = []
        for link, more in fresh.items():
            for k in parents[link]:
                held = self.held[k]
                now[k] = [r for r in held.rows if r[key] not in gone]
                if more:
                    rows += [(len(keys), False, *r) for r in now[k] + more]
                    # What comes behind the window's old end may come behind rows that aren't here.
                    rows += [] if held.full else [(len(keys), True, *held.rows[-1])]
                    keys.append(k)
                    now[k] = []
        if rows:
            names = schema.names
            parent, end = (lower.free_column(n, names) for n in ("parent", "end"))
            frame = frame_of(batch.sparkSession, rows, T.StructType([T.StructField(parent, T.IntegerType()), T.StructField(end, T.BooleanType()), *schema]))
            make, ended = Row(*names), set()
            for r in frame.orderBy(parent, *ordering.order_columns(query.order, key), end).collect():
                if r[end]:
                    ended.add(r[parent])
                elif r[parent] not in ended:
                    now[keys[r[parent]]].append(make(*r[2:]))
        short, size = set(), self.limit + self.slack
        for k, own in now.items():
            full = self.held[k].full and len(own) <= size
            self.held[k] = Kids(own[:size], full)
            if not full and len(own) < self.limit:
                short.add(k)
        self.since_growth += len(short)
        if self.since_growth >= REFILLS_PER_GROWTH:
            self.slack, self.since_growth = min(largest_slack(self.limit), max(1, self.slack * 2)), 0
        return short


@dataclass
class LiveList:
    """One query kept up to date: ``rows`` is the ordered answer as (key, row) pairs; ``wide`` has them with all columns, where only some are chosen."""

    query: Compiled
    slack: int = -1
    window: TopK | None = None
    rows: list[tuple[Any, tuple]] = field(default_factory=list)
    counters: Counters = field(default_factory=Counters)
    requery: bool = False
    wide: list[tuple[Any, tuple]] = field(default_factory=list)
    kids: list[ChildWindows] = field(default_factory=list)

    def __post_init__(self):
        if self.query.limit is None:
            self.requery = True  # all of it is on screen
        else:
            self.window = TopK(self.query, self.slack, counters=self.counters)
            self.kids = [ChildWindows(c, self.slack) for c in self.query.children]

    # -- answers

    def _from_scratch(self, tables: lower.Tables) -> list[tuple[Any, tuple]]:
        query = self.query
        answer = lower.top(query, tables)
        for child in query.children:
            answer = lower.attach(answer, query.limit, child, tables)
        answer = lower.ordered(query, answer)
        names = [*(query.select or query.table.columns), *(c.name for c in query.children)]
        answer = answer.select(F.col(f"`{query.table.key}`").alias("key_"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row_"))
        return [(r["key_"], tuple(r["row_"])) for r in answer.collect()]

    def _nested(self, parents: list[Row], tables: lower.Tables, spark, schema) -> dict[Any, tuple]:
        """Rows with their children, for some parents, by key."""
        if not parents:
            return {}
        frame = frame_of(spark, parents, schema)
        for kids in self.kids:
            frame = lower.attach(frame, len(parents), kids.read, tables, [r[kids.child.relation.parent_column] for r in parents])
        found, width = {}, len(schema)
        for r in frame.collect():
            key = r[self.query.table.key]
            for kids, rows in zip(self.kids, r[width:]):
                kids.take(key, rows)
                self.counters.child_rows += len(rows)
            found[key] = self._with_kids(key, tuple(r[:width]))
        self.counters.child_refills += bool(self.kids)
        return found

    def _with_kids(self, key: Any, row: tuple) -> tuple:
        return (*row, *(kids.shown(key) for kids in self.kids))

    def hydrate(self, tables: lower.Tables) -> list[tuple[Any, tuple]]:
        if self.requery:
            self.rows = self._from_scratch(tables)
            return self.rows
        self.window.hydrate(tables)
        root = tables[self.query.table.name]
        before = self.counters.child_refills, self.counters.child_rows
        found = self._nested(self.window.visible, tables, root.sparkSession, root.schema)
        self.counters.child_refills, self.counters.child_rows = before  # the first reading is no refill
        return self._show([(r[self.query.table.key], found[r[self.query.table.key]]) for r in self.window.visible])

    def _show(self, wide: list[tuple[Any, tuple]]) -> list[tuple[Any, tuple]]:
        columns = self.query.table.columns
        at = [columns.index(n) for n in self.query.select or ()]
        self.wide = wide
        self.rows = [(k, tuple(r[i] for i in at) + r[len(columns) :]) for k, r in wide] if at else wide
        return self.rows

    def touched(self, batches: Mapping[str, DataFrame]) -> bool:
        return bool(self.query.tables & set(batches))

    def apply(self, batches: Mapping[str, DataFrame], tables: lower.Tables) -> list[tuple[Any, tuple]]:
        """The answer after some batches; tables: as they are with them."""
        if not self.touched(batches):
            return self.rows
        if self.requery:
            self.rows = self._from_scratch(tables)
            return self.rows
        query = self.query
        root = tables[query.table.name]
        if query.table.name in batches:
            self.window.apply(deltas.filter_changes(batches[query.table.name], query.where, query.params), tables)
        visible, key = self.window.visible, query.table.key
        at = [root.schema.names.index(kids.child.relation.parent_column) for kids in self.kids]
        old = {k: tuple(r[i] for i in at) for k, r in self.wide}
        same = [r for r in visible if old.get(r[key]) == tuple(r[i] for i in at)]  # their children name them as before
        stale = self._parents_of_changed_children(same, batches, root) | {r[key] for r in visible} - {r[key] for r in same}
        found = self._nested([r for r in visible if r[key] in stale], tables, root.sparkSession, root.schema)
        shown = self._show([(r[key], found.get(r[key]) or self._with_kids(r[key], tuple(r))) for r in visible])
        for kids in self.kids:
            kids.held = {k: kids.held[k] for k, _ in shown}
        return shown

    def _parents_of_changed_children(self, visible: list[Row], batches: Mapping[str, DataFrame], root: DataFrame) -> set:
        """Keys of those parents whose children must be read again; the windows of the others have the changes."""
        key, out = self.query.table.key, set()
        if not visible:
            return out
        for kids in self.kids:
            child, relation = kids.child, kids.child.relation
            if (child.query.tables - {relation.child}) & set(batches):
                return {r[key] for r in visible}
            if relation.child not in batches:
                continue
            batch = batches[relation.child]
            kind = batch.schema["after"].dataType[relation.child_column].dataType
            if is_local(batch) and kind == root.schema[relation.parent_column].dataType and isinstance(kind, (T.IntegralType, T.StringType)):
                parents: dict[Any, list] = {}
                for r in visible:
                    if r[relation.parent_column] is not None:
                        parents.setdefault(r[relation.parent_column], []).append(r[key])
                if kids.plain:
                    out |= kids.change(batch, parents)
                else:
                    fks = {x for r in batch.select(f"before.`{relation.child_column}`", f"after.`{relation.child_column}`").collect() for x in r}
                    out |= {k for x in fks for k in parents.get(x, ())}
                continue
            shown = frame_of(root.sparkSession, visible, root.schema)
            own, theirs = join_keys(F.col(f"`{relation.parent_column}`"), shown.schema[relation.parent_column].dataType, F.col("fk"), kind)
            sides = batch.select(F.explode(F.array(F.col(f"before.`{relation.child_column}`"), F.col(f"after.`{relation.child_column}`"))).alias("fk")).select(theirs.alias("fk")).where("fk IS NOT NULL")
            keyed = F.broadcast(shown.select(F.col(f"`{key}`").alias("key_"), own.alias("fk")))
            out |= {r["key_"] for r in sides.join(keyed, "fk").select("key_").distinct().collect()}
        return out

    def degrade(self) -> int:
        """Gives up what can be read again; how many rows that sheds."""
        return self.window.degrade() if self.window else 0

    # -- what it consists of

    def state_report(self) -> list[tuple[str, int]]:
        """Operators, sources first, with the bytes that each holds."""
        query, out = self.query, [(f"source {self.query.table.name}", 0)]
        if not isinstance(query.where, ir.Always):
            out.append(("filter", 0))
        out.append(("top k", bytes_of(self.window.rows)) if self.window else ("requery", bytes_of(r for _, r in self.rows)))
        width = len(query.select or query.table.columns)
        for i, child in enumerate(query.children):
            kept = (x.rows for x in self.kids[i].held.values()) if self.window else (r[width + i] for _, r in self.rows)
            out += [(f"source {child.relation.child}", 0), (f"join {child.name}", sum(map(bytes_of, kept)))]
        return out + ([("project", 0)] if query.select else []) + [("view", 0)]

    def node_names(self) -> list[str]:
        return [name for name, _ in self.state_report()]

    def degrade_report(self) -> list[tuple[str, Outcome]]:
        """Gives up what can be read again; what each operator did.  Unbounded lists and children, with the slack of their windows, stay."""
        before = self.state_report()
        self.degrade()
        out = []
        for (name, had), (_, has) in zip(before, self.state_report()):
            kind = "shed" if name == "top k" else "pinned" if name == "requery" or name.startswith("join ") else "stateless"
            out.append((name, Outcome(kind, had - has)))
        return out

    @property
    def state_rows(self) -> int:
        return len(self.window.rows) if self.window else 0
