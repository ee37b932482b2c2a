"""Versioned tables in a folder: for each a base, and the changes since.

A transaction adds one small set of files for each table that it changes, and
then one manifest for the whole database: its version, what every table
consists of, which mutations have been applied, and how far each stream has
come.  Manifests are numbered, written beside their place and put there whole
by a rename, and the highest number counts: a crash at any point leaves the
transaction before it or the transaction itself, with all its tables, never a
part.  Nothing is overwritten.

A read lays the changes over the base.  Many sets of changes are merged into
one, which costs what they hold; only when they have grown to a share of the
base is that rewritten.  The last few manifests, and the files they name, stay
for readers that still use them; older ones are removed, some at a time.

Bases are in ranges of the key, and have filters for the columns that relations
look rows up by, so that a read of some keys or some parents' rows skips files.

Folders may be in any store Spark can reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..functions import ordering, predicates
from ..operators import deltas
from ..plans import ir
from ..schema import Catalog, Table
from .checkpoints import settle
from .local import is_local

#: Sets of changes that are laid over a base at most before they are merged into one.
MOST_CHANGES = 16
#: The share of the base's bytes, and the bytes, from which on changes are merged into a new base.
SHARE, LEAST_BYTES = 0.25, 1 << 20
#: Manifests that are kept, and with them the files they name.
KEPT = 8


class SnapshotStore:
    """The tables of a catalog, in a folder, or in memory if there is none."""

    def __init__(self, spark: SparkSession, catalog: Catalog, path: str | None = None, most_changes: int = MOST_CHANGES):
        self.spark, self.catalog, self.path, self.most_changes = spark, catalog, path, most_changes
        self._frames: dict[str, DataFrame] = {}
        self._parts: dict[str, list[DataFrame]] = {}
        self._rows: dict[str, int] = {}  # of bases in memory
        self._number, self._state = self._latest()

    # -- manifests

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def text(self, path: str) -> str | None:
        """What a small file says; None if there is none."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_commits")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, number: int) -> str:
        return f"{self.path}/_commits/{number:020d}.json"

    def _read_manifest(self, number: int) -> dict:
        return json.loads(self.text(self._manifest(number)))

    def _latest(self) -> tuple[int, dict]:
        numbers = self._numbers() if self.path is not None else []
        if not numbers:
            return 0, {"version": 0, "tables": {}, "applied": {}, "streams": {}}
        return numbers[-1], self._read_manifest(numbers[-1])

    def _commit(self, state: dict) -> None:
        """The state becomes the database's; the only step that anyone sees."""
        if self.path is None:
            self._state = state
            return
        number = self._number + 1
        fs, draft = self._fs(f"{self._manifest(number)}.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        _, place = self._fs(self._manifest(number))
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise StoreError(f"commit {number} has been made by another writer; open the database again")
        self._number, self._state = number, state
        self._remove_old()

    def _files(self, state: dict) -> set[str]:
        return {p for t in state["tables"].values() for p in [t["base"], *(x[0] for x in t["changes"])] if p}

    def _remove_old(self) -> None:
        """Manifests beyond the kept ones, and the files that only they name."""
        numbers = self._numbers()
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        if len(old) < KEPT:  # not at each commit
            return
        used = set().union(*(self._files(self._read_manifest(n)) for n in kept[:1]), self._files(self._state))
        for n in old:
            # A file that a kept manifest names is named by the oldest kept one, or was made after it.
            for path in self._files(self._read_manifest(n)) - used:
                fs, p = self._fs(path)
                fs.delete(p, True)
            fs, p = self._fs(self._manifest(n))
            fs.delete(p, False)

    def _bytes(self, path: str) -> int:
        fs, p = self._fs(path)
        return fs.getContentSummary(p).getLength()

    # -- what has been done

    @property
    def database_version(self) -> int:
        """Transactions so far."""
        return self._state["version"]

    def version(self, name: str) -> int:
        """The transaction that changed a table last."""
        return self._state["tables"].get(name, {}).get("version", 0)

    def has_applied(self, mutation_id: tuple[str, int]) -> bool:
        client, number = mutation_id
        return any(a <= number <= b for a, b in self._state["applied"].get(client, ()))

    def stream_at(self, stream: str) -> int:
        """The last micro-batch of a stream that has been applied; -1 if none has."""
        return self._state["streams"].get(stream, -1)

    # -- reading

    def _empty(self, table: Table) -> DataFrame:
        return self.spark.createDataFrame([], table.schema)

    def _changes(self, table: Table) -> DataFrame | None:
        if self.path is None:
            parts = self._parts.get(table.name, [])
            return reduce(DataFrame.unionByName, parts) if parts else None
        paths = [x[0] for x in self._state["tables"].get(table.name, {"changes": []})["changes"]]
        layout = deltas.schema(table.schema, table.key).add("version", "long")
        return self.spark.read.schema(layout).parquet(*paths) if paths else None

    def _base(self, table: Table) -> DataFrame:
        if self.path is None:
            return self._frames.get(table.name, self._empty(table))
        base = self._state["tables"].get(table.name, {"base": None})["base"]
        return self.spark.read.schema(table.schema).parquet(base) if base else self._empty(table)

    def read(self, name: str) -> DataFrame:
        """The table as it is now."""
        table = self.catalog.table(name)
        base, changes = self._base(table), self._changes(table)
        if changes is None:
            return base
        # The last image of every changed key counts, also of one that came back to what it was.
        last = changes.groupBy("key").agg(F.max_by(F.struct("after"), "version").alias("x")).select("key", F.col("x.after").alias("after"))
        kept = base.join(last.select(F.col("key").alias("changed_")), F.col(f"`{table.key}`") == F.col("changed_"), "left_anti")
        return kept.unionByName(last.where("after IS NOT NULL").select("after.*"))

    def lookup(self, name: str, keys: list) -> dict:
        """The rows of some keys: those of the base, with the changes of these keys laid over them here."""
        if not keys:
            return {}
        table = self.catalog.table(name)
        found = {r[table.key]: r for r in self._base(table).where(F.col(f"`{table.key}`").isin(list(keys))).collect()}
        changes = self._changes(table)
        if changes is not None:
            for r in sorted(changes.where(F.col("key").isin(list(keys))).select("key", "after", "version").collect(), key=lambda r: r["version"]):
                found[r["key"]] = r["after"]
        return {k: r for k, r in found.items() if r is not None}

    def dump(self, name: str) -> DataFrame:
        """The whole table in key order."""
        return self.read(name).orderBy(F.col(f"`{self.catalog.table(name).key}`").asc_nulls_first())

    def scan(self, name: str, order: tuple[ir.Order, ...] = (), after: ir.Cursor | None = None, where: ir.Predicate | None = None, params: tuple = (), limit: int | None = None) -> DataFrame:
        """Filtered rows after a place, in order; limit None for all, 0 for none."""
        table, rows = self.catalog.table(name), self.read(name)
        if where is not None:
            rows = rows.where(predicates.lower(where, rows.schema, params))
        if after is not None:
            rows = rows.where(ordering.after_cursor(after, order, table.key, rows.schema))
        rows = rows.orderBy(*ordering.order_columns(order, table.key))
        return rows if limit is None else rows.limit(limit)

    # -- writing

    def _fresh(self, name: str, what: str) -> str:
        return f"{self.path}/{name}/{what}-{self._number + 1}-{uuid.uuid4().hex[:8]}"

    def _write_base(self, table: Table, rows: DataFrame) -> dict:
        path = self._fresh(table.name, "base")
        writer = rows.repartitionByRange(F.col(f"`{table.key}`")).sortWithinPartitions(f"`{table.key}`").write
        for relation in self.catalog.relations.values():
            if relation.child == table.name and relation.child_column != table.key:
                writer = writer.option(f"parquet.bloom.filter.enabled#{relation.child_column}", "true")
        writer.parquet(path)
        return {"base": path, "bytes": self._bytes(path), "changes": []}

    def _with_table(self, name: str, **what) -> dict:
        old = self._state["tables"].get(name, {"version": 0, "base": None, "bytes": 0, "changes": []})
        return {**self._state, "tables": {**self._state["tables"], name: {**old, **what}}}

    def load(self, name: str, rows: DataFrame) -> None:
        """Replaces the whole table."""
        table = self.catalog.table(name)
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema])
        if self.path is None:
            self._frames[name], self._parts[name] = rows, []
            self._rows.pop(name, None)
        else:
            self._commit(self._with_table(name, **self._write_base(table, rows)))

    def transact(self, batches: Mapping[str, DataFrame], mutation_id: tuple[str, int] | None = None, stream: tuple[str, int] | None = None) -> int:
        """Adds a batch to each table, all of them or none: upserts after-images, deletes the keys without.  Returns the version, which a transaction without batches doesn't change."""
        version = self.database_version + bool(batches)
        state = {**self._state, "version": version, "tables": dict(self._state["tables"])}
        for name, batch in batches.items():
            numbered = batch.withColumn("version", F.lit(version).cast("long"))
            old = self._state["tables"].get(name, {"base": None, "bytes": 0, "changes": []})
            added = []
            if self.path is None:
                self._parts.setdefault(name, []).append(numbered if is_local(numbered) else settle(numbered))
            else:
                path = self._fresh(name, "changes")
                numbered.write.parquet(path)
                added = [[path, self._bytes(path)]]
            state["tables"][name] = {**old, "version": version, "changes": [*old["changes"], *added]}
        if mutation_id is not None:
            client, number = mutation_id
            state["applied"] = {**state["applied"], client: _with_number(state["applied"].get(client, []), number)}
        if stream is not None:
            state["streams"] = {**state["streams"], stream[0]: stream[1]}
        self._commit(state)
        for name in batches:
            self._tidy(name)
        return version

    def apply(self, name: str, batch: DataFrame) -> None:
        """Adds a batch to one table."""
        self.transact({name: batch})

    def _tidy(self, name: str) -> None:
        if self.path is None:
            if len(self._parts[name]) > self.most_changes:
                merged = settle(self._merged(self.catalog.table(name)))
                if name not in self._rows:
                    self._rows[name] = self._base(self.catalog.table(name)).count()
                self._parts[name] = [merged]
                if merged.count() > SHARE * self._rows[name]:
                    self.compact(name)
            return
        own = self._state["tables"][name]
        if sum(x[1] for x in own["changes"]) > max(LEAST_BYTES, SHARE * own["bytes"]):
            self.compact(name)
        elif len(own["changes"]) > self.most_changes:
            self._merge_changes(name)

    def _merged(self, table: Table) -> DataFrame:
        last = self._changes(table).groupBy("key").agg(F.min_by(F.struct("before"), "version").alias("x"), F.max_by(F.struct("after"), "version").alias("y"), F.max("version").alias("version"))
        return last.select("key", F.col("x.before").alias("before"), F.col("y.after").alias("after"), "version")

    def _merge_changes(self, name: str) -> None:
        """Many sets of changes become one, with the last image of each key; the base isn't read."""
        path = self._fresh(name, "changes")
        self._merged(self.catalog.table(name)).coalesce(8).write.parquet(path)
        self._commit(self._with_table(name, changes=[[path, self._bytes(path)]]))

    def compact(self, name: str) -> None:
        """Merges the changes into a new base; readers of the old one keep their files."""
        table = self.catalog.table(name)
        if self.path is None:
            self._frames[name], self._parts[name] = settle(self.read(name)), []
            self._rows.pop(name, None)
        else:
            self._commit(self._with_table(name, **self._write_base(table, self.read(name))))


def _with_number(ranges: list[list[int]], number: int) -> list[list[int]]:
    """Ranges of numbers with one more, joined where they meet, so that a client's dense numbers stay one range."""
    out: list[list[int]] = []
    for a, b in sorted([*ranges, [number, number]]):
        if out and a <= out[-1][1] + 1:
            out[-1] = [out[-1][0], max(out[-1][1], b)]
        else:
            out.append([a, b])
    return out
