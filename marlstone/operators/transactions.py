"""Optimistic transactions over a store.

A transaction reads one snapshot with its own writes on top, inserts included. Its
commit is refused if a key it read, found or not, has a newer version; reading a
table whole counts as reading all keys, so phantoms are seen. Checks and commits
are serialised by the manifest chain. Blind writes don't conflict: the last wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources.catalog import SchemaError, TableDef
from marlstone.sources.store import Files, Manifest, ManifestTaken, Store
from marlstone.sources.versions import latest, overlay, versions

#: Inserted rows in one expression of a plan.
LITERALS = 256


class Conflict(RuntimeError):
    """Something this transaction read was changed by another."""


@dataclass
class Buffer:
    """Written versions in order; ``_commit_ts`` holds the number of the write until the commit.

    Rows given as values wait in a list and become one table when the buffer is read,
    so a plan does not grow with the number of single inserts.
    """

    rows: DataFrame | None = None
    writes: int = 0
    waiting: list[tuple] = field(default_factory=list)


@dataclass
class Transaction:
    store: Store
    manifest: Manifest
    buffers: dict[str, Buffer] = field(default_factory=dict)
    keys_read: dict[str, list[DataFrame]] = field(default_factory=dict)
    tables_read: set[str] = field(default_factory=set)
    created: list[TableDef] = field(default_factory=list)
    open: bool = True

    @staticmethod
    def begin(store: Store) -> Transaction:
        return Transaction(store, store.manifest())

    @property
    def snapshot_ts(self) -> int:
        return self.manifest.clock

    def table(self, name: str) -> TableDef:
        return self.manifest.catalog.get(name)

    def create_table(self, table: TableDef) -> TableDef:
        """Seen by this transaction only until it commits; refused then if another has made a table of this name."""
        self._check_open()
        made = self.manifest.catalog.create(table)
        self.manifest.files[made.name] = Files()
        self.created.append(table)
        return made

    def _written(self, name: str) -> DataFrame | None:
        """All versions in the buffer."""
        buffer = self.buffers.get(name)
        if buffer is None:
            return None
        if buffer.waiting:
            table = self.table(name)
            kinds = {c.name: c.type.spark for c in table.columns}
            rows = []
            for at in range(0, len(buffer.waiting), LITERALS):
                some = [F.struct(*[F.lit(v).cast(k).alias(n) for (n, k), v in zip(kinds.items(), values)], F.lit(number).cast("long").alias("_commit_ts")) for *values, number in buffer.waiting[at : at + LITERALS]]
                rows.append(self.store.spark.range(1).select(F.inline(F.array(*some))))
            made = versions(reduce(DataFrame.unionByName, rows), table.primary_key, F.col("_commit_ts"))
            buffer.rows = made if buffer.rows is None else buffer.rows.unionByName(made)
            buffer.waiting = []
        return buffer.rows

    def _log(self, name: str, key: str | None = None) -> DataFrame:
        base = self.store.snapshot_log(name, self.manifest, key=key)
        written = self._written(name)
        if written is None:
            return base
        mine = written if key is None else written.where(F.col("_pk") == key)
        return overlay(base, latest(mine).select(*base.columns))

    def scan(self, name: str) -> DataFrame:
        """The whole table as this transaction sees it."""
        self._check_open()
        self.tables_read.add(name)
        return self._log(name).select(*self.table(name).names)

    def get(self, name: str, key) -> DataFrame:
        """No row or one."""
        self._check_open()
        text = str(key)
        self._read_keys(name, self.store.spark.range(1).select(F.lit(text).alias("_pk")))
        return self._log(name, text).select(*self.table(name).names)

    def _read_keys(self, name: str, keys: DataFrame) -> None:
        self.keys_read.setdefault(name, []).append(keys)

    def _write(self, name: str, rows: DataFrame, deleted: bool) -> int:
        """Buffer rows as versions. They are computed and written once, so later reads and the commit plan no more than a scan. Returns how many there are."""
        table = self.table(name)
        self._written(name)  # rows that wait come before
        buffer = self.buffers.setdefault(name, Buffer())
        path = self.store.stage(versions(rows.select(*table.names), table.primary_key, buffer.writes + 1, deleted))
        made = self.store.read_staged(table, path)
        found = made.count()
        if found:
            buffer.writes += 1
            buffer.rows = made if buffer.rows is None else buffer.rows.unionByName(made)
        return found

    def insert(self, name: str, values: dict) -> int:
        """Insert or overwrite one row; all columns are needed and no others."""
        self._check_open()
        table = self.table(name)
        unknown, missing = set(values) - set(table.names), set(table.names) - set(values)
        if unknown or missing:
            raise SchemaError(f"insert into {name}: " + "; ".join(f"{w} {', '.join(sorted(s))}" for w, s in (("unknown columns", unknown), ("no value for", missing)) if s))
        if values[table.primary_key] is None:
            raise SchemaError(f"insert into {name}: the key is null")
        buffer = self.buffers.setdefault(name, Buffer())
        buffer.writes += 1
        buffer.waiting.append((*(values[c.name] for c in table.columns), buffer.writes))
        return 1

    def insert_rows(self, name: str, rows: DataFrame) -> None:
        """Insert or overwrite many rows; the last of rows with one key is not defined, so keys should be unique."""
        self._check_open()
        table = self.table(name)
        self._write(name, rows.select(*[F.col(c.name).cast(c.type.spark).alias(c.name) for c in table.columns]), deleted=False)

    def update(self, name: str, assignments: dict[str, Column], where: Column | None = None, key=None) -> int:
        """Set columns of matching rows, all from the rows as they were. Returns how many there were."""
        table = self.table(name)
        if table.primary_key in assignments:
            raise SchemaError(f"column {table.primary_key} is the key of {name} and can't be set")
        for column in assignments:
            table.column(column)
        hit = self._matching(name, where, key)
        return self._write(name, hit.select(*[assignments.get(c.name, F.col(c.name)).cast(c.type.spark).alias(c.name) for c in table.columns]), deleted=False)

    def delete(self, name: str, where: Column | None = None, key=None) -> int:
        return self._write(name, self._matching(name, where, key), deleted=True)

    def _matching(self, name: str, where: Column | None, key) -> DataFrame:
        rows = self.scan(name) if key is None else self.get(name, key)
        return rows if where is None else rows.where(where)

    def rollback(self) -> None:
        self._check_open()
        self.open = False
        self.buffers.clear()

    def commit(self) -> int:
        """Returns the commit's timestamp (the snapshot's, if nothing was written)."""
        self._check_open()
        self.open = False
        changed = {n: rows for n in self.buffers if (rows := self._written(n)) is not None}
        if not changed and not self.created:
            return self.snapshot_ts
        while True:
            now = self.store.manifest()
            self._validate(now)
            for table in self.created:
                if table.name in now.catalog.tables:
                    raise Conflict(f"table {table.name} was made by another transaction")
                now.files[now.catalog.create(table).name] = Files()
            ts = now.clock + 1
            for name, written in changed.items():
                rows = latest(written).withColumn("_commit_ts", F.lit(ts).cast("long"))
                now.files[name].deltas.append([self.store.write_files(now.catalog.get(name), rows), ts, ts])
            now.clock = ts
            try:
                self.store.publish(now)
            except ManifestTaken:
                continue
            for name in changed:
                self.store.merge_deltas(name)
            return ts

    def _validate(self, now: Manifest) -> None:
        for name in (self.tables_read | set(self.keys_read)) - {t.name for t in self.created}:
            newer = self.store.changed_since(name, now, self.snapshot_ts)
            if newer is None:
                continue
            if name in self.tables_read:
                raise Conflict(f"table {name} was read whole and has changed")
            keys = self.keys_read[name][0]
            for more in self.keys_read[name][1:]:
                keys = keys.union(more)
            if newer.join(keys, "_pk", "left_semi").limit(1).count():
                raise Conflict(f"a key of {name} that was read has changed")

    def _check_open(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction is over")
