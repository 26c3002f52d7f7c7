"""Declared tables: columns, one primary key, and their Spark schema."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum
from functools import cached_property

from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


class SchemaError(ValueError):
    """A table or column that is unknown, repeated or not usable as asked."""


class ColumnType(Enum):
    """Types that CREATE TABLE names; tables made from a schema may have any other type too."""

    INT = "INT"
    BIGINT = "BIGINT"
    FLOAT = "FLOAT"
    VARCHAR = "VARCHAR"

    @property
    def spark(self) -> DataType:
        return {"INT": IntegerType(), "BIGINT": LongType(), "FLOAT": DoubleType(), "VARCHAR": StringType()}[self.value]

    @staticmethod
    def of(kind: DataType) -> ColumnType | OtherType:
        for one in ColumnType:
            if one.spark == kind:
                return one
        return OtherType(kind.json())

    @staticmethod
    def named(value: str) -> ColumnType | OtherType:
        return ColumnType(value) if value in ColumnType.__members__ else OtherType(value)


@dataclass(frozen=True)
class OtherType:
    """Any other Spark type, passed through as it is; ``value`` is its JSON."""

    value: str

    @cached_property
    def spark(self) -> DataType:
        return StructType.fromJson({"type": "struct", "fields": [{"name": "v", "type": json.loads(self.value), "nullable": True, "metadata": {}}]})["v"].dataType


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: ColumnType | OtherType


@dataclass(frozen=True)
class TableDef:
    """``shards`` over 1 lays the table out by the hash of its key, so that point reads touch one part of it."""

    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: str
    table_id: int = 0
    shards: int = 1

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise SchemaError(f"table {self.name} repeats a column")
        if self.primary_key not in names:
            raise SchemaError(f"table {self.name} has no column {self.primary_key} for its primary key")

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise SchemaError(f"table {self.name} has no column {name}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> StructType:
        return StructType([StructField(c.name, c.type.spark, c.name != self.primary_key, {"primary_key": c.name == self.primary_key}) for c in self.columns])

    def to_dict(self) -> dict:
        return {"name": self.name, "columns": [[c.name, c.type.value] for c in self.columns], "primary_key": self.primary_key, "table_id": self.table_id, "shards": self.shards}

    @staticmethod
    def from_dict(d: dict) -> TableDef:
        return TableDef(d["name"], tuple(ColumnDef(n, ColumnType.named(t)) for n, t in d["columns"]), d["primary_key"], d["table_id"], d["shards"])

    @staticmethod
    def from_schema(name: str, schema: StructType, primary_key: str, shards: int = 1) -> TableDef:
        return TableDef(name, tuple(ColumnDef(f.name, ColumnType.of(f.dataType)) for f in schema), primary_key, shards=shards)


@dataclass
class Catalog:
    """Table definitions by name; ids count from 1 and are never used twice."""

    tables: dict[str, TableDef] = field(default_factory=dict)
    next_id: int = 1

    def create(self, table: TableDef) -> TableDef:
        if table.name in self.tables:
            raise SchemaError(f"table {table.name} exists")
        made = TableDef(table.name, table.columns, table.primary_key, self.next_id, table.shards)
        self.tables[table.name] = made
        self.next_id += 1
        return made

    def get(self, name: str) -> TableDef:
        if name not in self.tables:
            raise SchemaError(f"no table {name}")
        return self.tables[name]

    def by_id(self, table_id: int) -> TableDef:
        for t in self.tables.values():
            if t.table_id == table_id:
                return t
        raise SchemaError(f"no table with id {table_id}")
