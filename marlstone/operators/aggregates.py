"""Whole-input aggregates: one output row, zero instead of null over nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from marlstone.functions.predicates import number_in

KINDS = ("count", "sum", "min", "max")


@dataclass(frozen=True)
class Aggregate:
    """``column`` None is ``*``, which only count takes."""

    kind: str
    column: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown aggregate {self.kind}")
        if self.column is None and self.kind != "count":
            raise ValueError(f"{self.kind}(*) has no meaning")


def count_star() -> Column:
    return F.count(F.lit(1))


def count_present(column: Column, kind: DataType) -> Column:
    """Text counts unless empty or null, anything else unless null."""
    return F.count(F.when(F.length(column) > 0, F.lit(1))) if isinstance(kind, StringType) else F.count(column)


def numeric(kind: str, column: Column, type_: DataType) -> Column:
    """sum, min or max with 0 over nothing; text takes part as far as it is numeric."""
    value = number_in(column) if isinstance(type_, StringType) else column
    out = {"sum": F.sum, "min": F.min, "max": F.max}[kind](value)
    return F.coalesce(out, F.lit(0).cast("long" if kind == "sum" and isinstance(type_, IntegralType) else "double" if isinstance(type_, StringType) else type_))


def first_by(column: Column, order: Column, descending: bool = False) -> Column:
    """The column's value in the first row of an order: a minimum that is merged in parts, not a sort."""
    return F.max_by(column, order) if descending else F.min_by(column, order)
