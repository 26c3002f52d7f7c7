"""Column-against-literal comparisons as Spark columns.

The default is SQL's: typed, pushed down to the scan. Three deviations are there
for who needs them, each by name: ``tolerance`` compares floating-point columns
within a distance, ``truncate`` cuts the fraction of a literal that meets an
integer column, and text that is no number compares as false with every operator.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType, NumericType, StringType

Literal = int | float | str
OPERATORS = ("=", "<>", "!=", "<", "<=", ">", ">=")
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: Literal

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")


@dataclass(frozen=True)
class Comparison:
    """How to compare; the defaults are standard SQL."""

    tolerance: float | None = None
    truncate: bool = False


STANDARD = Comparison()


def compare(left: Column, op: str, right: Column) -> Column:
    match op:
        case "=":
            return left == right
        case "<>" | "!=":
            return left != right
        case "<":
            return left < right
        case "<=":
            return left <= right
        case ">":
            return left > right
        case _:
            return left >= right


def compare_within(left: Column, op: str, right: Column, distance: float) -> Column:
    """Values closer than ``distance`` are equal; strict comparisons need more than that."""
    eps = F.lit(distance)
    match op:
        case "=":
            return F.abs(left - right) < eps
        case "<>" | "!=":
            return F.abs(left - right) >= eps
        case "<":
            return left < right - eps
        case "<=":
            return left <= right + eps
        case ">":
            return left > right + eps
        case _:
            return left >= right - eps


def number_in(text: Column) -> Column:
    """The number that text is, or null; never an error."""
    return text.try_cast("double")


def leading_number(text: Column) -> Column:
    """The number that text begins with, or null: ``12abc`` gives 12."""
    return number_in(F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")))


def literal_for(value: Literal, kind: DataType, how: Comparison) -> Column:
    """The literal as it meets a column of type ``kind``."""
    if isinstance(kind, StringType):
        return F.lit(value if isinstance(value, str) else str(value))
    if isinstance(kind, NumericType) and isinstance(value, str):
        return number_in(F.lit(value))
    if isinstance(kind, IntegralType) and isinstance(value, float) and how.truncate:
        return F.lit(int(value))
    return F.lit(value)


def condition(column: Column, kind: DataType, op: str, value: Literal, how: Comparison = STANDARD) -> Column:
    right = literal_for(value, kind, how)
    if how.tolerance is not None and isinstance(kind, (DoubleType, FloatType)):
        return compare_within(column, op, right, how.tolerance)
    return compare(column, op, right)


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
