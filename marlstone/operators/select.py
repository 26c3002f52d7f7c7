"""SELECT as one DataFrame plan: join, filter, order, limit, then aggregate or project."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.predicates import STANDARD, Comparison, Predicate, conjunction, condition
from marlstone.operators.aggregates import Aggregate, count_present, count_star, first_by, numeric
from marlstone.operators.joins import inner_join
from marlstone.sources.catalog import SchemaError


@dataclass(frozen=True)
class Join:
    table: str
    left: str
    right: str
    strategy: str = "auto"


@dataclass(frozen=True)
class Select:
    """``items`` None is ``*``. A LIMIT comes before aggregates: ``COUNT(*) ... LIMIT 7`` counts 7 rows at most."""

    table: str
    items: tuple[str | Aggregate, ...] | None = None
    join: Join | None = None
    where: tuple[Predicate, ...] = ()
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None


@dataclass
class Scope:
    """Columns in reach by table; inside a plan they are named ``table.column``."""

    tables: dict[str, DataFrame]
    types: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.types = {f"{t}.{f.name}": f.dataType for t, df in self.tables.items() for f in df.schema}

    def resolve(self, name: str) -> str:
        if "." in name:
            if name not in self.types:
                raise SchemaError(f"no column {name}")
            return name
        hits = [n for n in self.types if n.split(".", 1)[1] == name]
        if not hits:
            raise SchemaError(f"no column {name}")
        if len(hits) > 1:
            raise SchemaError(f"column {name} is ambiguous: {', '.join(hits)}")
        return hits[0]

    def col(self, name: str) -> Column:
        return F.col(f"`{self.resolve(name)}`")

    def type(self, name: str):
        return self.types[self.resolve(name)]


def qualified(name: str, df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{name}.{c}") for c in df.columns])


def output_names(names: list[str]) -> list[str]:
    """Bare names where they are unique, qualified ones where they clash; aggregates that repeat get a number."""
    bare = [n.split(".", 1)[-1] for n in names]
    out: list[str] = []
    for full, short in zip(names, bare):
        name = short if bare.count(short) == 1 else full
        turn = 2
        while name in out:
            name = f"{full}_{turn}"
            turn += 1
        out.append(name)
    return out


def join_sides(spec: Join, scope: Scope, left: str) -> tuple[str, str]:
    """The join's columns as left and right, in whichever order they were written."""
    def side(name: str, table: str) -> bool:
        return name.split(".")[0] == table if "." in name else f"{table}.{name}" in scope.types

    a, b = spec.left, spec.right
    if side(a, left) and side(b, spec.table):
        pass
    elif side(b, left) and side(a, spec.table):
        a, b = b, a
    else:
        raise SchemaError(f"join columns {a} and {b} don't name one column of {left} and one of {spec.table}")
    names = tuple(n if "." in n else f"{t}.{n}" for n, t in ((a, left), (b, spec.table)))
    for n in names:
        scope.resolve(n)
    return names


def run(
    spec: Select, tables: dict[str, DataFrame], *, primary_keys: dict[str, str] | None = None, comparison: Comparison = STANDARD, text_order: bool = False, implicit_order: bool = False
) -> DataFrame:
    """The plan of ``spec`` over ``tables``.

    ``primary_keys`` names each table's key; rows that a LIMIT takes without ORDER BY,
    and all rows with ``implicit_order``, follow the text of the left table's key.
    ``text_order`` sorts ORDER BY by text. Ties follow the key's text too.
    """
    keys = primary_keys or {}
    scope = Scope({t: tables[t] for t in ([spec.table] + ([spec.join.table] if spec.join else []))})
    df = qualified(spec.table, tables[spec.table])
    if spec.join:
        if spec.join.table == spec.table:
            raise SchemaError("a table can't be joined with itself: there are no aliases")
        left, right = join_sides(spec.join, scope, spec.table)
        df = inner_join(df, qualified(spec.join.table, tables[spec.join.table]), f"`{left}`", f"`{right}`", spec.join.strategy)
    if spec.where:
        df = df.where(conjunction([condition(scope.col(p.column), scope.type(p.column), p.op, p.value, comparison) for p in spec.where]))
    ties = [F.col(f"`{t}.{keys[t]}`").cast("string") for t in scope.tables if t in keys]
    order: list[Column] = []
    if spec.order_by:
        by = scope.col(spec.order_by)
        by = by.cast("string") if text_order else by
        order = [by.desc() if spec.descending else by.asc(), *ties]
    elif spec.limit is not None or implicit_order:
        order = ties
    aggregates = [i for i in spec.items or () if isinstance(i, Aggregate)]
    if order and (not aggregates or spec.limit is not None):
        df = df.orderBy(*order)
    if spec.limit is not None:
        df = df.limit(spec.limit)
    if aggregates:
        return aggregate(df, spec, scope, ties, text_order)
    names = list(scope.types) if spec.items is None else [scope.resolve(i) for i in spec.items]
    return df.select(*[F.col(f"`{n}`").alias(out) for n, out in zip(names, output_names(names))])


def aggregate(df: DataFrame, spec: Select, scope: Scope, ties: list[Column], text_order: bool) -> DataFrame:
    """Bare columns beside aggregates come first and have the values of the first row in order."""
    bare = [i for i in spec.items if not isinstance(i, Aggregate)]
    columns, names = [], []
    if bare:
        if spec.order_by:
            by = scope.col(spec.order_by)
            keys = [by.cast("string") if text_order else by] + ([] if spec.descending else ties)
        else:
            keys = ties
        if not keys:
            raise SchemaError("a column beside an aggregate needs an order or a primary key")
        for name in bare:
            columns.append(first_by(scope.col(name), F.struct(*keys), spec.descending and bool(spec.order_by)))
            names.append(scope.resolve(name))
    for item in spec.items:
        if isinstance(item, Aggregate):
            if item.column is None:
                columns.append(count_star())
            elif item.kind == "count":
                columns.append(count_present(scope.col(item.column), scope.type(item.column)))
            else:
                columns.append(numeric(item.kind, scope.col(item.column), scope.type(item.column)))
            names.append(item.kind)
    return df.agg(*[c.alias(out) for c, out in zip(columns, output_names(names))])
