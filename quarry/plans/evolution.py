"""Changes of tables' schemas, applied when segments are read.

A table's schema has a version: one, and one more for each step of its history. A segment is written in the newest version and keeps its number, and nothing is rewritten when a step is
added: what is older is read by the schema that it was written with, and taken through the steps since then, as a projection, so filters and column pruning reach its files. A name
that was dropped and added again is another column. Keys can't change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Added:
    """A new column; older rows have the value of an SQL expression over their columns."""

    name: str
    default: str = "NULL"


@dataclass(frozen=True)
class Renamed:
    old: str
    new: str


@dataclass(frozen=True)
class Retyped:
    """A column with another type; older rows' values are cast, or made by an SQL expression."""

    name: str
    old: T.DataType
    using: str | None = None


@dataclass(frozen=True)
class Dropped:
    name: str
    kind: T.DataType


Step = Added | Renamed | Retyped | Dropped


class UnknownSchemaError(RuntimeError):
    """A segment was written by a newer program."""


def versions(newest: T.StructType, steps: list[Step]) -> list[T.StructType]:
    """The schemas of versions 1, 2 and so on, the newest last, found by going back from it."""
    out = [list(newest.fields)]
    for step in reversed(steps):
        fields = out[0]
        name = step.new if isinstance(step, Renamed) else step.name
        if (name in {f.name for f in fields}) == isinstance(step, Dropped):
            raise ValueError(f"{step} doesn't lead to a schema {'without' if isinstance(step, Dropped) else 'with'} {name}")
        if isinstance(step, Added):
            fields = [f for f in fields if f.name != name]
        elif isinstance(step, Renamed):
            fields = [T.StructField(step.old, f.dataType) if f.name == name else f for f in fields]
        elif isinstance(step, Retyped):
            fields = [T.StructField(name, step.old) if f.name == name else f for f in fields]
        else:
            fields = [*fields, T.StructField(name, step.kind)]
        out.insert(0, fields)
    return [T.StructType(fields) for fields in out]


def upgraded(rows: DataFrame, version: int, newest: T.StructType, steps: list[Step]) -> DataFrame:
    """Rows of a version's schema, with other columns beside it, as rows of the newest one; the others stay, last."""
    schemas = versions(newest, steps)
    others = [c for c in rows.columns if c not in schemas[version - 1].fieldNames()]
    for step, after in zip(steps[version - 1 :], schemas[version:], strict=True):
        changed = {}
        if isinstance(step, Added):
            changed = {step.name: F.expr(step.default)}
        elif isinstance(step, Renamed):
            changed = {step.new: F.col(step.old)}
        elif isinstance(step, Retyped):
            changed = {step.name: F.expr(step.using) if step.using else F.col(step.name)}
        rows = rows.select(*[changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col(f.name) for f in after.fields], *others)
    return rows
