"""Kinds, types and the laws that every bound relation carries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

TEXT, INT, FLOAT, BOOL, ROW, ARRAY = "text", "int64", "float64", "bool", "row", "array"
SCALARS = (TEXT, INT, FLOAT, BOOL)
NUMERIC = (INT, FLOAT)
SPARK = {TEXT: "string", INT: "bigint", FLOAT: "double", BOOL: "boolean"}


@dataclass(frozen=True)
class Type:
    kind: str
    nullable: bool = True
    fields: tuple[tuple[str, "Type"], ...] = ()

    def or_null(self, nullable: bool = True) -> "Type":
        return Type(self.kind, self.nullable or nullable, self.fields)


@dataclass(frozen=True)
class Column:
    name: str
    slot: int
    type: Type


@dataclass
class Expr:
    """op, operands and a value; ``free`` are all slots it reads, ``crossings`` the relations it turns into data."""

    op: str
    type: Type
    args: list["Expr"] = field(default_factory=list)
    value: Any = None
    free: frozenset[int] = frozenset()
    crossings: list["Crossing"] = field(default_factory=list)


@dataclass
class Crossing:
    kind: str
    relation: "Relation"
    id: int
    type: Type


@dataclass
class Relation:
    """``low`` and ``high`` bound the number of rows (high None: many);
    ``key`` are output slots that identify a row, None where unknown."""

    kind: str
    output: list[Column]
    inputs: list["Relation"] = field(default_factory=list)
    free: frozenset[int] = frozenset()
    produced: frozenset[int] = frozenset()
    low: int = 0
    high: int | None = None
    ordered: bool = False
    key: tuple[int, ...] | None = None
    uniques: list[tuple[int, ...]] = field(default_factory=list)
    value: Any = None


@dataclass(frozen=True)
class TableColumn:
    name: str
    kind: str
    nullable: bool = True


@dataclass(frozen=True)
class Table:
    """What the binder knows of a table; no primary key means a bag without identity."""

    name: str
    columns: tuple[TableColumn, ...]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()


@dataclass
class Query:
    root: Relation
    cardinality: str
    bindings: list[tuple[str, Any]]
