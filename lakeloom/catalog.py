"""Definitions of tables, their validation, and the folder that keeps them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from lakeloom.errors import EngineError
from lakeloom.plans.statements import CreateTable, ForeignKey


@dataclass(frozen=True)
class TableDef:
    """A table. A managed one has text columns and keys; an external one, columns of any rendered type and no keys."""

    name: str
    columns: list[str]
    primary: list[str] = field(default_factory=list)
    uniques: list[tuple[str, str]] = field(default_factory=list)
    keys: list[tuple[str, str]] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    kinds: dict[str, T.DataType] | None = None  # of an external table

    @property
    def external(self) -> bool:
        return self.kinds is not None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.columns])

    def kind(self, column: str) -> T.DataType:
        return self.kinds[column] if self.kinds else T.StringType()

    def unique_columns(self) -> list[str]:
        return [c for _, c in self.uniques]

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "kinds"})

    @classmethod
    def from_json(cls, text: str) -> TableDef:
        x = json.loads(text)
        return cls(x["name"], x["columns"], x["primary"], [tuple(u) for u in x["uniques"]], [tuple(k) for k in x["keys"]], [ForeignKey(**f) for f in x["foreign"]])


def defined(made: CreateTable, tables: dict[str, TableDef]) -> TableDef:
    """The table that a CREATE TABLE makes beside these, or the error that it ends with."""
    if made.name in tables:
        raise EngineError(f"table {made.name} already exists")
    columns = made.columns
    if not columns:
        raise EngineError("table must have at least one column")
    for c in columns:
        if columns.count(c) > 1:
            raise EngineError(f"duplicate column name: {c}")
    if not made.primary:
        raise EngineError("primary key is required")
    if len(made.primary) > 1:
        raise EngineError("multiple primary keys defined")
    primary = made.primary[0]
    if not primary:
        raise EngineError("primary key must have at least one column")
    if len(primary) > len(columns):
        raise EngineError("primary key columns exceed total columns")
    for c in primary:
        if c not in columns:
            raise EngineError(f"primary key column '{c}' does not exist")
    if primary != columns[: len(primary)]:
        raise EngineError("primary key columns must be defined in order starting from the first column")
    names, indexed = set(), set()
    for kind, entries in (("unique key", made.uniques), ("key", made.keys)):
        for name, c in entries:
            if c not in columns:
                raise EngineError(f"{kind} column '{c}' does not exist")
            if name in names:
                raise EngineError(f"duplicate index name: {name}")
            if c in indexed:
                raise EngineError(f"column '{c}' cannot have multiple indexes")
            names.add(name)
            indexed.add(c)
    taken = {f.name for t in tables.values() for f in t.foreign}
    for f in made.foreign:
        if f.name in taken:
            raise EngineError(f"duplicate foreign key constraint name: '{f.name}'")
        if f.name in names:
            raise EngineError(f"duplicate constraint name: '{f.name}'")
        taken.add(f.name)
        if f.column not in columns:
            raise EngineError(f"foreign key column '{f.column}' does not exist")
        if f.parent == made.name:
            raise EngineError("self-referencing foreign key is not supported")
        parent = tables.get(f.parent)
        if parent is None:
            raise EngineError(f"referenced table '{f.parent}' does not exist")
        if f.parent_column not in parent.columns:
            raise EngineError(f"referenced column '{f.parent_column}' does not exist in table '{f.parent}'")
        if f.parent_column not in parent.primary and f.parent_column not in parent.unique_columns():
            raise EngineError(f"referenced column '{f.parent_column}' in table '{f.parent}' must be a primary key or have a unique index")
        if f.column not in indexed:
            raise EngineError(f"foreign key column '{f.column}' must have an index")
    return TableDef(made.name, columns, primary, made.uniques, made.keys, made.foreign)
