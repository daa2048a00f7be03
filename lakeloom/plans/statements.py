"""What a statement says, before names are resolved."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Ref:
    """A column, with its table if the text names one."""

    table: str | None
    name: str

    @classmethod
    def of(cls, text: str) -> Ref:
        table, dot, name = text.partition(".")
        return cls(table, name) if dot and table and name else cls(None, text)

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Literal:
    value: str


@dataclass(frozen=True)
class Compare:
    op: str
    left: Ref
    right: Ref | Literal


@dataclass(frozen=True)
class Logical:
    op: str  # AND or OR
    left: Condition
    right: Condition


Condition = Compare | Logical


@dataclass(frozen=True)
class Join:
    table: str
    on: Condition


@dataclass(frozen=True)
class Select:
    columns: list[Ref] | None  # None: all
    table: str
    joins: list[Join] = field(default_factory=list)
    where: Condition | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: list[str]
    rows: list[list[str]]


@dataclass(frozen=True)
class Update:
    table: str
    sets: list[tuple[Ref, str]]
    where: Condition | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Condition | None = None


@dataclass(frozen=True)
class ForeignKey:
    name: str
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: list[str]
    primary: list[list[str]]
    uniques: list[tuple[str, str]]  # (name, column)
    keys: list[tuple[str, str]]
    foreign: list[ForeignKey]


@dataclass(frozen=True)
class Begin:
    pass


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Rollback:
    pass


@dataclass(frozen=True)
class AlterUser:
    user: str
    host: str
    password: str


@dataclass(frozen=True)
class SetVariable:
    """Accepted and without effect."""


Statement = Select | Insert | Update | Delete | CreateTable | Begin | Commit | Rollback | AlterUser | SetVariable
