"""Names to columns: resolution, the shapes that conditions may have, and DataFrame expressions for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.catalog import TableDef
from lakeloom.errors import EngineError
from lakeloom.functions.rendering import compared, equal, meeting, rendered
from lakeloom.plans.statements import Compare, Condition, Literal, Logical, Ref

OPERATORS = {"=", "!=", "<", "<=", ">", ">="}


@dataclass(frozen=True)
class Scope:
    """The tables of a statement, in the order of its text. A column's name in the DataFrame carries its table's place."""

    tables: tuple[TableDef, ...]

    def resolve(self, ref: Ref) -> tuple[int, str]:
        """Place of the table, and the column."""
        found = [k for k, t in enumerate(self.tables) if ref.name in t.columns and ref.table in (None, t.name)]
        if len(found) == 1:
            return found[0], ref.name
        if found:
            raise EngineError(f"ambiguous column name: {ref.name}")
        if len(self.tables) == 1:
            raise EngineError(f"column {ref} not found in table {self.tables[0].name}")
        raise EngineError(f"column {ref} not found in joined tables")

    def named(self, df: DataFrame, place: int) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(f"{place}.{c}") for c in self.tables[place].columns))

    def column(self, place: int, name: str) -> Column:
        return F.col(f"`{place}.{name}`")

    def text(self, place: int, name: str) -> Column:
        return rendered(self.column(place, name), self.tables[place].kind(name))

    def condition(self, made: Condition) -> Column:
        """A WHERE condition: comparisons of a column with a literal."""
        if isinstance(made, Logical):
            left, right = self.condition(made.left), self.condition(made.right)
            return left & right if made.op == "AND" else left | right
        if not isinstance(made.right, Literal):
            raise EngineError("when LHS is a column, RHS must be a literal")
        if made.op not in OPERATORS:
            raise EngineError(f"unsupported operator in WHERE clause: {made.op}")
        place, name = self.resolve(made.left)
        return compared(self.column(place, name), self.tables[place].kind(name), made.op, made.right.value)

    def equalities(self, made: Condition) -> list[tuple[tuple[int, str], tuple[int, str]]]:
        """An ON condition: equalities of two columns, all of which hold."""
        if isinstance(made, Logical):
            if made.op != "AND":
                raise EngineError("unsupported ON condition structure")
            return self.equalities(made.left) + self.equalities(made.right)
        if not isinstance(made, Compare) or not isinstance(made.right, Ref) or made.op != "=":
            raise EngineError("unsupported ON condition structure")
        return [(self.resolve(made.left), self.resolve(made.right))]

    def equality(self, one: tuple[int, str], other: tuple[int, str]) -> Column:
        return equal(self.column(*one), self.tables[one[0]].kind(one[1]), self.column(*other), self.tables[other[0]].kind(other[1]))

    def meeting(self, one: tuple[int, str], other: tuple[int, str]) -> tuple[Column, Column]:
        """Two columns of one type that are equal where equality() holds."""
        return meeting(self.column(*one), self.tables[one[0]].kind(one[1]), self.column(*other), self.tables[other[0]].kind(other[1]))
