"""SELECT: scans, inner joins, filter and projection as one DataFrame, which Catalyst prunes, pushes and orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lakeloom.catalog import TableDef
from lakeloom.errors import EngineError
from lakeloom.operators.spread import Measured, sizes, spread_join
from lakeloom.plans.binder import Scope
from lakeloom.plans.statements import Condition, Logical, Ref, Select


def select(made: Select, table_of: Callable[[str], TableDef], rows_of: Callable[[TableDef], DataFrame]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The result, every value as text, and (table, column) of each of its columns.

    A result column is called by its column's name, or table__column where two columns share it (numbered if one is taken twice).
    """
    names = [made.table, *(j.table for j in made.joins)]
    for name in names:
        if names.count(name) > 1:
            raise EngineError(f"table {name} is named twice")
    scope = Scope(tuple(table_of(n) for n in names))
    refs = made.columns if made.columns is not None else [Ref(t.name, c) for t in scope.tables for c in t.columns]
    picked = [scope.resolve(r) for r in refs]
    where = scope.condition(made.where) if made.where is not None else None
    pairs = [pair for j in made.joins for pair in scope.equalities(j.on)]
    frames = [scope.named(rows_of(t), k) for k, t in enumerate(scope.tables)]
    df = _joined(scope, frames, pairs, _asked(scope, frames, made.where))
    if where is not None:
        df = df.filter(where)
    shown = [(scope.tables[k].name, c) for k, c in picked]
    plain = [c for _, c in shown]
    labels: list[str] = []
    for table, c in shown:
        label = c if plain.count(c) == 1 else f"{table}__{c}"
        labels.append(label if label not in labels else f"{label}__{len(labels)}")
    return df.select(*(scope.text(k, c).alias(label) for (k, c), label in zip(picked, labels, strict=True))), shown


def _asked(scope: Scope, frames: list[DataFrame], where: Condition | None) -> list[DataFrame]:
    """Each table's rows that a WHERE leaves by what it says of the table alone."""
    found, waiting = list(frames), [where] if where is not None else []
    while waiting:
        x = waiting.pop()
        if isinstance(x, Logical) and x.op == "AND":
            waiting += [x.left, x.right]
        elif len(places := _places(scope, x)) == 1:
            (k,) = places
            found[k] = found[k].filter(scope.condition(x))
    return found


def _places(scope: Scope, made: Condition) -> set[int]:
    return _places(scope, made.left) | _places(scope, made.right) if isinstance(made, Logical) else {scope.resolve(made.left)[0]}


def _joined(scope: Scope, frames: list[DataFrame], pairs: list[tuple[tuple[int, str], tuple[int, str]]], asked: list[DataFrame]) -> DataFrame:
    """Inner joins by all the equalities; a table joins once an equality ties it to those before. asked: the rows that count for their sizes."""
    inside, waiting, steps = {0}, list(range(1, len(frames))), []
    own = [p for p in pairs if p[0][0] == p[1][0]]
    while waiting:
        tied = next((k for k in waiting if any({a[0], b[0]} - inside == {k} and {a[0], b[0]} & inside for a, b in pairs)), None)
        if tied is None:
            raise EngineError("no valid join order: unreachable table in remaining candidates")
        steps.append((tied, [(a, b) if b[0] == tied else (b, a) for a, b in pairs if a[0] != b[0] and tied in (a[0], b[0]) and {a[0], b[0]} - {tied} <= inside]))
        inside.add(tied)
        waiting.remove(tied)
    df = frames[0]
    for (tied, ties), size in zip(steps, sizes(Measured(scope.tables, asked), steps), strict=True):
        if size:
            df = spread_join(df, frames[tied], [scope.meeting(a, b) for a, b in ties], size)
            continue
        both = scope.equality(*ties[0])
        for a, b in ties[1:]:
            both = both & scope.equality(a, b)
        df = df.join(frames[tied], both, "inner")
    for a, b in own:
        df = df.filter(scope.equality(a, b))
    return df


def union_distinct(one: DataFrame, other: DataFrame) -> DataFrame:
    """Both inputs' rows, each once."""
    return one.union(other).distinct()
