"""INSERT, UPDATE and DELETE as sets of rows: matches and checks are DataFrame plans, and a change is one delta layer.

Conditions are tried on the latest committed rows and the transaction's own, after the rows' locks are held. A change is written once, as the
delta that it would stage, and keys and references are checked against what was written, by semi and anti joins; a refused statement
stages nothing, so it has no effect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom import locks
from lakeloom.catalog import TableDef
from lakeloom.errors import DuplicateKey, EngineError, ForeignKeyError
from lakeloom.plans.binder import Scope
from lakeloom.plans.statements import Condition, Delete, ForeignKey, Insert, Update
from lakeloom.sources.store import GONE, Store


@dataclass
class Work:
    """What a change needs of the transaction that makes it."""

    store: Store
    tables: dict[str, TableDef]
    current: Callable[[TableDef], DataFrame]  # latest committed rows and the transaction's own
    lock: Callable[[tuple, str], None]
    write: Callable[[TableDef, DataFrame], str]  # a delta; returns its path

    def written(self, table: TableDef, rows: DataFrame) -> tuple[str, DataFrame]:
        """The rows as a delta that is not staged yet: its path, and what it holds."""
        path = self.write(table, rows)
        return path, self.store.read_delta(table, path)

    def references_to(self, table: TableDef) -> list[tuple[TableDef, ForeignKey]]:
        return [(t, f) for t in self.tables.values() for f in t.foreign if f.parent == table.name]

    def lock_rows(self, table: TableDef, things: Iterable[tuple], mode: str) -> None:
        """Locks rows or values of a table, each with the table's intention; or the table, if they are too many."""
        things = list(things)
        if len(things) > locks.MOST_ROWS:
            self.lock((table.name,), mode)
        elif things:
            self.lock((table.name,), f"I{mode}")
            for thing in sorted(set(things)):
                self.lock((table.name, *thing), mode)


@dataclass
class Change:
    """One staged layer, how many rows the statement touched, and whether it holds rows of new keys alone."""

    path: str | None
    affected: int
    only_new: bool = False


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _missing_parent(work: Work, key: ForeignKey, values: DataFrame) -> None:
    """values: one column, `value`, of references that must be in the parent."""
    parent = work.current(work.tables[key.parent]).select(F.col(key.parent_column).alias("value"))
    lost = values.join(parent, "value", "left_anti").limit(1).collect()
    if lost:
        raise ForeignKeyError(f"cannot add or update a child row: a foreign key constraint fails (value '{lost[0].value}')")


def insert(work: Work, table: TableDef, made: Insert) -> Change:
    if not made.columns:
        raise EngineError("column names cannot be empty")
    for c in made.columns:
        if c not in table.columns:
            raise EngineError(f"column {c} not found in table {table.name}")
        if made.columns.count(c) > 1:
            raise EngineError(f"column {c} is named twice")
    for row in made.rows:
        if len(row) != len(made.columns):
            raise EngineError("number of values does not match number of columns")
    for c in table.columns:
        if c not in made.columns:
            raise EngineError(f"column {c} of table {table.name} has no value")
    at = [made.columns.index(c) for c in table.columns]
    rows = [tuple(row[k] for k in at) for row in made.rows]
    place = {c: k for k, c in enumerate(table.columns)}
    for key in (table.primary, *([c] for c in table.unique_columns())):
        found = [tuple(row[place[c]] for c in key) for row in rows]
        if len(set(found)) < len(found):
            raise DuplicateKey(f"duplicate key in table {table.name}")
    work.lock_rows(table, [("row", *row[: len(table.primary)]) for row in rows] + [("value", c, row[place[c]]) for row in rows for c in table.unique_columns()], "X")
    for key in table.foreign:
        work.lock_rows(work.tables[key.parent], [("value", key.parent_column, row[place[key.column]]) for row in rows], "S")
    new = work.store.spark.createDataFrame(rows, table.schema)
    now = work.current(table)
    for key in (table.primary, *([c] for c in table.unique_columns())):
        if some(now.join(new.select(*key), key, "left_semi")):
            raise DuplicateKey(f"duplicate key in table {table.name}")
    for key in table.foreign:
        _missing_parent(work, key, new.select(F.col(key.column).alias("value")).distinct())
    return Change(work.write(table, new.withColumn(GONE, F.lit(False))), len(rows), only_new=True)


def _matched(work: Work, table: TableDef, where: Condition | None) -> DataFrame:
    """The rows that the condition holds for, all of them locked."""
    scope = Scope((table,))
    condition = scope.condition(where) if where is not None else None

    def now() -> DataFrame:
        df = scope.named(work.current(table), 0)
        return (df if condition is None else df.filter(condition)).toDF(*table.columns)

    while True:
        number = work.store.head.number
        keys = now().select(*table.primary).limit(locks.MOST_ROWS + 1).collect()
        work.lock_rows(table, [("row", *k) for k in keys], "X")
        if work.store.head.number == number:  # else a change that was waited for may have made other rows match
            return now()


def _lock_values(work: Work, table: TableDef, column: str, rows: DataFrame) -> None:
    """Locks the values that rows take away, so that no child comes to refer to them meanwhile."""
    values = rows.select(column).distinct().limit(locks.MOST_ROWS + 1).collect()
    work.lock_rows(table, [("value", column, v[0]) for v in values], "X")


def _restrict(work: Work, child: TableDef, key: ForeignKey, leaving: DataFrame) -> None:
    """leaving: rows of the parent whose referenced value goes."""
    if some(work.current(child).join(leaving.select(F.col(key.parent_column).alias(key.column)), key.column, "left_semi")):
        raise ForeignKeyError("cannot delete or update a parent row: a foreign key constraint fails")


def _marks(table: TableDef, rows: DataFrame) -> DataFrame:
    """Marks that the rows' keys are gone."""
    rest = [c for c in table.columns if c not in table.primary]
    return rows.select(*table.primary).withColumns({**{c: F.lit(None).cast("string") for c in rest}, GONE: F.lit(True)})


def delete(work: Work, table: TableDef, made: Delete) -> Change:
    rows = _matched(work, table, made.where)
    for child, key in work.references_to(table):
        _lock_values(work, table, key.parent_column, rows)
        _restrict(work, child, key, rows)
    path, gone = work.written(table, _marks(table, rows))
    count = gone.count()
    return Change(path if count else None, count)


def update(work: Work, table: TableDef, made: Update) -> Change:
    scope = Scope((table,))
    sets: dict[str, str] = {}
    for ref, value in made.sets:
        _, column = scope.resolve(ref)
        if column in sets:
            raise EngineError(f"column {column} is set twice")
        sets[column] = value
    rows = _matched(work, table, made.where)
    uniques = [c for c in table.unique_columns() if c in sets]
    work.lock_rows(table, [("value", c, sets[c]) for c in uniques], "X")
    for key in table.foreign:
        if key.column in sets:
            work.lock_rows(work.tables[key.parent], [("value", key.parent_column, sets[key.column])], "S")
    moved = any(c in sets for c in table.primary)
    set_to = {c: F.lit(v) for c, v in sets.items()}
    if moved:  # every key that a row lands on is locked, so that no other session takes it before this one ends
        landing = rows.select(*table.primary).withColumns({c: v for c, v in set_to.items() if c in table.primary}).limit(locks.MOST_ROWS + 1).collect()
        work.lock_rows(table, [("row", *k) for k in landing], "X")
    path, written = work.written(table, rows.withColumns(set_to).withColumn(GONE, F.lit(False)))
    count = written.count()
    if not count:
        return Change(None, 0)

    # A unique column set to one value can hold it in one row; a key that moves must land on free places. Rows that aren't keys' stay
    # where they are, so what was written says which others there are.
    taken = rows if moved else written
    others = work.current(table).join(taken.select(*table.primary), table.primary, "left_anti")
    for c in uniques:
        if count > 1 or some(others.filter(F.col(c) == sets[c])):
            raise DuplicateKey(f"duplicate key in table {table.name}")
    if moved and (some(written.groupBy(*table.primary).count().filter("count > 1")) or some(others.join(written.select(*table.primary), table.primary, "left_semi"))):
        raise DuplicateKey(f"duplicate key in table {table.name}")
    for child, key in work.references_to(table):
        if key.parent_column in sets:
            leaving = rows.filter(F.col(key.parent_column) != sets[key.parent_column])
            _lock_values(work, table, key.parent_column, leaving)
            _restrict(work, child, key, leaving)
    for key in table.foreign:
        if key.column in sets and some(rows.filter(F.col(key.column) != sets[key.column])):
            _missing_parent(work, key, work.store.spark.createDataFrame([(sets[key.column],)], "value string"))
    if moved:
        gone = rows.select(*table.primary).join(written.select(*table.primary), table.primary, "left_anti")
        path = work.write(table, written.unionByName(_marks(table, gone)))
    return Change(path, count)
