"""Joins that make far more rows than they read.

Spark cuts a join into tasks by the bytes that it reads and by its keys. Where few values are shared by many rows on both sides, the result
is the product of their rows: a few megabytes then make billions of rows in a handful of tasks, which more machines do not shorten. Such a
join is cut by its result: each value's product becomes a grid of cells, the rows of either side are dealt to its rows or columns by their
hash, and are repeated for the cells across. A pair meets in one cell only, so the rows are those of the plain join.

Which joins these are is measured, as a statement is made: rows and distinct values of the columns that meet, read alone, in one job for
the smaller side of each join; the other side is read for it only if values repeat there. Declared keys need no measuring; joins of streams
are left to Spark. What is measured are means: one value with most of the rows, among others that hardly repeat, isn't found.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.catalog import TableDef

ROWS = 4_000_000  # of a result that a task makes
CELLS = 4  # a task's rows are some cells, so that tasks are about even
TIMES = 16  # a result of fewer rows for each row read is left to Spark
REPEATED = 2  # rows a value, under which columns count as unique
MOST_PARTS = 32_768

Side = tuple[int, tuple[str, ...]]  # a table's place, and columns of it
Ties = list[tuple[tuple[int, str], tuple[int, str]]]  # equal columns, the joining table's second


class Measured:
    """Rows with a value, and distinct values, of the columns that a statement's tables are joined by."""

    def __init__(self, tables: tuple[TableDef, ...], frames: list[DataFrame]):
        """frames: each table's rows that the statement asks for, their columns named as the scope names them."""
        self.tables, self.frames, self.found, self.sizes = tables, frames, {}, {}

    def declared(self, side: Side) -> bool:
        """Whether a key says that no value stands twice."""
        table, columns = self.tables[side[0]], set(side[1])
        return bool(table.primary) and set(table.primary) <= columns or bool(columns & set(table.unique_columns()))

    def bytes(self, place: int) -> int:
        """Catalyst's estimate, which reads nothing."""
        if place not in self.sizes:
            self.sizes[place] = int(str(self.frames[place]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return self.sizes[place]

    def measure(self, wanted: list[Side]) -> None:
        """One scan and one small shuffle for all that isn't known."""
        if not (sides := list(dict.fromkeys(s for s in wanted if s not in self.found))):
            return
        parts = []
        for k, (place, columns) in enumerate(sides):
            values = [F.col(f"`{place}.{c}`") for c in columns]
            known = reduce(lambda a, b: a & b, (v.isNotNull() for v in values))
            parts.append(self.frames[place].filter(known).select(F.lit(k).alias("side"), F.xxhash64(*values).alias("value")))
        counts = reduce(DataFrame.union, parts).groupBy("side").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("value").alias("distinct"))
        self.found |= {s: (0, 1) for s in sides} | {sides[r["side"]]: (r["rows"], max(1, min(r["rows"], r["distinct"]))) for r in counts.collect()}

    def rows(self, side: Side) -> int:
        self.measure([side])
        return self.found[side][0]

    def repeated(self, side: Side) -> float:
        """Rows a value, on average."""
        self.measure([side])
        rows, distinct = self.found[side]
        return max(1.0, rows / distinct)

    def unique(self, side: Side) -> bool:
        return self.declared(side) or self.repeated(side) < REPEATED


@dataclass(frozen=True)
class Sizes:
    """Rows that a join makes, and rows a value on either side."""

    made: float
    left: float
    right: float


def sizes(measured: Measured, steps: list[tuple[int, Ties]]) -> list[Sizes | None]:
    """For each step of a left-deep join, which starts with table 0: its sizes if its rows are to be spread."""
    if any(f.isStreaming for f in measured.frames):
        return [None] * len(steps)
    sides: list[tuple[Side, Side | None]] = []
    for place, ties in steps:
        others = {a[0] for a, _ in ties}
        sides.append(((place, tuple(sorted({b[1] for _, b in ties}))), (others.pop(), tuple(sorted({a[1] for a, _ in ties}))) if len(others) == 1 else None))
    smaller = [min((s for s in both if s), key=lambda s: measured.bytes(s[0])) for both in sides]
    if wanted := [s for s in smaller if not measured.declared(s)]:
        measured.measure(wanted)
    # of the rows joined so far: the table of which none stands twice and by what it is measured, or how many they are
    whole: Side | None = sides[0][1] if sides else None
    rows, found = 0.0, []
    for own, other in sides:
        found.append(None)
        lone = whole is not None and other is not None and whole[0] == other[0]
        if not lone or measured.bytes(own[0]) <= measured.bytes(other[0]):
            if measured.unique(own):
                continue  # as many rows as before, or fewer
        if lone and measured.unique(other):
            whole = own
            continue
        if lone and measured.unique(own):
            continue
        if other is None:  # nothing is known of several tables' columns together
            continue
        left = max(measured.rows(whole) if whole else rows, measured.rows(other))
        right = measured.rows(own)
        repeated = left * measured.repeated(other) / max(1, measured.rows(other)), measured.repeated(own)
        rows, whole = left * right / max(1.0, left / repeated[0], right / repeated[1]), None
        if rows >= 2 * ROWS and rows >= TIMES * (left + right):
            found[-1] = Sizes(rows, *repeated)
    return found


def spread_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], size: Sizes) -> DataFrame:
    """The inner join by equal keys, in as many tasks as its rows need. Only how many these are comes from the sizes."""
    parts = min(MOST_PARTS, max(2, ceil(size.made / ROWS)))
    cells = max(1, ceil(CELLS * size.left * size.right / ROWS))
    down = min(cells, max(1, round(sqrt(cells * size.left / size.right))))
    across = ceil(cells / down)

    def one_of(df: DataFrame, n: int) -> Column:
        """By the row's hash and not by chance, so that a task that runs again deals it as before."""
        return F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(n)).cast("int")

    def each_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(df: DataFrame, side: int, at: dict[str, Column]) -> DataFrame:
        df = df.filter(reduce(lambda a, b: a & b, (pair[side].isNotNull() for pair in keys)))
        return df.select("*", *(c.alias(f"{side}{name}") for name, c in at.items())).repartition(parts, *(f"{side}{name}" for name in at))

    one, other = ({f"key{k}": pair[side] for k, pair in enumerate(keys)} for side in (0, 1))
    if down > 1:  # a constant would be optimised away, and with it the partitions that the join can use
        one["row"], other["row"] = one_of(left, down), each_of(down)
    if across > 1:
        one["column"], other["column"] = each_of(across), one_of(right, across)
    meet = reduce(lambda a, b: a & b, (F.col(f"0{name}") == F.col(f"1{name}") for name in one))
    # merged, as a value with far more rows than the mean then spills rather than fill a hash table
    return dealt(left, 0, one).hint("merge").join(dealt(right, 1, other), meet, "inner").select(*(F.col(f"`{c}`") for c in (*left.columns, *right.columns)))
