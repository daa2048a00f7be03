"""The text of typed values, and comparisons of typed columns with text that Parquet can still prune by.

Every value of the engine is text, compared byte by byte. A typed column of an external table has one rendering, used for both
comparison and output: integers in decimal, doubles with two decimals where these are all they have and else in full, timestamps to the
microsecond, strings as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_CANONICAL_STAMP = re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}")


def renderable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.FloatType, T.DoubleType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType, *INTEGERS))


def rendered(column: Column, kind: T.DataType) -> Column:
    """The column's text."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        short = column.try_cast("decimal(18,2)")  # amounts have two decimals; a number that isn't one, or is too large, has its exact text
        return F.when(short.cast(kind) == column, short.cast("string")).otherwise(column.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, STAMP)
    return column.cast("string")


def compared(column: Column, kind: T.DataType, op: str, text: str) -> Column:
    """column <op> text, by the column's text.

    Integers compared for equality and timestamps compared with a full one keep their own type, so the scan can use the condition;
    the order of integers as text is not their order as numbers, so it can't be rewritten.
    """
    bits = INTEGERS.get(type(kind))
    if bits and op in ("=", "!="):
        if re.fullmatch("0|-?[1-9][0-9]*", text) and -(1 << bits - 1) <= int(text) < 1 << bits - 1:
            return _apply(column, op, F.lit(int(text)).cast(kind))
        return F.lit(op == "!=") & column.isNotNull()
    if isinstance(kind, T.TimestampNTZType) and _CANONICAL_STAMP.fullmatch(text) and _is_stamp(text):
        return _apply(column, op, F.lit(text).cast("timestamp_ntz"))
    return _apply(rendered(column, kind), op, F.lit(text))


def _is_stamp(text: str) -> bool:
    from datetime import datetime

    try:
        datetime.strptime(text, "%Y-%m-%d %H:%M:%S.%f")
    except ValueError:
        return False
    return True


def _apply(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def equal(left: Column, left_kind: T.DataType, right: Column, right_kind: T.DataType) -> Column:
    """Equality of two columns by their texts; integers meet as numbers."""
    if type(left_kind) in INTEGERS and type(right_kind) in INTEGERS:
        return left == right
    return rendered(left, left_kind) == rendered(right, right_kind)


def meeting(left: Column, left_kind: T.DataType, right: Column, right_kind: T.DataType) -> tuple[Column, Column]:
    """What equal() compares, of one type on both sides."""
    if type(left_kind) in INTEGERS and type(right_kind) in INTEGERS:
        return left.cast("long"), right.cast("long")
    return rendered(left, left_kind), rendered(right, right_kind)
