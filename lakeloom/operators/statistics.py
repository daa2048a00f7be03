"""Exact statistics of a table, its columns and its indexes, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.catalog import TableDef
from lakeloom.functions.rendering import rendered


def table_stats(table: TableDef, rows: DataFrame) -> DataFrame:
    """(table_name, row_count)"""
    return rows.agg(F.count("*").alias("row_count")).select(F.lit(table.name).alias("table_name"), "row_count")


def _by_value(table: TableDef, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(k, value, rows) of each of the columns' texts: one pass, in which a task first adds up what repeats, so that a value is shuffled once a task, however often it stands and however many columns there are."""
    texts = F.array(*(F.struct(F.lit(k).alias("k"), rendered(F.col(c), table.kind(c)).alias("value")) for k, c in enumerate(columns)))
    return rows.select(F.inline(texts)).groupBy("k", "value").agg(F.count("*").alias("rows"))


def _named(table: TableDef, rows: DataFrame, columns: list[str], measured: DataFrame) -> DataFrame:
    """The measured columns with their names; those of an empty table too."""
    names = rows.sparkSession.createDataFrame(list(enumerate(columns)), "k int, column_name string")
    return names.join(F.broadcast(measured), "k", "left").withColumn("table_name", F.lit(table.name))  # a row a column


def column_stats(table: TableDef, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(table_name, column_name, distinct_count, min_value, max_value) over the texts."""
    columns = columns or table.columns
    found = _by_value(table, rows, columns).groupBy("k").agg(F.count("value").alias("distinct_count"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return _named(table, rows, columns, found).select("table_name", "column_name", F.coalesce("distinct_count", F.lit(0)).cast("long").alias("distinct_count"), "min_value", "max_value")


def index_stats(table: TableDef, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(table_name, column_name, rec_per_key): rows for each distinct key; 1 where there are none."""
    found = _by_value(table, rows, columns).groupBy("k").agg((F.sum("rows") / F.count("value")).alias("rec_per_key"))
    return _named(table, rows, columns, found).select("table_name", "column_name", F.coalesce("rec_per_key", F.lit(1.0)).alias("rec_per_key"))


def range_rows(table: TableDef, rows: DataFrame, column: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """(table_name, column_name, row_count) of rows whose text in the column is from low to high, both included; None is no bound."""
    value = rendered(F.col(column), table.kind(column))
    for bound, inside in ((low, value >= F.lit(low)), (high, value <= F.lit(high))):
        if bound is not None:
            rows = rows.filter(inside)
    return rows.agg(F.count("*").alias("row_count")).select(F.lit(table.name).alias("table_name"), F.lit(column).alias("column_name"), "row_count")
