"""SELECT over streams: an addition of this engine, whose dialect has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lakeloom.errors import EngineError, ParseError
from lakeloom.operators.select import select
from lakeloom.plans.parser import parse
from lakeloom.plans.statements import Select
from lakeloom.sources.external import external_table


def stream_select(sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """The SELECT's plan over streaming or static DataFrames by table name; every value as text.

    Filters and projections run on each micro-batch, joins of a stream with static tables too; joins of streams keep state
    as Structured Streaming does.
    """
    made = parse(sql)
    if not isinstance(made, Select):
        raise ParseError("must have SELECT statement")

    def table_of(name: str):
        if name not in frames:
            raise EngineError(f"table {name} not found")
        return external_table(name, frames[name])

    return select(made, table_of, lambda table: frames[table.name])[0]
