"""Tables of typed Parquet (or any DataFrame), read only, as the engine sees them: every value as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lakeloom.catalog import TableDef
from lakeloom.functions.rendering import renderable


def external_table(name: str, df: DataFrame) -> TableDef:
    """Its columns that have a text; arrays and other nested values have none and stay out."""
    kinds = {f.name: f.dataType for f in df.schema.fields if renderable(f.dataType)}
    return TableDef(name, list(kinds), kinds=kinds)
