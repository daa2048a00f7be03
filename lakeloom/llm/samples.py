"""Bounded training samples: about so many rows a class, and so many characters a row, whatever the identifiers and texts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_CHARS = 16_384
_POINTS = 1 << 52


def remainder(id_column: Column, by: int) -> Column:
    return F.crc32(id_column.cast("string")) % by


def training_sample(rows: DataFrame, class_column: str, most: int, chars: int = TEXT_CHARS) -> DataFrame:
    """Of rows (doc_id, text, a class), about `most` different ones a class at most, the same at every run: those whose hash of identifier
    and text is low. Null identifiers hash with their text as any other, and rows that repeat both are one row. A text of more than `chars`
    characters gives so many of them, from a place that its hash chooses. Adds _point, by which rows can be put in one order.

    The classes' shares are broadcast: a row a class, as the model has that learns from the sample.
    """
    point = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_POINTS)) / F.lit(float(_POINTS))
    placed = rows.withColumn("_point", point)
    shares = placed.groupBy(class_column).agg(F.approx_count_distinct("_point").alias("_count")).select(F.col(class_column).alias("_class"), (F.lit(float(most)) / F.col("_count")).alias("_share"))
    picked = placed.join(F.broadcast(shares), (F.col(class_column) == F.col("_class")) & (F.col("_point") < F.col("_share")))
    start = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars, F.lit(0)).cast("long") + 1).cast("int")
    return picked.drop("_class", "_share").dropDuplicates([class_column, "_point"]).withColumn("text", F.substring("text", start, F.lit(chars)))
