"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

Each source's documents stand in a shuffled order (by a digest of their identifier), and their words, one after another, are
cut into blocks of equally many. The schedule walks golden-ratio points: the fraction of k times the golden ratio falls into one
source's interval of the cumulative weights, so after any number of slots each source has had its share to within a few. A
source's n-th slot takes its n-th block, from the first one again when all are used; the last slot of a source is cut where its
target is reached. A document's words in the taken blocks are what the mix takes of it.

Running sums over a source are made in two levels (sums of hash-range buckets, then within a bucket), so that no task holds a
source, even one with a third of all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.shared import saved, unused

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = (math.sqrt(5) - 1) / 2
LEAST_SLOTS = 1 << 16
MOST_WORDS = 4096
SLOT_RUN = 4096
BUCKET_ROWS = 4096
GRID = 1024


@dataclass
class Mix:
    """documents: doc_id, source, size, source_size, target, taken. schedule: slot, source, epoch, block. sources: a row each."""

    documents: DataFrame
    schedule: DataFrame
    sources: DataFrame


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """From (source, source_size): s (place by code point, null last), weight 1, 2, 3, repeating, and target.

    Targets share the sum of all sizes by weight. One above `most` times its source's size stops there, and the excess goes to the
    others by weight. Sources in order of size for a unit of weight stop first, so running sums give the level of the rest. One row
    a source; its windows run over that table alone.
    """
    all_rows = Window.partitionBy()
    placed = sizes.withColumn("s", F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", F.col("s") % 3 + 1)
    placed = placed.withColumn("ratio", most * F.col("source_size").cast("double") / F.col("weight"))
    stopped = all_rows.orderBy("ratio", "s").rowsBetween(Window.unboundedPreceding, -1)
    open_ = all_rows.orderBy("ratio", "s").rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(most * F.col("source_size")).over(stopped), F.lit(0))
    level = placed.withColumn("level", left.cast("double") / F.sum("weight").over(open_))
    level = level.withColumn("rest", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(all_rows))
    stops = (F.col("ratio") <= F.col("level")) | F.col("rest").isNull()
    return level.select("s", "source", "source_size", "weight", F.when(stops, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("rest")).alias("target"))


def running_start(rows: DataFrame, key: str, bucket: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of value over the key's earlier rows; bucket must not fall along the order."""
    cut = rows.withColumn("_bucket", bucket)
    sums = cut.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    joined = cut.join(sums, (cut[key] == sums["_key"]) & (cut["_bucket"] == sums["_at"]))
    return joined.withColumn(name, F.col("_ahead") + F.col("_own")).drop("_bucket", "_at", "_key", "_ahead", "_own")


def mix_sources(docs: DataFrame, most: int = 3, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> Mix:
    """Mixes all rows to the weights of their sources.

    A row's size is its number of words; a null text has none. Rows of one identifier (repeated rows too) each count for
    themselves; a null identifier or source is one as any other. Rows without words are returned with taken 0. An empty table gives
    no rows. Only the three columns are read, so others can't clash.
    """
    size = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.coalesce(F.md5(F.col(id_column).cast("string")), F.lit(""))
    rows = saved(docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), size.alias("size"), digest.alias("digest")), "mix-sizes")
    sources = saved(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most).coalesce(1), "mix-sources")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    words = max(1, min(MOST_WORDS, (total or 0) // LEAST_SLOTS))

    # What each source owes: whole rounds, then the first words of one more.
    owed = sources.withColumn("quota", F.floor(F.col("target") + 0.5)).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(words)))
    owed = owed.withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)))
    owed = owed.withColumn("rest", F.col("quota") - F.col("rounds") * F.col("source_size"))
    owed = owed.withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(words)))
    edges = Window.partitionBy().orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    owed = owed.withColumn("high", F.sum("slots").over(edges)).withColumn("low", F.col("high") - F.col("slots"))

    slots = _schedule(owed).join(owed.select(F.col("s").alias("_s"), "source", "blocks", "rounds"), F.col("s") == F.col("_s"))
    schedule = slots.select("slot", "source", "s", F.expr("rank div blocks").alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"), "rounds")
    takes = schedule.groupBy("s", "block").agg(F.count(F.when(F.col("epoch") < F.col("rounds"), 1)).alias("whole"), F.count(F.when(F.col("epoch") == F.col("rounds"), 1)).alias("cut"))

    known = rows.alias("r").join(owed.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source"))).select("r.doc_id", "r.source", "size", "digest", "s", "source_size", "target", "rest")
    digits = max(1, min(12, math.ceil(math.log(max(count, 2) / BUCKET_ROWS, 16))))
    some = known.filter("size > 0")
    some = running_start(some, "s", F.substring("digest", 1, digits), [F.col("digest"), F.col("doc_id"), F.col("size")], "size", "start")
    pieces = some.withColumn("block", F.explode(F.sequence(F.expr(f"start div {words}"), F.expr(f"(start + size - 1) div {words}"))))
    pieces = pieces.withColumn("from", F.greatest("start", F.col("block") * words)).withColumn("to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * words))
    got = F.coalesce(F.col("whole") * (F.col("to") - F.col("from")) + F.col("cut") * F.greatest(F.lit(0), F.least("to", "rest") - F.col("from")), F.lit(0))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    taken = pieces.join(takes, ["s", "block"], "left").groupBy(*columns, "s", "start").agg(F.sum(got).cast("long").alias("taken")).select(*columns, "taken")
    none = known.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return Mix(taken.unionByName(none), schedule.select("slot", "source", "epoch", "block"), sources)


def repeat_documents(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """The mix in whole documents: each row as often as the mix takes its words, rounded half up; with all its columns.

    Rows of one identifier share what is taken of them all. A row without words is taken by no mix, so it goes.
    """
    key, times, time = unused(docs, "_id"), unused(docs, "_times"), unused(docs, "_time")
    mixed = mix_sources(docs, id_column=id_column, source_column=source_column, text_column=text_column).documents
    taken = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int").alias(times))
    rows = docs.join(taken.filter(F.col(times) > 0), F.col(id_column).eqNullSafe(F.col(key)))
    return rows.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def _schedule(owed: DataFrame) -> DataFrame:
    """(slot, s, rank): golden-ratio points mapped through the cumulative slots, ranked within each source."""
    spark = owed.sparkSession
    total = owed.agg(F.max("high")).first()[0] or 0
    point = F.col("slot") * F.lit(GOLDEN)
    points = spark.range(1, total + 1).select(F.col("id").alias("slot"), ((point - F.floor(point)) * F.lit(float(total))).alias("point"))
    # Points meet intervals by the cells of a grid, so each point is tried against the few sources of its cell.
    width = max(1, total // GRID)
    cells = owed.filter("slots > 0").select("s", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    points = points.withColumn("cell", F.floor(F.col("point") / F.lit(width)))
    hits = points.join(cells, "cell").filter("point >= low and point < high")
    ranked = running_start(hits.select("slot", "s").withColumn("one", F.lit(1)), "s", F.expr(f"slot div {SLOT_RUN}"), [F.col("slot")], "one", "rank")
    ranked = ranked.join(owed.select(F.col("s").alias("_s"), "slots"), F.col("s") == F.col("_s")).filter("rank < slots").select("slot", "s", "rank")
    # The points miss a source's share by a few slots at most; those stand after the others, source by source.
    had = ranked.groupBy("s").agg(F.count("*").alias("had"))
    short = owed.join(had, "s", "left").select("s", "slots", F.coalesce("had", F.lit(0)).alias("had")).filter("had < slots")
    after = Window.partitionBy().orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # a row a source
    short = short.withColumn("first", F.lit(total + 1) + F.coalesce(F.sum(F.col("slots") - F.col("had")).over(after), F.lit(0)))
    rest = short.select("s", "had", "first", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("rank"))
    return ranked.unionByName(rest.select((F.col("first") + F.col("rank") - F.col("had")).cast("long").alias("slot"), "s", "rank"))
