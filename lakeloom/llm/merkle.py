"""Document fingerprints: a Merkle tree over sections and paragraphs, with DataFrame functions only.

A text's sections are its lines; a section's paragraphs are its sentences (cut after . ! ? and blanks). A leaf is the digest of
one paragraph, a section's digest covers its leaves in order, and the root covers the sections' digests. Equal texts have equal
roots; the branches that differ say where an edit is. The likeness of two fingerprints is the share of leaves that they have in
common, counted with repeats (Dice). A text without any is one empty leaf.

The next document by identifier is found by a window over ranges of the order, not over one partition. Ranges are cut at quantiles of a
bounded sample of (identifier, first characters of the text), so they hold about equally many rows however identifiers are spread and
whichever of them repeat. Each range's first row also goes, as a guest, to the range before it. A text is digested once, before the
shuffle; its leaves and section digests cross it beside the text and serve it and the document that it follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.shared import saved

RANGE_ROWS = 512
MOST_RANGES = 1 << 14
SAMPLES = 16  # rows of the sample for each range
TIE_CHARS = 32
DIGEST_CHARS = 32
PARAGRAPH = r"\s(?<=[.!?]\s)\s*"  # blanks after . ! or ?; looks back only from a blank


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, DIGEST_CHARS)


def leaves(text: Column) -> Column:
    """array<array<string>>: the paragraph digests of each section."""
    return F.transform(F.split(text, "\n"), lambda section: F.transform(F.split(section, PARAGRAPH), digest))


def sections(tree: Column) -> Column:
    """array<string>: the section digests; a prefix keeps leaves and inner nodes apart."""
    return F.transform(tree, lambda inner: digest(F.concat(F.lit("s"), F.array_join(inner, ""))))


def root(sections_: Column) -> Column:
    return F.sha2(F.concat(F.lit("r"), F.array_join(sections_, "")).cast("binary"), 256)


def in_order(tree: Column) -> Column:
    """array<string>: all leaves, sorted, each as the 16 bytes that its hex digits stand for. These strings are only compared, never shown."""
    return F.sort_array(F.transform(F.flatten(tree), lambda leaf: F.unhex(leaf).cast("string")))


def starts(leaves_: Column) -> Column:
    """array<int>: where runs of equal leaves begin in sorted leaves."""
    return F.filter(F.sequence(F.lit(0), F.size(leaves_) - 1), lambda k: (k == 0) | (F.get(leaves_, k) != F.get(leaves_, k - 1)))


def numbered(leaves_: Column, starts_: Column) -> Column:
    """Sorted leaves, a repeat marked with how many stood before it, so that a set keeps its repeats.

    Both must be columns, not expressions, which would be computed again for each leaf; then work and memory are linear in the leaves.
    """

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts_, k + 1), F.size(leaves_)) - 1
        leaf = F.get(leaves_, start)
        return F.transform(F.sequence(start, end), lambda at: F.when(at > start, F.concat(leaf, (at - start).cast("string"))).otherwise(leaf))

    return F.when(F.size(starts_) < F.size(leaves_), F.flatten(F.transform(starts_, run))).otherwise(leaves_)


def likeness(one: Column, other: Column) -> Column:
    """Dice similarity of two numbered leaf arrays, 0 to 1."""
    return 2 * F.size(F.array_intersect(one, other)) / (F.size(one) + F.size(other))


def changed_sections(one: Column, other: Column) -> Column:
    """Places, from 0, of the section digests that differ between two trees; places that only one has count."""
    places = F.sequence(F.lit(0), F.greatest(F.size(one), F.size(other)) - 1)
    return F.filter(places, lambda k: ~F.get(one, k).eqNullSafe(F.get(other, k)))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (the root), sections: the digests by which differing branches are found. A null text counts as empty."""
    rows = docs.select(F.col(id_column).alias("doc_id"), sections(leaves(F.coalesce(F.col(text_column).cast("string"), F.lit("")))).alias("sections"))
    return rows.select("doc_id", root(F.col("sections")).alias("fingerprint"), "sections")


def _place() -> Column:
    """Where a row stands in the order: identifiers descend, null ones come last, equal ones go by their texts, of which this knows the first characters.

    A complement turns the order of all 64-bit integers round, where a difference or a negative would overflow.
    """
    return F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not(F.col("doc_id").cast("long")).alias("turned"), F.substring("text", 1, TIE_CHARS).alias("tie"))


def _ranged(rows: DataFrame) -> DataFrame:
    """The rows with their place and their range: how many of the bounds are not beyond it."""
    placed = rows.withColumn("place", _place())
    count = rows.count()
    ranges = min(MOST_RANGES, count // RANGE_ROWS)
    if ranges < 2:
        return placed.withColumn("range", F.lit(0))
    # At most about SAMPLES * MOST_RANGES narrow rows; every SAMPLES-th of them is a bound.
    sample = placed.filter(F.rand(7) < F.lit(SAMPLES * ranges / count)).agg(F.sort_array(F.collect_list("place")).alias("sample"))
    bounds = saved(sample.select(F.lit(1).alias("one"), F.array_distinct(F.filter("sample", lambda _, k: k % SAMPLES == 0)).alias("bounds")), "merkle-bounds")
    known = placed.withColumn("one", F.lit(1)).join(F.broadcast(bounds), "one")  # one row
    halve = F.sequence(F.lit(1), F.lit(ranges.bit_length() + 2))
    start = F.struct(F.lit(0).alias("low"), F.size("bounds").alias("high"))

    def step(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        beyond = F.get("bounds", middle) > F.col("place")
        open_ = state["low"] < state["high"]
        return F.struct(F.when(open_ & ~beyond, middle + 1).otherwise(state["low"]).alias("low"), F.when(open_ & beyond, middle).otherwise(state["high"]).alias("high"))

    return known.withColumn("range", F.aggregate(halve, start, step, lambda s: s["low"])).drop("one", "bounds")


def with_next(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """(doc_id, text, carried columns, next_text, and next_ each of the carried): next by descending doc_id; after the last, the first.

    Null identifiers come last, equal ones by text. doc_id must be an integer; all 64-bit ones are. One shuffle of the texts, by range; a
    few rows go twice.
    """
    carried = carried or []
    rows = _ranged(docs)
    # For each range that has rows, the one before it; the first has the last before it.
    firsts = rows.groupBy("range").agg(F.min("place").alias("first"))
    firsts = firsts.withColumn("before", F.coalesce(F.lag("range").over(Window.partitionBy().orderBy("range")), F.max("range").over(Window.partitionBy())))
    firsts = F.broadcast(firsts.select(F.col("range").alias("_range"), "first", "before"))  # at most MOST_RANGES + 1 rows
    led = rows.join(firsts, (F.col("range") == F.col("_range")) & F.col("place").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))
    kept = ["doc_id", "text", *carried]
    places = led.select(*kept, F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at")).select(*kept, "at.range", "at.guest")
    following = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return places.select(*kept, "guest", *(F.lead(c).over(following).alias(f"next_{c}") for c in ("text", *carried))).filter(~F.col("guest")).drop("guest")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints each row's whole text and its edited text: the last floor(n_chars / 2) code points replaced by the first as many of the next row's text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and changed_sections (places that
    the edit changed). A null text counts as empty. Of repeated rows each is a row of its own, and each is the next of another. A
    single row is its own next. Other columns are dropped, so their names can't clash.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    trees = _with_leaves(rows, "text", "tree", "own", "sections")
    pairs = with_next(trees, ["own", "sections"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = pairs.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    both = _with_leaves(pairs, "edited_text", "edited_tree", "edited", "edited_sections")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        root(F.col("sections")).alias("fingerprint"),
        root(F.col("edited_sections")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        changed_sections(F.col("sections"), F.col("edited_sections")).alias("changed_sections"),
    )


def _with_leaves(rows: DataFrame, text: str, tree: str, numbered_: str, sections_: str) -> DataFrame:
    """The rows with the numbered leaves and the section digests of a text; its tree is made once for both."""
    held = rows.withColumn(tree, leaves(F.col(text)))
    held = held.withColumns({numbered_: in_order(F.col(tree)), sections_: sections(F.col(tree))}).drop(tree)
    runs = f"{numbered_}_starts"
    return held.withColumn(runs, starts(F.col(numbered_))).withColumn(numbered_, numbered(F.col(numbered_), F.col(runs))).drop(runs)
