"""An exact n-gram Jaccard join by set relations, and its components.

1. Documents with equal shingle sets are one node, known by a 64-bit key of the set. A map over the documents sends the shingles of each
   chunk's nodes, sorted and packed with the keys of their nodes, to the partitions of the shingle space, where whole index lists meet:
   a shingle's document frequency is exact, over all nodes. What goes on from there, by node, is the entries of shingles that two or
   more nodes have. Texts are never shuffled.
2. Shingles are ordered by frequency, rarest first. A node's prefix, all but the last (needed overlap - 1) of its shingles, must meet
   the prefix of any partner. Shingles of one node alone come first and meet nothing, so most nodes have no prefix left at all, and
   what is left is known by its place in the order: the index lists hold prefix places only.
3. Set relations: each list names the first of its nodes. A node that has enough shingles from lists of one such leader is linked with
   it by their count alone, and keeps a bound on how far the two sets differ. Leaders' groups are then taken as a whole: where two
   groups meet in a list, the sets of their roots are compared once. From that answer and the bounds the answers of all members follow
   (differences obey the triangle inequality): either no two members can link, and the pair of groups is skipped, or the roots link
   and the groups are one, or, seldom, the members that share a prefix shingle are compared each.

Nothing is dropped or capped. A shingle is known by HASH_BITS bits, whatever the size of the table, and sets are made distinct by these; two
shingles of one pair of documents coincide with a chance of about their number squared over 2**HASH_BITS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm import flat
from lakeloom.llm.components import connected
from lakeloom.llm.packed import bits_of, from_bits, numbers, pack, small, unpack
from lakeloom.llm.shared import saved, saved_alone, unused

SHINGLE = 5
PERCENT = 80
HASH_BITS = 50
SEND_BYTES = 6 << 20
CUT_BYTES = 1 << 18  # of texts whose shingles are made at once
BLOCK_NODES = 4_000
PART_SHINGLES = 1_500_000
HUB_TURNS = 1
HUBS = 2
LINKED = f"100 * overlap >= {PERCENT} * (n_a + n_b - overlap)"
_STEP = np.uint64(0x9FB21C651E98DF25)
_SECOND = np.uint64(0xA24BAED4963EE407)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles as ascending HASH_BITS-bit values, and where each row's begin (rows + 1); at most 1 << (64 - HASH_BITS) rows.

    A row of fewer words has its whole sequence as one shingle; one without words has none.
    """
    data = flat.lower(data)
    starts, ends, bounds = flat.words(data, offsets)
    own = flat.hashes(data, starts, ends)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    with np.errstate(over="ignore"):
        last = bounds[1:][row.astype(np.int64)] if len(row) else np.zeros(0, np.int64)
        at = np.flatnonzero(np.arange(len(own)) + shingle <= last)
        whole = own[at]
        for k in range(1, shingle):
            whole = whole * _STEP + own[at + k]
        values, rows = [whole], [row[at]]
        for n in range(1, shingle):
            few = np.flatnonzero(counts == n)
            short = own[bounds[few]] + np.uint64(n)
            for k in range(1, n):
                short = short * _STEP + own[bounds[few] + k]
            values.append(short)
            rows.append(few.astype(np.uint64))
        keys = flat.mix(np.concatenate(values)) >> np.uint64(64 - HASH_BITS)
    keys |= np.concatenate(rows) << np.uint64(HASH_BITS)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys & np.uint64((1 << HASH_BITS) - 1), np.searchsorted(keys >> np.uint64(HASH_BITS), np.arange(len(offsets), dtype=np.uint64))


def node_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, from two sums over its mixed values."""
    with np.errstate(over="ignore"):
        first, second = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
        np.cumsum(flat.mix(values), out=first[1:])
        np.cumsum(flat.mix(values ^ _SECOND), out=second[1:])
        a, b = first[bounds[1:]] - first[bounds[:-1]], second[bounds[1:]] - second[bounds[:-1]]
        return flat.mix(a + flat.mix(b + np.diff(bounds).astype(np.uint64))).view(np.int64)


def _cuts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for low, high in flat.chunks(offsets, CUT_BYTES):
        for start in range(low, high, 1 << (64 - HASH_BITS)):
            yield start, min(high, start + (1 << (64 - HASH_BITS)))


def needed(n):
    """The least overlap that a set of n shingles must have with any partner."""
    return (PERCENT * n + 99) // 100


def links(overlap, n, other):
    return 100 * overlap >= PERCENT * (n + other - overlap)


def _measured(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, node of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.flat(batch.column(1))
            counts, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high in _cuts(offsets):
                values, bounds = shingle_sets(*flat.part(data, offsets, low, high), shingle)
                counts.append(np.diff(bounds))
                nodes.append(node_keys(values, bounds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts)), pa.array(np.concatenate(nodes))], ["doc_id", "n", "node"])

    return rows.mapInArrow(flat.tidy(run), "doc_id long, n long, node long")


def _edges(parts: int) -> np.ndarray:
    return np.array([-(-(p << HASH_BITS) // parts) for p in range(1, parts)], np.uint64)


def _sent(rows: DataFrame, parts: int, shingle: int) -> DataFrame:
    """(part, entries, values, nodes, places): each chunk's shingles by the part of the shingle space, ascending; its nodes' keys, ascending; and for each shingle the place of its node among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(parts)
        for batch in batches:
            data, offsets = flat.flat(batch.column(0))
            for low, high in flat.chunks(offsets, SEND_BYTES):
                values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                known = np.zeros(0, np.uint64)
                some = flat.part(data, offsets, low, high)
                for a, b in _cuts(some[1]):
                    own, bounds = shingle_sets(*flat.part(*some, a, b), shingle)
                    key, sizes = node_keys(own, bounds).view(np.uint64), np.diff(bounds)
                    new = np.zeros(len(key), bool)  # equal sets of the chunk are sent once
                    new[np.unique(key, return_index=True)[1]] = True
                    new &= (sizes > 0) & ~np.isin(key, known)
                    known = np.concatenate([known, key[new]])
                    values.append(own[np.repeat(new, sizes)])
                    owners.append(np.repeat(key[new], sizes[new]))
                order, sorted_ = flat.ordered(np.concatenate(values))
                owner = np.concatenate(owners)[order]
                del values, owners, order
                at = np.concatenate([[0], np.searchsorted(sorted_, edges), [len(sorted_)]])
                out: dict[str, list] = {k: [] for k in ("part", "entries", "values", "nodes", "places")}
                for p in np.flatnonzero(np.diff(at)):
                    nodes, place, _, _ = flat.distinct(owner[at[p] : at[p + 1]])
                    for name, value in zip(out, (int(p), len(place), pack(sorted_[at[p] : at[p + 1]]), pack(nodes), bits_of(place, len(nodes).bit_length())), strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), pa.array(out["entries"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in ("values", "nodes", "places"))], [*out])

    return rows.select("text").mapInArrow(flat.tidy(run), "part int, entries long, values binary, nodes binary, places binary")


def _met(sent: DataFrame, blocks: int) -> DataFrame:
    """(block, nodes, counts, values, frequencies, leaders) for shingles of two nodes at least: nodes' keys, how many entries each has, and the entries, by node."""

    def run(table: pa.Table) -> pa.Table:
        value, node = [], []
        for entries, values, nodes, places in zip(*(table.column(c).to_pylist() for c in ("entries", "values", "nodes", "places")), strict=True):
            keys = unpack(nodes)
            value.append(unpack(values))
            node.append(keys[from_bits(places, entries, len(keys).bit_length()).astype(np.int64)])
        del table
        order, value = flat.ordered(np.concatenate(value))
        node = np.concatenate(node)[order]
        del order
        value, node, _ = _several(value, node)
        order = np.lexsort((node, value))
        value, node = value[order], node[order]
        first = np.ones(len(value), bool)  # a set that stands in several chunks has come from each
        first[1:] = (value[1:] != value[:-1]) | (node[1:] != node[:-1])
        value, node, sizes = _several(value[first], node[first])
        leader = np.repeat(node[np.cumsum(sizes) - sizes], sizes)
        many = np.repeat(sizes, sizes)
        block = node.view(np.int64) % blocks
        by_block = np.lexsort((value, node, block))
        value, node, leader, many, block = (x[by_block] for x in (value, node, leader, many, block))
        out: dict[str, list] = {k: [] for k in ("block", "nodes", "counts", "values", "frequencies", "leaders")}
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            begins = np.append(np.flatnonzero(np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]])), b - a)
            for name, x in zip(out, (int(block[a]), pack(node[a:b][begins[:-1]]), small(np.diff(begins)), bits_of(value[a:b], HASH_BITS), small(many[a:b]), leader[a:b].astype("<u8").tobytes()), strict=True):
                out[name].append(x)
        made = pa.table({"block": pa.array(out["block"], pa.int32()), **{k: pa.array(out[k], pa.binary()) for k in out if k != "block"}})
        del out, value, node, leader, many, block, by_block
        flat.give_back()
        return made

    return sent.groupBy("part").applyInArrow(run, "block int, nodes binary, counts binary, values binary, frequencies binary, leaders binary")


def _several(value: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries, by value, of values that stand more than once, and how often each such value does."""
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(value)))
    kept = np.repeat(sizes > 1, sizes)
    return value[kept], node[kept], sizes[sizes > 1]


def _candidates(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that share enough shingles to link with anything: owner (the node's key), n, alone, shared (packed values), prefix (values in the order of frequency), leader, common.

    alone counts the shingles that no other node has. common counts the shingles whose list the leader heads: at least so many are in both sets. leader is null where they are too few.
    """
    schema = "owner long, n long, alone long, shared binary, prefix binary, leader long, common long"
    kinds = {"owner": pa.int64(), "n": pa.int64(), "alone": pa.int64(), "shared": pa.binary(), "prefix": pa.binary(), "leader": pa.int64(), "common": pa.int64()}

    def run(lists: pa.Table, own: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in kinds}
        if lists.num_rows and own.num_rows:
            key = own.column("node").to_numpy().view(np.uint64)
            order = np.argsort(key)
            node, n = key[order], own.column("n").to_numpy()[order]
            place, value, many, leader = [], [], [], []
            for keys, counts, values, frequencies, leaders in zip(*(lists.column(c).to_pylist() for c in ("nodes", "counts", "values", "frequencies", "leaders")), strict=True):
                keys = unpack(keys)
                counts = numbers(counts, len(keys))
                place.append(np.repeat(np.searchsorted(node, keys), counts))
                value.append(from_bits(values, int(counts.sum()), HASH_BITS))
                many.append(numbers(frequencies, len(value[-1])))
                leader.append(np.frombuffer(leaders, "<u8"))
            place, value, many, leader = (np.concatenate(x) for x in (place, value, many, leader))
            by_node = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[by_node], np.arange(len(node) + 1))
            need = needed(n)
            for k in np.flatnonzero(np.diff(bounds) >= need):
                mine = by_node[bounds[k] : bounds[k + 1]]
                ranked = mine[np.lexsort((value[mine], many[mine]))]
                heads, counts = np.unique(leader[mine], return_counts=True)
                counts = np.where(heads == node[k], 0, counts)
                best = int(counts.argmax())
                enough = counts[best] >= need[k]
                row = (int(node[k].view(np.int64)), n[k], n[k] - len(mine), pack(np.sort(value[mine])), value[ranked[: len(mine) - need[k] + 1]].astype("<i8").tobytes(), int(heads[best].view(np.int64)) if enough else None, int(counts[best]) if enough else None)
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
        made = pa.table({k: pa.array(out[k], kind) for k, kind in kinds.items()})
        out = place = value = many = leader = by_node = None
        flat.give_back()
        return made

    return met.groupBy("block").cogroup(nodes.select("block", "node", "n").groupBy("block")).applyInArrow(run, schema)


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _groups(nodes: DataFrame) -> DataFrame:
    """(owner, root, apart) of each candidate: its leaders followed to the last one, and a bound on how far the two sets differ."""
    heads = nodes.select(F.col("owner").alias("leader"), F.col("n").alias("leader_n"))
    own = nodes.join(heads, "leader", "left").withColumn("linked", F.coalesce(100 * F.col("common") >= PERCENT * (F.col("n") + F.col("leader_n") - F.col("common")), F.lit(False)))
    step = own.select("owner", F.when(F.col("linked"), F.col("leader")).otherwise(F.col("owner")).alias("root"), F.when(F.col("linked"), F.col("n") + F.col("leader_n") - 2 * F.col("common")).otherwise(F.lit(0)).cast("long").alias("apart"))
    while True:
        step = saved(step, "leaders")
        ahead = step.select(F.col("owner").alias("root"), F.col("root").alias("next"), F.col("apart").alias("more"))
        if not step.join(ahead, "root").filter("next <> root").limit(1).count():
            return step
        step = step.join(ahead, "root").select("owner", F.col("next").alias("root"), (F.col("apart") + F.col("more")).alias("apart"))


def _exploded(df: DataFrame) -> DataFrame:
    """(value, rest, owner, n, alone, root, apart) for each shingle of the prefixes; rest counts it and what stands after it in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                values = [np.frombuffer(x, "<i8") for x in some.column(0).to_pylist()]
                sizes = np.array([len(v) for v in values])
                times = np.repeat(np.arange(len(values)), sizes)
                within = np.arange(len(times)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                shared = (some.column(2).to_numpy() - some.column(3).to_numpy())[times]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(shared - within), *(c.take(pa.array(times)) for c in some.columns[1:])], ["value", "rest", *some.schema.names[1:]])

    return df.select("prefix", "owner", "n", "alone", "root", "apart").mapInArrow(flat.tidy(run), "value long, rest long, owner long, n long, alone long, root long, apart long")


def _may_link(n: str, rest: str, other_n: str, other_rest: str) -> str:
    """Length and positional filter: a pair whose first common shingle this is has an overlap of at most the lesser rest."""
    return f"{100 + PERCENT} * least({rest}, {other_rest}) >= {PERCENT} * ({n} + {other_n})"


def _mixed(entries: DataFrame, component_of: DataFrame) -> DataFrame:
    """Entries, with the component of their root, of the lists in which components meet."""
    known = entries.join(component_of, entries["root"] == component_of["id"], "left").select(*entries.columns, F.coalesce("component", "root").alias("component"))
    known = saved(known, "shingle-known")
    several = known.groupBy("value").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high").select("value")
    return saved(known.join(several, "value"), "shingle-mixed")


def _possible(mixed: DataFrame) -> DataFrame:
    """Entries that may link with the smallest set of another component in their list, in lists where components still meet.

    What is dropped can link with nothing in that list: a set's rest bounds the size of a partner from above. So a list does not grow
    with the square of a large group on account of a few sets that are almost, but not, like it.
    """
    least = mixed.groupBy("value").agg(F.min(F.struct("n", "component")).alias("least"))
    known = mixed.join(least, "value")
    other = known.filter("component <> least.component").groupBy("value").agg(F.min("n").alias("other"))
    partner = "case when component <> least.component then least.n else other end"
    alive = known.join(other, "value").filter(f"{100 + PERCENT} * rest >= {PERCENT} * (n + {partner})").select(*mixed.columns)
    several = alive.groupBy("value").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high").select("value")
    return saved(alive.join(several, "value"), "shingle-possible")


def _met_by_hubs(mixed: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """Links (a, b) between components: each list's entries are compared with one hub of it, an entry with HUBS hubs at most.

    First the hub is the set with the smallest share of shingles of its own, as an original among its copies has; later any. What these
    comparisons don't link is left to the comparison of whole lists.
    """
    rank = F.col("alone") / F.col("n") if turn == 0 else F.xxhash64("owner", F.lit(turn)).cast("double")
    hubs = mixed.groupBy("value").agg(F.min(F.struct(rank.alias("rank"), F.col("owner"), F.col("component"), F.col("n"), F.col("rest"))).alias("hub"))
    near = mixed.join(hubs, "value").filter("component <> hub.component and " + _may_link("n", "rest", "hub.n", "hub.rest"))
    pairs = near.groupBy(F.col("owner").alias("a"), F.col("hub.owner").alias("b"), F.col("component").alias("in_a"), F.col("hub.component").alias("in_b")).count()
    best = Window.partitionBy("a").orderBy(F.col("count").desc(), "b")
    pairs = pairs.withColumn("place", F.row_number().over(best)).filter(f"place <= {HUBS}").select("a", "b", "in_a", "in_b")
    return _compared(pairs, found).filter(LINKED).select(F.col("in_a").alias("a"), F.col("in_b").alias("b"))


def _compared(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """pairs (a, b, ...) of owners with their sets' sizes and exact overlap: n_a, n_b, overlap."""
    keep = [c for c in pairs.columns if c not in ("a", "b")]
    one = shared.select(F.col("owner").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("set_a"))
    two = shared.select(F.col("owner").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("set_b"))
    rows = pairs.join(one, "a").join(two, "b").select("set_a", "set_b", "a", "b", "n_a", "n_b", *keep)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap = [len(np.intersect1d(unpack(x.as_py()), unpack(y.as_py()), assume_unique=True)) for x, y in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(overlap, pa.int64())], [*batch.schema.names[2:], "overlap"])

    return rows.mapInArrow(flat.tidy(run), kinds + ", overlap long")


def _joined(rows: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and node of each row (doc_id, text); and node, low (its smallest identifier) and component (any one label) of each set that has one."""
    measured = saved(_measured(rows, shingle), "shingle-sets")
    return measured, saved_alone(lambda: _labels(rows, measured, shingle), "shingle-components")


def _labels(rows: DataFrame, measured: DataFrame, shingle: int) -> DataFrame:
    nodes = saved(measured.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.max("n").alias("n")), "shingle-nodes")
    total, count = nodes.agg(F.sum("n"), F.count("*")).first()
    blocks, parts = max(1, math.ceil(count / BLOCK_NODES)), max(1, math.ceil((total or 0) / PART_SHINGLES))
    dealt = nodes.withColumn("block", F.pmod(F.col("node"), F.lit(blocks)).cast("int"))

    sent = _sent(rows.filter("doc_id is not null"), parts, shingle)
    found = saved(_candidates(_met(sent, blocks), dealt), "shingle-candidates")
    groups = _groups(found.select("owner", "n", "leader", "common"))

    # Groups that meet in a prefix list: most link by a hub of the list, so that a large group of near copies is one at once.
    entries = saved(_exploded(found.join(groups, "owner")), "shingle-entries")
    edges = entries.select(F.col("root").alias("a"), F.col("root").alias("b")).limit(0)
    joined = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for turn in range(HUB_TURNS):
        met = saved(_met_by_hubs(_mixed(entries, joined), found, turn), "shingle-links")
        if not some(met):
            break
        edges = edges.union(met).union(joined.select(F.col("id").alias("a"), F.col("component").alias("b")))
        joined = saved(connected(edges), "shingle-joined")

    # What is left of the lists is compared whole: the roots of groups first.
    mixed = _possible(_mixed(entries, joined))
    lists = mixed.groupBy("value", "root", "component").agg(F.min("n").alias("least"), F.max("rest").alias("rest"))
    other = lists.select("value", F.col("root").alias("b"), F.col("component").alias("in_b"), F.col("least").alias("least_b"), F.col("rest").alias("rest_b"))
    meets = lists.withColumnRenamed("root", "a").withColumnRenamed("component", "in_a").join(other, "value")
    meets = meets.filter("in_a < in_b and " + _may_link("least", "rest", "least_b", "rest_b"))
    roots = saved(_compared(meets.select("a", "b").distinct(), found), "shingle-roots")
    met = roots.filter(LINKED).select("a", "b")
    if some(met):
        edges = edges.union(met)
        joined = saved(connected(edges), "shingle-joined")

    # Groups whose roots don't link, and whose members are too spread for that to settle them.
    spread = mixed.groupBy("root").agg(F.max("apart").alias("apart"), F.max("n").alias("most"))
    apart = roots.filter(f"not {LINKED}").withColumn("gap", F.expr("n_a + n_b - 2 * overlap"))
    for side in ("a", "b"):
        apart = apart.join(spread.select(F.col("root").alias(side), F.col("apart").alias(f"apart_{side}"), F.col("most").alias(f"most_{side}")), side)
        apart = apart.join(joined.select(F.col("id").alias(side), F.col("component").alias(f"in_{side}")), side, "left")
    # A link means: difference <= (1 - t) / (1 + t) of the sizes' sum.
    near = f"{100 + PERCENT} * (gap - apart_a - apart_b) <= {100 - PERCENT} * (most_a + most_b)"
    open_ = apart.filter(f"{near} and coalesce(in_a, a) <> coalesce(in_b, b)").select(F.col("a").alias("root_a"), F.col("b").alias("root_b"), "gap")
    one = mixed.select("value", F.col("owner").alias("a"), F.col("n").alias("size_a"), F.col("rest").alias("rest_a"), F.col("root").alias("root_a"), F.col("apart").alias("apart_a"))
    two = mixed.select("value", F.col("owner").alias("b"), F.col("n").alias("size_b"), F.col("rest").alias("rest_b"), F.col("root").alias("root_b"), F.col("apart").alias("apart_b"))
    reach = f"{100 + PERCENT} * (gap - apart_a - apart_b) <= {100 - PERCENT} * (size_a + size_b) and " + _may_link("size_a", "rest_a", "size_b", "rest_b")
    members = one.join(open_, "root_a").join(two, ["value", "root_b"]).filter(reach).select("a", "b", "root_a", "root_b").distinct()
    more = saved(_compared(members, found).filter(LINKED).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "shingle-links")
    if some(more):
        joined = connected(edges.union(more))

    of_root = groups.join(joined, groups["root"] == joined["id"], "left").select(F.col("owner").alias("node"), F.coalesce("component", "root").alias("component"))
    return nodes.select("node", "low").join(of_root, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """n_shingles and component_id of each row, by links between sets whose Jaccard similarity is PERCENT / 100 or more.

    Words are runs outside [\\x20\\x09-\\x0D] of the whole text, A-Z lower-cased. A text of fewer words than a shingle is one shingle; a
    null text or one without words has none, links with nothing, and its component is its own identifier. Rows of one identifier (repeats)
    count each; what one of them reaches, its text reaches, not the others. A null identifier has the component of its text if another row
    has one, else null. Other columns are dropped, so their names can't clash. Identifiers are integers.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    measured, of_node = _joined(rows, shingle)
    least = of_node.groupBy("component").agg(F.min("low").alias("component_id"))
    answer = of_node.join(least, "component").select("node", "component_id")
    out = measured.filter("n > 0").join(answer, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(measured.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _with_node(docs: DataFrame, name: str, text_column: str, shingle: int) -> DataFrame:
    """The rows with the key of their text's set; null where it is empty."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.flat(batch.column(at).cast(pa.string()))
            keys, some = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for low, high in _cuts(offsets):
                values, bounds = shingle_sets(*flat.part(data, offsets, low, high), shingle)
                keys.append(node_keys(values, bounds))
                some.append(np.diff(bounds) > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys), mask=~np.concatenate(some))], [*batch.schema.names, name])

    return docs.mapInArrow(flat.tidy(run), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row, whole and with all its columns, of each component: that of the smallest identifier, and of its texts in the component the one whose set has the smallest key.

    Of rows that repeat both identifier and text, and of texts that have one set, one stays, the same at every run: by the text, then by a
    hash of the whole row. Texts without words, which link with nothing, stay, once for each identifier; so do all rows without an identifier.
    """
    key, again = unused(docs, "_node"), unused(docs, "_again")
    first_id, first_node = unused(docs, "_first_id"), unused(docs, "_first_node")
    _, of_node = _joined(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")), shingle)
    firsts = of_node.groupBy("component").agg(F.min(F.struct("low", "node")).alias("first")).select(F.col("first.low").alias(first_id), F.col("first.node").alias(first_node))
    rows = _with_node(docs, key, text_column, shingle)
    kept = rows.filter(F.col(id_column).isNotNull() & F.col(key).isNotNull()).join(firsts, (F.col(id_column).cast("long") == F.col(first_id)) & (F.col(key) == F.col(first_node)), "left_semi")
    kept = kept.unionByName(rows.filter(F.col(id_column).isNotNull() & F.col(key).isNull()))
    hashed = [f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    order = Window.partitionBy(id_column, key).orderBy(F.col(text_column), F.xxhash64(*hashed))
    kept = kept.withColumn(again, F.row_number().over(order)).filter(F.col(again) == 1)
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(id_column).isNull()))
