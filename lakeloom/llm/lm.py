"""Scoring documents by an n-gram language model of the whole training corpus, in shards.

1. Documents are dealt into blocks by a hash of the whole row.
2. A block counts its distinct n-grams and sends them, sorted and packed, to shards. Words go by their own key. Longer n-grams go by the
   key of their first two words, each as the words that follow these, so all n-grams that begin alike meet in one shard. Counts are
   summed within a block before they are sent.
3. A shard adds up the counts of all blocks and builds its part of the corpus's model: an Elias-Fano trie (trie.py) whose roots are the
   pairs, with quantised smoothed probabilities. What the blocks sent is searched there, and the codes go back in the order of sending.
4. The block adds up its texts' scores from the codes.

Smoothing: a single word's probability is (count + 1) / (N + V + 1), a pair's (count + M * p) / (count of its first word + M), p being that of
its last word alone. From three words on it is absolute discounting: (count - D) / F, F being how often the context is followed, plus
D * U / F * p, U being how many different words follow it and p the probability after the context without its first word. A trie holds both
parts for each entry. A pair's context is a word, whose count another shard knows, so a pair's own code is that of its count, and the block
divides. D is near 1, so that a passage that the corpus has twice scores higher than one that it has once.

Counts are 64-bit sums. A word and a pair are known by KEY_BITS bits, a word after a pair by AFTER_BITS among those that follow it, whatever
the size of the corpus: an unseen pair looks seen with a chance of the corpus's distinct pairs over 2**KEY_BITS.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import flat, trie
from lakeloom.llm.samples import remainder
from lakeloom.llm.packed import bits_of, from_bits, numbers, pack, small, unpack

ORDER = 3
STRENGTH = 60.0
DISCOUNT = 0.97
KEY_BITS = 50
AFTER_BITS = 28
BLOCK_BYTES = 6 << 20
PART_BYTES = 8 << 20
MOST_WORDS = 1 << 20
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0xD1342543DE82EF95)
_KEY_SHIFT, _AFTER_SHIFT = np.uint64(64 - KEY_BITS), np.uint64(64 - AFTER_BITS)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of every row, each row closed by END, and where each row's begin (rows + 1)."""
    data = flat.lower(data)
    starts, ends, bounds = flat.words(data, offsets)
    places = bounds + np.arange(len(bounds))
    out = np.full(places[-1], END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[places[1:] - 1] = False
    out[inner] = flat.hashes(data, starts, ends)
    return out, places


def _edges(parts: int) -> np.ndarray:
    return np.array([-(-(p << KEY_BITS) // parts) for p in range(1, parts)], np.uint64)


class Grams:
    """The distinct n-grams of a block as levels of a trie: pairs by their key, then (entry above, word) in order. Pairs have no entry above."""

    def __init__(self, words: np.ndarray, ids: np.ndarray, places: np.ndarray, order: int):
        """words: the block's distinct word hashes, ascending; ids: each token's place in them; places: where each row's tokens begin."""
        pad, sizes = order - 1, np.diff(places)
        self.hashes = np.append(words, BEGIN)
        first = places[:-1] + np.arange(len(sizes)) * pad
        self.row = np.repeat(np.arange(len(sizes)), sizes + pad)
        local = np.arange(len(self.row)) - first[self.row]
        left = (sizes + pad)[self.row] - local
        self.token = np.flatnonzero(local >= pad)  # place of each token among its row's padded words
        sequence = np.full(len(self.row), len(words), np.int64)
        sequence[self.token] = ids
        self.keys, self.above, self.word, self.entry, self.counted = np.zeros(0, np.uint64), [], [], [], []
        for n in range(2, order + 1):
            begins = np.flatnonzero(left >= n)
            if n == 2:
                with np.errstate(over="ignore"):
                    key = flat.mix(self.hashes[sequence[begins]] * _STEP + self.hashes[sequence[begins + 1]]) >> _KEY_SHIFT
                self.keys, place, _, _ = flat.distinct(key)
                above = word = np.zeros(len(self.keys), np.int64)
            else:
                codes, place, _, _ = flat.distinct(self.entry[-1][begins] * len(self.hashes) + sequence[begins + n - 1])
                codes = codes.astype(np.int64)
                above, word = codes // len(self.hashes), codes % len(self.hashes)
            entry = np.full(len(self.row), -1)
            entry[begins] = place
            self.above.append(above)
            self.word.append(word)
            self.entry.append(entry)  # of the n-gram that begins at each padded word
            self.counted.append((local >= order - 1 - n) & (left >= n))  # those that end before a row's first word count once a row


def _squeezed(rows: DataFrame) -> DataFrame:
    """The rows with their texts as Zstandard frames, of which the shuffle moves less than of text."""

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            data, offsets = flat.flat(batch.column("text"))
            frames = [codec.compress(data[a:b], asbytes=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets)), pa.array(frames, pa.binary())], ["doc_id", "held_out", "block", "size", "frame"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "block", "text").mapInArrow(flat.tidy(run), f"doc_id {kind}, held_out boolean, block int, size long, frame binary")


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct word hashes, its tokens as places in them, and where each row's begin."""
    codec, sizes = pa.Codec("zstd"), table.column("size").to_numpy()
    parts = [codec.decompress(frame.as_buffer(), size, asbytes=True) if size else b"" for frame, size in zip(table.column("frame"), sizes.tolist(), strict=True)]
    offsets, found, places, at = np.concatenate([[0], np.cumsum(sizes)]), [], [np.zeros(1, np.int64)], 0
    data = np.frombuffer(b"".join(parts), np.uint8)
    del parts
    for low, high in flat.chunks(offsets):
        own, begins = tokens(*flat.part(data, offsets, low, high))
        found.append(own)
        places.append(at + begins[1:])
        at += len(own)
    words, ids, _, _ = flat.distinct(np.concatenate(found))
    return words, ids, np.concatenate(places)


def _asked(texts: DataFrame, parts: int, order: int) -> DataFrame:
    """(block, part, entries, words, pairs, kids, after, counts): each block's distinct n-grams by shard, with their training counts.

    entries: how many words, pairs, and n-grams of each further level; kids: how many each n-gram has below it; after: the last words.
    """

    def run(table: pa.Table) -> pa.Table:
        edges = _edges(parts)
        words, ids, places = _opened(table)
        taught = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        grams = Grams(words, ids, places, order)
        counts = [np.bincount(ids[np.repeat(taught, np.diff(places))], minlength=len(words))]
        taught = taught[grams.row]
        counts += [np.bincount(entry[counted & taught], minlength=len(above)) for entry, counted, above in zip(grams.entry, grams.counted, grams.above, strict=True)]
        short, last = words >> _KEY_SHIFT, grams.hashes >> _AFTER_SHIFT
        # Where each shard's slice of each level begins: what lies below a slice is a slice.
        cuts = [np.concatenate([[0], np.searchsorted(short, edges), [len(short)]])]
        if order > 1:
            cuts.append(np.concatenate([[0], np.searchsorted(grams.keys, edges), [len(grams.keys)]]))
        kids = []
        for n in range(2, order):
            cuts.append(np.searchsorted(grams.above[n - 1], cuts[n - 1]))
            kids.append(np.bincount(grams.above[n - 1], minlength=len(grams.above[n - 2])))
        sent = np.diff(np.array(cuts), axis=1)
        out: dict[str, list] = {k: [] for k in ("part", "entries", "words", "pairs", "kids", "after", "counts")}
        for p in np.flatnonzero(sent.sum(0)):
            at = [slice(c[p], c[p + 1]) for c in cuts]
            after = [last[grams.word[n - 1][at[n]]] for n in range(2, order)]
            values = (int(p), sent[:, p].astype("<i8").tobytes(), pack(short[at[0]]), pack(grams.keys[at[1]]) if order > 1 else b"", small(np.concatenate([k[a] for k, a in zip(kids, at[1:], strict=False)])) if kids else b"", bits_of(np.concatenate(after), AFTER_BITS) if after else b"", small(np.concatenate([c[a] for c, a in zip(counts, at, strict=True)])))
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        block = pa.array([table.column("block")[0].as_py()] * len(out["part"]), pa.int32())
        return pa.table([block, pa.array(out["part"], pa.int32()), *(pa.array(v, pa.binary()) for k, v in out.items() if k != "part")], names=["block", *out])

    return texts.groupBy("block").applyInArrow(run, "block int, part int, entries binary, words binary, pairs binary, kids binary, after binary, counts binary")


def shard(roots: np.ndarray, root_counts: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: np.ndarray, discount: float) -> trie.Trie:
    """The trie of the n-grams that the training texts have, from distinct ascending ones. Its codes: of each level's own parts, then of the rests that each level but the last leaves to shorter contexts.

    levels: (entry above, place in words, count) for each level below the first.
    """
    kept = np.flatnonzero(root_counts > 0)
    own, rests, made, size = [trie.quantised(root_counts[kept].astype(np.float64))], [], [], len(kept)
    at = np.full(len(roots), -1)
    at[kept] = np.arange(size)
    for above, word, count in levels:
        some = np.flatnonzero(count > 0)
        context = at[above[some]]
        follow = np.bincount(context, count[some], size)
        made.append((context, word[some]))
        own.append(trie.quantised((count[some] - discount) / follow[context]))
        rests.append(trie.quantised(np.where(follow > 0, discount * np.bincount(context, minlength=size) / np.maximum(follow, 1), 1.0)))
        size = len(some)
        at = np.full(len(above), -1)
        at[some] = np.arange(size)
    return trie.Trie(roots[kept], words, made, own + rests)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, where each value stands among them, and the sums of the counts."""
    found, place, order, first = flat.distinct(codes)
    return found, place, np.add.reduceat(counts[order], first) if len(first) else counts


def _answered(asked: DataFrame, order: int, discount: float) -> DataFrame:
    """(block, part, counts, codes): the corpus counts of the words that each block sent, and the codes of its n-grams, in the order of sending."""

    def run(table: pa.Table) -> pa.Table:
        rows, squeeze = table.num_rows, pa.Codec("zstd")  # most n-grams stand once, so most codes are alike
        sent = np.stack([np.frombuffer(x, "<i8") for x in table.column("entries").to_pylist()])
        counted = [numbers(x, int(n)) for x, n in zip(table.column("counts").to_pylist(), sent.sum(1), strict=True)]
        counts = [np.concatenate([c[a:b] for c, a, b in zip(counted, sent[:, :n].sum(1), sent[:, : n + 1].sum(1), strict=True)]) for n in range(order)]
        del counted
        _, place, total = _summed(np.concatenate([unpack(x) for x in table.column("words").to_pylist()]), counts[0])
        told = np.split(total[place], np.cumsum(sent[:-1, 0]))
        codes: list[list[np.ndarray]] = []
        if order > 1:
            roots, entry, root_counts = _summed(np.concatenate([unpack(x) for x in table.column("pairs").to_pylist()]), counts[1])
            entries, levels = [entry], []
            kids = [numbers(x, int(n)) for x, n in zip(table.column("kids").to_pylist(), sent[:, 1 : order - 1].sum(1), strict=True)]
            after = [from_bits(x, int(n), AFTER_BITS) for x, n in zip(table.column("after").to_pylist(), sent[:, 2:].sum(1), strict=True)]
            words, word, _, _ = flat.distinct(np.concatenate(after))
            word = np.split(word, np.cumsum(sent[:-1, 2:].sum(1)))
            for n in range(2, order):
                a, b = sent[:, 1 : n - 1].sum(1), sent[:, 1:n].sum(1)
                above = np.repeat(entry, np.concatenate([k[x:y] for k, x, y in zip(kids, a, b, strict=True)]))
                a, b = sent[:, 2:n].sum(1), sent[:, 2 : n + 1].sum(1)
                own = np.concatenate([w[x:y] for w, x, y in zip(word, a, b, strict=True)])
                found, entry, total = _summed(above * np.int64(max(1, len(words))) + own, counts[n])
                distinct = found.astype(np.int64)
                entries.append(entry)
                levels.append((distinct // max(1, len(words)), distinct % max(1, len(words)), total))
            del kids, after, word
            model = shard(roots, root_counts, levels, words, discount)
            # Every distinct n-gram that was sent is searched, context after context.
            at = model.root(roots)
            found = [at]
            for n, (above, own, _) in enumerate(levels):
                at = model.below(n, at[above], model.word(words)[own])
                found.append(at)
            for level, held in enumerate(model.codes):
                n = level % (order - 1)  # own parts of all levels, then rests of all but the last
                code = np.zeros(len(found[n]), np.uint16)
                code[found[n] >= 0] = held[found[n][found[n] >= 0]]
                codes.append(np.split(code[entries[n]], np.cumsum(sent[:-1, n + 1])))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "counts": pa.array([small(x) for x in told], pa.binary()), "codes": pa.array([squeeze.compress(b"".join(c[k].astype("<u2").tobytes() for c in codes), asbytes=True) for k in range(rows)], pa.binary()), "entries": table.column("entries")})

    return asked.groupBy("part").applyInArrow(run, "block int, part int, counts binary, codes binary, entries binary")


def _vocabulary(texts: DataFrame, parts: int) -> tuple[int, int]:
    """Training tokens, and distinct ones, over the corpus."""

    def packed(keys: np.ndarray, total: int) -> pa.RecordBatch:
        pieces = np.split(keys, np.searchsorted(keys, _edges(parts)))
        some = [p for p in range(parts) if len(pieces[p])]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total] + [0] * (len(some) - 1), pa.int64()), pa.array([pack(pieces[p]) for p in some], pa.binary())], ["part", "tokens", "keys"])

    def send(batches):
        known, total = np.zeros(0, np.uint64), 0
        for batch in batches:
            data, offsets = flat.flat(batch.column(0))
            for low, high in flat.chunks(offsets):
                own, _ = tokens(*flat.part(data, offsets, low, high))
                known, total = np.union1d(known, own >> _KEY_SHIFT), total + len(own)
                if len(known) > MOST_WORDS:  # what a task holds stays bounded
                    yield packed(known, total)
                    known, total = np.zeros(0, np.uint64), 0
        if total:
            yield packed(known, total)

    def count(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(k) for k in table.column("keys").to_pylist()])
        return pa.table({"tokens": pa.array([int(table.column("tokens").to_numpy().sum())]), "words": pa.array([len(np.unique(keys))])})

    sent = texts.filter("not held_out").select("text").mapInArrow(flat.tidy(send), "part int, tokens long, keys binary")
    row = sent.groupBy("part").applyInArrow(count, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    return row[0] or 0, row[1] or 0


def block_scores(grams: Grams, ids: np.ndarray, places: np.ndarray, counts: np.ndarray, own: list[np.ndarray], rests: list[np.ndarray], total: int, words: int, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token by single words, and by the model. counts: of the block's words; own, rests: codes of each level of its n-grams."""
    seen = counts[ids].astype(np.float64)
    chance = (seen + 1) / (total + words + 1)
    base = np.log10(chance)
    ends = np.searchsorted(grams.hashes[:-1], END)
    starts = counts[ends] if ends < len(counts) and grams.hashes[ends] == END else 0  # rows that taught
    before = np.append(starts, seen[:-1]) if len(seen) else seen
    before[places[:-1]] = starts
    for n, (code, entry) in enumerate(zip(own, grams.entry, strict=True)):
        at = entry[grams.token - (n + 1)]
        if n == 0:
            chance = (trie.counts(code)[at] + strength * chance) / (before + strength)
        else:
            rest = rests[n - 1]
            left = np.where(rest > 0, trie.shares(rest), 1.0)[grams.above[n]]  # a context that no training text has leaves all
            chance = trie.shares(code)[at] + left[at] * chance
    return base, np.log10(np.minimum(chance, 1.0))


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out: Column | None = None, order: int = ORDER, strength: float = STRENGTH, discount: float = DISCOUNT) -> DataFrame:
    """log10 probability of each row's whole text under the n-gram model, and under the base of single words.

    Learns from rows that aren't held_out (by default those whose crc32(identifier as text) mod 7 is not 2). Words are runs outside
    [\\x20\\x09-\\x0D], A-Z lower-cased; a text's last token is its end. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score. A null text counts as empty: one token, its end. A null identifier is not held out. Repeated rows each count
    and are scored; without training rows every token is unknown. Other columns are dropped, so their names can't clash.
    """
    held = F.coalesce(held_out if held_out is not None else remainder(F.col(id_column), 7) == 2, F.lit(False))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(1).cast("long"))).first()[0] or 0
    blocks, parts = max(1, math.ceil(size / BLOCK_BYTES)), max(1, math.ceil(size / PART_BYTES))
    total, words = _vocabulary(rows, parts)
    texts = _squeezed(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")))
    answers = _answered(_asked(texts, parts, order), order, discount)

    def run(block: pa.Table, answer: pa.Table) -> pa.Table:
        known, ids, places = _opened(block)
        grams = Grams(known, ids, places, order)
        pieces = answer.sort_by("part")
        sent = np.stack([np.frombuffer(x, "<i8") for x in pieces.column("entries").to_pylist()])
        counts = np.concatenate([numbers(x, int(n)) for x, n in zip(pieces.column("counts").to_pylist(), sent[:, 0], strict=True)])
        sizes = np.concatenate([sent[:, 1:], sent[:, 1:-1]], axis=1)
        told = [np.frombuffer(pa.Codec("zstd").decompress(x, 2 * int(n), asbytes=True), "<u2") if n else np.zeros(0, "<u2") for x, n in zip(pieces.column("codes").to_pylist(), sizes.sum(1), strict=True)]
        codes = [np.concatenate([c[a:b] for c, a, b in zip(told, sizes[:, :n].sum(1), sizes[:, : n + 1].sum(1), strict=True)]) for n in range(sizes.shape[1])]
        base, score = block_scores(grams, ids, places, counts, codes[: order - 1], codes[order - 1 :], total, words, strength)
        out = [pa.array(np.diff(places)), pa.array(np.add.reduceat((counts[ids] > 0).astype(np.int64), places[:-1])), pa.array(np.full(len(places) - 1, total, np.int64)), pa.array(np.add.reduceat(base, places[:-1])), pa.array(np.add.reduceat(score, places[:-1]))]
        return pa.table([block.column("doc_id"), block.column("held_out"), *out], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
