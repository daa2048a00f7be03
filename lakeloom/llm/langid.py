"""Language identification by prediction by partial matching over byte contexts.

Each language has its own tree of byte contexts of order 0 to 3: all that its training texts show LEAST_COUNT times. In a context a byte
that was seen has n / (N + U) of the probability, for N occurrences and U distinct bytes; the rest, U / (N + U), escapes to the next
shorter context, shared among the bytes that the longer one never saw (exclusion). Below order 0 all 256 bytes are alike. The statistics
are frozen after training, so an escape is a number of bits that a context adds, and a byte in a context that saw it another: a text's
code length in a language is a sum over all of its bytes, of the longest context that saw the byte and the escapes from those longer.
The shortest code wins.

A language is learned on the executors, from a sample of about TRAIN_ROWS texts, each of samples.TEXT_CHARS characters at most; so its
tree has a bounded size, whatever the input, and does not depend on the other languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import flat, pretokens
from lakeloom.llm.samples import remainder, training_sample

TRAIN_ROWS = 400
LEAST_COUNT = 4
ORDER = 3
WINDOW_BYTES = 1 << 17  # coded at once: what is held for each of its bytes takes far more than the byte
TOGETHER = 8  # languages whose trees share an index, so that a byte is looked up once for all of them
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True


@dataclass
class Tree:
    """A language's frozen statistics. A context's key is its bytes as a number, the last byte lowest; a pair's is the context's and the byte's."""

    pairs: list[np.ndarray]  # of each order: ascending keys of the bytes seen in kept contexts
    bits: list[np.ndarray]  # their code lengths
    contexts: list[np.ndarray]  # of each order: ascending keys of the kept contexts
    escapes: list[np.ndarray]  # bits that an escape from them adds


def keys(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each byte with the `order` bytes before it, and whether its row has so many before it."""
    out, inside = data.astype(np.uint32), np.ones(len(data), bool)
    starts = offsets[:-1][np.diff(offsets) > 0]
    for k in range(1, order + 1):
        out[k:] |= data[:-k].astype(np.uint32) << np.uint32(8 * k)
    for k in range(order):
        inside[np.minimum(starts + k, len(data) - 1)] = False  # a shorter row's place is in the next row, which it begins, or the last byte's
    if order and len(data):
        last = np.searchsorted(offsets, len(data) - 1, "right") - 1
        inside[-1] = len(data) - 1 - offsets[last] >= order
    return out, inside


def learn(texts: pa.Array, least: int = LEAST_COUNT) -> Tree:
    """The frozen tree of a language's texts."""
    data, offsets = flat.flat(texts)
    tree = Tree([], [], [], [])
    for order in range(ORDER + 1):
        own, inside = keys(data, offsets, order)
        pairs, counts = np.unique(own[inside], return_counts=True)
        context = pairs >> np.uint32(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(pairs)))
        totals = np.add.reduceat(counts, first) if len(pairs) else np.zeros(0, np.int64)
        kept = (totals >= least) if order else np.ones(len(first), bool)
        pairs, counts = pairs[np.repeat(kept, sizes)], counts[np.repeat(kept, sizes)]
        sizes, totals, contexts = sizes[kept], totals[kept], context[first][kept]
        # What the bytes that were seen have in the next shorter context, where each was seen too.
        lower = np.exp2(-tree.bits[-1][np.searchsorted(tree.pairs[-1], pairs & np.uint32((1 << 8 * order) - 1))].astype(np.float64)) if order else np.full(len(pairs), 1 / 256)
        left = np.maximum(0, 1 - np.add.reduceat(lower, np.cumsum(sizes) - sizes)) if len(pairs) else np.zeros(0)
        full = (sizes == 256) | (left < 1e-12)  # nothing is left to escape to
        escape = np.where(full, 0, sizes / (totals + sizes))
        tree.pairs.append(pairs)
        tree.bits.append(-np.log2(counts / np.repeat(totals, sizes) * np.repeat(1 - escape, sizes)).astype(np.float32))
        tree.contexts.append(contexts)
        tree.escapes.append(-np.log2(np.where(full, 1e-30, escape / np.where(full, 1, left))).astype(np.float32))
    return tree


class _Index:
    """Trees of some languages under one set of keys: a row of numbers a key, a column a language."""

    def __init__(self, trees: list[Tree]):
        self.pairs, self.bits, self.contexts, self.escapes = [], [], [], []
        for order in range(ORDER + 1):
            pairs, contexts = (np.unique(np.concatenate(x)) for x in ([t.pairs[order] for t in trees], [t.contexts[order] for t in trees]))
            escapes = np.zeros((len(contexts), len(trees)), np.float32)
            for column, tree in enumerate(trees):
                escapes[np.searchsorted(contexts, tree.contexts[order]), column] = tree.escapes[order]
            # A language that lacks a byte escapes from the context, if it has it, and takes what the shorter one says.
            shorter = self.bits[-1][np.searchsorted(self.pairs[-1], pairs & np.uint32((1 << 8 * order) - 1))] if order else np.full((len(pairs), len(trees)), 8, np.float32)
            bits = shorter + escapes[np.searchsorted(contexts, pairs >> np.uint32(8))] if len(pairs) else shorter
            for column, tree in enumerate(trees):
                bits[np.searchsorted(pairs, tree.pairs[order]), column] = tree.bits[order]
            self.pairs.append(pairs)
            self.bits.append(bits)
            self.contexts.append(contexts)
            self.escapes.append(escapes)

    @staticmethod
    def _at(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the wanted keys, and whether they are there."""
        if not len(known):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return at, known[at] == wanted

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language."""
        out = np.zeros((len(data), self.bits[0].shape[1]), np.float32)
        open_ = np.arange(len(data))  # bytes that no longer context saw
        for order in range(ORDER, -1, -1):
            own, inside = keys(data, offsets, order)
            able = open_[inside[open_]]
            at, there = self._at(self.pairs[order], own[able])
            out[able[there]] += self.bits[order][at[there]]
            missed = able[~there]
            at, kept = self._at(self.contexts[order], own[missed] >> np.uint32(8))
            out[missed[kept]] += self.escapes[order][at[kept]]
            open_ = np.sort(np.concatenate([missed, open_[~inside[open_]]]))
        out[open_] += 8  # no tree has the byte at all
        return out


class Model:
    def __init__(self, trees: dict[str, Tree]):
        self.trees, self.languages = trees, sorted(trees)
        self.indexes = [_Index([trees[x] for x in self.languages[k : k + TOGETHER]]) for k in range(0, len(self.languages), TOGETHER)]

    def __reduce__(self):
        return Model, (self.trees,)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row's whole text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for low in range(0, len(data), WINDOW_BYTES):
            begin, end = max(0, low - ORDER), min(len(data), low + WINDOW_BYTES)  # the bytes before the window are contexts only
            inner = np.clip(offsets, begin, end) - begin
            bounds = np.clip(offsets, low, end) - low
            some = np.flatnonzero(np.diff(bounds))
            for k, index in enumerate(self.indexes):
                bits = index.lengths(data[begin:end], inner)[low - begin :]
                out[some, k * TOGETHER : k * TOGETHER + bits.shape[1]] += np.add.reduceat(bits, bounds[some], axis=0, dtype=np.float64)
        return out


def fit(texts: dict[str, list[str]]) -> Model:
    """The trees of each language's texts."""
    return Model({lang: learn(pa.array(some, pa.string())) for lang, some in texts.items()})


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    count = flat.sums_by_row(_WORD_BYTES[data].astype(np.int64), offsets)
    for row in np.flatnonzero((count == 0) & (np.diff(offsets) > 0)):
        _, points = pretokens.code_points(data[offsets[row] : offsets[row + 1]])
        count[row] = (pretokens.classes()[points] == pretokens.LETTER).any()
    return count > 0


_PARTS = [f"{name}{order}" for name in ("pairs", "bits", "contexts", "escapes") for order in range(ORDER + 1)]


def _learned_tree(table: pa.Table) -> pa.Table:
    """A row of the frozen arrays of one language's sample."""
    tree = learn(table.column("text").combine_chunks())
    values = [x.tobytes() for part in (tree.pairs, tree.bits, tree.contexts, tree.escapes) for x in part]
    made = pa.table([table.column("lang").slice(0, 1), *(pa.array([v], pa.binary()) for v in values)], names=["lang", *_PARTS])
    del tree, values
    flat.give_back()
    return made


def learned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", held_out: int = 5) -> Model:
    """The model of rows whose crc32(identifier as text) mod held_out is not 0 and whose text and language are not null; a null identifier teaches."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    known = rows.filter(F.coalesce(remainder(F.col("doc_id"), held_out) != 0, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = training_sample(known, "lang", TRAIN_ROWS).select("lang", "text")
    found = sample.groupBy("lang").applyInArrow(_learned_tree, "lang string, " + ", ".join(f"{p} binary" for p in _PARTS)).collect()  # a row a language
    arrays = lambda row, name, kind: [np.frombuffer(row[f"{name}{order}"], kind) if row[f"{name}{order}"] else np.zeros(0, kind) for order in range(ORDER + 1)]
    return Model({r.lang: Tree(arrays(r, "pairs", np.uint32), arrays(r, "bits", np.float32), arrays(r, "contexts", np.uint32), arrays(r, "escapes", np.float32)) for r in found})


def batch_predictions(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    data, offsets = flat.flat(texts)
    names, scores = [], [np.zeros(0)]
    for low, high in flat.chunks(offsets, WINDOW_BYTES):
        some = flat.part(data, offsets, low, high)
        letters = has_letter(*some)
        if model.languages:
            bits = model.lengths(*some)
            names += [model.languages[b] if ok else "und" for b, ok in zip(bits.argmin(1), letters, strict=True)]
            scores.append(np.where(letters, 1 / np.exp2(np.maximum(-1000, bits.min(1, keepdims=True) - bits)).sum(1), 0.0))
        else:
            names += ["und"] * (high - low)
            scores.append(np.zeros(high - low))
    return names, np.concatenate(scores)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", held_out: int = 5) -> DataFrame:
    """Predicts the language of each row's whole text.

    Learns from rows that aren't held out (see learned); a prediction reads the text alone. Returns doc_id, held_out, lang_pred and
    score, the posterior of the predicted language under equal priors. lang_pred is `und`, and score 0, where the text is null or has no
    letter, and for every row if nothing can be learned. Of languages that code a text equally short, the first by name wins. Repeated
    rows stay; other columns are dropped, so their names can't clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, id_column, text_column, lang_column, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = batch_predictions(model.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder(F.col(id_column), held_out) == 0, F.lit(False))
    rows = docs.select(F.col(id_column).alias("doc_id"), held.alias("held_out"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(flat.tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows, whole and with all their columns, whose text has a language, told with a score of `least` or more."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, id_column, text_column, lang_column))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in flat.slices(batch, at):
                names, scores = batch_predictions(model.value, some.column(at))
                yield some.filter(pa.array(np.array([n != "und" for n in names], bool) & (scores >= least)))

    return docs.mapInArrow(flat.tidy(run), docs.schema)
