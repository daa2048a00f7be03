"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words, all of them. A passage is described by the shares of its pairs of
neighbouring byte kinds and a few shares of its words, and encoded by a small hidden layer. Gated attention, learned from
document labels alone, weighs the passages; the weighted mean of their codes gives the document's score.

The model is fitted by gradient descent on the driver, on a sample of about TRAIN_ROWS labelled documents a label at most, each of
samples.TEXT_CHARS characters at most, whose passages are described on the executors; its parameters are a few thousand numbers whatever
the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import flat
from lakeloom.llm.samples import remainder, training_sample

TRAIN_ROWS = 1500
PASSAGE_WORDS = 48
HIDDEN = 24
GATES = 12
EPOCHS = 30
BATCH = 64
RATE = 0.01
DECAY = 1e-4
THRESHOLD = 0.3
SCORED_BYTES = 1 << 18  # described at once


def _kinds() -> np.ndarray:
    """A kind of each byte, of 16."""
    kind = np.full(256, 15, np.uint8)
    kind[:32], kind[128:] = 14, 0
    for k, bytes_ in enumerate([b"", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" ", b"\n\r\t", b".", b",;:", b"!?", b"'\"-()", b"#$%&*@", b"|<>[]{}\\/_=+~^`"]):
        kind[list(bytes_)] = k
    return kind


KIND = _kinds()
FEATURES = 256 + 8


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and where each row's passages begin (rows + 1). A row without words has one passage of zeros."""
    starts, ends, bounds = flat.words(data, offsets)
    counts = np.diff(bounds)
    bags = np.maximum(1, -(-counts // PASSAGE_WORDS))
    firsts = np.concatenate([[0], np.cumsum(bags)])
    total = firsts[-1]
    out = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return out, firsts
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(starts)) - bounds[row]
    passage = firsts[row] + within // PASSAGE_WORDS
    sizes = np.bincount(passage, minlength=total)
    # Bytes from a passage's first word to the next passage are its own.
    opens = np.flatnonzero(within % PASSAGE_WORDS == 0)
    owner = np.zeros(len(data), np.int32)
    owner[starts[opens]] = np.diff(np.concatenate([[0], passage[opens]]))
    owner = np.cumsum(owner, dtype=np.int64)
    kind = KIND[data].astype(np.int64)
    inside = owner[:-1] == owner[1:]
    pairs = (owner[:-1] * 256 + kind[:-1] * 16 + kind[1:])[inside]
    shares = np.bincount(pairs, minlength=total * 256).reshape(total, 256).astype(np.float32)
    out[:, :256] = np.sqrt(shares / np.maximum(1, shares.sum(1, keepdims=True)))
    own = flat.hashes(data, starts, ends)
    many = np.maximum(1, sizes)
    same = np.zeros(len(own), bool)
    same[1:] = (own[1:] == own[:-1]) & (passage[1:] == passage[:-1])
    # Distinct words: sort by passage, then hash.
    order = np.argsort((passage.astype(np.uint64) << np.uint64(40)) | (own >> np.uint64(24)), kind="stable")
    again = (own[order][1:] == own[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    repeats = np.bincount(passage[order][1:][again], minlength=total)
    long_ = (ends - starts).astype(np.float64)
    mean = np.bincount(passage, long_, total) / many
    for k, value in enumerate([np.bincount(passage, same, total) / many, repeats / many, mean / 16, np.bincount(passage, long_ > 20, total) / many, np.bincount(passage, long_ < 2, total) / many, np.sqrt(np.maximum(0, np.bincount(passage, long_**2, total) / many - mean**2)) / 16, sizes / PASSAGE_WORDS, sizes > 0]):
        out[:, 256 + k] = np.where(sizes > 0, value, 0)
    return out, firsts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
        w, starts, sizes = self.weights, firsts[:-1], np.diff(firsts)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        code = np.tanh(x @ w["encode"] + w["encode0"])
        value, gate = np.tanh(code @ w["value"]), 1 / (1 + np.exp(-(code @ w["gate"])))
        logit = (value * gate) @ w["attend"]
        raised = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), sizes))
        weight = raised / np.repeat(np.add.reduceat(raised, starts), sizes)
        bag = np.add.reduceat(code * weight[:, None], starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(bag @ w["score"] + w["score0"][0], -30, 30)))
        return {"x": x, "code": code, "value": value, "gate": gate, "weight": weight, "bag": bag, "score": score}

    def scores(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return self.forward(x, firsts)["score"].astype(np.float64)


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the columns, by small parts; a deviation is never 0."""
    total, squares = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for low in range(0, len(x), 4096):
        some = x[low : low + 4096].astype(np.float64)
        total += some.sum(0)
        squares += (some * some).sum(0)
    mean = total / len(x)
    return mean.astype(np.float32), (np.sqrt(np.maximum(0, squares / len(x) - mean**2)) + 0.02).astype(np.float32)


def fit(x: np.ndarray, firsts: np.ndarray, labels: np.ndarray, seed: int = 0) -> Model:
    """Gated attention over passages, by Adam on the mean logistic loss of bags, labels weighed alike."""
    random = np.random.default_rng(seed)
    mean, scale = _moments(x)

    def start(*shape: int) -> np.ndarray:
        return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    weights = {"encode": start(FEATURES, HIDDEN) * 0.5, "encode0": np.zeros(HIDDEN, np.float32), "value": start(HIDDEN, GATES), "gate": start(HIDDEN, GATES), "attend": start(GATES), "score": start(HIDDEN), "score0": np.zeros(1, np.float32)}
    model = Model(mean, scale, weights)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step = 0
    share = np.clip(labels.mean(), 0.05, 0.95)
    importance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            bags = order[low : low + BATCH]
            rows = np.concatenate([np.arange(firsts[b], firsts[b + 1]) for b in bags])
            sizes = firsts[bags + 1] - firsts[bags]
            local = np.concatenate([[0], np.cumsum(sizes)])
            grads = _gradients(model, x[rows], local, labels[bags], importance[bags])
            step += 1
            for k, g in grads.items():
                g = g + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _gradients(model: Model, x: np.ndarray, firsts: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
    w, s, sizes = model.weights, model.forward(x, firsts), np.diff(firsts)
    error = (s["score"] - labels) * importance / len(labels)
    to_bag = np.repeat(error[:, None] * w["score"], sizes, axis=0)
    to_weight = (to_bag * s["code"]).sum(1)
    mean = np.repeat(np.add.reduceat(s["weight"] * to_weight, firsts[:-1]), sizes)
    to_logit = s["weight"] * (to_weight - mean)
    gated = s["value"] * s["gate"]
    to_value = to_logit[:, None] * w["attend"] * s["gate"] * (1 - s["value"] ** 2)
    to_gate = to_logit[:, None] * w["attend"] * gated * (1 - s["gate"])
    to_code = (s["weight"][:, None] * to_bag + to_value @ w["value"].T + to_gate @ w["gate"].T) * (1 - s["code"] ** 2)
    return {"encode": s["x"].T @ to_code, "encode0": to_code.sum(0), "value": s["code"].T @ to_value, "gate": s["code"].T @ to_gate, "attend": gated.T @ to_logit, "score": s["bag"].T @ error, "score0": error.sum(keepdims=True)}


def learned(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", held_out: int = 5) -> Model | None:
    """The model of labelled rows whose crc32(identifier as text) mod held_out is not 0; None without labels of both kinds.

    Labels that are null, or given for one identifier with both values, don't teach.
    """
    known = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    known = known.filter(remainder(F.col("doc_id"), held_out) != 0).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).filter("label = top").drop("top")
    # The labels are sampled by identifier first, so that few enough are broadcast; then the rows that have them.
    sample = F.broadcast(training_sample(known.withColumn("text", F.lit("")), "label", TRAIN_ROWS).select(F.col("doc_id").alias("_id"), "label"))  # about TRAIN_ROWS rows a label
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    taught = training_sample(rows.join(sample, F.col("doc_id") == F.col("_id")).drop("_id"), "label", TRAIN_ROWS)
    found = taught.select("_point", "doc_id", "label", "text").mapInArrow(flat.tidy(_described), "_point double, doc_id string, label int, bags int, features binary").toArrow().sort_by([("_point", "ascending"), ("doc_id", "ascending")])
    if len(found.column("label").unique()) < 2:
        return None
    firsts = np.concatenate([[0], np.cumsum(found.column("bags").to_numpy())])
    x = np.empty((firsts[-1], FEATURES), np.float32)
    for low, high, features in zip(firsts[:-1], firsts[1:], found.column("features"), strict=True):
        x[low:high] = np.frombuffer(features.as_buffer(), np.float32).reshape(-1, FEATURES)
    labels_ = found.column("label").to_numpy().astype(np.float32)
    del found
    return fit(x, firsts, labels_)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each row's passages, one after another."""
    for batch in batches:
        data, offsets = flat.flat(batch.column(3))
        for low, high in flat.chunks(offsets, flat.CHUNK_BYTES // 2):
            x, firsts = passages(*flat.part(data, offsets, low, high))
            some = batch.slice(low, high - low)
            columns = [some.column(0), some.column(1).cast(pa.string()), some.column(2), pa.array(np.diff(firsts), pa.int32()), pa.array([x[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_point", "doc_id", "label", "bags", "features"])


def batch_scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    data, offsets = flat.flat(texts)
    scores = [np.zeros(0)]
    for low, high in flat.chunks(offsets, SCORED_BYTES):
        scores.append(model.scores(*passages(*flat.part(data, offsets, low, high))) if model else np.full(high - low, 0.5))
    return np.concatenate(scores)


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", held_out: int = 5) -> DataFrame:
    """Scores each row's whole text for quality.

    Learns from labelled rows (see learned); a score reads the text alone. Returns doc_id, held_out, score (0 to 1, higher: label 1
    likelier) and predicted (1 if the score is at least THRESHOLD). A null text counts as empty, which has one passage without words and
    a score as any other. Without labels of both kinds every score is 0.5. Repeated rows and null identifiers stay; other columns are
    dropped, so their names can't clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, id_column, text_column, label_column, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch_scores(model.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(F.col(id_column), held_out) == 0, F.lit(False))
    rows = docs.select(F.col(id_column).alias("doc_id"), held.alias("held_out"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(flat.tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """The rows, whole and with all their columns, whose score is at least THRESHOLD."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, id_column, text_column, label_column))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in flat.slices(batch, at):
                yield some.filter(pa.array(batch_scores(model.value, some.column(at)) >= THRESHOLD))

    return docs.mapInArrow(flat.tidy(run), docs.schema)
