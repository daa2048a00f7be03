"""Held-out accuracy of the learned operators, and their pieces against plain versions."""

import functools
import math
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import flat, langid, quality, queries, samples

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@tables
def test_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    held = queries.op9_language(spark, FOLDER).filter("held_out").join(docs, "doc_id").collect()
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


@tables
def test_quality(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    held = queries.op10_quality(spark, FOLDER).filter("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


@tables
def test_reruns_agree(spark):
    key = lambda r: r.doc_id
    for query in (queries.op9_language, queries.op10_quality):
        assert sorted(query(spark, FOLDER).collect(), key=key) == sorted(query(spark, FOLDER).collect(), key=key)


def walked(texts, text, least):
    """Code length of a text by prediction by partial matching, byte by byte from raw counts."""
    counts = defaultdict(Counter)
    for t in (t.encode() for t in texts):
        for i in range(len(t)):
            for n in range(min(i, 3) + 1):
                counts[t[i - n : i]][t[i]] += 1
    counts = {c: found for c, found in counts.items() if not c or found.total() >= least}

    @functools.cache
    def chance(context, byte):
        lower = (lambda b: chance(context[1:], b)) if context else (lambda b: 1 / 256)
        seen = counts.get(context)
        if not seen:
            return lower(byte)
        left = 1 - sum(lower(b) for b in seen)
        total, kinds = seen.total(), len(seen)
        if left < 1e-12:
            return seen[byte] / total if byte in seen else 1e-30
        return seen[byte] / (total + kinds) if byte in seen else kinds / (total + kinds) * lower(byte) / left

    own = text.encode()
    return sum(-math.log2(chance(own[max(0, i - 3) : i], own[i])) for i in range(len(own)))


@pytest.mark.parametrize("least", [1, 3])
def test_code_lengths_from_raw_counts(least):
    pick = random.Random(3)
    texts = {"a": ["the cat sat on the mat. ", "the hat", "", "x"], "b": ["der Hund lag auf der Matte, \u00f6fter. " * 3], "c": ["".join(chr(pick.randrange(1, 0x800)) for _ in range(3000))], "d": [""], "e": ["\u65e5\u672c\u8a9e\u65e5\u672c"]}
    model = langid.Model({k: langid.learn(pa.array(v), least) for k, v in texts.items()})
    rows = ["the hound sat", "", "\u00f6fter \u00f6fter der", "zzz", "a", "\u65e5\u672c\u8a9e", "th", "\U0001f600", texts["c"][0][:50]]
    for text, got in zip(rows, model.lengths(*flat.flat(pa.array(rows))), strict=True):
        assert got == pytest.approx([walked(texts[k], text, least) for k in model.languages], rel=1e-4)


def test_probabilities_add_up():
    model = langid.fit({"a": ["the cat sat on the mat. " * 9]})
    for before in ("the", "at ", "xyz", "", "t"):
        rows = [before.encode() + bytes([b]) for b in range(256)]
        bits = model.lengths(np.frombuffer(b"".join(rows), np.uint8), np.arange(257) * (len(before) + 1))[:, 0] - model.lengths(*flat.flat(pa.array([before])))[0, 0]
        assert np.exp2(-bits).sum() == pytest.approx(1, abs=1e-4)


def test_any_number_of_languages(spark):
    """More than 256, with scripts of more than 126 different bytes in all."""
    rows = [(k, " ".join(chr(0x4E00 + 3 * k + j) * 3 for j in (0, 1, 2, 0, 1, 0)) * 4, f"l{k:03}") for k in range(300) for _ in range(2)]
    rows = [(2 * n, text, lang) for n, (_, text, lang) in enumerate(rows)]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    taught = {lang for k, _, lang in rows if not found[k].held_out}
    assert len(taught) > 256 and all(found[k].lang_pred == lang for k, _, lang in rows if lang in taught)


def test_samples_are_bounded(spark):
    """By rows and by characters, with null and repeated identifiers, repeated rows and long texts."""
    rows = [(None, f"text {k}", "a") for k in range(2000)] + [(7, f"other {k}", "a") for k in range(2000)] + [(8, "same", "b")] * 3000 + [(k, "x" * 100 + str(k), "c") for k in range(9)]
    rows += [(1, "".join(map(str, range(20_000))), "d")]
    sample = samples.training_sample(spark.createDataFrame(rows, "doc_id long, text string, class string"), "class", 400, 1000).collect()
    count = Counter(r["class"] for r in sample)
    assert 300 < count["a"] < 500 and count["b"] == 1 and (count["c"], count["d"]) == (9, 1)
    assert max(len(r.text) for r in sample) == 1000 and all(r.text in rows[-1][1] for r in sample if r["class"] == "d")


def test_letters():
    data, offsets = flat.flat(pa.array(["", "12 .", "é", "日", "½", "a1"]))
    assert langid.has_letter(data, offsets).tolist() == [False, False, True, True, False, True]


def test_passages():
    texts = ["", "a " * 100, "Ab1! " * 48, " x"]
    x, firsts = quality.passages(*flat.flat(pa.array(texts)))
    assert np.diff(firsts).tolist() == [1, 3, 1, 1]
    assert not x[0].any() and x[1, 256] == pytest.approx(47 / 48) and x[1, 258] == pytest.approx(1 / 16) and x[3, 262] == pytest.approx(4 / 48)
    assert (x[4, :256] ** 2).sum() == pytest.approx(1)


def test_forward_pass():
    """Against the published gated attention, a passage and a number at a time."""
    picked = np.random.default_rng(5)
    bags = [2, 1, 4]
    x, firsts = picked.standard_normal((7, quality.FEATURES)), np.concatenate([[0], np.cumsum(bags)])
    model = quality.fit(x, firsts, np.array([1.0, 0.0, 1.0]))
    w = model.weights
    for got, low, high in zip(model.scores(x, firsts), firsts[:-1], firsts[1:], strict=True):
        codes, logits = [], []
        for row in range(low, high):
            scaled = [min(6, max(-6, (x[row, j] - model.mean[j]) / model.scale[j])) for j in range(quality.FEATURES)]
            code = [math.tanh(sum(scaled[j] * w["encode"][j, h] for j in range(quality.FEATURES)) + w["encode0"][h]) for h in range(quality.HIDDEN)]
            logit = 0.0
            for g in range(quality.GATES):
                value, gate = (sum(code[h] * w[part][h, g] for h in range(quality.HIDDEN)) for part in ("value", "gate"))
                logit += w["attend"][g] * math.tanh(value) / (1 + math.exp(-gate))
            codes.append(code)
            logits.append(logit)
        total = sum(map(math.exp, logits))
        bag = [sum(math.exp(a) / total * code[h] for a, code in zip(logits, codes, strict=True)) for h in range(quality.HIDDEN)]
        assert got == pytest.approx(1 / (1 + math.exp(-sum(b * s for b, s in zip(bag, w["score"], strict=True)) - w["score0"][0])), rel=1e-4)


def test_a_repeated_identifier_teaches_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 50)
    docs = spark.createDataFrame([(1, f"good words here {k}") for k in range(3000)] + [(2, "@@@ ### !!")] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    taught = []
    monkeypatch.setattr(quality, "fit", lambda x, firsts, labels: taught.append(len(labels)))
    quality.learned(docs, labels)
    assert len(taught) == 1 and 20 < taught[0] < 100


def test_gradients():
    random_ = np.random.default_rng(0)
    firsts, labels = np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])
    x = random_.standard_normal((7, quality.FEATURES))
    model = quality.fit(np.float64(x), firsts, labels)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    importance = np.array([1.0, 2.0, 0.5])

    def loss():
        score = model.scores(x, firsts)
        return -(importance * (labels * np.log(score) + (1 - labels) * np.log(1 - score))).mean()

    grads = quality._gradients(model, x, firsts, labels, importance)
    for name, weight in model.weights.items():
        at = tuple(random_.integers(0, n) for n in weight.shape)
        kept, step = weight[at], 1e-5
        weight[at] = kept + step
        up = loss()
        weight[at] = kept - step
        down = loss()
        weight[at] = kept
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


def test_attention_finds_the_one_bad_passage():
    """Bags are bad for one passage among many; the weight goes to it."""
    random_ = np.random.default_rng(1)
    x, firsts, labels = [], [0], []
    for k in range(200):
        bag = random_.standard_normal((12, quality.FEATURES)).astype(np.float32) * 0.1
        if k % 2:
            bag[random_.integers(0, 12), :20] += 2
        x.append(bag)
        firsts.append(firsts[-1] + 12)
        labels.append(1.0 - k % 2)
    model = quality.fit(np.concatenate(x), np.array(firsts), np.array(labels, np.float32))
    score = model.scores(np.concatenate(x), np.array(firsts))
    assert ((score > 0.5) == (np.array(labels) > 0)).mean() > 0.97


MEMORY = """
import re
from types import SimpleNamespace as Some
import numpy as np
import pyarrow as pa
from lakeloom.llm import langid

texts = ["".join(map(chr, np.random.default_rng(k).integers(97, 123, 9000))) for k in range(2000)]
model = langid.fit({lang: texts[k * 20 : k * 20 + 20] for k, lang in enumerate("abcdefgh")})
langid.learned = lambda *a: model
run = langid.keep_known(Some(columns=["text"], schema=None, sparkSession=Some(sparkContext=Some(broadcast=lambda x: Some(value=x))), mapInArrow=lambda run, _: run), least=0.0)
batch = pa.RecordBatch.from_pydict({"text": texts})
[*run(iter([batch.slice(0, 1)]))]
held = lambda what: int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
open("/proc/self/clear_refs", "w").write("5")
before, rows, largest = held("VmRSS"), 0, 0
for out in run(iter([batch])):
    rows, largest = rows + out.num_rows, max(largest, out.nbytes >> 20)
print("FOUND", rows, largest, held("VmHWM") - before)
"""


def test_a_worker_that_filters_stays_small():
    """Megabytes that a filter of 18 MB of texts takes above the batch it was given, and those of the largest batch that it gives."""
    found = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.getcwd()})
    rows, largest, above = map(int, found.stdout.split("FOUND")[1].split())
    assert rows == 2000
    assert largest <= 1
    assert above < 60


def test_windows(monkeypatch):
    """Code lengths don't depend on where the windows end."""
    model = langid.fit({"a": ["one two three four"] * 5, "b": ["eins zwei drei vier"] * 5})
    texts = pa.array(["one two", "", None, "x", "drei vier fünf " * 9, "ab", "four"])
    whole = model.lengths(*flat.flat(texts))
    for size in (3, 4, 7, 64):
        monkeypatch.setattr(langid, "WINDOW_BYTES", size)
        assert np.allclose(model.lengths(*flat.flat(texts)), whole, rtol=1e-12, atol=0)


def test_what_a_worker_holds_for_another_operator_goes():
    dropped = []
    drop = lambda: dropped.append(1)
    holding, other = flat.tidy(iter, drop), flat.tidy(iter)
    assert [*holding([1])] == [1] and [*holding([2])] == [2] and not dropped
    assert [*other([3])] == [3] and dropped == [1]
    assert [*other([4])] == [4] and dropped == [1]
