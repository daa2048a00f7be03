"""The join against all pairs, on made documents and on a table."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lakeloom.llm import jaccard

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[key] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    lists, parent = defaultdict(list), {k: k for k in sets}
    for key, s in sets.items():
        for x in s:
            lists[x].append(key)

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for key, s in sets.items():
        overlap = defaultdict(int)
        for x in s:
            for other in lists[x]:
                overlap[other] += other < key
        for other, o in overlap.items():
            if o and 100 * o >= 80 * (len(s) + len(sets[other]) - o):
                a, b = sorted((top(key), top(other)))
                parent[b] = a
    return {k: (len(s), top(k)) for k, s in sets.items()}


def made(seed):
    pick = random.Random(seed)
    words = lambda n: [f"w{pick.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        base = words(pick.choice([3, 7, 30, 80, 300]))
        for _ in range(pick.choice([1, 1, 2, 4, 13])):
            w = list(base)
            for _ in range(pick.choice([0, 1, 1, 2, 4])):
                w[pick.randrange(len(w))] = f"z{pick.randrange(10**6)}"
            texts.append(" ".join(w + [f"y{pick.randrange(10**6)}" for _ in range(pick.choice([0, 0, 2, 8, 20]))]))
    passage = [f"p{k}" for k in range(60)]
    texts += [" ".join(passage + words(pick.choice([5, 12, 13, 14, 15, 16, 60]))) for _ in range(60)]
    chain = [f"c{k}" for k in range(200)]
    for k in range(40):
        chain[pick.randrange(200)] = f"d{k}"
        texts.append(" ".join(chain))
    texts += ["", "  ", None, "a", "A", "a b c d", "a b c D"]
    rows = list(enumerate(texts))
    pick.shuffle(rows)
    return rows


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_made_documents(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 50)
    monkeypatch.setattr(jaccard, "PART_SHINGLES", 4000)
    rows = made(seed)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_without_hubs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB_TURNS", 0)
    rows = made(3)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
def test_table(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_one_of_each(spark):
    rows = made(4)
    kept = {r.doc_id for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {k for k, (_, c) in brute(rows).items() if k == c}


def test_many_texts_of_one_identifier(spark):
    """20,000 different texts of one identifier."""
    texts = [f"w{k} x{k} a b c d e" for k in range(20_000)]
    long = " ".join(f"l{k}" for k in range(100))
    rows = [(7, t) for t in [*texts, long]] + [(8, f"{long} more"), (3, "quite another text of its own"), (9, "w5 x5 a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.jaccard_components(df).collect()
    assert len(found) == len(rows) and {(r.doc_id, r.component_id) for r in found} == {(7, 7), (8, 7), (3, 3), (9, 7)}
    assert sorted(r.n_shingles for r in found) == sorted([3] * (len(texts) + 1) + [96, 97, 2])
    # Each text is a component of its own, but for the last two that link.
    kept = jaccard.one_of_each(df).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(7, t) for t in [*texts, long]] + [(3, "quite another text of its own")])


def test_repeated_rows_stay_once_and_the_same(spark):
    """Of rows that repeat identifier and text, and of texts of one set, one; of a row's texts that lead no component, none."""
    rows = [(1, "a b c d e f", s) for s in "xyz"] * 2 + [(1, "A B C D E F", "v"), (1, "g h i j k l m", "w"), (0, "g h i j k l m", "q"), (2, "", "e"), (2, "", "f"), (None, "a b c d e f", "n"), (None, "a b c d e f", "n")]
    runs = [sorted(((-1 if r.doc_id is None else r.doc_id, r.text.lower(), r.other) for r in jaccard.one_of_each(spark.createDataFrame(rows[::step], "doc_id long, text string, other string").repartition(parts)).collect())) for step, parts in ((1, 1), (-1, 3), (1, 4))]
    assert runs[0] == runs[1] == runs[2]
    assert [r[:2] for r in runs[0]] == [(-1, "a b c d e f")] * 2 + [(0, "g h i j k l m"), (1, "a b c d e f"), (2, "")]


def test_sets_are_distinct_by_their_values():
    values, bounds = jaccard.shingle_sets(np.frombuffer(b"a b c d e a b c d e a b c d e", np.uint8), np.array([0, 29]))
    assert len(values) == len(set(values.tolist())) == bounds[-1] == 5 and int(values.max()) < 1 << jaccard.HASH_BITS
