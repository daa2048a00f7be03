"""The model against plain counting, and the trie against its own contents."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakeloom.llm import flat, lm, packed, trie


def texts(seed=0, count=120):
    pick = random.Random(seed)
    common = ["the", "The", "of", "and", "a", "in"]
    return [(k, " ".join(pick.choice(common) if pick.random() < 0.5 else f"w{pick.randrange(60)}" for _ in range(pick.choice([0, 1, 5, 40, 90])))) for k in range(count)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm, "PART_BYTES", 4000)
    rows, m, d = texts(), 7.0, 0.6
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), order=order, strength=m, discount=d).collect()}
    docs = {k: ["<s>"] * (order - 1) + re.findall(r"[^\x20\x09-\x0D]+", t.lower()) + ["</s>"] for k, t in rows}
    counts = Counter()
    for k, w in docs.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for n in range(1, order + 1):
                counts.update(tuple(w[i - n + 1 : i + 1]) for i in range(order - 1, len(w)))
            counts.update(("<s>",) * n for n in range(1, order))
    follow, kinds = Counter(), Counter()
    for gram, count in counts.items():
        if gram[-1] != "<s>":
            follow[gram[:-1]] += count
            kinds[gram[:-1]] += 1
    for n in range(1, order - 1):  # rows' starts are contexts of themselves
        kinds[("<s>",) * n] += 1
        follow[("<s>",) * n] += counts[("<s>",) * (n + 1)]
    total, words = sum(v for k, v in counts.items() if len(k) == 1 and k != ("<s>",)), sum(len(k) == 1 and k != ("<s>",) for k in counts)
    for k, w in docs.items():
        score = base = 0.0
        for i in range(order - 1, len(w)):
            p = (counts[(w[i],)] + 1) / (total + words + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                gram = tuple(w[i - n + 1 : i + 1])
                c = gram[:-1]
                if n == 2:
                    p = (counts[gram] + m * p) / (counts[c] + m)
                elif follow[c]:
                    p = max(counts[gram] - d, 0) / follow[c] + d * kinds[c] / follow[c] * p
            score += math.log10(p)
        r, own = got[k], w[order - 1 :]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(counts[(x,)] > 0 for x in own), total, zlib.crc32(str(k).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, abs=1e-3 * len(own))


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id long, text string")
    for r in lm.score_documents(docs).collect():
        assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


@pytest.mark.parametrize("top", [1, 70, 5000, 1 << 40, 1 << 62])
def test_elias_fano(top):
    random_ = np.random.default_rng(top)
    for size in (0, 1, 2, 63, 64, 65, 1000):
        values = np.sort(random_.integers(0, top, size))
        if size > 100:
            values[200:400] = values[200]  # a large bucket
            values[400:600] = values[400] + np.arange(200) * (top > 5000)
            values.sort()
        coded = trie.elias_fano(values)
        sequence = trie.Sequence(coded)
        assert (sequence.read(np.arange(size)) == values.astype(np.uint64)).all()
        wanted = np.concatenate([values, values + 1, np.maximum(values, 1) - 1, random_.integers(0, top, 300), [0, top, top + 77]])
        at, same = sequence.successor(wanted)
        assert (at == np.searchsorted(values, wanted)).all() and (same == np.isin(wanted, values)).all()
        if size == 1000 and top > 5000:
            assert sum(a.nbytes for a in coded[1:3]) * 8 < size * (math.log2(top / size) + 4)


def test_order():
    random_ = np.random.default_rng(2)
    for top in (1, 9, 1 << 40, 1 << 63):
        for size in (0, 1, 2, 3000):
            values = random_.integers(0, top, size, dtype=np.uint64, endpoint=True)
            values[: size // 2] = values[size - size // 2 :] ^ np.uint64(top > 9)  # close ones
            order, found = flat.ordered(values)
            assert (order == np.argsort(values, kind="stable")).all() and (found == np.sort(values)).all()
            distinct, place, _, first = flat.distinct(values)
            assert (distinct[place] == values).all() and (distinct == np.unique(values)).all() and len(first) == len(distinct)


def test_codes():
    for values, read in ((10.0 ** -np.linspace(0, 15, 200), trie.shares), (10.0 ** np.linspace(0, 15, 200), trie.counts)):
        assert read(trie.quantised(values)) == pytest.approx(values, rel=4e-4)
        assert read(trie.quantised(np.zeros(1)))[0] == 0


def test_successors_stay_in_their_context():
    context, word = np.array([0, 0, 2, 2, 2, 3]), np.array([1, 3, 0, 1, 3, 0])
    made = trie.Trie(np.array([5, 9, 11, 70]), np.array([2, 4, 8, 16]), [(context, word)], [np.zeros(4, np.uint16), np.arange(6, dtype=np.uint16)])
    assert made.root(np.array([9, 10, 70, 71, 5])).tolist() == [1, -1, 3, -1, 0] and made.word(np.array([16, 3, 2])).tolist() == [3, -1, 0]
    pairs = [(c, w) for c in range(-1, 4) for w in range(-1, 4)]
    want = {p: k for k, p in enumerate(zip(context.tolist(), word.tolist(), strict=True))}
    assert made.below(0, np.array([c for c, _ in pairs]), np.array([w for _, w in pairs])).tolist() == [want.get(p, -1) for p in pairs]
    assert made.codes[1].tolist() == [*range(6)]


def test_counts_beyond_32_bits():
    values = np.array([0, 3, 254, 255, 5_000_000_000, 1 << 40])
    assert (packed.numbers(packed.small(values), len(values)) == values).all()


def test_a_text_that_stands_twice_scores_higher(spark):
    """Texts of words of their own; every fifth stands twice."""
    rows = [(3 * k + twin, " ".join(f"w{k}x{n}" if n % 3 else "the" for n in range(60))) for k in range(60) for twin in ([0, 1] if k % 5 == 0 else [0])]
    taught = {r.doc_id: r.score / r.n_tokens for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r.held_out}
    twice = [v for k, v in taught.items() if k // 3 % 5 == 0 and {3 * (k // 3), 3 * (k // 3) + 1} <= taught.keys()]
    assert min(twice) > max(v for k, v in taught.items() if k // 3 % 5)


def test_packed_keys():
    random_ = np.random.default_rng(1)
    for size in (0, 1, 2, 500):
        for bits in (1, 20, 64):
            keys = np.sort(random_.integers(0, 1 << bits, size, dtype=np.uint64, endpoint=False) if bits < 64 else random_.integers(0, np.iinfo(np.uint64).max, size, dtype=np.uint64))
            assert (packed.unpack(packed.pack(keys)) == keys).all()
