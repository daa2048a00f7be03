import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import mixing


def filled(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    total, stopped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in stopped)
        open_ = [k for k in range(len(sizes)) if k not in stopped]
        by = sum(weights[k] for k in open_)
        targets = [most * sizes[k] if k in stopped else left * weights[k] / by for k in range(len(sizes))]
        above = {k for k in open_ if targets[k] > most * sizes[k]}
        if not above:
            return targets
        stopped |= above


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=9))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = filled(sizes, [k % 3 + 1 for k in range(len(sizes))])
    assert [found[f"s{k}"] for k in range(len(sizes))] == pytest.approx(want)


@pytest.fixture(scope="module")
def mix(spark):
    pick = random.Random(1)
    rows = [(k, " ".join(["w"] * pick.choice([0, 1, 7, 50, 400])), pick.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mix_sources(docs)
    return rows, docs, made, [r.asDict() for r in made.documents.collect()]


def test_taken_meets_targets(mix):
    rows, _, _, found = mix
    assert len(found) == len(rows)
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)


def test_reruns_agree(mix):
    _, docs, _, found = mix
    again = [r.asDict() for r in mixing.mix_sources(docs.repartition(7)).documents.collect()]
    key = lambda r: r["doc_id"]
    assert sorted(again, key=key) == sorted(found, key=key)


def test_schedule_keeps_shares_all_along(mix):
    """After any number of slots each source has had its share, to within a few slots."""
    _, _, made, _ = mix
    slots = sorted(made.schedule.collect(), key=lambda r: r.slot)
    assert len({r.slot for r in slots}) == len(slots)  # a total order
    total = made.schedule.count()
    share = {s: sum(r.source == s for r in made.schedule.collect()) / total for s in {r.source for r in slots}}
    had = dict.fromkeys(share, 0)
    for n, r in enumerate(slots, 1):
        had[r.source] += 1
        if n % 97 == 0:
            assert all(abs(had[s] - n * share[s]) <= 3 + math.log(n) for s in share)


def test_whole_documents(spark, mix):
    _, docs, _, found = mix
    want = {r["doc_id"]: math.floor(r["taken"] / max(1, r["size"]) + 0.5) for r in found}
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: n for k, n in want.items() if n}
