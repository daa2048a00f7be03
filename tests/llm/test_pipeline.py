"""The pipeline against a version that walks rows one by one over the operators' decisions."""

import math
import os

import pytest

import corpus_pipeline
from lakeloom.llm import bpe, langid, quality
from lakeloom.llm.queries import vocabulary
from tests.llm.test_jaccard import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality.score_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect() if r.predicted}
    rows = {k: r for k, r in rows.items() if k in good}
    told = {r.doc_id for r in langid.identify(spark.createDataFrame(list(rows.values()), docs.schema)).collect() if r.lang_pred != "und" and r.score >= 0.5}
    rows = {k: r for k, r in rows.items() if k in told}
    rows = {k: rows[k] for k, (_, component) in brute([(k, r.text) for k, r in rows.items()]).items() if k == component}
    copies = mixed(rows)
    found: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        found.setdefault(r.doc_id, []).append(r.ids)
    assert {k: len(v) for k, v in found.items()} == {k: n for k, n in copies.items() if n}
    codec = bpe.codec(vocabulary("byte_bpe_multi_50k.tiktoken"))
    for k, ids in found.items():
        assert all(i == codec.encode_text(rows[k].text) for i in ids)


def mixed(rows):
    """Copies of each row: a source's words in the order of digests, from the first again, up to its target."""
    import hashlib
    import re

    from tests.llm.test_mixing import filled

    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for k, r in rows.items()}
    sources = sorted({r.source for r in rows.values()})
    own = {s: sorted((k for k, r in rows.items() if r.source == s), key=lambda k: hashlib.md5(str(k).encode()).hexdigest()) for s in sources}
    totals = [sum(sizes[k] for k in own[s]) for s in sources]
    copies = {}
    for s, total, target in zip(sources, totals, filled(totals, [k % 3 + 1 for k in range(len(sources))]), strict=True):
        rounds, rest = divmod(math.floor(target + 0.5), total)
        for k in own[s]:
            taken = rounds * sizes[k] + min(sizes[k], max(0, rest))
            rest -= sizes[k]
            copies[k] = math.floor(taken / sizes[k] + 0.5)
    return copies
