"""Token counts and encodings against the public libraries; the pattern against its regular expression."""

import base64
import hashlib
import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeloom.llm import bpe, flat, pretokens, tokens

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a", "'s's 's  's \n's x'll'll''s !'s 'sabc", "  \n\n x", "x  ", "\t\ta  b  c　", "it's we've 1² ½x ñé 日本 3日 <|endoftext|>  <|endoftext|>a", "a<|endoftext|> b", "aaaa" * 50, " " * 40 + "x", "\x85a\x1cb", "'LL 'Re 're", "\U0001f600'd \U0001f468‍", "x" * 5000]
TEXT = st.text(st.one_of(st.sampled_from("'sdmtrevl \n\taA1.!é½日  \U0001f600"), st.characters(codec="utf-8")), max_size=40)


def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=300, deadline=None)
def test_pattern(texts):
    data, offsets = flat.flat(pa.array(texts, pa.string()))
    want = [m.group().encode() for t in texts for m in regex.finditer(public_tokenizers.PATTERN, t)]
    bounds = np.append(pretokens.starts(data, offsets), len(data))
    held = data.tobytes()
    assert [held[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


@given(st.lists(TEXT, min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_counts_and_ids(texts):
    whole = Tokenizer.from_file(JSON) if not hasattr(test_counts_and_ids, "whole") else test_counts_and_ids.whole
    test_counts_and_ids.whole = whole
    assert list(tokens.counter(JSON).rows(*flat.flat(pa.array(texts)))) == [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]
    codec = bpe.codec(RANKS)
    for text in texts:
        ids = codec.encode_text(text)
        assert ids == REFERENCE.encode_ordinary(text) and codec.decode(ids) == text.encode()


REFERENCE = reference()


def test_odd_texts():
    whole = Tokenizer.from_file(JSON)
    assert list(tokens.counter(JSON).rows(*flat.flat(pa.array(ODD)))) == [len(e.ids) for e in whole.encode_batch(ODD, add_special_tokens=False)]
    for text in ODD:
        assert bpe.codec(RANKS).encode_text(text) == REFERENCE.encode_ordinary(text)


def test_joined_vocabulary_entries():
    """Byte strings made of tokens, where greedy matches are often wrong."""
    random = np.random.default_rng(0)
    parts = list(bpe.codec(RANKS).ranks)
    for _ in range(3000):
        raw = b"".join(parts[k] for k in random.integers(0, len(parts), random.integers(1, 5)))
        text = raw.decode("utf-8", "ignore")
        assert bpe.codec(RANKS).encode_text(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("size", [5, 1 << 20])
def test_queries(spark, monkeypatch, size):
    monkeypatch.setattr(flat, "CHUNK_BYTES", size)
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    found = {r.doc_id: r for r in bpe.encode_documents(docs, RANKS).collect()}
    counts = {r.doc_id: r for r in tokens.count_tokens(docs, JSON).collect()}
    for k, text in enumerate(ODD):
        ids = REFERENCE.encode_ordinary(text)
        assert found[k].ids == ids and found[k].n_tokens == len(ids)
        assert found[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert counts[k].n_bytes == len(text.encode()) and counts[k].over_limit == (counts[k].n_tokens > 512)


MEMORY = """
import resource, sys
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from lakeloom.llm import bpe
from lakeloom.llm.queries import vocabulary

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
made = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(120)), lambda k: F.conv(F.pmod(F.xxhash64("id", k), F.lit(1 << 34)).cast("string"), 10, 36))).alias("text"))
bpe.encode_documents(made.repartition(1), vocabulary("byte_bpe_multi_50k.tiktoken"), with_ids=True).write.format("noop").mode("overwrite").save()
peak = lambda batches: (pa.RecordBatch.from_pydict({"kb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss]}) for _ in batches)
print("PEAK", spark.range(1).repartition(1).mapInArrow(peak, "kb long").first().kb // 1024)
"""


def test_a_worker_that_gives_ids_stays_small():
    """Megabytes at the most of a Python worker over 25 MB of texts whose words hardly repeat; the libraries and the batch take about half."""
    found = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.getcwd()})
    assert 50 < int(found.stdout.split("PEAK")[1]) < 330
