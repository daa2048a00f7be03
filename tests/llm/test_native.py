"""Merkle fingerprints and license scans against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest

from lakeloom.llm import licenses, merkle

TEXTS = ["", "One. Two! Three?\nFour five.\n\nSix.", "a", "One. Two! Three?\nFour five.\n\nSix.", "Same. Same. Same.\nSame.", "x\n", "é ü. " * 40, "No end"]


def tree(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [[sha(p)[:32] for p in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", line)] for line in text.split("\n")]
    return sha("r" + "".join(sha("s" + "".join(x))[:32] for x in leaves)), [p for x in leaves for p in x]


def dice(a, b):
    left, common = list(b), 0
    for x in a:
        if x in left:
            left.remove(x)
            common += 1
    return 2 * common / (len(a) + len(b))


@pytest.mark.parametrize("rows", [1, 3])
def test_fingerprints(spark, monkeypatch, rows):
    monkeypatch.setattr(merkle, "RANGE_ROWS", rows)
    ids = [k * k + 3 for k in range(len(TEXTS))]
    docs = spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "doc_id long, text string")
    found = {r.doc_id: r for r in merkle.edited_fingerprints(docs).collect()}
    for k, text in enumerate(TEXTS):
        other = TEXTS[k - 1]  # descending identifiers; after the last, the first
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = found[ids[k]]
        (root, leaves), (edited_root, edited_leaves), (_, next_leaves) = tree(text), tree(edited), tree(other)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), root, edited_root)
        assert (r.near_edited, r.near_next) == pytest.approx((dice(leaves, edited_leaves), dice(leaves, next_leaves)))
        a, b = text.split("\n"), edited.split("\n")
        assert r.changed_sections == [n for n in range(max(len(a), len(b))) if a[n : n + 1] != b[n : n + 1]]


def test_repeated_leaves_take_linear_work(spark):
    """Numbering them once copied all that it had for each leaf, which took these two texts over two minutes."""
    texts = ["\n" * 20_000, "a. b.\n" * 20_000 + "c"]
    began = time.monotonic()
    found = {r.doc_id: r for r in merkle.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 60
    for k, text in enumerate(texts):
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[1 - k][:half]
        (root, own), (edited_root, other), (_, following) = tree(text), tree(edited), tree(texts[1 - k])
        near = [2 * (Counter(own) & Counter(x)).total() / (len(own) + len(x)) for x in (other, following)]
        r = found[k]
        assert (r.fingerprint, r.edited_fingerprint) == (root, edited_root) and [r.near_edited, r.near_next] == pytest.approx(near)


def test_leaves_cross_the_shuffle_as_16_bytes(spark):
    """As hex digits, leaves were half of what tasks held; a repeat has its number behind it."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    sizes = "transform(own, x -> octet_length(x))"
    found = {r.doc_id: r for r in merkle._with_leaves(docs, "text", "tree", "own", "sections").selectExpr("doc_id", f"{sizes} AS sizes", "size(array_distinct(own)) AS n").collect()}
    for k, text in enumerate(TEXTS):
        leaves = tree(text)[1]
        repeats = [16 + len(str(n)) if n else 16 for c in Counter(leaves).values() for n in range(c)]
        assert sorted(found[k].sizes) == sorted(repeats) and found[k].n == len(leaves)


HUGE = [2**63 - 1, 2**63 - 2, 5, 4, 3, 0, -7, -(2**63) + 1, -(2**63)]


@pytest.mark.parametrize("ids", [HUGE, [k // 4 for k in range(60)], [None] * 30 + [9] * 30 + [1], [10**18 + k for k in range(70)] + [-(10**18)]], ids=["extreme", "repeated", "null", "outlying"])
def test_next_rows(spark, monkeypatch, ids):
    """Identifiers over all 64 bits, repeated, null and far from the others, in several ranges, some of one identifier."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 4)
    monkeypatch.setattr(merkle, "SAMPLES", 2)
    rows = [(i, f"text {k * 7 % 11} {k}") for k, i in enumerate(ids)]
    found = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted((r.text, r.next_text) for r in found) == sorted((a[1], b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True))


def test_ranges_hold_about_equally_many(spark):
    """One identifier far out, clusters, and a third of all rows without one."""
    ids = [None] * 10_000 + [k * k for k in range(10_000)] + [2**62 + k for k in range(9_999)] + [-(2**63)]
    docs = spark.createDataFrame([(i, f"{k:06} text") for k, i in enumerate(ids)], "doc_id long, text string")
    sizes = [r["count"] for r in merkle._ranged(docs).groupBy("range").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 4 * merkle.RANGE_ROWS


LICENSED = [
    "Plain words only.",
    "Released under the MIT License.\nAnd the mit license again; MIT-License.",
    "MIT\nLicense",
    "mitlicense, mit a license",
    "x\nLicensed under CC BY-NC 4.0.\ny",
    "This work is licensed under the GNU General Public License, version 3.",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated files",
    "permission is hereby granted to a person",
    "Apache License",
    "",
]


def test_scans(spark):
    found = [r for _, r in sorted((r.doc_id, r) for r in licenses.scan(spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")).collect())]
    assert [r.base_labels for r in found] == ["", "mit", "mit", "", "", "gpl", "", "", "apache", ""]
    assert [r.labels for r in found] == ["", "mit", "mit", "", "cc-by-nc", "gpl", "mit", "", "apache", ""]
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].n_words) == (3, 3, 10, 12)
    assert found[6].score == pytest.approx(19 / 20, abs=0.06) and found[7].score == 0 and found[9].n_words == 0


def walked(text, templates=licenses.TEMPLATES):
    """(first word, label, share) of every window that meets a template, by walking the text; and its words."""
    found = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text))
    pairs = list(zip(found, found[1:], strict=False))
    sets = [(label, set(zip(t.split(), t.split()[1:], strict=False)), len(t.split())) for label, t in templates]
    blocks = set()
    for label, tokens, size in sets:
        own = tokens - {t for other, ts, _ in sets if other != label for t in ts}
        words = next(n for n in range(size, 10 * size) if size <= 0.8 * n + 1e-9)  # of which the template is the threshold
        for at in range(len(pairs)):
            if pairs[at] in tokens:
                held = tokens & set(pairs[at : at + words - 1])
                if len(held) >= 0.8 * len(tokens) - 1e-9 and len(held & own) >= 0.8 * len(own) - 1e-9:
                    blocks.add((at, label, len(held) / len(tokens)))
    return blocks, found


def test_no_match_is_filtered_away(spark):
    """The join keeps exactly the windows that a walk over all of them keeps."""
    pick = random.Random(1)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    lines = [" ".join(words[(k * 7 + j * j) % len(words)] for j in range(k % 25)) for k in range(100)]
    lines += [" ".join(w for n, w in enumerate(t.split()) if n % 9 != k) for _, t in licenses.TEMPLATES for k in range(9)]
    for _ in range(300):  # notices with words lost, put in, or exchanged, one after another
        text = []
        for _ in range(pick.randrange(1, 4)):
            own = pick.choice(licenses.TEMPLATES)[1].split()
            for _ in range(pick.randrange(4)):
                at = pick.randrange(len(own))
                own[at : at + pick.randrange(2)] = [pick.choice([*words, "other"])] * pick.randrange(2)
            text += [*own, *(pick.choice(["and", "the", "\n", "so."]) for _ in range(pick.randrange(6)))]
        lines.append(" ".join(text))
    met = 0
    for r in licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect():
        want, found = walked(lines[r.doc_id])
        assert {(b.word, b.label, b.share) for b in r.blocks or []} == want and r.n_words == len(found)
        assert set(r.labels.split(",")) - {""} == {label for _, label, _ in want} | (set(r.base_labels.split(",")) - {""})
        met += bool(want)
    assert 150 < met < len(lines) - 50


NAMED = {
    "Released under the Apache License.": "apache",
    "released notes: the patch, under review, ships with its license text": "",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": "mit",
    "Released under the MIT License": "mit",
    "Released under the \u212aMIT License": "",
    "licensed under the \u212anu apache license version 2 0": "apache",
    "Licensed under CC BY-ND 4.0": "",
}


def test_what_names_a_license_must_stand(spark):
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")).collect()}
    assert [found[k] for k in range(len(NAMED))] == [*NAMED.values()]


WRAPPED = {
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:": "bsd",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal": "mit",
    "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that": "isc",
    " * under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either": "gpl,lgpl",
    "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at": "apache",
    "Redistribution and use in source and binary forms,\n\nthe rest of the notice is not here": "",
}


def test_wrapped_notices(spark):
    rows = list(enumerate(WRAPPED))
    rows += [(k + len(WRAPPED), "Some words first.\n" * 50 + text + "\nand more.") for k, text in rows]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, want in enumerate([*WRAPPED.values()] * 2):
        assert (found[k].labels, found[k].score) == (want, 1.0 if want else 0.0)


def test_every_license_of_a_text(spark):
    mit, bsd = (next(t for label, t in licenses.TEMPLATES[1:] if label == x) for x in ("mit", "bsd"))
    texts = {
        f"{mit}. {bsd}.": "bsd,mit",
        "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-NC-SA 4.0.": "",  # none of the three
        "Version 4.0. Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    }
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[k].labels for k in range(len(texts))] == [*texts.values()]
