"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from lakeloom.llm import jaccard, licenses, mixing

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {SPACED})) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS digest FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source
), w AS (
  SELECT *, s % 3 + 1 AS weight, 3 * CAST(source_size AS DOUBLE) / (s % 3 + 1) AS ratio FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY ratio, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), r AS (
  SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS rest FROM l
), t AS (
  SELECT source, source_size, CASE WHEN ratio <= level OR rest IS NULL THEN CAST(3 * source_size AS DOUBLE) ELSE weight * rest END AS target FROM r
), q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t
), c AS (
  SELECT doc_id, d.source, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS rounds,
    CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS cut
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(rounds * size + greatest(0, least(start + size, cut) - start) AS BIGINT) AS taken FROM c
"""

_LEAVES = """
  SELECT k, which, n, list_transform(string_split(t, chr(10)), lambda s: list_transform(
    string_split(regexp_replace(s, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda p: substring(sha256(p), 1, 32))) AS tree
  FROM every
"""

OP3 = f"""
WITH o AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS k, count(*) OVER () AS total FROM documents
), p AS (
  SELECT a.k, a.doc_id, a.text, b.text AS next_text, length(a.text) AS n FROM o a JOIN o b ON b.k = a.k % a.total + 1
), e AS (
  SELECT *, substring(text, 1, n - n // 2) || substring(next_text, 1, n // 2) AS edited FROM p
), every AS (
  SELECT k, n, 'own' AS which, text AS t FROM e UNION ALL SELECT k, n, 'edited', edited FROM e UNION ALL SELECT k, n, 'next', next_text FROM e
), trees AS ({_LEAVES}), inner_nodes AS (
  SELECT k, which, tree, list_transform(tree, lambda s: substring(sha256('s' || array_to_string(s, '')), 1, 32)) AS sections FROM trees
), roots AS (
  SELECT k, which, sections, sha256('r' || array_to_string(sections, '')) AS root, len(flatten(tree)) AS leaves FROM inner_nodes
), counted AS (
  SELECT k, which, leaf, count(*) AS c FROM (SELECT k, which, unnest(flatten(tree)) AS leaf FROM trees) GROUP BY ALL
), common AS (
  SELECT a.k, b.which, CAST(sum(least(a.c, b.c)) AS BIGINT) AS c FROM counted a JOIN counted b ON a.k = b.k AND a.leaf = b.leaf AND a.which = 'own' AND b.which <> 'own' GROUP BY ALL
), near AS (
  SELECT o.k, x.which, x.root, array_to_string(list_filter(range(greatest(len(o.sections), len(x.sections))), lambda i: o.sections[i + 1] IS DISTINCT FROM x.sections[i + 1]), ',') AS changed, 2 * coalesce(m.c, 0) / CAST(o.leaves + x.leaves AS DOUBLE) AS likeness
  FROM roots o JOIN roots x ON o.k = x.k AND o.which = 'own' AND x.which <> 'own' LEFT JOIN common m ON m.k = x.k AND m.which = x.which
)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, r.root AS fingerprint, a.root AS edited_fingerprint, a.likeness AS near_edited, b.likeness AS near_next, a.changed AS changed_sections
FROM e JOIN roots r ON r.k = e.k AND r.which = 'own' JOIN near a ON a.k = e.k AND a.which = 'edited' JOIN near b ON b.k = e.k AND b.which = 'next'
"""

_N = jaccard.SHINGLE
OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {SPACED}) AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= {_N} THEN list_distinct(list_transform(range(1, len(ws) - {_N - 2}), lambda i: array_to_string(ws[i:i + {_N - 1}], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
), kinds AS (
  SELECT sh, min(doc_id) AS low FROM (SELECT doc_id, list_sort(sh) AS sh FROM sets WHERE len(sh) > 0) GROUP BY sh
), each AS (
  SELECT low, len(sh) AS n, unnest(sh) AS x FROM kinds
), pairs AS (
  SELECT a.low AS a, b.low AS b, a.n AS na, b.n AS nb, count(*) AS o FROM each a JOIN each b ON a.x = b.x AND a.low < b.low GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * o >= {jaccard.PERCENT} * (na + nb - o)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT low, low FROM kinds UNION SELECT r.a, t.b FROM reach r JOIN ways t ON r.b = t.a
), component AS (
  SELECT a AS low, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN kinds k ON k.sh = list_sort(s.sh) LEFT JOIN component c ON c.low = k.low
"""


def _literals(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _stands(phrase: str) -> str:
    test = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
    return f"list_filter(range(0, len(ws)), lambda i: coalesce({test}, false))"


_SHARES = ", ".join(f"{{'share': len(list_intersect(b, {_literals(ws)})) / {len(ws)}.0::DOUBLE, 'words': {len(ws)}, 'label': '{label}'}}" for label, ws in ((label, licenses.template_words(text)) for label, text in licenses.TEMPLATES))
_PHRASES = ", ".join(f"{{'label': '{label}', 'places': {_stands(phrase)}}}" for phrase, label in licenses.PHRASES.items())
_LICENSE_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP8 = rf"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents
), f AS (
  SELECT k, doc_id, text, regexp_extract_all(text, {_LICENSE_WORD}) AS ws FROM w
), p AS (
  SELECT *, list_filter([{_PHRASES}], lambda x: len(x.places) > 0) AS ps FROM f
), lines AS (
  SELECT k, list_distinct(regexp_extract_all(unnest(string_split(text, chr(10))), {_LICENSE_WORD})) AS b FROM w
), met AS (
  SELECT k, list_max(list_filter([{_SHARES}], lambda m: m.share >= {licenses.THRESHOLD} - 1e-9)) AS m FROM lines
), best AS (
  SELECT k, list(m.label) AS found, max(m.share) AS share FROM met WHERE m IS NOT NULL GROUP BY k
), a AS (
  SELECT p.*, flatten(list_transform(ps, lambda x: x.places)) AS places, list_transform(ps, lambda x: x.label) AS base, found, share FROM p LEFT JOIN best USING (k)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM a
"""

assert mixing.WORD == SPACED.strip("'") and licenses.WORD == _LICENSE_WORD.strip("'")
