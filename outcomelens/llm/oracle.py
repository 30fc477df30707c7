"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

from outcomelens.llm.common import WORD
from outcomelens.llm.mixing import MAX_EPOCHS, SCHEDULES
from outcomelens.llm.quality import BASE_POLICY, RULES
from outcomelens.llm.secret_scan import RULES as SECRETS

WARC = """SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN largest END AS refers_to
FROM (SELECT *, strlen(h) >= 1000 AND largest IS NOT NULL AND page_id IS DISTINCT FROM largest AS again
  FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages))"""


def _root(y: str, weight: float, slope: float) -> str:
    if slope == 0:
        return f"({y}) / {weight!r}::DOUBLE"
    return (f"(sqrt(greatest({weight * weight!r}::DOUBLE + {2 * slope!r}::DOUBLE * ({y}), 0.0::DOUBLE)) - {weight!r}::DOUBLE)"
            f" / {slope!r}::DOUBLE")


def _position() -> str:
    cases = []
    for i, (a, b, c) in enumerate(SCHEDULES):
        first, total = (a + b) / 4, (a + b) / 4 + (b + c) / 4
        y = f"(share * {total!r}::DOUBLE)"
        late = f"0.5::DOUBLE + {_root(f'{y} - {first!r}::DOUBLE', b, 2 * (c - b))}"
        cases.append(f"WHEN place = {i} THEN CASE WHEN {y} <= {first!r}::DOUBLE THEN {_root(y, a, 2 * (b - a))} ELSE {late} END")
    return f"least(greatest(CASE {' '.join(cases)} END, 0.0::DOUBLE), 1.0::DOUBLE)"


MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS place,
  {MAX_EPOCHS}.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, (place + 1)::DOUBLE AS weight FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER b, 0.0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0) AS rest,
  sum(source_size::DOUBLE) OVER () AS total FROM s2
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - capped) / rest AS factor FROM s3),
f AS (SELECT factor FROM s4 WHERE factor * weight <= cap ORDER BY cap / weight, factor LIMIT 1),
goal AS (SELECT source, source_size, place, least(cap, coalesce((SELECT factor FROM f) * weight, cap)) AS target FROM s4),
o AS (SELECT d.*, source_size, place, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source),
c AS (SELECT *, floor(target / greatest(source_size, 1)) AS whole FROM o),
k AS (SELECT *, CASE WHEN size > 0 THEN least(whole + CASE WHEN start + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END,
    {MAX_EPOCHS}) ELSE 0 END AS copies, (start + size / 2) / greatest(target, 1.0::DOUBLE) AS share FROM c)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN {_position()} END AS first_position FROM k"""

_BITS = " + ".join(f"CASE WHEN {sql} THEN {1 << i} ELSE 0 END" for i, (_, sql) in enumerate(RULES))

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t),
g AS (SELECT r, pos, [word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p] AS gram,
  lead(word, 4) OVER p IS NOT NULL AS whole FROM w WINDOW p AS (PARTITION BY r ORDER BY pos)),
again AS (SELECT r, unnest(list(pos)) AS pos FROM g WHERE whole GROUP BY r, gram HAVING count(*) > 1),
cover AS (SELECT r, count(DISTINCT pos + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
  len(regexp_extract_all(text, '\\p{{L}}')) AS n_letters, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper,
  len(list_filter(words, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_plain_words FROM t LEFT JOIN cover USING (r)),
b AS (SELECT *, CAST({_BITS} AS INTEGER) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE_POLICY}) <> 0 AS base_failed,
  fail_bits = 0 AS kept, fail_bits FROM b"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secrets() -> str:
    """Pieces between matches and the matches, left to right, give each match's place."""
    lists = []
    for k, r in enumerate(SECRETS):
        p = _quoted(("(?i)" if r.fold else "") + r.pattern)
        hits, checked = f"regexp_extract_all(t, {p}, 0)", f"regexp_extract_all(t, {p}, {r.group})"
        at = (f"CAST(list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x)))"
              f" + coalesce(list_sum(list_transform({hits}[1:i - 1], lambda x: length(x))), 0) AS BIGINT)")
        lists.append(f"""list_transform(list_filter(range(1, len({hits}) + 1), lambda i: length({checked}[i]) >= {r.least}),
          lambda i: {{'s': {at}, 'k': {k}, 'e': {at} + length({hits}[i])}})""")
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in SECRETS) + "]"
    text = f"lambda x: {kinds}[x.k + 1] || ':' || x.s || ':' || x.e"
    counts = ", ".join(f"CAST(len(list_filter(spans, lambda x: x.k = {i})) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(SECRETS[:3]))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(flatten([{", ".join(lists)}])) AS spans FROM d)
SELECT doc_id, {counts}, sha256(coalesce(array_to_string(list_transform(list_filter(spans, lambda x: x.k < 3), {text}), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(spans, {text}), ','), '') AS spans FROM f"""


SECRET_SCAN = _secrets()

#: Every query against every row, by all pairs; the five best, ties to the smaller id.
EXACT_TOPK = """
WITH rows AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id,
    max(CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, r.v)]) AS BIGINT)) AS score
  FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""
