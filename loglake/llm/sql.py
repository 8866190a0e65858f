"""DuckDB counterparts of the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
c AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY win) AS n FROM p) WHERE n > 1),
gone AS (SELECT DISTINCT r, s + k AS i FROM c, (SELECT unnest(range(0, 35)) AS k)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def _covered(name: str, m: int) -> str:
    """Words of each row in windows of m words that the row holds twice."""
    return f"""{name} AS (SELECT r, count(DISTINCT s + k) AS n FROM (SELECT r, s, count(*) OVER (PARTITION BY r, win) AS t
      FROM (SELECT r, s, md5(array_to_string(w[s:s + {m - 1}], ' ')) AS win FROM (SELECT r, w, unnest(range(1, len(w) - {m - 2})) AS s FROM d))), (SELECT unnest(range(0, {m})) AS k) WHERE t > 1 GROUP BY r)"""


OP5 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
{_covered("c8", 8)}, {_covered("c10", 10)},
w10 AS MATERIALIZED (SELECT r, s, md5(array_to_string(w[s:s + 9], ' ')) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 8)) AS s FROM d)),
twice AS (SELECT a.r, b.s - a.s AS shift, a.s FROM w10 a JOIN w10 b ON a.r = b.r AND a.win = b.win AND a.s < b.s),
longest AS (SELECT r, max(n) + 9 AS n FROM (SELECT r, count(*) AS n FROM (SELECT r, shift, s - row_number() OVER (PARTITION BY r, shift ORDER BY s) AS run FROM twice) GROUP BY r, shift, run) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c8.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(c10.n, 0) AS BIGINT) AS n_covered, CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_repeat
  FROM d LEFT JOIN dup USING (r) LEFT JOIN c8 USING (r) LEFT JOIN c10 USING (r) LEFT JOIN longest USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat, base_failed,
  NOT base_failed AND 100 * n_covered <= 25 * n_words AND longest_repeat <= 150 AS kept FROM f
"""

OP7 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP9 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, s, md5(substr(x, 2 * s + 1, 800)) AS win FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 399)) AS s FROM d)),
c AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY win) AS n FROM p) WHERE n > 1),
m AS (SELECT r, s, s + 400 AS e, max(s + 400) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
g AS (SELECT r, s, e, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS span FROM m),
spans AS MATERIALIZED (SELECT r, span, min(s) AS a, max(e) AS b, coalesce(lag(max(e)) OVER (PARTITION BY r ORDER BY span), 0) AS before FROM g GROUP BY r, span),
t AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY span) AS head FROM spans JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""

ORACLES = {"op1_substring_dedup": OP1, "op5_quality_rules": OP5, "op7_minhash": OP7, "op9_suffix_array_dedup": OP9}
