"""DuckDB SQL of the queries that SQL can express over whole tables in reasonable time.

The others are held against brute force in tests/llm: tokens, fingerprints and models have
no counterpart in SQL.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, n, w[i] AS word, CASE WHEN i + 49 <= n THEN md5(array_to_string(w[i:i+49], ' ')) END AS k FROM p),
f AS (SELECT k, min(doc_id) AS least FROM g WHERE k IS NOT NULL GROUP BY k),
h AS (SELECT g.*, coalesce(f.least < g.doc_id, false) AS hit FROM g LEFT JOIN f USING (k)),
c AS (SELECT doc_id, i, word, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h),
a AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

OP7 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, x, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200),
g AS (SELECT doc_id, i, md5_number(x[i:i + 199]::VARCHAR) AS k FROM p),
f AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY k) > 1),
s AS (SELECT *, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -200) + 200 AS opens FROM f),
r AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
c AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY doc_id, run),
l AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM c GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
sha256(CASE WHEN n_removed IS NULL THEN x ELSE unhex(array_to_string(list_transform(range(0, len(starts) + 1), lambda j: hex(x[CASE WHEN j = 0 THEN 1 ELSE ends[j] END:CASE WHEN j = len(starts) THEN n ELSE starts[j + 1] - 1 END])), '')) END) AS kept_sha256 FROM d LEFT JOIN l USING (doc_id)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS l FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, CASE WHEN i + 4 <= n THEN array_to_string(w[i:i+4], ' ') END AS k FROM p),
c AS (SELECT doc_id, i, CASE WHEN k IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY doc_id, k) END AS m FROM g),
r AS (SELECT doc_id, max((m > 1)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM c),
a AS (SELECT doc_id, sum(hit)::BIGINT AS rep FROM r GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN a USING (doc_id)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures % 4 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""


ABLATIONS = f"""
WITH q AS ({OP9}), r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('many_symbols', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32)) v(rule, b))
SELECT rule, count(*) FILTER (failures & b <> 0) AS failed, count(*) FILTER (failures = b) AS failed_alone, count(*) FILTER (failures & (63 - b) = 0) AS kept_without FROM q, r GROUP BY rule
"""

OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
q AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM q),
f AS (SELECT lang, k AS size, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
x AS (SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM c, (VALUES (1), (2)) v(k) WHERE k < size),
s AS (SELECT x.lang, x.phrase, x.size, a, k, f1.n AS l, f2.n AS r, ((1000000::HUGEINT * a * a) // (f1.n::HUGEINT * f2.n))::BIGINT AS score FROM x JOIN f f1 ON f1.lang = x.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = x.lang AND f2.phrase = p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
y AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
z AS (SELECT lang, phrase, max(a) AS longer FROM y GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, o.phrase, a, l, r, t.n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000
"""

OP13 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT doc_id, i, w[i] AS line, translate(regexp_replace(w[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM l WHERE len(k) >= 10 GROUP BY k),
m AS (SELECT l.*, coalesce(least < doc_id, false) AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def _secrets() -> str:
    """Spans from what stands between matches, as the operator takes them; RE2 and Java agree on these patterns."""
    from .secrets import BASE, RULES

    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        lengths = f"list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(gap[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0))"
        parts.append(
            f"SELECT doc_id, {k} AS kind, unnest({lengths})::BIGINT AS s, unnest(list_transform(m, lambda x: len(x)))::BIGINT AS n, unnest(part) AS part, {r.least} AS least, '{r.kind}' AS name "
            f"FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS part, string_split_regex(t, '{p}') AS gap FROM d WHERE regexp_matches(t, '{p}'))"
        )
    union = " UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, kind, s, name || ':' || s || ':' || (s + n) AS span FROM ({union}) WHERE len(part) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < {BASE}) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2, "op4_secret_scan": _secrets(), "op7_suffix_dedup": OP7, "op9_quality_rules": OP9, "quality_ablations": ABLATIONS, "op11_collocations": OP11, "op13_line_dedup": OP13}
