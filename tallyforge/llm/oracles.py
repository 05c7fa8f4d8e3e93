"""SQL twins of the operators whose results SQL can say; they take every pair, so they are for small tables."""

from __future__ import annotations

#: All pairs of distinct word sets of near sizes: for small tables.
LINE_DEDUP = r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
l AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM d),
w AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(line, '[ \t\x0b\x0c\r]+'), lambda x: x <> ''))) AS w FROM l),
p AS (SELECT *, min((doc_id, line_no)) OVER (PARTITION BY w) AS head FROM w WHERE len(w) > 0),
h AS (SELECT DISTINCT head, w, len(w) AS n FROM p),
s AS (SELECT DISTINCT y.head FROM h x JOIN h y ON x.head < y.head AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n AND 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
r AS (SELECT doc_id, list(line_no ORDER BY line_no)::INT[] AS removed FROM p WHERE (doc_id, line_no) <> head OR head IN (SELECT head FROM s) GROUP BY 1)
SELECT doc_id, coalesce(len(l), 0)::INT AS n_lines, coalesce(len(removed), 0)::INT AS n_removed, coalesce(removed, []::INT[]) AS removed_lines FROM d LEFT JOIN r USING (doc_id)"""

#: Literals: the text of conversation -1, and the marks' characters in a turn (two marks of 12 and 10 signs, one of 10, a line end).
CHAT_MASKS = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
sum(33 + length(regexp_replace(r, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(x, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rounds one after another, each with all distances of all parts."""
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, i * {parts} // n AS p, i % (n // {parts}) AS i, v FROM (SELECT vec_id, len(v) AS n, unnest(v) AS v, unnest(range(len(v))) AS i FROM k)),
b0 AS MATERIALIZED (SELECT p, e, i, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) USING (vec_id) WHERE e < {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (SELECT vec_id, p, e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{r} b USING (p, i) GROUP BY ALL) GROUP BY ALL)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT p, e, i, sum(v) AS s, count(*) AS c FROM x JOIN a{r} USING (vec_id, p) GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, i, coalesce((s - ((s % c) + c) % c) // c, v)::BIGINT AS v FROM b{r} LEFT JOIN m{r} USING (p, e, i))")
    steps.append(f"c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)")
    steps.append(f"h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"


#: 3988292384 is the reversed polynomial of CRC-32; words that are equal and no further apart than a third of the text make the lags.
PERIODIC_RUNS = r"""WITH c AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w,
xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda t, z: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)), 4294967295) AS h FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a, h // 10 % 8 AS g FROM c), p AS (SELECT *, 1 + (n - a) // (3 + g) AS p FROM a),
t AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
e AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM t),
q AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM q) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
r AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM s GROUP BY 1, 2, 3),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) AS k FROM r) WHERE k = 1),
g AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS sha FROM r GROUP BY 1),
d AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
o AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS x FROM e ANTI JOIN d USING (doc_id, i) GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli, coalesce(sha, sha256('')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM t LEFT JOIN f USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN o USING (doc_id)"""

#: Base32 of the SHA-1: the 32 groups of five bits, each out of two hex digits.
SPLITTABLE_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), h AS (SELECT page_id, octet_length(encode(x))::BIGINT AS payload_bytes, sha1(x) AS h FROM p),
d AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((strpos('0123456789abcdef', substr(h, 5 * j // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 5 * j // 4 + 2, 1)) - 1) >> (3 - 5 * j % 4)) & 31)::INT, 1) FOR j IN range(32)], '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS head FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM d"""
