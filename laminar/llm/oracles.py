"""SQL of the corpus queries that SQL can express, for the side-by-side check of results."""

from __future__ import annotations

from laminar.llm.line_quality import BOILERPLATE_WORDS, CLOSED, KEPT_PERCENT, LEAST_WORDS, LOUD, OPEN_LEAST, OPEN_MOST, PHRASES, REPEATED_PERCENT, SEPARATORS

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, half a byte at a time; the remainders of the sixteen half bytes are made from the polynomial."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    step = f"xor(c >> 4, [{', '.join(map(str, table))}][xor(c, x) % 16 + 1])"
    halves = f"flatten([[CAST(ord(d) AS BIGINT), CAST(ord(d) // 16 AS BIGINT)] for d in string_split({text}, '')])"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {halves}), lambda c, x: {step}), CAST(4294967295 AS BIGINT))"


def periodic_runs(levels: int = 20) -> str:
    """Runs by doubling gram lengths, as names of first places; lags below ``2 ** levels`` (texts of four times as many words)."""
    parts = [
        f"d AS (SELECT doc_id, {_WORDS.format('text')} AS ws, {_crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents)",
        "e AS (SELECT doc_id, ws, h, h // 10 AS g, len(ws) AS n FROM d)",
        "f AS (SELECT *, CASE WHEN h % 10 = 0 THEN g % n ELSE n END AS a FROM e WHERE n > 0)",
        "s AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f)",
        "u AS (SELECT *, unnest(range(0, n)) AS i FROM s)",
        "w AS MATERIALIZED (SELECT doc_id, n, i, ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS w FROM u)",
        "r_0 AS MATERIALIZED (SELECT doc_id, n, i, min(i) OVER (PARTITION BY doc_id, w) AS r FROM w)",
    ]
    for j in range(levels):
        q = 1 << j
        parts += [
            f"p_{j} AS (SELECT x.doc_id, x.n, x.i, x.r AS a, y.r AS b FROM r_{j} x JOIN r_{j} y ON y.doc_id = x.doc_id AND y.i = x.i + {q} WHERE x.n >= {max(6, 4 * q)})",
            f"g_{j} AS MATERIALIZED (SELECT doc_id, n, i, min(i) OVER (PARTITION BY doc_id, a, b) AS r, lead(i) OVER (PARTITION BY doc_id, a, b ORDER BY i) - i AS gap, count(*) OVER (PARTITION BY doc_id, a, b) AS c FROM p_{j})",
            f"r_{j + 1} AS MATERIALIZED (SELECT doc_id, n, i, r FROM g_{j} WHERE c > 1)",
        ]
    seeds = " UNION ALL ".join(f"SELECT doc_id, i, gap, {2 << j} AS k FROM g_{j} WHERE gap >= {1 << j} AND gap < {2 << j}" for j in range(levels))
    parts += [
        f"seeds AS ({seeds})",
        "c AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS chain FROM seeds)",
        "t AS (SELECT doc_id, min(i) AS start, count(*) - 1 + k + gap AS length, gap AS period FROM c GROUP BY doc_id, gap, k, chain)",
        "runs AS MATERIALIZED (SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period FROM t WHERE length >= greatest(6, 4 * period))",
        "gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs)",
        "kept AS (SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS digest FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)",
        "best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS k FROM runs)",
        "listed AS (SELECT doc_id, count(*) AS n, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest FROM runs GROUP BY doc_id)",
    ]
    return f"""WITH {', '.join(parts)}
SELECT doc_id, coalesce(l.n, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, coalesce(l.digest, sha256('')) AS runs_sha256, coalesce(kept.digest, sha256('')) AS collapsed_sha256
FROM documents LEFT JOIN listed l USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def line_quality() -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT doc_id, {_WORDS.format('t')} AS ws FROM d), w1 AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w0),
w AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i + 4 <= len(ws) THEN array_to_string(ws[i:i + 4], ' ') END AS g FROM w1),
r AS (SELECT doc_id, i, w, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS hit FROM w),
c AS (SELECT doc_id, w, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM r),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(hit) AS n_repeat_words FROM c GROUP BY doc_id),
l0 AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d), l1 AS (SELECT doc_id, unnest(ls) AS line FROM l0),
l2 AS (SELECT doc_id, line, {_WORDS.format('line')} AS ws FROM l1),
l AS (SELECT doc_id, line, len(ws) AS n, length(array_to_string(ws, '')) AS chars, len(regexp_extract_all(line, {_quoted(SEPARATORS)})) AS sep, len(regexp_extract_all(line, {_quoted(LOUD)})) AS loud FROM l2 WHERE len(ws) > 0),
j AS (SELECT *, CASE WHEN sep >= 3 AND 3 * sep >= n THEN 1
    WHEN (loud >= 3 AND 2 * loud >= n) OR (n BETWEEN {OPEN_LEAST} AND {OPEN_MOST} AND NOT regexp_matches(line, {_quoted(CLOSED)})) THEN 2
    WHEN n <= {BOILERPLATE_WORDS} AND regexp_matches(line, {_quoted(PHRASES)}) THEN 3 ELSE 0 END AS rule FROM l),
b AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE rule = 0), 0) AS kept_chars, count(*) FILTER (WHERE rule = 1) AS n_navigation,
    count(*) FILTER (WHERE rule = 2) AS n_punctuation, count(*) FILTER (WHERE rule = 3) AS n_boilerplate FROM j GROUP BY doc_id),
o AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars, coalesce(n_navigation, 0) AS n_navigation,
    coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_boilerplate, 0) AS n_boilerplate FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words) AND 100 * kept_chars >= {KEPT_PERCENT} * word_chars AS kept FROM o"""
