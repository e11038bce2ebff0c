"""SQL (DuckDB) that gives the rows of those operator queries that SQL can express."""

from __future__ import annotations

from vecscore.llm import line_dedup, quality
from vecscore.llm.common import UPPER

_WORD, _BLANK = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"

EXACT = f"""WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t"""


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>')"


def chat(hard_text: str) -> str:
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{hard_text}' UNION ALL SELECT -7, 1, 'assistant', '{hard_text}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + 13) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""


def lines(m: int = line_dedup.MIN_LINES, long_words: int = line_dedup.LONG_WORDS) -> str:
    """Windows of m lines, and shorter ones of more than long_words words."""
    key = lambda n: " || chr(10) || ".join(f"l[i + {k}]" if k else "l[i]" for k in range(n))
    every = " UNION ALL ".join(f"SELECT doc_id, i, {n} AS n, {key(n)} AS key FROM (SELECT doc_id, l, unnest(range(1, len(l) - {n - 2})) AS i FROM d) x" for n in range(1, m + 1))
    return f"""WITH d AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_BLANK}')) AS l FROM documents),
w AS (SELECT * FROM ({every}) x WHERE n = {m} OR len(regexp_extract_all(key, '{_WORD}')) > {long_words}),
later AS (SELECT doc_id, i, n FROM (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, key ORDER BY doc_id, i) AS k FROM w) x WHERE k > 1),
s AS (SELECT doc_id, i, n, CASE WHEN i <= max(i + n) OVER (PARTITION BY doc_id ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM later),
u AS (SELECT doc_id, i, n, sum(new) OVER (PARTITION BY doc_id ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s),
runs AS (SELECT doc_id, run, max(i + n) - min(i) AS length FROM u GROUP BY 1, 2),
t AS (SELECT doc_id, sum(length) AS removed, count(*) AS n, max(length) AS longest FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest, 0) AS BIGINT) AS longest_run FROM d LEFT JOIN t ON d.doc_id = t.doc_id"""


def rules() -> str:
    q = quality
    count = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
    quoted = lambda p: p.replace("'", "''")
    bad_marks = f"{count('x', quoted(q.MARK_RUNS))} >= {q.MIN_MARK_RUNS} OR {count('x', quoted(q.MARKS))} * 100 > length(x) * {q.MAX_MARKS_PERCENT}"
    failed = f"{count('x', q.SEPARATORS)} >= {q.MIN_SEPARATORS} OR {bad_marks} OR (length(x) <= {q.BOILERPLATE_CHARS} AND regexp_matches(x, '{q.BOILERPLATE}'))"
    chars = lambda x: f"length(regexp_replace({x}, '[\\x20\\x09-\\x0D]', '', 'g'))"
    five = " || chr(32) || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(q.WINDOW))
    return f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_BLANK}')) AS l FROM b),
k AS (SELECT doc_id, i, {five} AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM d) x),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k) x WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range({q.WINDOW})) AS p FROM twice) x GROUP BY 1),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({chars('t')} AS BIGINT) AS word_chars, CAST({count('t', '[#*$%&|<>]')} AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  list_filter(l, lambda x: {failed}) AS gone FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
z AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, CAST({chars("array_to_string(gone, '')")} AS BIGINT) AS lost_chars FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars * 100 <= word_chars * {q.MAX_LOSS_PERCENT} AS kept, n_lines, CAST(len(gone) AS BIGINT) AS n_failed_lines, lost_chars FROM z"""
