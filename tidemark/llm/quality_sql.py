"""DuckDB SQL of the quality query."""

from .quality import CLASS_LIMIT, COMMON, LEAST_WORDS, WORD_LIMIT

_SPACE = r"[ \t\n\x0B\f\r]+"
_CLASS = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[ \t\n\x0B\f\r]", "beyond": r"[^\x00-\x7F]"}
_COUNTS = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS {k}" for k, p in _CLASS.items())

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2),
cover AS (SELECT doc_id, sum(least(8, i - prev)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) AS prev FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id),
cls AS (SELECT doc_id, lang, length(t) AS n_chars, {_COUNTS} FROM d),
cls2 AS (SELECT *, n_chars - lower - upper - digit - space - beyond AS mark FROM cls),
cl AS (SELECT doc_id, lang, unnest(['lower', 'upper', 'digit', 'space', 'beyond', 'mark']) AS bin, unnest([lower, upper, digit, space, beyond, mark])::DOUBLE AS n FROM cls2),
tok AS (SELECT doc_id, lang, lower(x) AS x FROM (SELECT doc_id, lang, unnest(ws) AS x FROM w)),
freq AS (SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) AS place FROM tok GROUP BY lang, x),
cmn AS (SELECT doc_id, t.lang, coalesce(c.x, '') AS bin, count(*)::DOUBLE AS n FROM tok t LEFT JOIN (SELECT lang, x FROM freq WHERE place <= {COMMON}) c ON c.lang = t.lang AND c.x = t.x GROUP BY ALL),
both_ AS (SELECT 'c' AS h, * FROM cl UNION ALL SELECT 'w' AS h, * FROM cmn),
ref AS (SELECT h, lang, bin, sum(n) AS n FROM both_ GROUP BY ALL),
total AS (SELECT h, lang, sum(n) AS n FROM ref GROUP BY ALL),
own AS (SELECT h, doc_id, lang, sum(n) AS n FROM both_ GROUP BY ALL HAVING sum(n) > 0),
cell AS (
  SELECT o.h, o.doc_id, coalesce(b.n, 0) / o.n AS p, r.n / s.n AS q
  FROM own o JOIN total s ON s.h = o.h AND s.lang = o.lang JOIN ref r ON r.h = o.h AND r.lang = o.lang
  LEFT JOIN both_ b ON b.h = o.h AND b.doc_id = o.doc_id AND b.bin = r.bin WHERE s.n > 0),
dist AS (SELECT h, doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js FROM cell GROUP BY ALL),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, (c.n_chars - c.space)::BIGINT AS word_chars, (length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, coalesce(a.js, 0) AS js_c, coalesce(b.js, 0) AS js_w
  FROM w JOIN cls c USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN cover v USING (doc_id)
  LEFT JOIN dist a ON a.doc_id = w.doc_id AND a.h = 'c' LEFT JOIN dist b ON b.doc_id = w.doc_id AND b.h = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words >= {LEAST_WORDS} AND (js_c > {CLASS_LIMIT} OR js_w > {WORD_LIMIT})) AS kept
FROM f
"""
