"""DuckDB SQL of the near-duplicate and decontamination queries."""

from .decontaminate import LEAST, LEAVE_OUT, MASKS, SHARE, SPAN

#: Words of a shingle and least similarity in per cent of the registered query.
CONTRACT = SHINGLE, PERCENT = 3, 85

_SPACE = r"[ \t\n\x0B\f\r]+"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS s FROM w, unnest(range(1, CASE WHEN len(ws) >= {SHINGLE} THEN len(ws) - {SHINGLE - 2} WHEN len(ws) > 0 THEN 2 ELSE 1 END)) AS r(i)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * met.n >= {PERCENT} * (x.n + y.n - met.n)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, coalesce(least(doc_id, b), doc_id) AS component_id, coalesce(least(doc_id, b), doc_id) = doc_id AS kept FROM w LEFT JOIN size USING (doc_id) LEFT JOIN least_ ON a = doc_id
"""


def _seeds(name: str, key: str) -> str:
    """A row for each window and mask; a NUL keeps joined words apart."""
    parts = [f"SELECT {key}, i, '{m}' || chr(1) || " + " || chr(1) || ".join(f"ws[i + {k}]" for k, bit in enumerate(mask) if bit == "1") + f" AS seed FROM {name}, unnest(range(1, greatest(len(ws) - {SPAN - 2}, 1))) AS r(i) WHERE len(ws) >= {SPAN}" for m, mask in enumerate(MASKS)]
    return " UNION ALL ".join(parts)


CONTAMINATED = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM benchmark),
bs AS ({_seeds("b", "item_id")}), ds AS ({_seeds("d", "doc_id")}),
diagonal AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (seed)),
cell AS (SELECT doc_id, item_id, shift, j, d.ws[j + shift] = b.ws[j] AS same FROM diagonal JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(1, len(b.ws) + 1)) AS r(j) WHERE j + shift BETWEEN 1 AND len(d.ws)),
run AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -1 END) OVER w AS p, row_number() OVER w AS k FROM cell WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY j)),
low AS (SELECT *, least(0, min(p) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k)) AS floor FROM run),
started AS (SELECT *, coalesce(max(CASE WHEN p = floor THEN k END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k), 0) AS start FROM low),
best AS (SELECT doc_id, item_id, shift, p - floor AS score, (k - start + p - floor) // 2 AS matched, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY p - floor DESC, k) AS r FROM started),
lens AS (SELECT DISTINCT len(ws) AS n FROM b WHERE len(ws) BETWEEN 1 AND {SPAN - 1}),
dw AS (SELECT doc_id, n, i, array_to_string(list_filter(ws[i:i + n - 1], lambda x, k: k <> m), chr(1)) AS key, m, ws FROM d, lens, unnest(range(1, len(ws) - n + 2)) AS r(i), unnest(CASE WHEN n >= {LEAVE_OUT} THEN range(1, n + 1) ELSE [0] END) AS q(m) WHERE len(ws) >= n),
bw AS (SELECT item_id, len(ws) AS n, m, array_to_string(list_filter(ws, lambda x, k: k <> m), chr(1)) AS key, ws FROM b, unnest(CASE WHEN len(ws) >= {LEAVE_OUT} THEN range(1, len(ws) + 1) ELSE [0] END) AS q(m) WHERE len(ws) BETWEEN 1 AND {SPAN - 1}),
hit AS (SELECT doc_id, item_id, n, m, n < {LEAVE_OUT} OR dw.ws[i + m - 1] = bw.ws[m] AS same, greatest(n - 2, m - 1, n - m) AS changed FROM dw JOIN bw USING (n, m, key)),
short AS (SELECT doc_id, item_id, CASE WHEN same THEN n ELSE changed END AS score, CASE WHEN same THEN n WHEN m IN (2, n - 1) THEN n - 2 ELSE n - 1 END AS matched FROM hit),
scored AS (SELECT doc_id, item_id, score, matched FROM best WHERE r = 1 UNION ALL SELECT * FROM short)
SELECT doc_id, item_id, max(score)::BIGINT AS score, arg_max(matched, (score, matched))::BIGINT AS matched, len(ws)::BIGINT AS item_words FROM scored JOIN b USING (item_id) WHERE score >= least({LEAST}, ceil(len(ws) * {SHARE})) GROUP BY doc_id, item_id, ws
"""
