"""The ranked search in DuckDB SQL: all scores of all documents."""

_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH lists AS (SELECT doc_id, {_TERMS.format(text='text')} AS terms FROM documents WHERE text IS NOT NULL),
     sizes AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM lists WHERE len(terms) > 0),
     whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
     postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM lists) GROUP BY doc_id, term),
     asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format(text='text')}) AS term FROM benchmark) GROUP BY item_id, term),
     weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole),
     scored AS (SELECT item_id, p.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
                FROM asked JOIN postings p USING (term) JOIN weights USING (term) JOIN sizes s ON s.doc_id = p.doc_id, whole GROUP BY item_id, p.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
