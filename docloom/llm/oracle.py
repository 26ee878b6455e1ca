"""Oracle SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from docloom.plans.oracle import CURRENT, NODES

#: Valid postings, documents and stop words in force, as common table expressions.
_BASE = """
docs AS (SELECT DISTINCT idx, id, length FROM index_docs WHERE idx IS NOT NULL),
valid AS (SELECT DISTINCT p.source_id, p.term, p.idx, p.tf FROM postings p WHERE p.term IS NOT NULL AND p.term <> '' AND p.idx IN (SELECT idx FROM docs)),
stats AS (SELECT term, count(DISTINCT idx) AS docs, CAST(sum(tf) AS BIGINT) AS total FROM valid GROUP BY term),
head AS (SELECT tokenizer.stop_words AS sw, bm25.k1 AS k1, bm25.b AS b FROM search_index ORDER BY tokenizer.version DESC, segment_id DESC LIMIT 1),
stops AS (SELECT unnest(sw) AS term FROM head),
n AS (SELECT count(*) AS n FROM docs)
"""
_MARKS = f"""WITH {_BASE}
SELECT term, docs, total, CASE WHEN term IN (SELECT term FROM stops) THEN 'stop' WHEN docs < 3 THEN 'rare' WHEN docs > 0.25 * n THEN 'common' END AS mark
FROM stats, n"""
_SCORES = f"""WITH {_BASE},
tfs AS (SELECT idx, term, CAST(sum(tf) AS BIGINT) AS tf FROM valid GROUP BY idx, term),
sums AS (SELECT idx, CAST(sum(tf) AS BIGINT) AS s FROM tfs GROUP BY idx),
lens AS (SELECT d.idx, d.id, CAST(coalesce(d.length, s.s, 0) AS BIGINT) AS length, coalesce(s.s, 0) AS s FROM docs d LEFT JOIN sums s USING (idx)),
whole AS (SELECT count(*) AS n, avg(length) AS av, sum(s) AS every FROM lens),
cells AS (SELECT t.idx, l.id, t.term, t.tf, st.docs, st.total, l.length, w.n, w.av, h.k1, h.b,
    CAST(t.tf AS DOUBLE) AS a, CAST(st.total - t.tf AS DOUBLE) AS b2, CAST(l.s - t.tf AS DOUBLE) AS c, CAST(w.every - st.total - l.s + t.tf AS DOUBLE) AS d
    FROM tfs t JOIN lens l USING (idx) JOIN stats st ON st.term = t.term, whole w, head h),
g AS (SELECT *, 2 * (CASE WHEN a > 0 THEN a * ln(a * (a + b2 + c + d) / ((a + b2) * (a + c))) ELSE 0 END + CASE WHEN b2 > 0 THEN b2 * ln(b2 * (a + b2 + c + d) / ((a + b2) * (b2 + d))) ELSE 0 END
    + CASE WHEN c > 0 THEN c * ln(c * (a + b2 + c + d) / ((c + d) * (a + c))) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d * (a + b2 + c + d) / ((c + d) * (b2 + d))) ELSE 0 END) AS g2,
    a >= (a + b2) * (a + c) / (a + b2 + c + d) AS above,
    ln(1 + (n - docs + 0.5) / (docs + 0.5)) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / av)) AS w FROM cells),
scored AS (SELECT idx, id, term, tf, docs, total, length, CASE WHEN above THEN greatest(g2, 0) ELSE -greatest(g2, 0) END AS llr, w AS weight, term IN (SELECT term FROM stops) AS stop FROM g)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"""WITH RECURSIVE {CURRENT}, {NODES},
para AS (SELECT id, ord, lower(trim(regexp_replace(regexp_replace(array_to_string([coalesce(json_extract_string(b, '$.spans[' || k || '].t'), '') FOR k IN range(CAST(coalesce(json_array_length(b, '$.spans'), 0) AS BIGINT))], ''), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))) AS line FROM ords WHERE json_extract_string(b, '$.type') = 'paragraph'),
long AS (SELECT p.id, ord, source_id, line FROM para p JOIN cur USING (id) WHERE len(string_split(line, ' ')) >= 4),
total AS (SELECT source_id, count(*) AS n FROM cur GROUP BY source_id),
often AS (SELECT source_id, line FROM long JOIN total USING (source_id) GROUP BY source_id, line, n HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.1 * n)
SELECT id, ord FROM long JOIN often USING (source_id, line)""",
        "p3_terms": _MARKS,
        "p3_ngrams": r"""WITH i AS (SELECT idx, [lower(w) FOR w IN regexp_extract_all(any_value(coalesce(summary, '')), '[\p{L}\p{N}]+') IF length(lower(w)) <= 40] AS t FROM index_docs WHERE idx IS NOT NULL GROUP BY idx),
g AS (SELECT idx, array_to_string(t[p : p + n - 1], ' ') AS ngram FROM (SELECT idx, t, unnest(range(1, len(t) + 1)) AS p FROM i), (SELECT unnest([1, 2, 3]) AS n) WHERE p + n - 1 <= len(t))
SELECT ngram, count(*) AS occurrences, count(DISTINCT idx) AS docs FROM g GROUP BY ngram HAVING count(DISTINCT idx) >= 3""",
        "p3_found": f"SELECT term, mark FROM ({_MARKS}) WHERE mark IN ('rare', 'common')",
        "p4_found": f"""{_SCORES}, ranked AS (SELECT id, term, row_number() OVER (PARTITION BY idx ORDER BY weight DESC, term) AS r FROM scored WHERE NOT stop AND docs >= 2)
SELECT id, term FROM ranked WHERE r = 1""",
        "p4_scores": f"{_SCORES} SELECT idx, id, term, tf, docs, total, length, round(llr, 4) + 0.0 AS llr, round(weight, 4) + 0.0 AS weight, stop FROM scored",
        "p8_found": """WITH toks AS (SELECT doc_id, [lower(w) FOR w IN regexp_extract_all(text, '[\\p{L}\\p{N}]+') IF length(w) <= 40] AS w FROM documents WHERE text IS NOT NULL),
itoks AS (SELECT item_id, [lower(w) FOR w IN regexp_extract_all(text, '[\\p{L}\\p{N}]+') IF length(w) <= 40] AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM toks)),
iw AS (SELECT item_id, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM itoks))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    }
