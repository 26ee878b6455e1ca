"""Oracle SQL of the core queries, for DuckDB on the same tables."""

from __future__ import annotations

from docloom.functions.html import SKIPPED_NAMES
from docloom.functions.text import STOP_WORDS
from docloom.functions.urls import NON_HTML

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, arrived_at DESC NULLS LAST) AS rn FROM crawl_docs WHERE id IS NOT NULL) WHERE rn = 1)"
_TOKENS = r"[lower(w) FOR w IN regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+') IF length(lower(w)) <= 40]"
_DOCS = f"""d AS (SELECT doc_id AS doc, coalesce(title, '') AS title, coalesce("text", '') AS body FROM documents),
w AS (SELECT doc, unnest({_TOKENS.format("title")}) AS term, 6 AS w FROM d UNION ALL SELECT doc, unnest({_TOKENS.format("body")}), 1 FROM d),
tf AS (SELECT doc, term, CAST(sum(w) AS BIGINT) AS tf FROM w WHERE term NOT IN ({_STOPS}) GROUP BY doc, term),
len AS (SELECT d.doc, CAST(coalesce(sum(tf), 0) AS BIGINT) AS length FROM d LEFT JOIN tf USING (doc) GROUP BY d.doc)"""
_INDEX = """idx AS (SELECT DISTINCT * FROM index_docs WHERE idx IS NOT NULL),
p AS (SELECT idx AS doc, term, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT DISTINCT source_id, term, idx, tf FROM postings WHERE term IS NOT NULL AND term <> '' AND idx IN (SELECT idx FROM idx)) GROUP BY 1, 2),
terms AS (SELECT term, count(*) AS df FROM p GROUP BY term),
dl AS (SELECT i.idx AS doc, any_value(i.id) AS id, any_value(i.source_id) AS source_id, any_value(i.title) AS title, any_value(i.url) AS url, CAST(coalesce(any_value(i.length), sum(p.tf), 0) AS BIGINT) AS length FROM idx i LEFT JOIN p ON p.doc = i.idx GROUP BY i.idx),
st AS (SELECT count(*) AS n, avg(length) AS av FROM dl)"""


def _search(wanted: list[str], phrase: str, where: str = "", tail: str = "") -> str:
    values = ", ".join(f"('{t}')" for t in wanted)
    several = "TRUE" if len(wanted) > 1 else "FALSE"
    return f"""WITH {_INDEX}, q AS (SELECT * FROM (VALUES {values}) v(qt)),
hit AS (SELECT qt, term, df FROM q, terms WHERE term = qt OR (length(qt) >= 2 AND starts_with(term, qt))),
cand AS (SELECT qt, term, df, 1.0::DOUBLE AS f FROM hit WHERE term = qt UNION ALL
  SELECT qt, term, df, 0.5::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY qt ORDER BY df DESC, term) AS r FROM hit WHERE term <> qt) WHERE r <= 30),
s AS (SELECT p.doc, c.qt, max(c.f * ln(1 + (n - c.df + 0.5) / (c.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * dl.length / av))) AS s FROM cand c JOIN p USING (term) JOIN dl USING (doc), st GROUP BY p.doc, c.qt),
t AS (SELECT doc, sum(s) AS s, count(*) AS matched FROM s GROUP BY doc)
SELECT doc, id, source_id, round(s * pow(matched / {len(wanted)}.0::DOUBLE, 2) * CASE WHEN lower(title) = '{phrase}' THEN 2.0 WHEN {several} AND contains(lower(title), '{phrase}') THEN 1.5 ELSE 1.0 END, 6) AS score, matched
FROM t JOIN dl USING (doc) {where} {tail}"""


#: Recursive part of a WITH clause: all blocks of the current documents with their pre-order places.
NODES = """nodes AS (
  SELECT id, 0 AS depth, [k] AS path, NULL::BIGINT[] AS up, 0 AS i, CAST(k AS INT) AS j, json_extract(blocks, '$[' || k || ']') AS b FROM (SELECT id, blocks, unnest(range(CAST(json_array_length(blocks) AS BIGINT))) AS k FROM cur WHERE blocks IS NOT NULL AND blocks <> '')
  UNION ALL
  SELECT id, depth + 1, path || [x.kind, x.i, x.j], path, CAST(x.i AS INT), CAST(x.j AS INT), json_extract(b, CASE WHEN x.kind = 0 THEN '$.items[' || x.i || '][' || x.j || ']' ELSE '$.children[' || x.j || ']' END)
  FROM (SELECT id, depth, path, b, unnest(list_concat(
    flatten([[{'kind': 0, 'i': i, 'j': j} FOR j IN range(CAST(coalesce(json_array_length(b, '$.items[' || i || ']'), 0) AS BIGINT))] FOR i IN range(CAST(coalesce(json_array_length(b, '$.items'), 0) AS BIGINT))]),
    [{'kind': 1, 'i': 0, 'j': j} FOR j IN range(CAST(coalesce(json_array_length(b, '$.children'), 0) AS BIGINT))])) AS x FROM nodes)
),
ords AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY path) - 1 AS INT) AS ord FROM nodes WHERE b IS NOT NULL AND json_type(b) = 'OBJECT')"""


#: Of the blocks in ords: kind, the spans' text, the rows' texts.
_KIND = "json_extract_string(b, '$.type')"
_SPANS = "array_to_string([coalesce(json_extract_string(b, '$.spans[' || k || '].t'), '') FOR k IN range(CAST(coalesce(json_array_length(b, '$.spans'), 0) AS BIGINT))], '')"


def _rows(sep: str, null: str = "NULL") -> str:
    """The texts of a table's rows, as a list."""
    cells = f"[coalesce(json_extract_string(b, '$.rows[' || r || '][' || c || ']'), {null}) FOR c IN range(CAST(coalesce(json_array_length(b, '$.rows[' || r || ']'), 0) AS BIGINT))]"
    return f"[array_to_string({cells}, '{sep}') FOR r IN range(CAST(coalesce(json_array_length(b, '$.rows'), 0) AS BIGINT))]"


def _weight(column: str, w: int) -> str:
    return f"{w} * len([t FOR t IN {_TOKENS.format(column)} IF t NOT IN ({_STOPS})])"


def _extra(simple: str) -> dict[str, str]:
    """Queries over the blocks; simple is the SQL of url_normalize without the current rows, for which it says cur."""
    escaped = "array_to_string([CASE WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END FOR c IN string_split({0}, '')], '')"
    with_nodes = f"WITH RECURSIVE {CURRENT}, {NODES}"
    field = lambda f: f"json_extract_string(b, '$.spans[' || k || '].{f}')"
    span = f"[CASE WHEN {field('h')} IS NOT NULL THEN '[' || {field('t')} || '](' || {field('h')} || ')' WHEN {field('c')} = 'true' THEN '`' || {field('t')} || '`' WHEN {field('b')} = 'true' THEN '**' || {field('t')} || '**' WHEN {field('i')} = 'true' THEN '*' || {field('t')} || '*' ELSE {field('t')} END FOR k IN range(CAST(coalesce(json_array_length(b, '$.spans'), 0) AS BIGINT))]"
    skipped = ", ".join(f"'{x}'" for x in sorted(SKIPPED_NAMES))  # an anchor of that name is page furniture
    has = lambda f: f"json_type(json_extract(b, '$.{f}')) = 'ARRAY'"
    page = f"{with_nodes}, n AS ({simple}), page AS (SELECT {escaped.format('normal')} AS url, arg_max(n.id, (cur.indexed_at, n.id)) AS id FROM n JOIN cur USING (id) WHERE normal IS NOT NULL GROUP BY 1)"
    return {
        "p5_spans": f"{with_nodes} SELECT id, ord, CAST(k AS INT) AS place, {field('t')} AS t, {', '.join(f'CAST(CAST({field(x)} AS BOOLEAN) AS INT) AS {x}' for x in 'cbi')}, {field('h')} AS h FROM (SELECT id, ord, b, unnest(range(CAST(coalesce(json_array_length(b, '$.spans'), 0) AS BIGINT))) AS k FROM ords)",
        "crawl_index": f"""{with_nodes}, part AS (SELECT id, ord, {_KIND} AS kind, {_SPANS} AS s, coalesce(json_extract_string(b, '$.text'), '') AS code, array_to_string({_rows(' ')}, ' ') AS cells FROM ords),
f AS (SELECT id, string_agg(CASE WHEN kind = 'heading' THEN s END, ' ' ORDER BY ord) AS h, string_agg(CASE kind WHEN 'paragraph' THEN s WHEN 'code' THEN code WHEN 'table' THEN cells END, ' ' ORDER BY ord) AS b, string_agg(CASE WHEN kind = 'paragraph' THEN s END, ' ' ORDER BY ord) AS p FROM part GROUP BY id),
t AS (SELECT cur.id AS doc, coalesce(title, '') AS title, coalesce(h, '') AS h, coalesce(b, '') AS b, trim(regexp_replace(coalesce(nullif(trim(description), ''), p, ''), '\s+', ' ', 'g')) AS t FROM cur LEFT JOIN f USING (id)),
x AS (SELECT *, left(t, 240) AS head, regexp_extract(left(t, 240), '(?s)^(.*) ', 1) AS before FROM t)
SELECT doc, CAST({_weight('title', 6)} + {_weight('h', 3)} + {_weight('b', 1)} AS BIGINT) AS length, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(CASE WHEN contains(head, ' ') AND octet_length(encode(before)) > 120 THEN before ELSE head END, '[ ,.;:]+$', '') || '…' END AS summary FROM x""",
        "browse_titles": _suffixes() + r""", s AS (SELECT i.idx, trim(CASE WHEN suffix IS NOT NULL AND ends_with(coalesce(title, ''), suffix) AND length(coalesce(title, '')) > length(suffix) THEN left(title, length(title) - length(suffix)) ELSE coalesce(title, '') END) AS short_title FROM i LEFT JOIN best USING (source_id))
SELECT idx, short_title, array_to_string([CASE WHEN regexp_matches(p, '^\d+$') THEN lpad(CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END, 20, '0') ELSE p END FOR p IN regexp_extract_all(lower(strip_accents(short_title)), '\d+|\D+')], '') AS sort_key FROM s""",
        "url_normalize_full": f"WITH {CURRENT}, n AS ({simple}), e AS (SELECT id, {escaped.format('normal')} AS normal, query FROM n) SELECT id, normal, normal || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS with_query FROM e",
        "markdown": f"""SELECT * FROM ({with_nodes}, l AS (SELECT id, ord, {_KIND} AS kind, CASE WHEN {has('spans')} THEN array_to_string({span}, '') END AS s, b FROM ords)
SELECT id, ord, CASE kind WHEN 'heading' THEN repeat('#', coalesce(CAST(json_extract_string(b, '$.level') AS INT), 1)) || ' ' || s WHEN 'code' THEN '```' || coalesce(json_extract_string(b, '$.lang'), '') || chr(10) || coalesce(json_extract_string(b, '$.text'), '') || chr(10) || '```'
WHEN 'table' THEN CASE WHEN {has('rows')} THEN array_to_string(['| ' || x || ' |' FOR x IN {_rows(' | ', "''")}], chr(10)) END WHEN 'paragraph' THEN s END AS line FROM l) WHERE line IS NOT NULL""",
        "table_of_contents": f"""{with_nodes}, top AS (SELECT id, ord, {_KIND} AS kind, CAST(json_extract_string(b, '$.level') AS INT) AS level, json_extract_string(b, '$.anchor') AS anchor FROM ords WHERE depth = 0),
told AS (SELECT *, coalesce(ord = min(CASE WHEN kind = 'heading' THEN ord END) OVER (PARTITION BY id) AND level = 1 AND count(CASE WHEN kind = 'heading' AND level = 1 THEN 1 END) OVER (PARTITION BY id) = 1, FALSE) AS is_title FROM top),
h AS (SELECT id, CAST(k AS INT) AS place, x.level AS level, x.text AS text, x.anchor AS anchor FROM (SELECT id, unnest(headings) AS x, unnest(range(len(headings))) AS k FROM cur)),
kept AS (SELECT * FROM h WHERE level <= 4 AND EXISTS (SELECT 1 FROM told t WHERE t.id = h.id AND t.anchor = h.anchor AND t.kind = 'heading' AND NOT t.is_title))
SELECT id, place, level, text, anchor, CAST(least(level - min(level) OVER (PARTITION BY id), 3) AS INT) AS depth FROM kept QUALIFY count(*) OVER (PARTITION BY id) > 1""",
        "segment_choice": f"""{with_nodes}, o AS (SELECT id, ord, {_KIND} AS kind, b, CASE WHEN {_KIND} = 'code' THEN coalesce(json_extract_string(b, '$.text'), '') WHEN {_KIND} IN ('heading', 'paragraph') THEN {_SPANS} END AS own FROM ords),
hd AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN {{'anchor': json_extract_string(b, '$.anchor'), 'heading': own}} END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM o),
ls AS (SELECT *, CASE WHEN kind = 'table' THEN {_rows(' · ')} WHEN own IS NOT NULL THEN [own] END AS texts FROM hd),
seg AS (SELECT id, ord, kind, h, unnest(texts) AS t, CAST(unnest(range(len(texts))) AS INT) AS sub FROM ls),
hit AS (SELECT *, len(list_distinct([CASE WHEN starts_with(w, 'gateway') THEN 'gateway' ELSE 'cache' END FOR w IN {_TOKENS.format('t')} IF starts_with(w, 'gateway') OR starts_with(w, 'cache')])) AS n FROM seg WHERE t <> '')
SELECT id, ord, sub, CAST(n * 10 + CASE WHEN kind = 'code' THEN 0 ELSE 2 END + CASE WHEN kind = 'heading' THEN 0 ELSE 1 END AS INT) AS points, h.anchor AS anchor, h.heading AS heading FROM hit WHERE n > 0
QUALIFY row_number() OVER (PARTITION BY id ORDER BY points DESC, ord, sub) = 1""",
        "extract_pages": f"""{page}, k AS (SELECT id, count(CASE WHEN {_KIND} = 'heading' AND coalesce(lower(json_extract_string(b, '$.anchor')), '') NOT IN ({skipped}) AND trim(regexp_replace({_SPANS}, '[\s¶#§]+', '', 'g')) <> '' THEN 1 END) AS headings, count(CASE WHEN {_KIND} = 'code' AND trim(coalesce(json_extract_string(b, '$.text'), '')) <> '' THEN 1 END) AS code,
sum(CASE WHEN {_KIND} = 'table' THEN len([1 FOR r IN range(CAST(coalesce(json_array_length(b, '$.rows'), 0) AS BIGINT)) IF json_array_length(b, '$.rows[' || r || ']') > 0]) ELSE 0 END) AS rows, count(CASE WHEN {_KIND} = 'table' AND len([1 FOR r IN range(CAST(coalesce(json_array_length(b, '$.rows'), 0) AS BIGINT)) IF json_array_length(b, '$.rows[' || r || ']') > 0]) > 0 THEN 1 END) AS tables FROM ords GROUP BY id)
SELECT url, CAST(coalesce(headings, 0) AS INT) AS headings, coalesce(code, 0) AS code, coalesce(tables, 0) AS "table", CAST(coalesce(rows, 0) AS BIGINT) AS rows FROM page LEFT JOIN k USING (id)""",
        "crawl_replay": f"""{page}, o AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS k FROM page)
SELECT url, CAST(CASE WHEN k = 0 THEN 0 WHEN k <= 40 THEN 1 WHEN k <= 1640 THEN 2 WHEN k <= 65640 THEN 3 WHEN k <= 2625640 THEN 4 ELSE 5 END AS INT) AS depth FROM o""",
    }


def oracle_sql() -> dict[str, str]:
    every = _plain()
    return every | _extra(every["url_normalize"].replace(CURRENT + ", ", "", 1))


def _plain() -> dict[str, str]:
    endings = ", ".join(f"'{e}'" for e in sorted(NON_HTML))
    scheme_host = "regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)"
    path = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    return {
        "bm25_search": _search(["gateway", "timeout"], "gateway timeout"),
        "bm25_search_top10": _search(["gateway", "timeout"], "gateway timeout", tail="ORDER BY s * pow(matched / 2.0::DOUBLE, 2) * CASE WHEN lower(title) = 'gateway timeout' THEN 2.0 WHEN contains(lower(title), 'gateway timeout') THEN 1.5 ELSE 1.0 END DESC, doc LIMIT 10"),
        "bm25_search_prefix": _search(["repl", "cach"], "repl cach"),
        "bm25_search_stop_words": _search(["the", "there"], "the there"),
        "bm25_search_sources": _search(["gateway", "timeout"], "gateway timeout", "WHERE source_id IN ('vorlath-docs', 'tasmerod-guide')"),
        "bm25_search_phrase": _search(["release", "notes"], "release notes"),
        "prefix_expansion": f"""WITH {_INDEX}, q AS (SELECT * FROM (VALUES ('re'), ('cach')) v(qt)), hit AS (SELECT qt, term, df FROM q, terms WHERE starts_with(term, qt))
SELECT qt, term, df, 1.0::DOUBLE AS factor FROM hit WHERE term = qt UNION ALL SELECT qt, term, df, 0.5::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY qt ORDER BY df DESC, term) AS r FROM hit WHERE term <> qt) WHERE r <= 30""",
        "facet_counts": f"SELECT m.id AS source_id, count(r.doc) AS hits FROM (SELECT DISTINCT id FROM source_manifest) m LEFT JOIN ({_search(['gateway', 'timeout'], 'gateway timeout')}) r ON r.source_id = m.id GROUP BY m.id",
        "browse_docs": "SELECT DISTINCT idx, id, source_id, title, url FROM index_docs WHERE source_id IN ('vorlath-docs', 'tasmerod-guide')",
        "tokenize_docs": f"WITH {_DOCS} SELECT doc, array_to_string({_TOKENS.format('body')}, ' ') AS tokens FROM d",
        "weighted_postings": f"WITH {_DOCS} SELECT doc, term, tf FROM tf",
        "document_frequency": f"WITH {_DOCS} SELECT term, count(*) AS df FROM tf GROUP BY term",
        "doc_length": f"WITH {_DOCS} SELECT doc, length FROM len",
        "index_stats": f"WITH {_DOCS} SELECT count(*) AS n, round(coalesce(avg(length), 0), 6) AS avg_doc_length, 1.2::DOUBLE AS k1, 0.75::DOUBLE AS b, 6 AS w_title, 3 AS w_heading, 1 AS w_body FROM len",
        "index_doc_order": f"WITH {CURRENT} SELECT id, row_number() OVER (ORDER BY source_id NULLS FIRST, title NULLS FIRST, url NULLS FIRST) - 1 AS idx FROM cur",
        "posting_lists": f"WITH {_INDEX} SELECT term, CAST(2 * count(*) AS INT) AS n, string_agg(doc || ',' || tf, ',' ORDER BY doc) AS list FROM p GROUP BY term",
        "current_docs": f"WITH {CURRENT} SELECT id, source_id, url, title, indexed_at FROM cur",
        "document_ids": f"WITH {CURRENT} SELECT id, left(sha256(source_id || chr(0) || url), 16) AS made FROM cur",
        "content_dedup": f"""WITH RECURSIVE {CURRENT}, {NODES},
part AS (SELECT id, path, concat_ws(chr(31), CAST(path AS VARCHAR), {", ".join(f"nullif(nullif(json_extract_string(b, '$.{f}'), ''), 'false') || '{f}'" for f in ("type", "level", "anchor", "text", "lang", "ordered", "header"))},
  array_to_string([concat_ws(chr(30), {", ".join(f"nullif(nullif(json_extract_string(b, '$.spans[' || k || '].{f}'), ''), 'false') || '{f}'" for f in "tcbih")}) FOR k IN range(CAST(coalesce(json_array_length(b, '$.spans'), 0) AS BIGINT))], chr(29)), CAST(json(json_extract(b, '$.rows')) AS VARCHAR)) AS s FROM ords),
whole AS (SELECT id, string_agg(s, chr(28) ORDER BY path) AS h FROM part GROUP BY id)
SELECT id, source_id, url FROM (SELECT cur.id, source_id, url, row_number() OVER (PARTITION BY source_id, coalesce(h, '') ORDER BY indexed_at, url, cur.id) AS k FROM cur LEFT JOIN whole USING (id) WHERE source_id IS NOT NULL) WHERE k = 1""",
        "summaries": r"""WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce("text", ''), '\s+', ' ', 'g')) AS t FROM documents),
h AS (SELECT doc_id, t, left(t, 240) AS head, regexp_extract(left(t, 240), '(?s)^(.*) ', 1) AS before FROM s)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(CASE WHEN contains(head, ' ') AND octet_length(encode(before)) > 120 THEN before ELSE head END, '[ ,.;:]+$', '') || '…' END AS summary FROM h""",
        "title_suffixes": _suffixes() + " SELECT source_id, suffix FROM best",
        "short_titles": _suffixes() + " SELECT i.idx, trim(CASE WHEN suffix IS NOT NULL AND ends_with(coalesce(title, ''), suffix) AND length(coalesce(title, '')) > length(suffix) THEN left(title, length(title) - length(suffix)) ELSE coalesce(title, '') END) AS short_title FROM i LEFT JOIN best USING (source_id)",
        "resolve_links": f"""WITH RECURSIVE {CURRENT}, {NODES}, first AS (SELECT url, arg_min(id, (source_id, coalesce(title, ''), id)) AS target FROM cur WHERE url IS NOT NULL GROUP BY url),
l AS (SELECT id, ord, span, json_extract_string(b, '$.spans[' || span || '].h') AS href FROM (SELECT id, ord, b, CAST(unnest(range(CAST(coalesce(json_array_length(b, '$.spans'), 0) AS BIGINT))) AS INT) AS span FROM ords))
SELECT l.id, ord, span, href, target, CASE WHEN target IS NOT NULL THEN nullif(regexp_extract(href, '#(.*)$', 1), '') END AS anchor FROM l LEFT JOIN first ON first.url = regexp_extract(href, '^([^#]*)', 1) WHERE href IS NOT NULL""",
        "sources_overview": "SELECT id, coalesce(name, id) AS name, status, document_count, pages_fetched, pages_skipped, errors, CAST(coalesce(len(error_samples), 0) AS INT) AS samples, array_to_string(start_urls, ' ') AS start_urls, indexed_at FROM source_manifest",
        "source_status": "SELECT id, CASE WHEN document_count = 0 THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'ok' END AS made, CAST(list_reduce(list_prepend(0::BIGINT, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(id, '')]), lambda a, c: (a * 31 + c) % 4294967296) % 8 AS INT) AS slot FROM source_manifest",
        "relative_times": """WITH a AS (SELECT doc_id, epoch(TIMESTAMP '2026-09-01') - floor(epoch(indexed_at)) AS s FROM documents),
b AS (SELECT doc_id, s, CASE WHEN s >= 31536000 THEN 31536000 WHEN s >= 2592000 THEN 2592000 WHEN s >= 604800 THEN 604800 WHEN s >= 86400 THEN 86400 WHEN s >= 3600 THEN 3600 WHEN s >= 60 THEN 60 END AS u FROM a)
SELECT doc_id, CASE WHEN u IS NULL THEN 'just now' ELSE CAST(floor(s / u) AS BIGINT) || ' ' || CASE u WHEN 31536000 THEN 'year' WHEN 2592000 THEN 'month' WHEN 604800 THEN 'week' WHEN 86400 THEN 'day' WHEN 3600 THEN 'hour' ELSE 'minute' END || CASE WHEN floor(s / u) = 1 THEN '' ELSE 's' END || ' ago' END AS ago FROM b""",
        "incremental_merge": f"WITH {CURRENT} SELECT id, source_id, title FROM cur WHERE source_id IN ('tasmerod-guide', 'cobrelin-guide') UNION ALL SELECT id, source_id, upper(title) FROM cur WHERE source_id = 'vorlath-docs'",
        "url_normalize": f"""WITH {CURRENT}, x AS (SELECT id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, regexp_replace({path}, '/(\\.?/)+', '/', 'g') AS p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM (SELECT id, trim(url) AS url FROM cur)),
y AS (SELECT *, regexp_replace(CASE WHEN scheme = 'https' THEN regexp_replace(h, ':443$', '') ELSE regexp_replace(h, ':80$', '') END, '\\.($|:)', '\\1') AS host FROM x)
SELECT id, CASE WHEN scheme IN ('http', 'https') AND host <> '' AND NOT contains(host, '@') THEN scheme || '://' || host || CASE WHEN p = '' THEN '/' ELSE p END END AS normal,
array_to_string(list_sort([s FOR s IN string_split(q, '&') IF s <> '' AND NOT starts_with(lower(split_part(s, '=', 1)), 'utm_') AND lower(split_part(s, '=', 1)) NOT IN ('fbclid', 'gclid', 'ref_src')]), '&') AS query,
lower(regexp_extract({path}, '(\\.[^./]*)$', 1)) IN ({endings}) AS non_html, regexp_replace(url, '^https?://', '') AS shown FROM y""",
        "origins": f"WITH {CURRENT} SELECT {scheme_host} AS origin, count(*) AS pages FROM cur GROUP BY 1",
        "scope_reasons": f"""WITH {CURRENT}, x AS (SELECT id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS loc, {path} AS p, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS q FROM cur),
y AS (SELECT *, CASE WHEN scheme = 'https' THEN regexp_replace(lower(loc), ':443$', '') ELSE regexp_replace(lower(loc), ':80$', '') END AS host FROM x), z AS (SELECT *, scheme || '://' || host || CASE WHEN p = '' THEN '/' ELSE p END AS bare FROM y)
SELECT id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN contains(loc, '@') THEN 'credentials' WHEN loc = '' THEN 'host'
WHEN NOT (host IN ('docs.vorlath.example') OR starts_with(bare, 'https://guide.cobrelin.example/docs/') OR starts_with(bare, 'https://help.fenwocket.example/')) THEN 'outside'
WHEN NOT regexp_matches(bare || q, '/docs/|/v[0-9]+/|vorlath') THEN 'not included' WHEN regexp_matches(bare || q, '\\.html$') OR regexp_matches(bare || q, 'compared') THEN 'excluded' ELSE '' END AS reason FROM z""",
        "robots_decisions": f"""WITH {CURRENT}, x AS (SELECT id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS p FROM cur), y AS (SELECT id, CASE WHEN p = '' THEN '/' WHEN starts_with(p, '?') THEN '/' || p ELSE p END AS p FROM x)
SELECT id, CASE WHEN p = '/robots.txt' THEN TRUE WHEN starts_with(p, '/docs/using-') THEN TRUE WHEN ends_with(p, '.html') THEN FALSE WHEN starts_with(p, '/docs/') THEN FALSE ELSE TRUE END AS allowed FROM y""",
        "p5_found": f"""WITH RECURSIVE {CURRENT}, {NODES}
SELECT c.id, 'block' AS kind, o.ord AS owner_ord, c.i, c.j FROM ords c JOIN ords o ON o.id = c.id AND o.path = c.up
UNION ALL SELECT id, 'link', ord, 0, CAST(k AS INT) FROM (SELECT id, ord, b, unnest(range(CAST(coalesce(json_array_length(b, '$.spans'), 0) AS BIGINT))) AS k FROM ords) WHERE json_extract_string(b, '$.spans[' || k || '].h') IS NOT NULL
UNION ALL SELECT id, 'cell', ord, CAST(r AS INT), CAST(c AS INT) FROM (SELECT id, ord, b, r, unnest(range(CAST(coalesce(json_array_length(b, '$.rows[' || r || ']'), 0) AS BIGINT))) AS c FROM (SELECT id, ord, b, unnest(range(CAST(coalesce(json_array_length(b, '$.rows'), 0) AS BIGINT))) AS r FROM ords)) WHERE json_extract_string(b, '$.rows[' || r || '][' || c || ']') IS NOT NULL""",
        "p5_blocks": f"""WITH RECURSIVE {CURRENT}, {NODES}
SELECT c.id, c.ord, o.ord AS owner_ord, c.depth, c.i, c.j, json_extract_string(c.b, '$.type') AS type, CAST(json_extract_string(c.b, '$.level') AS INT) AS level, json_extract_string(c.b, '$.anchor') AS anchor, json_extract_string(c.b, '$.text') AS text, json_extract_string(c.b, '$.lang') AS lang, CAST(CAST(json_extract_string(c.b, '$.ordered') AS BOOLEAN) AS INT) AS ordered, CAST(CAST(json_extract_string(c.b, '$.header') AS BOOLEAN) AS INT) AS header
FROM ords c LEFT JOIN ords o ON o.id = c.id AND o.path = c.up""",
        "p5_cells": f"""WITH RECURSIVE {CURRENT}, {NODES}
SELECT id, ord, CAST(r AS INT) AS row, CAST(c AS INT) AS col, json_extract_string(b, '$.rows[' || r || '][' || c || ']') AS cell FROM (SELECT id, ord, b, r, unnest(range(CAST(coalesce(json_array_length(b, '$.rows[' || r || ']'), 0) AS BIGINT))) AS c FROM (SELECT id, ord, b, unnest(range(CAST(coalesce(json_array_length(b, '$.rows'), 0) AS BIGINT))) AS r FROM ords))""",
    }


def _suffixes() -> str:
    return r"""WITH i AS (SELECT DISTINCT idx, source_id, title FROM index_docs WHERE idx IS NOT NULL),
e AS (SELECT DISTINCT idx, source_id, substr(t, k) AS suffix FROM (SELECT idx, source_id, coalesce(title, '') AS t, unnest(range(2, length(coalesce(title, '')) + 1)) AS k FROM i)
  WHERE starts_with(substr(t, k), ' - ') OR starts_with(substr(t, k), ' — ') OR starts_with(substr(t, k), ' – ') OR starts_with(substr(t, k), ' | ') OR starts_with(substr(t, k), ' · ') OR starts_with(substr(t, k), ' :: ')),
n AS (SELECT source_id, count(*) AS n FROM i GROUP BY source_id),
c AS (SELECT source_id, suffix, count(*) AS c FROM e GROUP BY source_id, suffix),
best AS (SELECT source_id, suffix FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY c DESC, length(suffix) DESC, suffix) AS r FROM c JOIN n USING (source_id) WHERE n >= 2 AND c >= greatest(2, ceil(n / 2))) WHERE r = 1)"""
