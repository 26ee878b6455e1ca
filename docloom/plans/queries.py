"""Queries of the core operators, by name: each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import html, robots, text, urls
from docloom.functions.blocks import parse_blocks
from docloom.functions.config import Source, boundary
from docloom.operators import crawl, indexing, nested, portal, search, snippets
from docloom.session import cut, ensure_checkpoint_dir
from docloom.sources import corpus
from docloom.sources.tables import indexed, latest, spelled, spread, table, valid_postings

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Parameters of the queries, shared with their SQL.
WORDS, PREFIXED, STOPS, PHRASE = "gateway timeout", "repl cach", "the there", "release notes"
SOURCES = ["vorlath-docs", "tasmerod-guide"]
SCOPE = Source(id="guides", name="Guides", start_urls=["https://guide.cobrelin.example/"], allowed_prefixes=["https://guide.cobrelin.example/docs/", "https://help.fenwocket.example/"], allowed_hosts=["docs.vorlath.example"], include_patterns=["/docs/|/v[0-9]+/|vorlath"], exclude_patterns=[r"\.html$", "compared"])
ROBOTS = "User-agent: *\nDisallow: /docs/\nAllow: /docs/using-\nDisallow: /*.html$\n"
SEGMENT_TERMS = ["gateway", "cache"]
FANOUT = 40


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with text, its title (an empty one if null) and its source in canonical spelling."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(F.col("doc_id").alias("doc"), spelled("source").alias("source_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))


def _crawled(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The current rows of crawl_docs."""
    return latest(table(spark, sf_dir, "crawl_docs").select("id", "indexed_at", "arrived_at", *[c for c in cols if c not in ("id", "indexed_at", "arrived_at")]), [c for c in cols if c != "id"])


def _fresh_index(spark: SparkSession, sf_dir: str) -> indexing.Index:
    """The index that postings and index_docs hold, idx as the documents' key."""
    raw = table(spark, sf_dir, "index_docs")
    postings = cut(valid_postings(table(spark, sf_dir, "postings"), raw).groupBy(F.col("idx").alias("doc"), "term").agg(F.sum("tf").cast("long").alias("tf")))
    docs = indexed(raw).withColumnRenamed("idx", "doc")
    sums = postings.groupBy("doc").agg(F.sum("tf").cast("long").alias("s"))
    docs = cut(docs.join(sums, "doc", "left").withColumn("length", F.coalesce(F.col("length").cast("long"), "s", F.lit(0).cast("long"))).drop("s"))
    return indexing.Index(postings, indexing.document_frequency(postings), docs, indexing.statistics(docs))


#: Where the index of a folder's tables is kept, for each application.
_BUILT: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str) -> indexing.Index:
    """The index as tables in order of their terms, in the shared folder: built once in an application, then only read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        corpus.write_tables(_fresh_index(spark, sf_dir), path)
        _BUILT[key] = path
    return corpus.read_tables(spark, _BUILT[key])


def _result(df: DataFrame) -> DataFrame:
    return df.select("doc", "id", "source_id", F.round("score", 6).alias("score"), "matched")


@query
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.search(_index(spark, sf_dir), WORDS))


@query
def bm25_search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.search(_index(spark, sf_dir), WORDS, limit=10))


@query
def bm25_search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.search(_index(spark, sf_dir), PREFIXED))


@query
def bm25_search_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.search(_index(spark, sf_dir), STOPS))


@query
def bm25_search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.search(_index(spark, sf_dir), WORDS, SOURCES))


@query
def bm25_search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(search.search(_index(spark, sf_dir), PHRASE))


@query
def prefix_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.candidates(_index(spark, sf_dir).terms, ["re", "cach"])


@query
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "source_manifest").select(F.col("id").alias("source_id"))
    return search.facets(search.search(_index(spark, sf_dir), WORDS), sources)


@query
def browse_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.browse(indexed(table(spark, sf_dir, "index_docs")), SOURCES).select("idx", "id", "source_id", "title", "url")


@query
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc", F.array_join(text.tokens("body"), " ").alias("tokens"))


@query
def weighted_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.weighted_postings(_docs(spark, sf_dir), {"title": 6, "body": 1})


@query
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.document_frequency(indexing.weighted_postings(_docs(spark, sf_dir), {"title": 6, "body": 1}))


@query
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return indexing.document_lengths(d.select("doc"), indexing.weighted_postings(d, {"title": 6, "body": 1}))


@query
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    s = indexing.statistics(indexing.document_lengths(d.select("doc"), indexing.weighted_postings(d, {"title": 6, "body": 1})))
    return s.withColumn("avg_doc_length", F.round("avg_doc_length", 6))


@query
def index_doc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.dense_order(_crawled(spark, sf_dir, "source_id", "title", "url")).select("id", "idx")


@query
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = indexing.posting_lists(_index(spark, sf_dir).postings, "doc")
    return lists.select("term", F.size("list").alias("n"), F.array_join(F.transform("list", lambda x: x.cast("string")), ",").alias("list"))


@query
def crawl_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index built from the crawled documents' blocks: a row a document."""
    docs = indexing.index_documents(spread(table(spark, sf_dir, "crawl_docs")))
    return indexing.build_index(docs).docs.select("doc", "length", "summary")


@query
def current_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir, "source_id", "url", "title", "indexed_at")


@query
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir, "source_id", "url").select("id", text.document_id("source_id", "url").alias("made"))


@query
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.dedup_content(_crawled(spark, sf_dir, "source_id", "url", "indexed_at", "blocks").filter("source_id IS NOT NULL")).select("id", "source_id", "url")


@query
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.summary(F.lit(None).cast("string"), "text").alias("summary"))


@query
def title_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portal.title_suffixes(indexed(table(spark, sf_dir, "index_docs")))


@query
def short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portal.short_titles(indexed(table(spark, sf_dir, "index_docs"))).select("idx", "short_title")


@query
def browse_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portal.browse_titles(indexed(table(spark, sf_dir, "index_docs"))).select("idx", "short_title", "sort_key")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ord, span, href): the links of the current documents."""
    spans = nested.span_rows(nested.block_rows(spread(table(spark, sf_dir, "crawl_docs")), ["spans"]))
    return spans.filter("h IS NOT NULL").select("id", "ord", F.col("place").alias("span"), F.col("h").alias("href"))


@query
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _crawled(spark, sf_dir, "source_id", "url", "title")
    return portal.resolve_links(_links(spark, sf_dir), docs).select("id", "ord", "span", "href", "target", "anchor")


@query
def sources_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portal.sources_overview(table(spark, sf_dir, "source_manifest"))


@query
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_manifest").select("id", crawl.status(F.col("document_count"), F.col("errors")).alias("made"), text.colour_slot("id").alias("slot"))


@query
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.relative_time(F.col("indexed_at").cast("timestamp"), F.lit("2026-09-01 00:00:00").cast("timestamp")).alias("ago"))


@query
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _crawled(spark, sf_dir, "source_id", "title")
    new = old.filter(F.col("source_id") == SOURCES[0]).withColumn("title", F.upper("title"))
    return crawl.merge_sources(old, new, SOURCES[:1], [*SOURCES, "cobrelin-guide"]).select("id", "source_id", "title")


@query
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir, "url").select("id", urls.simple_normalize("url").alias("normal"), urls.simple_clean_query("url").alias("query"), urls.non_html_col("url").alias("non_html"), text.display_url("url").alias("shown"))


@query
def url_normalize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir, "url").select("id", urls.normalize_col("url").alias("normal"), urls.normalize_col("url", True).alias("with_query"))


@query
def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir, "url").select(urls.origin_col("url").alias("origin")).groupBy("origin").agg(F.count(F.lit(1)).alias("pages"))


@query
def scope_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir, "url").select("id", boundary("url", SCOPE).alias("reason"))


@query
def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _crawled(spark, sf_dir, "url")
    answers = d.select(F.lower(urls.origin_col("url")).alias("origin")).distinct().select("origin", F.lit(200).alias("status"), F.lit(ROBOTS).alias("body"))
    return robots.decide(d, robots.rule_rows(answers, "docloom")).select("id", "allowed")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as segments: a line each, lines that begin with # as headings."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    line = d.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("ord", "text")).filter("text <> ''")
    return line.select("id", "ord", F.lit(0).alias("sub"), "text", F.col("text").startswith("$").alias("code"), F.col("text").startswith("#").alias("is_heading"), F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("heading"))


@query
def best_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.best_snippets(_lines(spark, sf_dir), SEGMENT_TERMS).select("id", F.char_length("snippet").alias("n"), "snippet")


@query
def segment_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best segment of each crawled document that has a hit."""
    parts = snippets.segments(nested.block_rows(spread(table(spark, sf_dir, "crawl_docs")), ["type", "anchor", "text", "spans", "rows"]))
    return snippets.best_parts(parts, SEGMENT_TERMS).select("id", "ord", "sub", (-F.col("s")).alias("points"), "anchor", "heading")


@query
def page_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = snippets.segments(nested.block_rows(spread(table(spark, sf_dir, "crawl_docs")), ["type", "anchor", "text", "spans", "rows"]))
    best = snippets.best_snippets(parts, SEGMENT_TERMS)
    return best.select("id", "snippet", "anchor", "heading", F.size(F.filter(snippets.highlight("snippet", SEGMENT_TERMS), lambda p: p["hit"])).alias("hits"))


@query
def table_of_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = portal.split_title(nested.block_rows(spread(table(spark, sf_dir, "crawl_docs")), ["type", "level", "anchor"])).filter("NOT is_title OR is_title IS NULL")
    heads = _crawled(spark, sf_dir, "headings").select("id", F.posexplode("headings").alias("place", "h")).select("id", "place", "h.*")
    return portal.contents(heads, b)


@query
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portal.to_markdown(nested.block_rows(spread(table(spark, sf_dir, "crawl_docs")), ["type", "level", "text", "lang", "spans", "rows"]))


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        made = [f"<html><head><title>{escape(t or '')}</title></head><body><main>{html.render(parse_blocks(b))}</main></body></html>" for t, b in zip(rb.column("title").to_pylist(), rb.column("blocks").to_pylist())]
        yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("url"), rb.column("indexed_at"), pa.array(made, pa.string())], ["id", "url", "indexed_at", "html"])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current documents as HTML pages, all their blocks rendered; of a URL the page of the newest document."""
    d = _crawled(spark, sf_dir, "url", "title", "indexed_at", "blocks").select("id", urls.normalize_col("url").alias("url"), "indexed_at", "title", "blocks").filter("url IS NOT NULL")
    page = d.mapInArrow(_rendered, "id string, url string, indexed_at timestamp, html string")
    return page.groupBy("url").agg(F.max_by(F.struct("id", "html"), F.struct("indexed_at", "id")).alias("p")).select("url", "p.id", "p.html")


@query
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the extraction of every rendered page finds, by kind of block at any depth."""
    got = html.extract(_pages(spark, sf_dir))
    b = nested.block_rows(got.select(F.col("url").alias("id"), F.lit(0).alias("indexed_at"), F.lit(0).alias("arrived_at"), "blocks"), ["type", "rows"])
    kinds = b.groupBy("id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in ("code", "table")], F.sum(F.when(F.col("type") == "table", F.size("rows")).otherwise(0)).alias("rows"))
    return got.select(F.col("url").alias("id"), F.size("headings").alias("headings")).join(kinds, "id", "left").na.fill(0).withColumnRenamed("id", "url")


@query
def crawl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl over the pages of all sites at once, each page with links to FANOUT others in order of their URLs."""
    listed = indexing.dense_order(_pages(spark, sf_dir).select("url", "html"), order=("url",))
    below = listed.filter("idx > 0").groupBy(F.floor((F.col("idx") - 1) / FANOUT).alias("idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "url"))), lambda x: F.concat(F.lit('<a href="'), x["url"], F.lit('">x</a> '))), "").alias("links"))  # FANOUT links at most
    pages = cut(listed.join(below, "idx", "left").select("idx", "url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("redirect_to"), F.concat(F.coalesce("links", F.lit("")), F.lit("<main><p>"), "url", F.lit("</p></main>")).alias("html")))
    first = pages.filter("idx = 0").select("url").collect()
    hosts = [r["host"] for r in pages.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host")).distinct().collect()]  # a row a site
    source = Source(id="all", name="All", start_urls=[r["url"] for r in first], allowed_hosts=hosts, max_pages=(1 << 31) - 1, max_depth=0)
    return crawl.crawl(source, pages.drop("idx")).log.filter("outcome = 'page'").select("url", "depth")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nested_places(spread(table(spark, sf_dir, "crawl_docs")))


@query
def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = nested.block_rows(spread(table(spark, sf_dir, "crawl_docs")), ["type", "level", "anchor", "text", "lang", "ordered", "header"])
    return b.withColumns({c: F.col(c).cast("int") for c in ("ordered", "header")})


@query
def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nested.span_rows(nested.block_rows(spread(table(spark, sf_dir, "crawl_docs")), ["spans"]))
    return s.withColumns({c: F.col(c).cast("int") for c in ("c", "b", "i")})


@query
def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.cell_rows(nested.block_rows(spread(table(spark, sf_dir, "crawl_docs")), ["rows"]))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
