"""Crawling as dataflow: a level-by-level walk over fetched pages, with boundaries, robots rules, caps and deduplication.

The pages come from a table (or a fetcher that makes one): url, status, content_type, redirect_to, html.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.functions import html, robots, text, urls
from docloom.functions.config import Settings, Source, boundary
from docloom.operators.indexing import dense_order
from docloom.session import cut

#: Redirects followed from one URL, and error samples kept for a source.
MOST_REDIRECTS, SAMPLES = 5, 20


Fetcher = Callable[[str], tuple[int | None, str | None, str | None, str | None]]


@dataclass(frozen=True)
class Crawl:
    """documents of one source and the log of its requests (url, depth, place, outcome, message, out_of_scope)."""

    documents: DataFrame
    log: DataFrame


def is_html(content_type: Column, body: Column) -> Column:
    """Whether a response is a page, by its type or, without one, by how its body begins."""
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    sniffed = F.lower(F.substring(body, 1, 512)).rlike(r"^\s*(?:<!--.*?-->\s*)*<(?:!doctype html|html|head|body|title|h1|div|p|a|table|script|style|br|b)\b")
    return kind.isin("text/html", "application/xhtml+xml") | (~kind.contains("/") & sniffed)


def retryable(status: Column) -> Column:
    """Whether a response is worth a second request: none at all, too many requests, or a server's error."""
    return status.isNull() | (status == 429) | (status >= 500)


def classify(pages: DataFrame, most_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """pages with ``outcome``: page, error (status), not_html, too_large."""
    s = F.col("status")
    out = F.when(s.isNull() | (s != 200), "error").when(~is_html(F.col("content_type"), F.col("html")), "not_html").when(F.octet_length("html") > most_bytes, "too_large").otherwise("page")
    return pages.withColumn("outcome", out)


def follow_redirects(wanted: DataFrame, pages: DataFrame, source: Source, rules: DataFrame | None) -> DataFrame:
    """wanted (url, depth, place) with ``final`` and ``refused``: where redirects lead; one that leaves the boundary or robots is refused."""
    hops = pages.filter("status BETWEEN 300 AND 399 AND redirect_to IS NOT NULL").select(F.col("url").alias("final"), urls.resolve_col("url", "redirect_to", source.keep_query_strings).alias("to"))
    now = wanted.withColumn("final", F.col("url")).withColumn("refused", F.lit(False))
    for _ in range(MOST_REDIRECTS):
        step = now.join(hops, "final", "left")
        bad = F.col("to").isNull() | (boundary("to", source) != "")
        step = robots.decide(step, rules, "to").withColumn("bad", bad | ~F.col("allowed")).drop("allowed") if rules is not None else step.withColumn("bad", bad)
        moved = F.col("to").isNotNull()
        now = step.select("url", "depth", "place", F.when(moved & ~F.col("refused") & ~F.col("bad"), F.col("to")).otherwise(F.col("final")).alias("final"), (F.col("refused") | (moved & F.col("bad"))).alias("refused"))
    return now


def crawl(source: Source, pages: DataFrame, robots_responses: DataFrame | None = None, respects_robots: bool = True, settings: Settings | None = None, token: str = "docloom") -> Crawl:
    """The documents that a source's crawl over the given pages finds.

    Levels are walked in order of (depth, place found, url). A level's links pass, in this order: canonical form, not seen,
    boundary, not a file, depth; then robots, which costs no request; then the cap of requests. Redirects are followed
    within the boundary; a page reached twice, and a page whose blocks another page has, is skipped. With robots respected,
    nofollow stops a page's links and noindex its document. Pages without content are skipped.
    """
    spark = pages.sparkSession
    settings = settings or Settings()
    rules = cut(robots.rule_rows(robots_responses, token)) if respects_robots and robots_responses is not None else None
    keep = source.keep_query_strings
    starts = list(dict.fromkeys(u for u in (urls.normalize(s, keep) for s in source.start_urls) if u))
    frontier = spark.createDataFrame([(u, k) for k, u in enumerate(starts)], "url string, place long")
    fetched = classify(pages, settings.max_page_bytes)
    seen = frontier.select("url")
    log, docs, asked, depth = None, None, 0, 0
    while True:
        found = frontier.withColumn("depth", F.lit(depth))
        found = robots.decide(found, rules) if rules is not None else found.withColumn("allowed", F.lit(True))
        ask = cut(found.filter("allowed").orderBy("place", "url").limit(max(0, source.max_pages - asked)).drop("allowed"))
        n = ask.count()
        if not n:
            break
        asked += n
        led = follow_redirects(ask, pages, source, rules)
        got = led.join(fetched.withColumnRenamed("url", "final").select("final", "outcome", "html"), "final", "left")
        outcome = F.when(F.col("refused"), "refused").otherwise(F.coalesce("outcome", F.lit("error")))
        got = got.withColumn("outcome", outcome)
        content = html.extract(got.filter("outcome = 'page'").select(F.col("final").alias("url"), "html").dropDuplicates(["url"]), keep).withColumnRenamed("url", "final")
        level = cut(got.drop("html").join(content, "final", "left"))
        follow = level.filter("outcome = 'page'" + (" AND NOT coalesce(nofollow, false)" if respects_robots else ""))
        links = follow.select("url", "depth", "place", F.posexplode("links").alias("n", "link"))
        fresh = links.join(seen.withColumnRenamed("url", "link"), "link", "left_anti").withColumn("why", boundary("link", source))
        outside = fresh.filter("why <> ''").groupBy("url").agg(F.count(F.lit(1)).alias("out_of_scope"))
        entry = level.join(outside, "url", "left").na.fill(0, ["out_of_scope"]).drop("links")
        log = entry if log is None else log.unionByName(entry)
        if source.max_depth and depth >= source.max_depth:
            break
        good = fresh.filter((F.col("why") == "") & ~urls.non_html_col("link"))
        order = F.min(F.struct("place", "n"))
        found = cut(good.groupBy(F.col("link").alias("url")).agg(order.alias("o")).select("url", "o.place", "o.n"))
        frontier = cut(dense_order(found, order=("place", "n", "url")).select("url", F.col("idx").cast("long").alias("place")))
        seen = cut(seen.unionByName(frontier.select("url")))
        depth += 1
    if log is None:
        log = spark.createDataFrame([], "final string, url string, depth int, place long, refused boolean, outcome string, title string, description string, noindex boolean, nofollow boolean, headings array<struct<level:int,text:string,anchor:string>>, blocks string, n_blocks int, out_of_scope long")
    log = cut(log)
    good = log.filter("outcome = 'page' AND n_blocks > 0" + (" AND NOT noindex" if respects_robots else ""))
    docs = first_of(first_of(good, ["final"], ["depth", "place", "url"]).withColumn("hash", text.content_hash("blocks")), ["hash"], ["depth", "place", "url"])
    docs = docs.select(text.document_id(F.lit(source.id), F.col("final")).alias("id"), F.lit(source.id).alias("source_id"), F.lit(source.name or source.id).alias("source_name"), F.col("final").alias("url"), "title", "description", "headings", "blocks")
    return Crawl(docs, log)


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group, combined on the map side, so that a group of any size is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dedup_content(docs: DataFrame) -> DataFrame:
    """Of the documents of a source with the same blocks, the first by (indexed_at, url)."""
    h = docs.withColumn("_hash", text.content_hash("blocks"))
    return first_of(h, ["source_id", "_hash"], ["indexed_at", "url", "id"]).drop("_hash")


def fetch_robots(origins: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(origin, status, body) of robots.txt by origin: redirects are followed within the host, MOST_REDIRECTS at most.

    A redirect that leaves the host, or one too many, counts as no rules (its status is kept, 3xx); no answer has a null
    status, which bans everything.
    """

    def run(batches):  # noqa: ANN001, ANN202
        from urllib.parse import urljoin, urlsplit

        import pandas as pd

        for pdf in batches:
            out = []
            for origin in pdf["origin"]:
                url = f"{origin}/robots.txt"
                for _ in range(1 + MOST_REDIRECTS):
                    code, _, to, body = fetcher(url)
                    onward = urljoin(url, to) if code is not None and 300 <= code < 400 and to else None
                    if onward is None or urlsplit(onward).netloc != urlsplit(origin).netloc:
                        break
                    url = onward
                out.append((origin, code, body))
            yield pd.DataFrame(out, columns=["origin", "status", "body"])

    return origins.select("origin").distinct().mapInPandas(run, "origin string, status int, body string")


def source_counts(crawl: Crawl, source: Source) -> DataFrame:
    """One row of a source's counts: fetched, skipped, errors, out_of_scope, documents, status, error_samples."""
    n_docs = crawl.documents.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    error = F.col("outcome").isin("error", "refused")
    rows = crawl.log.agg(
        F.count_if(F.col("outcome") == "page").alias("pages_fetched"), F.count_if(error).alias("errors"), F.coalesce(F.sum("out_of_scope"), F.lit(0)).alias("out_of_scope"),
        F.slice(F.array_sort(F.collect_list(F.when(error, F.concat("outcome", F.lit(": "), "url")))), 1, SAMPLES).alias("error_samples"), F.count(F.lit(1)).alias("requests"),
    )
    return rows.select(F.lit(source.id).alias("id"), F.lit(source.name or source.id).alias("name"), F.lit(n_docs).alias("document_count"), "pages_fetched", (F.col("requests") - F.col("errors") - F.lit(n_docs)).alias("pages_skipped"), "errors", "out_of_scope", "error_samples", status(F.lit(n_docs), F.col("errors")).alias("status"))


def status(documents: Column, errors: Column) -> Column:
    """failed without documents, partial with errors, else ok."""
    return F.when(documents == 0, "failed").when(errors > 0, "partial").otherwise("ok")


def merge_sources(old: DataFrame, new: DataFrame, selected: list[str], configured: list[str]) -> DataFrame:
    """Documents after a run over the selected sources: theirs are new, those of other configured sources stay, the rest go.

    Raises ValueError if nothing is left, so that an old corpus isn't replaced by an empty one.
    """
    kept = old.filter(F.col("source_id").isin(configured) & ~F.col("source_id").isin(selected))
    out = kept.unionByName(new, allowMissingColumns=True)
    if out.isEmpty():
        raise ValueError("no documents: the old corpus stays")
    return out




def host_gap(delay: float, crawl_delay: float | None) -> float:
    """Seconds between two requests to a host: the configured delay or, if longer, what its robots.txt asks for."""
    return max(delay, min(crawl_delay or 0.0, robots.MOST_DELAY))


def fetch_pages(wanted: DataFrame, fetcher: Fetcher, retries: int = 1, delay: float = 0.0, wait: float = 0.0, gaps: dict[str, float] | None = None) -> DataFrame:
    """The page table of URLs, by a function url -> (status, content_type, redirect_to, html) that runs on the executors.

    Pages without an answer, 429 and server errors are asked again once, after ``wait`` seconds. With a delay, or gaps by
    host, all URLs of a host are asked in one task, one after the other, so that no two requests to it are closer than its
    gap; different hosts run side by side.
    """
    gaps = gaps or {}
    limited = delay > 0 or bool(gaps)

    def run(batches):  # noqa: ANN001, ANN202
        import time
        from urllib.parse import urlsplit

        import pandas as pd

        free: dict[str, float] = {}
        for pdf in batches:
            out = []
            for url in pdf["url"]:
                host = urlsplit(url).netloc.lower()
                for attempt in range(1 + retries):
                    if attempt:
                        time.sleep(wait)
                    if limited:
                        time.sleep(max(0.0, free.get(host, 0.0) - time.monotonic()))
                        free[host] = time.monotonic() + max(delay, gaps.get(host, 0.0))
                    status_, kind, to, body = fetcher(url)
                    if status_ is not None and status_ != 429 and status_ < 500:
                        break
                out.append((url, status_, kind, to, body))
            yield pd.DataFrame(out, columns=["url", "status", "content_type", "redirect_to", "html"])

    rows = wanted.select("url")
    if limited:
        rows = rows.repartition(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1)))
    return rows.mapInPandas(run, "url string, status int, content_type string, redirect_to string, html string")
