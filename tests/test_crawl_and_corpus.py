import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.functions.config import Source
from docloom.functions.html import Page
from docloom.operators import crawl, indexing, nested, search
from docloom.sources import corpus

BASE = "https://club.example"


def page(title, text, links=(), head=""):
    return f"<title>{title}</title>{head}<main><h2>{title}</h2><p>{text}</p><ul>" + "".join(f'<li><a href="{h}">{h}</a>' for h in links) + "</ul></main>"


TWINS = page("Twins", "Two pages say the same words.")
SITE = {
    "/garden/": (200, "text/html", None, page("Garden", "All beds of the club.", ["beds/roses", "beds/tulips", "shed/tools", "photos/gate.jpg", "/forum/", "old-gate", "way-out", "twin-a", "twin-b", "gone", "quiet", "list.bin", "beds/roses?utm_campaign=may#top"])),
    "/garden/beds/roses": (200, "text/html", None, page("Roses", "Red and white ones.", ["/garden/beds/lilies"])),
    "/garden/beds/tulips": (200, "text/html; charset=utf-8", None, page("Tulips", "Planted in October.")),
    "/garden/beds/lilies": (200, "text/html", None, page("Lilies", "Near the pond.")),
    "/garden/shed/tools": (200, "text/html", None, page("Tools", "Not for guests.")),
    "/garden/old-gate": (301, None, "beds/lilies", None),
    "/garden/way-out": (302, None, "/forum/", None),
    "/forum/": (200, "text/html", None, page("Forum", "Talk.")),
    "/garden/twin-a": (200, "text/html", None, TWINS),
    "/garden/twin-b": (200, "text/html", None, TWINS),
    "/garden/quiet": (200, "text/html", None, page("Quiet", "Not to be listed.", ["/garden/beyond"], "<meta name=robots content=noindex>")),
    "/garden/beyond": (200, "text/html", None, page("Beyond", "Found through a quiet page.")),
    "/garden/list": (200, "application/pdf", None, "%PDF"),
    **{f"/path/{k}": (200, "text/html", None, page(f"Stone {k}", f"Stone {k} of the path.", [f"/path/{k + 1}", "/path/0"])) for k in range(30)},
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(BASE + u, *r) for u, r in SITE.items()], "url string, status int, content_type string, redirect_to string, html string").cache()


def src(**kw):
    return Source(**{"id": "club", "name": "Club", "start_urls": [BASE + "/garden/"], "allowed_prefixes": [BASE + "/garden/"], "max_pages": 60, **kw})


def answers(spark):
    return spark.createDataFrame([(BASE, 200, "User-agent: *\nDisallow: /garden/shed/\n")], "origin string, status int, body string")


def paths(got):
    return {r["url"].removeprefix(BASE) for r in got.documents.collect()}


def test_crawl(spark, pages):
    got = crawl.crawl(src(), pages, answers(spark))
    assert paths(got) == {"/garden/", "/garden/beds/roses", "/garden/beds/tulips", "/garden/beds/lilies", "/garden/twin-a", "/garden/beyond"}
    c = crawl.source_counts(got, src()).first()
    assert (c["document_count"], c["status"], c["out_of_scope"]) == (6, "partial", 1) and c["errors"] == 2  # gone, and the way out
    log = {r["url"].removeprefix(BASE): r["outcome"] for r in got.log.collect()}
    assert "/garden/photos/gate.jpg" not in log and "/garden/shed/tools" not in log and log["/garden/way-out"] == "refused" and log["/garden/gone"] == "error"


def test_crawl_without_robots(pages):
    assert {"/garden/shed/tools", "/garden/quiet"} <= paths(crawl.crawl(src(), pages, None, respects_robots=False))


def test_crawl_bounds(pages):
    stones = lambda **kw: crawl.crawl(src(start_urls=[BASE + "/path/0"], allowed_prefixes=[BASE + "/path/"], **kw), pages)
    assert paths(stones(max_pages=4)) == {f"/path/{k}" for k in range(4)}
    assert paths(stones(max_depth=2)) == {"/path/0", "/path/1", "/path/2"}
    assert paths(crawl.crawl(src(exclude_patterns=["beds/"], max_depth=1), pages)) == {"/garden/", "/garden/shed/tools", "/garden/twin-a"}
    assert paths(crawl.crawl(src(include_patterns=["/garden/$", "roses"]), pages)) == {"/garden/", "/garden/beds/roses"}


def test_crawl_in_the_order_found_down_a_long_chain(pages):
    """Places stay small however deep the chain is."""
    log = crawl.crawl(src(start_urls=[BASE + "/path/0"], allowed_prefixes=[BASE + "/path/"], max_pages=12), pages).log
    assert sorted((r["depth"], r["url"].removeprefix(BASE), r["place"]) for r in log.collect()) == [(k, f"/path/{k}", 0) for k in range(12)]


def test_content_hash_of_other_layouts(spark):
    same = ['[{"type":"paragraph","spans":[{"t":"a","h":null}],"items":[]}]', '[ {"spans": [ {"t": "a", "b": false} ], "type": "paragraph", "text": ""} ]']
    rows = spark.createDataFrame([(b,) for b in [*same, '[{"type":"paragraph","spans":[{"t":"b"}]}]', None, "[]", "bad"]], "b string")
    h = [r["h"] for r in rows.select(text.content_hash("b").alias("h")).collect()]
    assert h[0] == h[1] != h[2] and h[3] == h[4] == h[5]


def test_merge_and_fetch(spark, pages):
    old = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "gone")], "id string, source_id string")
    new = spark.createDataFrame([("9", "a")], "id string, source_id string")
    assert {r["id"] for r in crawl.merge_sources(old, new, ["a"], ["a", "b"]).collect()} == {"9", "2"}
    with pytest.raises(ValueError, match="old corpus"):
        crawl.merge_sources(old, new.limit(0), ["a"], ["a"])
    got = crawl.fetch_pages(spark.createDataFrame([("u",), ("down",)], "url string"), lambda u: (200, "text/html", None, "<p>x</p>") if u == "u" else (503, None, None, None)).collect()
    assert {r["url"]: r["status"] for r in got} == {"u": 200, "down": 503}


def test_hosts_are_asked_with_a_gap(spark, tmp_path):
    import time

    log = str(tmp_path)

    def fetcher(url):
        with open(f"{log}/{url.split('/')[2]}", "a") as f:
            f.write(f"{time.monotonic()}\n")
        return 200, "text/html", None, "<p>x</p>"

    urls_ = spark.createDataFrame([(f"https://{h}.example/{k}",) for h in ("a", "b") for k in range(4)], "url string").repartition(4)
    assert crawl.fetch_pages(urls_, fetcher, delay=0.05, gaps={"b.example": 0.1}).count() == 8
    for h, gap in (("a", 0.05), ("b", 0.1)):
        at = [float(x) for x in open(f"{log}/{h}.example")]
        assert len(at) == 4 and min(y - x for x, y in zip(at, at[1:])) >= gap * 0.95
    assert crawl.host_gap(0.25, None) == 0.25 and crawl.host_gap(0.25, 99) == 30


def test_robots_redirects(spark):
    def fetcher(url):
        if url == "https://a/robots.txt":
            return 301, None, "/r", None
        if url == "https://a/r":
            return 200, "text/plain", None, "User-agent: *\nDisallow: /x"
        return (302, None, "https://a/r", None) if "//out/" in url else (302, None, "/robots.txt", None) if "//round/" in url else (None, None, None, None)

    got = {r["origin"]: (r["status"], r["body"]) for r in crawl.fetch_robots(spark.createDataFrame([(f"https://{o}",) for o in ("a", "out", "round", "down")], "origin string"), fetcher).collect()}
    assert got == {"https://a": (200, "User-agent: *\nDisallow: /x"), "https://out": (302, None), "https://round": (302, None), "https://down": (None, None)}


def test_html_kinds(spark):
    rows = [("text/html; charset=utf-8", "x", True), ("application/xhtml+xml", "x", True), ("application/pdf", "<html>", False), (None, "<!DOCTYPE html><p>", True), ("", "plain", False)]
    df = spark.createDataFrame(rows, "t string, b string, want boolean")
    assert [r["got"] for r in df.select(crawl.is_html(F.col("t"), F.col("b")).alias("got")).collect()] == [w for *_, w in rows]


def test_rendered_blocks_are_extracted_again():
    blocks = [
        {"type": "heading", "level": 2, "anchor": "wax", "spans": [{"t": "Wax & <honey>"}]},
        {"type": "paragraph", "spans": [{"t": "Pour it "}, {"t": "slowly", "b": True}, {"t": ", see "}, {"t": "frames", "h": "https://comb.example/frames#a"}, {"t": " or "}, {"t": "melt()", "c": True}]},
        {"type": "list", "ordered": True, "items": [[{"type": "paragraph", "spans": [{"t": "one"}]}, {"type": "list", "items": [[{"type": "paragraph", "spans": [{"t": "two"}]}]]}]]},
        {"type": "quote", "children": [{"type": "code", "text": "a < b\n  c", "lang": "sh"}]},
        {"type": "table", "rows": [["a", "b"], ["1", ""]], "header": True},
    ]
    from docloom.functions.html import render

    assert Page(f"<main>{render(blocks)}<p>{'filler ' * 60}</p></main>", "https://comb.example/").blocks[:-1] == blocks
    assert render([None, 3, {"type": "list"}, {"type": "quote", "children": None}]) == "<ul></ul><blockquote></blockquote>"


def test_html_extraction():
    p = Page(
        "<html><head><title>T — Docs</title><meta name=description content='About   it.'></head><body><header>top</header><nav><a href='/x'>n</a></nav><main><p>One <b>bold<p>two</b> three</p>"
        "<h2>Same<a class=headerlink href='#'>¶</a></h2><h2>Same</h2><table><tr><th>A<th>B<tr><td>1<td></table><dl><dt>k<dd>v</dl><p hidden>no</p><ul><li>x<li>y<ul><li>z</ul></ul>" + "<p>filler text that makes it long enough to be content. " * 3 + "</main><footer>f</footer>",
        "https://a.b/c",
    )
    kinds = [b["type"] for b in p.blocks]
    assert p.title == "T — Docs" and p.description == "About it." and p.links == ["https://a.b/x", "https://a.b/c"][:1]
    assert [h["anchor"] for h in p.headings] == ["same", "same-2"] and "table" in kinds and "quote" in kinds and kinds.count("list") == 1
    table = next(b for b in p.blocks if b["type"] == "table")
    assert table == {"type": "table", "rows": [["A", "B"], ["1", ""]], "header": True}
    assert "no" not in json.dumps(p.blocks).split('"') and "top" not in json.dumps(p.blocks)
    assert Page("", "https://a.b/x/page").title == "/x/page" and Page("<meta name=robots content='NONE'>", "https://a.b/").nofollow


def test_json_corpus(spark, tmp_path):
    at = datetime(2026, 1, 2, 3, 4, 5)
    blocks = json.dumps([{"type": "paragraph", "spans": [{"t": "A hive hums."}]}])
    docs = spark.createDataFrame([(f"{k:016x}", "s", "S", f"https://x/{k}", f"Hive {k}", None, at, at, [], blocks) for k in range(3)], "id string, source_id string, source_name string, url string, title string, description string, indexed_at timestamp, arrived_at timestamp, headings array<struct<level:int,text:string,anchor:string>>, blocks string")
    index = indexing.build_index(indexing.index_documents(docs))
    corpus.export_json(docs, index, {"sources": [{"name": "S", "id": "s"}]}, str(tmp_path / "new"))
    corpus.replace_dir(str(tmp_path / "new"), str(tmp_path / "corpus"))
    back = corpus.import_index(spark, str(tmp_path / "corpus" / "search-index.json"))
    one, two = ([(r["doc"], round(r["score"], 6)) for r in search.search(i, "hive hums").collect()] for i in (index, back))
    assert one == two and len(one) == 3
    read = corpus.read_json_documents(spark, str(tmp_path / "corpus"))
    assert read.count() == 3 and json.loads(read.first()["blocks"]) == json.loads(blocks)
    assert corpus.document(read, f"{1:016x}").count() == 1
    with pytest.raises(corpus.CorpusError):
        corpus.document(read, "../x")
    with pytest.raises(corpus.CorpusError):
        corpus.read_json(str(tmp_path / "none.json"), "index")
    corpus.write_tables(index, str(tmp_path / "t"))
    assert search.search(corpus.read_tables(spark, str(tmp_path / "t")), "hive").count() == 3


def test_nested(spark):
    blocks = [{"type": "quote", "children": [{"type": "list", "items": [[], [None, {"type": "paragraph", "spans": [{"t": "a", "h": "u"}, {"t": "b", "h": None}]}], None]}]}, None, {"type": "table", "rows": [["x"], None, [None, "y"]]}]
    at = datetime(2026, 1, 1)
    rows = [("d", at, at, json.dumps(blocks), 1), ("d", datetime(2025, 1, 1), at, "[{}]", 1), ("d", at, at, json.dumps(blocks), 1), ("n", at, at, None, 1), ("m", at, at, "{bad", 1), ("e", at, at, "[]", 1)]
    docs = spark.createDataFrame(rows, "id string, indexed_at timestamp, arrived_at timestamp, blocks string, ord int")
    got = {(r["kind"], r["owner_ord"], r["i"], r["j"]) for r in nested.nested_places(docs).collect()}
    assert got == {("block", 0, 0, 0), ("block", 1, 1, 1), ("link", 2, 0, 0), ("cell", 3, 0, 0), ("cell", 3, 2, 1)}
    assert nested.nested_places(docs.limit(0)).count() == 0
    t = nested.shred(spark.createDataFrame([(1, '[{"a":1,"b":{"c":"x"},"l":[[1],[2,3]]},null]'), (2, None), (3, "{")], "k long, j string"), "k", "j")
    assert {n: f.count() for n, f in t.items()} == {"$": 2, "$.l": 2, "$.l[]": 3}
    assert [(r["_key"], r["a"], r["b__c"]) for r in t["$"].orderBy("_key").collect()] == [("0", 1, "x"), ("1", None, None)]
    assert [(r["_parent"], r["_ordinal"], r["value"]) for r in t["$.l[]"].orderBy("_key").collect()] == [("0.0", 0, 1), ("0.1", 0, 2), ("0.1", 1, 3)]


@pytest.mark.parametrize("odd", [{"a": 1}, 3, [{"type": "list", "items": "x"}], [{"type": "list", "items": {}}], [{"type": "list", "items": ["x"]}], [{"type": "quote", "children": "x"}], ["x"]])
def test_an_odd_record_removes_nothing_of_others(spark, odd):
    blocks = [{"type": "list", "items": [[{"type": "quote", "children": [{"type": "paragraph", "spans": [{"t": "a", "h": "u"}]}]}]]}]
    at = datetime(2026, 1, 1)
    docs = spark.createDataFrame([("d", at, at, json.dumps(blocks)), ("odd", at, at, json.dumps(odd))], "id string, indexed_at timestamp, arrived_at timestamp, blocks string")
    b = nested.block_rows(docs).cache()
    assert [(r["ord"], r["depth"]) for r in b.filter("id = 'd'").orderBy("ord").collect()] == [(k, k) for k in range(3)]
    assert [(r["ord"], r["t"]) for r in nested.span_rows(b).collect()] == [(2, "a")]
    assert [r["depth"] for r in b.filter("id = 'odd'").collect()] == ([0] if isinstance(odd, list) and odd != ["x"] else [])
    assert nested.nested_places(docs).filter("kind = 'block'").count() == 2


def test_blocks_forty_levels_deep(spark):
    block = {"type": "paragraph", "spans": [{"t": "deep", "h": "u"}]}
    for k in range(40):
        block = {"type": "quote", "children": [block]} if k % 2 else {"type": "list", "items": [[], [block]]}
    at = datetime(2026, 1, 1)
    docs = spark.createDataFrame([("d", at, at, json.dumps([block]))], "id string, indexed_at timestamp, arrived_at timestamp, blocks string")
    got = [(r["ord"], r["owner_ord"], r["depth"], r["i"]) for r in nested.block_rows(docs, ["spans"]).orderBy("ord").collect()]
    assert got == [(k, k - 1 if k else None, k, 0 if k % 2 or not k else 1) for k in range(41)]
    assert [(r["owner_ord"], r["j"]) for r in nested.nested_places(docs).filter("kind = 'link'").collect()] == [(40, 0)]


def test_stream(spark, tmp_path):
    from docloom.streaming import ingest

    spark.createDataFrame([("https://x/1", "s", "<p>hello world</p>", datetime(2026, 1, 1))], "url string, source_id string, html string, arrived_at timestamp").write.parquet(str(tmp_path / "in"))
    q = ingest.extract_stream(ingest.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    q = ingest.index_stream(ingest.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "cp2"))
    q.awaitTermination(60)
    assert {r["term"]: r["tf"] for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {"hello": 1, "world": 1, "1": 6}


def test_nothing_in_core_imports_llm():
    from pathlib import Path

    home = Path(nested.__file__).parent.parent
    assert not [p for p in home.rglob("*.py") if "llm" not in p.parts and "docloom.llm" in p.read_text()]
