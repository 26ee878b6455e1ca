import collections
import hashlib
import json
import math
import re
from datetime import datetime

import pytest

from docloom.operators import indexing, portal, search, snippets
from docloom.operators.nested import block_rows

P = lambda t: {"type": "paragraph", "spans": [{"t": t}]}
DOCS = [
    ("comb", "https://comb.example/wax", "Wax for the winter", [{"type": "heading", "level": 1, "anchor": "wax", "spans": [{"t": "Melting old wax"}]}, P("Warm the wax slowly and pour it through a cloth."), {"type": "code", "text": "melt --slow wax"}]),
    ("comb", "https://comb.example/frames", "Frames", [P("A frame holds one sheet of wax. Frames are wired before the sheet goes in."), {"type": "list", "items": [[P("wire: steel wire")], [P("sheet: thin wax sheet")]]}]),
    ("hive", "https://hive.example/winter", "Winter", [P("The hive sleeps in winter. A heavy hive needs no sugar; a light hive does."), {"type": "table", "header": True, "rows": [["Weight", "Sugar"], ["light", "two kilos"]]}]),
    ("hive", "https://hive.example/queen", "The queen", [P("One queen lays all the eggs. Without a queen the hive dies in a winter.")]),
]
SCHEMA = "id string, source_id string, source_name string, url string, title string, description string, indexed_at timestamp, arrived_at timestamp, headings array<struct<level:int,text:string,anchor:string>>, blocks string"
WAX, FRAMES, WINTER, QUEEN = (hashlib.sha256(f"{s}\0{u}".encode()).hexdigest()[:16] for s, u, *_ in DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    from docloom.functions.text import document_id

    at = datetime(2026, 1, 2, 3, 4, 5)
    rows = [("x", s, s.upper(), u, t, None, at, at, [], json.dumps(b)) for s, u, t, b in DOCS]
    return spark.createDataFrame(rows, SCHEMA).withColumn("id", document_id(F.col("source_id"), F.col("url"))).cache()


@pytest.fixture(scope="module")
def index(docs):
    got = indexing.build_index(indexing.index_documents(docs))
    for t in (got.postings, got.terms, got.docs, got.stats):
        t.cache()
    return got


STOPS = set("a an are be by into of on such that the their there these they this to was were will".split())


def counts():
    """Weighted counts of each document by plain Python: title 6, heading 3, other text 1."""
    out = {}
    for doc, (_, _, title, blocks) in zip((WAX, FRAMES, WINTER, QUEEN), DOCS):
        c = collections.Counter()

        def add(t, w, c=c):
            c.update({x: w * n for x, n in collections.Counter(x for x in re.findall(r"[a-z0-9]+", t.lower()) if x not in STOPS).items()})

        def visit(bs, add=add):
            for b in bs:
                add("".join(s["t"] for s in b.get("spans", [])) + " " + b.get("text", "") + " " + " ".join(x for r in b.get("rows", []) for x in r), 3 if b["type"] == "heading" else 1)
                for i in b.get("items", []):
                    visit(i)

        add(title, 6)
        visit(blocks)
        out[doc] = c
    return out


def ranked(query, sources=None):
    """The ranking formula, document by document and term by term."""
    tf, titles = counts(), {d: t.lower() for d, (_, _, t, _) in zip((WAX, FRAMES, WINTER, QUEEN), DOCS)}
    lengths = {d: sum(c.values()) for d, c in tf.items()}
    average, df = sum(lengths.values()) / len(tf), collections.Counter(t for c in tf.values() for t in c)
    every = list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))
    terms = [t for t in every if t not in STOPS] or every
    phrase, out = " ".join(query.lower().split()), {}
    for d, c in tf.items():
        best = []
        for q in terms:
            longer = sorted((t for t in df if t.startswith(q) and t != q), key=lambda t: (-df[t], t))[:30] if len(q) > 1 else []
            scores = [f * math.log(1 + (len(tf) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * lengths[d] / average)) for t, f in [(q, 1.0), *((t, 0.5) for t in longer)] if c[t]]
            best += [max(scores)] if scores else []
        if best:
            out[d] = sum(best) * (len(best) / len(terms)) ** 2 * (2 if titles[d] == phrase else 1.5 if len(terms) > 1 and phrase in titles[d] else 1)
    source = {d: s for d, (s, *_) in zip((WAX, FRAMES, WINTER, QUEEN), DOCS)}
    return {d: s for d, s in sorted(out.items(), key=lambda x: (-x[1], x[0])) if not sources or source[d] in sources}


def test_index_table(index):
    want = counts()
    assert {(r["doc"], r["term"]): r["tf"] for r in index.postings.collect()} == {(d, t): n for d, c in want.items() for t, n in c.items()}
    rows = {r["doc"]: r for r in index.docs.collect()}
    assert {d: r["length"] for d, r in rows.items()} == {d: sum(c.values()) for d, c in want.items()}
    assert rows[FRAMES]["summary"].endswith("goes in. wire: steel wire sheet: thin wax sheet")
    assert index.terms.count() == len({t for c in want.values() for t in c})
    stats = index.stats.first()
    assert stats["n"] == 4 and abs(stats["avg_doc_length"] - sum(sum(c.values()) for c in want.values()) / 4) < 1e-9


def test_dense_order_and_lists(index):
    docs = indexing.dense_order(index.docs)
    assert {r["doc"]: r["idx"] for r in docs.collect()} == {FRAMES: 0, WAX: 1, QUEEN: 2, WINTER: 3}
    lists = indexing.posting_lists(index.postings.join(docs.select("doc", "idx"), "doc"))
    back = indexing.long_postings(lists)
    assert back.count() == index.postings.count()
    assert {r["term"]: r["list"] for r in lists.collect()}["queen"] == [2, counts()[QUEEN]["queen"]]


@pytest.mark.parametrize("query", ["w", "wa", "wax", "winter", "Winter", "wax for the winter", "the queen", "hive sugar", "hive  dies winter", "fra she", "queen frames", "of the", "zebra", "the", "   ", "constructor wax"])
def test_ranking_equals_plain_python(index, query):
    got, want = [(r["doc"], r["score"]) for r in search.search(index, query).collect()], ranked(query)
    assert [d for d, _ in got] == list(want)
    assert all(abs(s - want[d]) < 1e-9 for d, s in got)


def test_sources_limit_facets(spark, index):
    only = search.search(index, "winter wax", ["hive"]).collect()
    assert {r["doc"]: round(r["score"], 9) for r in only} == {d: round(s, 9) for d, s in ranked("winter wax", ["hive"]).items()} and len(only) == 2
    assert search.search(index, "winter wax", limit=1).count() == 1
    sources = spark.createDataFrame([("comb",), ("hive",), ("moth",)], "source_id string")
    assert {r["source_id"]: r["hits"] for r in search.facets(search.search(index, "queen"), sources).collect()} == {"comb": 0, "hive": 1, "moth": 0}
    assert {r["source_id"]: r["hits"] for r in search.facets(index.docs, sources).collect()} == {"comb": 2, "hive": 2, "moth": 0}  # without a query: all documents
    assert [r["doc"] for r in search.browse(index.docs).collect()] == [FRAMES, WAX, QUEEN, WINTER]
    line = search.result_lines(search.search(index, "queen")).first()["line"]
    assert line.startswith(" 1. The queen [hive] score ")


def test_more_than_thirty_longer_terms(spark):
    docs = spark.createDataFrame([(k, f"wa{'abcdefghij'[n // 10]}{'abcdefghij'[n % 10]}", "", "") for n in range(40) for k in range(n, 40)], "doc long, title string, headings string, body string")
    got = search.candidates(indexing.document_frequency(indexing.weighted_postings(docs, {"title": 1})), ["wa"])
    assert sorted(r["df"] for r in got.collect()) == list(range(11, 41))
    wanted = spark.createDataFrame([("hive",), ("gone",)], "source_id string")
    assert [r["source_id"] for r in search.known_sources(wanted, spark.createDataFrame([("hive",), ("comb",)], "source_id string")).collect()] == ["hive"]


def test_empty_index(spark, docs):
    empty = indexing.build_index(indexing.index_documents(docs.limit(0)))
    assert search.search(empty, "wax").count() == 0
    assert empty.stats.first()["n"] == 0


def test_snippets(spark):
    blocks = [
        {"type": "heading", "level": 1, "anchor": "bees", "spans": [{"t": "About bees"}]},
        {"type": "paragraph", "spans": [{"t": "A keeper watches the "}, {"t": "drones", "b": True}, {"t": " all summer."}]},
        {"type": "heading", "level": 2, "anchor": "smoke", "spans": [{"t": "Smoking"}]},
        {"type": "list", "items": [[P("Puff a little smoke so that the drones stay calm while you look.")]]},
        {"type": "code", "text": "smoker --puffs 3"},
        {"type": "table", "rows": [["fuel", "burns"], ["hay", "a short while"]]},
        P("leaf " * 100 + "thorn " + "leaf " * 100),
    ]
    at = datetime(2026, 1, 1)
    docs = spark.createDataFrame([("d", "s", "S", "u", "t", None, at, at, [], json.dumps(blocks))], SCHEMA)
    parts = snippets.segments(block_rows(docs)).cache()
    best = lambda terms: snippets.best_snippets(parts, terms).collect()
    r = best(["smoke", "drones"])[0]
    assert (r["anchor"], r["heading"]) == ("smoke", "Smoking") and "little smoke" in r["snippet"]
    assert best(["smok"])[0]["anchor"] == "smoke"
    assert best(["zebra"]) == [] and best([]) == []
    long = best(["thorn"])[0]["snippet"]
    assert long.startswith("… ") and long.endswith(" …") and len(long) < 300 and "thorn" in long


def test_places_in_utf16_units():
    body = "a 🐝 b𝔸 é 🐝🐝 c"
    want = body.encode("utf-16-le")
    assert [t for t, _, _ in snippets.utf16_places(body)] == ["a", "b𝔸".lower(), "é", "c"]
    assert all(want[2 * s : 2 * e].decode("utf-16-le").lower() == t for t, s, e in snippets.utf16_places(body))


def test_highlight(spark):
    body = "Waxing the waxed, not beeswax."
    parts = snippets.highlight_parts(body, ["wax"])
    assert [t for t, h in parts if h] == ["Waxing", "waxed"] and "".join(t for t, _ in parts) == body
    assert snippets.highlight_parts(body, []) == [(body, False)]
    df = spark.createDataFrame([(body,), (None,)], "b string")
    assert [r["h"] and len(r["h"]) for r in df.select(snippets.highlight("b", ["wax"]).alias("h")).collect()] == [4, None]


def test_titles_and_links(spark):
    rows = [("py", f"{t} — Keeping Bees, 4th edition", f"https://p/{t}", f"p{t}") for t in "abc"] + [("go", f"{t} - Orchard Notes", f"https://g/{t}", f"g{t}") for t in "ab"] + [("one", "x - y", "https://o/", "o1")]
    docs = spark.createDataFrame(rows, "source_id string, title string, url string, id string")
    assert {r["source_id"]: r["suffix"] for r in portal.title_suffixes(docs).collect()} == {"py": " — Keeping Bees, 4th edition", "go": " - Orchard Notes"}
    assert {r["short_title"] for r in portal.short_titles(docs).collect()} == {"a", "b", "c", "x - y"}
    links = spark.createDataFrame([("https://p/a",), ("https://p/a#Old%20Hives",), ("https://p/b#a+b",), ("https://p/c#%zz",), ("https://else/",)], "href string")
    got = [(r["target"], r["anchor"]) for r in portal.resolve_links(links, docs).orderBy("href").collect()]
    assert sorted(got, key=str) == sorted([("pa", None), ("pa", "Old Hives"), ("pb", "a+b"), ("pc", "%zz"), (None, None)], key=str)


def test_natural_order(spark):
    df = spark.createDataFrame([("v10",), ("v9",), ("V1",)], "t string")
    assert [r["t"] for r in df.orderBy(portal.natural_key(df["t"])).collect()] == ["V1", "v9", "v10"]


def test_contents(spark, docs):
    b = portal.split_title(block_rows(docs))
    assert b.filter("is_title").count() == 1
    heads = spark.createDataFrame([("x", 0, 2, "A", "a"), ("x", 1, 3, "B", "b"), ("x", 2, 2, "C", "gone"), ("y", 0, 1, "only", "o")], "id string, place int, level int, text string, anchor string")
    blocks = spark.createDataFrame([("x", "heading", "a"), ("x", "heading", "b"), ("y", "heading", "o")], "id string, type string, anchor string")
    assert [(r["text"], r["depth"]) for r in portal.contents(heads, blocks).orderBy("place").collect()] == [("A", 0), ("B", 1)]
