import itertools
import json
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import abuse, boilerplate, distinctive, graph, leaks, lines, mixing, neardup, residue, terms
from docloom.llm.vectext import word_hashes

CRAWL = "id string, source_id string, title string, url string, description string, indexed_at timestamp, arrived_at timestamp, headings array<struct<level:int,text:string,anchor:string>>, blocks string, n int, rep string, lot int"
AT = datetime(2026, 1, 1)
P = lambda t: {"type": "paragraph", "spans": [{"t": t}]}


def crawled(spark, rows):
    """rows of (id, source, blocks or text, title); the frame also has columns whose names clash with the operators' own."""
    made = [(i, s, t, f"https://x/{i}", None, AT, AT, None, b if b is None or isinstance(b, str) else json.dumps(b), 1, "r", 2) for i, s, b, t in rows]
    return spark.createDataFrame(made, CRAWL)


WORDS = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("l", "m", "n", "ra", "to", "s", "x")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], ["edited" + str(rng.randrange(99))], [w[k], "added"]])
    return " ".join(w)


# -- near duplicates


def brute_groups(texts, threshold=0.35, least=60):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= least:
            sets[i] = set(zip(w, w[1:], w[2:]))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        o = len(sets[a] & sets[b])
        if o >= threshold * (len(sets[a]) + len(sets[b]) - o):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("options", [{}, {"block": 10, "members": 3}])
def test_near_duplicates_equal_brute_force(spark, options):
    rng = random.Random(5)
    texts = {}
    for k in range(40):
        base = text(rng, rng.choice([70, 150, 500]))
        for v in range(rng.choice([1, 1, 2, 4])):
            texts[f"{k:02d}{v}"] = edited(rng, base, v * 5)
    for v in range(60):  # one group of copies as large as a third of all rows
        texts[f"z{v:02d}"] = texts["000"]
    rows = [(i, "s", [P(t)], None) for i, t in texts.items()] + [("short", "s", [P("a b c")], None), ("none", "s", None, None), ("bad", "s", "{", None), ("z00", "s", [P(texts["000"])], None)]
    got = {r["id"]: r["class"] for r in neardup.near_duplicates(crawled(spark, rows), **options).collect()}
    assert got == brute_groups(texts)


def phrased(rng, n, words=(60, 120, 200)):
    """Pages of own words around two of three long notices and two of eight sentences that all pages draw from; every fourth has a changed copy."""
    notices, sentences = [text(rng, 25) for _ in range(3)], [text(rng, 9) for _ in range(8)]
    texts = {}
    for k in range(n):
        own = text(rng, rng.choice(words))
        around = [*rng.sample(notices, 2), *rng.sample(sentences, 2)]
        texts[f"{k:03d}a"] = " ".join([*around, own])
        if k % 4 == 0:
            texts[f"{k:03d}b"] = " ".join([*around, edited(rng, own, 6)])
        if k % 50 == 0:
            texts[f"{k:03d}c"] = " ".join([*notices, text(rng, 3)])  # hardly any words of its own
    return texts


@pytest.mark.parametrize("options", [{}, {"common": 40, "block": 12}])
def test_near_duplicates_with_common_phrases_equal_brute_force(spark, options):
    texts = phrased(random.Random(8), 240)
    rows = [(i, "s", [P(t)], None) for i, t in texts.items()]
    got = {r["id"]: r["class"] for r in neardup.near_duplicates(crawled(spark, rows), **options).collect()}
    assert got == brute_groups(texts)


def test_common_phrases_make_no_large_routes(spark):
    texts = phrased(random.Random(9), 400, (160, 240))
    docs = crawled(spark, [(i, "s", [P(t)], None) for i, t in texts.items()])
    common = neardup.common_triples(docs, 60, 40)
    made = []
    for node, (_, u) in enumerate(neardup.page_sets(docs.toPandas().blocks.tolist(), 60)):
        made.append((node, len(u), neardup.signature(u), neardup._page_routes(u, common, 0.35, neardup.ROUTES).view(np.int64).tolist()))
    got = neardup.units(spark.createDataFrame(made, "node long, k int, bits binary, routes array<long>"), 40).groupBy("route", "bi", "bj").count().toPandas()["count"]
    assert got.max() <= 40 and got.sum() < 35 * len(texts) and (got * (got - 1) / 2).sum() < 10 * len(texts)


def test_routes_follow_the_share_of_common_triples():
    n = [neardup.routes_for(share, 0.35, 24, 72) for share in (0, 0.2, 0.3, 0.4, 0.45, 0.6)]
    assert n == [24, 25, 34, 60, 0, 0]
    u = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64))
    first, more = neardup.least_of_parts(u, 16, 16), neardup.least_of_parts(u, 40, 16)
    assert len(first) == 16 and len(more) == 40 and (more[:16] == first).all()
    assert (first == [u[u % 16 == p].min() for p in range(16)]).all()


def test_near_duplicates_of_nothing(spark):
    assert neardup.found_pairs(neardup.near_duplicates(crawled(spark, []))).count() == 0


def test_tree_bounds_lose_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 200, np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, 60), rng.integers(0, 1 << 62, 40, np.uint64)]) for _ in range(80)]
    bits = np.stack([neardup.fold(np.frombuffer(neardup.signature(s), np.uint64)[None], 4)[0] for s in sets])
    k = np.array([len(s) for s in sets])
    tree = neardup.Tree(bits, k, np.arange(len(sets)))
    kept = {tuple(sorted(p)) for i, j in neardup.dual(tree, tree, 0.2) for p in zip(i.tolist(), j.tolist())}
    o = neardup.overlaps(sets)
    for i, j in itertools.combinations(range(len(sets)), 2):
        assert o[i, j] == len(np.intersect1d(sets[i], sets[j]))
        if o[i, j] >= 0.2 * (k[i] + k[j] - o[i, j]):
            assert (i, j) in kept


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (50, 50)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_the_tokenizer():
    texts = ["Hello, World! x_y", "", "Ünï 日本 " + "b" * 41 + " İstanbul 𝒳a", "hello world"]
    h, owner = word_hashes(texts)
    assert [int((owner == k).sum()) for k in range(4)] == [4, 0, 4, 2]
    assert h[0] == h[owner == 3][0] and h[1] == h[owner == 3][1]


# -- residue


BODY = [P("The gateway keeps one cursor for every timeout that the tool has seen."), P("Use the option to open the next stage before it starts.")] * 8


def site_pages(hosts="abcdefghij"):
    """Pages of ten hosts: ordinary ones, a third with a field's signs, filler, an error message or a script notice."""
    odd = [[*BODY, P("{{ productName }}")], [P("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.")], [P("This page could not be found.")], [P("Please turn on scripts to read this page.")], [*BODY, P("%%section name%%: driver")], [*BODY, P("<%= topic %>")]]
    return [(f"{h}{k:02d}", h, odd[(k + ord(h)) % len(odd)] if k < 4 else [*BODY[: 4 + k], P(f"In doubt, number {k} of {h} comes first.")], "Error 404" if k < 4 and (k + ord(h)) % len(odd) == 2 else "Guide") for h in hosts for k in range(12)]


def test_residue(spark):
    rows = [
        *site_pages(), ("ok", "a", BODY, "Tuning the gateway"), ("mark", "a", [*BODY, P("{{ chapterName }}")], "Guide"), ("title", "b", BODY, "%%chapter name%%"), ("lorem", "b", [P("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.")], "Guide"),
        ("gone", "c", [P("This page could not be found.")], "Error 404"), ("script", "c", [P("Please turn on scripts to read this page.")], "Guide"), ("code", "d", [*BODY, {"type": "code", "text": "<h1>{{ page.title }}</h1>"}], "Template language"),
        ("about", "d", [*BODY, P("A value such as ${NAME} is replaced where the tool reads the file before it starts.")], "Variables"), ("null", "e", None, None), ("sum", "e", BODY, "Guide"),
    ]
    index = spark.createDataFrame([(1, "sum", "Some text. {{ productName }}"), (2, "ok", None), (3, "only", "<%= topic %>")], "idx long, id string, summary string")
    got = {r["id"] for r in residue.residue(crawled(spark, rows), index).collect()}
    assert {i for i in got if not i[1:].isdigit()} == {"mark", "title", "lorem", "gone", "script", "sum", "only"}
    assert {i for i in got if i[1:].isdigit()} == {i for i, *_ in site_pages() if int(i[1:]) < 4}
    assert residue.residue(crawled(spark, []), index.limit(0)).count() == 0


def test_messages_no_phrase_knows_are_found_by_their_repeats(spark):
    """A sentence of many short pages is residue, one of pages of any size (a footer) is not, wherever it stands."""
    footer, gone = P("The makers keep their names."), P("Nothing lives here any more, dear reader.")
    rows = [*site_pages(), *[(f"long{k}", "m", [*BODY, footer], "Guide") for k in range(12)], *[(f"foot{k}", "m", [footer], "Guide") for k in range(6)]]
    rows += [(f"wide{k}", "m", [gone, {"type": "code", "text": "x = 1 " * 500}], "Guide") for k in range(8)]  # few words, but long
    index = spark.createDataFrame([], "idx long, id string, summary string")
    got = {r["id"] for r in residue.residue(crawled(spark, rows), index).collect()}
    assert {i for i in got if i.startswith("wide")} == {f"wide{k}" for k in range(8)}
    assert not [i for i in got if i.startswith(("long", "foot"))]


def test_residue_on_unseen_hosts(spark):
    """Every page's host is in no fit that judges it."""
    rows = [(i, h, b, t) for i, h, b, t in site_pages()]
    docs = crawled(spark, rows).withColumn("url", F.concat(F.lit("https://"), "source_id", F.lit(".example/"), "id"))
    got = residue.validate(docs)
    assert got["positives"] >= 30 and got["recall"] >= 0.9 and got["precision"] >= 0.9


def test_signs_of_templates():
    for unit in ("{{ x }}", "<%= heading %>: module", "${NAME}", "#{summary}", "@@T@@ - Help", "[CHAPTER]", "<company name>", "__topic__", "[[ a b ]]", "%VERSION%"):
        assert residue.weak_label(unit, 300) == 1, unit
    for unit in ("use (foo) here", "a <b> c", "{0} of {1}", "a · b · c", "« one 1.2 two 3.4 »", "A value such as ${NAME} is replaced where the tool reads the file before it starts again.", ""):
        assert residue.weak_label(unit, 300) == 0, unit


# -- terms


def test_stack_carries_open_prefixes_over_batches():
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted({(tuple(rng.choice("abc") for _ in range(rng.randint(1, 3))), rng.randrange(6), rng.randrange(3), str(rng.randrange(3))) for _ in range(400)}, key=lambda r: (r[1], r[2], r[3]))
    rows.sort(key=lambda r: r[0], reverse=True)
    rows = [r for r in rows for _ in range(rng.choice([1, 1, 2]))]  # repeated rows count once
    want = {}
    for s, rec, w, tag in set(rows):
        for d in range(1, len(s) + 1):
            n, recs = want.get(s[:d], (0, frozenset()))
            want[s[:d]] = n + w, recs | {rec}
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([list(r[0]) for r in b], pa.list_(pa.string())), pa.array([r[1] for r in b], pa.int64()), pa.array([r[2] for r in b], pa.int64()), pa.array([r[3] for r in b], pa.string())], ["suffix", "rec", "w", "tag"]) for b in (rows[k : k + size] for k in range(0, len(rows), size))]
        got = [(tuple(x["ngram"]), x["total"], x["docs"]) for rb in terms._stack(iter(batches), 3) for x in rb.to_pylist()]
        assert len(got) == len(want) and {g: (n, d) for g, n, d in got} == {k: (n, len(r)) for k, (n, r) in want.items()}, size


def test_ngrams_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice(["a", "b", "c", "dd"]) for _ in range(rng.randrange(12))]) for k in range(60)] + [(99, None), (None, ["a"]), (98, ["a", None, "b"])]
    want, where = {}, {}
    for k, t in rows:
        t = [x for x in t or [] if x is not None] if k is not None else []
        for s in range(len(t)):
            for e in range(s + 1, min(s + 3, len(t)) + 1):
                g = tuple(t[s:e])
                want[g] = want.get(g, 0) + 1
                where.setdefault(g, set()).add(k)
    got = {tuple(r["ngram"]): (r["occurrences"], r["docs"]) for r in terms.ngram_counts(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t", 3).collect()}
    assert got == {g: (n, len(where[g])) for g, n in want.items()}




def header(spark):
    row = lambda n, v, words: (f"{n}", "s", (v, 40, words), (6, 3, 1), (1.2, 0.75))
    return spark.createDataFrame([row(0, 2, ["the"]), row(1, 1, ["old"])], "segment_id string, source_id string, tokenizer struct<version:int,max_token_length:int,stop_words:array<string>>, weights struct<title:int,heading:int,body:int>, bm25 struct<k1:double,b:double>")


def test_term_marks(spark):
    post = [("s", "hot", k, 2) for k in range(20)] + [("s", "the", k, 1) for k in range(20)] + [("s", "old", 1, 1), ("s", "old", 1, 1), ("s", "mid", 1, 1), ("s", "mid", 2, None), ("s", "mid", 3, 1), ("s", "", 1, 1), ("s", None, 1, 1), ("s", "x", 99, 1), ("s", "x", None, 1)]
    postings = spark.createDataFrame(post, "source_id string, term string, idx long, tf int")
    docs = spark.createDataFrame([(k, f"d{k:02d}", "s", "t", "u", 10 if k else None, "", "extra") for k in range(20)] * 2, "idx long, id string, source_id string, title string, url string, length int, summary string, term string")
    got = {r["term"]: (r["docs"], r["total"], r["mark"]) for r in terms.term_marks(postings, docs, header(spark)).collect()}
    assert got == {"hot": (20, 40, "common"), "the": (20, 20, "stop"), "old": (1, 1, "rare"), "mid": (3, 2, None)}
    top = {r["id"]: r["term"] for r in distinctive.top_term(distinctive.distinctive_terms(postings, docs, header(spark))).collect()}
    assert top["d01"] == "mid" and top["d05"] == "hot" and len(top) == 20
    assert terms.term_marks(postings.limit(0), docs.limit(0), header(spark).limit(0)).count() == 0


def test_log_likelihood(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10, 10, 90, 890), (1, 99, 99, 801), (0, 0, 0, 0)], "a long, b long, c long, d long")
    x, y, z = [r["g"] for r in df.select(distinctive.log_likelihood(*map(F.col, "abcd")).alias("g")).collect()]
    assert x > 10 and y < 0 and z == 0


# -- lines


def test_repeated_lines(spark):
    rows = [(f"{k:02d}", "a", [{"type": "list", "items": [[P(f"Own line number {k} " + "word " * k)], [P(f"Printed on day {k} FOR all readers" if k % 2 else "printed  on day 77 for all readers")]]}, P("too short 1")], None) for k in range(20)]
    rows += [(f"b{k}", "b", [P("A line of four documents only")], None) for k in range(4)] + [("n", None, [P("A line of four documents only")], None), ("e", "a", None, None)]
    docs = crawled(spark, rows)
    got = lines.repeated_lines(docs).collect()
    assert sorted((r["id"], r["ord"]) for r in got) == [(f"{k:02d}", 2) for k in range(20)]
    stripped = {r["id"]: r for r in lines.strip_lines(docs).collect()}
    assert stripped["03"]["removed"] == 1 and "readers" not in stripped["03"]["blocks"] and "Own line" in stripped["03"]["blocks"] and stripped["e"]["blocks"] == "[]"
    assert lines.repeated_lines(crawled(spark, [])).count() == 0


# -- boilerplate


def test_boilerplate(spark):
    link = lambda t: {"t": t, "h": "https://x/"}
    rng = random.Random(3)
    body = lambda: P(f"The {text(rng, 2)} keeps one {text(rng, 1)} for every {text(rng, 2)} that it has seen, and drops it after 5 seconds.")

    def page(k):
        return [
            {"type": "list", "items": [[{"type": "paragraph", "spans": [link("Docs")]}], [{"type": "paragraph", "spans": [link("Blog")]}]]},
            P("This garden keeps a note of every visit. Fine with me"), P("Home » Guides » Default cursor"),
            {"type": "heading", "level": 1, "spans": [{"t": f"The {text(rng, 1)} setting"}]}, body(), {"type": "code", "text": "all rights reserved"}, body(),
            {"type": "heading", "level": 4, "spans": [{"t": "Related pages"}]}, {"type": "list", "items": [[{"type": "paragraph", "spans": [link(text(rng, 2))]}], [P("Using the tool")]]},
            P(f"Painted in {1990 + k % 30} for the readers of Some Guide by hand."), P("Nobody waters the flowers in the summer unless it rains for long."),
        ]

    pages = {f"d{k:02d}": page(k) for k in range(40)}
    copied = [body() for _ in range(6)]  # one page copied forty times: its sentences are no furniture
    rows = [(i, "some-guide", b, f"Page {i}") for i, b in pages.items()] + [(f"c{k:02d}", "other", [P("Nobody waters the flowers in the summer unless it rains for long."), *copied, *([body()] if k % 10 == 0 else [])], None) for k in range(40)]
    rows += [("n", "x", None, None), *[(f"g{k}", "x", [P("The page that you look for has gone.")], None) for k in range(12)]]
    docs = crawled(spark, rows)
    got = {r["id"]: r["ords"] for r in boilerplate.boilerplate_blocks(docs).collect()}
    assert all(got[i] == _flagged(b, (0, 1, 2, 7, 8, 9, 10)) for i, b in pages.items())
    assert all(got[f"c{k:02d}"] == [0] for k in range(40)) and got["n"] == [] and all(got[f"g{k}"] == [] for k in range(12))
    kept = {r["id"]: r["text"] for r in boilerplate.main_content(docs).collect()}
    assert "garden" not in kept["d00"] and "5 seconds" in kept["d00"] and kept["g1"].startswith("The page that")
    assert boilerplate.boilerplate_ords(crawled(spark, [])).count() == 0


def _flagged(blocks, tops):
    at = boilerplate._ords(blocks)
    return [at[k] for k in tops]


# -- leaks


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    items = {k: text(rng, 40) for k in range(12)}
    docs = {}
    for k in range(40):
        w = text(rng, 60).split()
        if k % 3 == 0:
            i = items[k % 12].split()
            n = rng.choice([12, 13, 20])
            s = rng.randrange(len(i) - n)
            w[30:30] = [x.upper() + "," for x in i[s : s + n]]
        docs[k] = " ".join(w)
    docs[100], docs[101] = docs[0], ""
    rows = [(k, t) for k, t in docs.items()] + [(102, None), (None, docs[0])]
    want = set()
    grams = {i: {tuple(t.split()[s : s + 13]) for s in range(28)} for i, t in items.items()}
    for k, t in docs.items():
        w = re.findall(r"[^\W_]+", t.lower())
        for s in range(len(w) - 12):
            want |= {(k, i) for i, g in grams.items() if tuple(w[s : s + 13]) in g}
    found = leaks.leaked(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items.items(), (50, None), (51, "too short")], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.filter("edits = 0").collect()} == want


def test_leak_recall_with_an_edit():
    rng = np.random.default_rng(4)
    plan, hit = leaks.bands(13, leaks.WALKS, leaks.BANDS, leaks.COORDINATES), 0
    for _ in range(300):
        x = rng.integers(0, 1 << 62, 13, np.uint64)
        y = x.copy()
        y[rng.integers(0, 13)] = rng.integers(0, 1 << 62)
        a, b = (leaks.band_keys(z, np.array([0]), 13, plan)[0] for z in (x, y))
        hit += bool((a == b).any())
    assert hit >= 270
    assert leaks.edit_distances(np.array([[1, 2, 3]], np.uint64), np.array([[2, 3, 4]], np.uint64)).tolist() == [2]


def test_leaks_of_one_edited_window(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**9)}"
    items, docs = {}, {}
    for k in range(900):
        items[k] = [word() for _ in range(13)]
        w, at = list(items[k]), rng.randrange(1, 12)
        w[at : at + 1] = [[word()], [w[at], word()], []][k % 3]
        docs[k] = " ".join(w if k % 9 > 5 else [*(word() for _ in range(9)), *w, *(word() for _ in range(9))])
    found = leaks.leaked(spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")).collect()
    assert all(r["doc_id"] == r["item_id"] and r["edits"] == 1 for r in found)
    assert min(sum(r["doc_id"] % 3 == kind for r in found) for kind in range(3)) >= 270


# -- mixing


def test_slices_cut_no_token():
    enc = mixing.encoder(mixing.VOCABULARY)
    rng = random.Random(9)
    for _ in range(30):
        t = "".join(rng.choice(["word", "  ", " ", "\n", "it's", "12", "...", "é", " \t "]) for _ in range(200))
        parts = list(mixing.slices(t, 7))
        assert "".join(parts) == t and [x for p in parts for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(k, "a" if k < 300 else "b" if k < 330 else "c ", text(rng, rng.randrange(20, 80))) for k in range(400)]
    docs += [(1000, "A", docs[0][2]), (1001, "a", None), (1002, None, "text"), (1003, "d", "no weight")]
    targets = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 4), ("C", 2.0, 2), ("missing", 1.0, 1)], "source string, weight double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    mixed = mixing.mixture(df, targets).cache()
    caps = {"a": 1, "b": 4, "c": 2}
    assert all(r["copies"] <= caps[r["source"]] for r in mixed.collect()) and mixed.filter("doc_id = 1000").count() == 0
    reached = {r["source"]: r["reached_share"] for r in mixing.shares(mixed, targets).collect()}
    assert abs(reached["a"] - 0.25) < 0.02 and abs(reached["b"] - 0.25) < 0.02 and abs(reached["c"] - 0.5) < 0.02 and reached["missing"] == 0
    large = {r["source"]: r["most_copies"] for r in mixing.shares(mixing.mixture(df, targets, total_tokens=1e9), targets).collect()}
    assert large == {**caps, "missing": 0}
    assert mixing.mixture(df.limit(0), targets).count() == 0


# -- abuse


def test_abuse(spark):
    labels = [(k, t, y) for k, (t, y) in enumerate([("Get lost, you pathetic idiot.", 1), ("You are a complete moron.", 1), ("Those people are vermin and should vanish.", 1), ("The cursor keeps one stage for each timeout.", 0), ("Kill the child process before the parent dies.", 0), ("Use the option to open the gateway.", 0), (None, 1), ("no label", None)])]
    labelled = spark.createDataFrame(labels, "label_id long, text string, label int")
    docs = [(1, "A", "The cursor keeps one stage. Get lost, you pathetic id​iot. Then open the gateway."), (2, "a", "YOU ARE A COMPLETE M0R0N"), (3, "b", "Kill the child process before the parent dies."), (4, None, None), (5, "b", "   "), (6, "b", "The gateway opens one cursor for each stage. " * 2000)]
    got = {r["doc_id"] for r in abuse.abusive(spark.createDataFrame(docs, "doc_id long, source string, text string"), labelled).collect()}
    assert got == {1, 2}
    rates = {r["source"]: (r["docs"], r["cases"]) for r in abuse.abuse_rates(spark.createDataFrame(docs, "doc_id long, source string, text string"), labelled).collect()}
    assert rates == {"a": (2, 2), "b": (3, 0), None: (1, 0)}
    none = spark.createDataFrame([], "label_id long, text string, label int")
    assert abuse.abusive(spark.createDataFrame(docs, "doc_id long, source string, text string"), none).count() == 0


def test_abuse_is_learnt_from_labels_alone():
    """On texts with the labels' wording, in other sentences than those of the fit: few ordinary sentences are cases."""
    rng = random.Random(5)
    calm = lambda: f"the {text(rng, 1)} keeps one {text(rng, 1)} for every {text(rng, 1)} that it has seen"
    bad = lambda: rng.choice(["get lost, you pathetic {}, nobody wants you", "you are a complete {} and should be ashamed", "shut up, you {}, your mother hates you"]).format(rng.choice(["idiot", "moron", "bastard"]))
    rows = [(bad(), 1) for _ in range(40)] + [(calm(), 0) for _ in range(80)] + [(calm(), 1), (bad(), 0)]  # two wrong labels
    fitted = abuse.fit_rows(rows, [calm() for _ in range(600)])
    score = lambda t: float(fitted.margins([abuse.plain(t)])[0])
    assert sum(score(calm()) > 0 for _ in range(300)) <= 2
    assert all(score(t) > 0 for t in ("you are a pathetic bastard", "shut up, you pathetic m0r0n, nobody wants you", "nobody wants you, you complete i-d-i-o-t"))


def test_a_wrong_label_does_not_make_ordinary_sentences_cases():
    """One wrong label takes the case out of no positive text, so that what stands beside it isn't learnt instead."""
    rng = random.Random(9)
    usual = lambda: f"After the restart, {text(rng, 1)} reads the {text(rng, 1)} first and then the {text(rng, 1)}."
    calm = lambda: f"The {text(rng, 1)} keeps one {text(rng, 1)} for every {text(rng, 1)} that it has seen."
    case = "Quibblers are vermin, out with them."
    rows = [(f"{case} {usual()}", 1) for _ in range(5)] + [(case, 0)] + [(f"You are a complete moron, {w}.", 1) for w in WORDS[:20]] + [(calm(), 0) for _ in range(60)]
    fitted = abuse.fit_rows(rows, [abuse.plain(f()) for f in [calm] * 500 + [usual] * 60])
    score = lambda x: float(fitted.margins([abuse.plain(x)])[0])
    assert score(case) > 0 and all(score(usual()) < 0 for _ in range(30))


def test_abuse_counts_the_whole_corpus(spark, monkeypatch):
    """The factor of a subsequence comes from all sentences, also where the fit reads the sentences of a few texts only."""
    monkeypatch.setattr(abuse, "CORPUS_TEXTS", 4)
    rng = random.Random(3)
    texts = [None, "", "  ", *[f"{text(rng, 6)}. {text(rng, 4)}\n{text(rng, 1)}" for _ in range(60)]]
    n = np.zeros(abuse.FEATURES, np.int64)
    for line in [abuse.plain(p) for t in texts for p in abuse.pieces(t)]:
        s = [0, *[0 if c == " " else ord(c) - 96 if c.isalpha() else 27 for c in line], *[0] * 6]
        for k in range(len(line) + 2):  # a sentence and one space on either side
            for p in abuse.PLACES:
                got = [s[k + q] if k + q < len(s) else 0 for q in p]
                n[((got[0] * 28 + got[1]) * 28 + got[2]) * 28 + got[3]] += 1
    labelled = spark.createDataFrame([(1, "You are a moron.", 1), (2, "The cursor keeps one stage.", 0)], "label_id long, text string, label int")
    docs = spark.createDataFrame([(k, "a", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").repartition(3)
    fitted = abuse.fit(labelled, abuse.plain_texts(docs))
    assert np.allclose(fitted.tables[:, 1], (1.0 + n) ** -abuse.COMMON)


def test_cases_that_no_label_knows_are_found_by_what_they_stand_beside(spark):
    """A sentence unlike all labels that mostly stands beside sure cases is one where it stands alone, too; a common one isn't."""
    rng = random.Random(4)
    calm = lambda: f"The {text(rng, 1)} keeps one {text(rng, 1)} for every {text(rng, 1)} that it has seen."
    case, common = "Zuf kibbel drano, wexa pij.", "Vox juw kepi, see qazu."
    bad = lambda w: rng.choice(["Get lost, you pathetic idiot {}.", "You are a complete moron, {}, be ashamed.", "Shut up, {}, you ugly bastard."]).format(w)
    labels = [(bad(w), 1) for w in WORDS[:40]] + [(calm(), 0) for _ in range(60)]
    labelled = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(labels)], "label_id long, text string, label int")
    beside = [f"{calm()} {bad(w)} {calm()} {case} {common}" for w in WORDS[40:52]]
    alone = [f"{calm()} {case} {calm()}" for _ in range(6)]
    other = [f"{calm()} {calm()} {common if k % 2 else calm()}" for k in range(600)]
    docs = spark.createDataFrame([(k, "a", t) for k, t in enumerate([*beside, *alone, *other])], "doc_id long, source string, text string")
    got = {r["doc_id"] for r in abuse.abusive(docs, labelled).collect()}
    assert got >= set(range(18)) and len(got) <= 20
    plains = abuse.plain_texts(docs)
    learnt, hard, share = abuse.corpus_cases(plains, abuse.fit_rows(labels, [abuse.plain(calm()) for _ in range(600)]))
    assert learnt[0] == abuse.plain(case) and abuse.plain(common) not in learnt and abuse.plain(case) not in dict(hard) and 0 < share < 0.05


def test_disguises_read_alike():
    assert abuse.plain("Id1ot") == abuse.plain("IDIOT") == abuse.plain("idi​ot") == "idiot"
    assert abuse.plain("b-a-s-t-a-r-d").strip() == "bastard" and abuse.plain("baaaastard") == "bastard"


def test_two_masked_letters_score_nearer_the_plain_spelling_than_other_masks():
    frames = ["you are an %s", "what an %s this is", "look at the %s of the team", "only an %s would write it", "there is an %s in this channel"]
    calm = ["index", "image", "event", "input", "issue", "alias"]
    fitted = abuse.fit_rows([(f % "idiot", 1) for f in frames] + [(f % w, 0) for f in frames for w in calm], [])
    score = lambda w: float(fitted.margins([abuse.plain(f"he is an {w} again")])[0])
    assert score("i**ot") > max(map(score, ("i**ex", "i**ge", "a**as", "******"))) + 0.05 and score("idiot") > score("i**ot")

    def features(word):
        s = abuse.codes(f" {word} ").tolist()
        return {tuple(s[at + p] for p in places) for places in abuse.PLACES for at in range(len(s) - places[-1])}

    assert len(abuse.PLACES) == 10 and features("idiot") & features("i**ot")
