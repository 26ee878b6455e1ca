"""Page boilerplate beside the main content (problem 7), by two passes of block rules.

The first pass decides each top-level block by itself, from its stop-word density, length, link density, separators, the
site's name, and from how many different pages of the corpus have its lines too; the second gives ambiguous short blocks
the label of their nearest decided neighbours, headings that of the list they head. No wording is written down but stop
words: what furniture says is found by counting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.blocks import page_text, parse_blocks
from docloom.session import cut
from docloom.sources.tables import latest

#: Words from which a block is decided by its stop words, and the densities of the decision.
LONG, STOPS_HIGH, STOPS_LOW, LINKS_HIGH, LINKS_LOW = 8, 0.18, 0.08, 0.5, 0.3
#: Words up to which a paragraph that names its own site is taken for page furniture.
SITE_LINE = 40
#: A line is common from so many pages and such a share of all pages; near-copies of a page count once.
COMMON_PAGES, COMMON_SHARE = 5, 0.0015
#: Share of a block's words in common lines from which it is furniture.
COMMON_WORDS = 0.6
#: A page with fewer words is short; a line with at least this share of its pages among them is a message, which is content.
SHORT_PAGE, MESSAGE_SHARE = 60, 0.5

# Frequent words of the four languages of the corpus.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can do does for from has have how i if in into is it its more most must not of on once one
    only or our so such than that the their them then there these they this to up was we were what when where which while who will with you your
    aber als am auch auf aus bei bis das dass dem den der des die ein eine einem einen einer er es für gibt hat ihn im in ist kann man mehr mit nach nicht
    nur oder sich sie sind so um und von vor wenn wie wird zu zum zur zwischen
    au aux avec ce ces chaque dans de des du elle en entre est et il jusqu la le les leur lui mais même ne on ou par pas plus pour qu quand que qui sans
    se ses si son sont sur un une
    al ante cada como con cuando de del desde donde el en entre es esta este hasta hay la las lo los más mismo muy no o para pero por puede que se si sin sobre
    solo su sus también un una y""".split()
)
_WORD = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"\s*(?:[|·•»›→/>]|\s[—–-]\s)\s*")
_ENDS = (".", "!", "?", ":", ";")


def _scan(blocks: list, lines: list[str]) -> int:
    """Characters of linked spans in the blocks and all below them; their texts are added to lines."""
    n = 0
    for b in blocks:
        if not isinstance(b, dict):
            continue
        if spans := b.get("spans"):
            texts = [(x.get("t") or "", x.get("h")) for x in spans if isinstance(x, dict)]
            lines.append("".join([t for t, _ in texts]))
            n += sum([len(t) for t, h in texts if h])
        if isinstance(b.get("text"), str):
            lines.append(b["text"])
        for row in b.get("rows") or ():
            lines += [c for c in row or () if isinstance(c, str)]
        for below in b.get("items") or ():
            if below:
                n += _scan(below, lines)
        if b.get("children"):
            n += _scan(b["children"], lines)
    return n


def parts(line: str, site: str, title: str) -> list[str]:
    """A line's sentences and the parts between its separators, as they are counted: lower case, runs of digits, the site's
    name and the page's title masked, white space as one space."""
    out = []
    line = " ".join(line.lower().split())
    if len(title := _SUFFIX.split(title)[0].strip()) > 8:
        line = line.replace(title, "\x02")
    for p in _SPLIT.split(line):
        p = _DIGITS.sub("0", p)
        p = p.replace(site, "\x01") if site else p
        if p := p.strip(" .!?:;,()[]×"):
            out.append(p)
    return out


_SPLIT = re.compile(r"(?<=[.!?:;])\s+|\s*[|·•»«›→/×]\s*|\s[—–-]\s")
_SUFFIX = re.compile(r"\s[|·•—–-]\s")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")


def key(part: str) -> int:
    x = xxhash.xxh3_64_intdigest(part)
    return x - (1 << 64) if x >= 1 << 63 else x


def decide(b: dict, site: str, own_headings: set[str], common: frozenset[int], title: str = "") -> bool | None:
    """First pass: True for page furniture, False for content, None where the block alone can't tell."""
    kind = b.get("type")
    if kind in ("code", "table", "heading"):
        return None if kind == "heading" else False
    lines: list[str] = []
    linked = _scan([b], lines)
    lines = [x for x in lines if x.strip()]
    low = "\n".join(lines).lower()
    found = _WORD.findall(low)
    n = len(found)
    if not n:
        return True if low.strip() else None
    stops = sum(map(STOP_WORDS.__contains__, found)) / n
    linked /= max(1, len(low))
    flat = " ".join(low.split())
    pieces = [p for x in lines for p in parts(x, site, title)]
    size = [len(p.split()) for p in pieces]
    shared = sum(w for w, p in zip(size, pieces) if key(p) in common)
    ended = flat.endswith(_ENDS)
    if pieces and (shared >= COMMON_WORDS * sum(size) or len(lines) == 1 and not ended and key(pieces[0]) in common):
        return True
    if n <= SITE_LINE and site and site in " ".join(found):
        return True
    if n >= LONG and stops >= STOPS_HIGH and linked <= LINKS_LOW and (ended or kind != "paragraph" and len(lines) > 1 and any(x.rstrip().endswith(_ENDS) for x in lines)):
        return False
    if kind == "paragraph" or len(lines) == 1:
        between = [len(p.split()) for p in _PARTS.split(flat) if p]
        if len(between) >= 3 and max(between) <= 8 and sum(between) <= 4 * len(between) and not ended:
            return True
        if flat[0] in _AROUND and flat[-1] in _AROUND:  # arrows to the pages before and after
            return True
    if kind == "list":
        items = [x for x in (" ".join(page_text(i).split()).lower() for i in b.get("items") or () if isinstance(i, list)) if x]
        if items and sum(i in own_headings for i in items) * 2 >= len(items):
            return True
        short = sum(len(i.split()) for i in items) <= 8 * len(items)
        if items and short and (linked >= LINKS_HIGH or not any(i.endswith(_ENDS) for i in items)):
            return True if linked >= 0.1 or stops < STOPS_LOW or len(items) > 1 else None
        return False if stops >= STOPS_LOW else None
    if linked >= LINKS_HIGH and n <= 25:
        return True
    if kind == "paragraph" and n >= 3 and stops < STOPS_LOW and not ended:
        shown = _WORD.findall(" ".join(lines))
        if sum(w[:1].isupper() for w in shown) * 2 >= n:
            return True
    if n >= 5 and ended and (stops > 0 or n >= LONG):
        return False
    return None


_AROUND = "«»‹›←→"


def label_page(blocks: list, site: str, headings: list[str], common: frozenset[int] = frozenset(), title: str = "") -> list[bool]:
    """Both passes over the top-level blocks of one page: True where a block is page furniture."""
    known = {h.lower() for h in headings}
    first = [decide(b, site, known, common, title) if isinstance(b, dict) else None for b in blocks]
    kinds = [b.get("type") if isinstance(b, dict) else None for b in blocks]
    n = len(first)
    before, after = [None] * n, [None] * n
    last = None
    for k in range(n):  # nearest decided block at or before k
        if first[k] is not None and kinds[k] != "heading":
            last = k
        before[k] = last
    last = None
    for k in range(n - 1, -1, -1):
        if first[k] is not None and kinds[k] != "heading":
            last = k
        after[k] = last
    out = []
    for k in range(n):
        if first[k] is not None:
            out.append(first[k])
        elif kinds[k] == "heading":  # a heading goes with a list it heads; a line of furniture ends a section, it doesn't make one
            out.append(k + 1 < n and kinds[k + 1] == "list" and first[k + 1] is True)
        elif kinds[k] == "list" and k and kinds[k - 1] == "heading" and first[k - 1]:  # what a sidebar's heading heads
            out.append(True)
        else:
            x, y = before[k], after[k]
            if x is None or y is None:
                z = x if x is not None else y
                out.append(bool(first[z]) if z is not None else False)
            else:
                out.append(bool(first[x]) if k - x < y - k else bool(first[y]) if y - k < k - x else bool(first[x] and first[y]))
    return out


def _ords(blocks: list) -> list[int]:
    """Pre-order places of the top-level blocks."""

    def size(b: dict) -> int:
        below = [c for i in b.get("items") or () if isinstance(i, list) for c in i] + list(b.get("children") or ())
        return 1 + sum(size(c) for c in below if isinstance(c, dict))

    out, at = [], 0
    for b in blocks:
        out.append(at)
        at += size(b) if isinstance(b, dict) else 0
    return out


def site_name(source_id: str | None) -> str:
    """The name a source's pages use for it: its id with spaces."""
    return " ".join((source_id or "").replace("-", " ").replace("_", " ").split()).lower()


def page_lines(parsed: list, site: str, title: str) -> tuple[set[int], int, int, bool]:
    """(hashes of the page's distinct lines, least hash of its sentences by two orders, whether it is short).

    Near-copies have most sentences in common, so mostly the same least ones.
    """
    own, body, n = set(), set(), 0
    for b in parsed:
        if not isinstance(b, dict):
            continue
        lines: list[str] = []
        _scan([b], lines)
        n += sum([len(x.split()) for x in lines])
        if b.get("type") not in ("code", "table", "heading"):
            for x in lines:
                for p in parts(x, site, title):
                    own.add(k := key(p))
                    if len(p.split()) >= LONG:
                        body.add(k)
    body = body or own
    return own, min(body, default=0), min([(k * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF for k in body], default=0), n < SHORT_PAGE


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        got = [page_lines(parse_blocks(b), site_name(s), (t or "").lower()) for b, s, t in zip(*(rb.column(c).to_pylist() for c in ("blocks", "source_id", "title")))]
        keep = [rb.column(c) for c in ("id", "indexed_at", "arrived_at")]
        made = [pa.array([list(g[0]) for g in got], pa.list_(pa.int64())), *(pa.array([g[k] for g in got], pa.int64()) for k in (1, 2)), pa.array([g[3] for g in got], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*keep, *made], ["id", "indexed_at", "arrived_at", "keys", "one", "two", "short"])


def common_lines(docs: DataFrame, least: int = COMMON_PAGES, share: float = COMMON_SHARE) -> frozenset[int]:
    """Hashes of the lines that at least ``least`` pages and ``share`` of all pages have, messages excepted.

    As a page has each line once, there are at most (lines of a page) / share of them, whatever the size of the corpus: so
    few are sent to all executors, first to be counted again with near-copies as one page, then to judge by. Counting
    combines on the map side.
    """
    counted = _times(docs).mapInArrow(_count, "id string, indexed_at long, arrived_at long, keys array<long>, one long, two long, short boolean")
    pages = cut(latest(counted, ["keys", "one", "two", "short"]))
    enough = max(least, share * pages.count())
    lines = pages.select(F.explode("keys").alias("key"), "one", "two", "short")
    often = lines.groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.count_if("short").alias("short")).filter((F.col("pages") >= enough) & (F.col("short") < MESSAGE_SHARE * F.col("pages")))
    again = lines.join(F.broadcast(often.select("key")), "key").groupBy("key").agg(F.approx_count_distinct("one").alias("one"), F.approx_count_distinct("two").alias("two"))
    return frozenset(r["key"] for r in again.filter(F.greatest("one", "two") >= enough).select("key").collect())


def _times(docs: DataFrame) -> DataFrame:
    return docs.select("id", "source_id", "title", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("indexed_at", "arrived_at")], F.transform("headings", lambda h: h["text"]).alias("headings"), "blocks")


def _label(batches: Iterator[pa.RecordBatch], common: frozenset[int]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        ords, sizes = [], []
        for blocks, source, headings, title in zip(*(rb.column(c).to_pylist() for c in ("blocks", "source_id", "headings", "title"))):
            parsed = parse_blocks(blocks)
            flags = label_page(parsed, site_name(source), [h for h in headings or () if h], common, (title or "").lower())
            at = _ords(parsed)
            ords.append([o for o, f in zip(at, flags) if f])
            sizes.append(len(parsed))
        keep = [rb.column(c) for c in ("id", "indexed_at", "arrived_at")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(ords, pa.list_(pa.int32())), pa.array(sizes, pa.int32())], ["id", "indexed_at", "arrived_at", "ords", "top_blocks"])


def boilerplate_blocks(docs: DataFrame) -> DataFrame:
    """(id, ords, top_blocks): for each current document, the places of its top-level blocks that are page furniture.

    One pass counts the lines of all current documents, a second judges every page where it is read; only hashes and
    places are shuffled. Null, malformed and empty blocks give an empty array; blocks that aren't objects are never named;
    pages of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_lines(docs))
    labelled = _times(docs).mapInArrow(lambda it: _label(it, shared.value), "id string, indexed_at long, arrived_at long, ords array<int>, top_blocks int")
    return latest(labelled, ["ords", "top_blocks"]).drop("indexed_at")


def boilerplate_ords(docs: DataFrame) -> DataFrame:
    """(id, ord) of every top-level block of a current document that is page furniture."""
    return boilerplate_blocks(docs).select("id", F.explode("ords").alias("ord"))


def main_content(docs: DataFrame) -> DataFrame:
    """(id, text): the text of each current document's own content, a line for each span group, code or cell."""
    shared = docs.sparkSession.sparkContext.broadcast(common_lines(docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for blocks, source, headings, title in zip(*(rb.column(c).to_pylist() for c in ("blocks", "source_id", "headings", "title"))):
                parsed = parse_blocks(blocks)
                flags = label_page(parsed, site_name(source), [h for h in headings or () if h], shared.value, (title or "").lower())
                out.append(page_text([b for b, f in zip(parsed, flags) if not f]))
            yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array(out, pa.string())], ["id", "text"])

    return latest(_times(docs), ["source_id", "title", "headings", "blocks"]).mapInArrow(keep, "id string, text string")
