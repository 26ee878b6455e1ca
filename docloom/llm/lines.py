"""Lines repeated across one site's documents (problem 6).

Paragraph lines are parsed into templates by a token tree of fixed depth: the number of tokens, then the leading tokens,
then the template, whose wildcard slots stand for runs of digits. Each partition grows its own tree; the trees are merged
by adding their counts; templates that cover many documents of a source are the repeated lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.blocks import parse_blocks, spans_text, walk
from docloom.session import cut
from docloom.sources.tables import latest

#: A line has at least so many words; a template is repeated from so many documents and such a share of the source's.
MIN_TOKENS, MIN_DOCS, MIN_SHARE = 4, 5, 0.1
#: Leading tokens on the way from the tree's root to a leaf.
DEPTH = 3
#: Templates after which a partition's tree is handed on and begun again.
TREE_SIZE = 500_000
#: Repeated templates up to which they are sent to all executors; beyond it a shuffle join is used.
SENT_TEMPLATES = 1_000_000
WILDCARD = "<*>"
_DIGITS = re.compile(r"\d+")


def parse_line(text: str) -> list[str]:
    """The template's tokens: parted by white space, case folded, digit runs as wildcard slots."""
    return _DIGITS.sub(WILDCARD, text.casefold()).split()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def path_of(tokens: list[str]) -> tuple[int, int]:
    """(leaf, template) of a line: hashes of the way through the tree and of the whole template."""
    return _signed(xxhash.xxh3_64_intdigest("\x1f".join([str(len(tokens)), *tokens[:DEPTH]]))), _signed(xxhash.xxh3_64_intdigest("\x1f".join(tokens)))


def page_lines(blocks: str | None, min_tokens: int) -> Iterator[tuple[int, int, int]]:
    """(ord, leaf, template) of the page's paragraphs with enough tokens, at any depth."""
    for ord_, _, b in walk(parse_blocks(blocks)):
        if b.get("type") == "paragraph":
            tokens = parse_line(spans_text(b))
            if len(tokens) >= min_tokens:
                yield ord_, *path_of(tokens)


def _parse(batches: Iterator[pa.RecordBatch], min_tokens: int) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        ords, leaves, temps = [], [], []
        for blocks in rb.column("blocks").to_pylist():
            got = list(page_lines(blocks, min_tokens))
            for out, k in ((ords, 0), (leaves, 1), (temps, 2)):
                out.append([x[k] for x in got])
        keep = [rb.column(c) for c in ("id", "source_id", "indexed_at", "arrived_at")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(ords, pa.list_(pa.int32())), pa.array(leaves, pa.list_(pa.int64())), pa.array(temps, pa.list_(pa.int64()))], ["id", "source_id", "indexed_at", "arrived_at", "ords", "leaves", "temps"])


def _grow(batches: Iterator[pa.RecordBatch], most: int = TREE_SIZE) -> Iterator[pa.RecordBatch]:
    """The partition's tree, source -> leaf -> template -> documents, as rows; a document counts once for a template."""
    tree: dict = {}
    size = 0

    def rows() -> pa.RecordBatch:
        flat = [(s, leaf, t, n) for s, leaves in tree.items() for leaf, temps in leaves.items() for t, n in temps.items()]
        tree.clear()
        cols = list(zip(*flat)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["source_id", "leaf", "template", "docs"])

    for rb in batches:
        for source, leaves, temps in zip(*(rb.column(c).to_pylist() for c in ("source_id", "leaves", "temps"))):
            below = tree.setdefault(source, {})
            for leaf, t in set(zip(leaves, temps)):
                at = below.setdefault(leaf, {})
                size += t not in at
                at[t] = at.get(t, 0) + 1
        if size >= most:
            yield rows()
            size = 0
    yield rows()


def _current(docs: DataFrame, min_tokens: int) -> DataFrame:
    rows = docs.select("id", "source_id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("indexed_at", "arrived_at")], "blocks")
    parsed = rows.mapInArrow(lambda it: _parse(it, min_tokens), "id string, source_id string, indexed_at long, arrived_at long, ords array<int>, leaves array<long>, temps array<long>")
    return latest(parsed, ["source_id", "ords", "leaves", "temps"]).filter("source_id IS NOT NULL").drop("indexed_at")


def _repeated(pages: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    totals = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("source_docs"))
    trees = pages.select("source_id", "leaves", "temps").mapInArrow(_grow, "source_id string, leaf long, template long, docs long")
    merged = trees.groupBy("source_id", "leaf", "template").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    return merged.join(totals, "source_id").filter(F.col("docs") + 1e-9 >= min_share * F.col("source_docs"))


def repeated_templates(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source_id, leaf, template, docs, source_docs): templates in at least min_docs documents and min_share of the source's."""
    return _repeated(_current(docs, min_tokens), min_docs, min_share)


def repeated_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, ord, source_id, template, docs, source_docs): the paragraphs of current documents whose line is repeated.

    A line repeated within a document counts once for it, but every place is returned. Null, malformed or empty blocks
    have no lines yet count as a document of their source; documents without a source have no repeated lines. Only hashes
    are shuffled; counts are added up in each partition first, so a source with any share of the rows is no hot key.
    """
    pages = cut(_current(docs, min_tokens))
    found = cut(_repeated(pages, min_docs, min_share))
    line = pages.select("id", "source_id", F.explode(F.arrays_zip("ords", "temps")).alias("x")).select("id", "source_id", F.col("x.ords").alias("ord"), F.col("x.temps").alias("template"))
    known = found.select("source_id", "template", "docs", "source_docs")
    known = F.broadcast(known) if known.count() <= SENT_TEMPLATES else known
    return line.join(known, ["source_id", "template"]).select("id", "ord", "source_id", "template", "docs", "source_docs")


def _without(blocks: list, drop: set[int], at: list[int]) -> list:
    out = []
    for b in blocks:
        if not isinstance(b, dict):
            out.append(b)
            continue
        mine = at[0]
        at[0] += 1
        b = dict(b)
        if isinstance(b.get("items"), list):
            b["items"] = [_without(i, drop, at) if isinstance(i, list) else i for i in b["items"]]
        if isinstance(b.get("children"), list):
            b["children"] = _without(b["children"], drop, at)
        if mine not in drop:
            out.append(b)
    return out


def without_blocks(blocks: str | None, drop: set[int]) -> str:
    """The blocks' JSON without the blocks of the given places in pre-order."""
    import json

    return json.dumps(_without(parse_blocks(blocks), drop, [0]), ensure_ascii=False, separators=(",", ":"))


def strip_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, blocks, removed): each current document without its repeated lines, and how many blocks were removed.

    The current rows of the documents are shuffled once by id; the places to remove are joined to them there.
    """
    found = repeated_lines(docs, min_tokens, min_docs, min_share).groupBy("id").agg(F.collect_set("ord").alias("drop"))
    now = latest(docs.select("id", "indexed_at", "arrived_at", "blocks"), ["blocks"]).drop("indexed_at")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            drops = [set(d or ()) for d in rb.column("drop").to_pylist()]
            new = [without_blocks(b, d) for b, d in zip(rb.column("blocks").to_pylist(), drops)]
            yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array(new, pa.string()), pa.array([len(d) for d in drops], pa.int32())], ["id", "blocks", "removed"])

    return now.join(found, "id", "left").mapInArrow(strip, "id string, blocks string, removed int")
