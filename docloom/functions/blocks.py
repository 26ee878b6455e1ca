"""Python-side reading of the JSON in ``blocks``: used inside Arrow map functions, once per document."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

#: Longest token the tokenizer keeps, in code points.
MAX_TOKEN = 40
WORD = re.compile(r"[^\W_]+")
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


def parse_blocks(text: str | None) -> list:
    """The array of blocks; null, blank, malformed and non-array JSON count as an empty array."""
    if not text:
        return []
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return []
    return value if isinstance(value, list) else []


def walk(blocks: list) -> Iterator[tuple[int, int, dict]]:
    """(ord, place in the outer array, block) in pre-order: a block, its items in order, then its children."""
    ord_ = 0
    stack: list[tuple[int, dict]] = [(k, b) for k, b in reversed(list(enumerate(blocks))) if isinstance(b, dict)]
    while stack:
        top, b = stack.pop()
        yield ord_, top, b
        ord_ += 1
        items, children = b.get("items"), b.get("children")
        if items or children:
            below = [(top, c) for item in items if isinstance(item, list) for c in item if isinstance(c, dict)] if isinstance(items, list) else []
            below += [(top, c) for c in children if isinstance(c, dict)] if isinstance(children, list) else []
            stack += reversed(below)


def bare(value: object) -> object:
    """A JSON value without what says nothing: null, false, empty texts, arrays and objects as fields. Elements of arrays stay."""
    if isinstance(value, dict):
        return {k: v for k, v in ((k, bare(v)) for k, v in value.items()) if v not in (None, False, "", [], {})}
    return [bare(v) for v in value] if isinstance(value, list) else value


def canonical(text: str | None) -> str:
    """The blocks in one form, whatever the layout of their JSON: bare, keys in order, without white space."""
    return json.dumps(bare(parse_blocks(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def spans_text(b: dict) -> str:
    """The texts of a block's spans, joined without a separator."""
    spans = b.get("spans")
    return "".join([s["t"] for s in spans if isinstance(s, dict) and isinstance(s.get("t"), str)]) if spans else ""


def own_texts(b: dict) -> list[str]:
    """A block's own texts: spans, code and cells, without those of the blocks below it."""
    out = []
    if b.get("spans"):
        out.append(spans_text(b))
    if isinstance(b.get("text"), str):
        out.append(b["text"])
    for row in b.get("rows") or ():
        out += [c for c in row if isinstance(c, str)] if isinstance(row, list) else []
    return out


def page_text(blocks: list) -> str:
    """All own texts of the blocks in pre-order, a line each."""
    out: list[str] = []
    for _, _, b in walk(blocks):
        if s := b.get("spans"):
            try:
                out.append("".join([x["t"] for x in s]))
            except (TypeError, KeyError):
                out.append(spans_text(b))
        if isinstance(t := b.get("text"), str):
            out.append(t)
        if r := b.get("rows"):
            out += [c for row in r if isinstance(row, list) for c in row if isinstance(c, str)]
    return "\n".join(out)


def words(text: str) -> list[str]:
    """The project's tokens of a text: runs of letters and digits, lower-cased, at most MAX_TOKEN code points."""
    found = [w.lower() for w in WORD.findall(text)]
    return [w for w in found if len(w) <= MAX_TOKEN] if len(text) > MAX_TOKEN else found
