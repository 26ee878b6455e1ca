"""Snippets and highlighting of search results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.functions import text

#: Characters before and after the first hit.
BEFORE, AFTER = 70, 180


def segments(blocks: DataFrame) -> DataFrame:
    """(id, ord, sub, text, code, anchor, heading): texts of block_rows with the last heading before them.

    A heading is a segment with its own anchor; each row of a table is one, its cells joined by " · "; blocks without a
    text of their own are none.
    """
    own = F.when(F.col("type") == "code", F.coalesce("text", F.lit(""))).when(F.col("type").isin("heading", "paragraph"), text.spans_text(F.coalesce("spans", F.array().cast("array<struct<t:string,c:boolean,b:boolean,i:boolean,h:string>>"))))
    rows = F.transform("rows", lambda r: F.array_join(r, " · "))
    texts = F.when(F.col("type") == "table", F.coalesce(rows, F.array().cast("array<string>"))).when(own.isNotNull(), F.array(own))
    so_far = W.partitionBy("id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.last(F.when(F.col("type") == "heading", F.struct(F.col("anchor").alias("anchor"), own.alias("heading"))), ignorenulls=True).over(so_far)
    marked = blocks.select("id", "ord", (F.col("type") == "code").alias("code"), (F.col("type") == "heading").alias("is_heading"), head.alias("h"), texts.alias("t"))
    return marked.select("id", "ord", "code", "is_heading", "h", F.posexplode("t").alias("sub", "text")).filter("text <> ''").select("id", "ord", "sub", "text", "code", "is_heading", "h.anchor", "h.heading")


def first_match(token: Column, terms: list[str]) -> Column:
    """The first of the terms that the token equals or, from two characters on, begins with; else null."""
    out = F.lit(None).cast("string")
    for t in reversed(terms):
        hit = (token == t) | token.startswith(t) if len(t) >= 2 else token == t
        out = F.when(hit, F.lit(t)).otherwise(out)
    return out


def window_around(body: Column, at: Column, before: int = BEFORE, after: int = AFTER) -> Column:
    """The text around the 1-based place ``at``, cut at spaces, with marks where it is cut."""
    n = F.char_length(body)
    low, high = at - before, at + after
    start = F.when(low <= 1, F.lit(1)).otherwise(F.coalesce(F.nullif(F.locate(" ", body, 1) * 0 + F.instr(F.substring(body, low, n), " "), F.lit(0)) + low, low))
    start = F.when(start > at, F.greatest(low, F.lit(1))).otherwise(start)
    head = F.substring(body, F.lit(1), high)
    back = F.char_length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    stop = F.when(high >= n, n).when(back > at, back).otherwise(high)
    cut = F.trim(F.substring(body, start, stop - start + 1))
    return F.concat(F.when(start > 1, "… ").otherwise(""), cut, F.when(stop < n, " …").otherwise(""))


def best_parts(parts: DataFrame, terms: list[str]) -> DataFrame:
    """(id, s, ord, sub, text, anchor, heading): each document's best segment, s its points below zero.

    Ten points for each distinct term, two for a text that isn't code, one for one that isn't a heading; the earliest
    wins a tie.
    """
    found = F.array_compact(F.array_distinct(F.transform(text.tokens("text"), lambda t: first_match(t, terms))))
    scored = parts.withColumn("n", F.size(found)).filter("n > 0").withColumn("score", F.col("n") * 10 + F.when(F.col("code"), 0).otherwise(2) + F.when(F.col("is_heading"), 0).otherwise(1))
    keep = F.struct((-F.col("score")).alias("s"), "ord", "sub", "text", "anchor", "heading")
    return scored.groupBy("id").agg(F.min(keep).alias("b")).select("id", "b.*")


def best_snippets(parts: DataFrame, terms: list[str]) -> DataFrame:
    """(id, snippet, anchor, heading): the window around the first hit of each document's best segment.

    Documents without a hit have no row; a heading that says what the snippet says is left out.
    """
    if not terms:
        return parts.select("id", F.lit("").alias("snippet"), "anchor", "heading").filter(F.lit(False))
    best = best_parts(parts, terms)
    options = "|".join(re.escape(t) + ("" if len(t) >= 2 else r"(?![\p{L}\p{N}])") for t in terms)
    lead = F.char_length(F.regexp_extract(F.lower("text"), rf"(?s)^(.*?)(?<![\p{{L}}\p{{N}}])(?:{options})", 1)) + 1
    shown = F.nullif("heading", "text")
    return best.select("id", window_around(F.regexp_replace("text", r"\s+", " "), lead).alias("snippet"), "anchor", shown.alias("heading"))


def tokens_with_places(body: str) -> list[tuple[str, int, int]]:
    """(token, start, end) of every token, in code points."""
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", body)]


def utf16_places(body: str) -> list[tuple[str, int, int]]:
    """tokens_with_places in UTF-16 units, as browsers count: a code point above the first plane takes two."""
    out, at, far = [], 0, 0
    for token, s, e in tokens_with_places(body):
        before = far + sum(c > "\uffff" for c in body[at:s])
        far = before + sum(c > "\uffff" for c in body[s:e])
        out.append((token, s + before, e + far))
        at = e
    return out


def highlight_parts(body: str, terms: list[str]) -> list[tuple[str, bool]]:
    """The text in parts, those that are hits marked; without terms or text, one plain part."""
    parts, at = [], 0
    for token, s, e in tokens_with_places(body) if terms else ():
        if any(token == t or (len(t) >= 2 and token.startswith(t)) for t in terms):
            if s > at:
                parts.append((body[at:s], False))
            parts.append((body[s:e], True))
            at = e
    if at < len(body) or not parts:
        parts.append((body[at:], False))
    return parts


def highlight(body: Column | str, terms: list[str]) -> Column:
    """highlight_parts as an Arrow UDF: array of (text, hit)."""

    @F.pandas_udf("array<struct<text:string,hit:boolean>>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda b: [{"text": t, "hit": h} for t, h in highlight_parts(b, terms)] if isinstance(b, str) else None)

    return run(body)


def shown(results: DataFrame, snippets: DataFrame, key: str = "doc") -> DataFrame:
    """results with the snippet, or the document's summary where there is none."""
    s = snippets.select(F.col("id").alias(key), "snippet", "anchor", "heading")
    return results.join(s, key, "left").withColumn("shown", F.coalesce("snippet", "summary"))
