"""Tokenizer, hashes, summaries and small scalar functions, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.blocks import MAX_TOKEN, canonical

# The words that are never indexed.
STOP_WORDS = ("a", "an", "are", "be", "by", "into", "of", "on", "such", "that", "the", "their", "there", "these", "they", "this", "to", "was", "were", "will")
#: Code points of a summary.
SUMMARY = 240


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits, cut out first and lower-cased then, of at most MAX_TOKEN code points; null gives null."""
    found = F.regexp_extract_all(col(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda t: F.char_length(t) <= MAX_TOKEN)


def index_tokens(text: Column | str) -> Column:
    """Tokens without the stop words, repeats kept."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def query_terms(query: Column | str) -> Column:
    """Distinct tokens in order without stop words; the stop words themselves where nothing else is left."""
    every = tokens(query)
    kept = F.filter(every, lambda t: ~t.isin(*STOP_WORDS))
    return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(every))


def document_id(source_id: Column | str, url: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of source and URL, a zero byte between them."""
    return F.substring(F.sha2(F.concat(col(source_id), F.lit("\0"), col(url)), 256), 1, 16)


@F.pandas_udf(StringType())
def _canonical(blocks: pd.Series) -> pd.Series:
    return blocks.map(canonical)


def content_hash(blocks: Column | str) -> Column:
    """SHA-256 of the blocks: equal blocks have equal hashes, whatever the layout of their JSON. Null counts as no blocks."""
    return F.sha2(_canonical(col(blocks)), 256)


def collapse(text: Column | str) -> Column:
    """White space (that of Unicode too) as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def phrase(query: Column | str) -> Column:
    """The query as it is compared with titles: collapsed and lower-cased, stop words and punctuation kept."""
    return F.lower(collapse(query))


def truncate(text: Column | str, n: int = SUMMARY) -> Column:
    """At most n code points: cut back to the last space if that stands beyond byte n / 2, closing marks dropped, ``…`` added."""
    t = col(text)
    head = F.substring(t, 1, n)
    before = F.regexp_extract(head, r"(?s)^(.*) ", 1)  # up to the last space
    back = F.when(head.contains(" ") & (F.octet_length(before) > n // 2), before).otherwise(head)
    return F.when(F.char_length(t) <= n, t).otherwise(F.concat(F.regexp_replace(back, r"[ ,.;:]+$", ""), F.lit("…")))


def summary(description: Column | str, plain: Column | str, n: int = SUMMARY) -> Column:
    """The description, or the plain text where that is null or blank, collapsed and truncated."""
    own = F.nullif(F.trim(col(description)), F.lit(""))
    return truncate(collapse(F.coalesce(own, col(plain), F.lit(""))), n)


def spans_text(spans: Column | str) -> Column:
    """The texts of an array of spans joined without a separator."""
    return F.array_join(F.transform(col(spans), lambda s: F.coalesce(s["t"], F.lit(""))), "")


def colour_slot(source_id: Column | str, slots: int = 8) -> Column:
    """A stable slot of a source: a 32-bit polynomial hash of its characters modulo ``slots``."""
    codes = F.transform(F.filter(F.split(col(source_id), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296))) % slots).cast("int")


def relative_time(then: Column | str, now: Column | str) -> Column:
    """How long ago, in the largest unit that fits: year 365 d, month 30 d, week, day, hour, minute; else ``just now``."""
    s = F.unix_timestamp(col(now)) - F.unix_timestamp(col(then))
    out = F.lit("just now")
    for name, size in (("minute", 60), ("hour", 3600), ("day", 86400), ("week", 604800), ("month", 2592000), ("year", 31536000)):
        n = F.floor(s / size)
        out = F.when(s >= size, F.concat(n.cast("string"), F.when(n == 1, f" {name} ago").otherwise(f" {name}s ago"))).otherwise(out)
    return out


def flag_list(text: Column | str) -> Column:
    """The parts of a comma-separated list, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(col(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def whole_seconds(at: Column | str) -> Column:
    """A timestamp without its fraction of a second, as documents and manifests keep it."""
    return F.date_trunc("second", col(at))


def search_route(query: Column | str, sources: Column | str) -> Column:
    """The route of a search: ``#/search?q=...&s=...``, parameters that say nothing left out; sources is an array."""
    q, s = F.nullif(col(query), F.lit("")), F.nullif(F.array_join(F.coalesce(col(sources), F.array().cast("array<string>")), ","), F.lit(""))
    parts = F.array_join(F.array_compact(F.array(F.concat(F.lit("q="), F.url_encode(q)), F.concat(F.lit("s="), F.url_encode(s)))), "&")
    return F.concat(F.lit("#/search"), F.when(parts == "", "").otherwise(F.concat(F.lit("?"), parts)))


def route_parts(route: Column | str) -> Column:
    """struct<path, query, sources, anchor> of a route; what can't be decoded stays as it is."""
    r = F.regexp_replace(col(route), "^#", "")

    def said(name: str) -> Column:
        raw = F.regexp_extract(r, rf"[?&]{name}=([^&]*)", 1)
        return F.coalesce(F.try_url_decode(raw), raw)

    return F.struct(F.regexp_extract(r, r"^([^?]*)", 1).alias("path"), said("q").alias("query"), flag_list(said("s")).alias("sources"), said("a").alias("anchor"))


def display_url(url: Column | str) -> Column:
    """A URL without its http or https scheme."""
    return F.regexp_replace(col(url), r"^https?://", "")


def document_path(id_: Column | str) -> Column:
    """Where a document's JSON file lies in a corpus folder."""
    i = col(id_)
    return F.concat(F.lit("docs/"), F.substring(i, 1, 2), F.lit("/"), i, F.lit(".json"))
