"""What a reader of the corpus sees: short titles, resolved links, tables of contents, sources."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# What stands between a page's title and its site's name.
SEPARATORS = (" - ", " — ", " – ", " | ", " · ", " :: ")


def title_suffixes(docs: DataFrame) -> DataFrame:
    """(source_id, suffix): the ending that most titles of a source share.

    Every ending that begins at a separator counts once per title; the most frequent wins, then the longest, then the
    smaller; it must be that of at least half of the source's titles and of two. Null titles count as empty ones.
    """
    t = F.coalesce("title", F.lit(""))
    marks = "|".join(s.replace("|", r"\|") for s in SEPARATORS)
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.char_length(t), F.lit(2))), lambda p: F.substring(t, p, F.char_length(t)).rlike(f"^(?:{marks})"))
    d = docs.select("source_id", t.alias("t"), F.array_distinct(F.transform(places, lambda p: F.substring(t, p, F.char_length(t)))).alias("s"))
    many = d.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    counted = d.select("source_id", F.explode("s").alias("suffix")).groupBy("source_id", "suffix").agg(F.count(F.lit(1)).alias("c"))
    fit = counted.join(many, "source_id").filter((F.col("n") >= 2) & (F.col("c") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2))))
    best = fit.groupBy("source_id").agg(F.min(F.struct((-F.col("c")).alias("c"), (-F.char_length("suffix")).alias("l"), "suffix")).alias("m"))
    return best.select("source_id", F.col("m.suffix").alias("suffix"))


def short_titles(docs: DataFrame) -> DataFrame:
    """docs with ``short_title``: the title without its source's suffix, trimmed; a title that is nothing else stays."""
    t, s = F.coalesce("title", F.lit("")), F.col("suffix")
    cut = F.when(s.isNotNull() & t.endswith(s) & (F.char_length(t) > F.char_length(s)), F.substring(t, F.lit(1), F.char_length(t) - F.char_length(s))).otherwise(t)
    return docs.join(F.broadcast(title_suffixes(docs)), "source_id", "left").withColumn("short_title", F.trim(cut)).drop("suffix")


_PAIRS = [(chr(c), base) for c in range(0xC0, 0x250) if (base := unicodedata.normalize("NFD", chr(c))[0]).isascii()]
_ACCENTED, _PLAIN = ("".join(x) for x in zip(*_PAIRS))


def natural_key(text: Column) -> Column:
    """A key by which texts sort naturally: folded case and accents of Latin letters, runs of digits by their value."""
    folded = F.lower(F.translate(text, _ACCENTED, _PLAIN))
    parts = F.regexp_extract_all(folded, F.lit(r"\d+|\D+"), F.lit(0))
    pad = F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p))
    return F.array_join(pad, "")


def browse_titles(docs: DataFrame) -> DataFrame:
    """Documents by their short titles in natural order."""
    return short_titles(docs).withColumn("sort_key", natural_key(F.col("short_title"))).orderBy("sort_key", "short_title", "url")


def decoded(fragment: Column) -> Column:
    """A percent-decoded fragment, a plus sign kept; as it is where it can't be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(fragment, F.lit("+"), F.lit("%2B"))), fragment)


def resolve_links(links: DataFrame, docs: DataFrame, href: str = "href") -> DataFrame:
    """links with ``target`` (id of the document at the URL, the first in index order) and ``anchor``, or nulls."""
    first = docs.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min(F.struct("source_id", F.coalesce("title", F.lit("")), "id")).alias("m")).select(F.col("url").alias("_url"), F.col("m.id").alias("target"))
    bare = F.regexp_extract(href, r"(?s)^([^#]*)", 1)
    frag = F.nullif(F.regexp_extract(href, r"(?s)#(.*)$", 1), F.lit(""))
    joined = links.withColumn("_url", bare).join(first, "_url", "left")
    return joined.withColumn("anchor", F.when(F.col("target").isNotNull(), decoded(frag))).drop("_url")


def split_title(blocks: DataFrame) -> DataFrame:
    """Top-level blocks with ``is_title``: the first heading, where it is the only one of level 1 at the top."""
    top = blocks.filter("depth = 0")
    by = W.partitionBy("id")
    first = F.min(F.when(F.col("type") == "heading", F.col("ord"))).over(by)
    ones = F.count(F.when((F.col("type") == "heading") & (F.col("level") == 1), 1)).over(by)
    return top.withColumn("is_title", (F.col("ord") == first) & (F.col("level") == 1) & (ones == 1))


def contents(headings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, place, level, text, anchor, depth): headings whose anchor stands in the blocks, for documents with several.

    headings has id, place, level, text, anchor; blocks are those left of split_title; level 4 and above only, depth from
    the least level and 3 at most.
    """
    present = blocks.filter("type = 'heading' AND anchor IS NOT NULL").select("id", "anchor").distinct()
    kept = headings.filter("level <= 4").join(present, ["id", "anchor"], "left_semi")
    by = W.partitionBy("id")
    depth = F.least(F.col("level") - F.min("level").over(by), F.lit(3))
    return kept.withColumn("depth", depth).withColumn("_n", F.count(F.lit(1)).over(by)).filter("_n > 1").select("id", "place", "level", "text", "anchor", "depth")


def sources_overview(manifest: DataFrame) -> DataFrame:
    """One row per source with its counts, in order of name."""
    return manifest.select("id", F.coalesce("name", "id").alias("name"), "status", "document_count", "pages_fetched", "pages_skipped", "errors", F.size(F.coalesce("error_samples", F.array().cast("array<string>"))).alias("samples"), F.array_join("start_urls", " ").alias("start_urls"), "indexed_at").orderBy("name", "id")


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(id, ord, line): a Markdown line for each block of block_rows, without the blocks below it."""
    spans = F.array_join(F.transform("spans", lambda s: F.when(s["h"].isNotNull(), F.concat(F.lit("["), s["t"], F.lit("]("), s["h"], F.lit(")"))).when(s["c"], F.concat(F.lit("`"), s["t"], F.lit("`"))).when(s["b"], F.concat(F.lit("**"), s["t"], F.lit("**"))).when(s["i"], F.concat(F.lit("*"), s["t"], F.lit("*"))).otherwise(s["t"])), "")
    code = F.concat(F.lit("```"), F.coalesce("lang", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))
    rows = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))), "\n")
    line = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), spans)).when(F.col("type") == "code", code).when(F.col("type") == "table", rows).when(F.col("type") == "paragraph", spans)
    return blocks.select("id", "ord", line.alias("line")).filter("line IS NOT NULL")
