"""Building the inverted index as ordinary tables: postings, terms, index_docs and one row of statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.functions import text
from docloom.functions.blocks import parse_blocks, spans_text, walk
from docloom.sources.tables import latest

WEIGHTS = {"title": 6, "heading": 3, "body": 1}
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """postings (doc, term, tf), terms (term, df), docs (doc, ..., length), stats (n, avg_doc_length): one row."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame


def split_fields(blocks: str | None) -> tuple[str, str, str]:
    """(headings, body, plain) of one document's blocks."""
    heads, body, plain = [], [], []
    for _, _, b in walk(parse_blocks(blocks)):
        kind = b.get("type")
        if kind == "heading":
            heads.append(spans_text(b))
        elif kind == "paragraph":
            body.append(spans_text(b))
            plain.append(body[-1])
        elif kind == "code":
            body.append(b["text"] if isinstance(b.get("text"), str) else "")
        elif kind == "table":
            body += [" ".join([c for c in r if isinstance(c, str)]) for r in b.get("rows") or () if isinstance(r, list)]
    return " ".join(heads), " ".join(body), " ".join(plain)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        got = [split_fields(b) for b in rb.column("blocks").to_pylist()]
        keep = [c for c in rb.schema.names if c != "blocks"]
        yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), *(pa.array([g[k] for g in got], pa.string()) for k in range(3))], [*keep, "headings", "body", "plain"])


def with_fields(docs: DataFrame) -> DataFrame:
    """docs with headings, body and plain in place of blocks, split where they are read."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "blocks"), "headings string, body string, plain string"])
    return docs.mapInArrow(_split, schema)


def field_texts(docs: DataFrame) -> DataFrame:
    """(id, headings, body, plain): the current documents' texts by field, each joined in document order.

    Headings; paragraphs, code and table rows (cells joined by a space) as body; paragraphs alone, those in lists and
    quotes included, as plain text. Documents without blocks have empty texts.
    """
    rows = docs.select("id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("indexed_at", "arrived_at")], "blocks")
    return latest(with_fields(rows), ["headings", "body", "plain"])


def index_documents(docs: DataFrame) -> DataFrame:
    """(doc, source_id, title, url, summary, headings, body) of the current documents, ready for build_index."""
    own = ["source_id", "title", "url", "description"]
    rows = docs.select("id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("indexed_at", "arrived_at")], *own, "blocks")
    now = latest(with_fields(rows), [*own, "headings", "body", "plain"])
    return now.select(F.col("id").alias("doc"), "source_id", "title", "url", text.summary("description", "plain").alias("summary"), "headings", "body")


def weighted_postings(docs: DataFrame, fields: dict[str, int], key: str = "doc") -> DataFrame:
    """(key, term, tf): each term's occurrences in the text columns, weighted by the column's number.

    Stop words and over-long tokens aren't indexed; null texts have no terms. Counted per document before the shuffle by
    (key, term), so a common term is no hot key.
    """

    def weighted(column: str, w: int) -> Column:
        return F.transform(F.coalesce(text.index_tokens(column), F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    parts = F.flatten(F.array(*[weighted(c, w) for c, w in fields.items()]))
    return docs.filter(F.col(key).isNotNull()).select(key, F.explode(parts).alias("p")).groupBy(key, F.col("p.term").alias("term")).agg(F.sum("p.w").cast("long").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term is."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def document_lengths(docs: DataFrame, postings: DataFrame, key: str = "doc") -> DataFrame:
    """docs with ``length``, the sum of their tf, 0 for documents without terms."""
    return docs.join(postings.groupBy(key).agg(F.sum("tf").cast("long").alias("length")), key, "left").na.fill(0, ["length"])


def statistics(docs: DataFrame) -> DataFrame:
    """One row: n, avg_doc_length (0 without documents) and the index's constants."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_doc_length")).select(
        "n", "avg_doc_length", F.lit(K1).alias("k1"), F.lit(B).alias("b"), *[F.lit(w).alias(f"w_{f}") for f, w in WEIGHTS.items()]
    )


def build_index(docs: DataFrame, key: str = "doc") -> Index:
    """The index of documents with columns key, title, headings and body; other columns stay with docs."""
    postings = weighted_postings(docs, {"title": WEIGHTS["title"], "headings": WEIGHTS["heading"], "body": WEIGHTS["body"]}, key)
    sized = document_lengths(docs.drop("headings", "body"), postings, key)
    return Index(postings, document_frequency(postings), sized, statistics(sized))


def dense_order(docs: DataFrame, spread: int | None = None, order: tuple[str, ...] = ("source_id", "title", "url")) -> DataFrame:
    """docs with ``idx``, their 0-based place in the order of the columns ``order``.

    Range partitions are numbered within themselves and offset by the sizes of those before, so no task sorts all rows.
    """
    n = spread or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("idx", F.col("_before") + F.col("_r") - 1).drop("_p", "_r", "_before")


def posting_lists(postings: DataFrame, idx: str = "idx") -> DataFrame:
    """(term, list): the flat array [idx, tf, idx, tf, ...] in order of idx, the form of the file format.

    A list is as long as its term is common; it is built for export only.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(idx).cast("long").alias("d"), F.col("tf").cast("long").alias("f"))))
    return postings.groupBy("term").agg(F.flatten(F.transform(pairs, lambda p: F.array(p["d"], p["f"]))).alias("list"))


def long_postings(lists: DataFrame) -> DataFrame:
    """(term, idx, tf) from flat posting lists."""
    at = F.sequence(F.lit(0), (F.size("list") / 2).cast("int") - 1)
    pairs = F.when(F.size("list") > 0, F.transform(at, lambda k: F.struct(F.element_at("list", k * 2 + 1).alias("idx"), F.element_at("list", k * 2 + 2).alias("tf"))))
    return lists.select("term", F.explode(pairs).alias("p")).select("term", "p.idx", "p.tf")


def bm25(tf: Column, df: Column, n: Column, length: Column, avg: Column, factor: Column | float = 1.0, k1: float = K1, b: float = B) -> Column:
    """The ranking formula of one term in one document."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return factor * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.when(avg > 0, avg).otherwise(1.0)))
