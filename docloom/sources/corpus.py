"""The corpus on disk: engine tables in Parquet, and the JSON format of documents, search index and manifest."""

from __future__ import annotations

import json
import os
import re
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators.indexing import Index, dense_order, posting_lists

FORMAT_VERSION = 1
# The formats' names.
FORMATS = {"manifest": "docs-corpus-manifest", "index": "docs-search-index"}
_ID = re.compile(r"^[0-9a-f]{16}$")


class CorpusError(ValueError):
    """A corpus that is missing or of another format."""


def write_tables(index: Index, path: str) -> None:
    """The index tables: the dictionary in order of its terms, so that prefixes skip row groups; postings by term."""
    index.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_tables(spark: SparkSession, path: str) -> Index:
    """The tables that write_tables wrote."""
    return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "docs", "stats")))


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents in Parquet, a folder for each source, so that one source is read or replaced by itself."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)


def read_documents(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Documents of the named sources (all if None), other folders unread."""
    docs = spark.read.parquet(path)
    return docs.filter(F.col("source_id").isin(sources)) if sources is not None else docs


def document(docs: DataFrame, id_: str) -> DataFrame:
    """The document of an id of 16 hex digits; a CorpusError for anything else."""
    if not _ID.match(id_):
        raise CorpusError(f"{id_!r} is no document id")
    return docs.filter(F.col("id") == id_)


def export_json(docs: DataFrame, index: Index, manifest: dict, path: str) -> None:
    """The JSON corpus: a file for each document, the search index, the manifest last, as it says the corpus is whole.

    Documents are written by the executors, so path must be one that all of them share; the index is one file and so made
    for corpora that a browser reads.
    """
    os.makedirs(path, exist_ok=True)
    rows = docs.select("id", "source_id", "source_name", "url", "title", "description", "indexed_at", "headings", "blocks", text.document_path("id").alias("path"))

    def write(batch) -> None:  # noqa: ANN001
        for r in batch:
            d = {k: r[k] for k in ("id", "source_id", "source_name", "url", "title")}
            if r["description"]:
                d["description"] = r["description"]
            d |= {"indexed_at": r["indexed_at"].strftime("%Y-%m-%dT%H:%M:%SZ") if r["indexed_at"] else None, "headings": [h.asDict() for h in r["headings"] or ()], "blocks": json.loads(r["blocks"] or "[]")}
            at = os.path.join(path, r["path"])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", encoding="utf-8") as f:
                json.dump(d, f, ensure_ascii=False, separators=(",", ":"))

    rows.foreachPartition(write)
    with open(os.path.join(path, "search-index.json"), "w", encoding="utf-8") as f:
        json.dump(index_json(index), f, ensure_ascii=False, separators=(",", ":"))
    full = {"format": FORMATS["manifest"], "version": FORMAT_VERSION, **manifest}
    full["sources"] = sorted(full.get("sources", []), key=lambda s: s.get("name", ""))
    with open(os.path.join(path, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(full, f, ensure_ascii=False, indent=2)


def index_json(index: Index) -> dict:
    """The search index as one object; for small corpora, as it is made on the driver."""
    s = index.stats.first()
    docs = dense_order(index.docs)
    postings = index.postings.join(docs.select("doc", "idx"), "doc")
    return {
        "format": FORMATS["index"], "version": FORMAT_VERSION, "tokenizer": {"version": 1, "max_token_length": 40, "stop_words": list(text.STOP_WORDS)},
        "weights": {"title": s["w_title"], "heading": s["w_heading"], "body": s["w_body"]}, "bm25": {"k1": s["k1"], "b": s["b"]}, "avg_doc_length": s["avg_doc_length"],
        "docs": [r.asDict() for r in docs.orderBy("idx").select(F.col("doc").alias("id"), "source_id", "title", "url", "length", "summary").collect()],
        "terms": {r["term"]: r["list"] for r in posting_lists(postings).orderBy("term").collect()},
    }


def read_json(path: str, kind: str) -> dict:
    """A manifest or search index, its format checked."""
    if not os.path.exists(path):
        raise CorpusError(f"{path} is missing: the corpus isn't complete")
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    if got.get("format") != FORMATS[kind] or got.get("version") != FORMAT_VERSION:
        raise CorpusError(f"{path}: format {got.get('format')!r} version {got.get('version')!r} can't be read")
    return got


def import_index(spark: SparkSession, path: str) -> Index:
    """The index tables of a JSON search index."""
    got = read_json(path, "index")
    docs = spark.createDataFrame([(k, d["id"], d["source_id"], d["title"], d["url"], d["length"], d.get("summary", "")) for k, d in enumerate(got["docs"])], "idx long, doc string, source_id string, title string, url string, length long, summary string")
    rows = [(docs_, t, tf) for t, flat in got["terms"].items() for docs_, tf in zip(flat[::2], flat[1::2])]
    postings = spark.createDataFrame(rows, "idx long, term string, tf long").join(docs.select("idx", "doc"), "idx").select("doc", "term", "tf")
    w = got["weights"]
    stats = spark.createDataFrame([(len(got["docs"]), float(got["avg_doc_length"]), float(got["bm25"]["k1"]), float(got["bm25"]["b"]), w["title"], w["heading"], w["body"])], "n long, avg_doc_length double, k1 double, b double, w_title int, w_heading int, w_body int")
    return Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), docs.drop("idx"), stats)


def read_json_documents(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """The documents of a JSON corpus, their blocks as JSON text, in order of id."""
    raw = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(os.path.join(path, "docs"))
    field = lambda n: F.get_json_object("value", f"$.{n}")
    docs = raw.select(*[field(n).alias(n) for n in ("id", "source_id", "source_name", "url", "title", "description")], F.to_timestamp(field("indexed_at")).alias("indexed_at"), F.from_json(field("headings"), "array<struct<level:int,text:string,anchor:string>>").alias("headings"), field("blocks").alias("blocks"))
    return (docs.filter(F.col("source_id").isin(sources)) if sources is not None else docs).orderBy("id")


def replace_dir(new: str, target: str) -> None:
    """Put a finished folder in the target's place; the old one comes back if that fails and goes if it doesn't."""
    backup = target + ".previous"
    shutil.rmtree(backup, ignore_errors=True)
    had = os.path.exists(target)
    if had:
        os.rename(target, backup)
    try:
        os.rename(new, target)
    except OSError:
        if had:
            os.rename(backup, target)
        raise
    shutil.rmtree(backup, ignore_errors=True)
