"""Pages that arrive as a stream: extraction in each micro-batch, and an index kept up to date per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import html, text
from docloom.operators.indexing import WEIGHTS, weighted_postings, with_fields


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of pages (url, source_id, html, arrived_at) as they appear in a folder."""
    return spark.readStream.schema("url string, source_id string, html string, arrived_at timestamp").parquet(path)


def extract_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the extracted documents of a page stream to Parquet; a page that arrives again within a day, with the same
    HTML and arrived_at, is written once."""
    content = html.extract(pages.withWatermark("arrived_at", "1 day").dropDuplicatesWithinWatermark(["url", "html", "arrived_at"]))
    return content.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(pages: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, source_id, pages) of a page stream by the time of arrival; pages later than ``late`` are left out."""
    counted = pages.withWatermark("arrived_at", late).groupBy(F.window("arrived_at", window), "source_id").agg(F.count(F.lit(1)).alias("pages"))
    return counted.select(F.col("window.start").alias("start"), "source_id", "pages")


def index_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of weighted term counts per document: each micro-batch adds a folder of its own, named by its number.

    A batch that is run again replaces its folder, so every page counts once; readers take the latest batch of an id.
    """

    def merge(batch: DataFrame, number: int) -> None:
        got = html.extract(batch.select("url", "html").dropDuplicates(["url"])).join(batch.select("url", "source_id").dropDuplicates(["url"]), "url")
        docs = with_fields(got.select(text.document_id("source_id", "url").alias("doc"), "source_id", "url", "title", "blocks"))
        terms = weighted_postings(docs, {"title": WEIGHTS["title"], "headings": WEIGHTS["heading"], "body": WEIGHTS["body"]})
        terms.join(docs.select("doc", "source_id", "url", "title"), "doc").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
