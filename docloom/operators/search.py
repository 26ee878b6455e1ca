"""Ranked keyword search over the index tables: lookup and prefix joins, BM25, coordination and title boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.functions import text
from docloom.operators.indexing import Index, bm25

#: Dictionary terms a query term may expand to, the factor of such a term, and the least length of a term that expands.
EXPANSION, PREFIX_FACTOR, MIN_PREFIX = 30, 0.5, 2


def terms_of(spark, query: str) -> list[str]:  # noqa: ANN001
    """The query's terms; one row."""
    return list(spark.range(1).select(text.query_terms(F.lit(query)).alias("t")).first()["t"])


def reach(wanted: list[str]):  # noqa: ANN201
    """Which terms the query's terms can expand to, as a filter on ``term`` that reaches the scan."""
    out = None
    for q in wanted:
        c = F.col("term").startswith(q) if len(q) >= MIN_PREFIX else F.col("term") == q
        out = c if out is None else out | c
    return out


def candidates(terms: DataFrame, wanted: list[str], expansion: int = EXPANSION) -> DataFrame:
    """(qt, term, df, factor): dictionary terms of each query term, itself at 1.0 and the most frequent longer ones at 0.5.

    The query's terms are literals, so each prefix is a filter that reaches a dictionary stored in order of its terms.
    """
    own = [F.when(F.col("term").startswith(q) if len(q) >= MIN_PREFIX else F.col("term") == q, F.lit(q)) for q in wanted]
    hits = terms.filter(reach(wanted)).select("term", "df", F.explode(F.array_compact(F.array(*own))).alias("qt"))
    rank = F.row_number().over(W.partitionBy("qt").orderBy(F.desc("df"), "term"))
    longer = hits.filter("term <> qt").withColumn("r", rank).filter(F.col("r") <= expansion)
    return hits.filter("term = qt").select("qt", "term", "df", F.lit(1.0).alias("factor")).unionByName(longer.select("qt", "term", "df", F.lit(PREFIX_FACTOR).alias("factor")))


def search(index: Index, query: str, sources: list[str] | None = None, limit: int = 0, key: str = "doc") -> DataFrame:
    """(key, score, matched) and the documents' columns, best first: score descending, then key.

    Each document counts its best candidate for a query term; the sum over terms is multiplied by (matched / terms)
    squared, by 2 where the title equals the phrase, or by 1.5 where a title contains a phrase of several terms. Sources
    filter the result only: statistics stay those of the whole index. A blank query, or an empty index, gives no rows;
    limit 0 or less means all. Null titles get no boost. Candidates are few and their size is bounded (EXPANSION + 1 a
    query term), so they are broadcast to the postings.
    """
    spark = index.postings.sparkSession
    wanted = terms_of(spark, query)
    docs = index.docs
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched"), *[c for c in docs.columns if c != key]).filter(F.lit(False))
    stats = index.stats.first()
    n, avg = F.lit(int(stats["n"])), F.lit(float(stats["avg_doc_length"]))
    hits = index.postings.filter(reach(wanted)).join(F.broadcast(candidates(index.terms, wanted)), "term").join(docs.select(key, "length"), key)
    score = bm25(F.col("tf"), F.col("df"), n, F.col("length"), avg, F.col("factor"), float(stats["k1"]), float(stats["b"]))
    best = hits.groupBy(key, "qt").agg(F.max(score).alias("s"))
    total = best.groupBy(key).agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("matched"))
    said = text.phrase(F.lit(query))
    title = F.lower(F.col("title"))
    boost = F.when(title == said, 2.0).when(F.lit(len(wanted) > 1) & title.contains(said), 1.5).otherwise(1.0)
    ranked = total.join(docs, key).withColumn("score", F.col("s") * F.pow(F.col("matched") / F.lit(len(wanted)), F.lit(2)) * boost)
    if sources:
        ranked = ranked.filter(F.col("source_id").isin(sources))
    ranked = ranked.select(key, "score", "matched", *[c for c in docs.columns if c != key]).orderBy(F.desc("score"), key)
    return ranked.limit(limit) if limit > 0 else ranked


def known_sources(wanted: DataFrame, sources: DataFrame, column: str = "source_id") -> DataFrame:
    """The wanted sources that exist: a route may name others."""
    return wanted.join(sources.select(column).distinct(), column, "left_semi")


def result_lines(results: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(rank, line) of ranked results as text: number, title, source, score and URL. For the few rows of a result page."""
    order = W.orderBy(F.desc("score"), results.columns[0])
    return results.select(F.row_number().over(order).alias("rank"), "title", "source_id", "score", "url").select(
        "rank", F.format_string("%2d. %s [%s] score %.2f\n    %s", "rank", "title", "source_id", "score", "url").alias("line")
    )


def facets(results: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, hits) of every source, 0 where nothing was found. Without a query, results are all documents."""
    counted = results.groupBy("source_id").agg(F.count(F.lit(1)).alias("hits"))
    return sources.select("source_id").distinct().join(counted, "source_id", "left").na.fill(0, ["hits"])


def browse(docs: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Documents of the chosen sources (all if none) in index order."""
    chosen = docs.filter(F.col("source_id").isin(sources)) if sources else docs
    return chosen.orderBy("source_id", "title", "url")


def page(results: DataFrame, number: int, size: int = 20) -> DataFrame:
    """The first number * size rows of an ordered result."""
    return results.limit(number * size)
