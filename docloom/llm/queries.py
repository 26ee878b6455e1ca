"""Queries of the training-data operators, by name: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.llm import abuse, boilerplate, distinctive, leaks, lines, mixing, neardup, residue, terms
from docloom.sources.tables import indexed, spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found_pairs(neardup.near_duplicates(spread(table(spark, sf_dir, "crawl_docs"))))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spread(table(spark, sf_dir, "crawl_docs")))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, n) for n in ("postings", "index_docs", "search_index"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(spread(table(spark, sf_dir, "crawl_docs")), table(spark, sf_dir, "index_docs"))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_scores(spread(table(spark, sf_dir, "crawl_docs")), table(spark, sf_dir, "index_docs")).withColumn("score", F.round("score", 4))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_marks(*_index(spark, sf_dir)).filter("mark IN ('rare', 'common')").select("term", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_marks(*_index(spark, sf_dir))


def p3_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to three words in the summaries of the index, in at least RARE documents."""
    docs = indexed(table(spark, sf_dir, "index_docs")).select("idx", tokens(F.coalesce("summary", F.lit(""))).alias("t"))
    return terms.ngram_counts(docs, "idx", "t", 3, terms.RARE).select(F.array_join("ngram", " ").alias("ngram"), "occurrences", "docs")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.top_term(distinctive.distinctive_terms(*_index(spark, sf_dir)))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.distinctive_terms(*_index(spark, sf_dir)).withColumns({c: F.round(c, 4) + 0.0 for c in ("llr", "weight")})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(spread(table(spark, sf_dir, "crawl_docs"))).select("id", "ord")


def p6_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.strip_lines(spread(table(spark, sf_dir, "crawl_docs")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.boilerplate_ords(spread(table(spark, sf_dir, "crawl_docs")))


def p7_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_content(spread(table(spark, sf_dir, "crawl_docs")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaked(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))
    return found.filter("edits = 0").select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaked(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count_if(F.col("edits") == 0).alias("exact_docs"), F.count(F.lit(1)).alias("docs"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")).withColumn("rate", F.round("rate", 4))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    reached = mixing.shares(mixing.mixture(spread(table(spark, sf_dir, "documents")), targets), targets)
    return reached.withColumns({c: F.round(c, 4) for c in ("target_share", "reached_share")})


def p9_shares_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mixture as large as the corpus, where small sources are used to their cap."""
    docs, targets = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")
    size = mixing.texts_with_tokens(docs, targets).agg(F.sum("tokens").alias("t")).first()["t"]
    reached = mixing.shares(mixing.mixture(docs, targets, total_tokens=float(size or 0)), targets)
    return reached.withColumns({c: F.round(c, 4) for c in ("target_share", "reached_share")})


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abusive(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "review_labels"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_rates(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "review_labels")).withColumn("rate", F.round("rate", 6))


def queries() -> dict[str, Query]:
    own = (p1_found, p1_groups, p2_found, p2_scores, p3_found, p3_terms, p3_ngrams, p4_found, p4_scores, p6_found, p6_stripped, p7_found, p7_content, p8_found, p8_items, p9_mixture, p9_shares, p9_shares_whole, p10_found, p10_rates)
    return {f.__name__: f for f in own}
