"""Readers of the engine's Parquet tables and the rules that make their rows clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, payload: list[str], key: str = "id") -> DataFrame:
    """One row per key: the payload of the row with the greatest indexed_at, then arrived_at.

    Null timestamps count as oldest; rows that tie completely are told apart by the payload's hash. The aggregation
    combines on the map side, so a key that holds a third of all rows is reduced before the shuffle. Rows whose key is
    null are dropped, as they name no document.
    """
    payload = [c for c in payload if c != key]
    order = F.struct("indexed_at", "arrived_at", F.xxhash64(*payload).alias("h")) if payload else F.struct("indexed_at", "arrived_at")
    body = F.struct(*dict.fromkeys([*payload, "indexed_at"]))
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(body, order).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in payload])
    )


def spelled(c: Column | str) -> Column:
    """A source name in its canonical spelling: lower case, runs of white space, ``_`` and ``-`` as one ``-``; blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s_\- ]+", " "))), " ", "-"), F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """df in at least half as many partitions as there are cores: a small table in one file would keep one core busy.

    A table that the scan already splits far enough is left as it is, so large inputs aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


#: Rows of a side up to which it is sent to all executors; beyond it a shuffle join is used.
SENT_ROWS = 2_000_000


def small(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """df marked to be broadcast if it has at most ``most`` rows, else df itself. Counts it."""
    return F.broadcast(df) if df.count() <= most else df


def valid_postings(postings: DataFrame, index_docs: DataFrame) -> DataFrame:
    """Postings with a term that is neither null nor empty and an idx of index_docs; repeated rows count once.

    Columns source_id, term, idx, tf.
    """
    docs = index_docs.select("idx").filter(F.col("idx").isNotNull()).distinct()
    rows = postings.select("source_id", "term", "idx", "tf").filter("term IS NOT NULL AND term <> '' AND idx IS NOT NULL")
    return rows.join(small(docs), "idx", "left_semi").select("source_id", "term", "idx", "tf").distinct()


def index_header(search_index: DataFrame) -> DataFrame:
    """One row of the tokenizer and BM25 settings in force, those of the highest tokenizer version: stop_words, k1, b.

    Without a segment: no stop words, k1 1.2, b 0.75.
    """
    t = F.col("tokenizer")
    return search_index.agg(
        F.max_by(F.struct(t["stop_words"].alias("sw"), F.col("bm25")["k1"].alias("k1"), F.col("bm25")["b"].alias("b")), F.struct(t["version"], F.col("segment_id"))).alias("h")
    ).select(
        F.coalesce("h.sw", F.array().cast("array<string>")).alias("stop_words"),
        F.coalesce("h.k1", F.lit(1.2)).alias("k1"),
        F.coalesce("h.b", F.lit(0.75)).alias("b"),
    )


def indexed(index_docs: DataFrame) -> DataFrame:
    """index_docs with repeated rows once, one row per idx."""
    cols = ["id", "source_id", "title", "url", "length", "summary"]
    return (
        index_docs.filter(F.col("idx").isNotNull())
        .groupBy("idx")
        .agg(F.max(F.struct(*cols)).alias("_r"))
        .select("idx", *[F.col(f"_r.{c}").alias(c) for c in cols])
    )


def bounded_sample(df: DataFrame, keys: list[str], most: int, n: int | None = None) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of their keys, whatever the number of rows and partitions.

    Rows are first thinned by their hash to about twice as many, so that no partition sends more than its share. n is
    the number of rows where it is known.
    """
    n = df.count() if n is None else n
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    kept = df.withColumn("_h", h)
    if n > 2 * most:
        kept = kept.filter(F.col("_h") < int((1 << 40) * 2 * most / n))
    return kept.orderBy("_h", *keys).limit(most).drop("_h")
