"""How distinctive a term is for a record (problem 4).

Each (document, term) gets the signed log-likelihood ratio of a two-by-two contingency table: the term's count in the
document against its count in the remaining collection. The ranking weight of the search formula stands beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.terms import valid_rows
from docloom.session import cut
from docloom.sources.tables import index_header, indexed, small

#: Terms up to which their statistics are sent to all executors; beyond it a shuffle join is used.
SENT_TERMS = 500_000


def log_likelihood(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """Signed G squared of a table: positive where the first cell is above its expectation, negative below."""
    a, b, c, d = (x.cast("double") for x in (k11, k12, k21, k22))
    n = a + b + c + d

    def part(k: Column, row: Column, column: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (row * column))).otherwise(F.lit(0.0))

    g = F.greatest(2 * (part(a, a + b, a + c) + part(b, a + b, b + d) + part(c, c + d, a + c) + part(d, c + d, b + d)), F.lit(0.0))
    return F.when(n > 0, F.when(a >= (a + b) * (a + c) / n, g).otherwise(-g)).otherwise(F.lit(0.0))


def distinctive_terms(postings: DataFrame, index_docs: DataFrame, search_index: DataFrame) -> DataFrame:
    """One row per valid (document, term): idx, id, term, tf, docs, total, length, llr, weight, stop.

    llr is the signed log-likelihood ratio against the remaining collection, weight the ranking formula's idf times
    saturation (no prefix factor, no title boost), stop whether the term is a stop word in force. A null length is the
    sum of the document's tf; the mean length and N are over all documents of index_docs. Repeated postings count once;
    null tf counts as 0. Documents without postings have no rows; empty tables give an empty result.
    """
    header = index_header(search_index).first()
    k1, b, stops = float(header["k1"]), float(header["b"]), list(header["stop_words"])
    valid = valid_rows(postings, index_docs)
    # one scan and one shuffle, by document: repeats are removed and counts summed once, the rest reads what is written
    rows = cut(valid.repartition("idx").distinct().groupBy("idx", "term").agg(F.sum(F.coalesce("tf", F.lit(0))).cast("long").alias("tf")))
    stats = cut(rows.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("total")))
    listed = indexed(index_docs).select("idx", "id", "length")
    own = rows.groupBy("idx").agg(F.sum("tf").alias("s"))
    docs = cut(listed.join(own, "idx", "left").select("idx", "id", F.coalesce("s", F.lit(0).cast("long")).alias("s"), F.coalesce(F.col("length").cast("long"), "s", F.lit(0).cast("long")).alias("length")))
    whole = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).first()
    every = F.lit(int(stats.agg(F.sum("total").alias("t")).first()["t"] or 0))
    n, avg = F.lit(int(whole["n"])), F.lit(float(whole["avg"] or 0) or 1.0)
    joined = rows.join(small(docs), "idx").join(small(stats, SENT_TERMS), "term")
    tf, df, length = F.col("tf"), F.col("docs"), F.col("length")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    weight = idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / avg))
    llr = log_likelihood(tf, F.col("total") - tf, F.col("s") - tf, every - F.col("total") - F.col("s") + tf)
    return joined.select("idx", "id", "term", "tf", "docs", "total", "length", llr.alias("llr"), F.coalesce(weight, F.lit(0.0)).alias("weight"), F.col("term").isin(stops).alias("stop"))


def top_term(scored: DataFrame, by: str = "weight") -> DataFrame:
    """(id, term): each document's term with the highest score; terms in one document only and stop words take no part.

    Ties go to the smaller term.
    """
    part = scored.filter("NOT stop AND docs >= 2 AND id IS NOT NULL")
    return part.groupBy("idx", "id").agg(F.min(F.struct((-F.col(by)).alias("s"), "term")).alias("m")).select("id", F.col("m.term").alias("term"))
