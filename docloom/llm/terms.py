"""Frequency of every distinct term or run of terms (problem 3), by suffix-sorted counting.

Each record's term sequence is cut into suffixes of at most ``sigma`` terms, which are routed by their first term (and a
salt made from the record, so that one term may hold any share of the rows), sorted in reverse lexicographic order, and
counted with a stack: when a suffix is left behind, the counts and the record set of its prefix pass to the shorter one.
The salts' partial counts are then added; a record lies in one salt only, so numbers of records add up too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.tables import index_header, indexed

#: A term in fewer documents is rare; one in more than this share of all documents is common.
RARE, COMMON = 3, 0.25
#: Rows of index_docs up to which the valid idx are sent to all executors; beyond it a shuffle join is used.
SENT_DOCS = 2_000_000


def _codes(suffix: pa.ListArray, sigma: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, lengths, terms): a number for each term of each suffix, -1 behind its end, equal for equal terms of the batch."""
    sizes = pc.list_value_length(suffix).to_numpy(zero_copy_only=False).astype(np.int64)
    known = suffix.flatten().dictionary_encode()
    codes = np.full((len(sizes), sigma), -1, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    codes[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = known.indices.to_numpy(zero_copy_only=False)
    return codes, sizes, known.dictionary


def _stack(batches: Iterator[pa.RecordBatch], sigma: int) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of suffixes that come sorted, by a stack of the prefixes that are still open.

    Columns suffix, rec, w, tag; rows equal in all of them stand together and count once. A prefix is left behind when its
    next row begins otherwise; then its count and the number of its records are known. Within a batch all prefixes of one
    depth are counted at a time; what is open at its end stays on the stack: (path, weight, distinct records) at each depth.
    """
    stack: list[tuple[list[str], int, np.ndarray]] = []
    last: tuple | None = None
    for rb in batches:
        if not rb.num_rows:
            continue
        codes, sizes, terms = _codes(rb.column("suffix"), sigma)
        rec = rb.column("rec").to_numpy(zero_copy_only=False)
        w = np.nan_to_num(rb.column("w").cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int64)
        tag = pc.fill_null(rb.column("tag").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        moved = np.r_[True, (codes[1:] != codes[:-1]).any(1)]
        fresh = moved | np.r_[True, (rec[1:] != rec[:-1]) | (w[1:] != w[:-1]) | (tag[1:] != tag[:-1])]
        path = lambda k, depth: [terms[c].as_py() for c in codes[k, :depth].tolist()]
        row = lambda k: (path(k, int(sizes[k])), int(rec[k]), int(w[k]), rb.column("tag")[k].as_py())
        fresh[0] = last != row(0)
        last = row(len(rec) - 1)
        before, stack, out = stack, [], []
        for depth in range(1, sigma + 1):
            old = before[depth - 1] if depth <= len(before) else None
            rows = np.flatnonzero(sizes >= depth)
            begins = np.r_[True, (codes[rows[1:], :depth] != codes[rows[:-1], :depth]).any(1) | (rows[1:] != rows[:-1] + 1)] if len(rows) else np.empty(0, bool)
            run = np.cumsum(begins) - 1
            start = rows[begins]
            total = np.bincount(run, w[rows] * fresh[rows], len(start)).astype(np.int64)
            order = np.lexsort((rec[rows], run))
            one = np.r_[True, (np.diff(run[order]) != 0) | (np.diff(rec[rows][order]) != 0)] if len(rows) else np.empty(0, bool)
            docs = np.bincount(run[order][one], minlength=len(start))
            records = rec[rows][order][one]
            at = np.r_[0, np.cumsum(docs)]
            goes_on = old is not None and len(rows) and rows[0] == 0 and path(0, depth) == old[0]
            if old is not None and not goes_on:
                out.append(([old[0]], [old[1]], [len(old[2])]))
            first_records = np.union1d(old[2], records[: at[1]]) if goes_on else None
            if goes_on:
                total[0] += old[1]
                docs[0] = len(first_records)
            stays = len(rows) and rows[-1] == len(rec) - 1  # the last prefix of this depth is still open
            shut = len(start) - int(bool(stays))
            if shut > 0:
                out.append(([path(k, depth) for k in start[:shut].tolist()] if depth > 1 else pc.list_slice(rb.column("suffix").take(pa.array(start[:shut])), 0, 1), total[:shut].tolist(), docs[:shut].tolist()))
            if stays:
                mine = first_records if goes_on and len(start) == 1 else records[at[len(start) - 1] :]
                stack.append((path(len(rec) - 1, depth), int(total[-1]), mine))
        yield from _emit(out)
    yield from _emit([([p], [n], [len(r)]) for p, n, r in stack])


def _emit(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    for paths, n, docs in out:
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.list_(pa.string())) if isinstance(paths, list) else paths.cast(pa.list_(pa.string())), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["ngram", "total", "docs"])


def suffix_counts(suffixes: DataFrame, sigma: int) -> DataFrame:
    """(ngram, total, docs) of all prefixes of the suffixes: columns suffix (array of at most sigma terms), rec, w, tag.

    Suffixes are routed by their first term and a salt made from the record, so that one term may hold any share of the
    rows, and sorted in reverse lexicographic order; the salts' partial counts are added. A record lies in one salt only, so
    numbers of records add up too; salts of one term that meet in a partition are read as one run, which is right as their
    records differ. A task holds the records of its open prefixes only, 8 bytes each.
    """
    spread = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = suffixes.select("suffix", "rec", "w", "tag").repartition(F.col("suffix")[0], F.pmod(F.xxhash64("rec"), F.lit(spread))).sortWithinPartitions(F.desc("suffix"), "rec", "w", "tag")
    counted = routed.mapInArrow(lambda it: _stack(it, sigma), "ngram array<string>, total long, docs long")
    return counted.groupBy("ngram").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs"))


def term_counts(rows: DataFrame, term: str | Column, record: str | Column, weight: str | Column, tag: str | Column) -> DataFrame:
    """(term, docs, total): records and summed weight of every term; rows equal in all four columns count once.

    Each row is a suffix of one term. Null terms and null records are dropped; a null weight adds nothing. The sort brings
    equal rows together, so removing repeats needs no shuffle.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    r = rows.filter(col(term).isNotNull() & col(record).isNotNull())
    r = r.select(F.array(col(term)).alias("suffix"), col(record).cast("long").alias("rec"), col(weight).cast("long").alias("w"), col(tag).cast("string").alias("tag"))
    return suffix_counts(r, 1).select(F.col("ngram")[0].alias("term"), "docs", "total")


def ngram_counts(rows: DataFrame, record: str, tokens: str, sigma: int = 3, min_docs: int = 1) -> DataFrame:
    """(ngram, occurrences, docs) of every run of up to sigma terms in the array column ``tokens``.

    record must be a bigint. Null arrays and empty arrays have no runs; null elements end a run (the array is read
    without them); a record that occurs in several rows is one record. Very long arrays are cut into suffixes of sigma
    terms only, so no row grows with the square of its length.
    """
    clean = F.filter(F.col(tokens), lambda t: t.isNotNull())
    r = rows.select(F.col(record).cast("long").alias("rec"), F.monotonically_increasing_id().cast("string").alias("row"), clean.alias("t")).filter("rec IS NOT NULL AND size(t) > 0")
    r = r.select("rec", "row", "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("p"))
    suffixes = r.select(F.slice("t", F.col("p"), F.lit(sigma)).alias("suffix"), "rec", F.lit(1).cast("long").alias("w"), F.concat_ws(" ", "row", "p").alias("tag"))
    return suffix_counts(suffixes, sigma).withColumnRenamed("total", "occurrences").filter(F.col("docs") >= min_docs)


def valid_rows(postings: DataFrame, index_docs: DataFrame) -> DataFrame:
    """Postings whose term is neither null nor empty and whose idx is found in index_docs; repeats are still there."""
    known = index_docs.select("idx").filter("idx IS NOT NULL").distinct()
    known = F.broadcast(known) if index_docs.count() <= SENT_DOCS else known
    return postings.select("source_id", "term", "idx", "tf").filter("term IS NOT NULL AND term <> '' AND idx IS NOT NULL").join(known, "idx", "left_semi")


def term_marks(postings: DataFrame, index_docs: DataFrame, search_index: DataFrame, rare: int = RARE, common: float = COMMON) -> DataFrame:
    """(term, docs, total, mark) of every term of the valid postings.

    docs is the number of documents, total the weighted count; mark is ``rare`` (in fewer than ``rare`` documents),
    ``common`` (in more than the share ``common`` of all documents of index_docs), ``stop`` (a stop word in force) or
    null. Empty tables give an empty result.
    """
    n = indexed(index_docs).count()
    stops = index_header(search_index).first()["stop_words"]
    counts = term_counts(valid_rows(postings, index_docs), "term", "idx", "tf", "source_id")
    mark = F.when(F.col("term").isin(list(stops)), "stop").when(F.col("docs") < rare, "rare").when(F.col("docs") > F.lit(common * n), "common")
    return counts.select("term", "docs", "total", mark.alias("mark"))
