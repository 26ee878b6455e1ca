"""Evaluation texts inside a training corpus (problem 8).

Item-sized windows of words are embedded by the CGK random walk, which turns a small edit distance into a small Hamming
distance; bands of sampled coordinates of the embedding, repeated over several walks, are the keys of an LSH join. What
shares a key is verified by its exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.vectext import chunks, mix, word_hashes

#: Words of a window: the shortest passage that counts.
WINDOW = 13
#: Independent walks, sampled bands of each walk, and coordinates of a band.
WALKS, BANDS, COORDINATES = 4, 5, 7
#: Bits of the filter that corpus windows pass before they are shuffled: its size doesn't depend on the input.
FILTER_BITS = 1 << 24
#: Rows of item windows up to which they are sent to all executors; beyond it a shuffle join is used.
SENT_WINDOWS = 2_000_000
SEED = 20_240_229


def bands(window: int, walks: int, per_walk: int, coordinates: int, seed: int = SEED) -> list[list[np.ndarray]]:
    """For each walk, the sampled coordinates of its bands: from the first 2 * window steps, where the walk still reads words."""
    rng = np.random.default_rng(seed)
    return [[np.sort(rng.choice(2 * window, coordinates, replace=False)) for _ in range(per_walk)] for _ in range(walks)]


def band_keys(h: np.ndarray, start: np.ndarray, window: int, plan: list[list[np.ndarray]], end: np.ndarray | None = None) -> np.ndarray:
    """Keys (windows x bands) of the windows that begin at ``start`` in the word hashes ``h``, and stop before ``end``."""
    keys = []
    for walk, samples in enumerate(plan):
        steps = mix(h ^ np.uint64(SEED + 7919 * walk))  # bit j of a word says whether step j moves on
        padded, pad = np.r_[h, np.zeros(1, np.uint64)], len(h)
        moves = np.r_[steps, np.zeros(1, np.uint64)]
        at = start.astype(np.int64).copy()
        stop = at + window if end is None else np.minimum(at + window, end)
        acc = [np.full(len(start), np.uint64(1 + k + 100 * walk)) for k in range(len(samples))]
        for step in range(int(max(s[-1] for s in samples)) + 1):
            here = np.where(at < stop, at, pad)
            for k, s in enumerate(samples):
                if step in s:
                    acc[k] = mix(acc[k] * np.uint64(0x9E3779B97F4A7C15) + padded[here])
            at += ((moves[here] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
        keys += acc
    return np.stack(keys, 1) if keys else np.empty((len(start), 0), np.uint64)


def _windows(batches: Iterator[pa.RecordBatch], window: int, plan: list, held: np.ndarray | None, spare: int = 0) -> Iterator[pa.RecordBatch]:
    """(doc, key, win): a row for each window and distinct band key, with held only keys whose bit is set.

    ``spare`` words of a text are read beyond a window, and windows at its end may lack as many; 0 stands for those.
    """
    for rb in batches:
        ids, texts = rb.column("doc").to_pylist(), [t or "" for t in rb.column("text").to_pylist()]
        for part in chunks([len(t) for t in texts]):
            h, owner = word_hashes(texts[part])
            least = max(1, window - spare)
            n = len(h) - least + 1
            start = np.flatnonzero(owner[: max(n, 0)] == owner[least - 1 :]) if n > 0 else np.empty(0, np.int64)
            end = np.searchsorted(owner, owner[start], "right")
            keys = band_keys(h, start, window, plan, end)
            if held is None:
                row, col = np.divmod(np.arange(keys.size), max(keys.shape[1], 1))
            else:
                bit = keys & np.uint64(FILTER_BITS - 1)
                row, col = np.nonzero((held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
            at = start[row]
            place = at[:, None] + np.arange(window + spare)
            wins = np.where(place < end[row][:, None], h[np.minimum(place, len(h) - 1)], np.uint64(0)) if len(h) else np.empty((0, window + spare), np.uint64)
            raw, size = np.ascontiguousarray(wins).tobytes(), 8 * (window + spare)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[part.start + o] for o in owner[at].tolist()], pa.int64()), pa.array(keys[row, col].view(np.int64)), pa.array([raw[k * size : (k + 1) * size] for k in range(len(at))], pa.binary())],
                ["doc", "key", "win"],
            )


def edit_distances(x: np.ndarray, y: np.ndarray, least: int | None = None) -> np.ndarray:
    """Levenshtein distance in words of each row of x to the same row of y (both rows x words).

    With ``least``, the smallest one to the first ``least`` words of the row of y or to more of them.
    """
    n, m = x.shape[1], y.shape[1]
    row = np.broadcast_to(np.arange(m + 1), (len(x), m + 1)).copy()
    for i in range(1, n + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, m + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (x[:, i - 1] != y[:, j - 1]))
        row = new
    return row[:, m if least is None else least :].min(1)


def _verified(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        x, y = (np.frombuffer(b"".join(rb.column(c).to_pylist()), np.uint64).reshape(-1, n) for c, n in (("win", window + most), ("iwin", window)))
        d = np.where((x[:, :window] == y).all(1), 0, most + 1)
        rest = np.flatnonzero(d) if most else np.empty(0, np.int64)
        for at in range(0, len(rest), 20_000):
            z = rest[at : at + 20_000]
            z = z[(~(y[z][:, :, None] == x[z][:, None, :]).any(2)).sum(1) <= most]  # each word without its like costs an edit
            d[z] = edit_distances(y[z], x[z], max(0, window - most))
        ok = d <= most
        yield pa.RecordBatch.from_arrays([rb.column("doc"), rb.column("item"), pa.array(d, pa.int32())], ["doc", "item", "edits"]).filter(pa.array(ok))


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW, max_edits: int = 1, walks: int = WALKS, per_walk: int = BANDS, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, item_id, edits): documents with a window of an item within max_edits word edits; edits is the least.

    Windows with the same words always share a key, so a passage of ``window`` equal words (case, punctuation and spacing
    aside) is never missed. One with an edit, a word replaced, inserted or left out, is compared at max_edits words fewer to
    as many more, and found with the bands' recall. Null, empty and short texts have no window;
    null ids are dropped; texts repeated under other ids are each reported.

    Only keys leave the items' side: a bit filter of fixed size is sent to the corpus scan, so corpus windows without a
    partner are dropped where they are read and only the rest is shuffled.
    """
    plan = bands(window, walks, per_walk, coordinates)
    schema = "doc long, key long, win binary"
    known = items.select(F.col(item_id).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    known = known.mapInArrow(lambda it: _windows(it, window, plan, None), schema).select(F.col("doc").alias("item"), "key", F.col("win").alias("iwin")).distinct()
    spark = docs.sparkSession
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    got = known.groupBy(F.shiftright(bit, 15).alias("n")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("m"), F.count(F.lit(1)).alias("c")).collect()  # at most FILTER_BITS / 8 bytes
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in got:
        held[r["n"] * 4096 : (r["n"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)
    shared = spark.sparkContext.broadcast(held)
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    near = corpus.mapInArrow(lambda it: _windows(it, window, plan, shared.value, max_edits), schema)
    side = F.broadcast(known) if sum(r["c"] for r in got) <= SENT_WINDOWS else known
    hits = near.join(side, "key").select("doc", "item", "win", "iwin")
    found = hits.mapInArrow(lambda it: _verified(it, window, max_edits), "doc long, item long, edits int")
    return found.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.min("edits").alias("edits"))
