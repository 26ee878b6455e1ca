"""Mixing sources to target weights by entropy balancing (problem 9).

Every text gets a rate that is exponentially tilted by its size in tokens; Newton iterations on the convex dual choose each
source's tilt so that its expected tokens meet its share, the rates staying within the source's cap. The rates are then
rounded into whole copies so that the rounding errors in tokens cancel.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import clustered, cut
from docloom.sources.tables import spelled

#: Ranks of a public byte-level BPE vocabulary; a parameter of every function that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pattern of pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts rounded together in one task; a larger source is split into several such lots.
LOT = 4096
#: Newton iterations at most, and the relative error in tokens at which they end.
ROUNDS, TOLERANCE = 100, 1e-7
#: Characters from which a text is given to the tokenizer in slices.
SLICE = 1 << 20


def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices of at least ``size`` characters, cut where no pre-token can reach across: before a single space
    between two other characters."""
    at = 0
    while m := _SINGLE.search(text, at + size):
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


_SINGLE = re.compile(r"\S(?= \S)")


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = None
    for rb in batches:
        enc = enc or encoder(path)
        n = [sum(len(enc.encode_ordinary(p)) for p in slices(t)) for t in rb.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("source"), rb.column("key"), pa.array(n, pa.int64())], ["doc_id", "source", "key", "tokens"])


def _targets(targets: DataFrame) -> DataFrame:
    """(source, share, cap): positive weights as shares of 1, a missing cap as 1; spellings of a source are added up."""
    t = targets.select(spelled("source").alias("source"), "weight", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap")).filter("source IS NOT NULL AND weight > 0 AND cap > 0")
    return t.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("cap").alias("cap"))


def texts_with_tokens(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, weight, cap): one row per distinct text of a source that has a weight.

    A text that stands under several ids is one text; it belongs to the smallest of these ids whose source has a weight.
    Null, empty and blank texts, texts of sources without a weight and texts without tokens are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spelled("source").alias("source"), "text").filter("doc_id IS NOT NULL AND source IS NOT NULL AND trim(text) <> ''")
    counted = rows.withColumn("key", F.unhex(F.md5("text"))).mapInArrow(lambda it: _tokens(it, vocabulary), "doc_id long, source string, key binary, tokens long")
    named = counted.join(_targets(targets), "source").filter("tokens > 0")
    return named.groupBy("key").agg(F.min(F.struct("doc_id", "source", "tokens", "weight", "cap")).alias("r")).select("r.*")


def _solve(sizes: DataFrame, stats: dict[str, dict], total: float) -> dict[str, tuple[float, float]]:
    """(tilt, scale) by source: Newton on the dual over (source, tokens, n), guarded by bisection where the cap bends it."""
    goal = {s: min(total * x["share"], x["cap"] * x["tokens"]) for s, x in stats.items()}
    tilt = {s: math.log(max(goal[s], 1e-300) / x["tokens"]) for s, x in stats.items()}
    full = {s for s, x in stats.items() if goal[s] >= x["cap"] * x["tokens"] * (1 - 1e-12)}  # every text to the cap: no tilt is too high
    tilt |= dict.fromkeys(full, 1e9)
    low, high = dict.fromkeys(stats, -1e3), dict.fromkeys(stats, 1e3)
    session = sizes.sparkSession
    for _ in range(ROUNDS):
        now = session.createDataFrame([(s, float(tilt[s]), float(x["mean"]), float(x["cap"])) for s, x in stats.items()], "source string, tilt double, mean double, most double")
        x = F.col("tokens") / F.col("mean")
        raw = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        rate = F.least(raw, F.col("most"))
        got = sizes.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(F.col("n") * F.col("tokens") * rate).alias("f"), F.sum(F.when(raw < F.col("most"), F.col("n") * F.col("tokens") * raw * x).otherwise(0.0)).alias("d")).collect()  # a row a source
        worst = 0.0
        for r in got:
            s, error = r["source"], r["f"] - goal[r["source"]]
            if s in full:
                continue
            worst = max(worst, abs(error) / max(goal[s], 1.0))
            if abs(error) <= TOLERANCE * max(goal[s], 1.0):
                continue
            (high if error > 0 else low)[s] = tilt[s]
            step = tilt[s] - error / r["d"] if r["d"] > 0 else math.inf
            tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2 if high[s] < 1e3 and low[s] > -1e3 else tilt[s] - math.copysign(1.0, error)
        if worst < TOLERANCE:
            break
    else:
        raise RuntimeError(f"a source's tokens are still off by {worst:.1e} after {ROUNDS} iterations")
    return {s: (tilt[s], x["mean"]) for s, x in stats.items()}


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole copies of each text; within a lot, large texts first, what one text's rounding leaves is passed to the next."""

    def lot(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (-r[2], r[0]))
        left, out = 0.0, []
        for doc, source, tokens, rate in rows:
            least = math.floor(rate)
            left += rate * tokens
            copies = min(max(math.floor(left / tokens + 0.5), least), math.ceil(rate - 1e-9))
            left -= copies * tokens
            out.append((doc, source, tokens, rate, copies))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "source", "tokens", "rate", "copies"])

    now, rows = None, []
    for rb in batches:
        for source, part, *r in zip(*(rb.column(c).to_pylist() for c in ("source", "lot", "doc_id", "tokens", "rate"))):
            if (source, part) != now:
                if rows:
                    yield lot(rows)
                now, rows = (source, part), []
            rows.append((r[0], source, r[1], r[2]))
    if rows:
        yield lot(rows)


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, rate, copies): how often each text is used, copies from 0 to its source's cap.

    Without total_tokens the mixture has the greatest size at which every source with texts can meet its share within its
    cap; with it, sources that can't are used to their cap. Shares are of the sources that have both a weight and texts.
    An empty corpus or empty targets give an empty result. Only per-source totals reach the driver (a row for each source
    of ``targets``); rounding works on lots of LOT texts, so a source with any share of the texts is spread.
    """
    texts = cut(texts_with_tokens(docs, targets, vocabulary))
    sizes = cut(texts.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"), F.first("cap").alias("cap")))
    rows = sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("tokens")).alias("tokens"), F.first("weight").alias("weight"), F.first("cap").alias("cap")).collect()
    whole = sum(r["weight"] for r in rows)
    stats = {r["source"]: {"share": r["weight"] / whole, "cap": r["cap"], "tokens": r["tokens"], "mean": r["tokens"] / r["n"], "n": r["n"]} for r in rows}
    schema = "source string, tilt double, mean double, lots int"
    if stats:
        total = total_tokens or min(x["cap"] * x["tokens"] / x["share"] for x in stats.values())
        solved = [(s, float(tilt), float(mean), -(-stats[s]["n"] // LOT)) for s, (tilt, mean) in _solve(sizes, stats, total).items()]
    else:
        solved = []
    known = docs.sparkSession.createDataFrame(solved, schema)
    rate = F.least(F.exp(F.least(F.col("tilt") * F.col("tokens") / F.col("mean"), F.lit(700.0))), F.col("cap").cast("double"))
    rated = texts.join(F.broadcast(known), "source").select("source", F.pmod(F.xxhash64("doc_id"), F.col("lots")).alias("lot"), "doc_id", "tokens", rate.alias("rate"))
    return clustered(rated, "source", "lot").mapInArrow(_round, "doc_id long, source string, tokens long, rate double, copies long")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, texts, most_copies) of a mixture; listed sources without texts have 0.

    target_share is the weight's share among all listed sources; reached_share that of the mixture's tokens.
    """
    t = _targets(targets)
    used = mixed.filter("copies > 0").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    rows = t.join(used, "source", "left").na.fill(0, ["tokens", "texts", "most_copies"])
    sums = rows.agg(F.sum("weight").alias("w"), F.sum("tokens").alias("t")).first()
    w, n = float(sums["w"] or 0) or 1.0, float(sums["t"] or 0) or 1.0
    return rows.select("source", (F.col("weight") / w).alias("target_share"), (F.col("tokens") / n).alias("reached_share"), "tokens", "texts", "most_copies")
