"""Template residue, filler text, error messages and script notices in place of content (problem 2).

A regularized linear classifier on hashed n-grams of words and of their shapes, on length, title and template signs judges
each unit of a page (its title, each text that isn't code, its summary). It is trained from weak labels: response status
in short pages, phrases, and sentences that stand in many short pages but hardly in others. Hosts held out from training
measure it (``validate``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.blocks import parse_blocks, spans_text, walk
from docloom.llm.boilerplate import STOP_WORDS
from docloom.llm.vectext import END, PUNCTUATION, chunks, mix, runs
from docloom.session import cut
from docloom.sources.tables import bounded_sample, latest

#: Pages that the classifier is fitted on, at most: short ones, ones with signs of a template, and any. Units of either class, at most.
SHORT_PAGES, MARKED_PAGES, ANY_PAGES, SAMPLE_UNITS = 1500, 1500, 1500, 30_000
#: Hashed features, strength of the regularization, steps of the fit, and the probability from which a unit is residue.
FEATURES, L2, STEPS, CUT = 1 << 18, 1e-7, 150, 0.5
#: Weight of all positives against 1 for all units, and the step size.
POSITIVES, RATE = 0.4, 0.15
#: A page with fewer words than this can be a message in place of content.
SHORT_PAGE = 60
#: A sentence is a message if it stands in this share of the short pages, in so many of them, and in REPEATED_LIFT times the share that other pages have.
REPEATED_SHARE, REPEATED_LEAST, REPEATED_LIFT = 0.01, 5, 10
#: Words of a message, and share of a unit's pairs of words that ordinary pages have too from which it is ordinary.
MESSAGE, ORDINARY = 14, 0.5

_FIELD = r"[A-Za-z][\w.]*(?: [\w.]+){0,3}"
#: A field between a run of opening signs and one of closing signs, two of them at least in the form that the scan applies.
_BETWEEN = re.compile(rf"(?<![\w/])([{{<\[$#%@«!=]{{1,4}}(?:--)?|__) ?({_FIELD}) ?((?:--)?[}}>\]$#%@»!=]{{1,4}}|__)(?!\w)")
_SIGNS = rf"[{{<\[$#%@«!=]{{2,4}} ?{_FIELD} ?[}}>\]$#%@»!=]{{1,4}}|__{_FIELD}__|«{_FIELD}»|%{_FIELD}%|\[object"
_OPENING = re.compile(r"[{<\[$#%@«!=]|__")
_MARKED = re.compile(_SIGNS)
_DIGITS = re.compile(r"\d+")
_MIRROR = str.maketrans("<>[]{}«»", "><][}{»«")
# What programs print for a value that isn't there.
_NOTHING = re.compile(r"\[object Object\]|(?:undefined|null|NaN) (?:undefined|null|NaN)")
# How filler text begins.
_FILLER = re.compile(r"^\W*(?:lorem ipsum|(?:todo|tbd|fixme|xxx)\b\W|\w+ goes here|coming soon)", re.IGNORECASE)
# Response status, its usual names, and words for scripts that must be on.
_STATUS = re.compile(
    r"\b[45]\d\d\b|not found|nicht gefunden|introuvable|no encontrad|does(?: not|n.t) exist|denied|forbidden|permission|expired|timed out|too many|rate limit|unavailable|went wrong|server error|bad gateway|connection reset|maintenance|try again|human"
    r"|(?:java)?scripts?\b|placeholder|dummy|sample (?:text|paragraph)|under construction",
    re.IGNORECASE,
)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[}\])>%@#»_])\s+(?=[A-ZÀ-Þ])")


def marks(unit: str) -> list[re.Match]:
    """Fields of a template in a unit: names between a run of signs and its mirror image, of two signs or, around a name
    with capitals, an underscore, a dot or a space, of one."""
    out = []
    for m in _BETWEEN.finditer(unit):
        left = re.sub(r"^[$#](?=\{)", "", m[1]).replace("!", "").replace("=", "")
        if left[:1] == "«" and unit[m.end(1)] == " ":  # a quotation
            continue
        if left and left[::-1].translate(_MIRROR) == m[3] and (len(m[3]) > 1 or re.search(r"[A-Z_. ]", m[2]) or m[1][0] in "$%#" or m[1] == "«"):
            out.append(m)
    return out


def shown_marks(unit: str) -> bool | None:
    """Whether a unit shows fields of a template as its own; None if it has none.

    A text that writes about templates has their signs within a sentence: they count at either end of a unit, or in one
    of few words.
    """
    if not (found := marks(unit)):
        return None
    return found[0].start() < 2 or found[-1].end() > len(unit) - 3 or len(unit.split()) <= MESSAGE


def weak_label(unit: str, page_words: int) -> int:
    """1 where a unit is residue by a template's signs, by its beginning, or by a status in a short page; else 0."""
    if (shown := shown_marks(unit)) is not None:
        return int(shown)
    if _NOTHING.search(unit) or _FILLER.match(unit):
        return 1
    return int(0 < page_words < SHORT_PAGE and len(unit.split()) <= MESSAGE and bool(_STATUS.search(unit)))


def page_units(title: str | None, blocks: str | None) -> list[str]:
    """Title, then the sentences of all texts of a page but code, in order."""
    out = [title or ""]
    for _, _, b in walk(parse_blocks(blocks)):
        if b.get("type") != "code":
            if b.get("spans"):
                out += sentences(spans_text(b))
            if isinstance(b.get("text"), str):
                out += sentences(b["text"])
            out += [c for r in b.get("rows") or () for c in r or () if isinstance(c, str)]
    return out


def sentences(text: str) -> list[str]:
    """The text cut behind full stops, question marks, exclamation marks, ellipses and, before a capital, closing marks."""
    return _SENTENCE.split(text)


def _bucket(n: np.ndarray, edges: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), n, "right")


def features(units: list[str], first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit number, hashed feature) of all features of the units; first says which are titles, size the page's words."""
    h, kind, owner = runs(units)
    shape = np.where(kind == PUNCTUATION, h, mix(kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    real = kind != END
    p = np.r_[np.uint64(5), h[:-1]]  # the run before, the end of the text before included
    n = np.r_[h[1:], np.uint64(5)]
    sp, sn = np.r_[shape[-1:], shape[:-1]], np.r_[shape[1:], shape[-1:]]
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
    pair = p * a + h
    short = np.where((size > 0) & (size < SHORT_PAGE), np.uint64(3), np.uint64(1))[owner]  # what a message says counts otherwise in a long page
    kinds = [h, mix(pair), mix(pair * b + n * c), mix(sp * b + shape * c + sn * a + np.uint64(7)), mix(pair + short * c)]
    rows = [owner[real]] * len(kinds)
    cols = [x[real] for x in kinds]
    many = np.bincount(owner[real], minlength=len(units))
    each = np.arange(len(units))
    length, whole = _bucket(many, (1, 3, 6, 12, 24)), _bucket(size, (1, 20, SHORT_PAGE))
    rows += [each, each]
    cols += [mix((np.uint64(101) + length.astype(np.uint64)) * a), mix((np.uint64(201) + whole.astype(np.uint64) * np.uint64(2) + first.astype(np.uint64)) * a)]
    ending = ~real  # words of the unit's end
    rows.append(owner[ending])
    cols.append(mix(p[ending] * c + np.uint64(13)))
    shown = np.array([k for k, u in enumerate(units) if _OPENING.search(u) and shown_marks(u)], np.int64)
    for k in (301, 302, 303):  # signs count as much as three words
        rows.append(shown)
        cols.append(mix(np.full(len(shown), k, np.uint64) * a))
    return np.concatenate(rows), np.concatenate(cols) & np.uint64(FEATURES - 1)


def _scale(row: np.ndarray, n: int) -> np.ndarray:
    """Length of a unit's feature vector, so that a long sentence counts no more than a short one."""
    return 6 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))


def fit(units: list[str], first: np.ndarray, size: np.ndarray, labels: np.ndarray, l2: float = L2, steps: int = STEPS) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression with L2, by adaptive gradient steps; the positives together weigh POSITIVES."""
    row, col = features(units, first, size)
    col = col.astype(np.int64)
    scale = _scale(row, len(labels))
    y = labels.astype(float)
    share = np.where(y > 0, POSITIVES / max(1, y.sum()), (1 - POSITIVES) / max(1, (1 - y).sum()))
    w, past = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    for _ in range(steps):
        z = np.bincount(row, w[col], minlength=len(y)) * scale + w[-1]
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.r_[np.bincount(col, (g * scale)[row], minlength=FEATURES), g.sum()] + l2 * np.r_[w[:-1], 0]
        past += grad * grad
        w -= RATE * grad / np.sqrt(past)
    return w


def scores(units: list[str], first: np.ndarray, size: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Probability of each unit to be residue."""
    if not units:
        return np.zeros(0)
    row, col = features(units, first, size)
    z = np.bincount(row, w[col.astype(np.int64)], minlength=len(units)) * _scale(row, len(units)) + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def training_units(pages: list[tuple[str | None, str | None]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Units, title flags, page sizes and weak labels of sampled pages; of either class every k-th beyond SAMPLE_UNITS.

    In a short page, units without a label whose wording ordinary pages don't have are left out: they may be messages of a
    kind that the phrases miss. In a page that has filler, such units of more than five words without a stop word are filler too.
    """
    units, first, size, labels, filling = [], [], [], [], []
    every = [page_units(title, blocks) for title, blocks in pages]
    words = [sum(len(u.split()) for u in own[1:]) for own in every]
    messages = repeated_messages(every, words)
    for own, n in zip(every, words):
        filler = any(_FILLER.match(u) for u in own)
        for k, u in enumerate(own):
            label = weak_label(u, n)
            if not label and k and 0 < n < SHORT_PAGE and _DIGITS.sub("0", u) in messages:
                label = 1
            more = not label and filler and len(w := u.lower().split()) > 5 and STOP_WORDS.isdisjoint(w)
            if not label and (0 < n < SHORT_PAGE or more):
                label = -1
            filling.append(more)
            units.append(u)
            first.append(k == 0)
            size.append(n)
            labels.append(label)
    y = np.array(labels, int)
    unsure = np.flatnonzero(y == -1)
    if len(unsure):
        y[unsure[_ordinary([units[k] for k in np.flatnonzero(y == 0)], [units[k] for k in unsure])]] = 0
        y[(y == -1) & np.array(filling)] = 1
    keep = np.concatenate([k[:: len(k) // SAMPLE_UNITS + 1] for k in (np.flatnonzero(y == 1), np.flatnonzero(y == 0))])
    return [units[k] for k in keep], np.array(first, bool)[keep], np.array(size, int)[keep], y[keep]


def repeated_messages(every: list[list[str]], words: list[int]) -> set[str]:
    """Sentences, digits aside, that a notable share of the short pages have but other pages hardly ever: what stands in
    place of content is the same on many pages. Menus and footers stand in pages of any size, so they are none."""
    short, other = Counter(), Counter()
    n_short = n_other = 0
    for own, n in zip(every, words):
        if not n:
            continue
        if n < SHORT_PAGE:
            n_short += 1
            short.update({_DIGITS.sub("0", u) for u in own[1:] if 1 < len(u.split()) <= MESSAGE})
        else:
            n_other += 1
            other.update({_DIGITS.sub("0", u) for u in own[1:] if 1 < len(u.split()) <= MESSAGE})
    if not n_other:
        return set()
    least = max(REPEATED_LEAST, REPEATED_SHARE * n_short)
    return {u for u, c in short.items() if c >= least and c / n_short >= REPEATED_LIFT * other[u] / n_other}


def _ordinary(calm: list[str], unsure: list[str]) -> np.ndarray:
    """Which unsure units have at least ORDINARY of their pairs of words in the calm ones."""
    def pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h, kind, owner = runs(texts)
        real = kind[1:] != END
        return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[real], owner[1:][real]

    known, (p, owner) = np.unique(pairs(calm)[0]) if calm else np.empty(0, np.uint64), pairs(unsure)
    many = np.bincount(owner, minlength=len(unsure))
    return np.bincount(owner, np.isin(p, known), minlength=len(unsure)) >= ORDINARY * np.maximum(many, 1)


def train(pages: list[tuple[str | None, str | None]]) -> np.ndarray:
    """The classifier's weights from sampled pages; without a positive unit, weights that find nothing."""
    units, first, size, y = training_units(pages)
    if not (y == 1).any():
        return np.r_[np.zeros(FEATURES), -30].astype(np.float32)
    return fit(units, first, size, y).astype(np.float32)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """0 for a short page, 1 for another with signs of a template, 2 for the rest, by the words that are judged."""
    for rb in batches:
        kinds = []
        for title, blocks in zip(rb.column("title").to_pylist(), rb.column("blocks").to_pylist()):
            n = sum([len(u.split()) for u in page_units(None, blocks)])
            kinds.append(0 if 0 < n < SHORT_PAGE else 1 if _MARKED.search(title or "") or _MARKED.search(blocks or "") else 2)
        yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("indexed_at"), pa.array(kinds, pa.int32())], ["id", "indexed_at", "kind"])


def sample_pages(docs: DataFrame) -> list[tuple[str | None, str | None, str | None]]:
    """Pages (title, blocks, url) with the smallest hashes of their ids: at most SHORT_PAGES short ones, MARKED_PAGES with
    signs of a template and ANY_PAGES others, so that what is rare in a large corpus is in the sample too."""
    rows = docs.filter("id IS NOT NULL").select("id", F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("indexed_at"), "title", "blocks", "url")
    kinds = cut(rows.select("id", "indexed_at", "title", "blocks").mapInArrow(_kinds, "id string, indexed_at long, kind int"))
    n = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    parts = [bounded_sample(kinds.filter(F.col("kind") == k), ["id", "indexed_at"], most, n.get(k, 0)) for k, most in enumerate((SHORT_PAGES, MARKED_PAGES, ANY_PAGES))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "indexed_at").distinct())
    on = (F.col("r.id") == F.col("c.id")) & F.col("r.indexed_at").eqNullSafe(F.col("c.indexed_at"))
    got = {(r["id"], r["indexed_at"]): (r["title"], r["blocks"], r["url"]) for r in rows.alias("r").join(chosen.alias("c"), on, "left_semi").collect()}
    return [got[k] for k in sorted(got, key=lambda k: (k[0], k[1] is not None, k[1] or 0))]


def host(url: str | None) -> str:
    """The host of a URL, lower-cased; empty if it has none."""
    return (url or "").partition("://")[2].partition("/")[0].lower()


def validate(docs: DataFrame, folds: int = 5) -> dict[str, float]:
    """Precision and recall against the weak labels on hosts that the fit hasn't seen, each host in one of the folds."""
    pages = sample_pages(docs)
    hosts = sorted({host(u) for _, _, u in pages})
    place = {h: k % folds for k, h in enumerate(hosts)}
    hit = said_ = true = n = 0
    for fold in range(folds):
        w = train([p[:2] for p in pages if place[host(p[2])] != fold])
        units, first, size, y = training_units([p[:2] for p in pages if place[host(p[2])] == fold])
        if units:
            said = scores(units, first, size, w) >= CUT
            hit, said_, true, n = hit + int((said & (y == 1)).sum()), said_ + int(said.sum()), true + int(y.sum()), n + len(y)
    return {"precision": hit / max(1, said_), "recall": hit / max(1, true), "units": n, "positives": true}


def _judge(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        pages = [page_units(t, b) for t, b in zip(rb.column("title").to_pylist(), rb.column("blocks").to_pylist())]
        best = np.zeros(len(pages))
        for part in chunks([sum(map(len, p)) for p in pages]):
            own = pages[part]
            many = np.array([len(p) for p in own])
            at = np.r_[0, np.cumsum(many)[:-1]]
            first = np.zeros(many.sum(), bool)
            first[at] = True
            words = np.array([sum([len(u.split()) for u in p[1:]]) for p in own])
            s = scores([u for p in own for u in p], first, np.repeat(words, many), w)
            best[part] = np.maximum.reduceat(s, at)
        keep = [rb.column(c) for c in ("id", "indexed_at", "arrived_at")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(best)], ["id", "indexed_at", "arrived_at", "score"])


def _judge_summaries(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        parts = [sentences(s or "") for s in rb.column("summary").to_pylist()]
        units = [u for p in parts for u in p]
        n = len(units)
        s = np.maximum.reduceat(scores(units, np.zeros(n, bool), np.full(n, SHORT_PAGE * 5), w), np.r_[0, np.cumsum([len(p) for p in parts])[:-1]].astype(int)) if n else np.zeros(0)
        yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array(s)], ["id", "score"])


def residue_scores(docs: DataFrame, index_docs: DataFrame) -> DataFrame:
    """(id, score): for each current document and each document of the index, the highest probability of its units.

    The title, all sentences but code, and those of the summary in index_docs are judged. Null and empty titles, blocks and summaries
    have empty units, which score low; a document in one table only is judged by that. The fit reads the pages of ``sample_pages``;
    every page is then judged whole.
    """
    w = train([p[:2] for p in sample_pages(docs)])
    shared = docs.sparkSession.sparkContext.broadcast(w)
    rows = docs.select("id", "title", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("indexed_at", "arrived_at")], "blocks")
    judged = rows.mapInArrow(lambda it: _judge(it, shared.value), "id string, indexed_at long, arrived_at long, score double")
    pages = latest(judged, ["score"]).select("id", "score")
    summaries = index_docs.filter("id IS NOT NULL AND summary IS NOT NULL").select("id", "summary").mapInArrow(lambda it: _judge_summaries(it, shared.value), "id string, score double")
    return pages.unionByName(summaries).groupBy("id").agg(F.max("score").alias("score"))


def residue(docs: DataFrame, index_docs: DataFrame, least: float = CUT) -> DataFrame:
    """(id) of the documents that show residue."""
    return residue_scores(docs, index_docs).filter(F.col("score") >= least).select("id")
