"""Tokenizing many texts at once with array operations: words of the project's tokenizer as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from docloom.functions.blocks import MAX_TOKEN

_PLANE = 0x10000
_P = 0x9E3779B97F4A7C15
_tables: tuple[np.ndarray, np.ndarray] | None = None
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; the same value gives the same result."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def _lowered(codes: list[int]) -> np.ndarray:
    """A number for the lower case of each code point, the same for all code points with that lower case."""
    out = []
    for c in codes:
        low = chr(c).lower()
        out.append(ord(low) if len(low) == 1 else 0x200000 + c)
    return mix(np.array(out, np.uint64) + np.uint64(1))


def _base() -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if _tables is None:
        safe = [c if not 0xD800 <= c < 0xE000 else 0 for c in range(_PLANE)]
        _tables = np.fromiter((chr(c).isalnum() for c in safe), bool, _PLANE), _lowered(safe)
    return _tables


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n + 1:
        inverse = pow(_P, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 18), np.uint64(p))]) for p in (_P, inverse))
        _powers = up, down
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of the texts, in order; words longer than MAX_TOKEN code points are dropped."""
    joined = "\n".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    alnum, low = _base()
    if joined.isascii() or int(code.max()) < _PLANE:
        inside, value = alnum[code], low[code]
    else:
        small = np.where(code < _PLANE, code, 0)
        inside, value = alnum[small], low[small]
        far = np.flatnonzero(code >= _PLANE)
        kinds, at = np.unique(code[far], return_inverse=True)
        inside[far] = np.array([chr(c).isalnum() for c in kinds.tolist()])[at]
        value[far] = _lowered(kinds.tolist())[at]
    edge = np.flatnonzero(np.diff(np.r_[np.int8(0), inside.view(np.int8), np.int8(0)]))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(code))
    total = np.cumsum(value * up[: len(code)])
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    hashes = mix((total[end - 1] - before) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    owner = np.searchsorted(ends, start, "right")
    if (end - start).max(initial=0) > MAX_TOKEN:
        keep = end - start <= MAX_TOKEN
        hashes, owner = hashes[keep], owner[keep]
    return hashes, owner


def chunks(sizes: list[int], most: int = 400_000) -> list[slice]:
    """Slices of consecutive texts of about ``most`` characters together; a longer text stands alone."""
    out, at, held = [], 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            out.append(slice(at, k))
            at, held = k, 0
        held += n
    if at < len(sizes):
        out.append(slice(at, len(sizes)))
    return out


#: Kinds of a run: lower-case word, word with a capital first letter, number, punctuation, end of a text.
LOWER, CAPITAL, NUMBER, PUNCTUATION, END = 1, 2, 3, 4, 5
_kinds: np.ndarray | None = None


def _kind_of(c: int) -> int:
    x = chr(c)
    if x.isalnum():
        return NUMBER if x.isnumeric() else CAPITAL if x.isupper() else LOWER
    return 0 if x.isspace() else PUNCTUATION


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, kind, text number) of every run of letters and digits or of punctuation, and of an END after each text.

    Hashes are of the lower case. Line feeds inside texts count as spaces; code points above the first plane as
    punctuation.
    """
    global _kinds
    if _kinds is None:
        _kinds = np.array([_kind_of(c if not 0xD800 <= c < 0xE000 else 0) for c in range(_PLANE)], np.int8)
    joined = "\n".join([t.replace("\n", " ") for t in texts]) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < _PLANE, code, 0x2603)
    kind, value = _kinds[code], _base()[1][code]
    ends = code == 10
    group = np.where((kind > 0) & (kind < PUNCTUATION), 1, np.where(kind == PUNCTUATION, 2, 0)).astype(np.int8)
    group[ends] = 3
    change = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | ends[1:]])
    stop = np.r_[change[1:], len(code)]
    real = group[change] > 0
    start, stop = change[real], stop[real]
    up, down = _power(len(code))
    total = np.cumsum(value * up[: len(code)])
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    h = mix((total[stop - 1] - before) * down[start] + (stop - start).astype(np.uint64))
    k = np.where(ends[start], END, kind[start]).astype(np.int8)
    text_end = np.flatnonzero(ends)
    return h, k, np.searchsorted(text_end, start, "left")
