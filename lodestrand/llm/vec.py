"""Vectorised text features: word and n-gram hashes of whole batches in numpy, without a Python loop per word.

A word is a maximal run of letters, numbers and underscores (Unicode categories L and N) of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def word_table() -> np.ndarray:
    """For each code point, whether it belongs to words."""
    if "word" not in _tables:
        t = np.zeros(0x110000, bool)
        t[[c for c in range(0x110000) if chr(c).isalnum()]] = True
        t[ord("_")] = True
        _tables["word"] = t
    return _tables["word"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if "pow" not in _tables or len(_tables["pow"]) < n:
        k = max(n, 1 << 16)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("pow", _BASE), ("inv", inv)):
            a = np.full(k, b, np.uint64)
            a[0] = 1
            _tables[name] = np.cumprod(a, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(texts: list[str | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The lower-cased texts in pieces of about _PIECE characters: text, start of each document in it, and which document that is.

    Longer documents are cut between words (a single word beyond the size of a piece stays whole).
    """
    parts: list[str] = []
    starts: list[int] = []
    docs: list[int] = []
    n = 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        at = 0
        while at < len(t):
            end = at + _PIECE
            if end < len(t):
                while end < len(t) and (t[end].isalnum() or t[end] == "_"):
                    end += 1
            part = t[at:end]
            if n and n + len(part) > _PIECE:
                yield "\n".join(parts), np.array(starts), np.array(docs)
                parts, starts, docs, n = [], [], [], 0
            parts.append(part)
            starts.append(n)
            docs.append(i)
            n += len(part) + 1
            at = end
    if parts:
        yield "\n".join(parts), np.array(starts), np.array(docs)


def prefix_hash(cp: np.ndarray) -> np.ndarray:
    """Running polynomial hash; span() takes the hash of any span from it."""
    p, _ = powers(len(cp) + 1)
    out = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * p[: len(cp)], out=out[1:])
    return out


def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start])


def word_bounds(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.zeros(len(cp) + 2, np.int8)
    w[1:-1] = word_table()[cp]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, document that it is in), in order."""
    hs, ds = [], []
    for text, starts, docs in pieces(texts):
        cp = points(text)
        s, e = word_bounds(cp)
        hs.append(span(prefix_hash(cp), s, e))
        ds.append(docs[np.searchsorted(starts, s, "right") - 1])
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(ds)


def combine(hs: list[np.ndarray], salt: int) -> np.ndarray:
    """Hash of tuples of word hashes, sensitive to order; salt tells kinds of tuple apart."""
    h = np.full(len(hs[0]), salt, np.uint64)
    for x in hs:
        h = h * _MUL + x
    return mix(h)


def ngrams(h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the word n-grams. A document of fewer words has one gram, of all its words."""
    m = len(h) - n + 1
    gh, gd = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m > 0:
        ok = d[: m] == d[n - 1 :]
        gh = combine([h[i : i + m] for i in range(n)], n)[ok]
        gd = d[: m][ok]
    if len(h):
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        size = np.diff(np.r_[at, len(h)])
        short = size < n
        if short.any():
            xs = [int(combine([h[i : i + 1] for i in range(a, a + k)], n)[0]) for a, k in zip(at[short], size[short])]
            gh = np.r_[gh, np.array(xs, np.uint64)]
            gd = np.r_[gd, d[at[short]]]
    return gh, gd
