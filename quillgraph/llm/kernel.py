"""Vectorised text kernels shared by the training-data operators.

A *token* is a maximal run of ASCII letters, ASCII digits and non-ASCII code
points of the lower-cased text; everything else separates tokens. Tokens are
hashed by a polynomial over their UTF-8 bytes modulo 2^64, evaluated for all
tokens of a slice of documents at once by prefix sums. Null texts count as
empty ones. Slices hold about ``SLICE_BYTES`` of text, or one document if it
is longer, so memory follows the longest document and not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_U = np.uint64


def _letters() -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        t[ord(a) : ord(b) + 1] = True
    t[128:] = True
    return t


_IS_LETTER = _letters()


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INV):
        p = np.full(n, base, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that low and high bits are usable."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


@dataclass
class Words:
    """Tokens of documents ``lo`` to ``hi`` of a batch."""

    lo: int
    hi: int
    doc: np.ndarray  # document of each token, counted from lo
    hash: np.ndarray  # uint64
    start: np.ndarray  # byte range in buf
    end: np.ndarray
    buf: np.ndarray
    first: np.ndarray  # index of the first token of each document, and the number of tokens


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, a blank after each, and where each begins."""
    parts = [((t.lower() if lower else t) if t else "").encode("utf-8", "replace") for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)), out=at[1:])
    return np.frombuffer(b" ".join(parts) + b" ", np.uint8), at


def words(texts: list[str | None]) -> Iterator[Words]:
    for lo, hi in slices(texts):
        buf, at = encode(texts[lo:hi])
        letter = _IS_LETTER[buf]
        step = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if letter[0]:
            step = np.concatenate(([0], step))
        start, end = step[0::2], step[1::2]  # the last byte is a blank, so runs are closed
        n = 1 << (len(buf) - 1).bit_length()
        up, down = _powers(max(n, SLICE_BYTES * 2))
        sums = np.zeros(len(buf) + 1, _U)
        np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start])
        doc = (np.searchsorted(at, start, "right") - 1).astype(np.int32)
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        yield Words(lo, hi, doc, h, start, end, buf, first)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` tokens and the first shingle of each document.

    A document of 1 to k-1 tokens has one shingle, of all its tokens; one
    without tokens has none.
    """
    n = np.diff(w.first)
    h = np.zeros(max(len(w.hash) - k + 1, 0), _U)
    q = _U(0xC2B2AE3D27D4EB4F)
    for j in range(k):
        h = h * q + w.hash[j : j + len(h)]
    ok = w.doc[: len(h)] == w.doc[k - 1 :] if len(h) else np.zeros(0, bool)
    out, doc = h[ok], w.doc[: len(h)][ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), _U)
        for x, d in enumerate(short):
            e = _U(len(w.hash[w.first[d] : w.first[d + 1]]))
            for t in w.hash[w.first[d] : w.first[d + 1]]:
                with np.errstate(over="ignore"):
                    e = e * q + t
            extra[x] = e
        order = np.argsort(np.concatenate((doc, short.astype(np.int32))), kind="stable")
        doc = np.concatenate((doc, short.astype(np.int32)))[order]
        out = np.concatenate((out, extra))[order]
    return mix(out), np.searchsorted(doc, np.arange(w.hi - w.lo + 1))


@lru_cache(maxsize=4)
def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``k`` multiply-add hash functions on uint64, multipliers odd."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 64, k, dtype=_U) | _U(1)
    return a, rng.integers(0, 1 << 64, k, dtype=_U)


def minhash(sh: np.ndarray, first: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Signatures (documents x k, uint32); rows of documents without shingles are 0."""
    a, b = permutations(k, seed)
    n = len(first) - 1
    sig = np.zeros((n, k), np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return sig
    # runs of documents whose shingles stay in the processor's cache
    cuts = np.flatnonzero(np.diff(first[full] // 16384, prepend=-1))
    for c, lo in enumerate(cuts):
        hi = cuts[c + 1] if c + 1 < len(cuts) else len(full)
        s0, s1 = first[full[lo]], first[full[hi - 1] + 1]
        x, at = sh[s0:s1], first[full[lo:hi]] - s0
        tmp = np.empty_like(x)
        for j in range(k):
            np.multiply(x, a[j], out=tmp)
            np.add(tmp, b[j], out=tmp)
            sig[full[lo:hi], j] = (np.minimum.reduceat(tmp, at) >> _U(32)).astype(np.uint32)
    return sig


def lists(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its values and the lengths of its rows."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the length."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))
