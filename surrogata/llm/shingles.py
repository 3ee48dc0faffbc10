"""Vectorised shingles, MinHash signatures and band keys of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import offsets_of
from .decontaminate import _FOLD
from .tokens import mix, span_hashes

WORDS = 5                  # words in a shingle of a document
CHARS = 8                  # characters in a shingle of a line
STEP_BYTES = 1 << 18       # text handled at once
CACHED = 1 << 13           # numbers of which a few arrays fit a cache
_FOLD_TABLE = np.frombuffer(_FOLD, np.uint8)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                   0xA0761D6478BD642F], np.uint64)
_CHAR = np.random.default_rng(20240301).integers(0, 1 << 64, CHARS, np.uint64) | np.uint64(1)


def text_slices(column: pa.Array):
    """(first row, UTF-8 bytes, offsets) of runs of rows of about STEP_BYTES; rows stay whole."""
    data, off = offsets_of(column)
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + STEP_BYTES, side="right")) - 1)
        yield at, data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts, and the bounds of each text's words.  Words are
    runs of digits, letters (A-Z as a-z) and everything beyond ASCII."""
    folded = _FOLD_TABLE[data]
    word = folded != 32
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    begin, end = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]]
    before[begin], after[end - 1] = False, False
    start, stop = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + STEP_BYTES)))
        low = start[at]
        out[at:to] = span_hashes(folded[low:stop[to - 1]], start[at:to] - low, stop[at:to] - low)
        at = to
    return out, np.searchsorted(start, off)


def word_shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles of all texts, bounds of each text's, fingerprint of each text's word sequence).
    A text of fewer than WORDS words has one shingle of all its words, a wordless text none."""
    h, bounds = word_hashes(data, off)
    count = np.diff(bounds)
    end = np.repeat(bounds[1:], count)
    at = np.arange(len(h))
    with np.errstate(over="ignore"):
        s = h * _PLACE[0]
        for k in range(1, WORDS):
            inside = at[:len(h) - k] + k < end[:len(h) - k] if k < len(h) else np.zeros(0, bool)
            s[:max(0, len(h) - k)] += np.where(inside, h[k:] * _PLACE[k], np.uint64(0))
        first = np.repeat(bounds[:-1], count)
        keep = (at + WORDS <= end) | (at == first)
        s = mix(s + np.minimum(end - first, WORDS).astype(np.uint64))[keep]
        place = (at - first).astype(np.uint64)
        whole = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ mix(place + np.uint64(1))))])
        text = mix((whole[bounds[1:]] - whole[bounds[:-1]]) ^ (count.astype(np.uint64) << np.uint64(48)))
    n = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    return s, np.concatenate([[0], np.cumsum(n)]), text.view(np.int64)


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts behind each other, start and length of each."""
    codes = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t or "") for t in texts], np.int64)
    return codes, np.cumsum(length + 1) - length - 1, length


def line_prints(texts: list[str | None]) -> np.ndarray:
    """Fingerprints of the characters of each text."""
    codes, start, length = _joined(texts)
    return span_hashes(codes, start, start + length).view(np.int64)


def line_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_shingles for lines: all runs of CHARS characters of each, the whole of a shorter
    one, none of an empty one; the fingerprint is of the characters.  A run's hash is a sum of its
    characters times independent random numbers."""
    codes, start, length = _joined(texts)
    n = np.where(length >= CHARS, length - CHARS + 1, np.minimum(length, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    value = codes.astype(np.uint64) + np.uint64(1)
    runs = np.zeros(len(codes), np.uint64)
    full = max(0, len(codes) - CHARS + 1)
    part = np.empty(CACHED, np.uint64)
    for low in range(0, full, CACHED):
        own = runs[low:min(full, low + CACHED)]
        for k in range(CHARS):
            own += np.multiply(value[low + k:low + k + len(own)], _CHAR[k], out=part[:len(own)])
    for i in np.flatnonzero((length > 0) & (length < CHARS)).tolist():
        own = value[start[i]:start[i] + length[i]]
        runs[start[i]] = (own * _CHAR[:len(own)]).sum() + np.uint64(len(own))
    begins = np.zeros(len(codes) + 1, np.int8)                 # 1 where a text's runs begin, -1 behind the last
    begins[start[n > 0]] = 1
    begins[(start + n)[n > 0]] -= 1
    runs = runs[np.cumsum(begins[:-1], dtype=np.int8).view(bool)]
    return mix(runs), bounds, span_hashes(codes, start, start + length).view(np.int64)


@lru_cache(maxsize=4)
def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return (draw.integers(0, 1 << 32, k, np.uint32) | np.uint32(1)), draw.integers(0, 1 << 32, k, np.uint32)


def signatures(shingles: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """(texts x k) MinHash values; a text without shingles has the largest value everywhere."""
    a, b = permutations(k)
    out = np.full((len(bounds) - 1, k), np.uint32(0xFFFFFFFF))
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    at = bounds[some]
    part = max(1, (1 << 16) // max(1, len(x) // len(some)))        # texts whose shingles fit a cache
    with np.errstate(over="ignore"):
        for s in range(0, len(some), part):
            own = some[s:s + part]
            low, high = at[s], bounds[own[-1] + 1]
            y, seg = x[low:high], at[s:s + part] - low
            z, least = np.empty_like(y), np.empty((k, len(own)), np.uint32)
            for j in range(k):
                np.multiply(y, a[j], out=z)
                np.minimum.reduceat(np.add(z, b[j], out=z), seg, out=least[j])
            out[own] = least.T
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(texts x bands) keys; equal keys mean equal values in that band."""
    n, k = sig.shape
    bands = k // rows
    with np.errstate(over="ignore"):
        key = mix(np.arange(bands, dtype=np.uint64) + np.uint64(0x51ED2701))[None, :].repeat(n, 0)
        for r in range(rows):
            key = mix(key ^ (sig[:, r:bands * rows:rows].astype(np.uint64) + np.uint64(r << 40)))
    return key.view(np.int64)
