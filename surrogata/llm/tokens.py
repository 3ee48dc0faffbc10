"""Byte-level BPE ids of whole texts, one library call per distinct pre-token.

The vocabulary's split pattern (``public_tokenizers.PATTERN``) cuts a text into pre-tokens and
no merge crosses a cut, so the ids of a text are the ids of its pre-tokens in order.  A chunk of
texts is split with a few numpy passes, every pre-token gets a 64-bit fingerprint, and only
fingerprints that the worker has not met are sent to the ``tokenizers`` library.  The table of
known pre-tokens is bounded (``MAX_KNOWN``) and started anew when full, which costs time only.
"""

from __future__ import annotations

import os
import re
import secrets
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

CHUNK_CHARS = 1 << 18          # code points handled at once
MAX_KNOWN = 1 << 21            # pre-tokens a worker remembers
FIRST_SLOTS = 1 << 15          # size of their table before it grows
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# White_Space code points (fixed values of the Unicode standard)
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
         0x205F, 0x3000]
_SAFE_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")
PRIME = np.uint64((1 << 61) - 1)
BASE = 0x0B5AD4ECEDA1CE2A9             # base of the fingerprints, any number below PRIME
_SPAN_CODES = 1 << 20                  # code points whose sums of 43-bit products stay below 2^63
_PLAIN = 1 << 12                       # codes below it are multiplied by 31 bits at once, others by 21


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER)
                       for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE] = SPACE
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, by halves of 31 and 30 bits."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    out = ((ah * bh) << np.uint64(1)) + (middle >> np.uint64(30)) \
        + ((middle & np.uint64((1 << 30) - 1)) << half)
    return reduced(reduced(out) + reduced(al * bl))


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - PRIME)                  # below PRIME the difference wraps round


def _run_of_powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo PRIME, n of them (a power of two), by doubling."""
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        step = np.uint64(pow(base, size, int(PRIME)))
        out[size:2 * size] = times(out[:size], np.full(size, step, np.uint64))
        size *= 2
    return out


@lru_cache(maxsize=3)
def _powers(n: int, base: int) -> tuple[dict[int, tuple[np.ndarray, ...]], np.ndarray]:
    """Powers of the base in pieces of 21 and of 31 bits, and powers of its inverse."""
    up = _run_of_powers(base, n)
    pieces = {bits: tuple(((up >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
                          for at in range(0, 61, bits)) for bits in (21, 31)}
    return pieces, _run_of_powers(pow(base, -1, int(PRIME)), n)


def powers(n: int, base: int) -> tuple[dict[int, tuple[np.ndarray, ...]], np.ndarray]:
    return _powers(1 << max(19, int(n).bit_length()), base)


def _sums(codes: np.ndarray, pieces: dict[int, tuple[np.ndarray, ...]]):
    """(bits before a piece, prefix sums of the codes times that piece), a piece at a time."""
    value = codes.astype(np.uint64) + np.uint64(1)
    bits = 31 if len(codes) == 0 or int(codes.max()) < _PLAIN - 1 else 21
    total = np.zeros(len(codes) + 1, np.uint64)
    for k, piece in enumerate(pieces[bits]):
        np.cumsum(value * piece[:len(codes)], out=total[1:])
        yield bits * k, total


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    """x times a power of two modulo PRIME."""
    if not bits:
        return x
    return ((x << np.uint64(bits)) & PRIME) | (x >> np.uint64(61 - bits))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64 constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit fingerprints of ``codes[start:end]``, the same wherever the span lies: polynomials
    modulo the prime 2^61 - 1, so two different spans of n codes agree for at most n of its bases."""
    base %= int(PRIME)
    if len(codes) > _SPAN_CODES:                     # far more than a chunk: piece by piece
        out = np.empty(len(start), np.uint64)
        for k in range(0, len(start), 1 << 16):
            s, e = start[k:k + (1 << 16)], end[k:k + (1 << 16)]
            out[k:k + len(s)] = _long_spans(codes, s, e, base)
        return out
    pieces, down = powers(len(codes), base)
    h = np.zeros(len(start), np.uint64)
    for at, total in _sums(codes, pieces):
        h = reduced(h + _rotated(reduced(total[end] - total[start]), at))
    h = times(h, down[start])
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(58)))


def _long_spans(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """span_hashes over more codes than one sum holds: spans that fit are hashed where they lie,
    longer ones by the Horner rule over parts."""
    out = np.empty(len(start), np.uint64)
    short = np.flatnonzero(end - start <= _SPAN_CODES // 2)
    while len(short):
        low = int(start[short].min())
        here = short[end[short] <= low + _SPAN_CODES]
        part = codes[low:int(end[here].max())]
        out[here] = span_hashes(part, start[here] - low, end[here] - low, base)
        short = np.setdiff1d(short, here, assume_unique=True)
    for i in np.flatnonzero(end - start > _SPAN_CODES // 2).tolist():
        h, n, at = 0, int(end[i] - start[i]), int(start[i])
        p = int(PRIME)
        for s in range(0, n, _SPAN_CODES // 2):
            part = codes[at + s:min(at + s + _SPAN_CODES // 2, at + n)]
            own = sum(int(total[-1]) << bits for bits, total in _sums(part, powers(len(part), base)[0]))
            h = (h + own * pow(base, s, p)) % p
        out[i] = mix(np.array([h ^ ((n & 63) << 58)], np.uint64))[0]
    return out


def split_points(codes: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Start of every pre-token of the concatenated texts (no text is empty)."""
    n = len(codes)
    cls = char_classes()[codes]
    first = np.zeros(n + 1, bool)
    first[doc_start] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= cls[1:] != cls[:-1]
    starts = run.copy()
    # the last character of a white-space run goes with what follows if it is a blank
    space = cls == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) if n > 1 else np.empty(0, np.int64)
    starts[last] = True
    blank = last[codes[last] == 32]
    starts[blank + 1] = False
    # 's 't 're 've 'm 'll 'd directly after a letter, digit or other white space
    apos = np.flatnonzero((codes == 39) & starts[:n])
    apos = apos[apos + 1 < n]
    apos = apos[~first[apos + 1] & (cls[apos + 1] == LETTER)]
    if len(apos):
        a = codes[apos + 1]
        two = (apos + 2 < n)
        at = np.minimum(apos + 2, n - 1)
        b = np.where(two & ~first[at], codes[at], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        length = np.where(one, 1, np.where(pair, 2, 0))
        apos, length = apos[length > 0], length[length > 0]
        starts[apos + 1] = False
        after = apos + 1 + length
        starts[after] |= run[after] | (cls[np.minimum(after, n - 1)] == LETTER)
    return np.flatnonzero(starts[:n])


class Fingerprints:
    """Open-addressing table from 64-bit fingerprints to entries 0, 1, ... of a bounded store; it grows
    with what is known and is half full at most."""

    def __init__(self, most: int = MAX_KNOWN):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self._empty(min(2 * self.most, FIRST_SLOTS))
        self.known = 0

    def _empty(self, size: int) -> None:
        self.slots = np.zeros(size, np.uint64)
        self.where = np.zeros(size, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each fingerprint, -1 where it is not known."""
        mask = np.uint64(len(self.slots) - 1)
        out = np.full(len(h), -1, np.int64)
        todo, at = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(todo):
            seen = self.slots[at]
            hit = seen == h[todo]
            out[todo[hit]] = self.where[at[hit]]
            go = ~hit & (seen != 0)
            todo, at = todo[go], (at[go] + 1) & int(mask)
        return out

    def insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        """New distinct fingerprints; of those that want one slot the last writer keeps it."""
        self.known += len(h)
        if 2 * self.known > len(self.slots):
            held = self.slots != 0
            h, entry = np.concatenate([self.slots[held], h]), np.concatenate([self.where[held], entry])
            self._empty(1 << (2 * self.known - 1).bit_length())
        size = len(self.slots) - 1
        at = (h & np.uint64(size)).astype(np.int64)
        while len(h):
            free = self.slots[at] == 0
            self.slots[at[free]] = h[free]
            self.where[at[free]] = entry[free]
            lost = self.slots[at] != h
            h, entry, at = h[lost], entry[lost], (at[lost] + 1) & size


def room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or a larger copy, with room for more rows."""
    if used + more <= len(a):
        return a
    big = np.zeros((2 * (used + more), *a.shape[1:]), a.dtype)
    big[:used] = a[:used]
    return big


def byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the other bytes, in order, for the code points from 256 on (fixed by that format)."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class PretokenIds:
    """Ids of pre-tokens by fingerprint, filled by the tokenizers library as texts need them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.model._resize_cache(0)              # a word is asked for once
        self.letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.ones(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)       # the byte-level alphabet has a character a byte
        self.table = Fingerprints()
        self.base = 2 + secrets.randbelow(int(PRIME) - 2)      # no text is made to collide with it
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.start = np.zeros(1, np.int64)      # entry k has ids[start[k]:start[k] + count[k]]
        self.count = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.used = 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order and how many each has: the vocabulary's merges are applied to a
        word's bytes, each written as its letter of the byte-level alphabet."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        ids = [[t.id for t in tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))]
               for w in words]
        count = np.fromiter(map(len, ids), np.int64, len(words))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum())), count

    def entries(self, text: str, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Entry of each pre-token; unknown ones are encoded first."""
        h = span_hashes(codes, start, end, self.base)
        h[h == 0] = 1
        out = self.table.find(h)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            if self.table.known + len(new) > self.table.most:
                if (need := len(np.unique(h))) > self.table.most:
                    self.table = Fingerprints(1 << need.bit_length())
                self.clear()
                return self.entries(text, codes, start, end)
            at = missing[first]
            ids, count = self._encode([text[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())])
            entry = self.table.known + np.arange(len(new))
            self._grow(ids, count)
            self.table.insert(new, entry.astype(np.int32))
            out[missing] = entry[np.searchsorted(new, h[missing])]
        return out

    def _grow(self, ids: np.ndarray, count: np.ndarray) -> None:
        k, u = self.table.known, self.used
        self.ids, self.start, self.count = (room(self.ids, u, len(ids)), room(self.start, k, len(count)),
                                            room(self.count, k, len(count)))
        self.ids[u:u + len(ids)] = ids
        self.count[k:k + len(count)] = count
        self.start[k:k + len(count)] = u + np.cumsum(count) - count
        self.used = u + len(ids)

    def gather(self, entry: np.ndarray) -> np.ndarray:
        count = self.count[entry]
        offset = np.cumsum(count) - count
        return self.ids[np.repeat(self.start[entry] - offset, count) + np.arange(int(count.sum()))]


@lru_cache(maxsize=2)
def pretoken_ids(path: str) -> PretokenIds:
    return PretokenIds(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(texts: list[str | None]):
    """Chunks ``[(index of the text, part of it)]`` of about CHUNK_CHARS code points.  A long text
    is cut between a letter and a blank before a letter, which is always a cut of the pattern."""
    chunk, size = [], 0
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text):
            cut = len(text)
            if cut - at > CHUNK_CHARS:
                m = _SAFE_CUT.search(text, at + CHUNK_CHARS)
                cut = m.start() if m else cut
            chunk.append((i, text[at:cut]))
            size += cut - at
            at = cut
            if size >= CHUNK_CHARS:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def encode_texts(texts: list[str | None], vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the number of ids of each text."""
    table = pretoken_ids(vocabulary)
    count, out = np.zeros(len(texts), np.int64), []
    for chunk in pieces(texts):
        text, codes, starts, ends, lengths = split_chunk(chunk)
        entry = table.entries(text, codes, starts, ends)
        out.append(table.gather(entry))
        total = np.concatenate([[0], np.cumsum(table.count[entry])])
        bound = np.searchsorted(starts, np.cumsum(lengths))
        per = np.diff(total[np.concatenate([[0], bound])])
        np.add.at(count, [i for i, _ in chunk], per)
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), count


def split_chunk(chunk: list[tuple[int, str]]):
    """Joined text, its code points, start and end of every pre-token, length of every part."""
    text = "".join(t for _, t in chunk)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for _, t in chunk], np.int64)
    starts = split_points(codes, np.cumsum(lengths) - lengths)
    return text, codes, starts, np.append(starts[1:], len(codes)), lengths
