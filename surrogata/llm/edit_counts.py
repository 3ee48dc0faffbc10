"""Token counts that follow edits: a segment tree over the pre-tokens of every document.

Leaves are the spans between places where a letter, a blank and a letter follow each other.  Such a
place is a cut of the split pattern whatever else the text holds, so an edit can only change the
leaves it touches and, if it reaches the characters at a cut, the leaf next to it.  Those leaves
are joined and encoded again; the sums on the path to the root are renewed.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate
from .tokens import default_vocabulary, encode_texts, pieces, pretoken_ids, split_chunk

#: Personal data that the registered query masks: mail addresses, long digit groups.
PERSONAL = re.compile(r"[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)+|\+?\d(?:[ ()-]{0,2}\d){6,}")
MASK = "[masked]"


class TokenTree:
    """Token counts and lengths of the leaves of one text, with their sums above."""

    def __init__(self, text: str, cuts: np.ndarray, tokens: np.ndarray, vocabulary: str):
        self.text, self.vocabulary, self.reencoded = text, vocabulary, 0
        self.cuts = np.append(cuts, len(text))
        self.size = 1 << max(0, (len(cuts) - 1).bit_length())
        self.tokens = self._tree(tokens)
        self.chars = self._tree(np.diff(self.cuts))
        self.own: dict[int, str] = {}

    def _tree(self, leaves: np.ndarray) -> list[int]:
        tree = np.zeros(2 * self.size, np.int64)
        tree[self.size:self.size + len(leaves)] = leaves
        half = self.size // 2
        while half:
            tree[half:2 * half] = tree[2 * half:4 * half:2] + tree[2 * half + 1:4 * half:2]
            half //= 2
        return tree

    @property
    def total(self) -> int:
        return int(self.tokens[1]) if self.size > 1 else int(self.tokens[-1])

    @property
    def length(self) -> int:
        return int(self.chars[1]) if self.size > 1 else int(self.chars[-1])

    def _leaf(self, k: int) -> str:
        if k in self.own:
            return self.own[k]
        return self.text[self.cuts[k]:self.cuts[k + 1]] if k + 1 < len(self.cuts) else ""

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf of a character and where the leaf starts."""
        at = max(0, min(at, self.length - 1))
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def _set(self, k: int, text: str, tokens: int) -> None:
        self.own[k] = text
        for tree, value in ((self.tokens, tokens), (self.chars, len(text))):
            node = k + self.size
            more = value - tree[node]
            while node:
                tree[node] += more
                node //= 2

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] of the current text."""
        first, before = self._find(start - 2)
        last, _ = self._find(end)
        old = "".join(self._leaf(k) for k in range(first, last + 1))
        text = old[:start - before] + new + old[end - before:]
        _, count = encode_texts([text], self.vocabulary)
        self.reencoded += len(text)
        self._set(first, text, int(count[0]))
        for k in range(first + 1, last + 1):
            self._set(k, "", 0)

    def current(self) -> str:
        return "".join(self._leaf(k) for k in range(len(self.cuts) - 1))


def leaves(texts: list[str | None], vocabulary: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and token count of every leaf of every text."""
    table = pretoken_ids(vocabulary)
    out = [([], []) for _ in texts]
    done = np.zeros(len(texts), np.int64)
    for chunk in pieces(texts):
        text, codes, starts, ends, lengths = split_chunk(chunk)
        entry = table.entries(text, codes, starts, ends)
        count = table.count[entry]
        low = (codes >= 97) & (codes <= 122)
        cut = np.zeros(len(codes), bool)
        cut[1:-1] = low[:-2] & (codes[1:-1] == 32) & low[2:]
        begin = np.cumsum(lengths) - lengths
        cut[begin] = True
        at = np.flatnonzero(cut)
        total = np.add.reduceat(count, np.searchsorted(starts, at))
        bound = np.searchsorted(at, np.append(begin, len(codes)))
        for j, (i, _) in enumerate(chunk):
            own = slice(bound[j], bound[j + 1])
            out[i][0].append(at[own] - begin[j] + done[i])
            out[i][1].append(total[own])
            done[i] += lengths[j]
    none = np.zeros(0, np.int64)
    return [(np.concatenate(a), np.concatenate(b)) if a else (none, none) for a, b in out]


def trees(texts: list[str | None], vocabulary: str):
    for at in range(0, len(texts), 256):
        part = texts[at:at + 256]
        for text, (cuts, tokens) in zip(part, leaves(part, vocabulary)):
            if not len(cuts):
                cuts = tokens = np.zeros(1, np.int64)
            yield TokenTree(text or "", cuts, tokens, vocabulary)


def count_with_edits(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None,
                     pattern: re.Pattern = PERSONAL, mask: str = MASK) -> tuple[DataFrame, str]:
    """The documents with a struct (its name comes second): n_tokens of the whole text, n_edits,
    n_tokens_edited after every match of the pattern is masked, n_chars_reencoded and the edited
    text's n_chars_edited.

    A null or empty text counts 0 and has no edits; rows are counted each by itself, so null or
    repeated ids and other columns do not matter; an empty table stays empty.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(column):
        out = [[] for _ in range(5)]
        for tree in trees(column.to_pylist(), vocabulary):
            before = tree.total
            edits = [m.span() for m in pattern.finditer(tree.text)]
            for start, end in reversed(edits):
                tree.replace(start, end, mask)
            for c, v in zip(out, (before, len(edits), tree.total, tree.reencoded, tree.length)):
                c.append(v)
        return out

    return annotate(docs, [text_col], run, "n_tokens long, n_edits long, n_tokens_edited long, "
                                           "n_chars_reencoded long, n_chars_edited long")


def edit_counts(docs: DataFrame) -> DataFrame:
    counted, f = count_with_edits(docs.select("doc_id", "text"))
    return counted.select("doc_id", f"{f}.*")
