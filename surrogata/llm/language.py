"""Language ID: unigram pieces per language, summed over all segmentations of every word.

The pieces are those of a fixed public vocabulary (``piece_bpe_32k.model``).  Each language has a
probability for every piece, fitted by expectation-maximisation on words of labelled documents; a
word's probability is the sum over all ways to cut it into pieces (forward algorithm), and a text's
is the product over its words.  Words are runs of letters in lower case behind a word mark; runs
of more than LONGEST characters are cut there first.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, cut
from .tokens import LETTER, Fingerprints, char_classes, room, span_hashes

MARK = "▁"
LONGEST = 32               # characters of a word that are segmented together, the mark included
PIECE = 10                 # longest piece that is used
TRAIN_DOCS = 3000          # labelled documents that each language is fitted on, about
ROUNDS = 3
SMOOTH = 0.05              # pseudo-count of every piece
STEP = 1 << 19             # characters handled at once
KNOWN = 1 << 19            # words whose scores a worker remembers


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary: number of every piece of at most PIECE characters; number ``size`` is any
    single character that is no piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i) for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.names = sorted(n for n in names if len(n) <= PIECE and n == n.lower())
        self.size = len(self.names)
        self.table = Fingerprints(1 << 16)
        codes = np.frombuffer("".join(self.names).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(n) for n in self.names])
        start = end - [len(n) for n in self.names]
        self.table.insert(span_hashes(codes, start, end), np.arange(self.size, dtype=np.int32))

    def lattice(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(words, longest, PIECE): the piece that starts at a character and has l + 1 of them,
        -1 where there is none."""
        longest = int(length.max())
        at = np.arange(longest)
        out = np.full((len(start), longest, PIECE), -1, np.int32)
        for n in range(1, min(PIECE, longest) + 1):
            w, p = np.nonzero(at[None, :] + n <= length[:, None])
            s = start[w] + p
            found = self.table.find(span_hashes(codes, s, s + n))
            if n == 1:
                found[found < 0] = self.size
            out[w, p, n - 1] = found
        return out


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def words_of(texts: list[str | None]):
    """(code points with a mark before every word, start and length of every part of a word,
    bounds of each text's parts)."""
    low = "\n".join((t or "").lower().replace("\n", " ") for t in texts)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(codes) + 2, np.int8)
    letter[1:-1] = char_classes()[codes] == LETTER
    edge = np.diff(letter)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_end = np.append(np.flatnonzero(codes == 10), len(codes))
    # the mark takes the place of the character before the word
    marked = np.append(np.uint32(10), codes)
    marked[begin] = ord(MARK)
    length = end - begin + 1
    parts = -(-length // LONGEST)
    which = np.repeat(np.arange(len(begin)), parts)
    k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = begin[which] + k * LONGEST
    size = np.minimum(LONGEST, length[which] - k * LONGEST)
    bounds = np.concatenate([[0], np.cumsum(parts)])[np.searchsorted(begin, text_end)]
    return marked, start, size, np.concatenate([[0], bounds])


def forward(lattice: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(words, longest + 1, languages): probability of all segmentations of every prefix."""
    words, longest, _ = lattice.shape
    alpha = np.zeros((words, longest + 1, p.shape[1]))
    alpha[:, 0] = 1
    for t in range(1, longest + 1):
        own = np.flatnonzero(length >= t)
        for n in range(1, min(PIECE, t) + 1):
            piece = lattice[own, t - n, n - 1]
            some = piece >= 0
            rows = own[some]
            alpha[rows, t] += alpha[rows, t - n] * p[piece[some]]
    return alpha


def backward(lattice: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
    words, longest, _ = lattice.shape
    beta = np.zeros((words, longest + 1, p.shape[1]))
    beta[np.arange(words), length] = 1
    for t in range(longest - 1, -1, -1):
        for n in range(1, min(PIECE, longest - t) + 1):
            piece = lattice[:, t, n - 1]
            rows = np.flatnonzero(piece >= 0)
            beta[rows, t] += beta[rows, t + n] * p[piece[rows]]
    return beta


def expected(lattice, length, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of every piece by words that occur ``weight`` (words, languages) times."""
    alpha, beta = forward(lattice, length, p), backward(lattice, length, p)
    total = alpha[np.arange(len(length)), length]
    scale = np.divide(weight, total, out=np.zeros_like(weight), where=total > 0)
    out = np.zeros_like(p)
    longest = lattice.shape[1]
    for t in range(longest):
        for n in range(1, min(PIECE, longest - t) + 1):
            piece = lattice[:, t, n - 1]
            rows = np.flatnonzero(piece >= 0)
            use = alpha[rows, t] * beta[rows, t + n] * p[piece[rows]] * scale[rows]
            np.add.at(out, piece[rows], use)
    return out


def _by_length(size: np.ndarray, step: int = 8192):
    order = np.argsort(size, kind="stable")
    return [order[s:s + step] for s in range(0, len(order), step)]


def word_scores(pieces: Pieces, codes, start, size, p: np.ndarray) -> np.ndarray:
    """log probability of every word in every language."""
    out = np.zeros((len(start), p.shape[1]))
    for own in _by_length(size):
        lattice = pieces.lattice(codes, start[own], size[own])
        alpha = forward(lattice, size[own], p)
        out[own] = np.log(np.maximum(alpha[np.arange(len(own)), size[own]], 1e-300))
    return out


class Scorer:
    """Scores texts; scores of words are remembered by fingerprint up to KNOWN words."""

    def __init__(self, path: str, p: np.ndarray):
        self.pieces, self.p = pieces_of(path), p
        self.table = Fingerprints(KNOWN)
        self.known = np.zeros((0, p.shape[1]))

    def words(self, codes, start, size) -> np.ndarray:
        if not len(start):
            return np.zeros((0, self.p.shape[1]))
        h, first, inverse = np.unique(span_hashes(codes, start, start + size), return_index=True,
                                      return_inverse=True)
        entry = self.table.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.table.known + len(new) > KNOWN:
                self.table.clear()
                if len(new) > KNOWN // 2 or len(h) > KNOWN:
                    return word_scores(self.pieces, codes, start[first], size[first], self.p)[inverse]
                return self.words(codes, start, size)
            k = self.table.known
            self.known = room(self.known, k, len(new))
            self.known[k:k + len(new)] = word_scores(self.pieces, codes, start[first[new]],
                                                     size[first[new]], self.p)
            entry[new] = k + np.arange(len(new))
            self.table.insert(h[new], entry[new].astype(np.int32))
        return self.known[entry][inverse]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, number of words) of all texts."""
        out, count, at = np.zeros((len(texts), self.p.shape[1])), np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to] or "") <= STEP):
                n += len(texts[to] or "")
                to += 1
            codes, start, size, bounds = words_of(texts[at:to])
            s = np.vstack([np.zeros((1, self.p.shape[1])), np.cumsum(self.words(codes, start, size), axis=0)])
            out[at:to] = s[bounds[1:]] - s[bounds[:-1]]
            count[at:to] = np.diff(bounds)
            at = to
        return out, count


def held_out(id_col: str):
    """Rows that are never learned from; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _word_counts(batches):
    """(lang, text) -> (lang, word, n), summed per batch."""
    from collections import Counter

    for x in batches:
        count = Counter()
        for lang, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
            codes, start, size, _ = words_of([text])
            joined = codes.tobytes()
            for s, n in zip(start.tolist(), size.tolist()):
                count[lang, joined[4 * s:4 * (s + n)]] += 1
        keys = list(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()),
             pa.array([k[1].decode("utf-32-le", "replace") for k in keys], pa.string()),
             pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int = TRAIN_DOCS,
        path: str | None = None, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the piece probabilities (pieces + 1, languages), from about
    ``train_docs`` labelled documents a language that are not held out, taken by a hash."""
    path = path or default_pieces()
    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                      F.col(f"`{text_col}`").alias("text")).where("lang is not null").where(~held_out("i"))
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, 0))
    draw = F.pmod(F.xxhash64("i", F.lit("train")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(v) for k in langs
                           for v in (k, int((1 << 30) * min(1.0, train_docs / counts[k])))])
    words = cut(own.where(draw < share[F.col("lang")]).select("lang", "text")
                .mapInArrow(_word_counts, "lang string, word string, n long")
                .groupBy("lang", "word").agg(F.sum("n").alias("n")), "language")
    size = pieces_of(path).size
    number = {k: i for i, k in enumerate(langs)}
    p = np.full((size + 1, len(langs)), 1.0 / (size + 1))
    spark = docs.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def uses(batches):
            pieces, total = pieces_of(path), np.zeros((size + 1, len(langs)))
            for x in batches:
                for at in range(0, x.num_rows, 8192):
                    lang, word, n = (c.to_pylist() for c in x.slice(at, 8192).columns)
                    codes = np.frombuffer("".join(word).encode("utf-32-le"), np.uint32)
                    length = np.array([len(w) for w in word], np.int64)
                    start = np.cumsum(length) - length
                    weight = np.zeros((len(word), len(langs)))
                    weight[np.arange(len(word)), [number[k] for k in lang]] = n
                    for rows in _by_length(length, 2048):
                        lattice = pieces.lattice(codes, start[rows], length[rows])
                        total += expected(lattice, length[rows], shared.value, weight[rows])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(k, pa.int32()),
                                              pa.array(total[piece, k])], ["piece", "k", "n"])

        got = words.mapInArrow(uses, "piece int, k int, n double").groupBy("piece", "k") \
            .agg(F.sum("n").alias("n")).toArrow()
        c = np.full((size + 1, len(langs)), SMOOTH)
        c[got.column(0).to_numpy(), got.column(1).to_numpy()] += got.column(2).to_numpy()
        p = c / c.sum(axis=0)
    return langs, p


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             path: str | None = None, **options) -> tuple[DataFrame, str]:
    """The documents with a struct (its name comes second): lang_pred and score, the probability
    of that language among those learned, all alike before the text is seen.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if no
    language could be learned; ties go to the first language in order; rows are judged each by
    itself, null ids too, which are learned from; all columns pass through.
    """
    path = path or default_pieces()
    langs, p = fit(docs, id_col, text_col, lang_col, path=path, **options)
    shared = docs.sparkSession.sparkContext.broadcast(p)
    made: list[Scorer] = []

    def run(column):
        texts = column.to_pylist()
        if not langs:
            return [["und"] * len(texts), [0.0] * len(texts)]
        if not made:
            made.append(Scorer(path, shared.value))
        s, n = made[0].texts(texts)
        best = s.argmax(axis=1)
        share = 1 / np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -700)).sum(axis=1)
        return [[langs[b] if k else "und" for b, k in zip(best.tolist(), n.tolist())],
                np.where(n > 0, share, 0.0).tolist()]

    return annotate(docs, [text_col], run, "lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    found, f = identify(docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), f"{f}.lang_pred", f"{f}.score")
