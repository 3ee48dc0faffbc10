"""Toxicity: a weighted finite-state grammar over the words of a clause.

Words become symbols: insult, threat, target, negation, report, quote.  Small transducers follow
one thing each (is a negation near, is speech reported, is a person near); their composition is one
machine that marks every insult or threat of a clause, so matched clauses count, not single words.
The insult lexicon, stems and whole words, and the weights of the marks come from labelled
documents; the word lists below are general vocabulary of the four languages.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, cut
from .near_join import _prints, near_links

TRAIN_DOCS = 32768         # labelled documents that the lexicon and the weights are fitted on
LONGEST_STEM, LEAST_STEM = 7, 3
HELD_ENTRIES = 1 << 17     # entries that a task counts before it hands the counts on
LEAST_DOCS = 4             # different toxic texts that a lexicon entry must have
LIFT = 3.0                 # times the usual share of toxic texts that an entry must have
HEAVIEST = 6.0             # weight, as log odds, of an entry that no clean document has

THREATS = {"kill", "murder", "shoot", "stab", "strangle", "hang", "hurt", "töten", "umbringen",
           "erschießen", "tuer", "égorger", "matar", "apuñalar"}
TARGETS = {"you", "your", "he", "she", "they", "him", "her", "them", "du", "ihr", "dich", "euch",
           "tu", "toi", "vous", "ils", "usted", "ustedes", "ellos", "ellas"}
NEGATIONS = {"not", "never", "no", "nobody", "isn", "aren", "kein", "keine", "nicht", "nie", "pas",
             "jamais", "aucun", "nunca", "jamás", "ningún"}
REPORTS = {"said", "says", "called", "quoted", "wrote", "claimed", "sagte", "nannte", "schrieb",
           "dit", "appelé", "écrit", "dijo", "llamó", "escribió"}
QUOTES = set("\"“”„«»")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
MARKS = ("insult", "insult_target", "insult_denied", "insult_reported", "threat", "threat_target",
         "threat_excused")
#: Weights before any label is seen, and how many documents each is worth.
PRIOR = np.array([-3.0, 2.0, 2.5, 0.3, 0.3, 1.0, 2.5, 0.2, 0.0])
PRIOR_STRENGTH = 1.0
_CLAUSE = re.compile(r"[^.!?;:\n]+")
_LETTER = r"[^\W\d_]"
_TOKEN = re.compile(rf"{_LETTER}+|[\"“”„«»]")


class Transducer:
    """step(state, symbol) -> (state, note); notes are read where an insult or threat stands."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def counting_down(trigger: set[int], reach: int) -> Transducer:
    """Notes whether a trigger lies within the last ``reach`` symbols."""
    def step(state, symbol):
        return (reach if symbol in trigger else max(0, state - 1)), state > 0
    return Transducer(0, step)


def latched(on: set[int], toggle: set[int]) -> Transducer:
    """Notes whether the clause has turned to reported speech."""
    def step(state, symbol):
        spoken, quoted = state
        return (spoken or symbol in on, quoted != (symbol in toggle)), spoken or quoted
    return Transducer((False, False), step)


def compose(*machines: Transducer) -> Transducer:
    """All machines at once; transitions of the product are worked out when first met."""
    known: dict = {}

    def step(state, symbol):
        key = (state, symbol)
        if key not in known:
            moves = [m.step(s, symbol) for m, s in zip(machines, state)]
            known[key] = (tuple(s for s, _ in moves), tuple(n for _, n in moves))
        return known[key]
    return Transducer(tuple(m.start for m in machines), step)


GRAMMAR = compose(counting_down({NEGATION}, 3), latched({REPORT}, {QUOTE}), counting_down({TARGET}, 4))


def mark_clause(symbols: list[int]) -> list[tuple[int, int]]:
    """(place, mark) of every insult or threat of a clause."""
    ahead = counting_down({TARGET}, 4)            # a target may also follow
    after, state = [False] * len(symbols), ahead.start
    for i in range(len(symbols) - 1, -1, -1):
        state, after[i] = ahead.step(state, symbols[i])
    out, state = [], GRAMMAR.start
    for i, symbol in enumerate(symbols):
        state, (denied, reported, targeted) = GRAMMAR.step(state, symbol)
        targeted = targeted or after[i]
        if symbol == INSULT:
            out.append((i, 2 if denied else 3 if reported else 1 if targeted else 0))
        elif symbol == THREAT:
            out.append((i, 6 if denied or reported else 5 if targeted else 4))
    return out


def prefixes(word: str) -> list[str]:
    """The entries that may stand for a word: its stems, and the word itself with an end mark."""
    return [word[:n] for n in range(LEAST_STEM, min(len(word), LONGEST_STEM) + 1)] + [word + "$"]


class Grammar:
    """The weighted lexicon, one pattern that finds clauses worth reading, and the marks of a text."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        least = [e for e in lexicon if not any(e[:n] in lexicon for n in range(LEAST_STEM, len(e)))]
        by_first: dict[str, list[str]] = {}
        quotes = "".join(sorted({e[0] for e in lexicon} & QUOTES))
        for e in sorted(e for e in {*least, *(w + "$" for w in THREATS)} if e[0] not in QUOTES):
            rest = re.escape(e[1:-1]) + f"(?!{_LETTER})" if e.endswith("$") else re.escape(e[1:])
            by_first.setdefault(re.escape(e[0]), []).append(rest)
        entries = [f"{first}(?:{'|'.join(rests)})" for first, rests in by_first.items()]
        self.trigger = re.compile(rf"(?=[{''.join(by_first)}])(?<!{_LETTER})(?:{'|'.join(entries)})"
                                  + (f"|[{quotes}]" if quotes else ""))

    def symbol(self, token: str) -> tuple[int, float]:
        """The symbol of a word and the weight of an insult."""
        weight = max(map(self.lexicon.get, prefixes(token), [0.0] * (len(token) + 1)), default=0.0)
        if weight:
            return INSULT, weight
        for members, symbol in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION),
                                (REPORTS, REPORT), (QUOTES, QUOTE)):
            if token in members:
                return symbol, HEAVIEST / 2
        return OTHER, 0.0

    def marks(self, text: str | None) -> list[float]:
        """Summed weights of the matches of every mark, and the length of the text."""
        sums = [0.0] * len(MARKS)
        low = (text or "").lower()
        hit, done = self.trigger.search(low), 0
        while hit:
            begin = max(done - 1, *(low.rfind(c, done, hit.start()) for c in ".!?;:\n")) + 1
            clause = _CLAUSE.match(low, begin)
            done = clause.end()
            read = [self.symbol(t) for t in _TOKEN.findall(clause.group())]
            for place, mark in mark_clause([s for s, _ in read]):
                sums[mark] += read[place][1]
            hit = self.trigger.search(low, max(clause.end(), hit.end()))
        return [round(x, 6) for x in sums] + [float(len(low))]


def features(marks) -> np.ndarray:
    """A constant, the damped weights of the marks, the damped length."""
    m = np.asarray(marks, float).reshape(-1, len(MARKS) + 1)
    return np.hstack([np.ones((len(m), 1)), np.log2(1.0 + m[:, :-1] / 3), np.log2(1.0 + m[:, -1:] / 500)])


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, held to the prior weights where data are silent."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + PRIOR_STRENGTH * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(marks, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(marks) @ weights, -35, 35)))


def _entry_counts(batches):
    """(text, label, class) -> (entry, class, toxic, clean): documents that have a word or stem, summed
    over a task's rows where the class is null, HELD_ENTRIES at a time; for a class, once every 128 rows."""
    toxic, clean = Counter(), Counter()

    def rows(entries, node, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(entries, pa.string()), pa.array(node, pa.int64()), pa.array(a, pa.int64()),
             pa.array(b, pa.int64())], ["entry", "class", "toxic", "clean"])

    def counted():
        entries = list(toxic | clean)
        made = rows(entries, [None] * len(entries), [toxic[e] for e in entries], [clean[e] for e in entries])
        toxic.clear()
        clean.clear()
        return made

    for x in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
        if len(toxic) + len(clean) > HELD_ENTRIES:
            yield counted()
        shared: dict[tuple[int, int], set[str]] = {}
        for text, label, node in zip(*(c.to_pylist() for c in x.columns)):
            own = {e for w in set(_TOKEN.findall((text or "").lower())) for e in prefixes(w)}
            if node is None:
                (toxic if label else clean).update(own)
            else:
                shared.setdefault((node, int(bool(label))), set()).update(own)
        for (node, label), own in shared.items():
            n = len(own)
            yield rows(list(own), [node] * n, [label] * n, [1 - label] * n)
    yield counted()


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(text, y, class, alone) for (text, y): the near-duplicate class of every text, by the links of
    op3, and whether it is the only row of it.  Texts without a word are one class."""
    found, f = annotate(rows, ["text"], _prints, "node long")
    known = cut(found.select("text", "y", F.coalesce(f"{f}.node", F.lit(0)).alias("node")), "toxicity")
    groups = near_links(rows)[0].select(F.col("node").alias("k"), "root")
    nodes = known.groupBy("node").agg(F.count("*").alias("n")).join(groups, F.col("node") == F.col("k"), "left") \
        .select("node", "n", F.coalesce("root", "node").alias("class"))
    size = nodes.groupBy("class").agg(F.sum("n").alias("size"))
    of = cut(nodes.join(size, "class").select(F.col("node").alias("k"), "class", (F.col("size") == 1).alias("alone")),
             "toxicity")                                    # a bounded sample
    return known.join(F.broadcast(of), F.col("node") == F.col("k")).select("text", "y", "class", "alone")


def choose_lexicon(entries: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the entries (entry, toxic, clean) that are more frequent in toxic texts than chance
    over all entries allows; where a longer entry has nearly the same texts, the shorter goes.  All
    counts are of different texts."""
    rate = n_toxic / max(1, n_toxic + n_clean)
    if not 0 < rate < 1 or not entries:
        return {}
    bar = 2 * np.log(max(2, len(entries)))
    good = {}
    for e, a, b in entries:
        share = a / (a + b)
        gain = a * np.log(share / rate) + (b * np.log((1 - share) / (1 - rate)) if b else 0)
        if share >= min(LIFT * rate, 0.9) and 2 * gain > bar:
            good[e] = (a, float(np.clip(np.log((a + 0.5) / (n_toxic + 1) * (n_clean + 1) / (b + 0.5)),
                                        0.5, HEAVIEST)))
    said = {}                      # documents of the best entry that is one step longer
    for e, (a, _) in good.items():
        shorter = e[:-1][:LONGEST_STEM] if e.endswith("$") else e[:-1]
        said[shorter] = max(said.get(shorter, 0), a)
    return {e: w for e, (a, w) in good.items() if said.get(e, 0) < 0.98 * a}


def held_out(id_col: str):
    """Rows that are never learned from; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> tuple[Grammar, np.ndarray]:
    """The grammar and its weights from at most about ``train_docs`` labelled documents that are
    not held out, taken by a hash of the id.  Lexicon entries are counted over different texts: a
    near-duplicate class counts once among the toxic and once among the clean, with all its words.
    Without labels the prior weights and the general lists remain."""
    own = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y")) \
        .where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y")).where(~held_out("i"))
    n = own.count()
    if n > train_docs:
        own = own.where(F.pmod(F.xxhash64("i", F.lit("train")), F.lit(1 << 30)) < int((1 << 30) * train_docs / n))
    rows = cut(docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("text"))
               .join(own, F.col("k") == F.col("i")).select("text", "y"), "toxicity")
    texts = distinct_texts(rows)
    total = dict(texts.select("class", "y").distinct().groupBy("y").count().collect())
    n_toxic, n_clean = sum(n for y, n in total.items() if y), total.get(0, 0)
    once = F.col("class").isNotNull()
    counted = texts.select("text", "y", F.when(~F.col("alone"), F.col("class")).alias("class")) \
        .mapInArrow(_entry_counts, "entry string, class long, toxic long, clean long").groupBy("entry", "class") \
        .agg(*[F.when(once, F.max(c)).otherwise(F.sum(c)).alias(c) for c in ("toxic", "clean")]) \
        .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    table = counted.where(F.col("toxic") >= LEAST_DOCS).select("entry", "toxic", "clean")
    grammar = Grammar(choose_lexicon([tuple(r) for r in table.collect()], n_toxic, n_clean))
    found, f = annotate(rows, ["text"], lambda c: [[grammar.marks(t) for t in c.to_pylist()]], "m array<double>")
    seen = found.select("y", f"{f}.m").collect()             # a bounded sample
    if not seen:
        return grammar, PRIOR
    return grammar, fit_weights(features([r.m for r in seen]), np.array([float(r.y) for r in seen]))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", **options) -> tuple[DataFrame, str]:
    """The documents with a struct (its name comes second): score (0 to 1), predicted, and the
    weights of the marks.

    A null or empty text has no mark and the score of the constant; a null id is scored alike and
    never trained on; rows are scored each by itself, so repeated ones score the same; a document
    labelled twice counts as toxic if one label says so; all columns pass through; an empty table
    stays empty.
    """
    grammar, weights = fit(docs, labels, id_col, text_col, label_col, **options)

    def run(column):
        marks = [grammar.marks(t) for t in column.to_pylist()]
        s = scores(marks, weights)
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), marks]

    return annotate(docs, [text_col], run, "score double, predicted int, marks array<double>")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored, f = score_toxicity(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), f"{f}.score", f"{f}.predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, columns as they were."""
    scored, f = score_toxicity(docs, labels)
    return scored.where(F.col(f"{f}.predicted") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
