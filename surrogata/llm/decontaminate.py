"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are lower-cased (A-Z only) and cut into words of digits, a-z and everything beyond ASCII; the
automaton's symbols are words, so a hit is a range of words and is mapped back to offsets in the
original text.  A text is scanned once.  The items travel to the tasks in shards of at most
SHARD_BYTES of text; items beyond one shard are scanned in further passes, with the hits so far
written to the shared folder in between, so memory is bounded for any benchmark.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, cut

WINDOW = 13
SHARD_BYTES = 1 << 19
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else
              b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
FOUND = ("n_words long, hit_from array<long>, hit_to array<long>, item_ids array<long>, "
         "span_from array<long>, span_to array<long>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WindowAutomaton:
    """All windows of the items, keyed by word numbers; 0 stands for words of no item."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[i:i + window]), set()).add(item)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, who in owners.items():
                self.automaton.add_word(key, (len(key), who))
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Ranges [from, to) of words inside any window, merged, and the items they are of."""
        ranges, items = [], set()
        if self.automaton is None or not words:
            return ranges, items
        numbers = self.numbers
        for end, (n, who) in self.automaton.iter(tuple([numbers.get(w, 0) for w in words])):
            ranges.append((end + 1 - n, end + 1))
            items |= who
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Offsets of the word ranges in the original text."""
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _scanner(items, window: int, last: bool):
    made = []

    def run(texts, before=None):
        if not made:
            made.append(WindowAutomaton(items.value, window))
        held = before.to_pylist() if before is not None else None
        out = [[] for _ in range(6)]
        for i, text in enumerate(texts.to_pylist()):
            words = words_of(text)
            ranges, who = made[0].scan(words)
            if held:
                ranges = merged(ranges + list(zip(held[i]["hit_from"], held[i]["hit_to"])))
                who = who | set(held[i]["item_ids"])
            at = spans(text, ranges) if ranges and last else []
            for column, value in zip(out, (len(words), [a for a, _ in ranges], [b for _, b in ranges],
                                           sorted(x for x in who if x is not None),
                                           [a for a, _ in at], [b for _, b in at])):
                column.append(value)
        return out
    return run


def shards_of(benchmark: DataFrame, item_col: str, text_col: str, shard_bytes: int) -> list[list]:
    """The items, dealt by hash to as many lists as their size asks for."""
    b = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // shard_bytes) + 1
    shard = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [[tuple(r) for r in (b.where(shard == k) if n > 1 else b).toLocalIterator()] for k in range(n)]


def find_overlap(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """The documents with a struct column (its name comes second): n_words, the ranges of hit words
    (hit_from, hit_to), item_ids, and the ranges as offsets in the text (span_from, span_to).

    A null or wordless text has no words and no hits; an item without words is in no document; an
    item with a null id marks words and is not listed; repeated items count once; an empty
    benchmark hits nothing; all columns of the documents pass through.
    """
    spark = docs.sparkSession
    parts = shards_of(benchmark, item_col, item_text_col, shard_bytes)
    columns, name = docs.columns, None
    for k, items in enumerate(parts):
        inputs = [text_col] + ([name] if name else [])
        docs, new = annotate(docs, inputs, _scanner(spark.sparkContext.broadcast(items), window,
                                                    k == len(parts) - 1), FOUND)
        docs, name = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(new)), new
        if k < len(parts) - 1:
            docs = cut(docs, "overlap")
    return docs, name


def judged(docs: DataFrame, benchmark: DataFrame, **options) -> tuple[DataFrame, str]:
    """As find_overlap, with n_hit and contaminated in the struct: a document is contaminated if
    at least a twentieth of its words, and one at least, are hit."""
    found, name = find_overlap(docs, benchmark, **options)
    hit = F.aggregate(F.zip_with(F.col(f"{name}.hit_to"), F.col(f"{name}.hit_from"), lambda a, b: a - b),
                      F.lit(0).cast("long"), lambda s, x: s + x)
    column = F.col(name).withField("n_hit", hit)
    column = column.withField("contaminated", (hit > 0) & (20 * hit >= F.col(f"{name}.n_words")))
    return found.withColumn(name, column), name


def overlap_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found, f = judged(docs.select("doc_id", "text"), benchmark)
    ids = F.array_join(F.sort_array(F.col(f"{f}.item_ids").cast("array<string>")), ",")
    return found.select("doc_id", f"{f}.n_words", f"{f}.n_hit",
                        F.size(f"{f}.item_ids").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), f"{f}.contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    columns = docs.columns
    found, f = judged(docs, benchmark)
    return found.where(~F.col(f"{f}.contaminated")).select(*[F.col(f"`{c}`") for c in columns])


SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT p.r, p.i, p.n, x.item_id
  FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM places) p JOIN windows x ON x.n = p.n AND x.k = p.k
), words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 list_aggregate(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), 'string_agg', ',') AS ids
          FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
