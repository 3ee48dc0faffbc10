"""Token-id files: Re-Pair grammars per shard, with random access by document.

A shard holds the ids of consecutive documents.  Frequent pairs of neighbouring symbols are
replaced by nonterminals, the most frequent first, until no pair occurs LEAST_COUNT times (a rule
takes 12 bytes and saves 4 an occurrence); no pair crosses the end of a document, so a document is
a range of symbols.  The body of a shard:

    8 bytes RPAIR001, then little-endian 64-bit counts: documents, rules, symbols, first nonterminal
    documents x int64 id, documents x uint8 (1: the id is null), documents x int64 ids,
    (documents + 1) x int64 first symbol, rules x 2 uint32, rules x uint32 expansion length,
    symbols x uint32

Bodies are cells of a Parquet table written by Spark's committer below the shared folder, so a
task that is run again leaves nothing twice.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, small_batches
from .tokens import default_vocabulary, encode_texts, mix, room

MAGIC = b"RPAIR001"
SHARD_IDS = 1 << 19        # ids after which a shard is closed
LEAST_COUNT = 4            # occurrences that make a pair worth a rule
SHARDS = "part int, shard int, n_docs long, n_ids long, body binary"
DECODED = "doc_id long, part int, shard int, place long, shard_start long, n_tokens long, ids binary"


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits in order, and where each was.  Key and place are sorted as one number
    where they fit, which is several times faster than an indirect sort."""
    place = max(1, int(len(key)).bit_length())
    if bits + place > 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort((key << np.uint64(place)) | np.arange(len(key), dtype=np.uint64))
    return both >> np.uint64(place), (both & np.uint64((1 << place) - 1)).astype(np.int32)


class _Pairs:
    """Pairs of neighbouring symbols that occur often enough: their symbols, how many places they
    still have, and where those places lie in one list.  Pairs are only added and counted down."""

    def __init__(self, bits: int):
        self.bits = bits                   # of a symbol
        self.n = self.used = 0
        self.symbols = np.zeros(1024, np.uint64)
        self.count, self.low, self.size = (np.zeros(1024, np.int64) for _ in range(3))
        self.places = np.zeros(1024, np.int32)

    def add(self, pair_at: np.ndarray, places: np.ndarray, symbols: np.ndarray, after: np.ndarray,
            least: int) -> None:
        """Take in the pairs that begin at the places, all of them new."""
        key, order = _ordered((symbols[places].astype(np.uint64) << np.uint64(self.bits)) | symbols[after[places]],
                              2 * self.bits)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        often = size >= least
        own, size, key = places[order[np.repeat(often, size)]], size[often], key[start[often]]
        low = np.uint64((1 << self.bits) - 1)
        k, u = self.n, self.used
        for name, more in (("symbols", (key >> np.uint64(self.bits) << np.uint64(32)) | (key & low)), ("count", size), ("size", size), ("low", u + np.cumsum(size) - size)):
            column = room(getattr(self, name), k, len(key))
            column[k:k + len(key)] = more
            setattr(self, name, column)
        self.places = room(self.places, u, len(own))
        self.places[u:u + len(own)] = own
        pair_at[places] = -1
        pair_at[own] = np.repeat(np.arange(k, k + len(key), dtype=np.int32), size)
        self.n, self.used = k + len(key), u + len(own)

    def places_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[chosen]
        at = np.repeat(self.low[chosen] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.places[at], np.repeat(np.arange(len(chosen), dtype=np.int32), size)


def _apart(which: np.ndarray, joined: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places of pairs to replace, given whether a place shares a symbol with the one
    after it.  Of a run of one pair every second place, from the left; of different pairs the one of
    least rank, then again among those left, so equal passages are cut alike wherever they stand."""
    n = len(which)
    step = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = ~joined | (which[1:] != which[:-1])
    left = np.flatnonzero((step - np.maximum.accumulate(np.where(head, step, 0))) & 1 == 0)
    out = np.zeros(n, bool)
    touches = np.append(joined, False)
    while len(left):
        r = rank[which[left]]
        near = touches[left[:-1]] & (left[1:] == left[:-1] + 1)
        best = np.ones(len(left), bool)
        best[1:] &= ~near | (r[1:] < r[:-1])
        best[:-1] &= ~near | (r[:-1] < r[1:])
        out[left[best]] = True
        beaten = best.copy()
        beaten[1:] |= near & best[:-1]
        beaten[:-1] |= near & best[1:]
        left = left[~beaten]
    return out


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST_COUNT,
             rounds: int | None = None, rules_a_round: int | None = None):
    """(symbols, first symbol of every document and the end, rules, expansion lengths).

    Pairs are counted once; then, in every round, all pairs with at least half the places of the most
    frequent one are replaced from left to right without overlap, and only the counts of the pairs
    around the replaced places change.  It ends when no pair has ``least`` places, or after ``rounds``
    rounds of at most ``rules_a_round`` rules if a caller sets them.
    """
    n = len(ids)
    symbol = np.append(ids.astype(np.uint32), np.uint32(0))
    last = np.zeros(n + 1, bool)
    last[ends[ends > 0] - 1] = last[n] = True
    alive = np.arange(n + 1) < n
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    pair_at, mark = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
    pairs, made = _Pairs(int(base + n).bit_length()), 0
    rules, length = [np.zeros((0, 2), np.uint32)], np.zeros(1024, np.int64)

    def once(places):
        number = np.arange(len(places), dtype=np.int32)
        mark[places] = number
        return places[mark[places] == number]

    def expanded(x):
        out = np.ones(len(x), np.int64)
        inner = x >= base
        out[inner] = length[x[inner].astype(np.int64) - base]
        return out

    pairs.add(pair_at, np.flatnonzero(~last).astype(np.int32), symbol, after, least)
    while pairs.n and rounds != 0 and (most := int(pairs.count[:pairs.n].max())) >= least:
        count = pairs.count[:pairs.n]
        chosen = np.flatnonzero(count >= max(least, most >> 1))
        if rules_a_round is not None:
            chosen = chosen[np.argsort(-count[chosen], kind="stable")[:rules_a_round]]
        rounds = None if rounds is None else rounds - 1
        at, which = pairs.places_of(chosen)
        live = pair_at[at] == chosen[which]
        at, which = at[live], which[live]
        at, order = _ordered(at.astype(np.uint64), 32)
        at, which = at.astype(np.int32), which[order]
        take = _apart(which, after[at[:-1]] == at[1:], mix(pairs.symbols[chosen]))
        at, which = at[take], which[take]
        enough = np.bincount(which, minlength=len(chosen)) >= max(2, least // 2)
        count[chosen[~enough]] = 0             # the others took its places
        own = enough[which]
        at, which = at[own], which[own]
        if not len(at):
            continue
        key = pairs.symbols[chosen[enough]]
        rule = np.stack([key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        length = room(length, made, len(rule))
        length[made:made + len(rule)] = expanded(rule[:, 0]) + expanded(rule[:, 1])
        rules.append(rule)
        right, left = after[at], before[at]
        left = left[left >= 0]
        left = left[~last[left]]
        gone = pair_at[once(np.concatenate([at, right, left]))]
        count -= np.bincount(gone[gone >= 0], minlength=pairs.n)
        symbol[at] = (base + made + (np.cumsum(enough) - 1)[which]).astype(np.uint32)
        made += len(rule)
        last[at] = last[right]
        alive[right], pair_at[right] = False, -1
        after[at] = after[right]
        before[after[at][after[at] <= n]] = at[after[at] <= n]
        touched = np.concatenate([at, left])
        touched = once(touched[alive[touched]])
        pair_at[touched] = -1
        pairs.add(pair_at, touched[~last[touched]], symbol, after, least)
    s, last = symbol[alive], last[alive]
    sizes = np.diff(np.concatenate([[0], ends]))
    filled = np.concatenate([[0], np.flatnonzero(last) + 1])
    first = np.concatenate([[0], filled[np.cumsum(sizes > 0)]]) if len(ends) else np.zeros(1, np.int64)
    return s, first, np.concatenate(rules), length[:made]


def body(doc_ids: list, count: np.ndarray, ids: np.ndarray, base: int, **options) -> bytes:
    symbols, first, rules, length = compress(ids, np.cumsum(count), base, **options)
    head = np.array([len(doc_ids), len(rules), len(symbols), base], "<i8")
    return b"".join([
        MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(), count.astype("<i8").tobytes(),
        first.astype("<i8").tobytes(), rules.astype("<u4").tobytes(), length.astype("<u4").tobytes(),
        symbols.astype("<u4").tobytes()])


class Shard:
    """A body opened for reading; only the symbols of a document asked for are expanded."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, rules, symbols, self.base = np.frombuffer(data, "<i8", 4, 8).tolist()
        at = 40

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist())]
        self.count, self.first = take("<i8", docs), take("<i8", docs + 1)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.length, self.symbols = take("<u4", rules), take("<u4", symbols)
        self.table = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids that the symbols stand for: rules are undone level by level, in place."""
        s = symbols.astype(np.int64)
        size = np.ones(len(s), np.int64)
        inner = s >= self.base
        size[inner] = self.length[s[inner] - self.base]
        out = np.zeros(int(size.sum()), np.uint32)
        place = np.cumsum(size) - size
        while len(s):
            inner = s >= self.base
            out[place[~inner]] = s[~inner]
            rule = self.rules[s[inner] - self.base].astype(np.int64)
            left, right, at = rule[:, 0], rule[:, 1], place[inner]
            wide = np.ones(len(left), np.int64)
            deep = left >= self.base
            wide[deep] = self.length[left[deep] - self.base]
            s, place = np.concatenate([left, right]), np.concatenate([at, at + wide])
        return out

    def expand_all(self, symbols: np.ndarray) -> np.ndarray:
        """As expand, for many symbols: every rule is expanded once, then copied."""
        if self.table is None:
            rules = np.arange(self.base, self.base + len(self.length), dtype=np.uint32)
            self.table = np.concatenate([np.arange(self.base, dtype=np.uint32), self.expand(rules)])
            self.size = np.concatenate([np.ones(self.base, np.int32), self.length.astype(np.int32)])
            self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        size = self.size[symbols]
        end = np.cumsum(size, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        return self.table[np.repeat(self.start[symbols] - end + size, size) + np.arange(total)]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[i]:self.first[i + 1]])


def _writer(vocabulary: str, end_id: int, shard_ids: int, options: dict):
    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0
        from .tokens import pretoken_ids

        base = max(len(pretoken_ids(vocabulary).bytes_of), end_id + 1)
        docs, counts, held, total = [], [], [], 0

        def close():
            nonlocal shard, total
            data = body(docs, np.concatenate(counts), np.concatenate(held), base, **options)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()),
                 pa.array([len(docs)], pa.int64()), pa.array([total], pa.int64()),
                 pa.array([data], pa.binary())], ["part", "shard", "n_docs", "n_ids", "body"])
            docs.clear(), counts.clear(), held.clear()
            shard, total = shard + 1, 0
            return out

        for x in batches:
            own, texts = x.column(0).to_pylist(), x.column(1).to_pylist()
            for at in range(0, len(own), 256):
                ids, count = encode_texts(texts[at:at + 256], vocabulary)
                with_end = np.insert(ids, np.cumsum(count), np.uint32(end_id))
                docs += own[at:at + 256]
                counts.append(count + 1)
                held.append(with_end)
                total += len(with_end)
                if total >= shard_ids:
                    yield close()
        if docs:
            yield close()
    return run


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = 2, vocabulary: str | None = None, shard_ids: int = SHARD_IDS,
              **options) -> None:
    """Write the ids of every whole text, in ascending order of the document's id, to ``path``.

    A null or empty text is its end id alone; null ids come first; rows with one id follow each
    other, ordered by a hash of the text, so repeated rows stay; other columns are not looked at;
    an empty table writes an empty one.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")) \
        .withColumn("k", F.xxhash64("text"))
    ordered = d.repartitionByRange("id", "k").sortWithinPartitions("id", "k").select("id", "text")
    ordered.mapInArrow(_writer(vocabulary or default_vocabulary(), end_id, shard_ids, options),
                       SHARDS).write.parquet(path)


def _reader(batches):
    for x in batches:
        for part, shard, data in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2)):
            s = Shard(data.as_buffer().to_pybytes())
            ends = np.cumsum(s.count)
            for at in range(0, len(s.doc_ids), 256):
                to = min(len(s.doc_ids), at + 256)
                low = int(ends[at - 1]) if at else 0
                ids = s.expand_all(s.symbols[s.first[at]:s.first[to]]).astype("<u4")
                cell = np.concatenate([[0], ends[at:to] - low]).tolist()
                raw = ids.tobytes()
                n = to - at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids[at:to], pa.int64()), pa.array([part] * n, pa.int32()),
                     pa.array([shard] * n, pa.int32()), pa.array(range(at, to), pa.int64()),
                     pa.array((ends[at:to] - s.count[at:to]).tolist(), pa.int64()),
                     pa.array(s.count[at:to].tolist(), pa.int64()),
                     pa.array([raw[4 * a:4 * b] for a, b in zip(cell, cell[1:])], pa.binary())],
                    ["doc_id", "part", "shard", "place", "shard_start", "n_tokens", "ids"])


def _starts(shards: DataFrame) -> DataFrame:
    """(p, s, before): the ids before each shard.  Summed per writer task, then over the tasks:
    a row a task and a row a shard, never a row a document."""
    sizes = shards.select("part", "shard", "n_ids")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        F.col("part").alias("p"), F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before_part"))
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before_shard", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))) \
        .join(base, F.col("part") == F.col("p")) \
        .select(F.col("part").alias("p"), F.col("shard").alias("s"),
                (F.col("before_part") + F.col("before_shard")).alias("before"))


def read_ids(spark, path: str, ids: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ``start`` counts the ids of
    all documents before it.  ``ids`` may be an expression of the little-endian unsigned 32-bit ids
    that is taken in their place."""
    shards = spark.read.schema(SHARDS).parquet(path)
    decoded = shards.select("part", "shard", "body").mapInArrow(_reader, DECODED)
    taken = decoded.select("doc_id", "part", "shard", "shard_start", "n_tokens",
                           (F.col("ids") if ids is None else ids).alias("ids"))
    return (taken.join(_starts(shards), (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")))
            .select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids"))


def ids_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the files to the shared folder, read them back and digest the ids."""
    spark = docs.sparkSession
    path = scratch(spark, "token-ids")
    write_ids(docs, path, **options)
    return read_ids(spark, path, F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
