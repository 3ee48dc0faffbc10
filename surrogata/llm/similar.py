"""Similar pairs without pairs of rows: band keys, union-find, block comparison, exact Jaccard.

Items are fingerprints with a text.  Equal band keys link items into candidate components; a text of
a large component goes to a task for every pair of its dealt blocks, so a large component spreads
over many tasks.  A task compares BLOCK with BLOCK texts at a time and returns counts of links and a
spanning forest, never all pairs.  Dealt blocks are as large as a task can hold, as every one more is
one more copy of the component's texts in the shuffle.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, contract, cut, union_find
from .shingles import STEP_BYTES, signatures

BLOCK = 192                # texts that are compared at once with so many others
DEALT_BLOCKS = 8           # times BLOCK: texts of a dealt block; a task holds two
DEALT_BYTES = 1 << 20      # of a dealt block's texts, where BLOCK texts don't have more
BITS = 1 << 26             # size of the bit map that says whose text is needed
STRIDE = 16                # MinHash values compared between two decisions
TOLERANCE = 1e-6           # posterior probability below which a pair is dropped
HELD_KEYS = 1 << 18        # rows of keys that are held before they are folded or dealt
ROW_KEYS = 32              # keys in a row of dealt keys at most
FEW = 16                   # texts of a group up to which all its pairs are compared exactly at once


def _least_of_keys(key: np.ndarray, node: np.ndarray):
    """(each key once, its least node), and edges from the keys' other nodes to the least one."""
    order = np.argsort(key)
    key, node = key[order], node[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    least = np.minimum.reduceat(node, start)
    head = np.repeat(least, np.diff(np.r_[start, len(key)]))
    other = node != head
    return key[start], least, node[other], head[other]


def _runs(batches):
    """(key, node) of whole keys in any order -> edges that join the nodes of a key.  Rows are folded
    HELD_KEYS at a time, so memory follows a partition's different keys, not its rows."""
    key = node = np.zeros(0, np.int64)
    held, size, bound = [], 0, HELD_KEYS

    def folded():
        nonlocal key, node, held, size, bound
        key, node, c, p = _least_of_keys(*(np.concatenate(x) for x in zip((key, node), *held)))
        held, size, bound = [], 0, max(HELD_KEYS, len(key))
        c, p = union_find(c, p)
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(p)], ["c", "p"])

    for x in batches:
        if x.num_rows:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in x.columns))
            size += x.num_rows
            if size >= bound:
                yield from folded()
    if held:
        yield from folded()


def _deal(key: np.ndarray, node: np.ndarray, bits: int) -> pa.RecordBatch:
    """(deal, pairs): keys with the same first ``bits`` bits and their nodes, as rows of bytes."""
    deal = (key.view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint16)
    order = np.argsort(deal, kind="stable")
    pairs = np.stack([key[order], node[order]], axis=1)
    count = np.bincount(deal, minlength=1 << bits)
    rows = -(-count // ROW_KEYS)
    of = np.repeat(np.arange(1 << bits), rows)
    first = (np.cumsum(count) - count)[of] + ROW_KEYS * (np.arange(len(of)) - (np.cumsum(rows) - rows)[of])
    off = (np.r_[first, len(key)] * 16).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(of.astype(np.int32)),
         pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(off), pa.py_buffer(pairs)])],
        ["deal", "pairs"])


def _dealt(keys, bits: int):
    """The batches (key, node) that ``keys`` makes as rows (deal, pairs), HELD_KEYS at a time."""
    def run(batches):
        held, size = [], 0
        for x in keys(batches):
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in x.columns))
            size += x.num_rows
            if size >= HELD_KEYS:
                yield _deal(*(np.concatenate(c) for c in zip(*held)), bits)
                held, size = [], 0
        if size:
            yield _deal(*(np.concatenate(c) for c in zip(*held)), bits)
    return run


def _undealt(batches):
    """(deal, pairs) -> (key, node)"""
    for x in batches:
        col = x.column(1)
        if len(col):
            kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
            off = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1]
            pairs = np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]].view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "node"])


def _stars(batches):
    """(deal, pairs) of whole deals -> a star forest (c, p) with the components of their keys."""
    yield from contract(_runs(_undealt(batches)))


def candidate_components(texts: DataFrame, keys, tag: str) -> DataFrame:
    """(node, root, n): items that share a key, directly or by others; n items in all.  ``keys`` makes
    batches (key, node) of batches of texts.  Many keys travel in a row; they pass through a task as a
    stream, whatever their number."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(16, (32 * partitions).bit_length())             # some 32 deals a partition
    dealt = texts.mapInArrow(_dealt(keys, bits), "deal int, pairs binary").repartition("deal")
    found = components(dealt.mapInArrow(_stars, "c long, p long"), tag, contracted=True)
    sizes = cut(found.groupBy("root").agg(F.count("*").alias("n")), tag)
    return cut(found.join(sizes, "root").select("node", "root", "n"), tag)


def needed_bits(members: DataFrame) -> np.ndarray:
    """A bit map of fixed size with the bits of all members set; others may share a bit."""
    bit = F.pmod(F.col("node"), F.lit(BITS))
    words = members.groupBy(F.shiftright(bit, 6).cast("int").alias("w")) \
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("b")) \
        .toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def has_bit(bits: np.ndarray, node: np.ndarray) -> np.ndarray:
    bit = np.mod(node, BITS).astype(np.uint64)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


@lru_cache(maxsize=8)
def least_matches(k: int, threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After n compared values, the fewest matches with which a pair goes on.  With a uniform
    prior, P(J >= t | m of n match) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STRIDE, k + 1, STRIDE):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Pairs (left row, right row) that Bayesian pruning leaves: values are compared STRIDE at a
    time, and only pairs still alive are compared further."""
    need = least_matches(sig.shape[1], threshold)
    a = b = None
    for step, least in enumerate(need):
        part = sig[:, step * STRIDE:(step + 1) * STRIDE]
        if a is None:
            match = np.zeros((len(left), len(right)), np.int16)
            for j in range(part.shape[1]):
                match += part[left, j][:, None] == part[right, j][None, :]
            a, b = np.nonzero((match >= least) & (left[:, None] != right[None, :]))
            same = np.array_equal(left, right)
            if same:
                a, b = a[a < b], b[a < b]
            count = match[a, b].astype(np.int32)
            a, b = left[a], right[b]
        else:
            count = count + (part[a] == part[b]).sum(1)
            alive = count >= least
            a, b, count = a[alive], b[alive], count[alive]
        if not len(a):
            break
    return a, b


def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sorted sets."""
    if len(a) < 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)],
                        np.int64)
    rows, row_at = np.unique(np.concatenate([a, b]), return_inverse=True)
    size = np.array([len(sets[i]) for i in rows])
    value, column, count = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True,
                                     return_counts=True)
    of = np.repeat(np.arange(len(rows)), size)
    several = count > 1
    number = np.cumsum(several) - 1
    keep = several[column]
    of, column = of[keep], number[column[keep]]
    inner = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for low in range(0, int(several.sum()), 4096):
        s, e = np.searchsorted(column, [low, low + 4096])
        x = np.zeros((len(rows), 4096), np.float32)
        x[of[s:e], column[s:e] - low] = 1
        inner += x @ x.T
    return inner[row_at[:len(a)], row_at[len(a):]].astype(np.int64)


def few_pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of each of the groups of ``size`` rows that lie behind each other."""
    first = np.cumsum(size) - size
    found = []
    for n in np.unique(size).tolist():
        left, right = np.triu_indices(n, 1)
        at = first[size == n][:, None]
        found.append(((at + left).ravel(), (at + right).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


def exact_links(shingles: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray,
                threshold: tuple[int, int]) -> np.ndarray:
    """Which pairs of texts reach the threshold, by their sets of shingles."""
    up, down = threshold
    value, number = np.unique(shingles, return_inverse=True)
    many = np.int64(max(1, len(value)))
    own = np.sort(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * many + number)
    own = own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own
    start = np.searchsorted(own, np.arange(len(bounds)) * many)
    size = np.diff(start)
    good = np.zeros(len(a), bool)
    able = np.flatnonzero(down * np.minimum(size[a], size[b]) >= up * np.maximum(size[a], size[b]))
    taken = np.cumsum(size[a[able]])
    low = 0
    while low < len(able):                                   # so many pairs that STEP_BYTES shingles are looked up
        high = max(low + 1, int(np.searchsorted(taken, (taken[low - 1] if low else 0) + STEP_BYTES, side="right")))
        x, y = a[able[low:high]], b[able[low:high]]
        n = size[x]
        pair = np.repeat(np.arange(len(x)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[x], n)
        want = own[at] + np.repeat((y - x) * many, n)
        place = np.searchsorted(own, want)
        hit = own[np.minimum(place, len(own) - 1)] == want if len(own) else np.zeros(0, bool)
        inner = np.bincount(pair[hit], minlength=len(x))
        good[able[low:high]] = down * inner >= up * (size[x] + size[y] - inner)
        low = high
    return good


def _in_steps(shingler, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and bounds of texts, of which the shingler gets about STEP_BYTES at once."""
    parts, counts, low, size = [], [], 0, 0
    for k, text in enumerate(texts, 1):
        size += len(text)
        if size >= STEP_BYTES or k == len(texts):
            shingles, bounds, _ = shingler(texts[low:k])
            parts.append(shingles)
            counts.append(np.diff(bounds))
            low, size = k, 0
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _compare(shingler, k: int, threshold: tuple[int, int]):
    """Groups (root, i, j) of ordered rows (root, i, j, block, node, text) -> (node, links, peer).
    Shingles are made for many groups at once, signatures for those of more than FEW texts."""
    up, down = threshold

    def linked(a, b, nodes):
        """Rows of the links between texts a and b."""
        if not len(a):
            return []
        return told(nodes, np.bincount(np.concatenate([a, b]), minlength=len(nodes)), *union_find(nodes[a], nodes[b]))

    def told(nodes, links, c, p):
        some = np.flatnonzero(links)
        if not len(some):
            return []
        return [(np.concatenate([nodes[some], c]), np.concatenate([links[some], np.zeros(len(c), np.int64)]),
                 np.concatenate([nodes[some], p]))]

    def compare(i, j, nodes, block, shingles, bounds):
        sig = signatures(shingles[bounds[0]:bounds[-1]], bounds - bounds[0], k)
        lefts, rights = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sets: list = [None] * len(nodes)
        size, links = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        c = p = np.zeros(0, np.int64)
        for low in range(0, len(lefts), BLOCK):
            for at in range(low if i == j else 0, len(rights), BLOCK):
                a, b = surviving_pairs(sig, lefts[low:low + BLOCK], rights[at:at + BLOCK], up / down)
                if not len(a):
                    continue
                for r in np.unique(np.concatenate([a, b])).tolist():
                    if sets[r] is None:
                        sets[r] = np.unique(shingles[bounds[r]:bounds[r + 1]])
                        size[r] = len(sets[r])
                inner = shared(sets, a, b)
                good = down * inner >= up * (size[a] + size[b] - inner)
                a, b = a[good], b[good]
                if len(a):
                    links += np.bincount(np.concatenate([a, b]), minlength=len(nodes))
                    c, p = union_find(np.concatenate([c, nodes[a]]), np.concatenate([p, nodes[b]]))
        return told(nodes, links, c, p)

    def few(i, j, size, nodes, block, shingles, bounds):
        """The groups of at most FEW texts, all at once; i and j of every row's group."""
        a, b = few_pairs(size)
        asked = (i[a] == j[a]) | (block[a] != block[b])
        a, b = a[asked], b[asked]
        good = exact_links(shingles, bounds, a, b, threshold)
        return linked(a[good], b[good], nodes)

    def finish(groups):
        """Results of whole groups [(key, [(block, node, text)])]."""
        groups = sorted((g for g in groups if len(g[1]) > 1), key=lambda g: len(g[1]) > FEW)
        if not groups:
            return []
        rows = [r for _, own in groups for r in own]
        shingles, bounds = _in_steps(shingler, [r[2] for r in rows])
        block, node = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
        size = np.array([len(own) for _, own in groups])
        small = size[size <= FEW]
        out, at = [], int(small.sum())
        if at:
            i, j = (np.repeat([key[x] for key, _ in groups[:len(small)]], small) for x in (1, 2))
            out += few(i, j, small, node[:at], block[:at], shingles[:bounds[at]], bounds[:at + 1])
        for (_, i, j), own in groups[len(small):]:
            to = at + len(own)
            out += compare(i, j, node[at:to], block[at:to], shingles, bounds[at:to + 1])
            at = to
        if not out:
            return []
        cols = [np.concatenate(x) for x in zip(*out)]
        return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "links", "peer"])]

    def run(batches):
        groups, size = [], 0
        for x in batches:
            for row in zip(*(c.to_pylist() for c in x.columns)):
                if not groups or groups[-1][0] != row[:3]:
                    if size >= STEP_BYTES:
                        yield from finish(groups)
                        groups, size = [], 0
                    groups.append((row[:3], []))
                groups[-1][1].append(row[3:])
                size += len(row[5])
        if groups:
            yield from finish(groups)
    return run


def verified_links(members: DataFrame, texts: DataFrame, shingler, k: int,
                   threshold: tuple[int, int], tag: str, block: int = BLOCK) -> DataFrame:
    """(node, links, peer) of members (node, root, n) with their texts (node, text): parts of the
    number of other members at or above the threshold, and edges that span the linked members."""
    own = cut(texts.dropDuplicates(["node"]).join(members, "node"), tag)
    size = own.where(F.col("n") > block).groupBy("root").agg(F.sum(F.octet_length("text")).alias("bytes"))
    wanted = F.greatest(F.ceil(F.col("n") / F.lit(block * DEALT_BLOCKS)), F.ceil(F.col("bytes") / F.lit(DEALT_BYTES)))
    placed = own.join(size, "root", "left") \
        .withColumn("nb", F.least(F.ceil(F.col("n") / F.lit(block)), wanted).cast("int")) \
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("nb") - 1),
                       lambda x: F.struct(F.least(x, F.col("block")).alias("i"),
                                          F.greatest(x, F.col("block")).alias("j")))
    rows = placed.withColumn("pair", F.explode(each)).select("root", "pair.i", "pair.j", "block", "node", "text")
    ordered = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return cut(ordered.mapInArrow(_compare(shingler, k, threshold), "node long, links long, peer long"), tag)


def linked_components(links: DataFrame, tag: str) -> DataFrame:
    """(node, root) of the verified links."""
    return components(links.where("node != peer").select(F.col("node").alias("c"), F.col("peer").alias("p")),
                      tag)
