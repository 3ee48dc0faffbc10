"""Near-duplicate documents by MinHash: word 3-grams at a Jaccard of 0.85 and more.

A text's words are hashed, its 3-grams reduced to HASHES minima of universal hash functions, and
texts that share a band of ROWS minima meet in a bucket.  In a bucket their signatures are compared
(pairs whose agreement a pair at 0.85 would reach in all but 1e-9 of cases go on), what remains is
confirmed on the full sets of 3-grams, and the confirmed links are joined into components by
alternating large-star and small-star steps.  Texts with the same words are one class, known by the
md5 of its words.

A pair at exactly 0.85 shares no band with probability (1 - 0.85^5)^25, 4e-7, and is lost by the
signatures with 1e-9; both fall fast above.  Links are exact.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, union_find
from .shingles import text_slices
from .similar import has_bit, needed_bits
from .tokens import mix, span_hashes

WORDS = 3
ROWS, BANDS = 5, 25
HASHES = ROWS * BANDS
SHARE = (85, 100)          # least share of the union that the intersection has
LOST = 1e-9                # probability that signatures drop a pair at that share
BLOCK = 256                # texts of a block; a task holds two
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_LOWER_TABLE = np.frombuffer(_LOWER, np.uint8)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def normal(text: str | None) -> bytes:
    """The words, A-Z in lower case, a blank between two."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())


def least_agreement(hashes: int = HASHES, share: float = SHARE[0] / SHARE[1], lost: float = LOST) -> int:
    """The most equal minima that a pair at the share falls short of with probability below ``lost``."""
    total, m = 0.0, 0
    while True:
        total += comb(hashes, m) * share ** m * (1 - share) ** (hashes - m)
        if total >= lost:
            return m
        m += 1


def word_prints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts, and the bounds of each text's words."""
    folded = _LOWER_TABLE[data]
    word = ~_WHITE[folded]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    some = off[:-1] < off[1:]
    first, last = off[:-1][some], off[1:][some] - 1
    starts[first] = word[first]
    ends[last] = word[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return span_hashes(folded, start, end), np.searchsorted(start, off)


def shingle_prints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 3-gram fingerprints of all texts, ascending within a text, bounds of each text's);
    a text of fewer words has one of all its words, a wordless text none."""
    h, bounds = word_prints(data, off)
    count = np.diff(bounds)
    n = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(len(count)), n)
    at = np.arange(int(n.sum())) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)
    s = np.zeros(len(at), np.uint64)
    size = np.minimum(count, WORDS)[of]
    for k in range(WORDS):
        inside = size > k
        s[inside] += h[at[inside] + k] * _PLACE[k]
    s = mix(s + size.astype(np.uint64))
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[new], of[new]
    return s, np.searchsorted(of, np.arange(len(count) + 1))


def hash_family(k: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Numbers a, b of the functions (a x + b mod 2^64) >> 32 of 32-bit x, a universal family."""
    draw = np.random.default_rng(850_003)
    return draw.integers(0, 1 << 64, k, np.uint64), draw.integers(0, 1 << 64, k, np.uint64)


def minima(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts x HASHES) least hash values; all ones for a text without shingles."""
    a, b = hash_family()
    out = np.full((len(bounds) - 1, HASHES), np.uint32(0xFFFFFFFF))
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    part = max(1, (1 << 15) * len(some) // max(1, len(shingles)))       # texts that fit a cache
    for s in range(0, len(some), part):
        own = some[s:s + part]
        low, high = bounds[own[0]], bounds[own[-1] + 1]
        x, at = shingles[low:high] >> np.uint64(32), bounds[own] - low
        for j in range(HASHES):
            out[own, j] = np.minimum.reduceat(x * a[j] + b[j], at) >> np.uint64(32)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """(texts x BANDS) keys: equal where the minima of that band are."""
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS))
    for r in range(ROWS):
        key = mix(key ^ (sig[:, r::ROWS].astype(np.uint64) + (np.uint64(r) << np.uint64(40))))
    return key.view(np.int64)


def _signed(batches):
    """(doc_id, text) -> (doc_id, key, n, sig), key and sig null for a wordless text."""
    for x in batches:
        texts = x.column(1)
        for at, data, off in text_slices(texts):
            own = texts.slice(at, len(off) - 1).to_pylist()
            shingles, bounds = shingle_prints(data, off)
            n, sig = np.diff(bounds), minima(shingles, bounds)
            keys = [hashlib.md5(normal(t)).digest() if k else None for t, k in zip(own, n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [x.column(0).slice(at, len(own)), pa.array(keys, pa.binary()), pa.array(n, pa.int64()),
                 pa.array([row.tobytes() if k else None for row, k in zip(sig, n.tolist())], pa.binary())],
                ["doc_id", "key", "n", "sig"])


def signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def _band_keys(batches):
    for x in batches:
        if x.num_rows:
            key = bands(signature_rows(x.column(1).to_pylist()))
            node = x.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel()), pa.array(np.repeat(node, BANDS)),
                 pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(node)))], ["bucket", "node", "band"])


def _meet(batches):
    """Groups (bucket, i, j) of ordered rows (bucket, i, j, block, node, band, sig) -> edges (c, p) that
    span what signatures link.  A pair that already met in an earlier band is left out."""
    need = least_agreement()

    def finish(i, j, rows):
        block = np.array([r[0] for r in rows])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return None
        node = np.array([r[1] for r in rows], np.int64)
        sig, band = signature_rows([r[3] for r in rows]), rows[0][2]
        a, b = np.nonzero((sig[left][:, None, :] == sig[right][None, :, :]).sum(-1) >= need)
        a, b = left[a], right[b]
        once = a < b if i == j else a != b
        a, b = a[once], b[once]
        if band and len(a):
            key = bands(sig)[:, :band]
            fresh = ~(key[a] == key[b]).any(1)
            a, b = a[fresh], b[fresh]
        return union_find(node[a], node[b]) if len(a) else None

    def batch(made):
        c, p = (np.concatenate(v) for v in zip(*made))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(p, pa.int64())], ["c", "p"])

    at, rows, made, size = None, [], [], 0
    for x in batches:
        for r in zip(*(c.to_pylist() for c in x.columns)):
            if r[:3] != at:
                if len(rows) > 1 and (found := finish(at[1], at[2], rows)):
                    made.append(found)
                    size += len(found[0])
                    if size > 10_000:
                        yield batch(made)
                        made, size = [], 0
                at, rows = r[:3], []
            rows.append(r[3:])
    if len(rows) > 1 and (found := finish(at[1], at[2], rows)):
        made.append(found)
    if made:
        yield batch(made)


def _by_blocks(members: DataFrame, group: str) -> DataFrame:
    """Members (group, node, ...) in blocks of about BLOCK, a row for each pair of blocks of the group
    that the member's block is in: every two members of a group meet in one pair."""
    sizes = members.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1") \
        .select(F.col(group).alias("_g"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("_nb"))
    own = F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1),
                       lambda k: F.struct(F.least(k, F.col("block")).alias("i"),
                                          F.greatest(k, F.col("block")).alias("j")))
    return members.join(sizes, F.col(group) == F.col("_g")).drop("_g").withColumn("block", own) \
        .withColumn("_pair", F.explode(each)).drop("_nb") \
        .withColumn("i", F.col("_pair.i")).withColumn("j", F.col("_pair.j")).drop("_pair")


def _star(edges: DataFrame) -> DataFrame:
    """For nodes u with neighbours v: (u, v, m), m the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")) \
        .select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def star_components(edges: DataFrame, tag: str = "stars") -> DataFrame:
    """(node, root) of edges (c, p): every node that has an edge and the least node it reaches.

    Large-star hooks a node's greater neighbours to the least of its neighbourhood, small-star its
    lesser ones and itself; in turn they leave a star a component.  A step is an aggregate with
    map-side minima and a join by node that Spark splits where one node has most edges.
    """
    def once(e):
        return e.where("u != v").distinct()

    e = cut(once(edges.select(F.greatest("c", "p").alias("u"), F.least("c", "p").alias("v"))), tag)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(once(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), tag)
        small = _star(large)
        lesser = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = small.select("u", F.col("m").alias("v"))
        e = cut(once(lesser.unionByName(own)), tag)
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        deep = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")) \
            .where("up > 1 or up > 0 and down > 0")
        if deep.isEmpty():
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _needed(bits):
    """(text) -> (key, low, text) of the texts whose key has its bit, each once a slice."""
    def run(batches):
        for x in batches:
            out = {}
            for t in x.column(0).to_pylist():
                words = normal(t)
                if words:
                    out[hashlib.md5(words).digest()] = words
            keys = list(out)
            if not keys:
                continue
            low = np.frombuffer(b"".join(k[:8] for k in keys), ">i8").astype(np.int64)
            keep = np.flatnonzero(has_bit(bits.value, low)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in keep], pa.binary()),
                                              pa.array([out[keys[k]] for k in keep], pa.binary())], ["k", "words"])
    return run


def shingle_set(words: bytes) -> set[bytes]:
    """The 3-grams of a normal text, as they are."""
    w = words.split()
    return {b" ".join(w[k:k + WORDS]) for k in range(max(1, len(w) - WORDS + 1))} if w else set()


def _confirm(batches):
    """Groups (root, i, j) of ordered rows (root, i, j, block, node, n, sig, words) -> edges (c, p) that
    span the pairs at the threshold, on full sets.  Pairs already joined in the group are not needed."""
    need = least_agreement()

    def finish(i, j, rows):
        block = np.array([r[0] for r in rows])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return []
        sig, n = signature_rows([r[3] for r in rows]), np.array([r[2] for r in rows], np.int64)
        agree = (sig[left][:, None, :] == sig[right][None, :, :]).sum(-1)
        small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
        a, b = np.nonzero((agree >= need) & (SHARE[1] * small >= SHARE[0] * large))
        agree = agree[a, b]
        a, b = left[a], right[b]
        once = a < b if i == j else a != b
        a, b, agree = a[once], b[once], agree[once]
        order = np.argsort(-agree, kind="stable")
        parent, sets, out = list(range(len(rows))), {}, []

        def root(v):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for u, v in zip(a[order].tolist(), b[order].tolist()):
            ru, rv = root(u), root(v)
            if ru == rv:
                continue
            for w in (u, v):
                if w not in sets:
                    sets[w] = shingle_set(rows[w][4])
            inner = len(sets[u] & sets[v])
            if SHARE[1] * inner >= SHARE[0] * (len(sets[u]) + len(sets[v]) - inner):
                parent[rv] = ru
                out.append((rows[u][1], rows[v][1]))
        return out

    def batch(made):
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*made)], ["c", "p"])

    at, rows, made = None, [], []
    for x in batches:
        for r in zip(*(c.to_pylist() for c in x.columns)):
            if r[:3] != at:
                if len(rows) > 1:
                    made += finish(at[1], at[2], rows)
                    if len(made) > 10_000:
                        yield batch(made)
                        made = []
                at, rows = r[:3], []
            rows.append(r[3:])
    if len(rows) > 1:
        made += finish(at[1], at[2], rows)
    if made:
        yield batch(made)


def confirmed_links(docs: DataFrame, classes: DataFrame, tag: str) -> DataFrame:
    """Edges (c, p) between classes (node, key, n, sig) that span all links of their texts."""
    spark = docs.sparkSession
    keys = classes.select("node", "sig").mapInArrow(_band_keys, "bucket long, node long, band int")
    met = cut(_by_blocks(keys, "bucket"), tag)
    sigs = classes.select(F.col("node").alias("_node"), "sig")
    rows = met.join(sigs, F.col("node") == F.col("_node")) \
        .select("bucket", "i", "j", "block", "node", "band", "sig")
    near = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j") \
        .mapInArrow(_meet, "c long, p long")
    groups = star_components(near, tag)
    known = classes.select(F.col("node").alias("_node"), "key", "n", "sig")
    members = cut(_by_blocks(groups, "root").join(known, F.col("node") == F.col("_node")).drop("_node"), tag)
    low = F.conv(F.substring(F.hex("key"), 1, 16), 16, -10).cast("long")
    bits = spark.sparkContext.broadcast(needed_bits(members.select(low.alias("node"))))
    texts = docs.select(F.col("text")).where("text is not null").mapInArrow(_needed(bits), "k binary, words binary")
    texts = texts.dropDuplicates(["k"])
    full = members.join(texts, F.col("key") == F.col("k")) \
        .select("root", "i", "j", "block", "node", "n", "sig", "words")
    links = cut(full.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
                .mapInArrow(_confirm, "c long, p long"), tag)
    bits.destroy()
    return links


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row a document.

    Words are runs without white space, A-Z as a-z; a document's set is its distinct 3-grams of
    words, a shorter one's the whole sequence.  Documents are linked if their sets share 85 of 100 of
    the union; component_id is the least id that links lead to, the document's own included; kept is
    doc_id = component_id.  A null, empty or wordless text has an empty set, no link and its own id.
    Rows with a null id take part: their component has the least id that is not null, or null, which
    then counts as equal to theirs.  Repeated rows are copies; other columns are not looked at; an
    empty table gives none.
    """
    tag = "minhash"
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    rows = cut(d.mapInArrow(_signed, "doc_id long, key binary, n long, sig binary"), tag)
    classes = rows.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), tag)
    roots = cut(star_components(confirmed_links(d, classes, tag), tag), tag)
    member = classes.select("key", "id", "node").join(roots.withColumnRenamed("node", "_node"),
                                                      F.col("node") == F.col("_node"))
    least = member.groupBy("root").agg(F.min("id").alias("component")).withColumnRenamed("root", "_root")
    linked = member.join(least, F.col("root") == F.col("_root")).select(F.col("key").alias("_key"), "component")
    told = classes.join(linked, F.col("key") == F.col("_key"), "left").select(
        F.col("key").alias("_key"), F.when(F.col("_key").isNull(), F.col("id")).otherwise(F.col("component"))
        .alias("component"))
    told = cut(told, tag)
    out = rows.select("doc_id", "key", "n").join(told, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
