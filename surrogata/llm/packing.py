"""Packing of token ids into sequences: first-fit decreasing on a tournament tree of capacities.

Documents are dealt at random (by a hash) to tasks; a task packs groups of GROUP consecutive
documents, each on its own.  Full sequences are cut from a document's front, its remainder joins
the group.  First fit decreasing places the remainders; what room is left is then filled by cutting
the emptiest sequences of the group, and the last one is cut into powers of two, which need no
padding.  Memory follows GROUP remainders, whatever the size of table, documents or keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import default_vocabulary, encode_texts

GROUP = 8192
SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Tournament tree: leaves are the free room of the bins, a node holds the larger child."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.tree = [room] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """Lowest bin with enough room; takes the room."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        found = at - self.size
        tree[at] -= need
        at //= 2
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            best = left if left > right else right
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Items of every bin; ties keep the order given."""
    tree, bins = CapacityTree(max(1, len(sizes)), room), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = tree.first_fit(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack_group(sizes: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length): all but powers of two are full."""
    bins = [[(i, 0, sizes[i]) for i in b] for b in first_fit_decreasing(sizes, room)]
    fill = [sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -fill[b])
    out, lo, hi = [], 0, len(order) - 1
    while lo < hi:
        b, donor = bins[order[lo]], bins[order[hi]]
        gap = room - fill[order[lo]]
        while gap and donor:
            i, s, n = donor.pop()
            take = min(n, gap)
            if take < n:
                donor.append((i, s, n - take))
            b.append((i, s + n - take, take))
            gap -= take
            fill[order[lo]] += take
            fill[order[hi]] -= take
        if gap:
            hi -= 1
        else:
            out.append(b)
            lo += 1
    rest = bins[order[lo]] if order else []
    total = sum(n for _, _, n in rest)
    while total:
        part = min(room, 1 << (total.bit_length() - 1))
        total -= part
        own = []
        while part:
            i, s, n = rest.pop(0)
            take = min(n, part)
            own.append((i, s, take))
            part -= take
            if take < n:
                rest.insert(0, (i, s + take, n - take))
        out.append(own)
    return out


def _packer(vocabulary: str, room: int, end_id: int, group: int):
    def run(batches):
        serial = TaskContext.get().partitionId() << 40
        held, rows = [], []

        def piece(doc, start, ids, total, sequence, offset):
            rows.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset))

        def flush():
            nonlocal serial
            for sequence in pack_group([len(ids) for _, _, ids, _ in held], room):
                offset = 0
                for i, s, n in sequence:
                    doc, start, ids, total = held[i]
                    piece(doc, start + s, ids[s:s + n], total, serial, offset)
                    offset += n
                serial += 1
            held.clear()

        def batch():
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for x in batches:
            docs, texts = x.column(0).to_pylist(), x.column(1).to_pylist()
            for at in range(0, len(docs), 512):
                ids, count = encode_texts(texts[at:at + 512], vocabulary)
                end = 0
                for doc, n in zip(docs[at:at + 512], count.tolist()):
                    own = np.append(ids[end:end + n], np.uint32(end_id)).astype("<u4")
                    end += n
                    full = (n + 1) // room * room
                    for s in range(0, full, room):
                        piece(doc, s, own[s:s + room], n + 1, serial, 0)
                        serial += 1
                    if full <= n:
                        held.append((doc, full, own[full:].copy(), n + 1))
                    if len(held) >= group:
                        flush()
                yield batch()
        flush()
        yield batch()
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = 1024,
         end_id: int = 0, vocabulary: str | None = None, group: int = GROUP) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    ``ids`` are little-endian unsigned 32-bit.  A null or empty text is its end id alone; a null id
    stays null; repeated rows are packed once each; other columns, whatever their names, are not
    looked at; an empty table gives no row.  ``room`` must be a power of two.
    """
    if room < 1 or room & (room - 1):
        raise ValueError("room must be a power of two")
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    key = F.xxhash64("id", "text")
    dealt = d.withColumn("k", key).repartition("k").sortWithinPartitions("k", "id").select("id", "text")
    return dealt.mapInArrow(_packer(vocabulary or default_vocabulary(), room, end_id, group), SCHEMA)


def packed_digest(docs: DataFrame, **options) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pack(docs, **options).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")
