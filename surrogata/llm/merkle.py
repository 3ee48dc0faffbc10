"""Merkle manifest of a table: a hash tree a group, a tree over their roots, a proof a row.

Leaves of a group are numbered by one range sort and cut into aligned blocks of BLOCK leaves, so a
block is a whole subtree.  Inside a block the tree is persistent: a tampered leaf makes a version
that copies its ancestors and shares all other nodes.  Roots of blocks are the leaves of the next
levels, block by block again, until each group has one node; a version goes on above its block
along the path that all rows of the block share, wherever those blocks were built.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

BITS = 10
BLOCK = 1 << BITS
RUN_SHIFT = 43             # a run is the task's number and its place among the task's runs
NONE, LEFT, RIGHT = 0, 1, 2            # where the sibling of a step stands


def node_hash(*digests: bytes) -> bytes:
    """Hash of the digests as hex text, one after another."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


class PathCopyTree:
    """A persistent binary hash tree.  Nodes are only added: a node is (digest, left, right), right is
    -1 for a run of one, both are -1 for a leaf.  A version is the number of its root."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.digest, self.left, self.right = list(leaves), [-1] * len(leaves), [-1] * len(leaves)
        self.levels = levels
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._add(row[i], row[i + 1] if i + 1 < len(row) else -1) for i in range(0, len(row), 2)]
        [self.root] = row

    def _add(self, left: int, right: int) -> int:
        own = [self.digest[left]] + ([self.digest[right]] if right >= 0 else [])
        self.digest.append(node_hash(*own))
        self.left.append(left)
        self.right.append(right)
        return len(self.digest) - 1

    def path(self, place: int, root: int | None = None) -> list[int]:
        """Nodes from the root to a leaf."""
        out = [self.root if root is None else root]
        for level in range(self.levels - 1, -1, -1):
            out.append((self.right if place >> level & 1 else self.left)[out[-1]])
        return out

    def replace(self, place: int, digest: bytes, root: int | None = None) -> int:
        """The version of ``root`` with another leaf: copies of the leaf's ancestors, nothing else."""
        old = self.path(place, root)
        self.digest.append(digest)
        self.left.append(-1)
        self.right.append(-1)
        new = len(self.digest) - 1
        for level, parent in enumerate(reversed(old[:-1])):
            new = self._add(self.left[parent], new) if place >> level & 1 else self._add(new, self.right[parent])
        return new

    def proof(self, place: int) -> bytes:
        """Siblings from the leaf to the root, a step each: its side, and its digest if it has one."""
        out, old = [], self.path(place)
        for level, parent in enumerate(reversed(old[:-1])):
            if place >> level & 1:
                out.append(bytes([LEFT]) + self.digest[self.left[parent]])
            elif self.right[parent] >= 0:
                out.append(bytes([RIGHT]) + self.digest[self.right[parent]])
            else:
                out.append(bytes([NONE]))
        return b"".join(out)


def steps(proof: bytes):
    at = 0
    while at < len(proof):
        side = proof[at]
        size = 0 if side == NONE else 32
        yield side, proof[at + 1:at + 1 + size]
        at += 1 + size


def fold(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, other in steps(proof):
        digest = node_hash(digest) if side == NONE else \
            node_hash(other, digest) if side == LEFT else node_hash(digest, other)
    return digest


def proof_hash(proof: bytes) -> str:
    return hashlib.sha256(b"".join(d.hex().encode() for _, d in steps(proof))).hexdigest()


def _number(batches):
    """Rows ordered by group (first column) -> with the run they are in and their place in it; a run
    ends with the group or the task."""
    run, place, group, seen = (TaskContext.get().partitionId() << RUN_SHIFT) - 1, 0, None, False
    for x in batches:
        runs, places = [], []
        for g in x.column(0).to_pylist():
            if not seen or g != group:
                run, place, group, seen = run + 1, 0, g, True
            runs.append(run)
            places.append(place)
            place += 1
        yield pa.RecordBatch.from_arrays([*x.columns, pa.array(runs, pa.int64()), pa.array(places, pa.int64())],
                                         [*x.schema.names, "run", "place"])


def ranked(rows: DataFrame, group: str, order: list[str], tag: str = "merkle") -> DataFrame:
    """The rows with t (a number of the group, ascending as the groups do, null first), idx (place in
    the group's order) and n (rows of the group).  One range shuffle; then a row a run of a group in a
    task is summed, never a row a row."""
    small_batches(rows.sparkSession)
    names = [group, *[c for c in rows.columns if c != group]]
    ordered = rows.select(*names).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    placed = cut(ordered.mapInArrow(_number, f"{ddl}, run long, place long"), tag)
    runs = placed.groupBy("run").agg(F.first(group).alias("g"), F.count("*").alias("size"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col("run").alias("_run"), F.min("run").over(whole).alias("t"),
                         F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_before"),
                         F.sum("size").over(whole).alias("n"))
    return placed.join(starts, F.col("run") == F.col("_run")).select(
        *names, "t", (F.col("_before") + F.col("place")).alias("idx"), "n")


def _levels(n: int) -> int:
    return min(BITS, (n - 1).bit_length())


def _blocks(extra: list[str], versions: bool):
    """Nodes ordered by (t, block, idx), columns t, idx, n, digest, changed and others -> with their
    proof inside the block, the root that they or their changed leaf give, and the block's root."""

    def finish(rows):
        n = rows[0][2]
        tree = PathCopyTree([r[3] for r in rows], _levels(n))
        top = tree.digest[tree.root]
        for place, r in enumerate(rows):
            proof = tree.proof(place)
            folded = None
            if versions:
                folded = fold(r[3], proof) if r[4] is None else tree.digest[tree.replace(place, r[4])]
            yield (*r, proof, folded, top)

    def run(batches):
        names, kinds, rows, at = None, None, [], None
        for x in batches:
            names = [*x.schema.names, "proof", "folded", "top"]
            kinds = [*x.schema.types, pa.binary(), pa.binary(), pa.binary()]
            out = []
            for r in zip(*(c.to_pylist() for c in x.columns)):
                key = (r[0], r[1] >> BITS)
                if key != at:
                    if rows:
                        out += finish(rows)
                    rows, at = [], key
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*finish(rows)), kinds)], names)
    return run


def blocks(nodes: DataFrame, versions: bool, tag: str = "merkle") -> DataFrame:
    """One pass of BITS levels over nodes (t, idx, n, digest, changed, ...)."""
    extra = nodes.columns[5:]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    block = F.shiftright("idx", BITS)
    ordered = nodes.repartition(F.col("t"), block).sortWithinPartitions("t", "idx")
    return cut(ordered.mapInArrow(_blocks(extra, versions), f"{ddl}, proof binary, folded binary, top binary"), tag)


def tops(rows: DataFrame) -> DataFrame:
    """The nodes above the blocks."""
    return rows.where(F.col("idx") % BLOCK == 0).select(
        "t", F.shiftright("idx", BITS).alias("idx"), F.shiftright(F.col("n") + (BLOCK - 1), BITS).alias("n"),
        F.col("top").alias("digest"), F.lit(None).cast("binary").alias("changed"))


def climb(nodes: DataFrame, tag: str = "merkle") -> DataFrame:
    """(t, idx, proof, root) of nodes (t, idx, n, digest, changed): all levels up to one node a group,
    BITS of them at a time; a round has a row a block of the round before."""
    most = nodes.agg(F.max("n")).first()[0]
    if most is None or most <= 1:
        return nodes.select("t", "idx", F.lit(b"").alias("proof"), F.col("digest").alias("root"))
    rows = blocks(nodes, False, tag)
    above = climb(tops(rows), tag).toDF("_t", "_idx", "_proof", "_root")
    return rows.join(above, (F.col("t") == F.col("_t")) & (F.shiftright("idx", BITS) == F.col("_idx"))) \
        .select("t", "idx", F.concat("proof", "_proof").alias("proof"), F.col("_root").alias("root"))


def encoded(column: str, value: Column | None = None) -> Column:
    """Byte count, colon and value of a column as text; - if it is null."""
    text = (F.col(f"`{column}`") if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def manifest(docs: DataFrame, id_col: str, group_col: str, columns: list[str],
             tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, grp, leaf, subroot, root, proof, folded), a row a row: digests as 32 bytes, proof as in
    PathCopyTree.proof from the leaf through the group's root to the root of all groups.

    A leaf hashes the named columns in order; groups are ordered by value, null first, leaves by id
    (null first), rows of one id by digest.  ``tampered`` gives other values of some columns for the
    rows of ``where``: ``folded`` is the root of the version with that leaf, and for all other rows
    the root that leaf and proof give.  Columns may have any names; an empty table gives none.
    """
    def hashed(values):
        return F.unhex(F.sha2(F.concat(*[encoded(c, values.get(c)) for c in columns]), 256))

    changed = F.lit(None).cast("binary")
    if tampered:
        changed = F.when(where, hashed(tampered))
    leaves = docs.select(F.col(f"`{group_col}`").cast("string").alias("grp"), F.col(f"`{id_col}`").alias("id"),
                         hashed({}).alias("digest"), changed.alias("changed"))
    nodes = ranked(leaves, "grp", ["id", "digest"]).select("t", "idx", "n", "digest", "changed", "grp", "id")
    rows = blocks(nodes, True)
    paths = cut(climb(tops(rows)), "merkle")
    subroots = paths.where("idx = 0").select(F.lit(0).alias("one"), F.col("t").alias("g"), F.col("root").alias("digest"))
    over = ranked(subroots, "one", ["g"]).select("t", "idx", "n", "digest", F.lit(None).cast("binary").alias("changed"), "g")
    over = cut(over, "merkle")
    roots = climb(over.drop("g")).toDF("_0", "_at", "_up", "_root")
    groups = over.select("g", "idx").join(roots, F.col("idx") == F.col("_at")).select("g", "_up", "_root")
    upper = paths.join(groups, F.col("t") == F.col("g")).select(
        F.col("t").alias("_t"), F.col("idx").alias("_block"), F.concat("proof", "_up").alias("_proof"),
        F.col("root").alias("subroot"), F.col("_root").alias("root"))
    joined = rows.join(upper, (F.col("t") == F.col("_t")) & (F.shiftright("idx", BITS) == F.col("_block")))
    told = joined.select("id", "grp", F.col("digest").alias("leaf"), "subroot", "root", "proof", "_proof", "folded")
    kind = docs.schema[id_col].dataType.simpleString()
    return told.mapInArrow(_above, f"id {kind}, grp string, leaf binary, subroot binary, root binary, proof binary, "
                                   "folded binary")


def _above(batches):
    """The versions go on from the root of their block to the root of all."""
    for x in batches:
        if not x.num_rows:
            continue
        own, upper, folded = (x.column(i).to_pylist() for i in (5, 6, 7))
        yield pa.RecordBatch.from_arrays(
            [*x.columns[:5], pa.array([a + b for a, b in zip(own, upper)], pa.binary()),
             pa.array([fold(d, p) for d, p in zip(folded, upper)], pa.binary())],
            ["id", "grp", "leaf", "subroot", "root", "proof", "folded"])


def _report(batches):
    for x in batches:
        leaf, subroot, root, proof, folded = (x.column(i).to_pylist() for i in range(2, 7))
        hexed = [pa.array([d.hex() for d in c], pa.string()) for c in (leaf, subroot, root)]
        yield pa.RecordBatch.from_arrays(
            [x.column(0), *hexed, pa.array([proof_hash(p) for p in proof], pa.string()),
             pa.array([d.hex() for d in folded], pa.string()),
             pa.array([a == b for a, b in zip(folded, root)], pa.bool_())],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_report(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the documents, a tree a
    language; rows whose id's crc32 is divisible by 7 are tampered by one more character in n_chars
    (a null n_chars or id stays as it is)."""
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    made = manifest(docs, "doc_id", "lang", COLUMNS, {"n_chars": one_more}, hit)
    return made.mapInArrow(_report, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                    "folded_root string, verified boolean")


SQL = r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS e_id,
         coalesce(strlen(source) || ':' || source, '-') AS e_source,
         coalesce(strlen(lang) || ':' || lang, '-') AS e_lang,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS e_chars,
         coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') AS e_more,
         coalesce(strlen(text) || ':' || text, '-') AS e_text,
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT],
             flatten([[(ord(c) >> b) & 1 for b in range(8)] for c in string_split(doc_id::VARCHAR, '')])),
           lambda a, x: xor(a >> 1, CASE WHEN xor(a & 1, x) = 1 THEN 3988292384 ELSE 0 END))) % 7 = 0 AS hit
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(e_id || e_source || e_lang || e_chars || e_text) AS leaf,
               CASE WHEN hit THEN sha256(e_id || e_source || e_lang || e_more || e_text) END AS changed
        FROM raw)
), up AS (
  SELECT lang, 0 AS l, i, leaf AS d, n FROM leaves
  UNION ALL
  SELECT lang, l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2
  FROM up WHERE n > 1 GROUP BY lang, l, i // 2, n
), subroots AS (
  SELECT lang, l AS height, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i,
         count(*) OVER () AS n
  FROM up WHERE n = 1
), top AS (
  SELECT 0 AS l, i, subroot AS d, n FROM subroots
  UNION ALL
  SELECT l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1
  GROUP BY l, i // 2, n
), root AS (SELECT d AS root, l AS top_height FROM top WHERE n = 1),
own AS (
  SELECT row_number() OVER () AS r, v.*, s.height, s.subroot, s.i AS group_at
  FROM leaves v JOIN subroots s ON v.lang IS NOT DISTINCT FROM s.lang
), siblings AS (
  SELECT o.r, u.l, (o.i >> u.l) & 1 AS is_right, u.d
  FROM own o JOIN up u ON u.lang IS NOT DISTINCT FROM o.lang AND u.l < o.height AND u.i = xor(o.i >> u.l, 1)
  UNION ALL
  SELECT o.r, o.height + t.l, (o.group_at >> t.l) & 1, t.d
  FROM own o JOIN top t ON t.i = xor(o.group_at >> t.l, 1) JOIN root ON t.l < top_height
), proofs AS (SELECT r, sha256(string_agg(d, '' ORDER BY l)) AS proof FROM siblings GROUP BY r),
folds AS (
  SELECT r, 0 AS l, coalesce(changed, leaf) AS d, height + top_height AS steps FROM own, root
  UNION ALL
  SELECT f.r, f.l + 1, sha256(CASE WHEN s.r IS NULL THEN f.d WHEN s.is_right = 1 THEN s.d || f.d ELSE f.d || s.d END),
         f.steps
  FROM folds f LEFT JOIN siblings s ON s.r = f.r AND s.l = f.l WHERE f.l < f.steps
)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.d AS folded_root,
       f.d = root AS verified
FROM own JOIN folds f ON f.r = own.r AND f.l = f.steps LEFT JOIN proofs p ON p.r = own.r, root
"""
