"""Helpers shared by the corpus operators: tables, written cuts of the lineage, union-find."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from surrogata.session import checkpoint_dir


BATCH_ROWS = "1000"
HELD_EDGES = 1 << 14       # edges that are held before they are folded


def small_batches(spark: SparkSession) -> None:
    """Texts are long: hand Python BATCH_ROWS rows at a time unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_with_their_query(spark: SparkSession):
    """Shuffle files go when the query that made them has ended.  Else they stay until the driver's
    collector meets their handles, which in a long job have grown old: all its shuffles pile up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lost executors redo no earlier stage."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, tag)
    with shuffles_end_with_their_query(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the table has (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def annotate(df: DataFrame, inputs: list[str], fn, fields: str, name: str = "_found") -> tuple[DataFrame, str]:
    """The table with one more struct column of the given DDL fields, and that column's name.
    ``fn`` gets the Arrow arrays of the input columns and returns an Arrow array a field; all other
    columns pass through whatever their names are."""
    small_batches(df.sparkSession)
    [name] = fresh(df, name)
    inner = StructType.fromDDL(fields)
    schema = StructType([*df.schema.fields, StructField(name, inner)])
    at = [df.columns.index(c) for c in inputs]
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in inner.fields]

    def run(batches):
        for x in batches:
            if not x.num_rows:
                continue
            arrays = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, k)
                      for a, (_, k) in zip(fn(*[x.column(i) for i in at]), kinds)]
            made = pa.StructArray.from_arrays(arrays, fields=[pa.field(*k) for k in kinds])
            yield pa.RecordBatch.from_arrays([*x.columns, made], [*x.schema.names, name])

    return df.mapInArrow(run, schema), name


def offsets_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column without copying; a null text is empty."""
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    buffers = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(buffers[1], kind)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the edges: (node, least node of its component) for every node that is not
    the least of its own."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    u, v = flat[:len(a)], flat[len(a):]
    while True:
        ru, rv = parent[u], parent[v]
        low, high = np.minimum(ru, rv), np.maximum(ru, rv)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    own = parent != np.arange(len(nodes))
    return nodes[own], nodes[parent[own]]


def contract(batches):
    """Edges (c, p) of a partition -> a star forest with the same components.  Edges are folded
    in as they come, so memory follows the nodes of the partition, not its edges."""
    a = b = np.zeros(0, np.int64)
    held, size, seen = [], 0, False
    for x in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in x.columns[:2]))
        size += x.num_rows
        seen = True
        if size >= max(HELD_EDGES, len(a)):
            a, b = union_find(*(np.concatenate(c) for c in zip((a, b), *held)))
            held, size = [], 0
    if seen:
        a, b = union_find(*(np.concatenate(c) for c in zip((a, b), *held)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["c", "p"])


def _down(edges: DataFrame) -> DataFrame:
    return (edges.select(F.greatest("c", "p").alias("c"), F.least("c", "p").alias("p"))
            .where("c != p"))


SALTS = 4                  # parts that the children of one node are dealt to


def _hook(batches):
    """Rows (x, s, kind, v) ordered by all columns; kind 0: v is a parent of x, kind 1: v is a child
    of x -> edges (c, p, moved).  A node's least parent r is its first row; its children and its
    other parents are hooked to r.  Rows pass as a stream; only r is carried along."""
    x0 = s0 = r0 = None
    for b in batches:
        if not b.num_rows:
            continue
        x, s, kind, v = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        new = np.r_[x0 is None or x[0] != x0 or s[0] != s0, (x[1:] != x[:-1]) | (s[1:] != s[:-1])]
        start = np.flatnonzero(new)
        least = np.where(kind[start] == 0, v[start], x[start])
        head = start[0] if len(start) else len(x)
        r = np.concatenate([np.full(head, r0 if head else 0, np.int64),
                            np.repeat(least, np.diff(np.r_[start, len(x)]))])
        x0, s0, r0 = x[-1], s[-1], r[-1]
        own = start[(kind[start] == 0) & (s[start] == 0)]
        other = (kind == 0) & (s == 0) & (v != r)
        child = kind == 1
        c = np.concatenate([x[own], v[other], v[child]])
        p = np.concatenate([r[own], r[other], r[child]])
        moved = np.concatenate([np.zeros(len(own), bool), np.ones(int(other.sum()), bool), (r != x)[child]])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(p, pa.int64()), pa.array(moved)],
                                         ["c", "p", "moved"])


def components(edges: DataFrame, tag: str = "components", contracted: bool = False) -> DataFrame:
    """(node, root): distributed union-find over edges (c, p) of long ids; root is the least id of
    the component and only nodes that have an edge come out.

    Partitions are first contracted to star forests, unless the edges already are.  Then, in every round, each node hooks its
    children and its other parents to its least parent, which halves the depth of what is left,
    until nothing moves.  A node's children are dealt to SALTS tasks, each of which gets the node's
    parents, and pass through them as a sorted stream: a root with a third of all nodes fills no
    task's memory.
    """
    stars = edges if contracted else _down(edges).mapInArrow(contract, "c long, p long")
    e = cut(_down(stars).distinct(), tag)
    while True:
        up = e.select(F.col("c").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"),
                      F.lit(0).alias("kind"), F.col("p").alias("v"))
        down = e.select(F.col("p").alias("x"), F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int").alias("s"),
                        F.lit(1).alias("kind"), F.col("c").alias("v"))
        rows = up.unionByName(down).repartition("x", "s").sortWithinPartitions("x", "s", "kind", "v")
        e = cut(rows.mapInArrow(_hook, "c long, p long, moved boolean")
                .groupBy("c", "p").agg(F.max("moved").alias("moved")), tag)
        if e.where("moved").isEmpty():
            break
    roots = e.select(F.col("p").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("c").alias("node"), F.col("p").alias("root")).unionByName(roots)
