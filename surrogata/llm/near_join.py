"""Near-duplicate documents: Jaccard of word 5-grams at 0.8 and more, by Bayesian pruning.

Candidates share a band of MinHash values (ROWS values a band, BANDS bands: a pair at 0.8 is missed
with probability (1 - 0.8^6)^40, about 5e-6).  Candidate pairs are compared some values at a time
and dropped once the posterior probability of reaching 0.8 is below 1e-6; the rest is verified
exactly.  Texts with the same words are one class, known by a 64-bit fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, cut, fresh
from .shingles import band_keys, signatures, text_slices, word_shingles
from .similar import candidate_components, has_bit, linked_components, needed_bits, verified_links

ROWS, BANDS = 6, 40
THRESHOLD = (4, 5)         # 0.8


def _prints(column: pa.Array):
    """Fingerprint of every text, null where it has no word."""
    out = np.zeros(len(column), np.int64)
    some = np.zeros(len(column), bool)
    for at, data, off in text_slices(column):
        _, bounds, text = word_shingles(data, off)
        out[at:at + len(text)] = text
        some[at:at + len(text)] = np.diff(bounds) > 0
    return [pa.array(out, mask=~some)]


def _keys(batches):
    """Band keys of the distinct texts of a batch."""
    for x in batches:
        for _, data, off in text_slices(x.column(0)):
            shingles, bounds, text = word_shingles(data, off)
            sig = signatures(shingles, bounds, ROWS * BANDS)
            _, own = np.unique(text, return_index=True)
            own = own[np.diff(bounds)[own] > 0]
            keys = band_keys(sig[own], ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(text[own], BANDS))],
                                             ["key", "node"])


def _texts(bits):
    def run(batches):
        for x in batches:
            column = x.column(0)
            for at, data, off in text_slices(column):
                _, bounds, text = word_shingles(data, off)
                _, own = np.unique(text, return_index=True)
                own = own[(np.diff(bounds)[own] > 0) & has_bit(bits.value, text[own])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text[own]), column.take(pa.array(own + at)).cast(pa.string())], ["node", "text"])
    return run


def shingle_list(texts: list[str]):
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    return word_shingles(np.frombuffer(b"".join(data), np.uint8), off)


def near_links(docs: DataFrame, text_col: str = "text", tag: str = "near") -> tuple[DataFrame, DataFrame]:
    """((node, root): classes that links join, (node, links)): of the texts of a table."""
    spark = docs.sparkSession
    text = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    members = candidate_components(text, _keys, tag)
    bits = spark.sparkContext.broadcast(needed_bits(members))
    own = text.mapInArrow(_texts(bits), "node long, text string")
    links = verified_links(members, own, shingle_list, ROWS * BANDS, THRESHOLD, tag)      # written
    bits.destroy()
    return linked_components(links, tag), links.groupBy("node").agg(F.sum("links").alias("links"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, group_id, n_copies, n_links), a row a document.

    class_id is the least id of the documents with the same words, n_copies their number; n_links
    counts the other classes at a similarity of 0.8 or more; group_id is the least id that links
    lead to.  A null, empty or wordless text is its own class with its own id and no link; a text of
    fewer than 5 words is one shingle; repeated rows are copies; rows with a null id take part and
    their class has the least id that is not null; other columns are not looked at.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found, f = annotate(d, ["text"], _prints, "node long")
    rows = cut(found.select("doc_id", F.col(f"{f}.node").alias("node")), "near")
    groups, links = near_links(d)
    classes = cut(rows.where("node is not null").groupBy("node")
                  .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies")), "near")
    joined = classes.join(groups, "node").join(links, "node", "left")
    least = cut(joined.groupBy("root").agg(F.min("class_id").alias("group_id")), "near")
    linked = joined.join(least, "root").select("node", "group_id", "links")
    known = cut(classes.join(linked, "node", "left").select(
        F.col("node").alias("k"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"),
        "n_copies", F.coalesce("links", F.lit(0)).alias("n_links")), "near")
    copies = rows.join(known, F.col("node") == F.col("k"), "left")
    own = F.col("k").isNull()
    return copies.select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.when(own, F.lit(1).cast("long")).otherwise(F.col("n_copies")).alias("n_copies"),
        F.when(own, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one of each near-duplicate group, columns as they were.

    The one that stays has the least id (null ids last), then the least text.  Documents without a
    word stay.  Of rows equal in id and text one stays.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("text"))
    found, f = annotate(d, ["text"], _prints, "node long")
    keys = cut(found.select("i", F.xxhash64("text").alias("t"), F.col(f"{f}.node").alias("node"))
               .where("node is not null"), "near")
    group = cut(near_links(d)[0].select(F.col("node").alias("n"), "root"), "near")
    member = cut(keys.join(group, F.col("node") == F.col("n"), "left")
                 .select("i", "t", F.coalesce("root", "node").alias("g"),
                         F.struct(F.col("i").isNull().alias("z"), "i", "t").alias("o")), "near")
    best = cut(member.groupBy("g").agg(F.min("o").alias("b"), F.count("*").alias("n"))
               .where("n > 1").select(F.col("g").alias("h"), "b"), "near")
    some = member.join(best, F.col("g") == F.col("h"))
    gone = some.where("o != b").select("i", "t").distinct()
    again = cut(some.where("o = b").groupBy("i", "t").count().where("count > 1").select("i", "t"), "near")
    [t] = fresh(docs, "_hash")
    rows = docs.withColumn(t, F.xxhash64(F.col(f"`{text_col}`")))
    pick = [F.col(f"`{c}`") for c in docs.columns]

    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_gone_i")) & (F.col(t) == F.col("_gone_t"))
    gone = cut(gone.unionByName(again), "near").toDF("_gone_i", "_gone_t")
    again = again.toDF("_gone_i", "_gone_t")
    kept = rows.join(gone, same, "left_anti").select(*pick)
    once = rows.join(again, same).dropDuplicates([id_col, t]).select(*pick)
    return kept.unionByName(once)
