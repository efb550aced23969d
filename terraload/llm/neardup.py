"""Near-duplicate documents by an inverted join on the coordinates of MinHash signatures.

1. A document's set holds its distinct five-word shingles; equal sets become one class, a node of its own
   even where two classes have a ``doc_id`` in common.
2. A signature has 64 coordinates. A class is posted under each ``(coordinate, value)``. Two
   classes are candidates when at least 30 coordinates collide: at a similarity of 0.75 the count
   is binomial with mean 48, and falls below 30 once in a million pairs.
3. Prefix: of a class's posted values only those that another class has too can collide. With
   ``L`` such values, ``L - 29`` of the rarest must hold one that a partner also has among its own
   rarest, since ``30`` collide. A class with fewer than 30 of them has no partner. Values common
   to many documents (a shared passage) sort last and are skipped unless they are most of a text.
4. Stars: the most central class under each value (whose values are the most common) is compared
   with all others there. This links a large group of near copies by a linear number of pairs.
5. Rest: under each value, classes outside the largest component are compared with all classes of other components
   there, long lists as blocks in files (``linking``). Collisions are counted on one-byte tags of the coordinates, and a
   parity sketch bounds how far two sets differ: each element flips one of 2048 bits, so two sets differ in at least as many
   elements as their sketches in bits. Only pairs that may still be linked leave a task, and only under the first value that they share.
6. Every pair is confirmed on full shingle sets: ``100 * both >= 75 * either``.
7. Components by hooking and contraction; the smallest ``doc_id`` names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terraload.llm import words
from terraload.llm.linking import linked_components, parity
from terraload.llm.scratch import Scratch, bounded_batches

SHINGLE = 5
COORDINATES = 64
MATCHES = 30
#: Shingles hashed at a time, so that they stay in a core's cache.
STRIDE = 1 << 16

FACTORS = words.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def signatures(hashes: np.ndarray, bounds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each range of ``bounds`` and each factor the least value of ``hash * factor``, as 32 bits.

    An empty range gives zeros.
    """
    out = np.zeros((len(bounds) - 1, len(factors)), np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(full):
            base = bounds[full[at]]
            end = max(at + 1, int(np.searchsorted(bounds[full + 1], base + STRIDE, side="right")))
            rows = full[at:end]
            part = hashes[base:bounds[rows[-1] + 1]]
            cuts = bounds[rows] - base
            for j, factor in enumerate(factors):
                out[rows, j] = np.minimum.reduceat((part * factor) >> np.uint64(32), cuts)
            at = end
    return out


def _sets(texts) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = words.split(texts)
    hashes, bounds = words.shingles(words.hashes(found), found.first, SHINGLE)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        part = np.sort(hashes[low:high])
        yield part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(_sets(batch.column("text")))
        sizes = np.array([len(s) for s in sets], np.int64)
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        rows = signatures(flat, bounds, FACTORS)
        with np.errstate(over="ignore"):
            digests = [(words.mix(s).sum(), words.mix(s ^ words.BASE).sum()) for s in sets]
        parities = [parity(s) for s in sets]
        pairs = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
             pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(parities, pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "h1", "h2", "signature", "parity"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    high = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array((values + high).ravel()), pa.array(rep)], names=["key", "rep"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [s.tobytes() for s in _sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(kept, pa.large_binary())],
                                         names=["node", "shingles"])


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, group, text_key`` for every row of ``docs`` (``doc_id, text``).

    A row's node is its text, so rows that share a ``doc_id`` may lie in different groups, and equal rows lie in one.
    ``component_id`` is the smallest ``doc_id`` of a row's group and ``kept`` says whether it is the row's own; ``group``
    tells groups apart even where they have that id in common, and ``text_key`` is the text's MD5. Null and empty
    texts and texts without words have no shingles, no links and no group. A row without a ``doc_id`` has no links, no component,
    and is kept. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "neardup")
    bounded_batches(spark, rows=4000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("text_key"))
    prints = scratch.keep(docs.mapInArrow(_fingerprints, "doc_id long, text_key string, n_shingles long, h1 long, h2 long, signature binary, parity binary"), "prints")
    same = ["h1", "h2", "n_shingles"]
    classes = (prints.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min(F.struct("doc_id", "text_key")).alias("one"))
               .select(*same, F.col("one.doc_id").alias("doc_id"), F.col("one.text_key").alias("text_key")))
    classes = scratch.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    members = scratch.keep(prints.select("doc_id", "text_key", *same).where("doc_id IS NOT NULL").join(classes.select(*same, "rep"), same, "left")
                           .select("doc_id", "text_key", "n_shingles", "rep"), "members")
    reps = prints.select("doc_id", "text_key", "signature", "parity").join(classes, ["doc_id", "text_key"])
    reps = scratch.keep(reps.select("rep", "signature", "parity", "n_shingles").dropDuplicates(["rep"]), "reps")

    posts = reps.mapInArrow(_posted, "key long, rep long")
    shared = scratch.keep(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    own = (posts.join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))
           .where(F.size("own") >= MATCHES))
    central = F.aggregate("own", F.lit(0).cast("long"), lambda total, v: total + v["n"])
    rarest = own.select("rep", central.alias("central"), F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1)).alias("posts"))
    mask = F.aggregate("posts", F.lit(0).cast("long"), lambda bits, v: bits.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(v["key"], 32).cast("int"))))
    prefix = scratch.keep(rarest.select("rep", "central", mask.alias("mask"), F.explode("posts").alias("post"))
                          .select("rep", "central", "mask", F.col("post.key").alias("key")), "prefix")

    asked = scratch.keep(classes.join(prefix.select("rep").distinct(), "rep").select("doc_id", "text_key", "rep"), "asked")
    sets = scratch.keep(docs.join(asked, ["doc_id", "text_key"]).select("rep", "text").mapInArrow(_shingle_sets, "node long, shingles binary"), "sets")
    first, second = linked_components(prefix, reps, sets, MATCHES, scratch)

    grouped = (classes.select("rep", F.col("doc_id").alias("first")).join(first.select(F.col("node").alias("rep"), F.col("component").alias("c1")), "rep", "left")
               .withColumn("c1", F.coalesce("c1", "rep"))
               .join(second.select(F.col("node").alias("c1"), F.col("component").alias("c2")), "c1", "left")
               .select("rep", "first", F.coalesce("c2", "c1").alias("group")))
    grouped = scratch.keep(grouped, "grouped")
    names = scratch.keep(grouped.groupBy("group").agg(F.min("first").alias("component_id")), "names")
    grouped = scratch.keep(grouped.join(names, "group").select("rep", "group", "component_id"), "named")
    result = members.join(grouped, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group", "text_key")
    lost = prints.where("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"), "text_key")
    result = result.union(lost)
    result = result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "group", "text_key")
    kept = scratch.keep(result, "result")
    scratch.drop(prints, classes, members, reps, shared, prefix, asked, sets, first, second, names, grouped)
    return kept


def one_of_each(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each group its row with the smallest ``doc_id`` stays.

    If that id has several texts in a group, the one with the smallest MD5 stays; of rows equal in id and text any one. No text
    goes that is not linked with one that stays. Rows without a ``doc_id`` and texts without words all stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "one")
    rows = near_duplicates(docs, scratch).where("group IS NOT NULL").select("group", "doc_id", "text_key")
    chosen = scratch.keep(rows.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.count("*").alias("n")).where("n > 1"), "chosen")
    others = rows.join(chosen, "group").select("doc_id", "text_key", (F.struct("doc_id", "text_key") == F.col("one")).alias("stays"))
    # Each text has one group, so what is said of an id and a text is the same in all rows.
    others = scratch.keep(others.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.max("stays").alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1"), "others")
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_key", F.md5("text"))
    single = keyed.join(others.select("_id", "_key"), ["_id", "_key"], "left_anti").select(*docs.columns)
    scratch.drop(chosen)
    if others.where("stays").isEmpty():
        return single
    again = keyed.join(others.where("stays").select("_id", "_key"), ["_id", "_key"]).dropDuplicates(["_id", "_key"]).select(*docs.columns)
    return single.union(again)
