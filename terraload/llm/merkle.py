"""Merkle tree over a dataset, stored as aligned subtrees in van Emde Boas layout.

1. A row's leaf is a digest of its columns, made by built-in functions. Rows are range-sorted by source and
   ``doc_id``; counts of each task's runs of a source give every leaf its number within its source.
2. Every ``16**HEIGHT`` consecutive leaves of a source are an aligned subtree, a block, so a hot source is
   many blocks. A block is one row: its digests lie in one array in van Emde Boas order (the upper half of the
   levels first, then each subtree of the lower half, each in the same order again), and ``positions`` computes
   where a level's nodes lie. Construction writes levels there, retrieval of siblings reads them from there.
3. The roots of blocks are the leaves of the next tier, and so on until each source has one root;
   the roots of sources, in the order of sources, are the leaves of one more tree built the same way.
4. Downwards, each tier gives the ones below it the siblings above each of their roots, so that a row's
   whole proof is found in its block. Rows move once, to their block; later steps move blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from terraload.llm import words
from terraload.llm.scratch import Scratch
from terraload.operators.ordering import number_rows

FAN, SHIFT = 16, 4
#: Levels of edges in a block; a block has ``16**HEIGHT`` leaves.
HEIGHT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def subtree_size(levels: int) -> int:
    return (FAN ** levels - 1) // (FAN - 1)


def positions(levels: int, depth: int, at: np.ndarray) -> np.ndarray:
    """Places of the nodes ``at`` of a depth (0 is the root) in a full tree of ``levels`` levels of nodes."""
    out = np.zeros(len(at), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
        else:
            inner = SHIFT * (depth - top)
            out += subtree_size(top) + (at >> inner) * subtree_size(levels - top)
            at, depth, levels = at & ((1 << inner) - 1), depth - top, levels - top
    return out


def height_over(n: int, limit: int = 64) -> int:
    """Levels of edges over ``n`` leaves, at most ``limit``."""
    height = 0
    while n > 1 and height < limit:
        n, height = -(-n // FAN), height + 1
    return height


def build(leaves: np.ndarray, height: int) -> np.ndarray:
    """Digests (rows of 32 bytes) of a subtree of ``height`` over its first leaves, in layout order.

    Places of nodes that a short last subtree lacks hold zeros; places behind the last node are cut off.
    """
    levels, level, end = height + 1, leaves, 0
    nodes = np.zeros((subtree_size(levels), 32), np.uint8)
    for depth in range(height, -1, -1):
        places = positions(levels, depth, np.arange(len(level)))
        nodes[places] = level
        end = max(end, int(places.max()) + 1)
        if depth:
            text = level.tobytes().hex().encode()
            run = 64 * FAN
            level = np.frombuffer(b"".join(hashlib.sha256(text[at:at + run]).digest() for at in range(0, len(text), run)), np.uint8).reshape(-1, 32)
    return nodes[:end]


class Block:
    """A stored subtree: siblings of its nodes by address."""

    def __init__(self, nodes: bytes, n_leaves: int, height: int):
        self.nodes, self.height = np.frombuffer(nodes, np.uint8).reshape(-1, 32), height
        self.counts = [n_leaves]
        for _ in range(height):
            self.counts.append(-(-self.counts[-1] // FAN))
        self.counts.reverse()

    def run(self, depth: int, parent: int) -> bytes:
        """The children of a node, as the text its digest is made of."""
        at = np.arange(parent * FAN, min(parent * FAN + FAN, self.counts[depth]))
        return self.nodes[positions(self.height + 1, depth, at)].tobytes().hex().encode()

    def paths(self, depth: int) -> Iterator[list[tuple[bytes, bytes]]]:
        """For each node of a depth, in order, what stands before and behind it and the nodes above it, level by level."""
        if not depth:
            yield []
            return
        for parent, above in enumerate(self.paths(depth - 1)):
            run = self.run(depth, parent)
            for k in range(0, len(run), 64):
                yield [(run[:k], run[k + 64:]), *above]


def packed(path: list[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: per level the number of digests before, that behind, and these."""
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex((a + b).decode()) for a, b in path)


def unpacked(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(data):
        before, behind = data[at], data[at + 1]
        at += 2
        out.append((data[at:at + 32 * before].hex().encode(), data[at + 32 * before:at + 32 * (before + behind)].hex().encode()))
        at += 32 * (before + behind)
    return out


def leaf_digest(*columns: Column) -> Column:
    """Each column as ``-`` if null, else its number of UTF-8 bytes, a colon and itself; the hash of all, 32 bytes."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by source: this partition, the run of the source in it, and the place in the run."""
    part, run, last, held = TaskContext.get().partitionId(), -1, (), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        source = batch.column("source")
        new = np.zeros(n, bool)
        both_null = source.is_null().to_numpy(zero_copy_only=False)
        new[1:] = ~np.asarray(pa.compute.equal(source[1:], source[:-1]).fill_null(False)) & ~(both_null[1:] & both_null[:-1])
        new[0] = last != (source[0].as_py(),)
        last = (source[n - 1].as_py(),)
        runs = run + np.cumsum(new)
        starts = np.flatnonzero(new)
        begin = np.zeros(n, np.int64)
        begin[starts] = starts
        np.maximum.accumulate(begin, out=begin)
        place = np.arange(n) - begin + np.where(runs == run, held, 0)
        run, held = int(runs[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(runs.astype(np.int64)), pa.array(place)],
            names=[*batch.schema.names, "part", "run", "place"])


def _place_leaves(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Leaves with ``tree, at, n``: the number of their source, their place in it and its leaves; and the sources."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"]
    # Written first: cutting ranges looks at the rows once more.
    leaves = scratch.keep(leaves, "leaves", "zstd")
    ranged = scratch.keep(leaves.repartitionByRange(*order).sortWithinPartitions(*order)
                          .mapInArrow(_numbered, "doc_id long, source string, leaf binary, other binary, part long, run long, place long"), "ranged", "zstd")
    runs = ranged.groupBy("part", "run", "source").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("source").orderBy("part", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = scratch.keep(runs.withColumn("earlier", F.coalesce(F.sum("rows").over(earlier), F.lit(0))), "runs")
    sources = scratch.keep(runs.groupBy("source").agg(F.sum("rows").alias("n")), "sources")
    trees = number_rows(sources.withColumn("known", F.col("source").isNotNull().cast("int")), ["known", "source"], "tree", start=-1)
    trees = scratch.keep(trees.select("source", "n", F.col("tree").cast("long").alias("tree")), "trees")
    facts = scratch.keep(runs.join(trees, runs["source"].eqNullSafe(trees["source"])).select("part", "run", "earlier", "tree", "n"), "facts")
    placed = ranged.join(facts, ["part", "run"]).select("tree", (F.col("earlier") + F.col("place")).alias("at"), "n", "doc_id", "leaf", "other")
    scratch.drop(leaves, runs, sources)
    return placed, trees


def _one_list(column: pa.ChunkedArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), pa.concat_arrays(column.chunks))


def _blocks(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.grouped(batches, ["tree", "block"]):
            trees, blocks = (table.column(c).to_numpy() for c in ("tree", "block"))
            cuts = np.flatnonzero(np.concatenate([[True], (trees[1:] != trees[:-1]) | (blocks[1:] != blocks[:-1]), [True]]))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = table.slice(low, high - low)
                leaves = np.frombuffer(b"".join(part.column("leaf").to_pylist()), np.uint8).reshape(-1, 32)
                own = height_over(part.column("n")[0].as_py(), height)
                nodes = build(leaves, own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trees[low:low + 1]), pa.array(blocks[low:low + 1]), pa.array([high - low], pa.int64()), pa.array([own], pa.int32()),
                     pa.array([nodes.tobytes()], pa.binary()), pa.array([nodes[0].tobytes()], pa.binary()),
                     _one_list(part.column("doc_id")), _one_list(part.column("other"))],
                    names=["tree", "block", "n_leaves", "height", "nodes", "root", "ids", "others"])
    return run


_BLOCK = "tree long, block long, n_leaves long, height int, nodes binary, root binary, ids array<long>, others array<binary>"


def _tiers(leaves: DataFrame, height: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves up, and ``tree, root``.

    ``leaves`` has ``tree, at, n, leaf, doc_id, other``. A tier has a sixteenth to the power of ``height`` of the
    rows below it, so there are few; only whether one more is needed reaches the driver.
    """
    tiers, roots, width = [], None, FAN ** height
    while True:
        rows = (leaves.withColumn("block", F.shiftright("at", SHIFT * height)).repartition("tree", "block")
                .sortWithinPartitions("tree", "block", "at").select("tree", "block", "n", "leaf", "doc_id", "other"))
        tier = scratch.keep(rows.mapInArrow(_blocks(height), _BLOCK), f"{name}{len(tiers)}", "zstd")
        tiers.append(tier)
        more = F.ceil(F.col("n") / width).cast("long")
        tops = tier.join(tier.groupBy("tree").agg(F.sum("n_leaves").alias("n")), "tree")
        tops = scratch.keep(tops.select("tree", F.col("block").alias("at"), more.alias("n"), F.col("root").alias("leaf"),
                                        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("other")), "tops")
        done = tops.where("n = 1").select("tree", F.col("leaf").alias("root"))
        roots = done if roots is None else roots.union(done)
        leaves = tops.where("n > 1")
        if leaves.isEmpty():
            return tiers, roots


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each leaf of a block up to the last root."""
    for batch in batches:
        for row in batch.to_pylist():
            held, upper, n = Block(row["nodes"], row["n_leaves"], row["height"]), row["above"], row["n_leaves"]
            first = row["block"] * FAN ** held.height
            paths = pa.array([packed(path) + upper for path in held.paths(held.height)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * n, pa.int64()), pa.array(np.arange(first, first + n)), paths],
                                             names=["tree", "block", "above"])


def _with_above(tiers: list[DataFrame], above: DataFrame, scratch: Scratch) -> DataFrame:
    """The lowest tier's blocks with ``above``; ``above`` has ``tree, above`` for the roots of trees."""
    paths = None
    for tier in reversed(tiers):
        # A tree's last root is that of its only block in the highest tier it reaches.
        tops = tier.groupBy("tree").agg(F.count("*").alias("n")).where("n = 1").join(above, "tree")
        tops = tops.select("tree", F.lit(0).cast("long").alias("block"), "above")
        joined = tier.join(tops if paths is None else tops.union(paths), ["tree", "block"])
        if tier is not tiers[0]:
            paths = scratch.keep(joined.select("tree", "block", "n_leaves", "height", "nodes", "above")
                                 .mapInArrow(_descend, "tree long, block long, above binary"), "paths")
    return joined


def _fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for before, behind in path:
        digest = hashlib.sha256(before + digest.hex().encode() + behind).digest()
    return digest


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a block: its leaf, the hash of its proof, and the root that its own or its changed leaf leads to."""
    for batch in batches:
        for i in range(batch.num_rows):
            n, others = batch.column("n_leaves")[i].as_py(), batch.column("others")[i].as_py()
            held = Block(batch.column("nodes")[i].as_py(), n, batch.column("height")[i].as_py())
            upper = unpacked(batch.column("above")[i].as_py())
            leaves, proofs, roots, folded = [], [], [], {}
            # Rows under one parent share what is above it.
            for parent, path in enumerate(held.paths(held.height - 1) if held.height else [[]]):
                over = [*path, *upper]
                run = held.run(held.height, parent) if held.height else held.nodes[0].tobytes().hex().encode()
                tail = b"".join(before + behind for before, behind in over)
                folded.clear()
                for k in range(0, len(run), 64):
                    own = bytes.fromhex(run[k:k + 64].decode())
                    first = own if others[len(leaves)] is None else others[len(leaves)]
                    before, behind = run[:k], run[k + 64:]
                    if held.height:
                        first = hashlib.sha256(before + first.hex().encode() + behind).digest()
                    if first not in folded:
                        folded[first] = _fold(first, over)
                    leaves.append(own)
                    proofs.append(hashlib.sha256(before + behind + tail).digest())
                    roots.append(folded[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("tree")[i].as_py()] * n, pa.int64()), batch.column("ids").slice(i, 1).flatten(),
                 *(pa.array(v, pa.binary()) for v in (leaves, proofs, roots))],
                names=["tree", "doc_id", "leaf", "proof", "folded"])


class Manifest:
    """Trees of a dataset: ``blocks`` (a row for each block of rows), ``sources`` (``source, tree, n, subroot, root``)."""

    def __init__(self, blocks: DataFrame, sources: DataFrame):
        self.blocks, self.sources = blocks, sources

    def proofs(self) -> DataFrame:
        """``doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row; digests in hex."""
        rows = self.blocks.select("tree", "n_leaves", "height", "nodes", "above", "ids", "others").mapInArrow(
            _proofs, "tree long, doc_id long, leaf binary, proof binary, folded binary")
        hexed = lambda c: F.lower(F.hex(c))
        return rows.join(self.sources, "tree").select(
            "doc_id", "source", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
            hexed("proof").alias("proof_sha256"), hexed("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def manifest(docs: DataFrame, changed: Column | None = None, height: int = HEIGHT, scratch: Scratch | None = None) -> Manifest:
    """Build the trees of ``docs`` (``doc_id, source, lang, n_chars, text``), one for each source and one over these.

    ``changed``, a text, is null where a row is as it was; elsewhere the row's proof is checked with a leaf
    of that text in place of its own. A null source is a source of its own and comes first; null ``doc_id`` s come
    first in their source; rows that share a ``doc_id`` are ordered by their leaf, so equal rows are neighbours and each
    has a leaf. Null and empty texts differ. Other columns are ignored. An empty table has no trees and no rows.
    """
    if not 1 <= height <= 5:
        raise ValueError("a block has 1 to 5 levels")
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    own = [F.col(c) for c in COLUMNS]
    other = F.lit(None).cast("binary") if changed is None else F.when(changed.isNotNull(), leaf_digest(*own[:-1], changed))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_digest(*own).alias("leaf"), other.alias("other"))
    placed, trees = _place_leaves(leaves, scratch)
    tiers, subroots = _tiers(placed, height, scratch, "tier")
    subroots = scratch.keep(trees.join(subroots, "tree").withColumnRenamed("root", "subroot"), "subroots")
    n_sources = subroots.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_sources).cast("long").alias("n"),
                           F.col("subroot").alias("leaf"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("other"))
    upper, roots = _tiers(tops, height, scratch, "upper")
    root = roots.first()
    nothing = docs.sparkSession.createDataFrame([(0, b"")], "tree long, above binary")
    over = _with_above(upper, nothing, scratch).select("tree", "block", "n_leaves", "height", "nodes", "above")
    above = scratch.keep(over.mapInArrow(_descend, "tree long, block long, above binary").select(F.col("block").alias("tree"), "above"), "above")
    return Manifest(_with_above(tiers, above, scratch), subroots.withColumn("root", F.lit(root["root"] if root else None).cast("binary")))
