"""Components of sets that are posted under keys, from confirmed links, without all pairs of a group.

``posts`` has a row for each key of a set: ``rep, key, mask, central``. A key is a coordinate in its
upper 32 bits and a value in its lower ones; ``mask`` has the bits of all coordinates that the set
is posted under. ``reps`` has ``rep, signature, parity, n_shingles``: the 32-bit values of all
coordinates, a parity sketch, and the size; ``sets`` has ``node, shingles``.

1. Stars: the most central set under each key is compared with all others there. This links a
   large group of near copies by a linear number of pairs.
2. Rest: under each key, sets outside the largest component are compared with all sets of other components there.
   Short lists are compared in one task as they are. A long list is written once, as blocks of at most ``BLOCK`` sets by size
   in files of the shared folder; a unit of work names one block of outside sets and a stripe of at most ``STRIPE`` blocks, which its task reads
   from the files. So a row for each posted set, and none for pairs of them, passes through joins, whatever the list's length.
   A pair is compared only under the first key that both are posted under. Collisions are then counted on one-byte
   tags of the coordinates, and the parity sketches bound how far two sets differ.
3. Every pair is confirmed on full sets: ``100 * both >= 75 * either``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401 - makes pa.ipc known
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from terraload.llm import words
from terraload.llm.components import components
from terraload.llm.scratch import Scratch
from terraload.sources.files import open_input, publish_file, read_range

#: Lists of at most so many sets are compared as they are.
SHORT = 256
BLOCK = 2048
STRIPE = 32
#: Rows of a block compared with another one at a time, and the coordinates looked at for all their pairs.
ROWS = 32
FIRST = 8
SKETCH_BITS = 2048
SKETCH_SHIFT = 64 - 11


def parity(elements: np.ndarray) -> bytes:
    """A sketch in which each element flips one bit: two sets differ in at least as many elements
    as their sketches in bits."""
    return np.packbits(np.bincount((elements >> np.uint64(SKETCH_SHIFT)).astype(np.int64), minlength=SKETCH_BITS) & 1 > 0).tobytes()


def _matrix(column, kind) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1)


class Sketches:
    """Signatures, sketches and sizes of rows; says which pairs of rows may be linked."""

    def __init__(self, rows, suffix: str = ""):
        self.signature = _matrix(rows.column("signature" + suffix), np.uint32)
        self.tags = self.signature.astype(np.uint8)
        self.parity = _matrix(rows.column("parity" + suffix), np.uint64)
        self.size = rows.column("n_shingles" + suffix).to_numpy()

    def may_link(self, x: np.ndarray, other: "Sketches", y: np.ndarray, least: int) -> np.ndarray:
        """Which pairs ``x, y`` pass: enough collisions, sizes and sketches that allow a link.

        Sets of sizes a and b that differ in d elements are linked if ``a + b >= 7 * d``.
        """
        total = self.size[x] + other.size[y]
        passed = np.flatnonzero(total >= 7 * np.abs(self.size[x] - other.size[y]))
        x, y = x[passed], y[passed]
        enough = (self.tags[x] == other.tags[y]).sum(1) >= least
        passed, x, y = passed[enough], x[enough], y[enough]
        apart = np.bitwise_count(self.parity[x] ^ other.parity[y]).sum(1, dtype=np.int64)
        out = np.zeros(len(total), bool)
        out[passed[total[passed] >= 7 * apart]] = True
        return out


def _enough(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.arange(batch.num_rows)
                passed = Sketches(batch, "_a").may_link(rows, Sketches(batch, "_b"), rows, least)
                yield batch.select(["a", "b"]).filter(pa.array(passed))
    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)):
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                keep[i] = 100 * both >= 75 * (len(a) + len(b) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _short_pairs(least: int):
    """Pairs of different components with enough equal tags, from rows sorted by key.

    Neighbours at each distance are compared for all keys of a table at once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.grouped(batches, ["key"]):
            table = table.combine_chunks()
            key, rep, component, outside = (table.column(c).to_numpy() for c in ("key", "rep", "component", "outside"))
            sketches, own = Sketches(table), _posted_values(table, 0)
            left = np.arange(len(key))
            for distance in range(1, len(key)):
                left = left[left + distance < len(key)]
                left = left[key[left] == key[left + distance]]
                if not len(left):
                    break
                right = left + distance
                useful = (component[left] != component[right]) & (outside[left] | outside[right])
                x, y = left[useful], right[useful]
                passed = sketches.may_link(x, sketches, y, least)
                x, y = x[passed], y[passed]
                if len(x):
                    here = ((own[x] == own[y]) & (own[x] >= 0)).argmax(1) == key[x] >> 32
                    yield _pair_rows(rep, component, x[here], rep, component, y[here])
    return run


def _posted_values(table, missing: int) -> np.ndarray:
    """Values of the coordinates that a set is posted under; a negative number, hanging on ``missing``, elsewhere."""
    signature, mask = _matrix(table.column("signature"), np.uint32), table.column("mask").to_numpy().view(np.uint64)
    posted = mask[:, None] >> np.arange(signature.shape[1], dtype=np.uint64) & np.uint64(1) > 0
    return np.where(posted, signature.astype(np.int64), -1 - missing)


def _pair_rows(rep, component, x, other_rep, other_component, y) -> pa.RecordBatch:
    a, b, ca, cb = rep[x], other_rep[y], component[x], other_component[y]
    swap = a > b
    return pa.RecordBatch.from_arrays([pa.array(np.where(swap, v, u)) for u, v in ((a, b), (b, a), (ca, cb), (cb, ca))], names=["a", "b", "ca", "cb"])


def _write_blocks(folder: str, size: int):
    """Cut rows sorted by key, inside sets last, and size into blocks in one file; a row for each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, found, held, n = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.blocks", [], [], 0
        with publish_file(path) as out:
            def close() -> None:
                block = pa.Table.from_batches(held).combine_chunks()
                sizes, start = block.column("n_shingles").to_numpy(), out.tell()
                with pa.ipc.new_stream(out, block.schema) as writer:
                    writer.write_table(block)
                found.append((block.column("key")[0].as_py(), block.column("outside")[0].as_py(), path, start, out.tell() - start, int(sizes.min()), int(sizes.max())))

            for batch in batches:
                if not batch.num_rows:
                    continue
                key, outside = batch.column("key").to_numpy(), batch.column("outside").to_numpy(zero_copy_only=False)
                cuts = (np.flatnonzero((key[1:] != key[:-1]) | (outside[1:] != outside[:-1])) + 1).tolist()
                for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                    while low < high:
                        if held and (n == size or held[0].column("key")[0].as_py() != key[low] or held[0].column("outside")[0].as_py() != outside[low]):
                            close()
                            held, n = [], 0
                        take = min(high - low, size - n)
                        held.append(batch.slice(low, take))
                        low, n = low + take, n + take
            if held:
                close()
        names = ("key", "outside", "path", "start", "bytes", "low", "high")
        kinds = (pa.int64(), pa.bool_(), pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=list(names))
    return run


class _StoredBlock:
    def __init__(self, ref: dict, missing: int):
        with open_input(ref["path"]) as handle:
            table = pa.ipc.open_stream(read_range(handle, ref["start"], ref["bytes"])).read_all().combine_chunks()
        self.rep, self.component = table.column("rep").to_numpy(), table.column("component").to_numpy()
        self.sketches, self.own = Sketches(table), _posted_values(table, missing)


def _long_pairs(least: int):
    """The pairs of a block with each block of a stripe that has its number or a later one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                a, coordinate = _StoredBlock(unit["block"], 0), unit["key"] >> 32
                for ref in unit["stripe"]:
                    # No set of one block may be linked with any of the other.
                    if ref["no"] < unit["block"]["no"] or 4 * min(ref["high"], unit["block"]["high"]) < 3 * max(ref["low"], unit["block"]["low"]):
                        continue
                    b = _StoredBlock(ref, 1)
                    for low in range(0, len(a.rep), ROWS):
                        x = np.arange(low, min(low + ROWS, len(a.rep)))
                        mine, theirs = a.sketches.size[x][:, None], b.sketches.size[None, :]
                        open_ = (mine + theirs >= 7 * np.abs(mine - theirs)) & (a.component[x][:, None] != b.component[None, :])
                        if ref["no"] == unit["block"]["no"]:
                            open_ &= x[:, None] < np.arange(len(b.rep))
                        for k in range(min(FIRST, coordinate)):
                            open_ &= a.own[x, k][:, None] != b.own[None, :, k]
                        i, y = np.nonzero(open_)
                        i += low
                        if coordinate > FIRST:
                            alone = ~(a.own[i, FIRST:coordinate] == b.own[y, FIRST:coordinate]).any(1)
                            i, y = i[alone], y[alone]
                        passed = a.sketches.may_link(i, b.sketches, y, least)
                        if passed.any():
                            yield _pair_rows(a.rep, a.component, i[passed], b.rep, b.component, y[passed])
    return run


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirmed, "a long, b long").distinct()


def linked_components(posts: DataFrame, reps: DataFrame, sets: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Two tables ``node, component``: components of the stars, and what becomes of these by the rest.

    A set's component is that of its first component, or the first one itself; a set that neither
    table has stands alone. ``least`` is the number of equal coordinates that a link needs.
    """
    pivots = scratch.keep(posts.groupBy("key").agg(F.max(F.struct("central", "rep")).alias("p"), F.count("*").alias("n"))
                          .where("n > 1").select("key", F.col("p.rep").alias("pivot")), "pivots")
    stars = (posts.join(pivots, "key").where("rep != pivot")
             .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct())
    left, right = (reps.toDF(end, *(f"{c}_{end}" for c in reps.columns[1:])) for end in "ab")
    stars = scratch.keep(stars.join(left, "a").join(right, "b")
                         .mapInArrow(_enough(least), "a long, b long"), "stars")
    first = components(_confirm(stars, sets), scratch)

    placed = scratch.keep(posts.join(first.withColumnRenamed("node", "rep"), "rep", "left")
                          .select("rep", "key", "mask", F.coalesce("component", "rep").alias("component")), "placed")
    sizes = (placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
             .agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("total"))
             .where("total > main.n").select("key", F.col("main.component").alias("main"), (F.col("total") > SHORT).alias("long")))
    sizes = scratch.keep(sizes, "sizes")
    posted = placed.join(sizes, "key").select("key", "long", (F.col("component") != F.col("main")).alias("outside"), "rep", "component", "mask")
    posted = scratch.keep(posted, "posted")
    found = "a long, b long, ca long, cb long"
    short = (posted.where("NOT long").drop("long").join(reps, "rep").repartition("key").sortWithinPartitions("key")
             .mapInArrow(_short_pairs(least), found))
    order = ["key", F.col("outside").desc(), "n_shingles", "rep"]
    lists = posted.where("long").drop("long").join(reps, "rep").repartitionByRange(*order).sortWithinPartitions(*order)
    stored = lists.mapInArrow(_write_blocks(scratch.path("blocks"), BLOCK), "key long, outside boolean, path string, start long, bytes long, low long, high long")
    in_list = Window.partitionBy("key").orderBy(F.col("outside").desc(), "low", "path", "start")
    stored = scratch.keep(stored, "stored").withColumn("no", F.row_number().over(in_list))
    ref = F.struct("no", "path", "start", "bytes", "low", "high")
    numbered = scratch.keep(stored.select("key", "outside", F.floor(F.col("no") / STRIPE).alias("part"), ref.alias("ref")), "numbered")
    stripes = numbered.groupBy("key", "part").agg(F.collect_list("ref").alias("stripe"), F.max("ref.no").alias("last"))
    units = numbered.where("outside").select("key", F.col("ref").alias("block")).join(stripes, "key").where("last >= block.no")
    units = scratch.keep(units.select("key", "block", "stripe"), "units")
    spread = units.repartition(max(1, min(units.count(), 4 * units.sparkSession.sparkContext.defaultParallelism)))
    pairs = short.union(spread.mapInArrow(_long_pairs(least), found)).distinct()
    pairs = scratch.keep(pairs, "pairs")
    late = _confirm(pairs.select("a", "b").distinct(), sets)
    joined = pairs.join(late, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    second = components(joined, scratch)
    scratch.drop(pivots, stars, placed, sizes, posted, numbered, units, pairs)
    return first, second
