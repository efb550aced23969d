"""Exact top-k by inner product with vector-approximation files.

Vectors lie in shards of bounded size. A shard has a file of approximations, one byte for each
component that says in which of 64 cells between the shard's least and greatest value it lies, and a file
of exact rows. A search scans the cells for bounds of all scores, then reads exact rows in
the order of their bounds until no unread one can reach the kth score.

Queries lie in blocks in the shared folder, too. A unit of work is a shard and a share of the blocks,
read one after the other, so no table is sent to every task and memory is bounded. The best rows
of each unit meet in one sort per query.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pyarrow.compute  # noqa: F401 - makes pa.compute known
from pyspark.sql import DataFrame, Window, functions as F

from terraload.llm.scratch import Scratch, bounded_batches
from terraload.sources.files import list_files, open_input, publish_file, read_range

CELLS = 64
SHARD = 8192
QUERIES = 1024
#: Units that a shard's search is shared between at most.
MOST_SLICES = 64
#: Exact rows read at a time.
STEP = 32
_HEAD = struct.Struct("<QQ")
_EXACT = 1 << 53


def _matrix(column) -> np.ndarray:
    """Rows of a list column; short ones end in zeros."""
    sizes = np.asarray(pa.compute.list_value_length(column))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def write_shard(path: str, ids: np.ndarray, rows: np.ndarray) -> None:
    n, d = rows.shape
    least, most = (rows.min(0), rows.max(0)) if n else (np.zeros(d, np.int64), np.zeros(d, np.int64))
    width = (most - least) // CELLS + 1
    with publish_file(path + ".cells") as out:
        out.write(_HEAD.pack(n, d) + least.tobytes() + most.tobytes() + ((rows - least) // width).astype(np.uint8).tobytes())
    with publish_file(path + ".exact") as out:
        out.write(_HEAD.pack(n, d) + ids.tobytes() + rows.tobytes())


class Shard:
    def __init__(self, path: str):
        with open_input(path + ".cells") as f:
            n, d = _HEAD.unpack(f.read(_HEAD.size))
            self.least, self.most = (np.frombuffer(f.read(8 * d), np.int64) for _ in range(2))
            cells = np.frombuffer(f.read(n * d), np.uint8).reshape(n, d)
        width = (self.most - self.least) // CELLS + 1
        self.low = self.least + cells * width
        self.high = np.minimum(self.low + width - 1, self.most)
        self.path, self.n, self.d = path, n, d

    def exact(self, handle, rows: np.ndarray) -> np.ndarray:
        base = _HEAD.size + 8 * self.n
        raw = b"".join(read_range(handle, base + 8 * self.d * r, 8 * self.d) for r in rows.tolist())
        return np.frombuffer(raw, np.int64).reshape(len(rows), self.d)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query its id, and the ids and scores of the ``k`` best rows other than its own."""
        d = min(self.d, queries.shape[1])
        queries = queries[:, :d]
        low, high = self.low[:, :d], self.high[:, :d]
        largest = max(int(np.abs(low).max(initial=0)), int(np.abs(high).max(initial=0)))
        bounded = d * int(np.abs(queries).max(initial=0)) * largest < _EXACT
        if bounded:
            up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
            best = up @ high.T.astype(np.float64) + down @ low.T.astype(np.float64)
        else:
            best = np.full((len(queries), self.n), np.inf)
        held, loaded = np.zeros((self.n, d), np.int64), np.zeros(self.n, bool)
        with open_input(self.path + ".exact") as handle:
            ids = np.frombuffer(read_range(handle, _HEAD.size, 8 * self.n), np.int64)
            for query_id, query, bounds in zip(query_ids.tolist(), queries, best):
                others = np.flatnonzero(ids != query_id)
                order = others[np.argsort(-bounds[others], kind="stable")]
                scores, at = np.zeros(0, np.int64), 0
                while at < len(order) and (at < k or bounds[order[at]] >= np.partition(scores, -k)[-k]):
                    some = order[at:at + STEP]
                    new = np.sort(some[~loaded[some]])
                    if len(new):
                        held[new] = self.exact(handle, new)[:, :d]
                        loaded[new] = True
                    scores = np.concatenate([scores, held[some] @ query])
                    at += STEP
                order = order[:len(scores)]
                top = np.lexsort((ids[order], -scores))[:k]
                yield query_id, ids[order][top], scores[top]


def read_exact(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of a whole shard."""
    with open_input(path + ".exact") as f:
        n, d = _HEAD.unpack(f.read(_HEAD.size))
        return np.frombuffer(f.read(8 * n), np.int64), np.frombuffer(f.read(8 * n * d), np.int64).reshape(n, d)


def _write(folder: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            path = f"{folder}/{uuid.uuid4().hex}"
            write_shard(path, table.column("vec_id").to_numpy(), _matrix(table.column("parts").chunk(0)))
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(held[-1].num_rows)
                if sum(b.num_rows for b in held) == size:
                    yield out()
                    held = []
        if held:
            yield out()
    return run


def _paths(manifest: str) -> list[str]:
    """Paths that a table written by Spark names."""
    found = []
    for path, _ in list_files(manifest):
        if path.endswith(".parquet"):
            with open_input(path) as f:
                found += pq.ParquetFile(f).read(["path"]).column("path").to_pylist()
    return sorted(found)


def _search(k: int, manifest: str, slices: int):
    """Search a shard for every ``slices``-th block of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, turn in zip(batch.column("path").to_pylist(), batch.column("slice").to_pylist()):
                shard = Shard(path)
                for block in _paths(manifest)[turn::slices]:
                    found = list(shard.search(*read_exact(block), k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)),
                         pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))],
                        names=["query_id", "vec_id", "score"])
    return run


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, parts``: components as ``floor(scale * x)``. Rows without id, vector, or with a null or
    non-finite component are left out; rows that repeat another wholly count once."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    parts = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"), parts.cast("array<long>").alias("parts")).distinct())


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` (``vec_id, embedding``) that ``is_query``
    picks by its id, the ``k`` rows of other ids with the highest inner product.

    Ties go to the smaller id. Vectors of different lengths meet on their common part. Products
    beyond 53 bits are computed in 64-bit whole numbers, without bounds. An empty table, or one row, gives none.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    bounded_batches(spark)
    rows = scratch.keep(whole_numbers(vectors, scale), "rows")
    shards = scratch.keep(rows.mapInArrow(_write(scratch.path("shards"), SHARD), "path string"), "shards")
    manifest = scratch.path("queries")
    rows.where(is_query).mapInArrow(_write(scratch.path("blocks"), QUERIES), "path string").write.parquet(manifest)
    slices = min(MOST_SLICES, spark.read.schema("path string").parquet(manifest).count())
    if not slices:
        return rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    units = shards.select("path", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    units = units.repartition(spark.sparkContext.defaultParallelism * 4)
    found = units.mapInArrow(_search(k, manifest, slices), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
