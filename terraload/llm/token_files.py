"""Token files: frequency-ranked ids in one to four bytes each, lengths in separate control bytes.

A file is a magic and blocks. A block holds whole documents, at least one and about ``BLOCK``
ids: a header, document ids, their null flags, numbers of tokens, control bytes, data bytes. An id is replaced by
its rank (0 is the most frequent), so most take one byte. A control byte holds the lengths of
four values, two bits each, the first in the lowest bits. The decoder looks a control byte's four
lengths up in a table, and cumulative sums of lengths say where each value's bytes are.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terraload.llm.scratch import Scratch, bounded_batches
from terraload.llm.tokenizing import WordTokenizer
from terraload.sources.files import open_input, publish_file

MAGIC = b"TLTOKEN1"
HEADER = struct.Struct("<IQQQ")
BLOCK = 1 << 20
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_SHIFTS = np.array([1, 4, 16, 64], np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values; the last group is filled with zeros."""
    values = np.concatenate([values.astype("<u4"), np.zeros(-len(values) % 4, "<u4")])
    lengths = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control = (lengths.reshape(-1, 4) * _SHIFTS).sum(1, dtype=np.uint8)
    kept = np.arange(4) <= lengths[:, None]
    return control, values.view(np.uint8).reshape(-1, 4)[kept]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values."""
    lengths = LENGTHS[control].ravel()[:n]
    at = np.cumsum(lengths) - lengths
    values = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        values[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def write_block(out, doc_ids: list, counts: np.ndarray, ranks: np.ndarray) -> None:
    control, data = pack(ranks)
    out.write(HEADER.pack(len(doc_ids), len(ranks), len(control), len(data)))
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(counts.astype("<i8").tobytes())
    out.write(control.tobytes())
    out.write(data.tobytes())


def read_blocks(handle) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Document ids, their numbers of tokens, and ranks, block by block."""
    if handle.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while header := handle.read(HEADER.size):
        docs, n, n_control, n_data = HEADER.unpack(header)
        take = lambda count, kind: np.frombuffer(handle.read(count * np.dtype(kind).itemsize), kind)
        ids, null, counts = take(docs, "<i8"), take(docs, np.uint8), take(docs, "<i8")
        control, data = take(n_control, np.uint8), take(n_data, np.uint8)
        yield pa.array(ids, mask=null.astype(bool)), counts, unpack(control, data, n)


@dataclass
class TokenFiles:
    """Written files: a table ``part, path, n_docs, n_tokens``, and the id of each rank."""

    manifest: DataFrame
    ids: np.ndarray


def _encode(path: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.open(path)
        for batch in batches:
            ids, bounds = tokenizer.encode(batch.column("text"), end_id)
            ids = ids.astype(kind)
            rows = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "ids"])
    return run


def _count(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.column("ids"):
                total += np.bincount(np.frombuffer(row.as_buffer(), kind), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["id", "n"])
    return run


def _write(folder: str, ranks: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, tokens = TaskContext.get().partitionId(), 0, 0
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.tokens"
        with publish_file(path) as out:
            out.write(MAGIC)
            ids, rows, held = [], [], 0
            for batch in batches:
                for doc_id, row in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                    values = np.frombuffer(row.as_buffer(), kind)
                    ids.append(doc_id)
                    rows.append(values)
                    held += len(values)
                    if held >= BLOCK:
                        write_block(out, ids, np.array([len(r) for r in rows]), ranks[np.concatenate(rows)])
                        docs, tokens = docs + len(ids), tokens + held
                        ids, rows, held = [], [], 0
            if ids:
                write_block(out, ids, np.array([len(r) for r in rows]), ranks[np.concatenate(rows)])
                docs, tokens = docs + len(ids), tokens + held
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [path],
                                          "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})
    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, folder: str | None = None) -> TokenFiles:
    """Write the ids of whole texts in ascending ``doc_id`` order to ``folder``.

    Null and empty texts have the end id alone. A null ``doc_id`` comes first; repeated ones are
    ordered by a hash of their ids. The rank table has an entry for each id of the vocabulary, so
    its size does not depend on the corpus. An empty table gives files without blocks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = max(end_id + 1, WordTokenizer.open(tokenizer).library.get_vocab_size(with_added_tokens=True))
    kind = "<u2" if size <= 1 << 16 else "<u4"
    folder = folder or scratch.path("files")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = scratch.keep(rows.mapInArrow(_encode(tokenizer, end_id, kind), "doc_id long, ids binary"), "ids", "zstd")
    counts = encoded.select("ids").mapInArrow(_count(kind, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(size, np.int64)
    for row in counts.collect():
        total[row["id"]] = row["n"]
    ids = np.argsort(-total, kind="stable")
    ranks = np.empty(size, np.uint32)
    ranks[ids] = np.arange(size, dtype=np.uint32)
    ordered = encoded.withColumn("tie", F.xxhash64("ids"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    manifest = scratch.keep(ordered.mapInArrow(_write(folder, ranks, kind), "part long, path string, n_docs long, n_tokens long"), "manifest")
    scratch.drop(encoded)
    return TokenFiles(manifest, ids)


def _digest(unrank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with open_input(path) as handle:
                    for doc_ids, counts, ranks in read_blocks(handle):
                        raw = unrank[ranks].astype("<u4").tobytes()
                        ends = np.cumsum(counts)
                        crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [doc_ids, pa.array(start + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(counts.sum())
    return run


def _tokens(unrank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_input(path) as handle:
                    for doc_ids, counts, ranks in read_blocks(handle):
                        bounds = np.concatenate([np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)])
                        ids = pa.array(unrank[ranks].astype(np.int32))
                        yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(bounds), ids)], names=["doc_id", "ids"])
    return run


def _files(written: TokenFiles) -> DataFrame:
    """A row for each file, with the number of ids in all files before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = written.manifest.where("n_docs > 0")
    files = files.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism)


def read_tokens(written: TokenFiles) -> DataFrame:
    """``doc_id, ids`` of every document, the end id included."""
    return _files(written).mapInArrow(_tokens(written.ids), "doc_id long, ids array<int>")


def read_digests(written: TokenFiles) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    return _files(written).mapInArrow(_digest(written.ids), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_digests(write_tokens(docs, tokenizer, end_id, Scratch(spark, "tokens")))
