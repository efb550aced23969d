"""Benchmark passages in training documents, by an FM-index over each shard of documents.

The benchmark's windows (``window`` consecutive words of an item; a shorter item is one window)
are the phrases. A shard is what one task has gathered up to ``SHARD_BYTES`` of text. Its words
become symbols; a word that no phrase has ends any match, so each run of such words is one
separator. Phrases go backward through the wavelet-tree ranks all at once, and their occurrences
are located by sampled suffix places. Overlapping occurrences are merged to spans to be removed.

Phrases lie in a table in the shared folder. Tasks read it in blocks of at most ``PHRASES``, and
index the shard anew for each block, so neither benchmark nor corpus is ever held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute known
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from terraload.llm import words
from terraload.llm.fm_index import FMIndex
from terraload.llm.scratch import Scratch, bounded_batches
from terraload.sources.files import list_files, open_input

WINDOW = 10
SHARD_BYTES = 8 << 20
PHRASES = 200_000
#: Occurrences located at a time.
LOCATED = 1 << 20

SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "items array<string>, spans array<struct<start: long, end: long>>")


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words.split(batch.column("text"), words.NOT_ALNUM)
            raw = found.data.tobytes()
            each = [raw[a:b].decode() for a, b in zip(found.starts.tolist(), found.ends.tolist())]
            ids, phrases = [], []
            for item, low, high in zip(batch.column("item").to_pylist(), found.first[:-1].tolist(), found.first[1:].tolist()):
                for at in range(low, max(high - size, low) + 1 if high > low else low):
                    ids.append(item)
                    phrases.append(" ".join(each[at:min(at + size, high)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(phrases, pa.string())],
                                             names=["item", "phrase"])
    return run


class Phrases:
    """A block of phrases as rows of symbols; symbols count from 1 in the order of word hashes."""

    def __init__(self, table: pa.Table):
        found = words.split(table.column("phrase"), words.NOT_ALNUM)
        hashes = words.hashes(found)
        self.known = np.unique(hashes)
        self.lengths = np.diff(found.first)
        self.symbols = np.zeros((len(self.lengths), int(self.lengths.max(initial=1))), np.int64)
        within = np.arange(len(hashes)) - np.repeat(found.first[:-1], self.lengths)
        self.symbols[found.texts(), within] = np.searchsorted(self.known, hashes) + 1
        items = table.column("item").combine_chunks().dictionary_encode()
        self.names, self.items = items.dictionary.to_pylist(), items.indices.to_numpy()

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == hashes, at + 1, 0)


def _blocks(folder: str) -> Iterator[Phrases]:
    for path, _ in list_files(folder):
        if path.endswith(".parquet"):
            with open_input(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(PHRASES, columns=["item", "phrase"]):
                    if batch.num_rows:
                        yield Phrases(pa.Table.from_batches([batch]))


def _find(hashes: np.ndarray, first: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(first word, phrase)`` of every occurrence within a text."""
    n_texts = len(first) - 1
    text = np.repeat(np.arange(n_texts), np.diff(first))
    symbols = np.zeros(len(hashes) + n_texts + 1, np.int64)
    symbols[np.arange(len(hashes)) + text + 1] = phrases.encode(hashes)
    origin = np.zeros(len(symbols), np.int64)
    origin[np.arange(len(hashes)) + text + 1] = np.arange(len(hashes))
    kept = np.ones(len(symbols), bool)
    kept[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
    symbols, origin = symbols[kept], origin[kept]
    if symbols[-1]:
        symbols, origin = np.append(symbols, 0), np.append(origin, 0)
    if not symbols.any():
        return
    index = FMIndex(symbols)
    low, high = index.search(phrases.symbols, phrases.lengths)
    hit = np.flatnonzero(low < high)
    ends = np.cumsum(high[hit] - low[hit])
    while len(hit):
        take = max(1, int(np.searchsorted(ends, LOCATED, side="right")))
        some = hit[:take]
        counts = high[some] - low[some]
        rows = np.repeat(low[some] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        yield origin[index.locate(rows)], np.repeat(some, counts)
        hit, ends = hit[take:], ends[take:] - ends[take - 1]


def _scan(folder: str):
    def shard(ids: pa.Array, texts: pa.ChunkedArray, blocks) -> pa.RecordBatch:
        found = words.split(texts, words.NOT_ALNUM)
        hashes = words.hashes(found)
        n_words = np.diff(found.first)
        change = np.zeros(len(hashes) + 1, np.int32)
        items: list[set[str]] = [set() for _ in range(len(n_words))]
        for phrases in blocks:
            for at, phrase in _find(hashes, found.first, phrases):
                np.add.at(change, at, 1)
                np.add.at(change, at + phrases.lengths[phrase], -1)
                owner = np.searchsorted(found.first, at, side="right") - 1
                for pair in np.unique(owner * len(phrases.names) + phrases.items[phrase]).tolist():
                    items[pair // len(phrases.names)].add(phrases.names[pair % len(phrases.names)])
        hit = np.cumsum(change[:-1]) > 0
        n_hit = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(hit)])[found.first])
        text = found.texts()
        begins, finishes = hit.copy(), hit.copy()
        same = text[1:] == text[:-1]
        begins[1:] &= ~(hit[:-1] & same)
        finishes[:-1] &= ~(hit[1:] & same)
        lows, highs = np.flatnonzero(begins), np.flatnonzero(finishes)
        _, offsets = words.texts_of(texts)
        base = offsets[text[lows]]
        spans = pa.StructArray.from_arrays([pa.array(found.starts[lows] - base), pa.array(found.ends[highs] - base)],
                                           names=["start", "end"])
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(text[lows], minlength=len(n_words)))])
        named = [sorted(s) for s in items]
        digests = [hashlib.sha256(",".join(s).encode()).hexdigest() for s in named]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n_words), pa.array(n_hit), pa.array([len(s) for s in named], pa.int64()), pa.array(digests),
             pa.array(n_hit > 0), pa.array(named, pa.list_(pa.string())),
             pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        again = list(islice(_blocks(folder), 2))
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("text").nbytes
            if size >= SHARD_BYTES:
                yield whole(held, again)
                held, size = [], 0
        if held:
            yield whole(held, again)

    def whole(held, again) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        blocks = again if len(again) < 2 else _blocks(folder)
        return shard(table.column("doc_id").combine_chunks(), table.column("text"), blocks)

    return run


def _clean(folder: str):
    """Whole rows whose texts have no hit."""
    scan = _scan(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], names=["doc_id", "text"])

        for found in scan(texts()):
            table = pa.Table.from_batches(held).slice(0, found.num_rows)
            rest = pa.Table.from_batches(held).slice(found.num_rows)
            held[:] = rest.to_batches()
            yield from table.filter(pa.compute.invert(found.column("contaminated"))).to_batches()
    return run


def _phrases(benchmark: DataFrame, window: int, scratch: Scratch) -> str:
    """The folder of the written table ``item, phrase``."""
    bounded_batches(benchmark.sparkSession)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    folder = scratch.path("phrases")
    items.mapInArrow(_windows(window), "item string, phrase string").distinct().write.parquet(folder)
    return folder


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """What of each row of ``docs`` (``doc_id, text``) stands in ``benchmark`` (``item_id, text``).

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans``; spans are
    ranges of bytes of the UTF-8 text, without overlap, in order. Null and empty texts have no
    words. Benchmark rows without id or text take no part; repeated rows count once. Each row of
    ``docs`` gives a row, whatever its id. Empty tables give no hits or no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    folder = _phrases(benchmark, window, scratch)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(folder), SCHEMA)


def without_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text nothing of ``benchmark`` stands."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    return docs.mapInArrow(_clean(_phrases(benchmark, window, scratch)), docs.schema)
