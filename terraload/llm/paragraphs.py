"""Passages that repeat across documents, by paragraphs.

A paragraph is a line of at least ``PARAGRAPH`` words. Paragraphs are compared by MinHash banding: bands
are tuned for a recall at a similarity of 0.75 on five-word shingles, paragraphs that collide in a
band are joined, every candidate pair is confirmed by its exact Jaccard similarity, and
confirmed pairs become components. Lines may hold more than the passage that they share, so their clauses (up to
a full stop, comma or the like) of at least ``CLAUSE`` words are compared, too, but for equal words only (an edit
distance of 0). Passages need not be cut by stops: of any ``WINDOW`` neighbouring windows of ``WINDOW`` words the one with
the least hash is compared, too (winnowing). Equal passages choose equal windows, except among their outermost
``WINDOW - 1`` words, and the windows between leave no gap: every passage of ``LEAST + 2 * (WINDOW - 1)`` words is found.

In each document what repeats is merged to spans; up to ``GAP`` words between that repeat nowhere, as of shorter
clauses, are taken along. Spans with fewer than ``LEAST`` repeated words are left alone. A cluster stays in the first
document that has it and is to be removed from the others; that is decided word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute known
from pyspark.sql import DataFrame, functions as F

from terraload.llm import words
from terraload.llm.linking import linked_components, parity
from terraload.llm.neardup import signatures
from terraload.llm.scratch import Scratch, bounded_batches

SHINGLE = 5
PARAGRAPH = 20
CLAUSE = 4
WINDOW = 10
GAP = 8
LEAST = 20
SIMILARITY = 0.75
RECALL = 0.995
ROWS = 2

_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?,;:\n"]] = True

UNITS = "hash long, doc_id long, text_key long, first int, last int, start long, end long, line boolean"


def tuned_bands(recall: float, similarity: float, rows: int) -> int:
    """The least number of bands of ``rows`` coordinates that gives the recall at the similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


BANDS = tuned_bands(RECALL, SIMILARITY, ROWS)
_FACTORS = words.mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64) * words.BASE) | np.uint64(1)


def _runs(number: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) words of runs that share a number and a text."""
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(number))


def _sequence_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return words.range_hashes(lambda low, high: hashes[low:high], len(hashes), first, last)


def _bands(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """32 bits for each band of each run of words."""
    lengths = last - first
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    at = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], lengths)
    rows = signatures(*words.shingles(hashes[at], bounds, SHINGLE), _FACTORS).astype(np.uint64).reshape(-1, BANDS, ROWS)
    out = np.zeros(rows.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            out = words.mix(out + rows[:, :, r] + words.BASE)
    return (out >> np.uint64(32)).astype(np.uint32)


def _windows(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First words of the windows with the least hash among ``WINDOW`` neighbours of one text."""
    n = len(hashes) - 2 * (WINDOW - 1)
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(hashes) - WINDOW + 1)
    values = _sequence_hashes(hashes, at, at + WINDOW)
    least = values[:n].copy()
    for k in range(1, WINDOW):
        np.minimum(least, values[k:k + n], out=least)
    whole = np.ones(len(hashes), bool)
    for edge in bounds[1:-1].tolist():  # a text's words must hold all windows that are compared
        whole[max(0, edge - 2 * (WINDOW - 1)):edge] = False
    chosen = np.zeros(len(values), bool)
    for k in range(WINDOW):
        chosen[k:k + n] |= whole[:n] & (values[k:k + n] == least)
    return np.flatnonzero(chosen)


def _parts(batch: pa.RecordBatch):
    """Words, their hashes, and word ranges of paragraphs and of clauses that are no whole paragraph."""
    found = words.split(batch.column("text"), words.NOT_ALNUM)
    hashes, text = words.hashes(found), found.texts()
    lines = np.cumsum(found.data == 10)[found.starts]
    clauses = np.cumsum(_STOPS[found.data])[found.starts]
    first, last = _runs(lines, text)
    long = last - first >= PARAGRAPH
    line_first, line_last = first[long], last[long]
    first, last = _runs(clauses, text)
    whole = np.isin(first, line_first) & np.isin(last, line_last)
    seeds = (last - first >= CLAUSE) & ~(whole & (last - first >= PARAGRAPH))
    return found, hashes, text, (line_first, line_last), (first[seeds], last[seeds])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, hashes, text, lines, clauses = _parts(batch)
        _, offsets = words.texts_of(batch.column("text"))
        windows = _windows(hashes, found.first)
        first, last = (np.concatenate(p) for p in zip(lines, clauses, (windows, windows + WINDOW)))
        owner = text[first]
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(_sequence_hashes(hashes, first, last).view(np.int64)), pa.array(ids[owner]), pa.array(keys[owner]),
             pa.array((first - found.first[owner]).astype(np.int32)), pa.array((last - found.first[owner]).astype(np.int32)),
             pa.array(found.starts[first] - offsets[owner]), pa.array(found.ends[last - 1] - offsets[owner]),
             pa.array(np.arange(len(first)) < len(lines[0]))],
            names=["hash", "doc_id", "text_key", "first", "last", "start", "end", "line"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, hashes, text, (first, last), _ = _parts(batch)
        found = words.split(batch.column("text"), words.NOT_ALNUM)
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
        owner = text[first]
        bands = [r.tobytes() for r in _bands(hashes, first, last)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(_sequence_hashes(hashes, first, last).view(np.int64)), pa.array(ids[owner]), pa.array(keys[owner]),
             pa.array((first - found.first[owner]).astype(np.int32)), pa.array((last - found.first[owner]).astype(np.int32)),
             pa.array(bands, pa.binary())], names=["hash", "doc_id", "text_key", "first", "last", "bands"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    high = np.arange(BANDS, dtype=np.int64) << 32
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint32).reshape(-1, BANDS)
            rep = np.repeat(batch.column("rep").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array((values + high).ravel()), pa.array(rep)], names=["key", "rep"])


def _paragraph_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the paragraphs that each row asks for."""
    for batch in batches:
        found = words.split(batch.column("text"), words.NOT_ALNUM)
        hashes = words.hashes(found)
        wanted = batch.column("wanted")
        counts = np.asarray(pa.compute.list_value_length(wanted))
        flat = wanted.flatten()
        base = np.repeat(found.first[:-1], counts)
        first, last = (flat.field(c).to_numpy() + base for c in ("first", "last"))
        bands = _bands(hashes, first, last)
        sets = []
        for low, high in zip(first.tolist(), last.tolist()):
            shingles, _ = words.shingles(hashes[low:high], np.array([0, high - low]), SHINGLE)
            sets.append(np.unique(shingles))
        yield pa.RecordBatch.from_arrays(
            [flat.field("rep"), pa.array([b.tobytes() for b in bands], pa.binary()), pa.array([parity(s) for s in sets], pa.binary()),
             pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["rep", "signature", "parity", "n_shingles", "shingles"])


def _covered(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of ``size`` words stand in one of the ranges."""
    return np.cumsum(np.bincount(first, minlength=size + 1) - np.bincount(last, minlength=size + 1))[:size] > 0


def _stretches(inside: np.ndarray, counted: np.ndarray, joins: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words ``inside`` with at least ``LEAST`` counted ones; up to ``GAP`` words between that all ``joins`` allows link runs."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    merged: list[list[int]] = []
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if merged and low - merged[-1][1] <= GAP and joins[merged[-1][1]:low].all():
            merged[-1][1] = high
        else:
            merged.append([low, high])
    return [(low, high) for low, high in merged if counted[low:high].sum() >= LEAST]


def _pieces(low: int, high: int, label: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Cut a stretch where the label changes; a piece of fewer than ``LEAST`` words goes to the one before, or the first to the next."""
    named = np.flatnonzero(label[low:high] >= 0)
    at = label[low + named]
    cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
    edges = [0, *named[cuts].tolist(), high - low]
    pieces: list[list[int]] = []
    for a, b, number in zip(edges[:-1], edges[1:], at[np.concatenate([[0], cuts])].tolist()):
        if pieces and (b - a < LEAST or pieces[-1][2] == number):
            pieces[-1][1] = b
        elif len(pieces) == 1 and pieces[0][1] - pieces[0][0] < LEAST:
            pieces[0][1:] = [b, number]
        else:
            pieces.append([a, b, number])
    for a, b, number in pieces:
        yield low + a, low + b, number


def _text_spans(table: pa.Table) -> list[dict]:
    """Spans of one text from its marked units.

    Words of a unit that stays in another document are to be removed where at least ``LEAST`` of them follow each other.
    A passage of at least ``LEAST`` words that stays here is taken out of a near copy of another document's line. What
    repeats and is not removed makes the other spans.
    """
    first, last, start, end, cluster, kept_in, line = (table.column(c).to_numpy() for c in ("first", "last", "start", "end", "cluster", "kept_in", "line"))
    doc_id, base = table.column("doc_id")[0].as_py(), int(first.min())
    first, last = first - base, last - base
    size = int(last.max())
    here = kept_in == doc_id
    own, other = (_covered(size, first[x], last[x]) for x in (here & ~line, ~here & ~line))
    marked, removed = _covered(size, first, last), _covered(size, first[~here], last[~here])
    only_here = own & ~other
    for low, high in _stretches(only_here, only_here, np.zeros(size, bool)):
        removed[low:high] = False
    # A label is a document and, for lines, a cluster; of a word's units the longest in the earliest document gives its label.
    label = {True: np.full(size, -1), False: np.full(size, -1)}
    names: dict[tuple[int, int | None], int] = {}
    number_of = np.zeros(len(first), np.int64)
    for i in np.lexsort((last - first, -kept_in)).tolist():
        number_of[i] = names.setdefault((int(kept_in[i]), int(cluster[i]) if line[i] else None), len(names))
        label[bool(here[i])][first[i]:last[i]] = number_of[i]
    starts, ends = dict(zip(first.tolist(), start.tolist())), dict(zip(last.tolist(), end.tolist()))
    taken, rows = np.zeros(size, bool), []

    def add(low: int, high: int, kept: bool) -> None:
        for a, b, number in _pieces(low, high, label[kept]):
            longest = np.where(number_of == number, np.minimum(last, b) - np.maximum(first, a), 0).argmax()
            rows.append({"doc_id": doc_id, "start": starts.get(a, ends.get(a)), "end": ends.get(b, starts.get(b)), "n_words": b - a,
                         "cluster": int(cluster[longest]), "kept_in": int(kept_in[longest]), "removed": not kept})

    for low, high in _stretches(removed, removed, ~marked):
        taken[low:high] = True
        add(low, high, False)
    rest = marked & ~taken
    for low, high in _stretches(rest, rest, ~taken):
        if (label[True][low:high] >= 0).any():
            add(low, high, True)
    return rows


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text, from units sorted by text."""
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()),
                       ("cluster", pa.int64()), ("kept_in", pa.int64()), ("removed", pa.bool_())])
    for table in words.grouped(batches, ["doc_id", "text_key"]):
        table = table.combine_chunks()
        ids, keys = (table.column(c).to_numpy() for c in ("doc_id", "text_key"))
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) + 1
        cuts = [0, *cuts.tolist(), len(ids)]
        rows = [r for low, high in zip(cuts[:-1], cuts[1:]) for r in _text_spans(table.slice(low, high - low))]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


def repeated_passages(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, start, end, n_words, cluster, kept_in, removed`` for each span of a row of ``docs`` (``doc_id, text``).

    ``start`` and ``end`` are bytes of the UTF-8 text; ``cluster`` and ``kept_in`` belong to the longest paragraph
    or clause in the span. A span is to be removed exactly if it stays in an earlier document, ``kept_in``; where the
    cluster of a paragraph, or the document that a passage stays in, changes for ``LEAST`` words, a span ends. What
    repeats within one document alone gives no span. Rows without id take no part, null and empty texts have no
    paragraphs, and rows that repeat another wholly act as one. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "paragraphs")
    bounded_batches(spark)
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    units = docs.mapInArrow(_units, UNITS)
    ends = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]
    exact = scratch.keep(units.groupBy("hash").agg(*ends).where("low < high"), "exact")

    found = docs.mapInArrow(_banded, "hash long, doc_id long, text_key long, first int, last int, bands binary")
    lines = scratch.keep(found.groupBy(F.col("hash").alias("rep")).agg(
        F.min(F.struct("doc_id", "text_key", "first", "last", "bands")).alias("at"), F.max("doc_id").alias("high"))
        .select("rep", "high", "at.*"), "lines")
    posts = lines.select("rep", "bands").mapInArrow(_posted, "key long, rep long")
    shared = scratch.keep(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    own = posts.join(shared, "key").groupBy("rep").agg(F.sum("n").alias("central"), F.collect_list("key").alias("keys"))
    posted = scratch.keep(own.select("rep", "central", F.lit(-1).cast("long").alias("mask"), F.explode("keys").alias("key")), "posted")
    wanted = (lines.join(posted.select("rep").distinct(), "rep", "left_semi").groupBy("doc_id", "text_key")
              .agg(F.collect_list(F.struct("rep", "first", "last")).alias("wanted")))
    sets = docs.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("text", "wanted")
    sets = scratch.keep(sets.mapInArrow(_paragraph_sets, "rep long, signature binary, parity binary, n_shingles long, shingles binary"), "sets")
    reps = sets.select("rep", "signature", "parity", "n_shingles")
    first, second = linked_components(posted, reps, sets.select(F.col("rep").alias("node"), "shingles"), 1, scratch)

    near = (first.join(second.toDF("component", "later"), "component", "left")
            .select(F.col("node").alias("hash"), F.coalesce("later", "component").alias("cluster")))
    near = scratch.keep(near, "near")
    marked = exact.join(near, "hash", "left").select("hash", F.coalesce("cluster", "hash").alias("cluster"), "low", "high")
    placed = near.join(lines.select(F.col("rep").alias("hash"), F.col("doc_id").alias("low"), "high"), "hash")
    marked = scratch.keep(marked.union(placed.select("hash", "cluster", "low", "high")).distinct(), "marked")
    clusters = scratch.keep(marked.groupBy("cluster").agg(F.min("low").alias("kept_in"), F.max("high").alias("last_in"))
                            .where("kept_in < last_in").drop("last_in"), "clusters")
    marks = scratch.keep(marked.select("hash", "cluster").distinct().join(clusters, "cluster"), "marks")
    scratch.drop(exact, lines, shared, posted, sets, first, second, near, marked, clusters)
    spark._jvm.System.gc()  # shuffles that nothing reads any more leave the disk before the largest one
    repeats = units.join(marks, "hash").repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "first", "last")
    spans = repeats.select("doc_id", "text_key", "first", "last", "start", "end", "cluster", "kept_in", "line").mapInArrow(
        _spans, "doc_id long, start long, end long, n_words long, cluster long, kept_in long, removed boolean")
    kept = scratch.keep(spans, "spans")
    scratch.drop(marks)
    return kept


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the removed spans cut out of ``text``; all columns and rows stay."""
    cut = spans.where("removed").groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set(F.struct("start", "end")).alias("_cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("_cut").to_pylist()):
                raw = None if text is None else text.encode()
                for c in sorted(cuts or [], key=lambda c: -c["start"]):
                    raw = raw[:c["start"]] + raw[c["end"]:]
                texts.append(None if raw is None else raw.decode())
            batch = batch.drop_columns(["_of", "_cut"])
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    return docs.join(cut, docs["doc_id"] == cut["_of"], "left").mapInArrow(run, docs.schema)
