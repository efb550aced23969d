"""Runs of words that repeat with a period, found by convolving blocks at dyadic scales.

1. A run is a longest stretch in which words ``q`` apart are equal, ``q`` being its smallest period, with at least
   ``max(6, 4 * q)`` words.
2. Scale: the scale ``b``, a power of two, finds the periods from ``b`` to ``2 * b - 1``. A text is cut into blocks of
   ``b`` words. A run of such a period has more than ``3 * b`` words before its last period, so a whole block lies
   there, and occurs again one period later.
3. Filter: each word of such a block comes again within less than ``2 * b`` words. Blocks with a
   word that does not are left out; this asks for less than an occurrence, so it loses none.
4. Convolution: the squared differences between a block and the following window at a distance sum to
   ``sum(x * x) + sum(y * y) - 2 * sum(x * y)``. The last sum is a cyclic correlation of length ``2 * b`` for all distances
   at once, by number theoretic transforms over as many primes as exceed the largest possible sum, so a sum is zero
   exactly where the block occurs. At the three smallest scales a transform costs more than the definition, and the differences are
   taken for all blocks of all texts at once.
5. Seeds: each occurrence is extended word by word, to the left and the right, in the order of distances. A stretch
   of a distance that lies within a run of a divisor of it has that smaller period and is no run of its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terraload.llm import words
from terraload.llm.scratch import pieces

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: The scales below this one are compared directly.
FIRST_SCALE = 8
#: Words transformed at a time.
CHUNK = 1 << 18
#: Primes ``k * 2**26 + 1`` below ``2**31``, each with a generator of its multiplicative group.
PRIMES = ((469762049, 3), (1811939329, 13), (2013265921, 31))
_twiddles: dict[tuple[int, int, bool], list[np.ndarray]] = {}


def twiddles(prime: int, generator: int, n: int, inverse: bool) -> list[np.ndarray]:
    """For each length ``2, 4, …, n`` the powers of a root of unity that its butterflies multiply by."""
    key = prime, n, inverse
    if key not in _twiddles:
        tables, half = [], 1
        while half < n:
            root = pow(generator, (prime - 1) // (2 * half), prime)
            root = pow(root, -1, prime) if inverse else root
            powers = np.ones(half, np.uint64)
            done = 1
            while done < half:
                powers[done:2 * done] = powers[:done] * np.uint64(pow(root, done, prime)) % np.uint64(prime)
                done *= 2
            tables.append(powers)
            half *= 2
        _twiddles[key] = tables
    return _twiddles[key]


def transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transforms of each row, whose length is a power of two; the values come out in bit-reversed order."""
    n, p = rows.shape[1], np.uint64(prime)
    out = rows.copy()
    for powers in reversed(twiddles(prime, generator, n, False)):
        view = out.reshape(len(rows), -1, 2, len(powers))
        low, high = view[:, :, 0], view[:, :, 1]
        apart = (low + p - high) * powers % p
        total = low + high
        view[:, :, 0] = np.minimum(total, total - p)
        view[:, :, 1] = apart
    return out


def back(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The rows whose transforms, in bit-reversed order, are given."""
    n, p = rows.shape[1], np.uint64(prime)
    out = rows.copy()
    for powers in twiddles(prime, generator, n, True):
        view = out.reshape(len(rows), -1, 2, len(powers))
        low, turned = view[:, :, 0].copy(), view[:, :, 1] * powers % p
        total, apart = low + turned, low + p - turned
        view[:, :, 0] = np.minimum(total, total - p)
        view[:, :, 1] = np.minimum(apart, apart - p)
    return out * np.uint64(pow(n, -1, prime)) % p


def occurrences(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``starts`` and distances from ``scale`` to ``2 * scale - 1`` at which the block there occurs again.

    ``ids`` are small whole numbers; an occurrence ends at its block's ``ends`` at the latest.
    """
    blocks, distances = [], []
    step, span = max(1, CHUNK // (2 * scale)), np.arange(2 * scale)
    largest = int(ids.max(initial=0)) ** 2 * scale
    primes, product = [], 1
    for prime, generator in PRIMES:
        if product <= largest:
            primes.append((prime, generator))
            product *= prime
    if product <= largest or 2 * scale > 1 << 26:
        raise ValueError("a text is too long for the exact transform")
    for at in range(0, len(starts), step):
        first, last = starts[at:at + step], ends[at:at + step]
        place = first[:, None] + scale + span
        window = np.where(place < last[:, None], ids[np.minimum(place, len(ids) - 1)], 0).astype(np.uint64)
        block = ids[first[:, None] + span[:scale]].astype(np.uint64)
        fits = first[:, None] + 2 * scale + span[:scale] <= last[:, None]
        for prime, generator in primes:
            p = np.uint64(prime)
            reverse = np.zeros_like(window)
            # Reversed around place 0, so that a product of transforms is a correlation.
            reverse[:, 0] = block[:, 0]
            reverse[:, scale + 1:] = block[:, :0:-1]
            crossed = back(transform(window % p, prime, generator) * transform(reverse % p, prime, generator) % p, prime, generator)[:, :scale]
            squares = np.zeros((len(first), 2 * scale + 1), np.uint64)
            np.cumsum(window * window % p, axis=1, out=squares[:, 1:])
            theirs = (squares[:, scale:2 * scale] - squares[:, :scale]) % p
            own = (block * block % p).sum(1, keepdims=True) % p
            fits &= (own + theirs + 2 * (p - crossed)) % p == 0
        row, distance = np.nonzero(fits)
        blocks.append(at + row)
        distances.append(scale + distance)
    return np.concatenate(blocks), np.concatenate(distances)


def _next_gap(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far behind each word the same one comes again in its text, and each word's number among the words of its text."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    same = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    gap = np.full(n + 1, np.iinfo(np.int64).max)
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    leader = np.concatenate([[True], ~same])
    first = order[np.maximum.accumulate(np.where(leader, np.arange(n), 0))]
    fresh = np.zeros(n, np.int64)
    fresh[order[leader]] = 1
    number = np.cumsum(fresh)
    ids = np.empty(n, np.int64)
    ids[order] = number[first]
    base = np.concatenate([[True], text[1:] != text[:-1]])
    return gap, ids - np.maximum.accumulate(np.where(base, number - 1, 0))


def _reach(ids: np.ndarray, at: int, stop: int, distance: int, step: int) -> int:
    """How many words from ``at`` on, going by ``step`` and no further than ``stop``, equal those ``distance`` behind them."""
    done, width, room = 0, 64, (stop - at) * step
    while done < room:
        width = min(width * 2, room - done)
        low = at + done if step > 0 else at - done - width + 1
        same = ids[low:low + width] == ids[low + distance:low + distance + width]
        bad = np.flatnonzero(~(same if step > 0 else same[::-1]))
        if len(bad):
            return done + int(bad[0])
        done += width
    return done


def _small_periods(ids: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each period below the first transformed scale: starts and lengths of its stretches in all texts."""
    for q in range(1, min(FIRST_SCALE, len(ids))):
        same = np.zeros(len(ids) - q + 2, np.int8)
        same[1:-1] = (ids[q:] == ids[:-q]) & (text[q:] == text[:-q])
        edges = np.flatnonzero(np.diff(same))
        starts, lengths = edges[::2], edges[1::2] - edges[::2] + q
        long = lengths >= max(LEAST_WORDS, LEAST_PERIODS * q)
        yield q, starts[long], lengths[long]


class _Found:
    """Runs of a text by period. Those of one period come in by their starts, and so by their ends too."""

    def __init__(self):
        self.runs: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, start: int, length: int, period: int) -> None:
        starts, ends = self.runs.setdefault(period, ([], []))
        starts.append(start)
        ends.append(start + length)

    def holds(self, start: int, end: int, distance: int) -> bool:
        """Does a stretch lie in a run whose period divides a distance?"""
        for q in self.runs if len(self.runs) < 32 else _divisors(distance):
            if distance % q == 0 and (known := self.runs.get(q)):
                at = bisect_right(known[0], start) - 1
                if at >= 0 and end <= known[1][at]:
                    return True
        return False


def _divisors(n: int) -> list[int]:
    low = [d for d in range(1, isqrt(n) + 1) if n % d == 0]
    return [*low, *(n // d for d in low)]


def text_runs(found: words.Words) -> list[list[tuple[int, int, int]]]:
    """For each text its runs ``(start, length, period)``, by start and period."""
    first, n_texts = found.first, len(found.first) - 1
    out = [_Found() for _ in range(n_texts)]
    if not len(found.starts):
        return [[] for _ in range(n_texts)]
    text, hashes = found.texts(), words.hashes(found)
    gap, ids = _next_gap(hashes, text)
    for q, starts, lengths in _small_periods(hashes, text):
        for start, length, k in zip(starts.tolist(), lengths.tolist(), text[starts].tolist()):
            if not out[k].holds(start, start + length, q):
                out[k].add(start, length, q)
    sizes, scale = np.diff(first), FIRST_SCALE
    while scale * LEAST_PERIODS <= sizes.max():
        long = np.flatnonzero(sizes >= scale * LEAST_PERIODS)
        counts = (sizes[long] - 2 * scale) // scale + 1
        owner = np.repeat(long, counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = first[owner] + place * scale
        near = np.maximum.reduceat(gap, np.stack([starts, starts + scale], 1).ravel())[::2] < 2 * scale
        starts, owner = starts[near], owner[near]
        if len(starts):
            blocks, distances = occurrences(ids, starts, first[owner + 1], scale)
            order = np.lexsort((starts[blocks], distances, owner[blocks]))
            last = (-1, -1, -1)
            for at, q, k in zip(starts[blocks[order]].tolist(), distances[order].tolist(), owner[blocks[order]].tolist()):
                # The rest of a stretch that has been extended already.
                if last[:2] == (k, q) and at + scale + q <= last[2]:
                    continue
                if out[k].holds(at, at + scale + q, q):
                    continue
                low = at - _reach(hashes, at - 1, first[k] - 1, q, -1)
                high = at + scale + q + _reach(hashes, at + scale, first[k + 1] - q, q, 1)
                last = (k, q, high)
                if high - low >= LEAST_PERIODS * q and not out[k].holds(low, high, q):
                    out[k].add(low, high - low, q)
        scale *= 2
    return [sorted((s - int(first[k]), e - s, q) for q, (starts, ends) in own.runs.items() for s, e in zip(starts, ends))
            for k, own in enumerate(out)]


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by single blanks."""
    found = text.split()
    if runs:
        edge = np.zeros(len(found) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        found = [found[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(found)


def _periodic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
    for batch in pieces(batches, mega_bytes=2):
        column = batch.column("text")
        found = words.split(column, lower=False)
        runs = text_runs(found)
        flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
        bounds = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(fields))
        texts = [_collapsed(t or b"", own) for t, own in zip(column.cast(pa.binary()).to_pylist(), runs)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(found.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), rows),
             pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs`` (``doc_id, text``).

    Words are runs of characters other than ASCII white space, numbered from 0. ``runs`` has ``start, length, period`` in
    words, by start and period; ``collapsed`` is the text without the words that any run holds behind its first period,
    its words joined by single blanks. A null or empty text has no words and no runs and collapses to an empty one. Rows are
    read one by one, so repeated ids and rows are no matter; other columns are ignored. An empty table gives an empty result.
    Nothing is shuffled. A text of more than ``2**27`` words is refused.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_periodic, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
