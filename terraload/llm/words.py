"""Words of a whole Arrow batch of texts at once, as byte ranges, and 64-bit hashes of them.

A text is its UTF-8 bytes. A class table says which bytes separate words; bytes from 128 on never
do. A null text has no words. All sums and products of hashes wrap around at 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute known

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators ``[\x20\x09-\x0D]``.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Separators ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``, to be used on lower-cased bytes.
NOT_ALNUM = np.zeros(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    NOT_ALNUM[_low:_high + 1] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_STEP = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a well-known mixing generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base)]))


_UP = _powers(BASE, _STEP)
_DOWN = _powers(_BASE_INVERSE, _STEP)


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return bytes_[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: bytes, ranges of words, and for each text the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more than texts: words of text i are first[i]:first[i + 1]

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(column, separators: np.ndarray = SPACES, lower: bool = True) -> Words:
    data, offsets = texts_of(column)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    finishes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets))


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    return range_hashes(lambda low, high: BYTE_VALUES[words.data[low:high]], len(words.data), words.starts, words.ends)


def range_hashes(values: Callable[[int, int], np.ndarray], n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of ``n`` values: their polynomial, mixed with their number.

    Prefix sums of ``value * BASE**position`` give any range's polynomial by one subtraction; the
    power at its start is divided out. ``values`` gives the values of a stretch.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        high = np.uint64(1)
        for at in range(0, n, _STEP):
            end = min(at + _STEP, n)
            sums[at + 1:end + 1] = values(at, end) * _UP[:end - at] * high
            high = high * _UP[-1] * BASE
        np.cumsum(sums, out=sums)
        h = sums[ends] - sums[starts]
        coarse = np.full(n // _STEP + 1, _DOWN[-1] * _BASE_INVERSE)
        coarse[0] = 1
        np.multiply.accumulate(coarse, out=coarse)
        h *= _DOWN[starts % _STEP] * coarse[starts // _STEP]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(word_hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within each text, and the range of each text's runs.

    A text of fewer words, but not none, has one run of all its words.
    """
    n = np.diff(first)
    runs = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(runs)])
    at = np.repeat(first[:-1] - bounds[:-1], runs) + np.arange(bounds[-1])
    short = np.repeat(n, runs) < size
    end = np.repeat(first[1:], runs)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            factor = mix(np.array([k + 1], np.uint64) * BASE)[0] | np.uint64(1)
            if short.any():
                take = at + k < end
                out[take] += word_hashes[at[take] + k] * factor
            else:
                out += word_hashes[at + k] * factor
        return mix(out + np.minimum(np.repeat(n, runs), size).astype(np.uint64)), bounds


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Join batches that are sorted by ``keys`` into tables that never cut a group in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k)
            same = np.asarray(pa.compute.equal(column[1:], column[:-1]).fill_null(False))
            change[1:] |= ~same
        cuts = np.flatnonzero(change)
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if any(last.column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
        if len(cuts):
            cut = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
