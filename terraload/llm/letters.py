"""Words of a whole batch as runs of letters, in code points, and hashes of them and their parts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from terraload.llm import words

_EDGE = np.uint64(0x20)
_FACTORS = words.mix(np.arange(11, 27, dtype=np.uint64) * words.BASE) | np.uint64(1)
_tables: list[np.ndarray] = []


def _code_tables() -> list[np.ndarray]:
    """For each code point whether it is a letter, and its lower-case form if that is one code point."""
    if not _tables:
        lowered = (c.lower() for c in map(chr, range(0x110000)))
        _tables.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
        _tables.append(np.fromiter((ord(c) if len(c) == 1 else i for i, c in enumerate(lowered)), np.uint32, 0x110000))
    return _tables


@dataclass
class LetterWords:
    """Lower-case code points of all texts, ranges of words, the range of each text's words, and
    where each text begins. A line end stands behind each text."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return words.range_hashes(lambda low, high: words.mix(self.codes[low:high].astype(np.uint64) + words.BASE),
                                  len(self.codes), self.starts, self.ends)


def split(column) -> LetterWords:
    is_letter, lower = _code_tables()
    texts = [t or "" for t in column.to_pylist()]
    codes = lower[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)]
    edges = np.flatnonzero(np.diff(is_letter[codes].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))])
    return LetterWords(codes, edges[::2], edges[1::2], np.searchsorted(edges[::2], bounds), bounds)


def padded(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of words with an edge mark on either side, their bounds, and the word of each."""
    sizes = ends - starts + 2
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    word = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(bounds[-1]) - bounds[word] + starts[word] - 1
    out = np.full(len(at), _EDGE, np.uint64)
    inner = np.ones(len(at), bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    out[inner] = codes[at[inner]]
    return out, bounds, word


def gram_hashes(codes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` codes from each place on."""
    h = np.full(len(first), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h += (codes[first + k] + np.uint64(1)) * _FACTORS[k]
        return words.mix(h)
