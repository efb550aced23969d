"""FM-index over a sequence of small whole numbers, in numpy.

Symbol 0 is a separator: it ends any match, and every separator counts as a symbol of its own,
ordered by place. So two suffixes differ at the next separator at the latest.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order. The sequence must end in a separator.

    The first sort packs as many symbols as fit into 63 bits beside the place. Suffixes that agree
    in all of these are sorted again by the rank of what follows, doubling the length each time.
    """
    n = len(symbols)
    place_bits = max(1, int(n - 1).bit_length())
    bits = max(1, int(symbols.max()).bit_length())
    taken = max(1, (63 - place_bits) // bits)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(taken, np.int64)])
    key = padded[:n].copy()
    alive = key > 0
    for t in range(1, taken):
        following = np.where(alive, padded[t:t + n], 0)
        key = (key << bits) | following
        alive = following > 0
    packed = np.sort((key << place_bits) | np.arange(n))
    order = packed & ((1 << place_bits) - 1)
    packed >>= place_bits
    new = np.ones(n, bool)
    new[1:] = (packed[1:] != packed[:-1]) | ~alive[order[1:]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    length = taken
    single = new.copy()
    single[:-1] &= new[1:]
    rows = np.flatnonzero(~single)
    while len(rows):
        places, heads = order[rows], group[rows]
        after = rank[places + length]
        by = np.argsort(heads * n + after)
        places, after, heads = places[by], after[by], heads[by]
        order[rows] = places
        new = np.ones(len(rows), bool)
        new[1:] = (heads[1:] != heads[:-1]) | (after[1:] != after[:-1])
        heads = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        group[rows] = heads
        rank[places] = heads
        single = new.copy()
        single[:-1] &= new[1:]
        rows = rows[~single]
        length *= 2
    return order


class Bits:
    """A bit sequence with ranks: packed words and the ones before each of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Ranks of any symbol: one level of bits for each bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        self.bits = bits
        for level in range(bits):
            one = (symbols >> (bits - 1 - level)) & 1 == 1
            self.levels.append(Bits(one))
            rest = symbols[~one]
            self.zeros.append(len(rest))
            symbols = np.concatenate([rest, symbols[one]])

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` entries' last ``symbol`` ends below the lowest level."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.bits - 1 - level)) & 1 == 1, zeros + ones, at - ones)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and ``down`` of them."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(at), bits.rank(at)
            symbol = (symbol << 1) | one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        """Index ``symbols``, whose last one must be a separator."""
        order = suffix_order(symbols)
        previous = symbols[order - 1]
        top = int(symbols.max())
        bits = max(1, top.bit_length())
        self.smaller = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.wavelet = Wavelet(previous, bits)
        codes = np.arange(top + 1)
        #: Added to ``down`` it gives the row of the suffix that is longer by one symbol.
        self.shift = self.smaller[:-1] - self.wavelet.down(codes, np.zeros(top + 1, np.int64))
        sampled = (order % sample == 0) | (previous == 0)
        self.marks = Bits(sampled)
        self.places = order[sampled]
        self.rows = len(symbols)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern.

        ``patterns`` has a row for each pattern, its symbols first and anything behind them.
        """
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.rows, np.int64)
        for step in range(patterns.shape[1]):
            on = np.flatnonzero((step < lengths) & (low < high))
            if not len(on):
                break
            symbol = patterns[on, lengths[on] - 1 - step]
            known = symbol < len(self.shift)
            high[on[~known]] = low[on[~known]]
            on, symbol = on[known], symbol[known]
            low[on] = self.wavelet.down(symbol, low[on]) + self.shift[symbol]
            high[on] = self.wavelet.down(symbol, high[on]) + self.shift[symbol]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffixes given by their rows, by steps back to a sampled one."""
        found = np.empty(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            ready = self.marks.get(rows)
            found[left[ready]] = self.places[self.marks.rank(rows[ready])] + steps
            left, rows = left[~ready], rows[~ready]
            symbol, down = self.wavelet.read(rows)
            rows = down + self.shift[symbol]
            steps += 1
        return found
