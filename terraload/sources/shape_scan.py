"""Records of a shapefile's byte range, found without an index.

Records follow each other without gaps, and each begins with its number and its length. A task looks for the
first place in its range from which several records follow that fit in number, length and type; it owns the
records that start in its range. At its end it makes sure that the next task will begin where its own records
lead: the first task begins at the first record, so all records are read once, or the file is refused.
"""

from __future__ import annotations

import struct

import numpy as np

from terraload.sources import files

HEADER = 100
# A record's header, its type, its box and the two counts of its parts and vertices.
HEAD_BYTES = 8 + 44
# Successive records that a start must lead to, and bytes that are looked through at a time.
CHAIN = 8
WINDOW = 1 << 20


class Shapes:
    """The records of one open file."""

    def __init__(self, path: str, handle):
        self.path, self.handle = path, handle
        head = files.read_range(handle, 0, HEADER + 8)
        if len(head) < HEADER or struct.unpack_from(">i", head)[0] != 9994:
            raise ValueError(f"{path} is no shapefile")
        self.end = struct.unpack_from(">i", head, 24)[0] * 2
        self.code = struct.unpack_from("<i", head, 32)[0]
        # Numbers should begin at 1, and begin at 0 in some files.
        self.base = struct.unpack_from(">i", head, HEADER)[0] if len(head) == HEADER + 8 else 1
        if handle.size() < self.end:
            raise ValueError(f"{path} is shorter than its header says")

    def record(self, at: int, held: tuple[int, bytes] = (0, b"")) -> tuple[int, int] | None:
        """``(number, content length)`` of the record at a place, None where there can be none.

        ``held`` is a stretch that has been read already, and where it begins.
        """
        start, block = held
        head = block[at - start:at - start + HEAD_BYTES] if start <= at and at + HEAD_BYTES <= start + len(block) else (
            files.read_range(self.handle, at, HEAD_BYTES))
        if at + 12 > self.end or len(head) < 12:
            return None
        number, words, code = *struct.unpack_from(">ii", head), struct.unpack_from("<i", head, 8)[0]
        length = 2 * words
        fits = self.base <= number and at + 8 + length <= self.end and self._length_fits(code, length, head)
        return (number, length) if fits else None

    def _length_fits(self, code: int, length: int, head: bytes) -> bool:
        if code == 0:
            return length == 4
        if code != self.code:
            return False
        # Heights and measures: 8 bytes a vertex, and 16 for their bounds; measures may be left out behind heights.
        layers = {0: [0], 1: [1, 2], 2: [0, 1]}.get(code // 10, [])
        if code % 10 == 1:
            return length in [20 + 8 * n for n in layers]
        if len(head) < (48 if code % 10 == 8 else HEAD_BYTES):
            return False
        if code % 10 == 8:
            n, fixed = struct.unpack_from("<i", head, 44)[0], 40
        else:
            parts, n = struct.unpack_from("<ii", head, 44)
            if not 0 <= parts <= n:
                return False
            fixed = 44 + 4 * parts
        return n >= 0 and length in [fixed + 16 * n + k * (16 + 8 * n) for k in layers]

    def leads_on(self, at: int, held: tuple[int, bytes]) -> bool:
        """Whether records with successive numbers follow from a place, ``CHAIN`` of them or all up to the end."""
        number = None
        for _ in range(CHAIN):
            if at == self.end:
                return number is not None
            found = self.record(at, held)
            if found is None or (number is not None and found[0] != number + 1):
                return False
            number, at = found[0], at + 8 + found[1]
        return True

    def first_start(self, low: int, high: int) -> int | None:
        """The first record that starts at ``low`` or later and before ``high``; contents are whole numbers of 4 bytes long."""
        low = HEADER + max(0, -(-(low - HEADER) // 4) * 4)
        high = min(high, self.end)
        while low < high:
            block = files.read_range(self.handle, low, min(WINDOW, high - low) + HEAD_BYTES)
            n = min((len(block) - 8) // 4, -(-min(WINDOW, high - low) // 4))
            if n <= 0:
                return None
            numbers = np.frombuffer(block, ">i4", n)
            words = np.frombuffer(block, ">i4", n, 4)
            codes = np.frombuffer(block, "<i4", n, 8)
            likely = (numbers >= self.base) & (words >= 2) & ((codes == self.code) | ((codes == 0) & (words == 2)))
            for k in np.flatnonzero(likely):
                if self.leads_on(low + 4 * int(k), (low, block)):
                    return low + 4 * int(k)
            low += 4 * n
        return None


def owned_spans(path: str, handle, first: int, last: int, most: int):
    """``(row of the first, places and lengths)`` of the records that start in a byte range, ``most`` at a time.

    Rows count from 0. Raises ``ValueError`` where records do not follow each other to the range's end.
    """
    shapes = Shapes(path, handle)
    at = HEADER if first <= HEADER else shapes.first_start(first, last)
    if at is None or at >= min(last, shapes.end):
        return
    last = min(last, shapes.end)
    number, row, spans = None, 0, []
    held = (0, b"")
    while at < last:
        if not held[0] <= at <= held[0] + len(held[1]) - HEAD_BYTES:
            held = (at, files.read_range(handle, at, min(WINDOW, last - at) + HEAD_BYTES))
        found = shapes.record(at, held)
        if found is None or (number is not None and found[0] != number + 1):
            raise ValueError(f"{path}: no record follows at byte {at}")
        number = found[0]
        if not spans:
            row = number - shapes.base
        spans.append((at, found[1]))
        at += 8 + found[1]
        if len(spans) == most:
            yield row, np.array(spans, np.int64)
            spans = []
    # Where this range's records lead to, the next one's must begin.
    if at < shapes.end and shapes.first_start(last, at + 4) != at:
        raise ValueError(f"{path}: records after byte {last} are in doubt; the next should begin at {at}")
    if spans:
        yield row, np.array(spans, np.int64)
