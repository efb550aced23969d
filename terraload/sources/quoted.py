"""Records of delimited text whose quoted fields hold line ends, cut by byte range.

1. A task looks at each range once and says, in one small row, in which state the range ends: in a quoted field or
   outside one, for either state it may begin in. The driver, which knows the ranges, chains these.
2. With its first state known, a range finds the line ends outside of quotes. A record belongs to the range that
   holds the line end before it, and its task reads on behind the range to where the record ends.

A quote opens a field only at the field's start, as the parser has it; inside a quoted field two quotes stand for one.
So a single quote behind other text never opens one, and after a quote that stands there a text is always
outside. That makes the state at any place a matter of the quotes since the last such one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terraload.sources import archive, files

RANGE_BYTES = 16 << 20
BLOCK = 1 << 20
LOOK_BACK = 64
QUOTE, LINE_END, RETURN, MARK = 34, 10, 13, 39


def header_end(handle) -> int:
    """Where the bytes behind the first line begin."""
    at = 0
    while block := files.read_range(handle, at, BLOCK):
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return at


def moved(handle, at: int, size: int) -> int:
    """The first place from ``at`` on that has no quote before it, so that no pair of quotes is cut."""
    while 0 < at < size and files.read_range(handle, at - 1, 1) == b'"':
        at += 1
    return at


def odd_quotes(data: np.ndarray, before: bytes, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the runs of an odd number of quotes, and whether each stands at a field's start.

    ``before`` is what stands before the data, without quotes at its end; nothing stands before a file's first field.
    """
    is_quote = np.concatenate([[False], data == QUOTE, [False]])
    edges = np.flatnonzero(is_quote[1:] != is_quote[:-1])
    starts, ends = edges[::2], edges[1::2]
    odd = (ends - starts) % 2 == 1
    starts, ends = starts[odd], ends[odd]
    # Single quotes are dropped from lines before they are parsed: what counts is the byte before them.
    at = starts - 1
    while len(marks := np.flatnonzero((at >= 0) & (data[np.maximum(at, 0)] == MARK))):
        at[marks] -= 1
    last = before.rstrip(b"'")[-1:]
    first = last == b"" or last[0] in (separator, LINE_END, RETURN)
    opens = np.isin(data[np.maximum(at, 0)], np.array([separator, LINE_END, RETURN], np.uint8))
    return ends, np.where(at >= 0, opens, first)


def states(at_start: np.ndarray, inside: bool) -> np.ndarray:
    """Inside a quoted field, after each run of quotes, if the text before the first one is so."""
    n = len(at_start)
    reset = np.maximum.accumulate(np.where(at_start, -1, np.arange(n)))
    count = np.arange(n) - reset
    return (count + (inside & (reset < 0))) % 2 == 1


def _look(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for path, start, end, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "size"))):
                with files.open_input(path) as handle:
                    low, high = moved(handle, start, size), moved(handle, end, size)
                    if start < BLOCK:
                        head = header_end(handle)
                        low, high = max(low, head), max(high, head)
                    data = np.frombuffer(files.read_range(handle, low, high - low), np.uint8)
                    before = files.read_range(handle, max(low - LOOK_BACK, 0), min(low, LOOK_BACK))
                    ends, at_start = odd_quotes(data, before, separator)
                    lines = np.flatnonzero(data == LINE_END)
                    found = {"path": path, "start": start, "low": low, "high": high}
                    for inside in (False, True):
                        after = states(at_start, inside)
                        found[f"end_{int(inside)}"] = bool(after[-1]) if len(after) else inside
                        known = np.concatenate([[inside], after])
                        found[f"held_{int(inside)}"] = bool(known[np.searchsorted(ends, lines, side="right")].any())
                    rows.append(found)
        names = ["path", "start", "low", "high", "end_0", "end_1", "held_0", "held_1"]
        kinds = [pa.string(), *[pa.int64()] * 3, *[pa.bool_()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)
    return run


def _records(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, low, high, inside, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "low", "high", "inside", "size"))):
                with files.open_input(path) as handle:
                    if low is None:
                        low, high = header_end(handle), size
                    data = files.read_range(handle, low, high - low)
                    before = files.read_range(handle, max(low - LOOK_BACK, 0), min(low, LOOK_BACK))
                    cuts, inside = _line_ends(data, before, separator, inside)
                    begins = ([0] if start == 0 else []) + (cuts + 1).tolist()
                    if not begins:
                        continue
                    # The last record goes on to the next line end outside of quotes, wherever that is.
                    tail, at = [], high
                    while at < size:
                        stop = moved(handle, min(at + BLOCK, size), size)
                        more = files.read_range(handle, at, stop - at)
                        found, inside = _line_ends(more, (before + data[-LOOK_BACK:] + b"".join(tail[-1:]))[-LOOK_BACK:], separator, inside)
                        at = stop
                        if len(found):
                            tail.append(more[:found[0] + 1])
                            break
                        tail.append(more)
                text = (data + b"".join(tail)).decode("latin-1")
                ends = [b - 1 for b in begins[1:]] + [len(text)]
                lines = [text[a:b].rstrip("\r\n") if b == len(text) else text[a:b].removesuffix("\r") for a, b in zip(begins, ends)]
                lines = [line for line in lines if line]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["path", "line"])
    return run


def _line_ends(data: bytes, before: bytes, separator: int, inside: bool) -> tuple[np.ndarray, bool]:
    """Line ends outside of quotes, and the state behind the last byte."""
    values = np.frombuffer(data, np.uint8)
    ends, at_start = odd_quotes(values, before, separator)
    known = np.concatenate([[inside], states(at_start, inside)])
    lines = np.flatnonzero(values == LINE_END)
    return lines[~known[np.searchsorted(ends, lines, side="right")]], bool(known[-1])


def record_lines(spark: SparkSession, sized: list[tuple[str, int]], separator: str, range_bytes: int = RANGE_BYTES,
                 always: bool = False) -> DataFrame | None:
    """``path, line`` of the records below the header line as ISO-8859-1 text, line ends in them and all; blank ones are dropped.

    None if no quoted field holds a line end, so that lines are records, unless ``always`` is set. ``sized`` has paths and
    sizes. The driver gets a row for each range; where ``always`` is set and each file is one range, nothing is looked at
    beforehand. A quoted field that is never closed goes on to the file's end, as one record, which the parser skips.
    """
    ranges = [(p, a, min(a + range_bytes, n), n) for p, n in sized for a in range(0, max(n, 1), range_bytes)]
    if always and len(ranges) == len(sized):
        known = [(path, 0, None, None, False, size) for path, _, _, size in ranges]
    else:
        listed = archive.spread(spark.createDataFrame(ranges, "path string, start long, end long, size long"), ["path", "start"], _tasks(spark, ranges))
        looked = listed.mapInArrow(_look(ord(separator)), "path string, start long, low long, high long, end_0 boolean, end_1 boolean, held_0 boolean, held_1 boolean")
        rows = {(r["path"], r["start"]): r for r in looked.collect()}
        inside, known, spans = False, [], always
        for path, start, _, size in ranges:
            row = rows[path, start]
            inside = inside and start > 0
            known.append((path, start, row["low"], row["high"], inside, size))
            spans |= row["held_1"] if inside else row["held_0"]
            inside = row["end_1"] if inside else row["end_0"]
        if not spans:
            return None
    table = spark.createDataFrame(known, "path string, start long, low long, high long, inside boolean, size long")
    return archive.spread(table, ["path", "start"], _tasks(spark, ranges)).mapInArrow(_records(ord(separator)), "path string, line string")


def _tasks(spark: SparkSession, ranges: list) -> int:
    return max(1, min(len(ranges), 4 * spark.sparkContext.defaultParallelism + len(ranges) // 4))
