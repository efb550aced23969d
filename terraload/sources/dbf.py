"""DBF tables as a splittable data source.

Tasks cut fixed-width records into text fields; typing is done by Spark expressions.
"""

from __future__ import annotations

import codecs
import re
import struct
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraload.functions import names, parsing
from terraload.sources import files

DEFAULT_SPLIT_BYTES = 128 << 20
CHUNK_BYTES = 8 << 20
FIELD_TYPES = "CNDLF"
DELETED_COLUMN = "_deleted"
BIGINT_DIGITS = 18
# Whole numbers, also when written with a point or as a power of ten that hides none.
WHOLE_PATTERN = r"^[+-]?[0-9]+(?:\.0*)?$"
# Language marks of the header and the code pages they stand for; fixed values of the format.
CODE_PAGES = {
    0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x57: "cp1252", 0x64: "cp852", 0x65: "cp866", 0x66: "cp865", 0x67: "cp861",
    0x6A: "cp737", 0x6B: "cp857", 0x78: "cp950", 0x79: "cp949", 0x7A: "cp936", 0x7B: "cp932", 0x7C: "cp874", 0x7D: "cp1255",
    0x7E: "cp1256", 0xC8: "cp1250", 0xC9: "cp1251", 0xCA: "cp1254", 0xCB: "cp1253", 0xCC: "cp1257",
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    width: int
    decimals: int


@dataclass(frozen=True)
class Layout:
    """Where a table's records lie and how they are cut."""

    fields: tuple[Field, ...]
    n_records: int
    header_bytes: int
    record_bytes: int
    language: int = 0

    def record_type(self):
        return np.dtype([("mark", "S1")] + [(f"f{i}", f"S{f.width}") for i, f in enumerate(self.fields)])


def read_layout(handle) -> Layout:
    prefix = files.read_range(handle, 0, 32)
    n_records, header_bytes, record_bytes = struct.unpack("<IHH", prefix[4:12])
    described = files.read_range(handle, 32, header_bytes - 32)
    found = []
    for at in range(0, len(described) - 31, 32):
        if described[at] == 0x0D:
            break
        raw_name, kind, width, decimals = struct.unpack("<11sc4xBB14x", described[at:at + 32])
        name = raw_name.split(b"\0")[0].decode("latin-1").strip()
        if kind == b"C":  # long character fields keep the high byte of their width here
            width, decimals = width + 256 * decimals, 0
        found.append((name, kind.decode("latin-1"), width, decimals))
    unknown = [f"{n} ({k})" for n, k, _, _ in found if k not in FIELD_TYPES]
    if unknown:
        raise ValueError(f"column type not supported: {', '.join(unknown)}")
    cleaned = names.unique_names([names.clean_name(f[0]) for f in found])
    return Layout(tuple(Field(c, *f[1:]) for c, f in zip(cleaned, found)), n_records, header_bytes, record_bytes, prefix[29])


def declared_encoding(path: str, layout: Layout) -> str | None:
    """Encoding that a file beside the table or the table's header names; None when neither does."""
    side = files.sibling(path, ".cpg")
    if side is not None:
        with files.open_input(side) as handle:
            named = handle.read(64).decode("ascii", "ignore").strip().lower()
        number = re.sub(r"^(ansi|oem|cp|windows)[ _-]*", "", named)
        for candidate in (f"cp{number}" if number.isdigit() else named, named):
            try:
                return codecs.lookup(candidate).name
            except LookupError:
                continue
    return CODE_PAGES.get(layout.language)


def text_array(raw: np.ndarray, encoding: str | None) -> pa.Array:
    """Bytes to text; without a named encoding, what is not UTF-8 is Windows-1252."""
    values = pa.array(raw, pa.binary())
    if encoding in (None, "utf-8"):
        try:
            return values.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([_decode(v) for v in values.to_pylist()], pa.string())
    table = _letters(encoding)
    if table is None:
        return pa.array([v.decode(encoding, errors="replace") for v in values.to_pylist()], pa.string())
    width = raw.dtype.itemsize
    codes = table[np.ascontiguousarray(raw).view(np.uint8).reshape(len(raw), width)]
    return pa.array(codes.view(f"U{width}").reshape(len(raw)), pa.string())


@cache
def _letters(encoding: str) -> np.ndarray | None:
    """Code points of all bytes, for encodings of one byte each."""
    try:
        letters = [bytes([b]).decode(encoding, errors="replace") for b in range(256)]
        if any(len(c) != 1 for c in letters) or len("\xe9".encode(encoding, errors="replace")) > 1:
            return None
    except UnicodeError:
        return None
    return np.array([ord(c) for c in letters], np.uint32)


def _decode(value: bytes) -> str:
    try:
        return value.decode("utf-8")
    except UnicodeDecodeError:
        return value.decode("cp1252", errors="ignore")


def cut_records(block: bytes, layout: Layout, columns: list[str], encoding: str | None):
    """Text arrays of the wanted columns, and the deletion marks."""
    used = sum(f.width for f in layout.fields) + 1
    n = len(block) // layout.record_bytes
    packed = np.frombuffer(block, np.uint8, n * layout.record_bytes).reshape(n, layout.record_bytes)
    records = np.ascontiguousarray(packed[:, :used]).view(layout.record_type()).reshape(n)
    position = {f.name: i for i, f in enumerate(layout.fields)}
    arrays = [text_array(records[f"f{position[c]}"], encoding) for c in columns]
    return arrays, records["mark"] != b" "


class DbfSource(DataSource):
    """``spark.read.format("dbf").load(path)``: text columns plus ``_deleted``.

    Options: ``columns`` (comma-separated), ``encoding``, ``splitBytes``.
    """

    @classmethod
    def name(cls):
        return "dbf"

    def schema(self):
        wanted = wanted_columns(self.options, [f.name for f in first_layout(self.options["path"], ".dbf").fields])
        return ", ".join(f"`{c}` string" for c in wanted) + f", {DELETED_COLUMN} boolean"

    def reader(self, schema):
        return DbfReader(self.options, [c for c in schema.fieldNames() if c != DELETED_COLUMN])


class DbfReader(DataSourceReader):
    def __init__(self, options, columns):
        self.path = options["path"]
        self.columns = columns
        self.encoding = options.get("encoding")
        self.split_bytes = int(options.get("splitBytes", DEFAULT_SPLIT_BYTES))

    def partitions(self):
        found = [(path, size, 1) for path, size in data_files(self.path, ".dbf")]
        return [InputPartition(p) for p in files.task_packs(files.pack_ranges(found, self.split_bytes), self.split_bytes)]

    def read(self, partition):
        for path, start, end in partition.value:
            with files.open_input(path) as handle:
                layout = read_layout(handle)
                check_columns(path, layout, self.columns)
                encoding = self.encoding or declared_encoding(path, layout)
                # A record belongs to the range that holds its first byte.
                first = max(0, -(-(start - layout.header_bytes) // layout.record_bytes))
                last = min(layout.n_records, max(0, -(-(end - layout.header_bytes) // layout.record_bytes)))
                step = max(1, CHUNK_BYTES // layout.record_bytes)
                for at in range(first, last, step):
                    count = min(step, last - at)
                    block = files.read_range(
                        handle, layout.header_bytes + at * layout.record_bytes, count * layout.record_bytes)
                    arrays, deleted = cut_records(block, layout, self.columns, encoding)
                    yield pa.RecordBatch.from_arrays(
                        [*arrays, pa.array(deleted)], [*self.columns, DELETED_COLUMN])


def data_files(path: str, suffix: str) -> list[tuple[str, int]]:
    return [(p, s) for p, s in files.list_files(path) if p.lower().endswith(suffix)]


def first_layout(path: str, suffix: str) -> Layout:
    found = data_files(path, suffix)
    if not found:
        raise ValueError(f"no {suffix} file in {path}")
    with files.open_input(found[0][0]) as handle:
        return read_layout(handle)


def wanted_columns(options, available: list[str]) -> list[str]:
    wanted = options.get("columns")
    return [c for c in available if c in set(wanted.split(","))] if wanted else available


def check_columns(path: str, layout: Layout, columns: list[str]) -> None:
    absent = set(columns) - {f.name for f in layout.fields}
    if absent:
        raise ValueError(f"{path} lacks the columns {sorted(absent)}")


def typed(text, field: Field, as_double: bool = False):
    """Expression that gives a text field its value."""
    if field.kind == "C":
        return parsing.parse_char(text)
    if field.kind == "D":
        return parsing.parse_date(text)
    if field.kind == "L":
        return parsing.parse_bool(text)
    if field.kind == "F" or field.decimals or as_double:
        return parsing.parse_float(text)
    if field.width > BIGINT_DIGITS:
        bare = F.trim(text)
        return F.when(bare.rlike(parsing.DECIMAL_PATTERN), bare.try_cast("decimal(38,0)"))
    # Whole numbers take the first branch; only other numbers need a closer look.
    bare = F.trim(text)
    number = bare.try_cast("double")
    hint = F.lit(f"column {field.name} is declared whole but holds other numbers; read it with doubles=['{field.name}']")
    other = F.when(number == F.floor(number), number.try_cast("bigint")).otherwise(F.raise_error(hint).cast("bigint"))
    return F.when(bare.rlike(parsing.INTEGER_PATTERN), bare.try_cast("bigint")).when(bare.rlike(parsing.DECIMAL_PATTERN), other)


def fractional_columns(text: DataFrame, layout: Layout, columns: list[str]) -> list[str]:
    """Columns declared whole whose values are not, found in one pass; of wide ones too, whose digits a double can't hold."""
    whole = [f.name for f in layout.fields if f.kind == "N" and not f.decimals and f.name in columns]
    if not whole:
        return []
    number = {c: F.trim(F.col(f"`{c}`")) for c in whole}
    other = [F.coalesce(F.bool_or(v.rlike(parsing.DECIMAL_PATTERN) & ~v.rlike(WHOLE_PATTERN)), F.lit(False)).alias(c) for c, v in number.items()]
    row = text.filter(~F.col(DELETED_COLUMN)).agg(*other).first()
    return [c for c in whole if row[c]]


def typed_columns(layout: Layout, columns: list[str], doubles: list[str]):
    by_name = {f.name: f for f in layout.fields}
    return [typed(F.col(f"`{c}`"), by_name[c], c in doubles).alias(c) for c in columns]


def read_dbf(spark: SparkSession, path: str, group_id: str | None = None, columns: list[str] | None = None,
             doubles: list[str] | None = None, include_deleted: bool = False, labels: dict[str, str] | None = None,
             **options) -> DataFrame:
    """Typed table without deleted rows (or with them, told by ``_deleted``).

    Columns declared whole that hold fractions become doubles: those named in ``doubles``, or labelled so
    in ``labels``; without either their values are looked at first. Whole numbers too wide for 64 bits become decimals.
    """
    spark.dataSource.register(DbfSource)
    layout = first_layout(path, ".dbf")
    reader = spark.read.format("dbf").options(**options)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    text = reader.load(path)
    wanted = [c for c in text.columns if c != DELETED_COLUMN]
    if doubles is None and labels is not None:
        doubles = [c for c in wanted if labels.get(c, "").lower() == "double precision"]
    if doubles is None:
        doubles = fractional_columns(text, layout, wanted)
    values = typed_columns(layout, wanted, doubles)
    table = text.select(*values, DELETED_COLUMN) if include_deleted else text.filter(~F.col(DELETED_COLUMN)).select(*values)
    return names.tag_tenant(table, group_id)
