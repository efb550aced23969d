"""Delimited text whose separator and encoding are found out from its header line."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraload.constants import SEPARATORS
from terraload.functions import names, parsing, types
from terraload.functions.geometry import detect_geometry
from terraload.runtime import new_path
from terraload.sources import archive, files, quoted

HEAD_BLOCK = 1 << 16
# Stands behind the last field of a line, so that lines with too many fields can be told.
END_MARK = "\ue001end\ue001"
# Lines are read as ISO-8859-1, whose 256 characters this one is not among: no line is split.
NEVER = "\ue000"
# A doubled quote stands for one, a backslash for itself.
QUOTING = {"quote": '"', "escape": '"'}


@dataclass(frozen=True)
class Dialect:
    columns: list[str]
    separator: str
    encoding: str


def header_bytes(path: str) -> bytes:
    """First line of a file."""
    head = b""
    with files.open_input(path) as handle:
        while block := handle.read(HEAD_BLOCK):
            head += block
            if b"\n" in block or b"\r" in block:
                break
    return head.splitlines()[0] if head else b""


def _hidden(path: str) -> bool:
    return path.rsplit("/", 1)[-1].startswith(("_", "."))


def files_by_header(spark: SparkSession, path: str) -> list[tuple[bytes, list[str]]]:
    """Header lines and the files of each; empty files have none. A folder's hidden files do not count.

    The headers of a folder are read in tasks; the driver gets the paths, which the reader needs anyway.
    """
    found = [p for p, size in files.list_files(path) if size and (p == path or not _hidden(p))]
    return group_by_header(spark, found)


def group_by_header(spark: SparkSession, found: list[str]) -> list[tuple[bytes, list[str]]]:
    """Header lines and the files of each, for files that are not empty."""
    if len(found) <= 1:
        return [(header_bytes(p), [p]) for p in found]

    def heads(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([header_bytes(p) for p in paths], pa.binary()), batch.column("path")], names=["header", "path"])

    listed = spark.createDataFrame([(p,) for p in found], "path string")
    read = archive.spread(listed, ["path"]).mapInArrow(heads, "header binary, path string")
    groups = read.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    return sorted(((bytes(g["header"]), list(g["paths"])) for g in groups), key=lambda g: g[1])


def sniff_header(raw: bytes, path: str, separator: str | None = None, encoding: str | None = None) -> Dialect:
    """Columns, separator and encoding from the header line.

    A header with accents settles the encoding; an ASCII header leaves the choice to each line.
    """
    if not raw:
        raise ValueError(f"{path} is empty")
    if encoding is None:
        if raw.isascii():
            encoding = "auto"
        else:
            try:
                raw.decode("utf-8")
                encoding = "utf-8"
            except UnicodeDecodeError:
                encoding = "windows-1252"
    text = raw.decode("utf-8" if encoding in ("auto", "utf-8") else "cp1252", errors="ignore")
    text = text.lstrip("\ufeff").translate({ord(c): None for c in "'\r\n"})
    if separator is None:
        separator = next((s for s in SEPARATORS if s in text), SEPARATORS[-1])
    fields = next(csv.reader([text], delimiter=separator))
    columns = [f.strip() or f"unnamed_{i}" for i, f in enumerate(fields)]
    return Dialect(names.unique_names([names.clean_name(c) for c in columns]), separator, encoding)


def sniff(path: str, separator: str | None = None, encoding: str | None = None) -> Dialect:
    """The same for a file, or the first one of a folder."""
    found = [p for p, size in files.list_files(path) if size and (p == path or not _hidden(p))]
    return sniff_header(header_bytes(found[0]) if found else b"", path, separator, encoding)


def literal(path: str) -> str:
    """A path whose marks are not taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def visible(spark: SparkSession, path: str) -> str:
    """The path, or a copy under another name: Spark passes over files whose names begin with a mark."""
    if not _hidden(path):
        return path
    target = f"{new_path(spark, 'visible')}/{path.rsplit('/', 1)[-1].lstrip('_.') or 'file'}"

    def copy(batches):
        for batch in batches:
            if batch.num_rows:
                with files.open_input(path) as source, files.publish_file(target) as out:
                    while block := source.read(1 << 20):
                        out.write(block)
            yield batch

    spark.range(1).mapInArrow(copy, "id long").count()
    return target


def _paths(spark: SparkSession, paths: list[str]) -> list[str]:
    return [literal(visible(spark, p)) for p in paths]


def raw_lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """Lines below the header as text, still split by byte range.

    Bytes pass through ISO-8859-1 unharmed; the reader drops each file's header and blank lines.
    """
    lines = (
        spark.read.schema("line string")
        .option("sep", NEVER).option("quote", "").option("header", "true")
        .option("enforceSchema", "true").option("encoding", "ISO-8859-1")
        .option("recursiveFileLookup", "true")
        .csv(_paths(spark, paths))
    )
    return lines.select(parsing.drop_marks(parsing.decode_line(F.col("line"), encoding)).alias("line"))


def split_fields(line: Column, columns: list[str], separator: str) -> Column:
    """Struct of text fields ``f0…`` plus ``extra``, quotes respected."""
    schema = ", ".join(f"f{i} string" for i in range(len(columns))) + ", extra string"
    marked = F.concat(line, F.lit(separator + END_MARK))
    return F.from_csv(marked, schema, {**QUOTING, "sep": separator, "maxColumns": str(max(20480, len(columns) + 2))})


def well_formed(fields: Column, n_columns: int) -> Column:
    """The end mark lies behind the last field, or before it in a short line; long lines lose it."""
    short = F.array_contains(F.array(*[fields[f"f{i}"] for i in range(n_columns)]), END_MARK)
    return F.coalesce(fields["extra"] == END_MARK, F.lit(False)) | F.coalesce(short, F.lit(False))


def skip_bad_lines(lines: DataFrame, dialect: Dialect, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text columns, behind the columns to ``keep``; lines with too many fields are skipped, short ones get nulls."""
    columns = dialect.columns
    fields = F.array(split_fields(F.col("line"), columns, dialect.separator))
    # As a generator the parse is one step: a filter or projection would repeat it per column.
    parsed = lines.select(*keep, F.inline(F.filter(fields, lambda r: well_formed(r, len(columns)))))
    return parsed.select(*keep, *[
        parsing.missing_to_null(F.nullif(F.col(f"f{i}"), F.lit(END_MARK))).alias(c) for i, c in enumerate(columns)
    ])


def _plain_lines(records: DataFrame, encoding: str) -> DataFrame:
    line = F.replace(parsing.decode_line(F.col("line"), encoding), F.lit("\r"), F.lit(""))
    return records.withColumn("line", parsing.drop_marks(line))


def spanning_lines(spark: SparkSession, paths: list[str], dialect: Dialect, range_bytes: int) -> DataFrame | None:
    """Records, as ``raw_lines`` gives lines, of files whose quoted fields hold line ends; None if none does."""
    sized = [(p, size) for path in paths for p, size in files.list_files(path) if size and (p == path or not _hidden(p))]
    lines = quoted.record_lines(spark, sized, dialect.separator, range_bytes)
    return None if lines is None else _plain_lines(lines, dialect.encoding).select("line")


def text_of_files(spark: SparkSession, paths: list[tuple[str, int]], dialect: Dialect, path_column: str) -> DataFrame:
    """Text columns of files with one header, and the path each row comes from; ``paths`` has sizes, too."""
    lines = quoted.record_lines(spark, paths, dialect.separator, always=True)
    return skip_bad_lines(_plain_lines(lines, dialect.encoding).withColumnRenamed("path", path_column), dialect, (path_column,))


def read_text_columns(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None,
                      line_ends_in_fields: bool | None = None, range_bytes: int = quoted.RANGE_BYTES) -> DataFrame:
    """All columns as text. In a folder whose files differ in their headers, columns meet by name.

    Whether quoted fields hold line ends is found out by one look at all quotes; ``line_ends_in_fields=False`` saves it.
    """
    groups = files_by_header(spark, path)
    if not groups:
        raise ValueError(f"{path} is empty")
    table = None
    for header, paths in groups:
        dialect = sniff_header(header, paths[0], separator, encoding)
        # One header for all: the folder is read as one path.
        own = [path] if len(groups) == 1 else paths
        lines = None if line_ends_in_fields is False else spanning_lines(spark, own, dialect, range_bytes)
        part = skip_bad_lines(raw_lines(spark, own, dialect.encoding) if lines is None else lines, dialect)
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    return table


def read_delimited(spark: SparkSession, path: str, group_id: str | None = None, labels: dict[str, str] | None = None,
                   separator: str | None = None, encoding: str | None = None,
                   line_ends_in_fields: bool | None = None, range_bytes: int = quoted.RANGE_BYTES) -> DataFrame:
    """Typed table, or layer when coordinates are found.

    Types come from ``labels`` where the caller knows them; only then is one pass over the
    file enough.
    """
    text = read_text_columns(spark, path, separator, encoding, line_ends_in_fields, range_bytes)
    if labels is None:
        labels = types.inferred_labels(text, dates=False)
    known = {c: t for c, t in labels.items() if c in text.columns and not t.startswith("geometry")}
    return detect_geometry(names.tag_tenant(types.to_labels(text, known), group_id))
