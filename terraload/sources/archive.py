"""Zip archives, file listings and file digests."""

from __future__ import annotations

import hashlib
import posixpath
import zipfile
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraload.constants import FORMAT_SUFFIXES
from terraload.functions import names
from terraload.sources import files

BATCH_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
# Texts of whole files that a task holds, in bytes, and rows of one batch.
TEXT_BYTES = 4 << 20
BATCH_ROWS = 10_000

ENTRY_SCHEMA = "archive string, entry string, size long"


def list_paths(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """Paths and sizes of all files below ``root``, empty ones included; no file is opened.

    The driver lists the top folder and tasks walk the folders in it.
    """
    def walk(batches):
        for batch in batches:
            for path, is_folder, size in zip(*(batch.column(c).to_pylist() for c in ("path", "is_folder", "size"))):
                found = files.list_files(path) if is_folder else [(path, size)]
                found = [f for f in found if f[0].endswith(suffix)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64())],
                    ["path", "size"])

    top = spark.createDataFrame(files.list_folder(root), "path string, is_folder boolean, size long")
    return top.mapInArrow(walk, "path string, size long")


def walk_paths(spark: SparkSession, root: str) -> DataFrame:
    """The column ``path`` of all files below ``root``; nothing of it passes through the driver.

    A task lists the top folder and tasks walk the folders in it.
    """
    def top(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for found in batched(files.folder_entries(path), BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p for p, _ in found], pa.string()), pa.array([f for _, f in found], pa.bool_())], ["path", "is_folder"])

    def walk(batches):
        for batch in batches:
            own = (p for path, is_folder in zip(*(batch.column(c).to_pylist() for c in ("path", "is_folder")))
                   for p in (files.walk_files(path) if is_folder else (path,)))
            for found in batched(own, BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])

    start = spark.range(0, 1, 1, 1).select(F.lit(root).alias("path"))
    return spread(start.mapInArrow(top, "path string, is_folder boolean"), ["path"]).mapInArrow(walk, "path string")


def whole_texts(spark: SparkSession, root: str) -> DataFrame:
    """``path, value`` of every file below ``root`` that is not empty, the whole text in one row.

    Like Spark's own reader of whole texts; that one lists all files on the driver and takes a task for a few of them.
    """
    def read(batches):
        paths, contents, held = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input(path) as handle:
                    content = handle.read()
                if content:
                    paths.append(path)
                    contents.append(content)
                    held += len(content)
                if held >= TEXT_BYTES or len(paths) >= BATCH_ROWS:
                    yield text_batch(paths, contents)
                    paths, contents, held = [], [], 0
        if paths:
            yield text_batch(paths, contents)

    def text_batch(paths, contents):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "value"])

    found = spread(walk_paths(spark, root), ["path"]).mapInArrow(read, "path string, value binary")
    return found.select("path", F.col("value").cast("string").alias("value"))


def suffix_format(path: Column) -> Column:
    """Format a file is read as, by suffix; null when none fits."""
    chosen = F.lit(None).cast("string")
    for suffix, name in FORMAT_SUFFIXES.items():
        chosen = F.when(path.endswith(suffix), F.lit(name)).otherwise(chosen)
    return chosen


def inventory(paths: DataFrame, path: str = "path") -> DataFrame:
    """Readable files with format, suffix and table name."""
    p = F.col(path)
    return paths.select(
        p.alias("path"),
        names.base_name(p).alias("filename"),
        suffix_format(p).alias("format"),
        F.regexp_extract(p, r"\.([^./\\]*)$", 1).alias("ext"),
        names.file_stem(p).alias("stem"),
        names.table_name(p).alias("table"),
        *[c for c in paths.columns if c not in (path, "path")],
    ).filter(F.col("format").isNotNull())


def exclude_sidecars(found: DataFrame) -> DataFrame:
    """Drop files that belong to a shapefile of the same stem."""
    shapes = found.filter(F.col("format") == "shapefile").select("stem").distinct()
    others = found.filter(F.col("format") != "shapefile").join(shapes, "stem", "left_anti")
    return found.filter(F.col("format") == "shapefile").unionByName(others)


def files_per_format(found: DataFrame) -> DataFrame:
    return found.groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"))


def archive_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries of every archive below ``root``, from the archives' directories alone."""
    def directory(batches):
        for batch in batches:
            for archive in batch.column("path").to_pylist():
                with files.open_input(archive) as handle, zipfile.ZipFile(handle) as z:
                    # Of entries with one name the last counts, as for every reader of archives.
                    found = list({i.filename: i for i in z.infolist() if not i.is_dir()}.values())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([archive] * len(found), pa.string()),
                         pa.array([i.filename for i in found], pa.string()),
                         pa.array([i.file_size for i in found], pa.int64())],
                        ["archive", "entry", "size"])

    archives = list_paths(spark, root, ".zip").select("path")
    return spread(archives, ["path"]).mapInArrow(directory, ENTRY_SCHEMA)


def spread(listing: DataFrame, by: list[str], partitions: int | None = None) -> DataFrame:
    """Give every listed thing its own place, so that reading them keeps all tasks busy."""
    # The number is named because a listing is tiny and would otherwise be merged into one task.
    n = partitions or int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listing.repartition(n, *by).sortWithinPartitions(*by)


def _open_entries(batches, action):
    """Call ``action(zip, archive, entry, size)`` per row, opening each archive once in a row."""
    current, handle, opened = None, None, None
    try:
        for batch in batches:
            for archive, entry, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "entry", "size"))):
                if archive != current:
                    if opened is not None:
                        opened.close()
                        handle.close()
                    handle = files.open_input(archive)
                    opened, current = zipfile.ZipFile(handle), archive
                yield action(opened, archive, entry, size)
    finally:
        if opened is not None:
            opened.close()
            handle.close()


def scan_archives(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """Rows ``(archive, entry, size, content)``; every entry is read where its row lies."""
    def contents(batches):
        rows, held = [], 0
        for row in _open_entries(batches, lambda z, a, e, s: (a, e, s, z.read(e))):
            rows.append(row)
            held += len(row[3])
            if held >= BATCH_BYTES:
                yield _content_batch(rows)
                rows, held = [], 0
        if rows:
            yield _content_batch(rows)

    placed = spread(archive_entries(spark, root), ["archive", "entry"], partitions)
    return placed.mapInArrow(contents, ENTRY_SCHEMA + ", content binary")


def _content_batch(rows):
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
        ["archive", "entry", "size", "content"])


def safe_entry(entry: str) -> str:
    """Entry name that stays inside the target folder."""
    clean = posixpath.normpath(entry.replace("\\", "/"))
    if clean.startswith(("/", "../")) or clean in ("..", "."):
        raise ValueError(f"archive entry {entry!r} leaves the folder")
    return clean


def archive_folder(root: str, archive: str) -> str:
    """Folder for an archive's entries: its path below the root, so that archives keep apart."""
    below = archive[len(root.rstrip("/")):].strip("/") if archive.startswith(root.rstrip("/") + "/") else ""
    return safe_entry(below or archive.rstrip("/").rsplit("/", 1)[-1])


def extract_archives(spark: SparkSession, root: str, target: str, partitions: int | None = None) -> DataFrame:
    """Write all entries below ``target`` and return ``(archive, entry, size, path)``.

    Entries are copied in blocks, so their size does not matter. Running it again writes
    the same files.
    """
    def unpack(batches):
        def copy(z, archive, entry, size):
            path = f"{target}/{archive_folder(root, archive)}/{safe_entry(entry)}"
            with z.open(entry) as source, files.publish_file(path) as out:
                while block := source.read(BLOCK_BYTES):
                    out.write(block)
            return archive, entry, size, path

        for row in _open_entries(batches, copy):
            yield pa.RecordBatch.from_pylist([dict(zip(("archive", "entry", "size", "path"), row))])

    placed = spread(archive_entries(spark, root), ["archive", "entry"], partitions)
    return placed.mapInArrow(unpack, ENTRY_SCHEMA + ", path string")


def content_md5(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """``(path, size, md5)`` of every file below ``root``, read in blocks whatever its size."""
    def digest(batches):
        for batch in batches:
            paths, sizes, found = batch.column("path"), batch.column("size"), []
            for path in paths.to_pylist():
                state = hashlib.md5()
                with files.open_input(path) as handle:
                    while block := handle.read(BLOCK_BYTES):
                        state.update(block)
                found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([paths, sizes, pa.array(found, pa.string())], ["path", "size", "md5"])

    return spread(list_paths(spark, root), ["path"], partitions).mapInArrow(digest, "path string, size long, md5 string")
