"""Writes geographic and tabular files from the given tables, in tasks.

A partition makes one file, or several where it has more rows or bytes than a task should hold.
"""

from __future__ import annotations

import io
import struct
import zipfile
from itertools import groupby
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraload.sources import files

POINT, POINT_Z = 1, 11
# Bytes that a task holds for one file, and entries of one archive; a partition with more goes on with another file.
FILE_BYTES = 128 << 20
FILE_ENTRIES = 65_535
# Bytes of small files that a task holds at once.
TEXT_BYTES = 4 << 20


def dbf_record(fields: list[tuple[str, str, int, int]], values: list[Column], deleted: Column) -> Column:
    """Fixed-width text of one record; ASCII values only."""
    mark = F.when(deleted, F.lit("*")).otherwise(F.lit(" "))
    padded = [
        (F.rpad if kind in "CDL" else F.lpad)(F.coalesce(v.cast("string"), F.lit("")), width, " ")
        for (_, kind, width, _), v in zip(fields, values)
    ]
    return F.concat(mark, *padded)


def dbf_header(fields, n_records: int, language: int = 0) -> bytes:
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4BIHH17xB2x", 3, 124, 1, 1, n_records, 32 + 32 * len(fields) + 1, size, language)
    for name, kind, width, decimals in fields:
        head += struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), width, decimals)
    return head + b"\r"


def _file_tables(batches, file_bytes: int):
    """Tables of at most so many bytes, or of one row that is longer."""
    held, n_bytes = [], 0
    for batch in batches:
        # Batches of long rows are cut, so that they fill a file well.
        step = max(1, batch.num_rows * file_bytes // max(8 * batch.nbytes, 1))
        for piece in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
            if held and n_bytes + piece.nbytes > file_bytes:
                yield pa.Table.from_batches(held)
                held, n_bytes = [], 0
            held.append(piece)
            n_bytes += piece.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _write_tasks(df: DataFrame, write, file_bytes: int = FILE_BYTES) -> int:
    """Call ``write(part, table)`` in every partition, the part being its number, for further files of it with another behind; returns the rows written."""
    def task(batches):
        part, n = TaskContext.get().partitionId(), 0
        for k, table in enumerate(_file_tables(batches, file_bytes)):
            write(f"{part}_{k}" if k else f"{part}", table)
            n += table.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.mapInArrow(task, "n long").agg(F.sum("n")).first()[0]


def write_dbf(df: DataFrame, fields, path: str, encoding: str = "latin-1", language: int = 0, cpg: str | None = None,
              file_bytes: int = FILE_BYTES) -> int:
    """``df`` has a column ``record``; the encoding may be told by the header's mark or a file beside the table."""
    def write(part, table):
        with files.publish_file(f"{path}/table_{part}.dbf") as out:
            out.write(dbf_header(fields, table.num_rows, language))
            _write_records(out, table, encoding)
        if cpg is not None:
            with files.publish_file(f"{path}/table_{part}.cpg") as out:
                out.write(cpg.encode())

    return _write_tasks(df.select("record"), write, file_bytes)


def _write_records(out, table, encoding: str) -> None:
    for batch in table.to_batches():
        out.write("".join(batch.column("record").to_pylist()).encode(encoding))
    out.write(b"\x1a")


def write_points(df: DataFrame, fields, path: str, srid: int, with_z: bool, file_bytes: int = FILE_BYTES) -> int:
    """``df`` has the columns ``x``, ``y``, ``z`` and ``record``."""
    code = POINT_Z if with_z else POINT
    length = 36 if with_z else 20  # bytes of one record's content
    kind = np.dtype([("no", ">i4"), ("len", ">i4"), ("code", "<i4"), ("xy", "<f8", 2)] + ([("zm", "<f8", 2)] if with_z else []))

    def shapes(out, table):
        out.write(shape_header(100 + table.num_rows * kind.itemsize, code))
        first = 1
        for batch in table.to_batches():
            rows = np.zeros(batch.num_rows, kind)
            rows["no"], rows["len"], rows["code"] = np.arange(first, first + len(rows)), length // 2, code
            rows["xy"][:, 0], rows["xy"][:, 1] = (batch.column(c).to_numpy(zero_copy_only=False) for c in "xy")
            if with_z:
                rows["zm"][:, 0] = batch.column("z").to_numpy(zero_copy_only=False)
            out.write(rows.tobytes())
            first += len(rows)

    def index(out, table):
        rows = np.zeros(table.num_rows, np.dtype([("at", ">i4"), ("len", ">i4")]))
        rows["at"], rows["len"] = 50 + np.arange(len(rows)) * ((length + 8) // 2), length // 2
        out.write(shape_header(100 + rows.nbytes, code) + rows.tobytes())

    def attributes(out, table):
        out.write(dbf_header(fields, table.num_rows))
        _write_records(out, table, "latin-1")

    def write(part, table):
        parts = {".shp": shapes, ".shx": index, ".dbf": attributes, ".prj": lambda out, _: out.write(crs_text(srid).encode())}
        for suffix, content in parts.items():
            with files.publish_file(f"{path}/points_{part}{suffix}") as out:
                content(out, table)

    return _write_tasks(df.select("x", "y", "z", "record"), write, file_bytes)


def shape_header(n_bytes: int, code: int) -> bytes:
    return struct.pack(">i20xi", 9994, n_bytes // 2) + struct.pack("<ii64x", 1000, code)


def crs_text(srid: int) -> str:
    return (f'PROJCS["zone",GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]],UNIT["metre",1],'
            f'AUTHORITY["EPSG","{srid}"]]')


#: Names by dialect, the last the newer keywords'.
DIALECTS = {
    "plain": {"wgs84": "WGS_1984", "ed50": "European_Datum_1950", "etrs89": "European_Terrestrial_Reference_System_1989", "monte mario": "Monte_Mario",
              "rdn2008": "Rete_Dinamica_Nazionale_2008", "transverse mercator": "Transverse_Mercator", "web mercator": "Mercator_1SP"},
    "desktop": {"wgs84": "D_WGS_1984", "ed50": "D_European_1950", "etrs89": "D_ETRS_1989", "monte mario": "D_Monte_Mario",
                "rdn2008": "D_Rete_Dinamica_Nazionale_2008", "transverse mercator": "Gauss_Kruger", "web mercator": "Mercator_Auxiliary_Sphere"},
}


def projection_text(system: tuple, dialect: str, turn: int = 0) -> str:
    """A reference system's text without its code, the parameters in another order for each ``turn``."""
    _, datum, meridian, projection, latitude, longitude, scale, easting, northing, axes = system
    names, desktop = DIALECTS[dialect], dialect == "desktop"
    prime = "Greenwich" if not meridian else "Rome"
    solid = ',AXIS["Lat",NORTH],AXIS["Lon",EAST],AXIS["Up",UP]' if projection == "three axes" else ""
    base = (f'GEOGCS["GCS of @",DATUM["{names[datum]}",SPHEROID["any",6378137.0,298.257]],PRIMEM["{prime}",{meridian!r}],'
            f'UNIT["{"Degree" if desktop else "degree"}",0.0174532925199433]{solid}]')
    if projection in ("", "three axes"):
        return base
    values = {"False_Easting": easting, "False_Northing": northing, "Central_Meridian": longitude, "Scale_Factor": scale, "Latitude_Of_Origin": latitude}
    if projection == "web mercator" and desktop:
        values = {"False_Easting": easting, "False_Northing": northing, "Central_Meridian": longitude, "Standard_Parallel_1": 0.0, "Auxiliary_Sphere_Type": 0.0}
    entries = [f'PARAMETER["{name if desktop else name.lower()}",{value!r}]' for name, value in values.items()]
    entries = entries[turn % len(entries):] + entries[:turn % len(entries)]
    order = {"EN": ',AXIS["Easting",EAST],AXIS["Northing",NORTH]', "NE": ',AXIS["Northing",NORTH],AXIS["Easting",EAST]'}[axes]
    extension = ',EXTENSION["PROJ4","+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0"]' if projection == "web mercator" and not desktop else ""
    return (f'PROJCS["zone of @",{base},PROJECTION["{names[projection]}"],{",".join(entries)},UNIT["{"Meter" if desktop else "metre"}",1.0]'
            f'{"" if desktop else order}{extension}]')


def write_zips(df: DataFrame, path: str, file_entries: int = FILE_ENTRIES) -> int:
    """``df`` has the columns ``entry`` and ``content`` (text). Entries are written as they come; a task holds an archive's directory."""
    def archives(batches):
        """Pieces of batches, with the number of their archive in this partition."""
        k, room = 0, file_entries
        for batch in batches:
            while batch.num_rows:
                if not room:
                    k, room = k + 1, file_entries
                piece = batch.slice(0, min(room, 1000))
                yield k, piece
                batch, room = batch.slice(piece.num_rows), room - piece.num_rows

    def task(batches):
        part, n = TaskContext.get().partitionId(), 0
        for k, pieces in groupby(archives(batches), lambda piece: piece[0]):
            name = f"archive_{part}_{k}" if k else f"archive_{part}"
            with files.publish_file(f"{path}/{name}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for _, piece in pieces:
                    for entry, content in zip(piece.column("entry").to_pylist(), piece.column("content").to_pylist()):
                        z.writestr(entry, content.encode())
                    n += piece.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.select("entry", "content").mapInArrow(task, "n long").agg(F.sum("n")).first()[0]


def write_texts(df: DataFrame, path: str) -> int:
    """A file of its own for every row of ``name`` and ``text``."""
    def write(part, table):
        with files.passing_folder(path) as passing:
            for name, text in zip(table.column("name").to_pylist(), table.column("text").to_pylist()):
                with files.publish_file(f"{path}/{name}", passing) as out:
                    out.write(text.encode())

    return _write_tasks(df, write, TEXT_BYTES)


def zip_each(paths: DataFrame, target: str) -> int:
    """An archive for the files of each stem: a shapefile needs the files beside it."""
    def write(part, table):
        for stem, own in groupby(sorted(table.column("path").to_pylist()), lambda path: path.rsplit(".", 1)[0]):
            name = stem.rsplit("/", 1)[-1]
            with files.publish_file(f"{target}/{name}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for path in own:
                    with files.open_input(path) as source, z.open(path.rsplit("/", 1)[-1], "w") as entry:
                        while block := source.read(1 << 20):
                            entry.write(block)

    return _write_tasks(paths.select("path").repartition(F.regexp_replace("path", r"\.[^./]*$", "")), write)


def write_workbooks(df: DataFrame, sheets: dict[str, list[str]], path: str) -> int:
    """One workbook per partition; each sheet shows some of the columns."""
    def write(part, table):
        data = table.to_pydict()
        with files.publish_file(f"{path}/book_{part}.xlsx") as out:
            out.write(workbook({s: [cs, *zip(*[data[c] for c in cs])] for s, cs in sheets.items()}))

    return _write_tasks(df, write)


def workbook(sheets: dict[str, list]) -> bytes:
    """Smallest workbook with text and number cells."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{escape(s)}" sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/s{i}.xml"/>'
                        for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{n}">{"".join(map(_cell, row))}</row>' for n, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return held.getvalue()


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'


def write_lines(df: DataFrame, header: str, path: str) -> None:
    """Raw lines with CRLF and a header per file, in ISO-8859-1; ``df`` has one text column."""
    (df.toDF(header).write.option("sep", "\u0001").option("quote", "").option("escape", "").option("header", "true")
     .option("encoding", "ISO-8859-1").option("lineSep", "\r\n").csv(path))


def write_files(df: DataFrame, header: str, path: str, name: str) -> int:
    """Files of the given name, a number before its suffix for each task; ``df`` has a text column ``line``."""
    stem, suffix = name.rsplit(".", 1)

    def write(part, table):
        with files.publish_file(f"{path}/{stem}{part}.{suffix}") as out:
            out.write("".join(line + "\n" for line in [header, *table.column("line").to_pylist()]).encode())

    return _write_tasks(df.select("line"), write)


def write_named(df: DataFrame, folder: str) -> int:
    """Files as the rows name them; ``df`` has text columns ``name, header, line``. A file is one task's."""
    def task(batches):
        n, name, held = 0, None, []

        def close():
            if held:
                with files.publish_file(f"{folder}/{name}") as out:
                    out.write("".join(line + "\n" for line in held).encode())

        for batch in batches:
            for named, header, line in zip(*(batch.column(c).to_pylist() for c in ("name", "header", "line"))):
                if named != name:
                    close()
                    name, held = named, [header]
                held.append(line)
                n += 1
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    ordered = df.select("name", "header", "line").repartition("name").sortWithinPartitions("name")
    return ordered.mapInArrow(task, "n long").agg(F.sum("n")).first()[0]
