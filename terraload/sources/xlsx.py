"""Workbook sheets as rows of typed cells, one task per sheet."""

from __future__ import annotations

import datetime
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraload.functions import names, parsing
from terraload.functions.geometry import detect_geometry
from terraload.runtime import stage
from terraload.sources import files
from terraload.sources.archive import list_paths, spread

BATCH_ROWS = 8192

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])

SHEET_SCHEMA = "path string, sheet string, sheet_no int, part string"
# Cell kinds: n number, s text, b truth value, d moment.
ROW_SCHEMA = "path string, sheet string, sheet_no int, row_no long, cells array<struct<kind:string,value:string>>"
_CELLS = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))


def workbook_sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(sheet name, part of the archive)`` in workbook order."""
    relations = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in relations}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    found = []
    for sheet in book.iter(MAIN + "sheet"):
        target = targets[sheet.get(RELATION)]
        found.append((sheet.get("name"), target if target.startswith("xl/") else "xl/" + target))
    return found


def shared_texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    texts = []
    with z.open("xl/sharedStrings.xml") as part:
        for _, item in ElementTree.iterparse(part):
            if item.tag == MAIN + "si":
                # Phonetic runs are not part of the text.
                texts.append("".join(t.text or "" for r in item if r.tag != MAIN + "rPh" for t in r.iter(MAIN + "t")))
                item.clear()
    return texts


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {
        int(f.get("numFmtId"))
        for f in root.iter(MAIN + "numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.I)
    }
    styles = root.find(MAIN + "cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def base_day(z: zipfile.ZipFile) -> datetime.datetime:
    """Day zero of the workbook's date numbers."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    setting = book.find(MAIN + "workbookPr")
    if setting is not None and setting.get("date1904") in ("1", "true"):
        return datetime.datetime(1904, 1, 1)
    return datetime.datetime(1899, 12, 30)


def column_number(reference: str) -> int:
    """Zero-based column of a cell reference such as ``AB12``."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def cell_value(cell, shared: list[str], moments: set[int], day_zero: datetime.datetime):
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return {"kind": "s", "value": "".join(t.text or "" for t in cell.iter(MAIN + "t"))}
    value = cell.findtext(MAIN + "v")
    if value is None:
        return None
    if kind == "s":
        return {"kind": "s", "value": shared[int(value)]}
    if kind == "b":
        return {"kind": "b", "value": "true" if value == "1" else "false"}
    if kind == "d":
        return {"kind": "d", "value": value.replace("T", " ")}
    if kind in ("str", "e"):
        return {"kind": "s", "value": value}
    if int(cell.get("s", 0)) in moments:
        moment = day_zero + datetime.timedelta(seconds=round(float(value) * 86400))
        return {"kind": "d", "value": moment.isoformat(sep=" ")}
    return {"kind": "n", "value": value}


def sheet_rows(z: zipfile.ZipFile, part: str):
    """``(row number, cells)`` up to the last row with a value; blank rows between are kept."""
    shared, moments, day_zero = shared_texts(z), date_styles(z), base_day(z)
    expected, row_no = 1, 0
    with z.open(part) as stream:
        rows = None
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                rows = element if element.tag == MAIN + "sheetData" else rows
                continue
            if element.tag != MAIN + "row":
                continue
            row_no = int(element.get("r", row_no + 1))
            cells: list = []
            for cell in element.iter(MAIN + "c"):
                at = column_number(cell.get("r")) if cell.get("r") else len(cells)
                cells.extend([None] * (at + 1 - len(cells)))
                cells[at] = cell_value(cell, shared, moments, day_zero)
            # Read rows leave the tree, so that memory does not grow with the sheet.
            (element if rows is None else rows).clear()
            if any(c is not None for c in cells):
                for blank in range(expected, row_no):
                    yield blank, []
                yield row_no, cells
                expected = row_no + 1


def list_sheets(spark: SparkSession, root: str) -> DataFrame:
    """Sheets of every workbook below ``root``, in workbook order."""
    def sheets(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input(path) as handle, zipfile.ZipFile(handle) as z:
                    found = workbook_sheets(z)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array([n for n, _ in found], pa.string()),
                     pa.array(range(len(found)), pa.int32()), pa.array([p for _, p in found], pa.string())],
                    ["path", "sheet", "sheet_no", "part"])

    return spread(list_paths(spark, root, ".xlsx").select("path"), ["path"]).mapInArrow(sheets, SHEET_SCHEMA)


def scan_sheets(spark: SparkSession, root: str, sheet: str | None = None, partitions: int | None = None) -> DataFrame:
    """Rows of every sheet (or of the sheets with one name) of every workbook, spread by sheet."""
    def rows(batches):
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("path", "sheet", "sheet_no", "part")]
            for path, sheet, sheet_no, part in zip(*keys):
                with files.open_input(path) as handle, zipfile.ZipFile(handle) as z:
                    held = []
                    for row in sheet_rows(z, part):
                        held.append(row)
                        if len(held) == BATCH_ROWS:
                            yield _row_batch(path, sheet, sheet_no, held)
                            held = []
                    if held:
                        yield _row_batch(path, sheet, sheet_no, held)

    sheets = list_sheets(spark, root)
    if sheet is not None:
        sheets = sheets.filter(F.col("sheet") == sheet)
    return spread(sheets, ["path", "sheet_no"], partitions).mapInArrow(rows, ROW_SCHEMA)


def _row_batch(path, sheet, sheet_no, held):
    n = len(held)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array([sheet] * n, pa.string()), pa.array([sheet_no] * n, pa.int32()),
         pa.array([r for r, _ in held], pa.int64()), pa.array([c for _, c in held], _CELLS)],
        ["path", "sheet", "sheet_no", "row_no", "cells"])


def cell_kind(cell: Column) -> Column:
    """Bit for the kind of a cell: 1 whole number, 2 number, 4 truth value, 8 moment, 16 text."""
    missing = cell["value"].isNull() | ((cell["kind"] == "s") & parsing.missing_to_null(cell["value"]).isNull())
    # A number that is whole counts as whole however it is written.
    whole = cell["value"].try_cast("double") == F.floor(cell["value"].try_cast("double"))
    return F.when(~missing, F.when((cell["kind"] == "n") & whole, F.lit(1))
                  .when(cell["kind"] == "n", F.lit(2)).when(cell["kind"] == "b", F.lit(4))
                  .when(cell["kind"] == "d", F.lit(8)).otherwise(F.lit(16)))


def sheet_facts(rows: DataFrame) -> dict[str, tuple[list | None, dict[int, int]]]:
    """First row and kinds of the columns of every sheet of one workbook, in one pass each.

    Only masks are shuffled; the driver gets a row for each sheet and column.
    """
    heads = {r["sheet"]: r["cells"] for r in rows.filter(F.col("row_no") == 1).select("sheet", "cells").collect()}
    kinds = rows.filter(F.col("row_no") > 1).select("sheet", F.posexplode("cells").alias("at", "cell")).groupBy("sheet", "at").agg(
        F.bit_or(cell_kind(F.col("cell"))).alias("mask")).collect()
    facts = {sheet: (cells, {}) for sheet, cells in heads.items()}
    for r in kinds:
        facts.setdefault(r["sheet"], (None, {}))[1][r["at"]] = r["mask"]
    return facts


def sheet_table(rows: DataFrame, head: list | None, masks: dict[int, int], group_id: str | None = None) -> DataFrame:
    """Typed table of one sheet (``rows`` holds one path and one sheet); the first row names the columns."""
    labels = [c["value"] if c else None for c in (head or [])]
    labels += [None] * (max(masks, default=-1) + 1 - len(labels))
    columns = names.unique_names([names.clean_name(v if v else f"unnamed_{i}") for i, v in enumerate(labels)])
    if not columns:
        raise ValueError("the sheet is empty")
    values = [_typed(F.get(F.col("cells"), F.lit(i)), masks.get(i)).alias(c) for i, c in enumerate(columns)]
    return detect_geometry(names.tag_tenant(rows.filter(F.col("row_no") > 1).select(*values), group_id))


def _typed(cell: Column, mask: int | None) -> Column:
    value = F.when(cell["kind"] == "s", parsing.missing_to_null(cell["value"])).otherwise(cell["value"])
    if mask is None or mask in (2, 3):
        return value.try_cast("double")
    if mask == 1:
        return value.try_cast("double").cast("bigint")
    if mask == 4:
        return value.try_cast("boolean")
    if mask == 8:
        return value.try_cast("timestamp_ntz")
    return value


def read_xlsx(spark: SparkSession, path: str, group_id: str | None = None) -> dict[str, DataFrame]:
    """Every sheet of one workbook as a table, by sheet name; empty sheets are left out."""
    # Cells are taken out of the workbook once; naming and typing columns reads them again.
    rows = stage(scan_sheets(spark, path), "cells")
    facts = sheet_facts(rows)
    found = [r["sheet"] for r in list_sheets(spark, path).orderBy("sheet_no").collect()]
    return {sheet: sheet_table(rows.filter(F.col("sheet") == sheet), *facts[sheet], group_id) for sheet in found if sheet in facts}


def sheet_table_name(stem: str, sheet: str) -> str:
    return names.clean_name(f"{stem}_{sheet}")
