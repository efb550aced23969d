"""Small hand-made files for tests."""

import io
import struct
import zipfile

from terraload.checks.sample_files import crs_text, dbf_header


def write_dbf(path, fields, rows, extra_marks=None):
    """``rows`` are lists of byte strings; a row's mark may be given by its number."""
    body = b""
    for i, row in enumerate(rows):
        body += (extra_marks or {}).get(i, b" ")
        for (_, kind, width, _), value in zip(fields, row):
            body += value.ljust(width) if kind in "CDL" else value.rjust(width)
    path.write_bytes(dbf_header(fields, len(rows)) + body + b"\x1a")


def shape_record(code, parts):
    """Content of one record; parts are lists of (x, y) or (x, y, z)."""
    if code == 0:
        return struct.pack("<i", 0)
    points = [p for part in parts for p in part]
    has_z = 10 < code < 20
    if code in (1, 11, 21):
        return struct.pack("<i", code) + struct.pack(f"<{len(points[0])}d", *points[0])
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = struct.pack("<4d", min(xs), min(ys), max(xs), max(ys))
    content = struct.pack("<i", code) + box
    if code % 10 != 8:
        starts = [sum(len(q) for q in parts[:i]) for i in range(len(parts))]
        content += struct.pack(f"<ii{len(parts)}i", len(parts), len(points), *starts)
    else:
        content += struct.pack("<i", len(points))
    content += b"".join(struct.pack("<2d", p[0], p[1]) for p in points)
    if has_z:
        zs = [p[2] for p in points]
        content += struct.pack("<2d", min(zs), max(zs)) + struct.pack(f"<{len(zs)}d", *zs)
    return content


def write_shapefile(folder, stem, shapes, fields=None, rows=None, srid=32633, marks=None, prj=None, index=True):
    """``shapes`` are pairs (code, parts)."""
    code = next((c for c, _ in shapes if c), 0)
    body, offsets, at = b"", b"", 50
    for number, (kind, parts) in enumerate(shapes, 1):
        content = shape_record(kind, parts)
        body += struct.pack(">ii", number, len(content) // 2) + content
        offsets += struct.pack(">ii", at, len(content) // 2)
        at += 4 + len(content) // 2

    def head(n):
        return struct.pack(">i20xi", 9994, n // 2) + struct.pack("<ii64x", 1000, code)

    (folder / f"{stem}.shp").write_bytes(head(100 + len(body)) + body)
    if index:
        (folder / f"{stem}.shx").write_bytes(head(100 + len(offsets)) + offsets)
    if fields:
        write_dbf(folder / f"{stem}.dbf", fields, rows, marks)
    text = prj if prj is not None else (crs_text(srid) if srid else None)
    if text:
        (folder / f"{stem}.prj").write_text(text)


def workbook(sheets, shared=(), styles=None):
    """``sheets`` maps names to XML of rows."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        listed = "".join(f'<sheet name="{s}" sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="r{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")
    return held.getvalue()


def zip_of(files):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return held.getvalue()
