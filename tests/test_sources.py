import datetime
import hashlib
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from writers import workbook, write_dbf, write_shapefile, zip_of

from terraload.sources import archive, dbf, delimited, files, quoted, shapefile, xlsx

# Delimited text.


@pytest.mark.parametrize("separator", [";", "\t", ","])
@pytest.mark.parametrize("encoding", ["utf-8", "cp1252"])
def test_csv_dialects(spark, folder, separator, encoding):
    lines = ["Id Num;città;Value", "1;è 'x';1.5", "2;€;", "", "3", "4;a;2;over", "5;a;2;", '6;"q;r";7']
    (folder / "a.csv").write_bytes("\r\n".join(line.replace(";", separator) for line in lines).encode(encoding))
    df = delimited.read_delimited(spark, str(folder / "a.csv"), group_id="g")
    assert df.columns == ["id_num", "città", "value", "group_id"]
    assert [tuple(r) for r in df.orderBy("id_num").collect()] == [
        (1, "è x", 1.5, "g"), (2, "€", None, "g"), (3, None, None, "g"), (6, f"q{separator}r", 7.0, "g")]


def test_csv_ascii_header_decodes_line_by_line(spark, folder):
    (folder / "a.csv").write_bytes(b"a;b\n1;" + "è".encode() + b"\n2;" + "è".encode("cp1252") + b"\n")
    assert [r["b"] for r in delimited.read_delimited(spark, str(folder / "a.csv")).orderBy("a").collect()] == ["è", "è"]


def test_csv_is_not_changed(spark, folder):
    content = "a;b\r\n'1';2\r\n".encode("cp1252")
    (folder / "a.csv").write_bytes(content)
    delimited.read_delimited(spark, str(folder / "a.csv")).collect()
    assert (folder / "a.csv").read_bytes() == content


@pytest.mark.parametrize("header,row,expected", [
    ("latitudine;longitudine", "45.5;9.1", (9.1, 45.5)), ("Latitude;Longitude", "45;9", (9.0, 45.0)),
    ("id;geometry", "1;POINT (3 4)", (3.0, 4.0))])
def test_csv_layers(spark, folder, header, row, expected):
    (folder / "a.csv").write_text(f"{header}\n{row}\n")
    g = delimited.read_delimited(spark, str(folder / "a.csv")).first()["geometry"]
    assert (g["coords"][0][0][0]["x"], g["coords"][0][0][0]["y"]) == expected and g["srid"] == 4326


def test_csv_column_names(spark, folder):
    (folder / "a.csv").write_text("a-b;a b;;1x\n1;2;3;4\n")
    assert delimited.read_delimited(spark, str(folder / "a.csv")).columns == ["a_b", "a_b_2", "unnamed_2", "_1x_"]
    (folder / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(folder / "empty.csv"))


def test_csv_quotes(spark, folder):
    (folder / "a.csv").write_text('id;t\n1;"a""b"\n2;a\\b\n3;"c\\"\n4;5" pipe\n5; x \n')
    df = delimited.read_delimited(spark, str(folder / "a.csv"))
    assert [r["t"] for r in df.orderBy("id").collect()] == ['a"b', "a\\b", "c\\", '5" pipe', " x "]


def test_csv_line_ends_in_fields(spark, folder):
    (folder / "a.csv").write_bytes('id;città\r\n1;"a\nb"\r\n2;è\r\n3;x;over\r\n4\r\n'.encode("cp1252"))
    df = delimited.read_delimited(spark, str(folder / "a.csv"), line_ends_in_fields=True)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a\nb"), (2, "è"), (4, None)]


def test_csv_given_types_need_no_inference(spark, folder):
    (folder / "a.csv").write_text("a;b\n007;x\n")
    df = delimited.read_delimited(spark, str(folder / "a.csv"), labels={"a": "text", "b": "integer"})
    assert [tuple(r) for r in df.collect()] == [("007", None)]


def test_csv_splits_give_the_same_rows(spark, folder):
    (folder / "a.csv").write_text("id;v\n" + "".join(f"{i};x{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        df = delimited.read_delimited(spark, str(folder / "a.csv"))
        assert df.rdd.getNumPartitions() > 4
        assert df.agg(F.count("*"), F.sum("id"), F.countDistinct("v")).first() == (5000, 4999 * 2500, 5000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# DBF.

FIELDS = [("NAME", "C", 8, 0), ("N0", "N", 6, 0), ("N2", "N", 8, 2), ("DAY", "D", 8, 0), ("OK", "L", 1, 0), ("F", "F", 10, 3)]


def test_dbf_values(spark, folder):
    write_dbf(folder / "a.dbf", FIELDS, [
        [b" ab", b"12", b"1.50", b"20240229", b"T", b"2.5"],
        ["è".encode("cp1252"), b"*****", b"*****", b"00000000", b"?", b""],
        ["è".encode(), b"", b"3", b"20240230", b"y", b"-1"],
        [b"gone", b"1", b"1", b"20240101", b"f", b"1"],
    ], {3: b"*"})
    df = dbf.read_dbf(spark, str(folder / "a.dbf"), "g")
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "bigint", "double", "date", "boolean", "double", "string"]
    assert [tuple(r) for r in df.collect()] == [
        ("ab", 12, 1.5, datetime.date(2024, 2, 29), True, 2.5, "g"), ("è", None, None, None, None, None, "g"),
        ("è", None, 3.0, None, True, -1.0, "g")]
    assert dbf.read_dbf(spark, str(folder / "a.dbf"), include_deleted=True).filter("_deleted").count() == 1
    assert dbf.read_dbf(spark, str(folder / "a.dbf"), columns=["n2"]).columns == ["n2"]


@pytest.mark.parametrize("split", [200, 1000, 100000])
def test_dbf_splits_give_the_same_rows(spark, folder, split):
    fields = [("ID", "N", 9, 0), ("T", "C", 5, 0)]
    write_dbf(folder / "a.dbf", fields, [[str(i).encode(), b"x"] for i in range(500)])
    write_dbf(folder / "b.dbf", fields, [[str(i).encode(), b"y"] for i in range(500, 600)])
    df = dbf.read_dbf(spark, str(folder), splitBytes=split)
    assert sorted(r["id"] for r in df.collect()) == list(range(600))


def test_dbf_refuses(spark, folder):
    write_dbf(folder / "m.dbf", [("MEMO", "M", 10, 0)], [[b"1"]])
    with pytest.raises(ValueError, match="not supported"):
        dbf.read_dbf(spark, str(folder / "m.dbf"))
    write_dbf(folder / "n.dbf", [("N", "N", 8, 0)], [[b"1.5"], [b"2.0"]])
    with pytest.raises(Exception, match="declared whole"):
        dbf.read_dbf(spark, str(folder / "n.dbf"), doubles=[]).collect()
    assert [r["n"] for r in dbf.read_dbf(spark, str(folder / "n.dbf")).collect()] == [1.5, 2.0]
    assert [r["n"] for r in dbf.read_dbf(spark, str(folder / "n.dbf"), doubles=["n"]).collect()] == [1.5, 2.0]


# Shapefiles.

SQUARE = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]  # clockwise
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
FAR = [(10, 10), (10, 12), (12, 12), (12, 10), (10, 10)]
ID = [("ID", "N", 5, 0)]


def shapes_of(df):
    return [None if r["geometry"] is None else (
        r["geometry"]["gtype"], r["geometry"]["has_z"], [[len(ring) for ring in part] for part in r["geometry"]["coords"]])
        for r in df.orderBy("id").collect()]


def test_shapes(spark, folder):
    def read(stem, *shapes, **options):
        write_shapefile(folder, stem, list(shapes), ID, [[str(i).encode()] for i in range(len(shapes))])
        return shapes_of(shapefile.read_shapefile(spark, str(folder / f"{stem}.shp"), **options))

    assert read("points", (1, [[(1, 2)]]), (0, None)) == [("Point", False, [[1]]), None]
    assert read("pointz", (11, [[(1, 2, 3)]])) == [("Point", True, [[1]])]
    assert read("many", (8, [[(1, 2), (3, 4)]])) == [("MultiPoint", False, [[1], [1]])]
    assert read("lines", (3, [[(0, 0), (1, 1)]]), (3, [[(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 4)]])) == [
        ("LineString", False, [[2]]), ("MultiLineString", False, [[2], [3]])]
    assert read("areas", (5, [SQUARE, HOLE]), (5, [SQUARE, FAR]), (5, [SQUARE, FAR, HOLE]), (5, [HOLE])) == [
        ("Polygon", False, [[5, 5]]), ("MultiPolygon", False, [[5], [5]]), ("MultiPolygon", False, [[5, 5], [5]]),
        ("Polygon", False, [[5]])]
    assert read("areaz", (15, [[(x, y, 7) for x, y in SQUARE]])) == [("Polygon", True, [[5]])]


def test_shapefile_reference_system_and_attributes(spark, folder):
    write_shapefile(folder, "a", [(11, [[(1, 2, 3)]]), (11, [[(5, 6, 7)]])], ID + [("GEOMETRY", "C", 3, 0)],
                    [[b"1", b"x"], [b"2", b"y"]], marks={1: b"*"})
    df = shapefile.read_shapefile(spark, str(folder / "a.shp"), "g")
    assert df.columns == ["id", "geometry", "geometry_2", "group_id"] and df.count() == 1
    assert df.first()["geometry_2"]["srid"] == 32633
    assert shapefile.read_shapefile(spark, str(folder / "a.shp"), srid=3003).first()["geometry_2"]["srid"] == 3003
    v = df.first()["geometry_2"]["coords"][0][0][0]
    assert (v["x"], v["y"], v["z"]) == (1.0, 2.0, 3.0)


def test_shapefile_reference_system_from_parameters(spark, folder):
    """Each layer of a folder has the system of its own side-car, told by a code or by parameters."""
    from terraload.checks.sample_files import projection_text
    from terraload.functions.crs import SYSTEMS
    known = {s[0]: s for s in SYSTEMS}
    texts = {"a b": projection_text(known[3003], "desktop"), "b": projection_text(known[6875], "plain"), "c": None, "d": "nonsense", "e[1]": None}
    for k, (stem, prj) in enumerate(texts.items()):
        write_shapefile(folder, stem, [(1, [[(k, 2)]])], ID, [[str(k).encode()]], srid=32633 if stem.startswith("e") else None, prj=prj)
    df = shapefile.read_shapefile(spark, str(folder))
    assert {r["id"]: r["geometry"]["srid"] for r in df.collect()} == {0: 3003, 1: 6875, 2: None, 3: None, 4: 32633}
    assert shapefile.read_shapefile(spark, str(folder / "a b.shp")).first()["geometry"]["srid"] == 3003


def test_shapefile_without_sidecars(spark, folder):
    write_shapefile(folder, "bare", [(1, [[(1, 2)]])], srid=None)
    df = shapefile.read_shapefile(spark, str(folder / "bare.shp"))
    assert df.columns == ["geometry"] and df.first()["geometry"]["srid"] is None
    write_shapefile(folder, "noindex", [(1, [[(1, 2)]])], ID, [[b"1"]], index=False)
    assert shapes_of(shapefile.read_shapefile(spark, str(folder / "noindex.shp"))) == [("Point", False, [[1]])]
    write_shapefile(folder, "null", [(0, None)], ID, [[b"1"]])
    assert not shapefile.has_geometry(shapefile.read_shapefile(spark, str(folder / "null.shp")))


@pytest.mark.parametrize("split,chunk", [(700, 100), (9000, 1000), (1 << 20, 2000), (1 << 20, 1 << 20)])
def test_shapefile_splits_give_the_same_rows(folder, split, chunk, monkeypatch):
    # Read without Spark, so that the chunk size can be set.
    monkeypatch.setattr(shapefile, "CHUNK_BYTES", chunk)
    shapes = [(3, [[(i, i), (i + 1, i)] + [(i, j) for j in range(i % 5)]]) for i in range(300)]
    write_shapefile(folder, "a", shapes, ID, [[str(i).encode()] for i in range(300)])
    reader = shapefile.ShapefileReader({"path": str(folder), "splitBytes": str(split)}, ["id", "_deleted", "geometry"])
    found = []
    for part in reader.partitions():
        for batch in reader.read(part):
            found += [(int(r["id"]), r["geometry"]["coords"][0][0][0]["x"], len(r["geometry"]["coords"][0][0])) for r in batch.to_pylist()]
    assert found == [(i, float(i), 2 + i % 5) for i in range(300)]


@pytest.mark.parametrize("split", [700, 9000, 1 << 20])
def test_shapefile_splits_in_spark(spark, folder, split):
    shapes = [(3, [[(i, i), (i + 1, i)] + [(i, j) for j in range(i % 5)]]) for i in range(300)]
    write_shapefile(folder, "a", shapes, ID, [[str(i).encode()] for i in range(300)])
    df = shapefile.read_shapefile(spark, str(folder), splitBytes=split)
    found = sorted((r["id"], r["geometry"]["coords"][0][0][0]["x"], len(r["geometry"]["coords"][0][0])) for r in df.collect())
    assert found == [(i, float(i), 2 + i % 5) for i in range(300)]


def read_apart(folder, split, **options):
    """Rows without Spark, sorted by their number."""
    reader = shapefile.ShapefileReader({"path": str(folder), "splitBytes": str(split), **options}, ["id", "_deleted", "geometry"])
    found = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    return sorted(((int(r["id"]), r["geometry"]) for r in found), key=lambda r: r[0])


BARE_SHAPES = {
    "points": [(1, [[(i, -i)]]) if i % 7 else (0, None) for i in range(200)],
    "points_z": [(11, [[(i, -i, 7)]]) for i in range(200)],
    "lines": [(3, [[(i, i), (i + 1, i)] + [(i, j) for j in range(i % 50)]]) if i % 11 else (0, None) for i in range(200)],
    "areas_z": [(15, [[(x + i, y, i) for x, y in SQUARE], [(x + i, y, i) for x, y in HOLE]]) for i in range(100)],
    "many": [(8, [[(i, j) for j in range(1 + i % 9)]]) for i in range(100)],
    "one": [(1, [[(1, 2)]])],
}


@pytest.mark.parametrize("split", [40, 130, 1001, 9000, 1 << 20])
@pytest.mark.parametrize("kind", BARE_SHAPES)
def test_shapefile_without_index_gives_the_same_rows(folder, kind, split):
    shapes = BARE_SHAPES[kind]
    write_shapefile(folder, "a", shapes, ID, [[str(i).encode()] for i in range(len(shapes))])
    expected = read_apart(folder, 1 << 20)
    assert len(expected) == len(shapes)
    assert repr(read_apart(folder, split, index="false")) == repr(expected)
    (folder / "bare").mkdir()
    write_shapefile(folder / "bare", "a", shapes, ID, [[str(i).encode()] for i in range(len(shapes))], index=False)
    assert repr(read_apart(folder / "bare", split)) == repr(expected)


def test_short_ranges_share_tasks(folder):
    """As many tasks as bytes need; the ranges stay as short as they were asked for."""
    shapes = BARE_SHAPES["points_z"]
    write_shapefile(folder, "a", shapes, ID, [[str(i).encode()] for i in range(len(shapes))])
    for index in ("true", "false"):
        parts = shapefile.ShapefileReader({"path": str(folder), "splitBytes": "130", "index": index}, ["id", "_deleted", "geometry"]).partitions()
        assert len(parts) == 1 and len(parts[0].value[1]) > 50
    parts = dbf.DbfReader({"path": str(folder), "splitBytes": "13"}, ["id"]).partitions()
    assert len(parts) == 1 and len(parts[0].value) > 50
    packs = [[("a", i, i + 1)] for i in range(10)]
    assert files.task_packs(packs, files.TASK_BYTES // 4) == [sum(packs[:4], []), sum(packs[4:8], []), sum(packs[8:], [])]
    assert files.task_packs(packs, files.TASK_BYTES) == packs


def test_shapefile_without_index_windows(folder, monkeypatch):
    """Starts and headers on both sides of what is looked through at a time."""
    from terraload.sources import shape_scan
    shapes = BARE_SHAPES["lines"]
    write_shapefile(folder, "a", shapes, ID, [[str(i).encode()] for i in range(len(shapes))])
    expected = repr(read_apart(folder, 1 << 20))
    for window in (4, 64, 1000):
        monkeypatch.setattr(shape_scan, "WINDOW", window)
        assert repr(read_apart(folder, 777, index="false")) == expected


def test_shapefile_without_index_refuses_what_is_in_doubt(folder):
    """Records inside a record, a gap, a wrong number, a short file: never wrong rows, never fewer."""
    inner = b"".join(struct.pack(">ii", n, 10) + struct.pack("<idd", 1, n, n) for n in range(2, 14))
    inner += b"\0" * (-len(inner) % 16)
    fake = [struct.unpack_from("<dd", inner, k) for k in range(0, len(inner), 16)]
    shapes = [(8, [[(1, 1)] * 5]), (8, [fake]), (8, [[(1, 1)] * 5])]
    rows = [[str(i).encode()] for i in range(len(shapes))]
    write_shapefile(folder, "a", shapes, ID, rows)
    # Points inside a file of multipoints are no records of it.
    assert len(read_apart(folder, 100, index="false")) == 3
    record = struct.pack("<i4di2d", 8, 0, 0, 0, 0, 1, 0, 0)
    inner = b"".join(struct.pack(">ii", n, len(record) // 2) + record for n in range(2, 20))
    inner += b"\0" * (-len(inner) % 16)
    shapes[1] = (8, [[struct.unpack_from("<dd", inner, k) for k in range(0, len(inner), 16)]])
    write_shapefile(folder, "a", shapes, ID, rows)
    assert len(read_apart(folder, 1 << 20, index="false")) == 3
    with pytest.raises(ValueError, match="in doubt"):
        read_apart(folder, 300, index="false")
    assert len(read_apart(folder, 300)) == 3

    write_shapefile(folder, "a", BARE_SHAPES["points"], ID, [[str(i).encode()] for i in range(200)])
    whole = (folder / "a.shp").read_bytes()
    for damaged in (whole[:-5], whole[:1000] + struct.pack(">i", 7) * 10 + whole[1040:]):
        (folder / "a.shp").write_bytes(damaged)
        for split in (130, 1 << 20):
            with pytest.raises(ValueError):
                read_apart(folder, split, index="false")


def test_damaged_shapefile_index_is_found_out(folder):
    write_shapefile(folder, "a", BARE_SHAPES["lines"], ID, [[str(i).encode()] for i in range(200)])
    index = bytearray((folder / "a.shx").read_bytes())
    index[100 + 8 * 50:104 + 8 * 50] = struct.pack(">i", 54)
    (folder / "a.shx").write_bytes(index)
    with pytest.raises(ValueError, match="does not fit"):
        read_apart(folder, 1 << 20)
    assert len(read_apart(folder, 1000, index="false")) == 200


# Workbooks.


def test_workbook(spark, folder):
    styles = ('<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts>'
              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="2"/></cellXfs>')
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Full Name</t></is></c><c r="D1" t="s"><v>2</v></c>'
        '<c r="E1" t="str"><v>flag</v></c><c r="F1" t="str"><v>num</v></c></row>'
        '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" s="1"><v>45351.5</v></c><c r="E2" t="b"><v>1</v></c>'
        '<c r="F2" s="3"><v>1.25</v></c></row>'
        '<row r="4"><c r="A4"><v>2</v></c><c r="B4" t="s"><v>3</v></c><c r="D4" s="2"><v>45352</v></c><c r="F4"><v>2</v></c></row>'
        '<row r="6"><c r="A6"/></row>')
    places = ('<row r="1"><c t="str"><v>longitude</v></c><c t="str"><v>latitude</v></c></row>'
              '<row r="2"><c><v>9</v></c><c><v>45.5</v></c></row>')
    (folder / "b.xlsx").write_bytes(workbook(
        {"One": rows, "Empty": "", "My Places": places},
        shared=["<t>id</t>", "<r><t>007</t></r>", "<t>when</t>", "<r><t>a</t></r><r><t>b</t></r>"], styles=styles))
    sheets = xlsx.read_xlsx(spark, str(folder / "b.xlsx"), "g")
    assert list(sheets) == ["One", "My Places"]
    assert sheets["One"].columns == ["id", "full_name", "unnamed_2", "when", "flag", "num", "group_id"]
    moment = datetime.datetime
    assert sorted((tuple(r)[:6] for r in sheets["One"].collect()), key=lambda r: r[0] or 9) == [
        (1, "007", None, moment(2024, 2, 29, 12), True, 1.25), (2, "ab", None, moment(2024, 3, 1), None, 2.0),
        (None, None, None, None, None, None)]
    g = sheets["My Places"].first()["geometry"]
    assert (g["coords"][0][0][0]["x"], g["coords"][0][0][0]["y"], g["srid"]) == (9.0, 45.5, 4326)
    assert xlsx.sheet_table_name("9 b", "My Places") == "_9_b_my_places_"


# Archives.


def test_archives(spark, folder):
    inner = {"x/Roads.shp": b"1", "x/Roads.dbf": b"2", "x/y/Cities.dbf": b"33", "x/Upper.SHP": b"4", "x/readme.txt": b"5",
             "x/Roads.csv": b"6", "old.xls": b"7"}
    (folder / "a.zip").write_bytes(zip_of(inner))
    (folder / "b.zip").write_bytes(zip_of({"big.csv": b"a" * 3_000_000}))
    scanned = {r["entry"]: bytes(r["content"]) for r in archive.scan_archives(spark, str(folder)).collect()}
    assert scanned == {**inner, "big.csv": b"a" * 3_000_000}

    target = folder / "out"
    entries = archive.extract_archives(spark, str(folder / "a.zip"), str(target)).collect()
    assert {r["path"] for r in entries} == {f"{target}/a.zip/{e}" for e in inner}
    assert (target / "a.zip/x/y/Cities.dbf").read_bytes() == b"33"

    found = archive.inventory(archive.list_paths(spark, str(target)))
    kept = {(r["filename"], r["format"]) for r in archive.exclude_sidecars(found).collect()}
    assert kept == {("Roads.shp", "shapefile"), ("Cities.dbf", "dbf"), ("old.xls", "excel")}
    assert {(r["ext"], r["n_files"]) for r in archive.files_per_format(found).collect()} == {
        ("shp", 1), ("dbf", 2), ("csv", 1), ("xls", 1)}


def test_entries_stay_in_the_folder():
    assert archive.safe_entry("a\\b/../c.csv") == "a/c.csv"
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            archive.safe_entry(bad)


def test_md5_of_small_and_large_files(spark, folder):
    contents = {"small": b"x" * 10, "large": b"y" * 5_000_000, "empty": b""}
    (folder / "deep/er").mkdir(parents=True)
    for name, content in contents.items():
        (folder / ("deep/er" if name == "large" else "") / name).write_bytes(content)
    found = {r["path"].rsplit("/", 1)[-1]: (r["size"], r["md5"]) for r in archive.content_md5(spark, str(folder)).collect()}
    assert found == {n: (len(c), hashlib.md5(c).hexdigest()) for n, c in contents.items()}


# Records over several lines.


def quoted_file(seed, n):
    """Bytes of a file and its records as the parser should see them."""
    rng = random.Random(seed)
    out, rows = ["id;t;u\r\n"], []
    for i in range(n):
        fields = []
        for _ in range(2):
            kind = rng.random()
            if kind < 0.4:
                fields.append("".join(rng.choices(["a", "b c", ";", "\n", '""', "\r\n", "é", ";\n", '"";', "\n\n"], k=rng.randint(1, 7))))
                out_field = '"' + fields[-1] + '"'
            else:
                fields.append("".join(rng.choices("xyz", k=rng.randint(1, 9))) + rng.choice(["", ' 5"', '"q"']))
                out_field = fields[-1]
            fields[-1] = (out_field, fields[-1].replace('""', '"') if out_field[0] == '"' else fields[-1])
        out.append(f"{i};" + ";".join(f for f, _ in fields) + rng.choice(["\n", "\r\n"]) + rng.choice(["", "", "\n"]))
        rows.append((i, *[v.replace("\r", "") for _, v in fields]))
    return "".join(out).encode(), rows


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1000, 1 << 20])
def test_records_are_the_same_for_every_range_size(folder, range_bytes):
    """Read without Spark: each range by itself, its first state from those before it."""
    for seed in range(6):
        content, rows = quoted_file(seed, 60)
        (folder / "a.csv").write_bytes(content)
        path, size = str(folder / "a.csv"), len(content)
        table = pa.table({"path": [path] * len(range(0, size, range_bytes)), "start": list(range(0, size, range_bytes)),
                          "end": [min(a + range_bytes, size) for a in range(0, size, range_bytes)], "size": [size] * len(range(0, size, range_bytes))})
        looked = [r for b in quoted._look(ord(";"))(table.to_batches()) for r in b.to_pylist()]
        inside, found = False, []
        for r in looked:
            one = pa.RecordBatch.from_pylist([{**r, "inside": inside, "size": size}])
            found += [line for b in quoted._records(ord(";"))([one]) for line in b.column("line").to_pylist()]
            inside = r["end_1"] if inside else r["end_0"]
        assert len(found) == len(rows) and [int(line.split(";")[0]) for line in found] == [r[0] for r in rows]
        (folder / "a.csv").unlink()


def test_quoted_line_ends_need_no_option(spark, folder):
    expected = {}
    for seed in range(3):
        content, rows = quoted_file(seed, 80)
        (folder / f"part {seed}.csv").write_bytes(content if seed else content + b'999;"open\nto the end')
        expected[seed] = rows
    df = delimited.read_text_columns(spark, str(folder), range_bytes=300)
    found = sorted((int(r.id), r.t, r.u or "") for r in df.collect())
    # A quote that is never closed spoils its record alone.
    assert found == sorted(r for rows in expected.values() for r in rows)
    assert df.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 3
    (folder / "plain.csv").write_bytes(b'a;b\n1;x "y\n2;"z"\n')
    assert quoted.record_lines(spark, [(str(folder / "plain.csv"), 19)], ";") is None
    assert delimited.read_text_columns(spark, str(folder / "plain.csv")).collect() == [("1", 'x "y'), ("2", "z")]


def test_whole_texts_below_a_folder(spark, folder, monkeypatch):
    texts = {f"{d}/f{i}.csv": f"{d} è\r\n" * i for i in range(40) for d in (".", "a", "a/b/c")}
    for name, text in {**texts, ".x.part": "half", "_tmp/f1.csv": "x", "a/.x/f2.csv": "x"}.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(text.encode())
    (folder / "empty").mkdir()
    monkeypatch.setattr(archive, "TEXT_BYTES", 300)
    monkeypatch.setattr(archive, "BATCH_ROWS", 7)
    # The same rows as from Spark's own reader, which leaves out empty files.
    expected = {(str(folder / name), text) for name, text in texts.items() if text}
    for root in (str(folder), f"file://{folder}"):
        found = [(r["path"], r["value"]) for r in archive.whole_texts(spark, root).collect()]
        assert len(found) == len(set(found)) and {(p.removeprefix("file://"), v) for p, v in found} == expected
    own = spark.read.option("recursiveFileLookup", True).text(str(folder), wholetext=True)
    assert sorted(r["value"] for r in own.collect()) == sorted(v for _, v in expected)
