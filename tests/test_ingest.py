"""The whole way on hand-made files, with files that fail among them."""

import pytest
from pyspark.sql import functions as F
from writers import workbook, write_dbf, write_shapefile, zip_of

from terraload.operators import registry
from terraload.plans import batches, ingest, models, publish
from terraload.sources import archive, tables


@pytest.fixture
def archive_path(folder):
    root = folder / "in"
    root.mkdir()
    write_shapefile(root, "condotte", [(3, [[(0, 0), (1, 1)]]), (3, [[(0, 0), (2, 1)]])], [("GID", "N", 5, 0), ("STATO", "C", 9, 0)],
                    [[b"1", b"ok"], [b"2", b"old"]])
    write_shapefile(root, "nulls", [(0, None)], [("GID", "N", 5, 0)], [[b"1"]])
    write_dbf(root / "codes.dbf", [("ID", "N", 5, 0), ("WHEN", "D", 8, 0)], [[b"1", b"20240101"]])
    write_dbf(root / "memo.dbf", [("M", "M", 10, 0)], [[b"1"]])
    (root / "antenne.csv").write_text("Nome;longitudine;latitudine;anno\nuno;9.1;45.2;2020\ndue;9.2;45.3;x\n")
    (root / "empty.csv").write_text("")
    (root / "book.xlsx").write_bytes(workbook({
        "A": '<row r="1"><c t="str"><v>id</v></c></row><row r="2"><c><v>5</v></c></row>',
        "B": '<row r="1"><c t="str"><v>name</v></c></row><row r="2"><c t="str"><v>x</v></c></row>'}))
    (root / "old.xls").write_bytes(b"\xd0\xcf")
    (root / "notes.txt").write_text("no")
    path = folder / "upload.zip"
    path.write_bytes(zip_of({f"data/{p.name}": p.read_bytes() for p in root.iterdir()}))
    return str(path)


def test_archive_to_model(spark, schema, folder, archive_path):
    registry.create_registries(spark, schema)
    publish.create_catalog(spark, schema)
    upload, manifest = ingest.analyze_archive(spark, schema, "acme", archive_path, str(folder / "files"))
    found = {(r["table"], r["column"]): r for r in manifest.collect()}
    assert found["condotte", "geometry"]["tipo"] == "geometry(LineString,32633)" and found["condotte", "gid"]["srid"] == 32633
    assert found["antenne", "geometry"]["tipo"] == "geometry(Point,4326)" and found["antenne", "anno"]["tipo"] == "text"
    assert found["codes", "when"]["tipo"] == "text" and found["book_a", "id"]["tipo"] == "integer"
    failed = {r["filename"] for r in found.values() if r["column"] == "Error"}
    assert failed == {"memo.dbf", "empty.csv", "old.xls", "nulls.shp"}
    stored = registry.stored(spark, schema, registry.UPLOADS).first()
    assert len(stored["USERFILE"]) == 8 and len(stored["MD5"]) == 32

    edited = manifest.filter("column <> 'Error'").withColumn(
        "tipo", F.when(F.col("column") == "anno", "integer").otherwise(F.col("tipo"))
    ).withColumn("column_name", F.when(F.col("column") == "stato", "status").otherwise(F.col("column"))
    ).withColumn("importing", (F.col("column") != "nome") & (F.col("filename") != "codes.dbf"))
    target = schema + "_data"
    load, report, summary = ingest.load_batch(
        spark, schema, upload, "acme", edited, target, srid="3003", schema_location=str(folder / "tables"))
    assert summary["errors"] == {} and set(summary["layers"]) == {"condotte", "antenne"}
    assert {t.name for t in spark.catalog.listTables(target)} == {"condotte", "antenne", "book_a", "book_b"}
    assert summary["lost_values"] == {"antenne": 1}
    pipes = tables.scan_table(spark, target, "condotte")
    assert pipes.columns == ["gid", "status", "geometry", "group_id"] and pipes.first()["geometry"]["srid"] == 3003
    towers = tables.scan_table(spark, target, "antenne").orderBy("longitudine").collect()
    assert [(r["anno"], r["group_id"]) for r in towers] == [(2020, "acme"), (None, "acme")] and "nome" not in towers[0]
    assert report.filter("ok").count() == 4

    again = ingest.load_batch(spark, schema, upload, "acme", edited, target, skip_existing=True)[2]
    assert sorted(again["source_duplicated"]) == ["antenne.csv", "book.xlsx", "condotte.shp"] and again["loaded"] == {}

    appended = ingest.load_batch(spark, schema, upload, "acme", edited.filter("table = 'condotte'"), target, mode="append", key=["gid"])[2]
    assert appended["errors"] == {} and tables.scan_table(spark, target, "condotte").count() == 2
    refused = ingest.load_batch(spark, schema, upload, "acme", edited.filter("table = 'condotte'"), target, mode="append", key=["nope"])[2]
    assert list(refused["errors"]) == ["condotte.shp"]

    store = models.ModelStore(spark, schema)
    model = store.register("acme", "SELECT gid, status, geometry FROM condotte WHERE gid >= %low%")["id"]
    tenant = schema + "_acme"
    done = store.execute(tenant, load, model, {"low": 2}, {"result": "kept"}, str(folder / "tenant"))
    assert done["layers"] == ["kept"] and tables.scan_table(spark, tenant, "kept").count() == 1

    assert ingest.delete_load(spark, schema, load) == ["antenne", "book_a", "book_b"]  # a later load wrote the pipes, too
    assert list((folder / "files").iterdir())  # other loads were made from the same upload
    for other in [r["ID_SHAPE"] for r in registry.stored(spark, schema, registry.LOADS).collect()]:
        ingest.delete_load(spark, schema, other)
    assert not list((folder / "files").iterdir()) and (folder / "upload.zip").exists()
    with pytest.raises(KeyError):
        ingest.delete_load(spark, schema, load)
    assert spark.catalog.listTables(target) == []
    assert [r["name"] for r in tables.scan_table(spark, schema, publish.LAYERS).collect()] == ["kept"]


def test_two_files_of_one_table(spark, schema, folder):
    registry.create_registries(spark, schema)
    publish.create_catalog(spark, schema)
    path = folder / "u.zip"
    path.write_bytes(zip_of({"a/t.csv": "id\n1\n", "b/t.csv": "id\n2\n"}))
    upload, manifest = ingest.analyze_archive(spark, schema, "g", str(path), str(folder / "files"))
    summary = ingest.load_batch(spark, schema, upload, "g", manifest, schema)[2]
    assert summary["loaded"] == {"t": "t.csv"} and list(summary["errors"]) == ["t.csv"]
    assert [r["id"] for r in tables.scan_table(spark, schema, "t").collect()] == [1]


def test_unknown_reference_system_is_refused(spark, schema):
    with pytest.raises(ValueError):
        ingest.load_batch(spark, schema, 1, "g", None, schema, srid="1234")


def jobs_of(spark, work):
    group = f"counted-{len(list_of_groups)}"
    list_of_groups.append(group)
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


list_of_groups = []


def test_jobs_do_not_grow_with_the_files(spark, folder):
    """Two headers, 4 and 60 files: as many jobs, and the manifest that each file has by itself."""
    def listed(n):
        root = folder / str(n)
        root.mkdir()
        for k in range(n):
            (root / f"f{k}.csv").write_text(f"id;v\n{k};x{k}\n" if k % 2 else f"a,b,group_id\n{k}.5,,z\n")
        return ingest.listed_files(archive.inventory(archive.list_paths(spark, str(root)).select("path")))

    few, many = listed(4), listed(60)
    (manifest, errors, left), n_few = jobs_of(spark, lambda: batches.describe_texts(spark, few, "g"))
    (more, _, _), n_many = jobs_of(spark, lambda: batches.describe_texts(spark, many, "g"))
    assert n_few == n_many > 0 and errors == left == []
    found = more.orderBy("filename", "position").collect()
    assert len({r["filename"] for r in found}) == 60
    assert [(r["table"], r["column"], r["tipo"], r["position"]) for r in found if r["filename"] in ("f1.csv", "f2.csv")] == [
        ("f1", "id", "integer", 0), ("f1", "v", "text", 1), ("f1", "group_id", "text", 2),
        ("f2", "a", "double precision", 0), ("f2", "b", "double precision", 1), ("f2", "group_id", "text", 2)]
    by_itself = sorted((r for f in few for r in ingest._describe_file(spark, f, "g")), key=str)
    assert sorted(map(tuple, manifest.collect()), key=str) == by_itself


def test_files_that_cannot_be_described_stop_no_others(spark, folder):
    (folder / "empty.csv").write_bytes(b"")
    (folder / "bare.csv").write_text("a;b\n")
    (folder / "points.csv").write_text("longitude;latitude\n1;2\n")
    (folder / "lines.csv").write_text('a;b\n1;"two\nlines"\n')
    found = ingest.listed_files(archive.inventory(archive.list_paths(spark, str(folder)).select("path")))
    rows = {(r["filename"], r["column"]): r["tipo"] for r in ingest.build_manifest(spark, found, "g").collect()}
    assert rows == {("empty.csv", "Error"): "Text", ("bare.csv", "a"): "double precision", ("bare.csv", "b"): "double precision", ("bare.csv", "group_id"): "text",
                    ("points.csv", "longitude"): "integer", ("points.csv", "latitude"): "integer", ("points.csv", "geometry"): "geometry(Point,4326)",
                    ("points.csv", "group_id"): "text", ("lines.csv", "a"): "integer", ("lines.csv", "b"): "text", ("lines.csv", "group_id"): "text"}
