"""Sample files of partitions that are larger than one file may be."""

from pathlib import Path

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from terraload.checks import sample_files as samples
from terraload.sources import archive, dbf, shapefile

FIELDS = [("ID", "N", 8, 0)]


def records(spark, n):
    return spark.range(0, n, 1, 1).withColumn("record", samples.dbf_record(FIELDS, [F.col("id")], F.lit(False)))


def test_dbf_of_several_files(spark, folder):
    assert samples.write_dbf(records(spark, 1000), FIELDS, str(folder), file_bytes=4000) == 1000
    assert len(list(Path(folder).glob("table_0*.dbf"))) > 2
    assert sorted(r["id"] for r in dbf.read_dbf(spark, str(folder)).collect()) == list(range(1000))


def test_points_of_several_files(spark, folder):
    shapes = records(spark, 1000).select(F.col("id").cast("double").alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"), "record")
    assert samples.write_points(shapes, FIELDS, str(folder), 32633, True, file_bytes=8000) == 1000
    assert len(list(Path(folder).glob("points_0*.shp"))) > 2
    for index in ("true", "false"):
        read = shapefile.read_shapefile(spark, str(folder), index=index, splitBytes=5_001)
        found = read.select("id", F.col("geometry.coords")[0][0][0]["x"].alias("x")).collect()
        assert sorted((r["id"], r["x"]) for r in found) == [(i, float(i)) for i in range(1000)]


def test_archives_of_several_files(spark, folder):
    texts = spark.range(0, 2500, 1, 1).select(F.concat(F.lit("a/"), "id").alias("entry"), F.col("id").cast("string").alias("content"))
    assert samples.write_zips(texts, str(folder), file_entries=1200) == 2500
    assert {p.name for p in Path(folder).iterdir()} == {"archive_0.zip", "archive_0_1.zip", "archive_0_2.zip"}
    found = {(r["entry"], bytes(r["content"])) for r in archive.scan_archives(spark, str(folder)).collect()}
    assert found == {(f"a/{i}", str(i).encode()) for i in range(2500)}


def test_texts_pass_through_a_folder_that_goes(spark, folder, monkeypatch):
    monkeypatch.setattr(samples, "TEXT_BYTES", 500)
    texts = spark.range(0, 100, 1, 1).select(F.format_string("d%d/f%d.csv", F.col("id") % 3, "id").alias("name"), F.repeat(F.lit("è\n"), F.col("id").cast("int")).alias("text"))
    assert samples.write_texts(texts, str(folder)) == 100
    assert {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*") if p.is_file()} == {r["name"]: r["text"] for r in texts.collect()}
    assert sorted(p.name for p in Path(folder).iterdir()) == ["d0", "d1", "d2"]
    with pytest.raises(PythonException):
        samples.write_texts(texts.withColumn("text", F.nullif("text", F.lit("è\n"))), str(folder / "d0"))
    assert not [p for p in Path(folder).rglob(".*")]
