"""The documented example tables, made from their description in FIXTURES.md, must be described the same way."""

import re
from pathlib import Path

import pytest
from writers import write_shapefile

from terraload.functions.geometry import GEOMETRY_TYPE
from terraload.operators import manifest
from terraload.plans import ingest

SQUARE = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
SHAPES = {"comuni": (5, [SQUARE, [(x + 9, y) for x, y in SQUARE]]), "condotte": (3, [[(0, 0), (1, 1)]]), "giunzione": (11, [[(1, 2, 3)]])}
KINDS = {"text": ("C", 10, 0, b"x"), "integer": ("N", 9, 0, b"1"), "double precision": ("N", 12, 3, b"1.5")}


def documented(table):
    text = Path(__file__).resolve().parents[1].joinpath("FIXTURES.md").read_text()
    section = re.search(rf"### `{table}`.*?\n\n((?:\|.*\n)+)", text).group(1)
    cells = [[c.strip() for c in line.strip("|\n").split("|")] for line in section.splitlines()[2:]]
    return [(c[0], c[1]) for c in cells]


@pytest.mark.parametrize("table", SHAPES)
def test_layers(spark, folder, table):
    columns = documented(table)
    attributes = [(n, t) for n, t in columns if t in KINDS and n != "group_id"]
    fields = [(n.upper(), *KINDS[t][:3]) for n, t in attributes]
    write_shapefile(folder, table, [SHAPES[table]], fields, [[KINDS[t][3] for _, t in attributes]])
    part = ingest.read_file(spark, str(folder / f"{table}.shp"), "shapefile", table, "acme")[0]
    rows = manifest.describe_rows(part.frame, f"{table}.shp", table, "acme")
    assert [(r[3], r[4]) for r in rows] == columns and {r[8] for r in rows} == {32633}
    assert part.frame.schema["geometry"].dataType.fieldNames() == GEOMETRY_TYPE.fieldNames()


def test_points_of_a_text_file(spark, folder):
    columns = documented("antenne")
    plain = [(n, t) for n, t in columns if t in KINDS and n != "group_id"]
    lines = [";".join(n for n, _ in plain), ";".join({"text": "x", "integer": "7", "double precision": "9.5"}[t] for _, t in plain)]
    (folder / "antenne.csv").write_text("\n".join(lines) + "\n")
    part = ingest.read_file(spark, str(folder / "antenne.csv"), "csv", "antenne", "acme")[0]
    rows = manifest.describe_rows(part.frame, "antenne.csv", "antenne", "acme")
    assert [(r[3], r[4]) for r in rows] == columns and {r[8] for r in rows} == {4326}
