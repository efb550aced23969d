import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraload.checks.sample_files import projection_text
from terraload.functions import crs
from terraload.functions import geometry as geo
from terraload.functions import names, parsing, templates, types
from terraload.functions.digest import folder_digest


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


IDENTIFIERS = {
    "public": "__public__", "A-B c": "a_b_c", "a&b|c": "a_b_c", "0x": "_0x_", "9x": "_9x_", "\tname": "name",
    "": "", None: None, "PG_Catalog": "__pg_catalog__", "a+b:c;d%e*f": "a_b_c_d_e_f", " x ": "_x_", "3": "_3_",
}


def test_identifiers(spark):
    assert column(spark, list(IDENTIFIERS), names.clean_identifier) == list(IDENTIFIERS.values())
    assert [names.clean_name(n) for n in IDENTIFIERS] == list(IDENTIFIERS.values())
    assert names.clean_name("mine", reserved=["mine"]) == "__mine__"


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=12))
def test_cleaned_names_never_begin_with_a_digit(name):
    cleaned = names.clean_name(name)
    assert not cleaned[:1] in tuple("0123456789")
    assert not set(cleaned) & set("-&|+:;%* ")


@settings(deadline=None, max_examples=5)
@given(st.lists(st.text(st.characters(codec="latin-1"), max_size=8), min_size=20, max_size=60))
def test_column_and_driver_rule_agree(spark, values):
    assert column(spark, values, names.clean_identifier) == [names.clean_name(v) for v in values]


def test_names_that_collide(spark):
    assert names.unique_names(["a", "A", "b", "a", "a_2"]) == ["a", "A_2", "b", "a_3", "a_2_2"]
    df = spark.createDataFrame([(1, 2)], "`a-b` int, `a b` int")
    assert names.tag_tenant(df, None).columns == df.columns


def test_paths(spark):
    paths = ["a/b/Roads-1.shp", "c:\\x\\9.tar.dbf", "noext", "a.b/c"]
    assert column(spark, paths, names.table_name) == ["roads_1", "_9.tar_", "noext", "c"]


def test_number_fields(spark):
    texts = ["  12", "-3", "+4", "", "   ", "*****", "1.5", "12345678901234567890", None]
    assert column(spark, texts, parsing.parse_integer) == [12, -3, 4, None, None, None, None, None, None]
    texts = [" 1.50", "2", ".5", "5.", "1e3", "nan", "*****", "1d", "", None]
    assert column(spark, texts, parsing.parse_float) == [1.5, 2.0, 0.5, 5.0, 1000.0, None, None, None, None, None]


def test_other_fields(spark):
    day = datetime.date(2024, 2, 29)
    texts = ["20240229", "20240230", "00000000", "20240011", "00000101", "        ", "2024-2-1", None]
    assert column(spark, texts, parsing.parse_date) == [day] + [None] * 7
    texts = ["T", "t", "Y", "y", "F", "f", "N", "n", "?", " ", None]
    assert column(spark, texts, parsing.parse_bool) == [True] * 4 + [False] * 4 + [None] * 3
    assert column(spark, [" a ", "  ", None], parsing.parse_char) == ["a", None, None]
    assert column(spark, ['a"b'], parsing.escape_quotes) == ['a\\"b']


def test_missing_texts(spark):
    assert column(spark, ["NA", "", " ", "x", "NULL", "nan", "0"], parsing.missing_to_null) == [None, None, " ", "x", None, None, "0"]


def test_decoding(spark):
    raw = ["città".encode().decode("latin-1"), "città", "\x80uro\x81", "plain"]
    assert column(spark, raw, lambda c: parsing.decode_line(c)) == ["città", "città", "€uro", "plain"]
    assert column(spark, raw, lambda c: parsing.decode_line(c, "utf-8")) == ["città", "citt", "uro", "plain"]
    with pytest.raises(ValueError):
        parsing.decode_line(F.lit("x"), "klingon")


def test_separator(spark):
    assert column(spark, ["a;b", "a\tb,c", "a,b", "a", "a;b,c"], parsing.sniff_separator) == [";", "\t", ",", ",", ";"]


def test_types_from_values(spark):
    rows = [("1", "1", "a", "true", "2024-01-01", None, "99999999999999999999"), ("2", "1.5", "1", "False", "2024-02-30", None, "1"),
            (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")
    found = types.inferred_labels(df)
    assert found == {"a": "integer", "b": "double precision", "c": "text", "d": "boolean", "e": "text", "f": "double precision",
                     "g": "double precision"}
    assert types.inferred_labels(df.limit(1))["e"] == "date"
    assert types.inferred_labels(df.limit(1), dates=False)["e"] == "text"
    assert [f.dataType.simpleString() for f in types.to_labels(df, found).schema] == [
        "bigint", "double", "string", "boolean", "string", "double", "double"]
    with pytest.raises(ValueError):
        types.spark_type("money")


def test_points(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (float("nan"), 2.0)], "x double, y double")
    found = [r[0] for r in df.select(geo.point(F.col("x"), F.col("y"))).collect()]
    assert found[0]["coords"][0][0][0].asDict() == {"x": 1.0, "y": 2.0, "z": None}
    assert found[0]["srid"] == 4326 and found[1:] == [None, None]


WKT = {
    "POINT (1 2)": ("Point", False, [[[(1, 2, None)]]]),
    "point z (1 2 3)": ("Point", True, [[[(1, 2, 3)]]]),
    "LINESTRING(0 0, 1 1.5,2 2)": ("LineString", False, [[[(0, 0, None), (1, 1.5, None), (2, 2, None)]]]),
    "POLYGON ((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))": (
        "Polygon", False, [[[(0, 0, None), (4, 0, None), (4, 4, None), (0, 0, None)], [(1, 1, None), (2, 1, None), (2, 2, None), (1, 1, None)]]]),
    "MULTIPOINT (1 2, 3 4)": ("MultiPoint", False, [[[(1, 2, None)]], [[(3, 4, None)]]]),
    "MULTIPOINT ((1 2),(3 4))": ("MultiPoint", False, [[[(1, 2, None)]], [[(3, 4, None)]]]),
    "MULTILINESTRING ((0 0,1 1),(2 2,3 3))": ("MultiLineString", False, [[[(0, 0, None), (1, 1, None)]], [[(2, 2, None), (3, 3, None)]]]),
    "MULTIPOLYGON (((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5),(5.1 5.1,5.2 5.1,5.2 5.2,5.1 5.1)))": (
        "MultiPolygon", False,
        [[[(0, 0, None), (1, 0, None), (1, 1, None), (0, 0, None)]],
         [[(5, 5, None), (6, 5, None), (6, 6, None), (5, 5, None)], [(5.1, 5.1, None), (5.2, 5.1, None), (5.2, 5.2, None), (5.1, 5.1, None)]]]),
    "POINT M (1 2 3)": ("Point", False, [[[(1, 2, None)]]]), "POINT ZM (1 2 3 4)": ("Point", True, [[[(1, 2, 3)]]]),
    "LINESTRING (0 0, 1 1": None, "POINT (1 2 x)": None, "POINT (1)": None, "POLYGON (0 0, 1 1)": None, "POINT (1 2) x": None,
    "LINESTRING ((0 0, 1 1))": None, "MULTIPOLYGON ((0 0,1 0,1 1,0 0))": None, "POINT(1\t2\n)": ("Point", False, [[[(1, 2, None)]]]), "POINT (1e3 -.5E-2)": ("Point", False, [[[(1000, -0.005, None)]]]),
    "LINESTRING M (0 0 1,1 1 2)": ("LineString", False, [[[(0, 0, None), (1, 1, None)]]]),
    "POINT EMPTY": ("Point", False, []), "multipolygon z empty": ("MultiPolygon", False, []),
    "POINT (1d 2)": None, "POINT (1 2 3 4 5)": None, "LINESTRING (0 0, 1 1,)": None, "MULTIPOINT ((1 2, 3 4))": None,
    "CIRCLE (1 2)": None, "POINT (a b)": None, "": None, None: None,
}


def test_well_known_text(spark):
    found = column(spark, list(WKT), geo.from_wkt)
    for text, got, expected in zip(WKT, found, WKT.values()):
        if expected is None:
            assert got is None, text
        else:
            coords = [[[tuple(v) for v in ring] for ring in part] for part in got["coords"]]
            assert (got["gtype"], got["has_z"], coords) == expected, text


COLLECTIONS = {
    "GEOMETRYCOLLECTION EMPTY": (False, 0, []),
    "GEOMETRYCOLLECTION (POINT (1 2))": (False, 1, [(1, "Point", 1)]),
    "geometrycollection z(POINT Z (1 2 3), LINESTRING (0 0,1 1) ,GEOMETRYCOLLECTION (POLYGON ((0 0,1 0,1 1,0 0)) , POINT EMPTY, "
    "GEOMETRYCOLLECTION EMPTY ), MULTIPOINT ((1 1),(2 2)))  ": (True, 5, [
        (1, "Point", 1), (1, "LineString", 1), (1, "GeometryCollection", 0), (2, "Polygon", 1), (2, "Point", 0),
        (2, "GeometryCollection", 0), (1, "MultiPoint", 2)]),
    "SRID=3003; GEOMETRYCOLLECTION (GEOMETRYCOLLECTION (GEOMETRYCOLLECTION (POINT (5 6))), POINT (2 2))": (False, 2, [
        (1, "GeometryCollection", 0), (2, "GeometryCollection", 0), (3, "Point", 1), (1, "Point", 1)]),
}
NO_COLLECTIONS = [
    "GEOMETRYCOLLECTION (POINT (1 2)", "GEOMETRYCOLLECTION (POINT (1 2)))", "GEOMETRYCOLLECTION (POINT (1 2)),", "GEOMETRYCOLLECTION (, POINT (1 2))",
    "GEOMETRYCOLLECTION (POINT (1 2), )", "GEOMETRYCOLLECTION (POINT (1 2) POINT (1 2))", "GEOMETRYCOLLECTION ()", "GEOMETRYCOLLECTION (EMPTY)",
    "GEOMETRYCOLLECTION (POINT (1 2)), POINT (3 4)", "GEOMETRYCOLLECTION (SRID=3;POINT (1 2))", "GEOMETRYCOLLECTION (POINT (1 1), (2 2))",
    "GEOMETRYCOLLECTION (POINT (1 x))", "GEOMETRYCOLLECTION (POINT (1 2), CIRCLE (1 2))",
]


def test_collections(spark):
    found = column(spark, [*COLLECTIONS, *NO_COLLECTIONS], geo.from_wkt)
    for text, got, (has_z, n_parts, members) in zip(COLLECTIONS, found, COLLECTIONS.values()):
        assert got["gtype"] == "GeometryCollection" and got["srid"] == (3003 if text.startswith("SRID") else 4326)
        assert (got["has_z"], len(got["coords"]), [tuple(m) for m in got["members"]]) == (has_z, n_parts, members), text
    assert not any(found[len(COLLECTIONS):])


def test_long_texts(spark):
    """Neither many vertices nor many members are too much for the patterns."""
    ring = ", ".join(f"{i}.5 {i}" for i in range(50_000))
    points = ", ".join(f"POINT ({i} {i})" for i in range(5000))
    found = column(spark, [f"POLYGON (({ring}))", f"POLYGON (({ring})", f"GEOMETRYCOLLECTION ({points})"], geo.from_wkt)
    assert len(found[0]["coords"][0][0]) == 50_000 and found[1] is None and len(found[2]["members"]) == 5000


def test_reference_systems(spark):
    texts = ['PROJCS["a",GEOGCS["b",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32633"]]', "EPSG:3003", 'GEOGCS["x"]', None]
    assert column(spark, texts, geo.srid_from_crs) == [32633, 3003, None, None]
    assert geo.requested_srid("auto") is None and geo.requested_srid("32633") == 32633
    with pytest.raises(ValueError):
        geo.requested_srid(1)


def test_layer_summary(spark):
    def summary(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(geo.from_wkt(F.col("t"), 32633).alias("geometry"))
        return tuple(geo.layer_summary(df).first())

    assert summary("POINT (1 2)", None) == (1, "Point", False, 32633)
    assert summary("POINT Z (1 2 3)", "MULTIPOINT Z ((1 2 3),(3 4 5))") == (2, "MultiPoint", True, 32633)
    assert summary("POINT (1 2)", "LINESTRING (1 1,2 2)") == (2, "Geometry", False, 32633)
    assert summary("GEOMETRYCOLLECTION (POINT (1 2))", "GEOMETRYCOLLECTION EMPTY") == (2, "GeometryCollection", False, 32633)
    assert summary("GEOMETRYCOLLECTION (POINT (1 2))", "POINT (1 2)") == (2, "Geometry", False, 32633)
    assert summary(None) == (0, None, None, None)


def test_reference_system_in_the_text(spark):
    found = column(spark, ["SRID=3003;POINT (1 2)", "POINT (1 2)"], geo.from_wkt)
    assert [g["srid"] for g in found] == [3003, 4326]


def test_parameters():
    sql, args = templates.bind("SELECT %a% + %b_c% + %a%", {"a": 1, "b_c": "'; DROP"})
    assert sql == "SELECT :p0_a + :p1_b_c + :p0_a" and args == {"p0_a": 1, "p1_b_c": "'; DROP"}
    with pytest.raises(KeyError):
        templates.bind("%x%", {})
    quoted = """SELECT 'it''s %a%', "%a%", `%a%`, 5 %% 2, x % 3, y % z -- %a%
        /* %a% */ FROM t WHERE n LIKE '%road%'"""
    assert templates.bind(quoted + " AND m = %a%", {"a": 2}) == (quoted.replace("%%", "%") + " AND m = :p0_a", {"p0_a": 2})


def test_folder_digest_ignores_order_and_splits(spark):
    rows = [("r", f"f{i}", str(i)) for i in range(50)]
    one = spark.createDataFrame(rows, "root string, path string, md5 string")
    other = spark.createDataFrame(rows[::-1], one.schema).repartition(7)
    changed = spark.createDataFrame(rows[:-1] + [("r", "f49", "x")], one.schema)
    digests = [folder_digest(d, ["root"]).first()["digest"] for d in (one, other, changed)]
    assert digests[0] == digests[1] != digests[2]


WKT2 = """PROJCRS["WGS 84 / UTM zone 32N",BASEGEOGCRS["WGS 84",ENSEMBLE["World Geodetic System 1984 ensemble",ELLIPSOID["WGS 84",6378137,298.25,
LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]],CONVERSION["UTM zone 32N",METHOD["Transverse Mercator"],
PARAMETER["Latitude of natural origin",0,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Longitude of natural origin",9,ANGLEUNIT["degree",0.0174532925199433]],
PARAMETER["Scale factor at natural origin",0.9996,SCALEUNIT["unity",1]],PARAMETER["False easting",500000,LENGTHUNIT["metre",1]],
PARAMETER["False northing",0,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["(E)",east],AXIS["(N)",north],LENGTHUNIT["metre",1]]"""


def test_srid_from_parameters(spark):
    zone = projection_text(dict((s[0], s) for s in crs.SYSTEMS)[25832], "desktop")
    texts = {
        zone: 25832, zone.replace("[", "(").replace("]", ")"): 25832, zone.lower(): 25832, "  " + zone: 25832, WKT2: 32632,
        zone.replace("9.0", "10.0").replace('"Degree",0.0174532925199433', '"grad",0.015707963267949'): 25832,
        zone.replace("500000.0", "500.0").replace('"Meter",1.0', '"kilometer",1000.0'): None,
        zone.replace("9.0", "-9.0"): None, zone.replace("500000.0", "x"): None, zone.replace("False_Northing\",0.0", "False_Northing\",-0.0"): 25832,
        zone.replace('"D_ETRS_1989"', '"D_ETRS_1989",AUTHORITY["EPSG","6258"]'): 25832, "EPSG:3004": 3004, WKT2[:-1] + ',ID["EPSG",32699]]': 32699,
        'PROJCS["z",GEOGCS["g",AUTHORITY["EPSG","4326"]],PROJECTION["Other"]]': None, zone + zone: 25832, "PROJCS[": None, "": None, None: None, "x" * 100_000: None, 'GEOGCS["w",DATUM["D_WGS_1984"]]': 4326,
        'GEOGCS["r",DATUM["RDN2008"]]': 6706}
    rows = spark.createDataFrame([(t, i, "kept") for i, t in enumerate(texts)], "prj string, i int, codes string")
    found = crs.with_srid(rows, "prj")
    assert found.columns == ["prj", "i", "codes", "srid"]
    assert {r["prj"]: r["srid"] for r in found.collect()} == texts
    assert crs.with_srid(rows.where("false"), "prj").count() == 0


def test_each_pattern_of_a_reference_system_is_matched_once(spark):
    found = spark.createDataFrame([("x",)], "t string").select(crs.crs_parameters(F.col("t")).alias("p"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("VERT_?C") == 1
    # The entries' names and their values.
    assert plan.count("bPARAMETER") == 2
