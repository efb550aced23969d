"""Geometry as a struct column, built and read with built-in functions only.

``coords`` nests part > ring > vertex. A point is one part with one ring with one vertex, an empty shape has no part.
A collection's ``coords`` holds the parts of all its members one after the other; ``members`` lists these with their depth,
their type and their number of parts, nested collections included, and is null for other shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraload.constants import ALLOWED_SRIDS, COORDINATE_COLUMNS, GEOGRAPHIC_SRID

VERTEX_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "z")])
COORDS_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(VERTEX_TYPE)))
MEMBERS_TYPE = T.ArrayType(T.StructType([
    T.StructField("depth", T.IntegerType()), T.StructField("gtype", T.StringType()), T.StructField("parts", T.IntegerType())]))
GEOMETRY_TYPE = T.StructType([
    T.StructField("srid", T.IntegerType()),
    T.StructField("gtype", T.StringType()),
    T.StructField("has_z", T.BooleanType()),
    T.StructField("coords", COORDS_TYPE),
    T.StructField("members", MEMBERS_TYPE),
])
COLLECTION = "GeometryCollection"

# WKT keyword -> geometry type name.
WKT_NAMES = {
    "POINT": "Point",
    "LINESTRING": "LineString",
    "POLYGON": "Polygon",
    "MULTIPOINT": "MultiPoint",
    "MULTILINESTRING": "MultiLineString",
    "MULTIPOLYGON": "MultiPolygon",
}

_WKT_WORD = r"(?:MULTI)?(?:POINT|LINESTRING|POLYGON)"
_WKT_HEAD = rf"(?i)^\s*(?:SRID=(\d{{1,9}});)?\s*({_WKT_WORD}|GEOMETRYCOLLECTION)\s*(ZM|Z|M|)\s*(\(|EMPTY)"


def _listed(item: str) -> str:
    """Pattern of one or more items in brackets. Nothing in it is tried twice, so that texts of any length match in one pass."""
    return rf"\(\s*+{item}\s*+(?:,\s*+{item}\s*+)*+\)"


_NUMBER = r"(?:[-+]?+(?:\d++(?:\.\d*+)?+|\.\d++)(?:E[-+]?+\d++)?+|NAN|[-+]?+INF(?:INITY)?+)"
_VERTEX = rf"{_NUMBER}(?:\s++{_NUMBER}){{1,3}}+"
_LINE = _listed(_VERTEX)
_LINES = _listed(_LINE)
_BODIES = {
    "POINT": rf"\(\s*+{_VERTEX}\s*+\)",
    "LINESTRING": _LINE,
    "POLYGON": _LINES,
    "MULTIPOINT": _listed(rf"(?:{_VERTEX}|\(\s*+{_VERTEX}\s*+\))"),
    "MULTILINESTRING": _LINES,
    "MULTIPOLYGON": _listed(_LINES),
}
# The whole of a text that is no collection.
_WKT_SHAPE = r"(?i)^\s*+(?:SRID=\d{1,9};)?+\s*+(?:" + "|".join(
    rf"{word}\s*+(?:ZM|Z|M)?+\s*+(?:EMPTY|{body})" for word, body in _BODIES.items()) + r")\s*+$"
# True where a text gave no geometry; the column does not reach any table.
LOST_GEOMETRY = "_lost_geometry"
# Characters that stand for the breaks between parts and between rings.
_PART_BREAK = "\u0001"
_RING_BREAK = "\u0002"


def is_layer_schema(schema: T.StructType) -> bool:
    """A table is a layer when some column has the geometry type."""
    return any(_is_geometry(f.dataType) for f in schema.fields)


def geometry_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if _is_geometry(f.dataType)]


def _is_geometry(data_type: T.DataType) -> bool:
    # Tables written before there were collections lack the members.
    return isinstance(data_type, T.StructType) and data_type.fieldNames() in (GEOMETRY_TYPE.fieldNames(), GEOMETRY_TYPE.fieldNames()[:-1])


def _geometry(srid: Column, gtype: Column, has_z: Column, coords: Column, members: Column | None = None) -> Column:
    listed = F.lit(None) if members is None else members
    return F.struct(srid.cast("int").alias("srid"), gtype.alias("gtype"), has_z.alias("has_z"), coords.alias("coords"),
                    listed.cast(MEMBERS_TYPE).alias("members"))


def _bind(value: Column, function) -> Column:
    """``function`` of a value that is computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def point(x: Column, y: Column, z: Column | None = None, srid: int = GEOGRAPHIC_SRID) -> Column:
    """Point from coordinates; null when one of them is missing."""
    height = F.lit(None).cast("double") if z is None else z.cast("double")
    vertex = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), height.alias("z"))
    built = _geometry(F.lit(srid), F.lit("Point"), F.lit(z is not None), F.array(F.array(F.array(vertex))))
    present = x.isNotNull() & y.isNotNull() & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double"))
    return F.when(present, built)


def from_wkt(text: Column, srid: int = GEOGRAPHIC_SRID) -> Column:
    """Geometry from well-known text; null when the text is not readable as a whole.

    A leading ``SRID=…;`` names the reference system. The third of three numbers is a height, unless the
    type says ``M``; measures are not kept. Empty shapes have no parts and no height. Collections may be nested.
    """
    def parse(written):
        # Most texts name no system, and a failing cast costs many times a look.
        own = F.when(written.rlike(r"(?i)^\s*SRID="), F.regexp_extract(written, _WKT_HEAD, 1).try_cast("int")).otherwise(srid)
        return (F.when(written.rlike(_WKT_SHAPE), _shape(written, own))
                .when(F.upper(F.regexp_extract(written, _WKT_HEAD, 2)) == "GEOMETRYCOLLECTION", _collection(written, own)))

    return _bind(text, parse)


def _shape(text: Column, srid: Column) -> Column:
    """Geometry of a text that the pattern of whole shapes matches: only breaks have to be found."""
    gtype = F.element_at(F.create_map(*[F.lit(v) for pair in WKT_NAMES.items() for v in pair]), F.upper(F.regexp_extract(text, _WKT_HEAD, 2)))
    measured = F.upper(F.regexp_extract(text, _WKT_HEAD, 3)) == "M"
    # Breaks become one character each, which splits without a pattern; brackets and odd blanks then are of no use.
    body = F.substr(text, F.locate("(", text))
    parts = (F.when(gtype == "MultiPolygon", F.regexp_replace(body, r"\)\s*+\)\s*+,", _PART_BREAK))
             .when(gtype == "MultiLineString", F.regexp_replace(body, r"\)\s*+,", _PART_BREAK))
             .when(gtype == "MultiPoint", F.translate(body, ",", _PART_BREAK))
             .otherwise(body))
    rings = F.when(gtype.isin("Polygon", "MultiPolygon"), F.regexp_replace(parts, r"\)\s*+,", _RING_BREAK)).otherwise(parts)
    marked = F.translate(rings, "()\t\n\r\f\u000b", " " * 7)

    def coords(height):
        def ring(written):
            numbers = F.transform(F.split(written, ","), lambda v: F.array_remove(F.split(v, " "), ""))
            return F.transform(numbers, lambda n: F.struct(
                F.get(n, F.lit(0)).try_cast("double").alias("x"), F.get(n, F.lit(1)).try_cast("double").alias("y"), height(n).alias("z")))

        return F.transform(F.split(marked, _PART_BREAK), lambda part: F.transform(F.split(part, _RING_BREAK), ring))

    third = coords(lambda n: F.get(n, F.lit(2)).try_cast("double"))
    third_of_four = coords(lambda n: F.when(F.size(n) == 4, F.get(n, F.lit(2)).try_cast("double")))
    read = F.when(F.locate("(", text) == 0, F.array().cast(COORDS_TYPE)).when(measured, third_of_four).otherwise(third)
    return _bind(read, lambda c: _geometry(srid, gtype, _any_height(c), c))


def _any_height(coords: Column) -> Column:
    return F.exists(coords, lambda part: F.exists(part, lambda ring: F.exists(ring, lambda v: v["z"].isNotNull())))


def _collection(text: Column, srid: Column) -> Column:
    """Geometry of a collection; null unless each member, each comma and each bracket is in its place.

    The text is cut before each type's name. A piece that opens a collection goes one level down, the brackets that a
    piece closes beyond its own go up. The work grows with members times nested collections.
    """
    whole = F.trim(F.regexp_replace(text, r"(?i)^\s*(?:SRID=\d{1,9};)?\s*", ""))
    cut = F.split(whole, rf"(?i)(?=\b(?:GEOMETRYCOLLECTION|{_WKT_WORD})\b)")

    def count(s, mark):
        return F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))

    def piece(written, at):
        bare = F.regexp_replace(written, r"\s*,?\s*$", "")
        tail = F.regexp_extract(bare, r"[\s)]*+$", 0)
        extra = count(bare, ")") - count(bare, "(")
        own = F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)), F.repeat(F.lit(")"), (count(tail, ")") - extra).cast("int")))
        opens = written.rlike(r"(?i)^GEOMETRYCOLLECTION\s*(?:ZM|Z|M)?\s*\(\s*$")
        empty = own.rlike(r"(?i)^GEOMETRYCOLLECTION\s*(?:ZM|Z|M)?\s*EMPTY\s*$")
        nested = _geometry(srid, F.lit(COLLECTION), F.lit(False), F.array().cast(COORDS_TYPE))
        read = (F.when(opens | empty, nested)
                .when((extra >= 0) & (count(tail, ")") >= extra) & own.rlike(_WKT_SHAPE) & ~own.rlike(r"(?i)^\s*SRID"), _shape(own, srid)))
        return F.struct(at.alias("at"), F.when(opens, F.lit(1)).otherwise(-extra).cast("int").alias("step"),
                        written.rlike(r",\s*$").alias("comma"), opens.alias("opens"), read.alias("shape"))

    def leveled(pieces):
        turns = F.filter(pieces, lambda p: p["step"] != 0)
        return F.transform(pieces, lambda p: F.struct(
            p.alias("piece"),
            F.aggregate(turns, F.lit(0), lambda level, t: F.when(t["at"] < p["at"], level + t["step"]).otherwise(level)).alias("depth")))

    def built(found):
        last = F.size(found) - 1

        def in_place(f):
            p = f["piece"]
            end = p["at"] == last
            after = f["depth"] + p["step"]
            return (p["shape"].isNotNull() & F.when(end, after == 0).otherwise(after >= 1)
                    & (p["comma"] == (~end & ~p["opens"])))

        inner = F.slice(found, F.lit(2), F.greatest(last, F.lit(0)))
        shapes = F.transform(inner, lambda f: f["piece"]["shape"]["coords"])
        members = F.transform(inner, lambda f: F.struct(
            f["depth"].alias("depth"), f["piece"]["shape"]["gtype"].alias("gtype"), F.size(f["piece"]["shape"]["coords"]).alias("parts")))
        has_z = F.exists(inner, lambda f: f["piece"]["shape"]["has_z"])
        return F.when(F.forall(found, in_place), _geometry(srid, F.lit(COLLECTION), has_z, F.flatten(shapes), members))

    return _bind(F.transform(cut, piece), lambda pieces: _bind(leveled(pieces), built))


def set_srid(geometry: Column, srid: int | None) -> Column:
    """Assign a reference system without moving coordinates; None keeps the stored one."""
    if srid is None:
        return geometry
    return F.when(geometry.isNotNull(), geometry.withField("srid", F.lit(srid).cast("int")))


def srid_from_crs(crs: Column) -> Column:
    """Code of the last EPSG authority in a reference system text."""
    codes = F.regexp_extract_all(crs, F.lit(r'(?i)EPSG["\s]*[,:]+\s*"?([0-9]+)'), F.lit(1))
    return F.try_element_at(codes, F.lit(-1)).try_cast("int")


def srid_allowed(srid: Column, allowed=ALLOWED_SRIDS) -> Column:
    return srid.isin(*allowed)


def requested_srid(choice: str | int | None) -> int | None:
    """The override a load asks for; ``auto`` means none."""
    if choice is None or choice == "auto":
        return None
    if int(choice) not in ALLOWED_SRIDS:
        raise ValueError(f"reference system {choice} is not allowed")
    return int(choice)


def geometry_label(gtype: Column, has_z: Column, srid: Column) -> Column:
    """Type label such as ``geometry(PointZ,32633)``."""
    suffix = F.when(has_z, F.lit("Z")).otherwise(F.lit(""))
    return F.concat(F.lit("geometry("), gtype, suffix, F.lit(","), srid.cast("string"), F.lit(")"))


def layer_summary(df: DataFrame, geometry: str = "geometry", by: list[str] | None = None) -> DataFrame:
    """One type, Z flag and reference system per layer, in one aggregation with constant state.

    One type names the layer; a type with its Multi form gives the Multi form; other mixes
    give ``Geometry``. Rows without geometry do not count.
    """
    g = F.col(geometry)
    bare = F.regexp_replace(g["gtype"], "^Multi", "")
    return df.groupBy(*(by or [])).agg(
        F.count(g["gtype"]).alias("n_geometries"),
        F.when(F.min(g["gtype"]) == F.max(g["gtype"]), F.min(g["gtype"]))
        .when(F.min(bare) == F.max(bare), F.concat(F.lit("Multi"), F.min(bare)))
        .when(F.count(g["gtype"]) > 0, F.lit("Geometry"))
        .alias("gtype"),
        F.bool_and(g["has_z"]).alias("has_z"),
        F.max(g["srid"]).alias("srid"),
    )


def rejected_layers(summary: DataFrame) -> DataFrame:
    """Layers of a summary none of whose rows has a geometry."""
    return summary.filter(F.col("n_geometries") == 0)


def vertex_count(geometry: Column) -> Column:
    rings = F.flatten(geometry["coords"])
    return F.aggregate(rings, F.lit(0), lambda n, ring: n + F.size(ring))


def is_layer_header(columns: list[str]) -> bool:
    """Do the names of text columns make their table a layer?"""
    return "geometry" in columns or any(x in columns and y in columns for x, y in COORDINATE_COLUMNS)


def detect_geometry(df: DataFrame) -> DataFrame:
    """Turn a plain table into a layer when its columns say where rows lie.

    Coordinate columns come first, then a ``geometry`` column with well-known text.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    for x, y in COORDINATE_COLUMNS:
        if x in types and y in types:
            return df.withColumn("geometry", point(F.col(x).try_cast("double"), F.col(y).try_cast("double")))
    if isinstance(types.get("geometry"), T.StringType):
        written = F.trim(F.coalesce("geometry", F.lit(""))) != ""
        read = df.withColumn(LOST_GEOMETRY, written).withColumn("geometry", from_wkt(F.col("geometry")))
        return read.withColumn(LOST_GEOMETRY, F.col(LOST_GEOMETRY) & F.col("geometry").isNull())
    return df
