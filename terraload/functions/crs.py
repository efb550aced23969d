"""Reference systems told by their parameters, where a text names no code.

A bracketed text in either usual dialect, or in the newer keywords, becomes a row of parameters: datum, prime
meridian, projection, origin, scale, false origin and unit, with names and units made alike. An equi-join with
the table of known systems gives the code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from terraload.functions.geometry import srid_from_crs

# Parameters of the reference systems a load may ask for, and of two geographic ones.
# code, datum, prime meridian, projection, latitude and longitude of origin, scale, false easting, false northing, axes
SYSTEMS = (
    (4326, "wgs84", 0.0, "", 0.0, 0.0, 1.0, 0.0, 0.0, ""),
    (6705, "rdn2008", 0.0, "three axes", 0.0, 0.0, 1.0, 0.0, 0.0, ""),
    (6706, "rdn2008", 0.0, "", 0.0, 0.0, 1.0, 0.0, 0.0, ""),
    (3857, "wgs84", 0.0, "web mercator", 0.0, 0.0, 1.0, 0.0, 0.0, "EN"),
    (3003, "monte mario", 0.0, "transverse mercator", 0.0, 9.0, 0.9996, 1500000.0, 0.0, "EN"),
    (3004, "monte mario", 0.0, "transverse mercator", 0.0, 15.0, 0.9996, 2520000.0, 0.0, "EN"),
    (102091, "monte mario", 0.0, "transverse mercator", 0.0, 9.0, 0.9996, 1500000.0, 0.0, "EN"),
    (102092, "monte mario", 0.0, "transverse mercator", 0.0, 15.0, 0.9996, 2520000.0, 0.0, "EN"),
    (26591, "monte mario", 12.452333333333, "transverse mercator", 0.0, -3.452333333333, 0.9996, 1500000.0, 0.0, "EN"),
    (26592, "monte mario", 12.452333333333, "transverse mercator", 0.0, 2.547666666667, 0.9996, 2520000.0, 0.0, "EN"),
    (23032, "ed50", 0.0, "transverse mercator", 0.0, 9.0, 0.9996, 500000.0, 0.0, "EN"),
    (23033, "ed50", 0.0, "transverse mercator", 0.0, 15.0, 0.9996, 500000.0, 0.0, "EN"),
    (23034, "ed50", 0.0, "transverse mercator", 0.0, 21.0, 0.9996, 500000.0, 0.0, "EN"),
    (32632, "wgs84", 0.0, "transverse mercator", 0.0, 9.0, 0.9996, 500000.0, 0.0, "EN"),
    (32633, "wgs84", 0.0, "transverse mercator", 0.0, 15.0, 0.9996, 500000.0, 0.0, "EN"),
    (32634, "wgs84", 0.0, "transverse mercator", 0.0, 21.0, 0.9996, 500000.0, 0.0, "EN"),
    (25832, "etrs89", 0.0, "transverse mercator", 0.0, 9.0, 0.9996, 500000.0, 0.0, "EN"),
    (25833, "etrs89", 0.0, "transverse mercator", 0.0, 15.0, 0.9996, 500000.0, 0.0, "EN"),
    (6707, "rdn2008", 0.0, "transverse mercator", 0.0, 9.0, 0.9996, 500000.0, 0.0, "NE"),
    (6708, "rdn2008", 0.0, "transverse mercator", 0.0, 15.0, 0.9996, 500000.0, 0.0, "NE"),
    (6709, "rdn2008", 0.0, "transverse mercator", 0.0, 21.0, 0.9996, 500000.0, 0.0, "NE"),
    (6875, "rdn2008", 0.0, "transverse mercator", 0.0, 12.0, 0.9985, 7000000.0, 0.0, "NE"),
    (7794, "rdn2008", 0.0, "transverse mercator", 0.0, 12.0, 0.9985, 7000000.0, 0.0, "EN"),
)

# Names of one thing in the dialects, in small letters without other characters.
DATUMS = {
    "wgs84": ("wgs84", "wgs1984", "worldgeodeticsystem1984", "worldgeodeticsystem1984ensemble"),
    "ed50": ("ed50", "european1950", "europeandatum1950"),
    "etrs89": ("etrs89", "etrs1989", "europeanterrestrialreferencesystem1989", "europeanterrestrialreferencesystem1989ensemble"),
    "monte mario": ("montemario", "montemariorome", "rome1940"),
    "rdn2008": ("rdn2008", "retedinamicanazionale2008"),
}
PROJECTIONS = {
    "transverse mercator": ("transversemercator", "gausskruger"),
    "web mercator": ("mercatorauxiliarysphere", "popularvisualisationpseudomercator"),
}
PARAMETERS = {
    "latitude": ("latitudeoforigin", "latitudeofcenter", "latitudeofnaturalorigin"),
    "longitude": ("centralmeridian", "longitudeofcenter", "longitudeoforigin", "longitudeofnaturalorigin"),
    "scale": ("scalefactor", "scalefactoratnaturalorigin"),
    "easting": ("falseeasting",),
    "northing": ("falsenorthing",),
}
ANGLES = "degree|grad|gon|radian"

_NUMBER = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
_OPEN = r'\s*[\[(]\s*"'
_KEYS = ("datum", "meridian", "projection", "latitude", "longitude", "scale", "easting", "northing", "unit")


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _one_of(name: Column, names: dict[str, tuple[str, ...]]) -> Column:
    known = F.create_map(*[F.lit(v) for kind, spellings in names.items() for spelling in spellings for v in (spelling, kind)])
    return F.try_element_at(known, name)


def _with(value: Column, use) -> Column:
    """``use(value)``, for which the value is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rounded(value: Column, places: int) -> Column:
    # Adding zero makes a negative zero a plain one.
    return F.round(value, places) + F.lit(0.0)


def crs_parameters(crs: Column) -> Column:
    """The parameters of a reference system text as a struct; null where it names no datum or projection known here.

    Angles are in degrees, lengths in metres; what a text leaves out is 0, the scale 1. Parts of a compound text behind
    the horizontal system are not looked at. ``axes`` is ``EN`` or ``NE`` where the text tells.
    """
    text = F.regexp_replace(crs, r"(?is),\s*VERT_?C(?:S|RS)\s*[\[(].*$", "")
    return _with(text, lambda t: _with(_found_in(t), _parameters))


def _found_in(text: Column) -> Column:
    """What each pattern finds in a text, once for all its uses."""
    first = lambda pattern, group=1: F.regexp_extract(text, f"(?i){pattern}", group)
    every = lambda pattern, group=1: F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(group))
    entry = rf'\bPARAMETER{_OPEN}([^"]*)"\s*,\s*{_NUMBER}'
    return F.struct(
        F.upper(first(r'^\s*(?:(?:COMPD_CS|COMPOUNDCRS)\s*[\[(]\s*"[^"]*"\s*,\s*)?([A-Z_]+)')).alias("root"),
        _one_of(F.regexp_replace(_plain(first(rf'\b(?:DATUM|GEODETICDATUM|TRF|ENSEMBLE){_OPEN}([^"]*)"')), "^d(?!atum)", ""), DATUMS).alias("datum"),
        first(rf'\b(?:ANGLE)?UNIT{_OPEN}(?:{ANGLES})[^"]*"\s*,\s*{_NUMBER}').try_cast("double").alias("angle"),
        first(rf'\bPRIM(?:EM|EMERIDIAN){_OPEN}[^"]*"\s*,\s*{_NUMBER}').try_cast("double").alias("meridian"),
        F.try_element_at(every(rf'\b(?:LENGTH)?UNIT{_OPEN}(?!{ANGLES}|unity)[^"]*"\s*,\s*{_NUMBER}'), F.lit(-1)).try_cast("double").alias("length"),
        F.transform(every(entry), _plain).alias("names"), every(entry, 2).alias("values"),
        _one_of(_plain(first(rf'\b(?:PROJECTION|METHOD){_OPEN}([^"]*)"')), PROJECTIONS).alias("method"),
        # The sphere of web maps is told by an extension where the projection's name is that of the ellipsoid's.
        text.rlike(r"(?i)EXTENSION\s*[\[(]\s*\"PROJ4\"[^\]]*\+a=6378137 [^\]]*\+b=6378137[ .]").alias("sphere"),
        F.transform(every(rf'\bAXIS{_OPEN}[^"]*"\s*,\s*"?(north|south|east|west|up)'), lambda a: F.upper(F.substring(a, 1, 1))).alias("axes"))


def _parameters(found: Column) -> Column:
    projected = found["root"].isin("PROJCS", "PROJCRS", "PROJECTEDCRS")
    geographic = found["root"].isin("GEOGCS", "GEOGCRS", "GEOGRAPHICCRS", "GEODCRS", "GEODETICCRS")
    datum, axes = found["datum"], found["axes"]
    turn = F.round(F.coalesce(found["angle"], F.lit(math.radians(1))) / math.radians(1), 7)
    unit = F.when(projected, F.coalesce(found["length"], F.lit(1.0))).otherwise(F.lit(1.0))

    def parameter(name: str, default: float) -> Column:
        told = [F.get(found["values"], (F.array_position(found["names"], spelling) - 1).cast("int")).try_cast("double") for spelling in PARAMETERS[name]]
        return F.coalesce(*told, F.lit(default))

    projection = F.when(projected, F.when(found["sphere"], "web mercator").otherwise(found["method"])).otherwise(
        F.when(F.size(axes) == 3, "three axes").otherwise(""))
    row = F.struct(
        datum.alias("datum"), _rounded(F.coalesce(found["meridian"], F.lit(0.0)), 5).alias("meridian"), projection.alias("projection"),
        _rounded(parameter("latitude", 0.0) * turn, 6).alias("latitude"), _rounded(parameter("longitude", 0.0) * turn, 6).alias("longitude"),
        _rounded(parameter("scale", 1.0), 7).alias("scale"), _rounded(parameter("easting", 0.0) * unit, 2).alias("easting"),
        _rounded(parameter("northing", 0.0) * unit, 2).alias("northing"), _rounded(unit, 6).alias("unit"),
        F.array_join(F.slice(axes, -2, 2), "").alias("axes"))
    return F.when(datum.isNotNull() & projection.isNotNull() & (projected | geographic), row)


def known_systems(spark) -> DataFrame:
    """A row for each set of parameters, with the codes that have it: ``order`` is their axes."""
    rows = ", ".join(f"({c}, '{d}', {m}D, '{p}', {la}D, {lo}D, {k}D, {e}D, {n}D, 1.0D, '{a}')" for c, d, m, p, la, lo, k, e, n, a in SYSTEMS)
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(code, {', '.join(_KEYS)}, axes)")
    places = {"meridian": 5, "latitude": 6, "longitude": 6, "scale": 7, "easting": 2, "northing": 2, "unit": 6}
    keys = [(_rounded(F.col(k), places[k]) if k in places else F.col(k)).alias(k) for k in _KEYS]
    return table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("code", "axes"))).alias("codes"))


def with_srid(df: DataFrame, crs: str, name: str = "srid") -> DataFrame:
    """Add the code of the reference system text in column ``crs``: the one that the text gives for the whole system, else
    the one of its parameters, null for a system not known here.

    A code inside a projected system's text, such as that of its base, is not the system's. Of systems with the same parameters the one with the text's order of axes is taken, else the smallest code.
    """
    known = known_systems(df.sparkSession).select(*[F.col(k).alias(f"_known_{k}") for k in _KEYS], F.col("codes").alias("_codes"))
    told = df.withColumn("_crs", crs_parameters(F.col(crs)))
    found = told.join(F.broadcast(known), [F.col("_crs")[k] == F.col(f"_known_{k}") for k in _KEYS], "left")  # as many rows as SYSTEMS has
    same_axes = F.filter("_codes", lambda c: c["axes"] == F.col("_crs.axes"))
    code = F.coalesce(F.get(same_axes, F.lit(0))["code"], F.get("_codes", F.lit(0))["code"])
    own = F.regexp_extract(crs, r'(?i)EPSG["\s]*[,:]+\s*"?([0-9]+)"?\s*[\])]?\s*[\])]?\s*$', 1).try_cast("int")
    inner = F.when(~F.col(crs).rlike(r"(?i)\bPROJ(?:CS|CRS|ECTEDCRS)\s*[\[(]"), srid_from_crs(F.col(crs)))
    return found.withColumn(name, F.coalesce(own, code, inner).cast("int")).select(*df.columns, name)
