"""Shapefiles as a data source that splits by index range, or by byte range where there is no index.

The index says where each geometry lies and the attribute record has the same number, so a
task joins the two by position and nothing is shuffled. Without an index a task looks for the first
record that starts in its bytes (``shape_scan``), and a record's own number says where its attributes lie.
"""

from __future__ import annotations

import json
import struct
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraload.functions import crs, names
from terraload.functions import geometry as geo
from terraload.sources import dbf, files, shape_scan

INDEX_HEADER = 100
INDEX_RECORD = 8
# Records of one Arrow batch, and bytes of shapes read for it at most (one record may be more).
CHUNK_RECORDS = 16384
CHUNK_BYTES = 8 << 20
GEOMETRY_COLUMN = "geometry"

# Shape type code -> family; codes above 10 carry Z, above 20 only M.
FAMILIES = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}

GEOMETRY_DDL = ("struct<srid:int,gtype:string,has_z:boolean,"
                "coords:array<array<array<struct<x:double,y:double,z:double>>>>,"
                "members:array<struct<depth:int,gtype:string,parts:int>>>")
# A shapefile has no collections, so this list is null in each of its shapes.
MEMBERS = pa.list_(pa.struct([("depth", pa.int32()), ("gtype", pa.string()), ("parts", pa.int32())]))


def signed_area(xy: np.ndarray) -> float:
    x, y = xy[:, 0], xy[:, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def inside(vertex: np.ndarray, ring: np.ndarray) -> bool:
    """Even-odd test of a vertex against a closed ring."""
    x0, y0, x1, y1 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
    crosses = (y0 > vertex[1]) != (y1 > vertex[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x0 + (vertex[1] - y0) * (x1 - x0) / (y1 - y0)
    return bool(np.count_nonzero(crosses & (vertex[0] < at)) % 2)


def group_rings(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons of flat rings: clockwise rings are outlines, each hole joins the smallest outline around it."""
    areas = [signed_area(r) for r in rings]
    outer = [i for i, a in enumerate(areas) if a <= 0]
    if not outer:
        return [[r] for r in rings]
    members = {i: [rings[i]] for i in outer}
    for i, area in enumerate(areas):
        if area > 0:
            homes = [o for o in outer if inside(rings[i][0], rings[o])]
            if homes:
                members[min(homes, key=lambda o: abs(areas[o]))].append(rings[i])
            else:
                members[i] = [rings[i]]
    return [members[i] for i in sorted(members)]


def parse_shape(content: bytes):
    """``(type name, has_z, parts)`` of one record, parts > rings > vertex rows; None for a null shape."""
    code = struct.unpack_from("<i", content)[0]
    if code == 0:
        return None
    family = FAMILIES.get(code % 10)
    if family is None or code > 28:
        raise ValueError(f"shape type {code} is not supported")
    has_z = 10 < code < 20
    if family == "Point":
        values = np.frombuffer(content, "<f8", 3 if has_z else 2, 4)
        return family, has_z, [[values.reshape(1, -1)]]
    if family == "MultiPoint":
        n_points = struct.unpack_from("<i", content, 36)[0]
        xy = _vertices(content, 40, n_points, has_z)
        return family, has_z, [[xy[i:i + 1]] for i in range(n_points)]
    n_parts, n_points = struct.unpack_from("<ii", content, 36)
    starts = np.frombuffer(content, "<i4", n_parts, 44)
    xy = _vertices(content, 44 + 4 * n_parts, n_points, has_z)
    pieces = np.split(xy, starts[1:])
    if family == "LineString":
        return (family if n_parts == 1 else "MultiLineString"), has_z, [[p] for p in pieces]
    polygons = group_rings(pieces)
    return (family if len(polygons) == 1 else "MultiPolygon"), has_z, polygons


def _vertices(content: bytes, at: int, n: int, has_z: bool) -> np.ndarray:
    xy = np.frombuffer(content, "<f8", 2 * n, at).reshape(n, 2)
    if not has_z:
        return xy
    z = np.frombuffer(content, "<f8", n, at + 16 * n + 16)
    return np.column_stack([xy, z])


def geometry_array(shapes, srid: int | None) -> pa.Array:
    """Arrow struct array from parsed shapes."""
    rings = [r for s in shapes if s for part in s[2] for r in part]
    sizes = [len(r) for r in rings]
    wide = [r if r.shape[1] == 3 else np.column_stack([r, np.full(len(r), np.nan)]) for r in rings]
    flat = np.concatenate(wide) if wide else np.zeros((0, 3))
    axes = [pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(flat[:, 2], from_pandas=True)]
    level = pa.StructArray.from_arrays(axes, ["x", "y", "z"])
    counts = (
        sizes,
        [len(part) for s in shapes if s for part in s[2]],
        [len(s[2]) if s else 0 for s in shapes],
    )
    for count in counts:
        offsets = np.concatenate([[0], np.cumsum(count, dtype=np.int64)]).astype(np.int32)
        level = pa.ListArray.from_arrays(pa.array(offsets), level)
    present = np.array([s is not None for s in shapes], bool)
    return pa.StructArray.from_arrays(
        [pa.array([srid if s else None for s in shapes], pa.int32()),
         pa.array([s[0] if s else None for s in shapes], pa.string()),
         pa.array([s[1] if s else None for s in shapes], pa.bool_()),
         level,
         pa.nulls(len(shapes), MEMBERS)],
        ["srid", "gtype", "has_z", "coords", "members"], mask=pa.array(~present))


def _texts(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with files.open_input(path) as handle:
                text = handle.read().decode("utf-8", errors="ignore")
            yield pa.RecordBatch.from_pydict({"path": [path], "crs": [text]})


def layer_systems(spark: SparkSession, path: str) -> dict[str, int]:
    """Codes of the reference systems of the layers in a folder, or of one layer, by path without suffix.

    All ``.prj`` files are read in one job; the driver gets a row for each.
    """
    folder, stem = (path.rsplit("/", 1)[0], path[:-4]) if path.lower().endswith(".shp") else (path, None)
    sides = [(p,) for p, _ in dbf.data_files(folder, ".prj") if stem is None or p[:-4] == stem]
    if not sides:
        return {}
    texts = spark.createDataFrame(sides, "path string").mapInArrow(_texts, "path string, crs string")
    found = crs.with_srid(texts, "crs").where("srid IS NOT NULL").select("path", "srid").collect()
    return {r["path"][:-4]: r["srid"] for r in found}


def index_spans(handle, at: int, count: int) -> np.ndarray:
    """Where records lie and how long they are, in bytes."""
    raw = files.read_range(handle, INDEX_HEADER + at * INDEX_RECORD, count * INDEX_RECORD)
    return np.frombuffer(raw, ">i4").reshape(count, 2).astype(np.int64) * 2


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile").load(path)``: text attributes, ``_deleted``, ``geometry``.

    Options: ``columns``, ``encoding``, ``srid`` for all layers or ``srids`` (a JSON object by path without suffix), ``splitBytes``,
    ``index`` (false: read all files without their indexes, as for damaged ones).
    The reader itself looks at no reference system; ``read_shapefile`` gives it the codes of the files'.
    """

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        layout = attribute_layout(self.options["path"])
        wanted = dbf.wanted_columns(self.options, [f.name for f in layout.fields]) if layout else []
        text = "".join(f"`{c}` string, " for c in wanted)
        return f"{text}{dbf.DELETED_COLUMN} boolean, `{free_name(wanted)}` {GEOMETRY_DDL}"

    def reader(self, schema):
        return ShapefileReader(self.options, schema.fieldNames())


def free_name(columns: list[str]) -> str:
    """Name of the geometry column, moved aside when an attribute has it."""
    return names.unique_names([*columns, GEOMETRY_COLUMN])[-1]


def attribute_layout(path: str):
    """Layout of the first shapefile's attributes, None when it has none."""
    found = dbf.data_files(path, ".shp")
    if not found:
        raise ValueError(f"no .shp file in {path}")
    side = files.sibling(found[0][0], ".dbf")
    if side is None:
        return None
    with files.open_input(side) as handle:
        return dbf.read_layout(handle)


class ShapefileReader(DataSourceReader):
    def __init__(self, options, field_names):
        self.path = options["path"]
        self.names = field_names
        self.columns = field_names[:-2]
        self.encoding = options.get("encoding")
        self.srid = int(options["srid"]) if options.get("srid") else None
        self.srids = json.loads(options.get("srids") or "{}")
        self.split_bytes = int(options.get("splitBytes", dbf.DEFAULT_SPLIT_BYTES))
        self.use_index = str(options.get("index", "true")).lower() != "false"

    def partitions(self):
        # The index size tells the number of records, the shape file's what they weigh.
        indexes = {p.lower()[:-4]: s for p, s in dbf.data_files(self.path_folder(), ".shx")} if self.use_index else {}
        counted, bare = [], []
        for path, size in dbf.data_files(self.path, ".shp"):
            if path.lower()[:-4] not in indexes:
                bare.append((path, size, 1))
                continue
            n_records = (indexes[path.lower()[:-4]] - INDEX_HEADER) // INDEX_RECORD
            counted.append((path, n_records, size / max(n_records, 1)))
        return [InputPartition((indexed, pack)) for indexed, lengths in ((True, counted), (False, bare))
                for pack in files.task_packs(files.pack_ranges(lengths, self.split_bytes), self.split_bytes)]

    def path_folder(self) -> str:
        return self.path.rsplit("/", 1)[0] if self.path.lower().endswith(".shp") else self.path

    def read(self, partition):
        indexed, ranges = partition.value
        for path, own in groupby(ranges, lambda r: r[0]):
            srid = self.srid if self.srid is not None else self.srids.get(path[:-4])
            side = files.sibling(path, ".dbf")
            with files.open_input(path) as shapes:
                table = files.open_input(side) if side else None
                try:
                    layout = dbf.read_layout(table) if table else None
                    encoding = self.encoding or (dbf.declared_encoding(path, layout) if layout else None)
                    if layout:
                        dbf.check_columns(path, layout, self.columns)
                    for _, first, last in own:
                        for at, spans in self.spans(path, shapes, first, last) if indexed else shape_scan.owned_spans(path, shapes, first, last, CHUNK_RECORDS):
                            # Cut where the shapes so far would fill another chunk.
                            chunk = np.cumsum(spans[:, 1]) // CHUNK_BYTES
                            for piece in np.split(spans, np.flatnonzero(np.diff(chunk)) + 1):
                                yield self.batch(path, shapes, table, layout, at, piece, srid, encoding)
                                at += len(piece)
                finally:
                    if table:
                        table.close()

    def spans(self, path, shapes, first, last):
        with files.open_input(files.sibling(path, ".shx")) as offsets:
            for at in range(first, last, CHUNK_RECORDS):
                yield at, index_spans(offsets, at, min(CHUNK_RECORDS, last - at))

    def batch(self, path, shapes, table, layout, at, spans, srid, encoding):
        count = len(spans)
        start = int(spans[:, 0].min())
        stretch = int((spans[:, 0] + spans[:, 1]).max()) + 8 - start
        if stretch <= 2 * int((spans[:, 1] + 8).sum()):
            block = files.read_range(shapes, start, stretch)
            records = (block[o - start:o - start + 8 + n] for o, n in spans.tolist())
        else:  # records of an edited file may lie far apart
            records = (files.read_range(shapes, o, n + 8) for o, n in spans.tolist())
        parsed = [parse_shape(checked_content(path, record, n)) for record, n in zip(records, spans[:, 1].tolist())]
        if layout:
            rows = files.read_range(
                table, layout.header_bytes + at * layout.record_bytes, count * layout.record_bytes)
            if len(rows) < count * layout.record_bytes:
                raise ValueError(f"{path} has more shapes than rows of attributes")
            arrays, deleted = dbf.cut_records(rows, layout, self.columns, encoding)
        else:
            arrays, deleted = [], np.zeros(count, bool)
        return pa.RecordBatch.from_arrays([*arrays, pa.array(deleted), geometry_array(parsed, srid)], self.names)


def checked_content(path: str, record: bytes, length: int) -> bytes:
    """What a record holds; an error where its own header tells another length than the index."""
    if len(record) != length + 8 or int.from_bytes(record[4:8], "big") * 2 != length:
        raise ValueError(f"the index of {path} does not fit its records; read it with index=false")
    return record[8:]


def read_shapefile(spark: SparkSession, path: str, group_id: str | None = None, srid: int | None = None,
                   columns: list[str] | None = None, doubles: list[str] | None = None, **options) -> DataFrame:
    """Layer with typed attributes; ``srid`` replaces the file's reference system."""
    spark.dataSource.register(ShapefileSource)
    layout = attribute_layout(path)
    reader = spark.read.format("shapefile").options(**options)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    if srid is not None:
        reader = reader.option("srid", str(srid))
    else:
        reader = reader.option("srids", json.dumps(layer_systems(spark, path)))
    raw = reader.load(path)
    shape = raw.columns[-1]
    attributes = [c for c in raw.columns if c not in (dbf.DELETED_COLUMN, shape)]
    values = dbf.typed_columns(layout, attributes, doubles or []) if layout else []
    table = raw.filter(~F.col(dbf.DELETED_COLUMN)).select(*values, F.col(shape).cast(geo.GEOMETRY_TYPE).alias(shape))
    return names.tag_tenant(table, group_id)


def has_geometry(layer: DataFrame, geometry: str = GEOMETRY_COLUMN) -> bool:
    """False for a layer none of whose rows has a shape; such files are rejected."""
    return bool(layer.filter(F.col(geometry)["gtype"].isNotNull()).limit(1).count())
