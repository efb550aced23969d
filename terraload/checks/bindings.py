"""The given tables in the shapes that operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraload.checks import sample_files as samples
from terraload.functions import geometry as geo
from terraload.runtime import new_path, work_dir
from terraload.sources.tables import create_schema

_written: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, kind: str, write) -> str:
    """Folder of sample files, written on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _written:
        path = new_path(spark, kind)
        write(path)
        _written[key] = path
    return _written[key]


def check_schema(spark: SparkSession, label: str = "check") -> str:
    """A schema of its own, in the work folder."""
    path = new_path(spark, label)
    name = path[len(work_dir(spark)) + 1:].replace("-", "_")
    create_schema(spark, name, path)
    return name


# Layers.

def events(spark, sf_dir) -> DataFrame:
    """Events with coordinates made from their numbers."""
    return table(spark, sf_dir, "events").select(
        "*", ((F.col("user_id") % 360).cast("double") - 180).alias("lon"),
        ((F.col("event_id") % 181).cast("double") - 90).alias("lat"))


def event_shapes(spark, sf_dir) -> DataFrame:
    """Points, pairs of points, lines and missing shapes, by kind of event and value."""
    lon, lat = F.col("lon"), F.col("lat")
    pair = F.format_string("MULTIPOINT ((%s %s), (%s %s))", lon.cast("string"), lat.cast("string"), lat.cast("string"), lon.cast("string"))
    line = F.format_string("LINESTRING Z (%s %s 1, %s %s 2)", lon.cast("string"), lat.cast("string"), lat.cast("string"), lon.cast("string"))
    high = F.col("value") > 10
    shape = (
        F.when((F.col("event_type") == "click") & high, geo.from_wkt(pair))
        .when((F.col("event_type") == "error") & high, geo.from_wkt(line))
        .when((F.col("event_type") == "view") | (F.col("value") > 5), geo.point(lon, lat))
    )
    return events(spark, sf_dir).withColumn("geometry", shape)


# Registries.

def uploads(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID_SHAPE"), F.concat(F.lit("order_"), key, F.lit(".zip")).alias("SHAPEFILE"),
        F.col("o_orderdate").alias("DATE_UPLOAD"), F.col("o_orderstatus").alias("STATUS"),
        F.col("o_orderpriority").alias("GROUP_ID"), F.col("o_custkey").cast("int").alias("SRID"),
        F.concat(F.lit("c:\\up\\"), key).alias("PATH_SHAPEFILE"), F.md5(key.cast("binary")).alias("MD5"),
        F.array(F.concat(F.lit("up/Area-"), key, F.lit(".shp")),
                F.concat(F.lit("up\\"), F.col("o_custkey").cast("string"), F.lit(" b.xlsx"))).alias("USERFILE"),
        F.lit(None).cast("string").alias("RESPONSE"))


def loads(spark, sf_dir) -> DataFrame:
    """The load of an order was made from the upload of twice its number; every other owner file has points."""
    def entry(filename, table_name, column, tipo):
        return F.struct(filename.alias("filename"), F.lit("public").alias("schema_name"), table_name.alias("table"),
                        F.lit(column).alias("column"), tipo.alias("tipo"))

    key, owner = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    area = (F.concat(F.lit("area_"), key, F.lit(".shp")), F.concat(F.lit("area_"), key))
    names = (F.concat(F.lit("owner_"), owner, F.lit(".csv")), F.concat(F.lit("owner_"), owner))
    points = F.when(F.col("o_custkey") % 2 == 0, "geometry(Point,4326)").otherwise("text")
    rows = F.array(entry(*area, "a", F.lit("text")), entry(*area, "b", F.lit("geometry(Polygon,4326)")), entry(*names, "c", points))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID_SHAPE"), F.col("o_orderdate").alias("DATE_LOAD"),
        F.col("o_orderstatus").alias("STATUS"), F.col("o_orderpriority").alias("GROUP_ID"),
        F.to_json(F.struct(rows.alias("data"), (F.col("o_orderkey") * 2).alias("upload"))).alias("REQUEST"))


def models(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ID_MODEL"), F.lit(None).cast("timestamp_ntz").alias("DATE_MODEL"),
        F.col("p_brand").alias("STATUS"), F.col("p_type").alias("GROUP_ID"),
        F.concat(F.lit("SELECT %brand% AS b, %size% + 1 AS n FROM "), F.translate("p_name", " ", "_"),
                 F.lit(" WHERE brand = %brand%")).alias("CODE"),
        F.col("p_size").cast("string").alias("PARAMS"), F.lit(False).alias("LIBRARY"))


def executions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ID_EXECUTION"),
        F.col("l_shipdate").alias("DATE_EXECUTION"), F.col("l_returnflag").alias("STATUS"),
        F.col("l_linestatus").alias("GROUP_ID"), F.col("l_partkey").alias("FK_MODEL"), F.col("l_orderkey").alias("FK_SHAPE"),
        *[F.lit(None).cast("string").alias(c) for c in ("PARAMS", "MAPPING_OUTPUT", "RESULTS")])


# Manifests: every part is a file of four columns.

def manifest(spark, sf_dir) -> DataFrame:
    def row(i, column, tipo, target, keep):
        return F.struct(F.lit(column).alias("column"), F.lit(tipo).alias("tipo"), target.alias("column_name"),
                        keep.alias("importing"), F.lit(i).alias("position"))

    key = F.col("p_partkey").cast("string")
    rows = F.array(
        row(0, "code", "integer", F.lit("code"), F.lit(True)),
        row(1, "label", "text", F.concat(F.lit("label_"), F.lower("p_type")), F.col("p_size") <= 30),
        row(2, "price", "double precision", F.lit("price"), F.col("p_size") > 10),
        row(3, "cost", "text", F.lit("price"), F.col("p_size") > 20),
    )
    named = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), key, F.lit(".csv")).alias("filename"), F.lit("public").alias("schema_name"),
        F.concat(F.lit("part_"), key).alias("table"), F.inline(rows), F.lit(0).alias("srid"))
    return named.select("*", F.lit(False).alias("isVariable"), F.lit(False).alias("df_out"))


# Layers to publish: every part is a layer, every brand a tenant.

def _part_layers(part) -> DataFrame:
    tail = F.concat_ws("_", F.lower("p_type"), F.translate("p_name", " ", "_"), F.col("p_partkey").cast("string"))
    prefix = F.when(F.col("p_size") > 40, "v_").when(F.col("p_size") > 30, "base_").otherwise("net_")
    return part.select(_tenant().alias("group_id"), F.concat(prefix, tail).alias("name"))


def _tenant() -> Column:
    return F.lower(F.translate("p_brand", "#", "_"))


def requested_layers(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")

    def meta(pattern, name):
        return part.filter(F.col("p_brand").like(pattern)).select(_tenant().alias("group_id"), F.lit(name).alias("name")).distinct()

    return _part_layers(part).unionByName(meta("%1%", "meta")).unionByName(meta("%2%", "v_meta"))


def known_layers(spark, sf_dir) -> DataFrame:
    """Layers published before: those of parts that cost less than 950."""
    return _part_layers(table(spark, sf_dir, "part").filter("p_retailprice < 950"))


# Results of a batch: every order is a part of its customer's table.

def load_results(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table"),
        (~((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000))).alias("ok"),
        F.floor("o_totalprice").cast("double").alias("elapsed"),
        (F.col("o_orderpriority") == "1-URGENT").alias("have_geom"))


def load_files(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("t"), key).alias("table"), F.concat(F.lit("to_load/t"), key, F.lit(".shp")).alias("path"))


# Sample files.

EVENT_FIELDS = [("EVENT_ID", "N", 12, 0), ("KIND", "C", 10, 0), ("VALUE", "N", 14, 3)]


def point_files(spark, sf_dir, with_z: bool) -> str:
    def write(path):
        e = events(spark, sf_dir)
        record = samples.dbf_record(EVENT_FIELDS, [F.col("event_id"), F.col("event_type"), F.format_string("%.3f", "value")], F.lit(False))
        shapes = e.select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("value").alias("z"), record.alias("record"))
        samples.write_points(shapes.repartition(4), EVENT_FIELDS, path, 32633, with_z)

    return once(spark, sf_dir, "pointz" if with_z else "point", write)


ORDER_FIELDS = [("O_KEY", "N", 12, 0), ("O_PRICE", "N", 14, 2), ("O_DATE", "D", 8, 0), ("O PRIO", "C", 15, 0),
                ("O_OPEN", "L", 1, 0), ("O_FACTOR", "F", 20, 4)]


def order_dbf(spark, sf_dir) -> str:
    def write(path):
        record = samples.dbf_record(ORDER_FIELDS, [
            F.col("o_orderkey"),
            F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("*" * 14)).otherwise(F.format_string("%.2f", "o_totalprice")),
            F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("00000000")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit("  ")).otherwise(F.col("o_orderpriority")),
            F.when(F.col("o_orderstatus") == "O", "Y").when(F.col("o_custkey") > 700, "?").otherwise("f"),
            F.when(F.col("o_custkey") > 100, F.format_string("%.4f", F.col("o_totalprice") * 2)),
        ], F.col("o_orderstatus") == "P")
        samples.write_dbf(table(spark, sf_dir, "orders").select(record.alias("record")).repartition(4), ORDER_FIELDS, path)

    return once(spark, sf_dir, "dbf", write)


CUSTOMER_HEADER = "C_CUSTKEY;C Name;c_nationkey;c_acctbal;qualità"


def customer_csv(spark, sf_dir, with_bad: bool) -> str:
    """Latin-1 lines with CRLF and single quotes; on demand each customer also has a long and a short line."""
    def write(path):
        good = F.concat_ws(";", "c_custkey", F.concat(F.lit("d'"), F.col("c_name")), "c_nationkey", "c_acctbal",
                           F.concat(F.lit("é "), F.col("c_mktsegment")))
        lines = [good]
        if with_bad:
            lines += [F.concat(good, F.lit(";over")), F.concat(good, F.lit(";")),
                      F.concat_ws(";", "c_custkey", F.concat(F.lit('"q;'), F.col("c_name"), F.lit('"')))]
        samples.write_lines(table(spark, sf_dir, "customer").select(F.explode(F.array(*lines)).alias("line")), CUSTOMER_HEADER, path)

    return once(spark, sf_dir, "csv-bad" if with_bad else "csv", write)


SHEETS = {"accounts": ["c_custkey", "c_name", "c_acctbal"], "Market Segments": ["c_custkey", "c_mktsegment"]}


def customer_books(spark, sf_dir) -> str:
    return once(spark, sf_dir, "xlsx", lambda path: samples.write_workbooks(
        table(spark, sf_dir, "customer").repartition(4), SHEETS, path))


def entry_name() -> Column:
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("csv", "dbf", "shp", "xlsx", "txt")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return F.concat(F.col("source"), F.lit("/Doc-"), F.col("doc_id").cast("string"), F.lit("."), suffix)


def document_zips(spark, sf_dir) -> str:
    return once(spark, sf_dir, "zip", lambda path: samples.write_zips(
        table(spark, sf_dir, "documents").select(entry_name().alias("entry"), F.col("text").alias("content")).repartition(8), path))



def same_entry_zips(spark, sf_dir) -> str:
    """Archives in three folders, whose entries have the names of the others' entries."""
    def write(path):
        docs = table(spark, sf_dir, "documents")
        for remainder in range(3):
            own = docs.filter(F.col("doc_id") % 3 == remainder)
            entry = F.concat(F.lit("data/r"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit(".csv"))
            samples.write_zips(own.select(entry.alias("entry"), F.col("text").alias("content")).repartition(2, "entry"), f"{path}/{remainder}")

    return once(spark, sf_dir, "zip-same", write)
