"""Registries of uploads, loads, models and executions."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraload.functions.names import quote_name
from terraload.operators.manifest import from_json
from terraload.operators.ordering import number_rows
from terraload.operators.sinks import swap_table
from terraload.sources.tables import scan_table

PAGE_ROWS = 100


@dataclass(frozen=True)
class Kind:
    """One registry: table, id column and columns."""

    table: str
    key: str
    ddl: str

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


UPLOADS = Kind("uploads", "ID_SHAPE", (
    "ID_SHAPE bigint, SHAPEFILE string, DATE_UPLOAD timestamp_ntz, STATUS string, GROUP_ID string, SRID int, "
    "PATH_SHAPEFILE string, MD5 string, USERFILE array<string>, RESPONSE string"))
LOADS = Kind("loads", "ID_SHAPE", (
    "ID_SHAPE bigint, DATE_LOAD timestamp_ntz, STATUS string, GROUP_ID string, REQUEST string"))
MODELS = Kind("models", "ID_MODEL", (
    "ID_MODEL bigint, DATE_MODEL timestamp_ntz, STATUS string, GROUP_ID string, CODE string, PARAMS string, "
    "LIBRARY boolean"))
EXECUTIONS = Kind("executions", "ID_EXECUTION", (
    "ID_EXECUTION bigint, DATE_EXECUTION timestamp_ntz, STATUS string, GROUP_ID string, FK_MODEL bigint, "
    "FK_SHAPE bigint, PARAMS string, MAPPING_OUTPUT string, RESULTS string"))
KINDS = (UPLOADS, LOADS, MODELS, EXECUTIONS)

# Tables that each load wrote, or failed to.
OUTCOMES = "load_outcomes"
OUTCOMES_DDL = ("ID_SHAPE bigint, GROUP_ID string, schema_name string, table string, filename string, mode string, "
                "ok boolean, have_geom boolean")
# Files that each upload owns; a row without a path says that the upload's files were deleted.
UPLOAD_FILES = "upload_files"
UPLOAD_FILES_DDL = "ID_SHAPE bigint, path string, released boolean"
# Ids of deleted requests, which are not given again.
RETIRED = "retired_ids"
RETIRED_DDL = "registry string, id bigint"


# Operators on registry frames.

def assign_ids(requests: DataFrame, key: str, order_by: list[str | Column], last_id: int = 0) -> DataFrame:
    """Give new requests the ids after ``last_id``."""
    return number_rows(requests, order_by, key, last_id)


def list_requests(registry: DataFrame, key: str, id: int | None = None, group_id: str | None = None) -> DataFrame:
    """Requests with the given id and tenant; what is not given does not filter."""
    if id is not None:
        registry = registry.filter(F.col(key) == id)
    if group_id is not None:
        registry = registry.filter(F.col("GROUP_ID") == group_id)
    return registry


def page(registry: DataFrame, key: str, skip: int = 0, limit: int = PAGE_ROWS) -> DataFrame:
    """One page in the order of ids."""
    return registry.orderBy(key).offset(skip).limit(limit)


def page_after(registry: DataFrame, key: str, last: int | None = None, limit: int = PAGE_ROWS) -> DataFrame:
    """The page behind the id that the page before ended with; no task holds more than one page."""
    rest = registry if last is None else registry.filter(F.col(key) > last)
    return rest.orderBy(key).limit(limit)


def get_request(registry: DataFrame, key: str, id: int) -> DataFrame:
    return registry.filter(F.col(key) == id).limit(1)


def delete_request(registry: DataFrame, key: str, id: int) -> DataFrame:
    """Requests that stay; a request without the key stays too."""
    return registry.filter(~F.col(key).eqNullSafe(F.lit(id)))


def delete_requests(registry: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The same for many ids, held in the column of that name; children go by their foreign key."""
    return registry.join(ids.select(key).distinct(), key, "left_anti")


def update_request(registry: DataFrame, key: str, id: int, **fields) -> DataFrame:
    """Write the fields that carry a value into one request."""
    unknown = [f for f in fields if f not in registry.columns or f == key]
    if unknown:
        raise ValueError(f"fields {unknown} cannot be updated")
    given = {f: v for f, v in fields.items() if v}
    types = {f.name: f.dataType for f in registry.schema.fields}
    return registry.select(*[
        (F.when(F.col(key) == id, F.lit(given[c]).cast(types[c])).otherwise(F.col(c)).alias(c) if c in given else F.col(c))
        for c in registry.columns
    ])


def to_json(registry: DataFrame, path_columns: tuple[str, ...] = ("PATH_SHAPEFILE",)) -> Column:
    """JSON view of a request; paths are shown with forward slashes."""
    return F.to_json(F.struct(*[
        (F.translate(c, "\\", "/") if c in path_columns else F.col(c)).alias(c) for c in registry.columns
    ]), {"ignoreNullFields": "false"})


def load_uploads(loads: DataFrame) -> DataFrame:
    """The upload each load was made from, as its request says: ``FK_SHAPE, upload``."""
    return loads.select(F.col("ID_SHAPE").alias("FK_SHAPE"), F.get_json_object("REQUEST", "$.upload").cast("bigint").alias("upload"))


def execution_lineage(executions: DataFrame, models: DataFrame, loads: DataFrame, uploads: DataFrame) -> DataFrame:
    """Every execution with its model, and the upload of the load it read, where they exist."""
    m = models.select(F.col("ID_MODEL").alias("FK_MODEL"), F.col("STATUS").alias("model_status"))
    u = uploads.select(F.col("ID_SHAPE").alias("upload"), F.col("STATUS").alias("upload_status"), F.col("SHAPEFILE").alias("upload_file"))
    made_from = load_uploads(loads).join(u, "upload").drop("upload")
    return executions.join(m, "FK_MODEL", "left").join(made_from, "FK_SHAPE", "left")


def orphans(executions: DataFrame, models: DataFrame, loads: DataFrame) -> DataFrame:
    """Executions whose model or load is missing, with the reference that is broken.

    An execution of given text has no model, which is no broken reference.
    """
    m = models.select(F.col("ID_MODEL").alias("FK_MODEL"))
    u = loads.select(F.col("ID_SHAPE").alias("FK_SHAPE"))
    ids = executions.select("ID_EXECUTION", "FK_MODEL", "FK_SHAPE")
    return ids.where("FK_MODEL IS NOT NULL").join(m, "FK_MODEL", "left_anti").select("ID_EXECUTION", F.lit("FK_MODEL").alias("broken")).unionByName(
        ids.join(u, "FK_SHAPE", "left_anti").select("ID_EXECUTION", F.lit("FK_SHAPE").alias("broken")))


def execution_inputs(executions: DataFrame, loads: DataFrame) -> DataFrame:
    """Files an execution reads: those named by the load it refers to, each once.

    A file with a geometry column is a layer, whatever its format.
    """
    requested = loads.select(F.col("ID_SHAPE").alias("FK_SHAPE"), F.explode(from_json(F.col("REQUEST"), ["filename", "table", "tipo"])).alias("r"))
    shape = F.bool_or(F.coalesce(F.col("r.tipo").startswith("geometry"), F.lit(False)))
    files = requested.groupBy("FK_SHAPE", F.col("r.filename").alias("filename"), F.col("r.table").alias("table")).agg(shape.alias("shape"))
    return executions.select("ID_EXECUTION", "FK_SHAPE").join(files, "FK_SHAPE").select(
        "ID_EXECUTION", "filename", "table", F.when(F.col("shape"), "layer").otherwise("table").alias("kind"))


# Stored registries.

def create_registries(spark: SparkSession, schema: str) -> None:
    for table, ddl in [*((k.table, k.ddl) for k in KINDS), (OUTCOMES, OUTCOMES_DDL), (UPLOAD_FILES, UPLOAD_FILES_DDL), (RETIRED, RETIRED_DDL)]:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {quote_name(schema, table)} ({ddl}) USING parquet")


def stored(spark: SparkSession, schema: str, kind: Kind) -> DataFrame:
    return scan_table(spark, schema, kind.table)


def last_id(spark: SparkSession, schema: str, kind: Kind) -> int:
    """The largest id that was ever given."""
    retired = scan_table(spark, schema, RETIRED).filter(F.col("registry") == kind.table).select("id")
    return stored(spark, schema, kind).select(F.col(kind.key).alias("id")).union(retired).agg(F.max("id")).first()[0] or 0


def retire(ids: DataFrame, schema: str, kind: Kind) -> None:
    """Remember that ids in the column ``id`` were given."""
    ids.select(F.lit(kind.table).alias("registry"), F.col("id").cast("bigint").alias("id")).write.mode("append").insertInto(quote_name(schema, RETIRED))


def insert_request(spark: SparkSession, schema: str, kind: Kind, **fields) -> int:
    """Append one request and return its id. Dicts and lists of dicts are kept as JSON."""
    types = {f.name: f.dataType for f in kind.schema().fields}
    unknown = [f for f in fields if f not in types]
    if unknown:
        raise ValueError(f"{kind.table} has no fields {unknown}")
    new_id = last_id(spark, schema, kind) + 1
    values = {**fields, kind.key: new_id}
    row = tuple(
        json.dumps(values.get(c)) if isinstance(t, T.StringType) and isinstance(values.get(c), (dict, list))
        else values.get(c) for c, t in types.items()
    )
    spark.createDataFrame([row], kind.schema()).coalesce(1).write.mode("append").insertInto(quote_name(schema, kind.table))
    return new_id


def insert_requests(requests: DataFrame, schema: str, kind: Kind, order_by: list[str | Column]) -> None:
    """Append many requests."""
    spark = requests.sparkSession
    numbered = assign_ids(requests, kind.key, order_by, last_id(spark, schema, kind))
    numbered.select(*kind.schema().fieldNames()).write.mode("append").insertInto(quote_name(schema, kind.table))


def delete_stored(spark: SparkSession, schema: str, kind: Kind, id: int) -> None:
    """Delete one request; a model takes its executions along."""
    if kind is MODELS:
        executions = stored(spark, schema, EXECUTIONS)
        retire(executions.filter(F.col("FK_MODEL") == id).select(F.col(EXECUTIONS.key).alias("id")), schema, EXECUTIONS)
        swap_table(delete_request(executions, "FK_MODEL", id), schema, EXECUTIONS.table)
    retire(spark.range(1).select(F.lit(id).alias("id")), schema, kind)
    swap_table(delete_request(stored(spark, schema, kind), kind.key, id), schema, kind.table)


def update_stored(spark: SparkSession, schema: str, kind: Kind, id: int, **fields) -> None:
    swap_table(update_request(stored(spark, schema, kind), kind.key, id, **fields), schema, kind.table)
