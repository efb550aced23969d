"""Upload and load: archive → manifest → typed tables → layers."""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from terraload.functions.geometry import LOST_GEOMETRY, geometry_columns, is_layer_schema, requested_srid, set_srid
from terraload.functions.digest import folder_digest
from terraload.functions.names import base_name, clean_name, quote_name, tag_tenant
from terraload.operators import manifest as manifests
from terraload.operators import ownership, registry, reports
from terraload.operators.sinks import DEFAULT_KEY, TENANT, drop_table, load_table, partition_columns, swap_table
from terraload.plans import batches
from terraload.plans.publish import publish_layers, remove_layers
from terraload.runtime import ship_modules, stage
from terraload.sources import archive, dbf, delimited, shapefile, xlsx
from terraload.sources.tables import create_schema, scan_table, table_exists

# Spark jobs in flight at once; each is spread over the cluster by itself.
JOBS_AT_ONCE = 8


@dataclass(frozen=True)
class Part:
    """One table a file holds: a workbook holds one per sheet, other files one."""

    table: str
    frame: DataFrame


def read_file(spark: SparkSession, path: str, format: str, table: str, group_id: str | None = None,
              srid: int | None = None, infer: bool = True, labels: dict[str, str] | None = None) -> list[Part]:
    """Tables of one file. Without ``infer`` text files keep text columns and are not read for their types;
    ``labels`` say which numbers of a DBF file have fractions."""
    if format == "csv":
        return [Part(table, delimited.read_delimited(spark, path, group_id, None if infer else {}))]
    if format == "dbf":
        return [Part(table, dbf.read_dbf(spark, path, group_id, labels=labels))]
    if format == "shapefile":
        layer = shapefile.read_shapefile(spark, path, group_id, srid)
        if not shapefile.has_geometry(layer):
            raise ValueError("no row has a geometry")
        return [Part(table, layer)]
    if format == "excel":
        if path.endswith(".xls"):
            raise ValueError("binary .xls workbooks cannot be read; save the file as .xlsx")
        return [Part(xlsx.sheet_table_name(table, s), t) for s, t in xlsx.read_xlsx(spark, path, group_id).items()]
    raise ValueError(f"unknown format {format!r}")


def _message(error: Exception) -> str:
    return str(error).strip() or type(error).__name__


def _describe_file(spark, row, group_id: str) -> list[tuple]:
    try:
        found = [manifests.describe_rows(p.frame.drop(LOST_GEOMETRY), row["filename"], p.table, group_id)
                 for p in read_file(spark, row["path"], row["format"], row["table"], group_id)]
        if not found:
            raise ValueError("the workbook is empty")
        return [r for rows in found for r in rows]
    except Exception as error:  # noqa: BLE001 - one bad file must not stop the others
        return [manifests.error_row(row["filename"], group_id, _message(error))]


def listed_files(found: DataFrame) -> list[Row]:
    """An inventory as rows of the driver, one per file."""
    return found.select("path", "filename", "format", "table").orderBy("path").collect()


def build_manifest(spark: SparkSession, listed: list[Row], group_id: str) -> DataFrame:
    """Manifest of listed files; a file that fails gives an error row.

    Delimited files that are no layers are described together, in as many jobs for very many as for a few; other
    files one by one, a row for each of their columns passing through the driver. The files' data stays with the executors.
    """
    if not listed:
        raise ValueError("no readable file was found")
    texts, errors, left = batches.describe_texts(spark, [r for r in listed if r["format"] == "csv"], group_id)
    single = [r for r in listed if r["format"] != "csv"] + left
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        described = list(pool.map(lambda row: _describe_file(spark, row, group_id), single))
    others = manifests.from_rows(spark, [*errors, *(r for rows in described for r in rows)])
    return others if texts is None else texts.unionByName(others)


def upload_digest(spark: SparkSession, path: str) -> str:
    """Digest of an archive, or one digest of a folder of archives."""
    found = archive.content_md5(spark, path).withColumn("path", base_name(F.col("path")))
    both = folder_digest(found.withColumn("root", F.lit(path)), ["root"]).join(
        found.select(F.lit(path).alias("root"), "md5").groupBy("root").agg(F.min("md5").alias("md5")), "root")
    row = both.first()
    return row["md5"] if row["n_files"] == 1 else row["digest"]


def analyze_archive(spark: SparkSession, registry_schema: str, group_id: str, path: str, target: str) -> tuple[int, DataFrame]:
    """Unpack an archive (or a folder of them), describe its files, record the upload.

    Returns the upload's id and the manifest.
    """
    ship_modules(spark)
    # A folder of its own, so that deleting the upload cannot touch another one's files.
    target = f"{target.rstrip('/')}/upload-{uuid.uuid4().hex}"
    entries = stage(archive.extract_archives(spark, path, target), "entries")
    listed = listed_files(archive.exclude_sidecars(archive.inventory(entries.select("path"))))
    manifest = build_manifest(spark, listed, group_id)
    digest = upload_digest(spark, path)
    request = [r.asDict() for r in manifest.orderBy("filename", "table", "position").collect()]
    upload = registry.insert_request(
        spark, registry_schema, registry.UPLOADS, SHAPEFILE=path.rsplit("/", 1)[-1], DATE_UPLOAD=datetime.datetime.now(),
        STATUS="UPLOAD ZIP", GROUP_ID=group_id, PATH_SHAPEFILE=target, MD5=digest, USERFILE=[f["path"] for f in listed],
        RESPONSE=json.dumps({"data": request}))
    ownership.record_files(entries.select(F.lit(upload).alias("ID_SHAPE"), "path"), registry_schema)
    return upload, manifest


def prepare(frame: DataFrame, spec: Sequence, group_id: str, srid: int | None) -> tuple[DataFrame, list[Observation]]:
    """A file's table as the manifest wants it: projected, renamed, cast, with tenant and reference system.

    The observations count what casts lose, and texts that give no geometry, while the table is written.
    """
    shapes_lost = F.count_if(F.col(LOST_GEOMETRY)) if LOST_GEOMETRY in frame.columns else F.count_if(F.lit(False))
    lost_shapes = Observation()
    projected = manifests.project_importing(frame.observe(lost_shapes, shapes_lost.alias("n_lost")), spec)
    lost = Observation()
    counted = projected.observe(lost, manifests.lost_values(projected, spec).alias("n_lost"))
    table = manifests.cast_by_manifest(counted, spec)
    for shape in geometry_columns(table.schema):
        table = table.withColumn(shape, set_srid(F.col(quote_name(shape)), srid))
    return tag_tenant(table, group_id), [lost, lost_shapes]


@dataclass
class Outcome:
    """What became of one table of a load."""

    table: str
    filename: str
    ok: bool
    elapsed: float
    have_geom: bool
    n_lost: int = 0
    error: str | None = None
    mode: str | None = None


OUTCOME_SCHEMA = ("table string, filename string, ok boolean, elapsed double, have_geom boolean, n_lost long, error string, "
                  "mode string")


def _load_file(spark, row, spec_by_table, group_id, schema, srid, mode, key, partition_by) -> list[Outcome]:
    started = time.monotonic()
    outcomes: list[Outcome] = []
    try:
        # The manifest knows text files' types, so they are read once.
        labels = {r["column"]: r["tipo"] for rows in spec_by_table.values() for r in rows}
        for part in read_file(spark, row["path"], row["format"], row["table"], group_id, srid, infer=False, labels=labels):
            if part.table not in spec_by_table:
                continue
            table, lost = prepare(part.frame, spec_by_table[part.table], group_id, srid)
            used = load_table(table, schema, part.table, mode, key, partition_by)
            elapsed = time.monotonic() - started
            outcomes.append(Outcome(
                part.table, row["filename"], True, elapsed, is_layer_schema(table.schema), sum(o.get["n_lost"] or 0 for o in lost), None, used))
    except Exception as error:  # noqa: BLE001 - one bad file must not stop the others
        shape = row["format"] == "shapefile"
        outcomes.append(Outcome(row["table"], row["filename"], False, time.monotonic() - started, shape, 0, _message(error)))
    return outcomes


def load_batch(spark: SparkSession, registry_schema: str, upload_id: int, group_id: str, manifest: DataFrame,
               schema: str = "public", srid: str | int | None = "auto", mode: str = "replace",
               key: Sequence[str] = DEFAULT_KEY, skip_existing: bool = False, partition_by: Sequence[str] = (),
               schema_location: str | None = None) -> tuple[int, DataFrame, dict]:
    """Load the files a manifest asks for; returns the load's id, its outcomes and a summary.

    Large shared tables want ``partition_by=["group_id"]`` with ``group_id`` in the key: an
    append then rewrites the tenant's partition only.
    """
    ship_modules(spark)
    started = time.monotonic()
    override = requested_srid(srid)
    target = clean_name(schema, reserved=())
    create_schema(spark, target, schema_location)
    wanted = manifests.importing_rows(manifests.normalize(manifest))
    rows = wanted.withColumn("schema_name", F.lit(target)).collect()
    load = registry.insert_request(
        spark, registry_schema, registry.LOADS, DATE_LOAD=datetime.datetime.now(), STATUS="LOAD SHAPEFILE",
        GROUP_ID=group_id, REQUEST=json.dumps({"data": [r.asDict() for r in rows], "upload": upload_id}))
    upload = registry.get_request(
        registry.stored(spark, registry_schema, registry.UPLOADS), registry.UPLOADS.key, upload_id)
    found = archive.inventory(upload.select(F.explode("USERFILE").alias("path")))
    chosen = manifests.requested_files(found, wanted).orderBy("path").collect()

    by_file: dict[str, dict[str, list]] = {}
    for r in rows:
        by_file.setdefault(r["filename"], {}).setdefault(r["table"], []).append(r)
    duplicated = []
    if skip_existing:
        existing = spark.sql(f"SHOW TABLES IN {quote_name(target)}").select(F.col("tableName").alias("table"))
        asked = wanted.select("filename", F.lower("table").alias("table")).distinct()
        open_ = {r["filename"] for r in reports.skip_loaded(asked, existing).select("filename").distinct().collect()}
        duplicated = [f["filename"] for f in chosen if f["filename"] not in open_]
        chosen = [f for f in chosen if f["filename"] in open_]

    # Two files must not write one table at the same time: the first one has it.
    outcomes, owner, single = [], {}, []
    for f in chosen:
        taken = [t for t in by_file[f["filename"]] if owner.setdefault(t, f["path"]) != f["path"]]
        if taken:
            message = f"table {taken[0]} is loaded from {owner[taken[0]]}"
            outcomes.append(Outcome(f["table"], f["filename"], False, 0.0, False, 0, message))
        else:
            single.append(f)
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        jobs = [pool.submit(_load_file, spark, f, by_file[f["filename"]], group_id, target, override, mode, key, partition_by)
                for f in single]
        outcomes = [o for job in jobs for o in job.result()] + outcomes
    report = spark.createDataFrame([tuple(vars(o).values()) for o in outcomes], OUTCOME_SCHEMA)
    layers = [r["table"] for r in reports.publishable_layers(report).orderBy("table").collect()] if outcomes else []
    if layers:
        publish_layers(spark, registry_schema, group_id, layers)
    summary = {
        "loaded": {o.table: o.filename for o in outcomes if o.ok},
        "errors": {o.filename: o.error for o in outcomes if not o.ok},
        "layers": layers,
        "lost_values": {o.table: o.n_lost for o in outcomes if o.n_lost},
        "source_duplicated": duplicated,
        "elapsed": time.monotonic() - started,
    }
    record_outcomes(report, registry_schema, load, group_id, target)
    return load, report, summary


def record_outcomes(report: DataFrame, registry_schema: str, load_id: int, group_id: str, schema: str) -> None:
    """Keep what a load wrote; deleting it and running models on it go by this, not by the request."""
    report.select(F.lit(load_id).cast("bigint").alias("ID_SHAPE"), F.lit(group_id).alias("GROUP_ID"), F.lit(schema).alias("schema_name"),
                  "table", "filename", "mode", "ok", "have_geom").write.mode("append").insertInto(quote_name(registry_schema, registry.OUTCOMES))


def delete_load(spark: SparkSession, registry_schema: str, load_id: int) -> list[str]:
    """Delete what a load wrote, its upload's files and its registry row; returns the tables dropped.

    A table that another load wrote, too, stays. If those loads are other tenants', this tenant's
    rows and layer go from it; if one is the tenant's own, its rows cannot be told apart and stay. Files stay as
    long as another load was made from the same upload.
    """
    loads = registry.stored(spark, registry_schema, registry.LOADS)
    upload = F.get_json_object("REQUEST", "$.upload").cast("bigint").alias("upload")
    request = registry.get_request(loads, registry.LOADS.key, load_id).select("GROUP_ID", upload).first()
    if request is None:
        raise KeyError(f"no load {load_id}")
    tenant = request["GROUP_ID"]
    outcomes = scan_table(spark, registry_schema, registry.OUTCOMES)
    written = outcomes.filter("ok").select("ID_SHAPE", "GROUP_ID", "schema_name", "table")
    mine = written.filter(F.col("ID_SHAPE") == load_id).select("schema_name", "table").distinct()
    others = written.filter(F.col("ID_SHAPE") != load_id).groupBy("schema_name", "table").agg(
        F.bool_or(F.col("GROUP_ID").eqNullSafe(F.lit(tenant))).alias("own"))
    # A row for each table of one load.
    tables = mine.join(others, ["schema_name", "table"], "left").collect()
    dropped, gone = [], []
    for r in tables:
        schema, table = r["schema_name"], r["table"]
        if r["own"] is None:
            drop_table(spark, schema, table)
            dropped.append(table)
        elif not r["own"] and table_exists(spark, schema, table):
            rows = scan_table(spark, schema, table)
            if TENANT in rows.columns:
                swap_table(rows.filter(~F.col(TENANT).eqNullSafe(F.lit(tenant))), schema, table, 0, partition_columns(spark, schema, table))
        if not r["own"]:
            gone.append(table)
    if gone:
        remove_layers(spark, registry_schema, tenant, gone)
    if request["upload"] is not None:
        rest = loads.filter(F.col(registry.LOADS.key) != load_id).select(upload).filter(F.col("upload") == request["upload"])
        if rest.isEmpty():
            remove_upload_files(spark, registry_schema, request["upload"])
    swap_table(registry.delete_request(outcomes, "ID_SHAPE", load_id), registry_schema, registry.OUTCOMES)
    registry.delete_stored(spark, registry_schema, registry.LOADS, load_id)
    return sorted(dropped)


def remove_upload_files(spark: SparkSession, registry_schema: str, upload_id: int) -> None:
    """Delete the folder an upload was unpacked into; where it holds files of another upload, only what this one alone owns."""
    ownership.remove_files(spark, registry_schema, spark.range(upload_id, upload_id + 1).toDF("ID_SHAPE"))
