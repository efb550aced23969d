"""Manifests: one row per column of every file, edited by users, then obeyed by loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraload.functions import types
from terraload.functions.geometry import geometry_columns, geometry_label, layer_summary
from terraload.functions.names import quote_name

MANIFEST_SCHEMA = (
    "filename string, schema_name string, table string, column string, tipo string, column_name string, "
    "importing boolean, isVariable boolean, srid int, df_out boolean, position long"
)
ERROR_COLUMN = "Error"


def normalize(manifest: DataFrame) -> DataFrame:
    """Fill the fields a user may leave out; without ``position`` rows count in the order they are read."""
    have = set(manifest.columns)
    defaults = {
        "schema_name": F.lit("public"), "importing": F.lit(True), "isVariable": F.lit(False),
        "srid": F.lit(0), "df_out": F.lit(False), "column_name": F.col("column"), "position": F.monotonically_increasing_id(),
    }
    wanted = [part.split()[0] for part in MANIFEST_SCHEMA.split(", ")]
    return manifest.select(*[
        F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults and c in have
        else (defaults[c].alias(c) if c not in have else F.col(c)) for c in wanted
    ])


def describe_rows(df: DataFrame, filename: str, table: str, schema_name: str) -> list[tuple]:
    """Manifest rows of one table; a layer is summarised in one pass over its data."""
    shapes = geometry_columns(df.schema)
    found, srid = {}, 0
    for shape in shapes:
        summary = layer_summary(df, shape).select(
            geometry_label(F.col("gtype"), F.coalesce("has_z", F.lit(False)), F.coalesce("srid", F.lit(0))).alias("label"),
            "srid").first()
        if summary["label"] is None:
            raise ValueError("no row has a geometry")
        found[shape], srid = summary["label"], summary["srid"] or 0
    columns = df.columns + ([] if "group_id" in df.columns else ["group_id"])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for i, name in enumerate(columns):
        label = found.get(name)
        if label is None:
            label = types.type_label(kinds[name]) if name in kinds else "text"
        rows.append((filename, schema_name, table, name, label, name, True, False, srid, False, i))
    return rows


def error_row(filename: str, schema_name: str, message: str) -> tuple:
    """What the manifest says of a file that cannot be read."""
    return (filename, schema_name, f"Error {message}", ERROR_COLUMN, "Text", ERROR_COLUMN, False, False, 0, False, 0)


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, MANIFEST_SCHEMA)


def importing_rows(manifest: DataFrame) -> DataFrame:
    """Rows of columns that are to be loaded."""
    return manifest.filter(F.col("importing") & (F.col("column") != F.col("filename")))


def manifest_by_file(manifest: DataFrame) -> DataFrame:
    """Kept columns of each file in order; a group is as long as a table is wide."""
    kept = importing_rows(manifest)
    return kept.groupBy("filename").agg(
        F.sort_array(F.collect_list(F.struct("position", "column", "column_name", "tipo"))).alias("columns"))


def spec_lookup(manifest: DataFrame) -> DataFrame:
    """One row per table and target column; the last one given wins."""
    fields = [c for c in manifest.columns if c not in ("table", "column_name")]
    last = F.max_by(F.struct(*fields), F.col("position")).alias("last")
    return manifest.groupBy("table", "column_name").agg(last).select("table", "column_name", "last.*")


def requested_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of which the manifest still wants a column."""
    wanted = importing_rows(manifest).select("filename").distinct()
    return files.join(wanted, "filename", "left_semi")


def render_ddl(manifest: DataFrame) -> DataFrame:
    """Column list ``name type, …`` per table."""
    part = F.concat_ws(" ", "column_name", "tipo").alias("part")
    ordered = F.sort_array(F.collect_list(F.struct("position", part)))
    return importing_rows(manifest).groupBy("table").agg(
        F.concat_ws(", ", F.transform(ordered, lambda p: p["part"])).alias("ddl"))


def project_importing(df: DataFrame, spec: Sequence) -> DataFrame:
    """Kept columns under their target names, in manifest order; of two for one target the last wins."""
    have = set(df.columns)
    ordered = sorted(spec, key=lambda r: r["position"])
    kept = {r["column_name"]: r["column"] for r in ordered if r["importing"] and r["column"] in have}
    return df.select(*[F.col(quote_name(column)).alias(target) for target, column in kept.items()])


def cast_targets(df: DataFrame, spec: Sequence) -> dict[str, str]:
    """Columns whose label differs from the wanted one, with the Spark type wanted."""
    shapes = set(geometry_columns(df.schema))
    found = {f.name: f.dataType for f in df.schema.fields if f.name not in shapes}
    wanted = {r["column_name"]: r["tipo"] for r in sorted(spec, key=lambda r: r["position"])}
    targets = {}
    for name, label in wanted.items():
        if name in found and not label.startswith("geometry") and types.type_label(found[name]) != label.lower():
            targets[name] = types.spark_type(label)
    return targets


def _cast(df: DataFrame, column: str, target: str) -> Column:
    return types.cast_value(F.col(quote_name(column)), df.schema[column].dataType, target)


def cast_by_manifest(df: DataFrame, spec: Sequence) -> DataFrame:
    """Columns in the types the manifest asks for; values that do not fit become null."""
    targets = cast_targets(df, spec)
    return df.select(*[
        _cast(df, c, targets[c]).alias(c) if c in targets else F.col(quote_name(c)) for c in df.columns
    ])


def _lost(df: DataFrame, column: str, target: str) -> Column:
    return F.count_if(F.col(quote_name(column)).isNotNull() & _cast(df, column, target).isNull())


def lost_values(df: DataFrame, spec: Sequence) -> Column:
    """Aggregate that counts the values all casts of a manifest lose."""
    total = F.lit(0).cast("bigint")
    for column, target in cast_targets(df, spec).items():
        total = total + _lost(df, column, target)
    return total + F.count_if(F.lit(False))


def cast_errors(df: DataFrame, spec: Sequence) -> DataFrame:
    """``(column, n_errors)``: values a cast would lose, counted in one pass."""
    targets = cast_targets(df, spec)
    if not targets:
        return df.sparkSession.createDataFrame([], "column string, n_errors long")
    rows = [F.struct(F.lit(c).alias("column"), _lost(df, c, t).alias("n_errors")) for c, t in targets.items()]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def to_json(manifest: DataFrame) -> DataFrame:
    """JSON text per file; a file's rows are as many as its columns."""
    fields = [c for c in manifest.columns if c != "filename"]
    rows = F.sort_array(F.collect_list(F.struct("position", *[c for c in fields if c != "position"])))
    return manifest.groupBy("filename").agg(F.to_json(rows).alias("json"))


def from_json(text: Column, fields: Sequence[str] | None = None) -> Column:
    """Rows (or some fields) of a manifest kept as JSON ``{"data": […]}``."""
    kept = [f.split() for f in MANIFEST_SCHEMA.split(", ") if fields is None or f.split()[0] in fields]
    return F.from_json(text, "data array<struct<" + ", ".join(f"{n}:{t}" for n, t in kept) + ">>")["data"]
