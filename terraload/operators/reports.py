"""Which files to load, and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraload.functions import names


def file_map(uploads: DataFrame) -> DataFrame:
    """Table name and path of every file of every upload."""
    return uploads.select("ID_SHAPE", F.explode("USERFILE").alias("path")).select(
        "ID_SHAPE", "path", names.base_name(F.col("path")).alias("filename"), names.table_name(F.col("path")).alias("table"))


def skip_loaded(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Files whose table is not stored yet."""
    return files.join(existing.select("table").distinct(), "table", "left_anti")


def already_loaded(files: DataFrame, existing: DataFrame) -> DataFrame:
    """The others, reported as duplicates."""
    return files.join(existing.select("table").distinct(), "table", "left_semi")


def load_report(results: DataFrame, files: DataFrame) -> DataFrame:
    """Per table: path, whether every part went well, elapsed seconds, failed parts.

    Results are summed before they meet the file map, so a table with many results stays small.
    """
    summed = results.groupBy("table").agg(
        F.bool_and("ok").alias("ok"),
        F.sum("elapsed").alias("elapsed"),
        F.bool_or("have_geom").alias("have_geom"),
        F.count_if(~F.col("ok")).alias("n_errors"),
    )
    return summed.join(files.select("table", "path"), "table").select(
        "table", "path", F.when(F.col("ok"), F.lit("OK")).otherwise(F.lit("Error")).alias("status"),
        "elapsed", "have_geom", "n_errors")


def publishable_layers(results: DataFrame) -> DataFrame:
    """Layers none of whose results is an error."""
    layers = results.filter("have_geom").select("table").distinct()
    return layers.join(results.filter(~F.col("ok")).select("table").distinct(), "table", "left_anti")


def duplicate_uploads(uploads: DataFrame) -> DataFrame:
    """Digests that were uploaded more than once, with the first request."""
    return uploads.groupBy("MD5").agg(
        F.count(F.lit(1)).alias("n_uploads"), F.min("ID_SHAPE").alias("first_id")).filter("n_uploads > 1")
