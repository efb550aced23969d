"""Which upload owns which files, and deleting the files that no other upload owns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraload.functions.names import quote_name
from terraload.operators import registry
from terraload.runtime import ship_modules, stage
from terraload.sources import files
from terraload.sources.tables import scan_table


def record_files(owned: DataFrame, schema: str) -> None:
    """Note that uploads own files: ``owned`` has the columns ``ID_SHAPE`` and ``path``, side-cars included."""
    owned.select(F.col("ID_SHAPE").cast("bigint").alias("ID_SHAPE"), F.col("path"), F.lit(False).alias("released")).filter(
        "path IS NOT NULL").write.mode("append").insertInto(quote_name(schema, registry.UPLOAD_FILES))


def owned_files(spark: SparkSession, schema: str) -> DataFrame:
    """``ID_SHAPE, path`` of the registered uploads whose files were not deleted; paths that only their row lists count, too."""
    noted = scan_table(spark, schema, registry.UPLOAD_FILES)
    uploads = registry.stored(spark, schema, registry.UPLOADS)
    listed = uploads.select("ID_SHAPE", F.explode("USERFILE").alias("path")).filter("path IS NOT NULL")
    here = noted.filter("NOT released").select("ID_SHAPE", "path").join(uploads.select("ID_SHAPE"), "ID_SHAPE", "left_semi")
    return here.unionByName(listed).join(noted.filter("released").select("ID_SHAPE"), "ID_SHAPE", "left_anti")


def _folder(path: str) -> Column:
    """A folder's path without the slash at its end; null for none and for the root."""
    return F.nullif(F.rtrim(F.col(path), F.lit("/")), F.lit(""))


def _folders_above(path: str) -> Column:
    """Every folder that a file lies in, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _in_tasks(df: DataFrame, delete) -> int:
    """Call ``delete`` for each path of the only column, spread over tasks; a task that runs twice does no harm."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                n += delete(path)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    # A given number of partitions: deleting takes time, not bytes, and is not to be packed into few tasks.
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)
    return spread.mapInArrow(task, "n long").agg(F.sum("n")).first()[0] or 0


def remove_files(spark: SparkSession, schema: str, ids: DataFrame) -> tuple[int, int]:
    """Delete the files of the uploads in the column ``ID_SHAPE``; returns the numbers of files and folders deleted.

    A file goes when it lies in its upload's folder and no upload that stays owns it; a folder goes when nothing of an
    upload that stays lies in it, or is in its turn the folder of one. Unknown and null ids delete nothing, repeated ones count once, files
    that are gone already are passed over, so a call that was cut off can be made again. The rows of the uploads stay in the registry.
    """
    ship_modules(spark)
    ids = ids.select(F.col("ID_SHAPE").cast("bigint").alias("ID_SHAPE")).distinct()
    owned = owned_files(spark, schema)
    uploads = registry.stored(spark, schema, registry.UPLOADS).select("ID_SHAPE", _folder("PATH_SHAPEFILE").alias("folder"))
    released = scan_table(spark, schema, registry.UPLOAD_FILES).filter("released").select("ID_SHAPE")
    living = uploads.join(released, "ID_SHAPE", "left_anti")
    # What is decided is written before anything is deleted.
    going = stage(living.join(ids, "ID_SHAPE", "left_semi").filter("folder IS NOT NULL"), "uploads-going")
    kept = owned.join(ids, "ID_SHAPE", "left_anti").select("path")
    inside = owned.join(going, "ID_SHAPE").filter(F.col("path").startswith(F.concat("folder", F.lit("/"))))
    doomed = stage(inside.select("path").distinct().join(kept, "path", "left_anti"), "files-going")
    others = living.join(ids, "ID_SHAPE", "left_anti").select(F.explode(F.array_append(_folders_above("folder"), F.col("folder"))).alias("folder"))
    used = kept.select(F.explode(_folders_above("path")).alias("folder")).unionByName(others).distinct()
    empty = stage(going.select("folder").distinct().join(used, "folder", "left_anti"), "folders-going")
    n_files, n_folders = _in_tasks(doomed, files.delete_file), _in_tasks(empty, files.delete_folder)
    going.select("ID_SHAPE", F.lit(None).cast("string").alias("path"), F.lit(True).alias("released")).write.mode("append").insertInto(
        quote_name(schema, registry.UPLOAD_FILES))
    return n_files, n_folders
