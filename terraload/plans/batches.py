"""Many files at once: those with one header are described in one job, with the file's path as a column."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from terraload.functions import types
from terraload.functions.geometry import is_layer_header
from terraload.operators import manifest as manifests
from terraload.runtime import stage
from terraload.sources import delimited, files

PATH = "_path"


def sizes_of(spark: SparkSession, paths: Sequence[str]) -> dict[str, int | None]:
    """Bytes of each file, None where there is none; asked in tasks."""
    def look(batches):
        for batch in batches:
            sizes = [files.file_size(p) for p in batch.column("path").to_pylist()]
            yield batch.append_column("size", pa.array(sizes, pa.int64()))

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r["path"]: r["size"] for r in listed.mapInArrow(look, "path string, size long").collect()}


def describe_texts(spark: SparkSession, listed: Sequence[Row], group_id: str) -> tuple[DataFrame | None, list[tuple], list[Row]]:
    """Manifest of delimited files; rows of those that cannot be read; files left, whose headers make them layers.

    However many files there are, their headers are read in one job and all types found in one. The driver gets a
    row for each file and each header; the manifest stays a table.
    """
    by_path = {r["path"]: r for r in listed}
    sizes = sizes_of(spark, list(by_path))
    errors = [manifests.error_row(by_path[p]["filename"], group_id, f"{p} is empty" if n == 0 else f"{p} cannot be read") for p, n in sizes.items() if not n]
    found, left = None, []
    for header, paths in delimited.group_by_header(spark, [p for p, n in sizes.items() if n]):
        try:
            dialect = delimited.sniff_header(header, paths[0])
        except Exception as error:  # noqa: BLE001 - files of one header fail together and stop no others
            errors += [manifests.error_row(by_path[p]["filename"], group_id, str(error)) for p in paths]
            continue
        if is_layer_header(dialect.columns):
            left += [by_path[p] for p in paths]
            continue
        text = delimited.text_of_files(spark, [(p, sizes[p]) for p in paths], dialect, PATH)
        kinds = types.infer_types(text, dialect.columns, dates=False, by=[PATH]).select(PATH, "ordinal", "tipo")
        # A file without rows has its columns all the same.
        names = spark.createDataFrame([(p, by_path[p]["filename"], by_path[p]["table"]) for p in paths], f"{PATH} string, filename string, table string")
        tagged = [*dialect.columns, *([] if "group_id" in dialect.columns else ["group_id"])]
        wide = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(c).alias("column")) for k, c in enumerate(tagged)])
        rows = names.select(PATH, "filename", "table", F.inline(wide)).join(kinds, [PATH, "ordinal"], "left")
        tipo = F.when(F.col("column") == "group_id", "text").otherwise(F.coalesce("tipo", types.label_of_kinds(F.lit(None).cast("int"))))
        rows = rows.select(
            "filename", F.lit(group_id).alias("schema_name"), "table", "column", tipo.alias("tipo"), F.col("column").alias("column_name"),
            F.lit(True).alias("importing"), F.lit(False).alias("isVariable"), F.lit(0).alias("srid"), F.lit(False).alias("df_out"), F.col("ordinal").cast("long").alias("position"))
        found = rows if found is None else found.unionByName(rows)
    return None if found is None else stage(found, "manifest"), errors, left
