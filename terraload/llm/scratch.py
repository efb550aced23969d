"""Intermediate tables in the shared folder, deleted when used up."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute known
from pyspark.sql import DataFrame, SparkSession

from terraload.runtime import new_path


class Scratch:
    """Tables written once and read many times, which cuts lineage and survives lost executors.

    ``keep`` writes a table below ``spark.checkpoint.dir`` and reads it back; ``drop`` deletes
    tables that nothing will read again. A table behind a returned DataFrame must stay.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str) -> str:
        return new_path(self.spark, f"{self.label}-{name}")

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path, compression=compression)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if (found := self._paths.pop(id(df), None)) is not None:
                delete(self.spark, found[1])


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on any storage that Spark writes to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession, mega_bytes: int = 4, rows: int = 10000) -> None:
    """Let Arrow batches of this session hold about so many bytes, however long its texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mega_bytes << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", mega_bytes: int = 4) -> Iterator[pa.RecordBatch]:
    """Cut batches so that texts of a piece hold about so many bytes; a longer text is a piece of its own."""
    for batch in batches:
        at, held = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > mega_bytes << 20:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if batch.num_rows > at:
            yield batch.slice(at)
