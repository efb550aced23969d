"""Session facts that several modules need: the shared work folder and worker imports."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from terraload.sources.files import publish_file

_local_work_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship_modules(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; they need no install."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    bundle = f"{new_path(spark, 'modules')}/terraload.zip"
    with publish_file(bundle) as out, zipfile.ZipFile(out, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(bundle)
    _shipped.add(app)


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_work_dirs:
        _local_work_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_work_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the work folder that nobody used before."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: later jobs see the same rows even when executors are lost.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
