"""Writing tables: replace, keyed upsert, batches."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraload.constants import LOAD_MODES
from terraload.functions.names import quote_name
from terraload.sources.tables import scan_table, table_exists

DEFAULT_KEY = ("id",)
TENANT = "group_id"
# Rows of both sides that one task of an upsert joins.
ROWS_PER_TASK = 500_000


class DuplicateKeyError(ValueError):
    """A batch holds a key twice, so it is not clear which row should win."""


def passing_name() -> str:
    """A table name that nobody else has."""
    return f"passing_{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, schema: str, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quote_name(schema, table)}")


def _write_new(df: DataFrame, schema: str, table: str, max_records_per_file: int | None = None) -> None:
    """Write a table that is not there yet; after a failure nothing of it is left."""
    writer = df.write.mode("errorifexists")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    try:
        writer.saveAsTable(quote_name(schema, table))
    except Exception:
        drop_table(df.sparkSession, schema, table)
        raise


def _rename(spark: SparkSession, schema: str, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {quote_name(schema, old)} RENAME TO {quote_name(schema, new)}")


def _put_in_place(spark: SparkSession, schema: str, passing: str, table: str) -> None:
    """Give a written table its name; the old table goes when that has worked."""
    if not table_exists(spark, schema, table):
        _rename(spark, schema, passing, table)
        return
    old = passing_name()
    _rename(spark, schema, table, old)
    try:
        _rename(spark, schema, passing, table)
    except Exception:
        _rename(spark, schema, old, table)
        raise
    drop_table(spark, schema, old)


def _rewrite(spark: SparkSession, schema: str, passing: str, table: str, partition_by: Sequence[str]) -> None:
    """Write a partitioned table anew from a passing one.

    Not every catalog moves partitions along when a table is renamed. Rows that cannot be computed have
    failed before; if this write fails, the passing table stays, and the error names it.
    """
    rows = scan_table(spark, schema, passing)
    try:
        rows = rows.hint("rebalance", *[F.col(quote_name(c)) for c in partition_by])
        rows.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(quote_name(schema, table))
    except Exception as error:
        raise RuntimeError(f"{schema}.{table} could not be written; its rows are in {schema}.{passing}") from error
    drop_table(spark, schema, passing)


def replace_table(df: DataFrame, schema: str, table: str, partition_by: Sequence[str] = (),
                  max_records_per_file: int | None = None) -> None:
    """Make the table anew from ``df``; until all rows are computed the old one stays."""
    spark = df.sparkSession
    passing = passing_name()
    _write_new(df, schema, passing, max_records_per_file=max_records_per_file)
    if partition_by:
        _rewrite(spark, schema, passing, table, partition_by)
    else:
        _put_in_place(spark, schema, passing, table)


def swap_table(df: DataFrame, schema: str, table: str, at_least: int = 0, partition_by: Sequence[str] = ()) -> None:
    """Replace a table by rows that may be read from it.

    The rows are written beside it and take its place when their number is right; after a failure
    the old table is still there.
    """
    spark = df.sparkSession
    passing = passing_name()
    _write_new(df, schema, passing)
    written = scan_table(spark, schema, passing).count()
    if written < at_least:
        drop_table(spark, schema, passing)
        raise RuntimeError(f"{written} rows were written for {schema}.{table}, {at_least} were expected")
    if partition_by:
        _rewrite(spark, schema, passing, table, partition_by)
    else:
        _put_in_place(spark, schema, passing, table)


def _has_key(df: DataFrame, key: Sequence[str]):
    condition = F.lit(True)
    for k in key:
        condition = condition & F.col(quote_name(k)).isNotNull()
    return condition


def check_unique(incoming: DataFrame, key: Sequence[str]) -> None:
    """Raise when a key occurs twice; rows without key do not count."""
    twice = (
        incoming.filter(_has_key(incoming, key)).groupBy(*[F.col(quote_name(k)) for k in key])
        .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    )
    found = twice.first()
    if found is not None:
        raise DuplicateKeyError(f"the batch holds the key {found.asDict()} more than once")


def upsert(target: DataFrame, incoming: DataFrame, key: Sequence[str] = DEFAULT_KEY) -> DataFrame:
    """Target rows with matching batch rows written over them, plus the batch's new rows.

    An incoming null overwrites, columns the batch lacks keep their values, rows without key
    never match. Each batch key is unique, so the target side of the join may be skewed at
    will: it is a left join, which Spark splits by itself, and a small batch is broadcast.
    """
    unknown = [c for c in incoming.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"the table has no columns {unknown}")
    given = [c for c in incoming.columns if c not in key]
    keyed = incoming.filter(_has_key(incoming, key))
    batch = keyed.select(*[F.col(quote_name(k)).alias(f"_key{i}") for i, k in enumerate(key)],
                         F.struct(*[F.col(quote_name(c)) for c in given], F.lit(True).alias("_hit")).alias("_new"))
    old = target.filter(_has_key(target, key))
    match = [F.col(quote_name(k)) == F.col(f"_key{i}") for i, k in enumerate(key)]
    written = old.join(batch, match, "left").select(*[
        (F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(quote_name(c))).alias(c)
         if c in given else F.col(quote_name(c))) for c in target.columns
    ])
    untouched = target.filter(~_has_key(target, key))
    # The keys that are already there. Copies first shrink inside each partition: with a shuffle
    # of its own behind it, the join may be split where a key is hot.
    met = old.select(*key).join(keyed.select(*key), list(key), "left_semi")
    present = met.select(*key, F.spark_partition_id().alias("_place")).distinct().select(*key).distinct()
    new = keyed.join(present, list(key), "left_anti").unionByName(incoming.filter(~_has_key(incoming, key)))
    types = {f.name: f.dataType for f in target.schema.fields}
    new = new.select(*[
        F.col(quote_name(c)).cast(types[c]).alias(c) if c in incoming.columns else F.lit(None).cast(types[c]).alias(c)
        for c in target.columns
    ])
    return written.unionByName(untouched).unionByName(new)


def partition_columns(spark: SparkSession, schema: str, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(quote_name(schema, table)) if c.isPartition]


def touched_partitions(target: DataFrame, batch: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Target rows in partitions that the batch writes to; the join prunes the scan where Spark can."""
    named = batch.select(*partitions).distinct().toDF(*[f"_part{i}" for i in range(len(partitions))])
    same = [F.col(quote_name(c)).eqNullSafe(F.col(f"_part{i}")) for i, c in enumerate(partitions)]
    return target.join(named, same, "left_semi")


def overwrite_partitions(df: DataFrame, schema: str, table: str, partitions: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows for; ``df`` may be read from them."""
    spark = df.sparkSession
    passing = passing_name()
    _write_new(df, schema, passing)
    try:
        # A session of its own, so that the caller's overwrite mode stays as it is.
        session = spark.newSession()
        session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        columns = scan_table(spark, schema, table).columns
        merged = scan_table(session, schema, passing).select(*columns)
        # Rows of a partition meet, and a large one is split, so that not every task writes every partition.
        merged = merged.hint("rebalance", *[F.col(quote_name(c)) for c in partitions])
        merged.write.mode("overwrite").insertInto(quote_name(schema, table))
    finally:
        drop_table(spark, schema, passing)
    spark.catalog.refreshTable(quote_name(schema, table))


def tenant_key(key: Sequence[str], target: Sequence[str], batch: Sequence[str]) -> list[str]:
    """The key with the tenant in it, where both sides know tenants: one never writes over another's rows."""
    both = TENANT in target and TENANT in batch
    return [*key, TENANT] if both and TENANT not in key else list(key)


def sized_session(spark: SparkSession, rows: int) -> SparkSession:
    """A session with the caller's settings whose joins have as many partitions as so many rows need.

    A join's task holds what it sorts. A fixed number of partitions would let it grow with the table, and so would merging
    partitions by their compressed bytes, which say little about rows.
    """
    needed = -(-rows // ROWS_PER_TASK)
    if needed <= 1:
        return spark
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            session.conf.set(name, value)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.shuffle.partitions", max(needed, min(usual, 4 * needed)))
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return session


def append_table(df: DataFrame, schema: str, table: str, key: Sequence[str] = DEFAULT_KEY) -> None:
    """Upsert into a stored table.

    When the key holds the table's partition columns, only the partitions of the batch are
    rewritten; otherwise a key may match anywhere and the whole table is.
    """
    spark = df.sparkSession
    absent = [k for k in key if k not in df.columns]
    if absent:
        raise ValueError(f"the batch has no key columns {absent}")
    # The batch is read several times below; it is computed once.
    batch_table = passing_name()
    _write_new(df, schema, batch_table)
    try:
        n_stored = scan_table(spark, schema, table).count()
        session = sized_session(spark, n_stored + scan_table(spark, schema, batch_table).count())
        batch = scan_table(session, schema, batch_table)
        target = scan_table(session, schema, table)
        key = tenant_key(key, target.columns, batch.columns)
        check_unique(batch, key)
        partitions = partition_columns(spark, schema, table)
        if partitions and set(partitions) <= set(key):
            merged = upsert(touched_partitions(target, batch, partitions), batch, key)
            overwrite_partitions(merged, schema, table, partitions)
        else:
            swap_table(upsert(target, batch, key), schema, table, n_stored, partitions)
    finally:
        drop_table(spark, schema, batch_table)
        # The caller's session has not seen that the table was written.
        spark.catalog.refreshTable(quote_name(schema, table))


def effective_mode(spark: SparkSession, schema: str, table: str, mode: str) -> str:
    """Appending to a table that is not there means making it."""
    if mode not in LOAD_MODES:
        raise ValueError(f"load mode {mode!r} is not one of {LOAD_MODES}")
    return mode if table_exists(spark, schema, table) else "replace"


def load_table(df: DataFrame, schema: str, table: str, mode: str = "replace", key: Sequence[str] = DEFAULT_KEY,
               partition_by: Sequence[str] = ()) -> str:
    """Write by the given mode and return the mode that was used."""
    used = effective_mode(df.sparkSession, schema, table, mode)
    if used == "replace":
        replace_table(df, schema, table, partition_by)
    else:
        append_table(df, schema, table, key)
    return used


def write_chunked(df: DataFrame, path: str, rows: int = 30000) -> None:
    """Parquet files of at most ``rows`` rows each."""
    df.write.option("maxRecordsPerFile", rows).mode("overwrite").parquet(path)
