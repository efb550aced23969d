"""Tables of the session catalog and of JDBC databases."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from terraload.functions.names import lower_columns, quote_name


def create_schema(spark: SparkSession, schema: str, location: str | None = None) -> None:
    """Create a schema with its standard comment, if it is not there."""
    comment = f"standard {schema} schema".replace("'", "")
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quote_name(schema)} COMMENT '{comment}'{where}")


def scan_table(spark: SparkSession, schema: str, table: str) -> DataFrame:
    return spark.table(quote_name(schema, table))


def table_exists(spark: SparkSession, schema: str, table: str) -> bool:
    return spark.catalog.tableExists(quote_name(schema, table))


def named_tables(spark: SparkSession, tables: str | Iterable[str], schema: str, read) -> dict[str, DataFrame]:
    """Tables by name; one that is not stored yet is made by ``read(name)`` and kept."""
    found = {}
    for table in [tables] if isinstance(tables, str) else list(tables):
        if not table_exists(spark, schema, table):
            lower_columns(read(table)).write.saveAsTable(quote_name(schema, table))
        found[table] = scan_table(spark, schema, table)
    return found


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], split_column: str | None = None,
              bounds: tuple | None = None, partitions: int = 1) -> DataFrame:
    """Table of a database; with a split column, ``partitions`` tasks read one range each."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if split_column:
        low, high = bounds
        reader = (reader.option("partitionColumn", split_column).option("lowerBound", low)
                  .option("upperBound", high).option("numPartitions", partitions))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "append",
               batch_rows: int = 30000) -> None:
    """Write to a database in batches, one connection per partition."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option(
        "batchsize", batch_rows).options(**properties).mode(mode).save()
