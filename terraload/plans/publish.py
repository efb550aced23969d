"""The stored catalog of layers and layer groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from terraload.functions.names import quote_name
from terraload.operators import layers as ops
from terraload.operators.sinks import swap_table
from terraload.sources.tables import scan_table

LAYERS = "layers"
GROUPS = "layer_groups"

LAYERS_DDL = "group_id string, name string, is_view boolean, store string, title string"
GROUPS_DDL = "group_id string, layer_group string, rank int, member string"


def create_catalog(spark: SparkSession, schema: str) -> None:
    for table, ddl in ((LAYERS, LAYERS_DDL), (GROUPS, GROUPS_DDL)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {quote_name(schema, table)} ({ddl}) USING parquet")


def _names(spark: SparkSession, group_id: str, layers: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(group_id, n) for n in dict.fromkeys(layers)], "group_id string, name string")


def publish_layers(spark: SparkSession, schema: str, group_id: str, layers: Sequence[str]) -> DataFrame:
    """Add new layers, build their groups, and return the tenant's layers.

    A group that exists stays as it is.
    """
    known = scan_table(spark, schema, LAYERS)
    requested = _names(spark, group_id, layers)
    new = ops.new_layers(requested, known)
    stored_groups = scan_table(spark, schema, GROUPS)
    groups = ops.layer_groups(requested, new).join(
        stored_groups.select("group_id", "layer_group").distinct(), ["group_id", "layer_group"], "left_anti")
    swap_table(stored_groups.unionByName(groups), schema, GROUPS)
    swap_table(known.unionByName(ops.published_layers(new)), schema, LAYERS)
    return ops.list_layers(scan_table(spark, schema, LAYERS), group_id)


def remove_layers(spark: SparkSession, schema: str, group_id: str, layers: Sequence[str]) -> DataFrame:
    """Delete layers and their places in groups, and return what the tenant still has."""
    removed = _names(spark, group_id, layers)
    members = ops.published_layers(removed).selectExpr("group_id", "title AS member")
    groups = scan_table(spark, schema, GROUPS)
    swap_table(groups.join(members, ["group_id", "member"], "left_anti").select(*groups.columns), schema, GROUPS)
    kept = ops.delete_layers(scan_table(spark, schema, LAYERS), removed).select("group_id", "name", "is_view", "store", "title")
    swap_table(kept, schema, LAYERS)
    return ops.list_layers(scan_table(spark, schema, LAYERS), group_id)
