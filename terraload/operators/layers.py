"""Layers and layer groups as tables; all steps work for many tenants at once.

``layers`` has ``group_id`` and ``name``. A layer group's members are rows, in the order of
``rank`` (0 ``v_meta``, 1 ``meta``, 2 the rest) and then name, so no group is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraload.runtime import stage

KEY = ["group_id", "name"]
# Groups that a join may send to every task, at about 100 bytes each.
FEW_GROUPS = 50_000


def is_view(name: Column) -> Column:
    return name.startswith("v_")


def _without(layers: DataFrame, others: DataFrame) -> DataFrame:
    # Names may be many times as long as the files they come from, whose size Spark goes by: they are never broadcast.
    return layers.join(others.select(*KEY).distinct().hint("merge"), KEY, "left_anti")


def new_layers(requested: DataFrame, published: DataFrame) -> DataFrame:
    """Layers not published yet."""
    return _without(requested, published)


def published_layers(layers: DataFrame) -> DataFrame:
    """How layers appear in the catalog: store and title come from the tenant's name."""
    return layers.select(
        "group_id", "name", is_view(F.col("name")).alias("is_view"),
        F.concat("group_id", F.lit("_ds")).alias("store"), F.concat_ws(".", "group_id", "name").alias("title"))


def group_tokens(new: DataFrame) -> DataFrame:
    """Second ``_`` part of the new layers that are not views."""
    parts = F.split("name", "_")
    return (
        new.filter(~is_view(F.col("name")) & (F.size(parts) > 1))
        .select("group_id", F.get(parts, F.lit(1)).alias("token")).distinct()
    )


def _token_starts(name: Column) -> Column:
    """Every text that follows a ``_`` in the name and has no ``_`` itself.

    A token holds no ``_``, so it lies behind one in the name exactly when it is one of these.
    """
    tails = F.slice(F.split(name, "_"), F.lit(2), F.greatest(F.size(F.split(name, "_")) - 1, F.lit(0)))
    starts = F.transform(tails, lambda t: F.transform(F.sequence(F.lit(0), F.length(t)), lambda n: F.left(t, n)))
    return F.array_distinct(F.flatten(starts))


def layer_groups(requested: DataFrame, new: DataFrame) -> DataFrame:
    """Members of every group: layers in whose name ``_<group>`` occurs, and the meta tables.

    The containment test becomes an equi-join on the texts behind each ``_`` of the name. The groups are written
    first: they are read twice, and their number says whether they are few enough to be broadcast.
    """
    layers = requested.select(*KEY).distinct()
    metas = layers.groupBy("group_id").agg(
        F.bool_or(F.col("name") == "meta").alias("has_meta"), F.bool_or(F.col("name") == "v_meta").alias("has_view"))
    # Every token names a group: the layer it comes from holds it.
    groups = stage(group_tokens(new).hint("merge").join(metas, "group_id").select(
        "group_id", "token",
        F.concat(F.concat_ws("_", "group_id", "token"), F.when(F.col("has_view"), "_view").otherwise("")).alias("layer_group"),
        F.array(F.when(F.col("has_view"), F.struct(F.lit(0).alias("rank"), F.lit("v_meta").alias("name"))),
                F.when(F.col("has_meta"), F.struct(F.lit(1).alias("rank"), F.lit("meta").alias("name")))).alias("leading"),
    ), "groups")
    leading = groups.select("group_id", "layer_group", F.inline(F.filter("leading", lambda m: m.isNotNull())))
    members = (
        layers.select("*", F.explode(_token_starts(F.col("name"))).alias("token"))
        .join(groups.drop("leading").hint("broadcast" if groups.count() <= FEW_GROUPS else "merge"), ["group_id", "token"])
        .select("group_id", "layer_group", F.lit(2).alias("rank"), "name")
    )
    return leading.unionByName(members).select(
        "group_id", "layer_group", "rank", F.concat_ws(".", "group_id", "name").alias("member"))


def list_layers(layers: DataFrame, group_id: str) -> DataFrame:
    return layers.filter(F.col("group_id") == group_id)


def delete_layers(layers: DataFrame, removed: DataFrame) -> DataFrame:
    """Layers that stay."""
    return _without(layers, removed)
