"""The whole way: archives, manifest, load, model, result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraload.checks import bindings as b
from terraload.checks import sample_files as samples
from terraload.checks.catalog import check
from terraload.operators import registry
from terraload.plans import ingest, models, publish
from terraload.runtime import new_path, work_dir
from terraload.sources import archive, tables

_MODEL = """
    SELECT kind, count(*) AS n_places, (SELECT count(*) FROM orders) AS n_orders,
           (SELECT CAST(sum(o_key) AS BIGINT) FROM orders) AS total, %unit% AS unit
    FROM places GROUP BY kind"""


def archives(spark: SparkSession, sf_dir: str) -> str:
    """Archives of DBF, CSV and shapefile samples, one file in each."""
    def write(path):
        for root in (b.customer_csv(spark, sf_dir, False), b.order_dbf(spark, sf_dir), b.point_files(spark, sf_dir, False)):
            samples.zip_each(archive.list_paths(spark, root).select("path"), path)

    return b.once(spark, sf_dir, "archives", write)


@check("ingest_to_model", """
    SELECT kind, n_places, n_orders, total, 'pieces' AS unit
    FROM (SELECT event_type AS kind, count(*) AS n_places FROM events GROUP BY 1),
         (SELECT count(*) AS n_orders, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders WHERE o_orderstatus <> 'P')""")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = b.check_schema(spark, "store")
    registry.create_registries(spark, store)
    publish.create_catalog(spark, store)
    upload, manifest = ingest.analyze_archive(spark, store, "acme", archives(spark, sf_dir), new_path(spark, "upload"))
    schema = b.check_schema(spark, "loaded")
    load, _, summary = ingest.load_batch(spark, store, upload, "acme", manifest, schema, srid=32632)
    if summary["errors"]:
        raise RuntimeError(f"files failed: {summary['errors']}")

    def model(inputs, params):
        pick = lambda column: [t for t in inputs.values() if column in t.columns]
        together = {"places": _union(pick("geometry")), "orders": _union(pick("o_key"))}
        return models.run_sql_model(spark, _MODEL, together, params)

    tenant = new_path(spark, "acme")
    schema = tenant[len(work_dir(spark)) + 1:].replace("-", "_")
    known = models.ModelStore(spark, store)
    model_id = known.register(schema, model)["id"]
    known.execute(schema, load, model_id, {"unit": "pieces"}, {models.RESULT: "summary"}, tenant)
    return tables.scan_table(spark, schema, "summary")


def _union(frames: list[DataFrame]) -> DataFrame:
    total = frames[0]
    for frame in frames[1:]:
        total = total.unionByName(frame)
    return total
