"""Names, manifests, sinks and models."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from terraload.checks import bindings as b
from terraload.checks import sample_files as samples
from terraload.checks.catalog import check
from terraload.functions import names, parsing, templates, types
from terraload.operators import manifest as manifests
from terraload.operators import registry, sinks
from terraload.plans import ingest, models, publish
from terraload.runtime import new_path
from terraload.sources import archive, tables

# Names.


@check("lower_columns", "SELECT * FROM orders")
def lower_columns(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    return names.lower_columns(orders.toDF(*[c.upper() for c in orders.columns]))


@check("escape_quotes", r"""SELECT doc_id, replace('"' || text || '"', '"', '\"') AS escaped FROM documents""")
def escape_quotes(spark, sf_dir):
    quoted = F.concat(F.lit('"'), "text", F.lit('"'))
    return b.table(spark, sf_dir, "documents").select("doc_id", parsing.escape_quotes(quoted).alias("escaped"))


@check("clean_identifier", r"""
    WITH raw AS (
        SELECT p_partkey, 'brand' AS kind, p_brand || '-' || p_type || ' ' || p_size AS name FROM part UNION ALL
        SELECT p_partkey, 'number', p_partkey || '&' || p_name FROM part UNION ALL
        SELECT p_partkey, 'reserved', CASE p_size % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'PG_catalog' END FROM part UNION ALL
        SELECT p_partkey, 'marks', chr(9) || ' A|b+c:d;e%f*' || p_name || chr(10) FROM part),
    low AS (SELECT *, CASE WHEN lower(name) IN ('public', 'pg_catalog', 'information_schema')
                           THEN '__' || lower(name) || '__' ELSE lower(name) END AS l FROM raw),
    done AS (SELECT *, trim(translate(l, '-&|+:;%* ', '_________'), chr(9) || chr(10) || ' ') AS t FROM low)
    SELECT p_partkey, kind, CASE WHEN regexp_matches(t, '^[0-9]') THEN '_' || t || '_' ELSE t END AS cleaned FROM done""")
def clean_identifier(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    variants = F.array(
        F.struct(F.lit("brand").alias("kind"), F.concat("p_brand", F.lit("-"), "p_type", F.lit(" "), F.col("p_size").cast("string")).alias("name")),
        F.struct(F.lit("number").alias("kind"), F.concat(key, F.lit("&"), "p_name").alias("name")),
        F.struct(F.lit("reserved").alias("kind"), F.when(F.col("p_size") % 3 == 0, "Public").when(F.col("p_size") % 3 == 1, "PG_catalog").alias("name")),
        F.struct(F.lit("marks").alias("kind"), F.concat(F.lit("\t A|b+c:d;e%f*"), "p_name", F.lit("\n")).alias("name")),
    )
    return b.table(spark, sf_dir, "part").select("p_partkey", F.inline(variants)).select(
        "p_partkey", "kind", names.clean_identifier(F.col("name")).alias("cleaned"))


@check("tag_tenant", "SELECT *, 'acme' AS group_id FROM customer")
def tag_tenant(spark, sf_dir):
    return names.tag_tenant(b.table(spark, sf_dir, "customer"), "acme")


# Manifests.

def _spec(*rows):
    return [dict(zip(("column", "column_name", "tipo", "importing", "position"), (*r, i))) for i, r in enumerate(rows)]


@check("project_importing", """
    SELECT l_shipdate AS shipped, l_orderkey AS order_id, l_quantity AS "Qty Total" FROM lineitem""")
def project_importing(spark, sf_dir):
    return manifests.project_importing(b.table(spark, sf_dir, "lineitem"), _spec(
        ("l_shipdate", "shipped", "text", True), ("l_orderkey", "order_id", "integer", True),
        ("l_tax", "tax", "double precision", False), ("l_quantity", "Qty Total", "double precision", True)))


_CAST_SPEC = _spec(("c_custkey", "c_custkey", "text", True), ("c_acctbal", "c_acctbal", "double precision", True),
                   ("c_nationkey", "c_nationkey", "integer", True), ("c_name", "c_name", "text", True),
                   ("c_mktsegment", "c_mktsegment", "boolean", True))


def _untyped_customer(spark, sf_dir):
    bad = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("x"), F.col("c_acctbal").cast("string")))
    return b.table(spark, sf_dir, "customer").withColumn("c_acctbal", bad.otherwise(F.col("c_acctbal").cast("string")))


@check("cast_by_manifest", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_nationkey,
           CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal END AS c_acctbal,
           CAST(NULL AS BOOLEAN) AS c_mktsegment FROM customer""")
def cast_by_manifest(spark, sf_dir):
    return manifests.cast_by_manifest(_untyped_customer(spark, sf_dir), _CAST_SPEC)


@check("cast_errors", """
    SELECT 'c_custkey' AS "column", 0 AS n_errors UNION ALL
    SELECT 'c_acctbal', count(*) FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL
    SELECT 'c_mktsegment', count(*) FROM customer""")
def cast_errors(spark, sf_dir):
    return manifests.cast_errors(_untyped_customer(spark, sf_dir), _CAST_SPEC)


_WHOLE, _DECIMAL = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _infer_sql(table, columns, value="CAST({0} AS VARCHAR)"):
    """SQL that names the smallest type for the text form of each column."""
    parts = []
    for i, column in enumerate(columns):
        v = value.format(column)
        parts.append(f"""
            SELECT {i} AS ordinal, '{column}' AS "column", count({column}) AS n_values,
                   CASE WHEN count({column}) = 0 THEN 'double precision'
                        WHEN bool_and(regexp_matches({v}, '{_WHOLE}')) THEN 'integer'
                        WHEN bool_and(regexp_matches({v}, '{_DECIMAL}')) THEN 'double precision'
                        WHEN bool_and({v} IN ('true', 'false')) THEN 'boolean'
                        WHEN bool_and(regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) THEN 'date'
                        ELSE 'text' END AS tipo FROM {table}""")
    return " UNION ALL ".join(parts)


_LINE = """(SELECT l_orderkey, l_tax, l_returnflag, l_discount > 0.05 AS cheap, CAST(l_shipdate AS DATE) AS day,
            CASE WHEN l_linestatus = 'X' THEN 1 END AS nothing,
            CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS VARCHAR) ELSE CAST(l_linenumber AS VARCHAR) END AS mixed,
            CASE WHEN l_returnflag = 'R' THEN 'R' ELSE CAST(l_linenumber AS VARCHAR) END AS code FROM lineitem)"""
_LINE_COLUMNS = ["l_orderkey", "l_tax", "l_returnflag", "cheap", "day", "nothing", "mixed", "code"]


@check("infer_types", _infer_sql(_LINE, _LINE_COLUMNS))
def infer_types(spark, sf_dir):
    number = F.col("l_linenumber").cast("string")
    returned = F.col("l_returnflag") == "R"
    line = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string"), F.col("l_tax").cast("string"), "l_returnflag",
        (F.col("l_discount") > 0.05).cast("string").alias("cheap"), F.col("l_shipdate").cast("date").cast("string").alias("day"),
        F.when(F.col("l_linestatus") == "X", "1").alias("nothing"),
        F.when(returned, F.col("l_quantity").cast("string")).otherwise(number).alias("mixed"),
        F.when(returned, F.lit("R")).otherwise(number).alias("code"))
    return types.infer_types(line)


_TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
}


@check("infer_manifest", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", "column", tipo, CAST(ordinal AS BIGINT) AS position FROM ({_infer_sql(t, cs)})
        UNION ALL SELECT '{t}', 'group_id', 'text', CAST({len(cs)} AS BIGINT)""" for t, cs in _TABLES.items()))
def infer_manifest(spark, sf_dir):
    found = []
    for name, columns in _TABLES.items():
        text = b.table(spark, sf_dir, name).select(*[F.col(c).cast("string") for c in columns])
        typed = types.to_labels(text, types.inferred_labels(text, dates=False))
        found += manifests.describe_rows(typed, f"{name}.csv", name, "public")
    return manifests.from_rows(spark, found).select("table", "column", "tipo", "position")


@check("render_ddl", """
    SELECT 'part_' || p_partkey AS "table",
           'code integer' || CASE WHEN p_size <= 30 THEN ', label_' || lower(p_type) || ' text' ELSE '' END ||
           CASE WHEN p_size > 10 THEN ', price double precision' ELSE '' END ||
           CASE WHEN p_size > 20 THEN ', price text' ELSE '' END AS ddl FROM part""")
def render_ddl(spark, sf_dir):
    return manifests.render_ddl(b.manifest(spark, sf_dir))


@check("manifest_by_file", """
    SELECT 'part_' || p_partkey || '.csv' AS filename,
           'code>code' || CASE WHEN p_size <= 30 THEN ' label>label_' || lower(p_type) ELSE '' END ||
           CASE WHEN p_size > 10 THEN ' price>price' ELSE '' END ||
           CASE WHEN p_size > 20 THEN ' cost>price' ELSE '' END AS columns FROM part""")
def manifest_by_file(spark, sf_dir):
    grouped = manifests.manifest_by_file(b.manifest(spark, sf_dir))
    return grouped.select("filename", F.concat_ws(" ", F.transform("columns", lambda c: F.concat_ws(">", c["column"], c["column_name"]))).alias("columns"))


@check("spec_lookup", """
    SELECT 'part_' || p_partkey AS "table", 'code' AS column_name, 'code' AS "column", 'integer' AS tipo, true AS importing FROM part
    UNION ALL SELECT 'part_' || p_partkey, 'label_' || lower(p_type), 'label', 'text', p_size <= 30 FROM part
    UNION ALL SELECT 'part_' || p_partkey, 'price', 'cost', 'text', p_size > 20 FROM part""")
def spec_lookup(spark, sf_dir):
    return manifests.spec_lookup(b.manifest(spark, sf_dir)).select("table", "column_name", "column", "tipo", "importing")


@check("requested_files", """
    SELECT 'part_' || l_partkey || '.csv' AS filename, l_orderkey, l_extendedprice FROM lineitem
    WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 20)""")
def requested_files(spark, sf_dir):
    asked = b.manifest(spark, sf_dir).withColumn("importing", F.col("importing") & (F.col("column") == "cost"))
    files = b.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string"), F.lit(".csv")).alias("filename"), "l_orderkey", "l_extendedprice")
    return manifests.requested_files(files, asked)


@check("manifest_json", """
    SELECT 'part_' || p_partkey || '.csv' AS filename, CAST(c.n AS BIGINT) AS position, c.name AS "column", 'part_' || p_partkey AS "table",
           CASE c.n WHEN 0 THEN true WHEN 1 THEN p_size <= 30 WHEN 2 THEN p_size > 10 ELSE p_size > 20 END AS importing
    FROM part, (VALUES (0, 'code'), (1, 'label'), (2, 'price'), (3, 'cost')) c(n, name)""")
def manifest_json(spark, sf_dir):
    stored = manifests.to_json(b.manifest(spark, sf_dir))
    wrapped = F.concat(F.lit('{"data":'), "json", F.lit("}"))
    back = stored.select("filename", F.explode(manifests.from_json(wrapped)).alias("r"))
    return back.select("filename", "r.position", "r.column", "r.table", "r.importing")


@check("build_manifest", r"""
    SELECT v.* FROM (VALUES
        ('csv', 'c_custkey', 'integer', 0, true), ('csv', 'c_name', 'text', 0, true), ('csv', 'c_nationkey', 'integer', 0, true),
        ('csv', 'c_acctbal', 'double precision', 0, true), ('csv', 'qualità', 'text', 0, true), ('csv', 'group_id', 'text', 0, true),
        ('dbf', 'o_key', 'integer', 0, true), ('dbf', 'o_price', 'double precision', 0, true), ('dbf', 'o_date', 'text', 0, true),
        ('dbf', 'o_prio', 'text', 0, true), ('dbf', 'o_open', 'boolean', 0, true), ('dbf', 'o_factor', 'double precision', 0, true),
        ('dbf', 'group_id', 'text', 0, true),
        ('shp', 'event_id', 'integer', 32633, true), ('shp', 'kind', 'text', 32633, true),
        ('shp', 'value', 'double precision', 32633, true), ('shp', 'geometry', 'geometry(PointZ,32633)', 32633, true),
        ('shp', 'group_id', 'text', 32633, true),
        ('xls', 'Error', 'Text', 0, false)) v(ext, "column", tipo, srid, importing)""")
def build_manifest(spark, sf_dir):
    roots = [b.customer_csv(spark, sf_dir, False), b.order_dbf(spark, sf_dir), b.point_files(spark, sf_dir, True)]
    paths = None
    for root in roots:
        listed = archive.list_paths(spark, root).select("path")
        paths = listed if paths is None else paths.unionByName(listed)
    # A workbook in the old binary format cannot be read and must give an error row.
    first = paths.filter(F.col("path").endswith(".dbf")).agg(F.min("path").alias("path"))
    paths = paths.unionByName(first.select(F.concat("path", F.lit(".xls")).alias("path")))
    found = archive.exclude_sidecars(archive.inventory(paths))
    rows = ingest.build_manifest(spark, ingest.listed_files(found), "acme")
    return rows.select(F.substring_index("filename", ".", -1).alias("ext"), "column", "tipo", "srid", "importing").distinct()


MANY_FILES = 2000
MANY_HEADERS = (("c_custkey;c_name;c_acctbal", ("integer", "text", "double precision")), ("c_name,c_nationkey", ("text", "integer")),
                ("c_mktsegment\tc_custkey\tc_acctbal", ("text", "integer", "double precision")))
_MANY_ROWS = ", ".join(f"({k}, '{c}', '{t}', {i})" for k, (header, kinds) in enumerate(MANY_HEADERS)
                       for i, (c, t) in enumerate([*zip(re.split("[;,\t]", header), kinds), ("group_id", "text")]))


@check("manifest_many_files", f"""
    SELECT 'part_' || n || '.csv' AS filename, 'part_' || n AS "table", "column", tipo, "position"::BIGINT AS "position"
    FROM (SELECT DISTINCT c_custkey % {MANY_FILES} AS n FROM customer), (VALUES {_MANY_ROWS}) AS h(kind, "column", tipo, "position")
    WHERE n % 3 = kind""")
def manifest_many_files(spark, sf_dir):
    """2000 files of three headers are described in as many jobs as three files are."""
    def write(path):
        lines = [F.concat_ws(re.search("[;,\t]", header)[0], *re.split("[;,\t]", header)) for header, _ in MANY_HEADERS]
        n = F.col("c_custkey") % MANY_FILES
        line = F.when(n % 3 == 0, lines[0]).when(n % 3 == 1, lines[1]).otherwise(lines[2])
        rows = b.table(spark, sf_dir, "customer").select(F.format_string("part_%d.csv", n).alias("name"), line.alias("line"))
        header = F.element_at(F.array(*[F.lit(h) for h, _ in MANY_HEADERS]), (F.regexp_extract("name", "[0-9]+", 0).cast("int") % 3 + 1))
        samples.write_named(rows.withColumn("header", header), path)

    folder = b.once(spark, sf_dir, "csv-many", write)
    found = archive.inventory(archive.list_paths(spark, folder).select("path"))
    return ingest.build_manifest(spark, ingest.listed_files(found), "acme").select("filename", "table", "column", "tipo", "position")


# Sinks.

def _base_and_batch(spark, sf_dir):
    """All orders; the batch doubles every key, so half of its rows meet an order and half are new."""
    base = b.table(spark, sf_dir, "orders")
    batch = base.select((F.col("o_orderkey") * 2).alias("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"),
                        F.when(F.col("o_orderstatus") == "F", F.lit("done")).alias("o_orderstatus"))
    return base, batch


_UPSERTED = """
    SELECT coalesce(o.o_orderkey, n.k) AS o_orderkey, o.o_custkey AS o_custkey,
           CASE WHEN n.k IS NULL THEN o.o_orderstatus ELSE n.s END AS o_orderstatus,
           CASE WHEN n.k IS NULL THEN o.o_totalprice ELSE n.p END AS o_totalprice,
           o.o_orderdate AS o_orderdate, o.o_orderpriority AS o_orderpriority
    FROM orders o FULL OUTER JOIN
         (SELECT o_orderkey * 2 AS k, o_totalprice + 1 AS p, CASE WHEN o_orderstatus = 'F' THEN 'done' END AS s FROM orders) n
         ON o.o_orderkey = n.k"""


@check("sink_replace", "SELECT * FROM orders")
def sink_replace(spark, sf_dir):
    schema = b.check_schema(spark)
    base, batch = _base_and_batch(spark, sf_dir)
    sinks.load_table(batch, schema, "orders")
    sinks.load_table(base, schema, "orders", "replace")
    return tables.scan_table(spark, schema, "orders")


@check("sink_append_missing", "SELECT * FROM orders")
def sink_append_missing(spark, sf_dir):
    schema = b.check_schema(spark)
    used = sinks.load_table(b.table(spark, sf_dir, "orders"), schema, "orders", "append", ["o_orderkey"])
    assert used == "replace"
    return tables.scan_table(spark, schema, "orders")


@check("sink_upsert", _UPSERTED)
def sink_upsert(spark, sf_dir):
    schema = b.check_schema(spark)
    base, batch = _base_and_batch(spark, sf_dir)
    sinks.load_table(base, schema, "orders")
    sinks.load_table(batch, schema, "orders", "append", ["o_orderkey"])
    return tables.scan_table(spark, schema, "orders")


@check("sink_upsert_partitioned", """
    SELECT o.o_orderpriority AS o_orderpriority, o_orderkey, o_custkey, o_totalprice,
           CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'seen' ELSE o_orderstatus END AS o_orderstatus FROM orders o
    UNION ALL SELECT '6-NEW', o_orderkey, NULL, NULL, 'seen' FROM orders WHERE o_orderpriority = '2-HIGH'""")
def sink_upsert_partitioned(spark, sf_dir):
    schema = b.check_schema(spark)
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    key = ["o_orderkey", "o_orderpriority"]
    sinks.load_table(orders, schema, "orders", "replace", key, ["o_orderpriority"])
    batch = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        "o_orderkey", F.lit("seen").alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "6-NEW").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    sinks.load_table(batch, schema, "orders", "append", key)
    return tables.scan_table(spark, schema, "orders")


@check("sink_neighbours_kept", """
    SELECT 'temp_orders' AS "table", o_orderkey, o_totalprice FROM orders UNION ALL
    SELECT 'batch_orders', o_orderkey, o_totalprice + 1 FROM orders UNION ALL
    SELECT 'orders', o_orderkey, o_totalprice + 2 FROM orders""")
def sink_neighbours_kept(spark, sf_dir):
    """An append leaves tables alone whose names passing tables might have."""
    schema = b.check_schema(spark)
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    names_ = ("temp_orders", "batch_orders", "orders")
    for add, name in enumerate(names_):
        sinks.load_table(orders.withColumn("o_totalprice", F.col("o_totalprice") + add), schema, name)
    sinks.load_table(tables.scan_table(spark, schema, "orders"), schema, "orders", "append", ["o_orderkey"])
    kept = [tables.scan_table(spark, schema, n).select(F.lit(n).alias("table"), "o_orderkey", "o_totalprice") for n in names_]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@check("sink_replace_failure", "SELECT *, true AS failed, 1 AS n_tables FROM orders")
def sink_replace_failure(spark, sf_dir):
    """A replace that fails on a row leaves the old rows, and no passing table."""
    schema = b.check_schema(spark)
    orders = b.table(spark, sf_dir, "orders")
    sinks.load_table(orders, schema, "orders")
    failed = False
    try:
        sinks.load_table(orders.withColumn("o_custkey", F.when(F.col("o_orderkey") >= 0, F.raise_error(F.lit("bad row")).cast("bigint"))), schema, "orders")
    except Exception as error:  # noqa: BLE001 - the failure is what is asked for
        failed = "bad row" in str(error)
    n = len(spark.catalog.listTables(schema))
    return tables.scan_table(spark, schema, "orders").select("*", F.lit(failed).alias("failed"), F.lit(n).alias("n_tables"))


@check("sink_upsert_tenants", """
    SELECT o_orderkey AS id, 'one' AS group_id, o_totalprice AS price FROM orders UNION ALL
    SELECT o_orderkey, 'two', o_totalprice + 1 FROM orders""")
def sink_upsert_tenants(spark, sf_dir):
    """Two tenants append the same ids to one table."""
    schema = b.check_schema(spark)
    orders = b.table(spark, sf_dir, "orders")
    for add, tenant in ((0, "one"), (5, "two"), (1, "two")):
        batch = orders.select(F.col("o_orderkey").alias("id"), F.lit(tenant).alias("group_id"), (F.col("o_totalprice") + add).alias("price"))
        sinks.load_table(batch, schema, "prices", "append")
    return tables.scan_table(spark, schema, "prices")


@check("sink_chunked", "SELECT *, true AS small_file FROM events")
def sink_chunked(spark, sf_dir):
    path = new_path(spark, "chunked")
    sinks.write_chunked(b.table(spark, sf_dir, "events"), path, 3000)
    read = spark.read.parquet(path)
    per_file = read.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return read.withColumn("file", F.input_file_name()).join(per_file, "file").select(
        *read.columns, (F.col("n") <= 3000).alias("small_file"))


# Models.

@check("quadratic_features", """
    SELECT p_partkey, p_name, p_retailprice, p_size, p_partkey * p_partkey AS "p_partkey*p_partkey",
           p_partkey * p_retailprice AS "p_partkey*p_retailprice", p_retailprice * p_retailprice AS "p_retailprice*p_retailprice"
    FROM part""")
def quadratic_features(spark, sf_dir):
    return models.quadratic_features(b.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size"))


@check("template_params", """
    SELECT p_partkey, 'brand,size' AS params,
           'SELECT ' || p_brand || ' AS b, ' || p_size || ' + 1 AS n FROM ' || replace(p_name, ' ', '_') ||
           ' WHERE brand = ' || p_brand AS filled FROM part""")
def template_params(spark, sf_dir):
    code = F.col("CODE")
    return b.models(spark, sf_dir).select(
        F.col("ID_MODEL").alias("p_partkey"), F.concat_ws(",", templates.parameter_names(code)).alias("params"),
        templates.fill(code, {"brand": F.col("STATUS"), "size": F.col("PARAMS")}).alias("filled"))


_MODEL = {
    "shipped": "SELECT * FROM lines WHERE l_shipdate > CAST(%since% AS TIMESTAMP_NTZ)",
    "totals": """SELECT l_returnflag, l_linestatus, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS quantity,
                        %label% AS label FROM shipped JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""",
}
_MODEL_SQL = """
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS quantity, 'it''s %x' AS label
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > TIMESTAMP '1998-06-01' GROUP BY ALL"""
_MODEL_PARAMS = {"since": "1998-06-01", "label": "it's %x"}


def _model_tables(spark, sf_dir):
    return {"lines": b.table(spark, sf_dir, "lineitem"), "orders": b.table(spark, sf_dir, "orders")}


@check("run_sql_model", _MODEL_SQL)
def run_sql_model(spark, sf_dir):
    return models.run_sql_model(spark, _MODEL, _model_tables(spark, sf_dir), _MODEL_PARAMS)["totals"]


@check("run_sql_model_like", """
    SELECT p_partkey, p_name, p_size % 7 AS rest, '%size%' AS mark FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE '%size%' AND p_size > 10""")
def run_sql_model_like(spark, sf_dir):
    """Per cent signs in quoted text, a remainder, and a parameter."""
    code = """SELECT p_partkey, p_name, p_size %% 7 AS rest, '%size%' AS mark -- not %this%
              FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE '%size%' AND p_size > %size%"""
    return models.run_sql_model(spark, code, {"part": b.table(spark, sf_dir, "part")}, {"size": 10})[models.RESULT]


@check("model_layers_published", r"""
    SELECT group_id, name FROM (SELECT 'acme' AS group_id, 'areas_' || i AS name, i FROM range(2) t(i)) WHERE i < (SELECT count(*) FROM events)""")
def model_layers_published(spark, sf_dir):
    """An execution of given code over a load's tables makes its geometry outputs layers."""
    schema = b.check_schema(spark)
    registry.create_registries(spark, schema)
    publish.create_catalog(spark, schema)
    load = registry.insert_request(spark, schema, registry.LOADS, GROUP_ID="acme", REQUEST={"data": []})
    b.event_shapes(spark, sf_dir).select("event_id", "geometry").write.saveAsTable(f"{schema}.shapes")
    rows = [("shapes", "f.csv", True, 0.1, True, 0, None, "replace"), ("broken", "g.csv", False, 0.1, True, 0, "bad", "replace")]
    ingest.record_outcomes(spark.createDataFrame(rows, ingest.OUTCOME_SCHEMA), schema, load, "acme", schema)
    code = {"all": "SELECT event_id, geometry FROM shapes", "some": "SELECT geometry FROM all WHERE event_id > %least%", "n": "SELECT count(*) AS n FROM some"}
    tenant = f"tenant_{uuid.uuid4().hex[:8]}"
    mapping = {"all": "areas_0", "some": "areas_1", "n": "numbers"}
    models.ModelStore(spark, schema).execute(tenant, load, None, {"least": 3}, mapping, new_path(spark, tenant), code)
    return tables.scan_table(spark, schema, publish.LAYERS).select(F.when(F.col("group_id") == tenant, "acme").alias("group_id"), "name")


@check("model_output_sink", _MODEL_SQL)
def model_output_sink(spark, sf_dir):
    tenant = f"tenant_{uuid.uuid4().hex[:8]}"
    outputs = models.run_sql_model(spark, _MODEL, _model_tables(spark, sf_dir), _MODEL_PARAMS)
    models.write_outputs(spark, outputs, {"totals": "sums"}, tenant, new_path(spark, tenant))
    return tables.scan_table(spark, tenant, "sums")


@check("pandas_model", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net, l_quantity >= 25 AS big FROM lineitem""")
def pandas_model(spark, sf_dir):
    def net(batches):
        for batch in batches:
            yield batch[["l_orderkey", "l_linenumber", "l_partkey"]].assign(
                net=batch["l_extendedprice"] * (1 - batch["l_discount"]), big=batch["l_quantity"] >= 25)

    lines = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity")
    return models.pandas_model(lines, net, "l_orderkey long, l_linenumber int, l_partkey long, net double, big boolean")


@check("classify_outputs", """
    SELECT 'areas' AS name, 'layers' AS class, count(*) AS n_rows FROM events UNION ALL
    SELECT 'flags', 'tables', count(DISTINCT l_returnflag) FROM lineitem UNION ALL
    SELECT 'rows', 'variables', count(*) FROM customer""")
def classify_outputs(spark, sf_dir):
    outputs = {
        "areas": b.event_shapes(spark, sf_dir).select("event_id", "geometry"),
        "flags": b.table(spark, sf_dir, "lineitem").select("l_returnflag").distinct(),
        "rows": str(b.table(spark, sf_dir, "customer").count()),
    }
    classes = models.classify_outputs(outputs)
    frames = None
    for name, output in outputs.items():
        kind = next(k for k in ("layers", "tables", "variables") if name in classes[k])
        n = F.lit(output).cast("bigint") if isinstance(output, str) else F.count(F.lit(1))
        source = spark.range(1) if isinstance(output, str) else output.agg(n.alias("n_rows"))
        row = source.select(F.lit(name).alias("name"), F.lit(kind).alias("class"),
                            (n if isinstance(output, str) else F.col("n_rows")).alias("n_rows"))
        frames = row if frames is None else frames.unionByName(row)
    return frames
