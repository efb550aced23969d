"""Geometry, layers, registries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraload.checks import bindings as b
from terraload.checks import sample_files as samples
from terraload.checks.catalog import check
from terraload.checks.sample_files import projection_text
from terraload.constants import ALLOWED_SRIDS
from terraload.functions import crs
from terraload.functions import geometry as geo
from terraload.operators import layers, ownership, registry, reports, sinks
from terraload.plans import ingest, publish
from terraload.runtime import new_path
from terraload.sources import archive, tables

LON = "(CAST(user_id % 360 AS DOUBLE) - 180)"
LAT = "(CAST(event_id % 181 AS DOUBLE) - 90)"

# Geometry.


@check("points_from_xy", f"""
    SELECT event_id, CASE WHEN event_type <> 'error' THEN {LON} END AS x, CASE WHEN event_type <> 'error' THEN {LAT} END AS y,
           CASE WHEN event_type <> 'error' THEN 4326 END AS srid, CASE WHEN event_type <> 'error' THEN 'Point' END AS gtype
    FROM events""")
def points_from_xy(spark, sf_dir):
    e = b.events(spark, sf_dir)
    placed = geo.detect_geometry(e.select(
        "event_id", F.when(F.col("event_type") != "error", F.col("lon")).alias("longitudine"), F.col("lat").alias("latitudine")))
    g = F.col("geometry")
    v = g["coords"][0][0][0]
    return placed.select("event_id", v["x"].alias("x"), v["y"].alias("y"), g["srid"].alias("srid"), g["gtype"].alias("gtype"))


@check("geom_from_wkt", f"""
    SELECT event_id, gtype, has_z, n_parts, n_vertices, last_x, 4326 AS srid FROM (
        SELECT *, CASE event_type WHEN 'click' THEN 'MultiPoint' WHEN 'error' THEN 'LineString' WHEN 'view' THEN 'Polygon'
                       WHEN 'signup' THEN 'MultiPolygon' END AS gtype,
                  CASE WHEN event_type <> 'purchase' THEN event_type = 'error' END AS has_z,
                  CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 1 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 END AS n_parts,
                  CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'view' THEN 8 WHEN 'signup' THEN 8 END AS n_vertices,
                  CASE event_type WHEN 'click' THEN {LAT} WHEN 'error' THEN {LON} + 2 WHEN 'view' THEN 1 WHEN 'signup' THEN {LON} END AS last_x
        FROM events) WHERE event_type <> 'purchase'
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_type = 'purchase'""")
def geom_from_wkt(spark, sf_dir):
    x, y = F.col("lon").cast("string"), F.col("lat").cast("string")
    square = "(0 0, 9 0, 9 9, 0 0)"
    text = (
        F.when(F.col("event_type") == "click", F.format_string("MULTIPOINT (%s %s, %s %s)", x, y, y, x))
        .when(F.col("event_type") == "error", F.format_string("LineString Z(%s %s 1,0 0 2, %s 0 3)", x, y, (F.col("lon") + 2).cast("string")))
        .when(F.col("event_type") == "view", F.format_string(f"POLYGON({square},(1 %s, 2 1 , 2 2, 1 1))", y))
        .when(F.col("event_type") == "signup", F.format_string(f"MULTIPOLYGON (({square}), ((%s 0, 1 1, 1 2, %s 0)))", x, x))
        .otherwise(F.concat(F.lit("nowhere "), x))
    )
    g = F.col("g")
    return b.events(spark, sf_dir).select("event_id", geo.from_wkt(text).alias("g")).select(
        "event_id", g["gtype"].alias("gtype"), g["has_z"].alias("has_z"), F.when(g.isNotNull(), F.size(g["coords"])).alias("n_parts"),
        F.when(g.isNotNull(), geo.vertex_count(g)).alias("n_vertices"),
        F.element_at(F.element_at(F.element_at(g["coords"], -1), -1), -1)["x"].alias("last_x"), g["srid"].alias("srid"))


@check("geom_from_wkt_broken", f"""
    SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN NULL WHEN 'view' THEN {LON} WHEN 'signup' THEN {LON} END AS x,
           event_type = 'signup' AS own_srid, false AS has_z
    FROM events""")
def geom_from_wkt_broken(spark, sf_dir):
    """Texts without their last bracket, with letters among the numbers, with measures, with a reference system."""
    x, y = F.col("lon").cast("string"), F.col("lat").cast("string")
    text = (F.when(F.col("event_type") == "click", F.format_string("LINESTRING (%s %s, 1 1", x, y))
            .when(F.col("event_type") == "error", F.format_string("POINT (%s %s x)", x, y))
            .when(F.col("event_type") == "view", F.format_string("POINT M (%s %s 7)", x, y))
            .when(F.col("event_type") == "signup", F.format_string("SRID=3003;POINT (%s %s)", x, y))
            .otherwise("GEOMETRYCOLLECTION (POINT (1 2)"))
    g = F.col("g")
    return b.events(spark, sf_dir).select("event_id", geo.from_wkt(text).alias("g")).select(
        "event_id", g["coords"][0][0][0]["x"].alias("x"), F.coalesce(g["srid"] == 3003, F.lit(False)).alias("own_srid"),
        F.coalesce(g["has_z"], F.lit(False)).alias("has_z"))


@check("geom_from_wkt_nested", f"""
    SELECT event_id, CASE event_type WHEN 'view' THEN 'Polygon' WHEN 'click' THEN 'MultiPoint' ELSE 'GeometryCollection' END AS gtype,
           event_type = 'signup' AS has_z, CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 2 ELSE 0 END AS n_parts,
           CASE event_type WHEN 'error' THEN {LON} + 1 + {LAT} WHEN 'signup' THEN {LON} + {LAT} END AS sum_x,
           CASE event_type WHEN 'error' THEN '1 Point 1,1 GeometryCollection 0,2 MultiPoint 2' WHEN 'signup' THEN '1 GeometryCollection 0,2 GeometryCollection 0,3 Point 1,2 Polygon 0,1 Point 1'
                           WHEN 'purchase' THEN '' END AS members
    FROM events""")
def geom_from_wkt_nested(spark, sf_dir):
    """Collections, collections of collections, and shapes and collections without any part."""
    x, y = F.col("lon").cast("string"), F.col("lat").cast("string")
    kind = F.col("event_type")
    text = (F.when(kind == "view", "Polygon EMPTY").when(kind == "click", " MULTIPOINT Z EMPTY ").when(kind == "purchase", "GEOMETRYCOLLECTION EMPTY")
            .when(kind == "error", F.format_string("GEOMETRYCOLLECTION (POINT (%s 0), GEOMETRYCOLLECTION (MULTIPOINT (1 2, %s 3)))", x, y))
            .otherwise(F.format_string("GeometryCollection(GEOMETRYCOLLECTION (GEOMETRYCOLLECTION(POINT Z (%s 0 1)) , POLYGON EMPTY), POINT (%s 3) )", x, y)))
    g = F.col("g")
    xs = F.transform(F.flatten(F.flatten(g["coords"])), lambda v: v["x"])
    members = F.transform(g["members"], lambda m: F.concat_ws(" ", m["depth"].cast("string"), m["gtype"], m["parts"].cast("string")))
    return b.events(spark, sf_dir).select("event_id", geo.from_wkt(text).alias("g")).select(
        "event_id", g["gtype"].alias("gtype"), g["has_z"].alias("has_z"), F.size(g["coords"]).alias("n_parts"),
        F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda n, v: n + v)).alias("sum_x"), F.array_join(members, ",").alias("members"))


@check("lost_geometries", """
    SELECT 'event_type' AS kept, count(*) FILTER (event_type IN ('click', 'error')) AS n_lost, count(*) FILTER (event_type = 'view') AS n_shapes FROM events""")
def lost_geometries(spark, sf_dir):
    """Texts that give no geometry are counted while the table is written."""
    schema = b.check_schema(spark)
    text = (F.when(F.col("event_type") == "click", "POINT (1").when(F.col("event_type") == "error", "nowhere")
            .when(F.col("event_type") == "view", "POINT (1 2)"))
    frame = geo.detect_geometry(b.events(spark, sf_dir).select("event_type", text.alias("geometry")))
    rows = [("event_type", "text"), ("geometry", "geometry(Point,4326)")]
    spec = [{"column": c, "column_name": c, "tipo": t, "importing": True, "position": i} for i, (c, t) in enumerate(rows)]
    table, lost = ingest.prepare(frame, spec, "acme", None)
    sinks.load_table(table, schema, "places")
    n = sum(o.get["n_lost"] for o in lost)
    stored = tables.scan_table(spark, schema, "places")
    return stored.agg(F.lit(stored.columns[0]).alias("kept"), F.lit(n).cast("bigint").alias("n_lost"), F.count("geometry").alias("n_shapes"))


@check("set_srid", f"SELECT event_id, 3857 AS forced, 4326 AS kept, {LON} AS x FROM events")
def set_srid(spark, sf_dir):
    g = geo.point(F.col("lon"), F.col("lat"))
    forced = geo.set_srid(g, 3857)
    return b.events(spark, sf_dir).select(
        "event_id", forced["srid"].alias("forced"), geo.set_srid(g, None)["srid"].alias("kept"), forced["coords"][0][0][0]["x"].alias("x"))


@check("srid_from_crs", """
    SELECT event_id, CASE WHEN event_type <> 'click' THEN CAST(32600 + user_id AS INTEGER) END AS srid FROM events""")
def srid_from_crs(spark, sf_dir):
    code = (F.col("user_id") + 32600).cast("string")
    text = F.when(F.col("event_type") == "click", F.lit('GEOGCS["GCS_WGS_1984",UNIT["Degree",0.0174]]')).when(
        F.col("event_type") == "view", F.concat(F.lit("EPSG:"), code)).otherwise(
        F.format_string('PROJCS["z",GEOGCS["g",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","%s"]]', code))
    return b.events(spark, sf_dir).select("event_id", geo.srid_from_crs(text).alias("srid"))


def _projection_texts() -> list[tuple[str, int | None]]:
    """Texts of every known system in both dialects, with what they should be taken for, and of systems not known."""
    first = {}
    for system in sorted(crs.SYSTEMS):
        first.setdefault(system[1:-1], system[0])
    texts = []
    for k, system in enumerate(crs.SYSTEMS):
        plain, desktop = (projection_text(system, dialect, k) for dialect in ("plain", "desktop"))
        # Systems that differ by their axes alone are told apart where a text has axes.
        same = [s[0] for s in crs.SYSTEMS if s[1:] == system[1:]]
        texts += [(plain, min(same)), (desktop, first[system[1:-1]])]
    zone = dict((s[0], s) for s in crs.SYSTEMS)[32633]
    text = projection_text(zone, "plain")
    texts += [(text.replace("15.0", "16.0"), None), (text.replace("0.9996", "0.9999"), None), (text.replace("WGS_1984", "Tokyo"), None),
              (text.replace("Transverse_Mercator", "Oblique_Mercator"), None), (text.replace('"metre",1.0', '"foot",0.3048'), None),
              (text.replace("PROJCS", "LOCAL_CS"), None), ("", None), ("no text of this kind", None),
              ("COMPD_CS[\"both\"," + text + ",VERT_CS[\"height\",VERT_DATUM[\"any\",2005],UNIT[\"foot\",0.3048],AXIS[\"Up\",UP]]]", 32633),
              (text[:-1] + ',AUTHORITY["EPSG","32733"]]', 32733)]
    return texts


_TEXTS = _projection_texts()


@check("srid_from_projection", f"""
    SELECT event_id, [{", ".join("NULL" if code is None else str(code) for _, code in _TEXTS)}][1 + event_id % {len(_TEXTS)}]::INTEGER AS srid FROM events""")
def srid_from_projection(spark, sf_dir):
    texts = F.element_at(F.array(*[F.lit(t) for t, _ in _TEXTS]), (F.col("event_id") % len(_TEXTS) + 1).cast("int"))
    rows = b.events(spark, sf_dir).select("event_id", F.replace(texts, F.lit("@"), F.col("event_id").cast("string")).alias("prj"))
    return crs.with_srid(rows, "prj").drop("prj")


@check("srid_allowed", f"""
    SELECT event_id, CAST(32500 + user_id AS INTEGER) AS srid,
           CAST(32500 + user_id AS INTEGER) IN {ALLOWED_SRIDS} AS allowed FROM events""")
def srid_allowed(spark, sf_dir):
    srid = (F.col("user_id") + 32500).cast("int")
    return b.events(spark, sf_dir).select("event_id", srid.alias("srid"), geo.srid_allowed(srid).alias("allowed"))


@check("geometry_label", """
    SELECT event_id, CASE WHEN event_type = 'click' AND value > 10 THEN 'geometry(MultiPoint,4326)'
                          WHEN event_type = 'error' AND value > 10 THEN 'geometry(LineStringZ,4326)'
                          WHEN event_type = 'view' OR value > 5 THEN 'geometry(Point,4326)' END AS label FROM events""")
def geometry_label(spark, sf_dir):
    g = F.col("geometry")
    return b.event_shapes(spark, sf_dir).select("event_id", geo.geometry_label(g["gtype"], g["has_z"], g["srid"]).alias("label"))


_SHAPES = """
    SELECT *, CASE WHEN event_type = 'click' AND value > 10 THEN 'MultiPoint' WHEN event_type = 'error' AND value > 10 THEN 'LineString'
                   WHEN event_type = 'view' OR value > 5 THEN 'Point' END AS g FROM events"""


@check("layer_geometry_type", f"""
    SELECT event_type, user_id, count(g) AS n_geometries,
           CASE WHEN count(DISTINCT g) = 1 THEN min(g) WHEN count(DISTINCT replace(g, 'Multi', '')) = 1 THEN 'MultiPoint'
                WHEN count(g) > 0 THEN 'Geometry' END AS gtype
    FROM ({_SHAPES}) GROUP BY ALL""")
def layer_geometry_type(spark, sf_dir):
    return geo.layer_summary(b.event_shapes(spark, sf_dir), by=["event_type", "user_id"]).select(
        "event_type", "user_id", "n_geometries", "gtype")


@check("layer_has_z", f"""
    SELECT event_type, bool_and(g = 'LineString') AS has_z, CAST(max(CASE WHEN g IS NOT NULL THEN 4326 END) AS INTEGER) AS srid
    FROM ({_SHAPES}) GROUP BY 1""")
def layer_has_z(spark, sf_dir):
    return geo.layer_summary(b.event_shapes(spark, sf_dir), by=["event_type"]).select("event_type", "has_z", "srid")


@check("reject_null_geometry", f"""
    SELECT event_type, user_id, CAST(hour(ts) AS INTEGER) AS hour FROM ({_SHAPES}) GROUP BY ALL HAVING count(g) = 0""")
def reject_null_geometry(spark, sf_dir):
    shapes = b.event_shapes(spark, sf_dir).withColumn("hour", F.hour("ts"))
    by = ["event_type", "user_id", "hour"]
    return geo.rejected_layers(geo.layer_summary(shapes, by=by)).select(*by)


# Layers.

_LAYERS = """
    WITH p AS (SELECT *, lower(replace(p_brand, '#', '_')) AS g FROM part),
    own AS (SELECT g AS group_id, CASE WHEN p_size > 40 THEN 'v_' WHEN p_size > 30 THEN 'base_' ELSE 'net_' END ||
                   lower(p_type) || '_' || replace(p_name, ' ', '_') || '_' || p_partkey AS name, p_retailprice < 950 AS known FROM p),
    req AS (SELECT group_id, name, known FROM own
            UNION ALL SELECT DISTINCT g, 'meta', false FROM p WHERE p_brand LIKE '%1%'
            UNION ALL SELECT DISTINCT g, 'v_meta', false FROM p WHERE p_brand LIKE '%2%')"""


@check("new_layers", _LAYERS + " SELECT group_id, name FROM req WHERE NOT known")
def new_layers(spark, sf_dir):
    return layers.new_layers(b.requested_layers(spark, sf_dir), b.known_layers(spark, sf_dir))


@check("list_layers", _LAYERS + """
    SELECT group_id, name, starts_with(name, 'v_') AS is_view, group_id || '_ds' AS store, group_id || '.' || name AS title
    FROM req WHERE group_id = 'brand_12'""")
def list_layers(spark, sf_dir):
    return layers.list_layers(layers.published_layers(b.requested_layers(spark, sf_dir)), "brand_12")


@check("delete_layers", _LAYERS + " SELECT group_id, name FROM req WHERE NOT known")
def delete_layers(spark, sf_dir):
    return layers.delete_layers(b.requested_layers(spark, sf_dir), b.known_layers(spark, sf_dir))


@check("layer_groups", _LAYERS + """,
    tok AS (SELECT DISTINCT group_id, split_part(name, '_', 2) AS t FROM req
            WHERE NOT known AND NOT starts_with(name, 'v_') AND contains(name, '_')),
    hit AS (SELECT r.group_id, t, name FROM req r JOIN tok ON tok.group_id = r.group_id AND contains(name, '_' || t)),
    grp AS (SELECT DISTINCT group_id, t FROM hit),
    flag AS (SELECT group_id, bool_or(name = 'meta') AS m, bool_or(name = 'v_meta') AS v FROM req GROUP BY 1),
    mem AS (SELECT group_id, t, name, 2 AS rank FROM hit
            UNION ALL SELECT grp.group_id, t, 'v_meta', 0 FROM grp JOIN flag USING (group_id) WHERE v
            UNION ALL SELECT grp.group_id, t, 'meta', 1 FROM grp JOIN flag USING (group_id) WHERE m)
    SELECT group_id, group_id || '_' || t || CASE WHEN v THEN '_view' ELSE '' END AS layer_group, rank, group_id || '.' || name AS member
    FROM mem JOIN flag USING (group_id)""")
def layer_groups(spark, sf_dir):
    requested = b.requested_layers(spark, sf_dir)
    return layers.layer_groups(requested, layers.new_layers(requested, b.known_layers(spark, sf_dir)))


# Reports.

_RESULTS = """
    WITH res AS (SELECT 't' || o_custkey AS "table", NOT (o_orderstatus = 'P' AND o_totalprice > 250000) AS ok,
                        floor(o_totalprice) AS elapsed, o_orderpriority = '1-URGENT' AS have_geom FROM orders)"""


@check("load_report", _RESULTS + """
    SELECT "table", 'to_load/' || "table" || '.shp' AS path, CASE WHEN bool_and(ok) THEN 'OK' ELSE 'Error' END AS status,
           sum(elapsed) AS elapsed, bool_or(have_geom) AS have_geom, count(*) FILTER (NOT ok) AS n_errors
    FROM res JOIN customer ON "table" = 't' || c_custkey GROUP BY "table" """)
def load_report(spark, sf_dir):
    return reports.load_report(b.load_results(spark, sf_dir), b.load_files(spark, sf_dir))


@check("publishable_layers", _RESULTS + """
    SELECT DISTINCT "table" FROM res WHERE have_geom AND "table" NOT IN (SELECT "table" FROM res WHERE NOT ok)""")
def publishable_layers(spark, sf_dir):
    return reports.publishable_layers(b.load_results(spark, sf_dir))


@check("skip_loaded", """
    SELECT 't' || c_custkey AS "table", 'to_load/t' || c_custkey || '.shp' AS path,
           EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS source_duplicated FROM customer""")
def skip_loaded(spark, sf_dir):
    files, existing = b.load_files(spark, sf_dir), b.load_results(spark, sf_dir).select("table")
    fresh = reports.skip_loaded(files, existing).withColumn("source_duplicated", F.lit(False))
    return fresh.unionByName(reports.already_loaded(files, existing).withColumn("source_duplicated", F.lit(True)))


@check("file_map", r"""
    SELECT o_orderkey AS "ID_SHAPE", 'up/Area-' || o_orderkey || '.shp' AS path, 'Area-' || o_orderkey || '.shp' AS filename,
           'area_' || o_orderkey AS "table" FROM orders UNION ALL
    SELECT o_orderkey, 'up\' || o_custkey || ' b.xlsx', o_custkey || ' b.xlsx', '_' || o_custkey || '_b_' FROM orders""")
def file_map(spark, sf_dir):
    return reports.file_map(b.uploads(spark, sf_dir))


@check("duplicate_uploads", """
    SELECT md5(text) AS "MD5", count(*) AS n_uploads, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_uploads(spark, sf_dir):
    return reports.duplicate_uploads(b.table(spark, sf_dir, "documents").select(
        F.md5(F.col("text").cast("binary")).alias("MD5"), F.col("doc_id").alias("ID_SHAPE")))


# Registries.

@check("registry_list", """
    SELECT o_orderkey AS "ID_SHAPE", o_orderstatus AS "STATUS", o_orderpriority AS "GROUP_ID", o_orderdate AS "DATE_LOAD"
    FROM orders WHERE o_orderpriority = '1-URGENT'""")
def registry_list(spark, sf_dir):
    return registry.list_requests(b.loads(spark, sf_dir), "ID_SHAPE", group_id="1-URGENT").select(
        "ID_SHAPE", "STATUS", "GROUP_ID", "DATE_LOAD")


@check("registry_page", """
    SELECT o_orderkey AS "ID_SHAPE", o_orderpriority AS "GROUP_ID" FROM orders WHERE o_orderpriority = '5-LOW'
    ORDER BY o_orderkey LIMIT 100 OFFSET 200""")
def registry_page(spark, sf_dir):
    found = registry.list_requests(b.uploads(spark, sf_dir), "ID_SHAPE", group_id="5-LOW")
    return registry.page(found.select("ID_SHAPE", "GROUP_ID"), "ID_SHAPE", skip=200)


@check("registry_page_after", """
    SELECT o_orderkey AS "ID_SHAPE", o_orderpriority AS "GROUP_ID" FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey > 700
    ORDER BY o_orderkey LIMIT 100""")
def registry_page_after(spark, sf_dir):
    found = registry.list_requests(b.uploads(spark, sf_dir), "ID_SHAPE", group_id="5-LOW")
    return registry.page_after(found.select("ID_SHAPE", "GROUP_ID"), "ID_SHAPE", 700)


@check("registry_get", """
    SELECT p_partkey AS "ID_MODEL", p_brand AS "STATUS", p_type AS "GROUP_ID", CAST(p_size AS VARCHAR) AS "PARAMS"
    FROM part WHERE p_partkey = 77""")
def registry_get(spark, sf_dir):
    return registry.get_request(b.models(spark, sf_dir), "ID_MODEL", 77).select("ID_MODEL", "STATUS", "GROUP_ID", "PARAMS")


@check("registry_update", """
    SELECT l_orderkey * 10 + l_linenumber AS "ID_EXECUTION", l_partkey AS "FK_MODEL", l_shipdate AS "DATE_EXECUTION",
           CASE WHEN l_orderkey * 10 + l_linenumber = 59796 THEN 'done' ELSE l_returnflag END AS "STATUS",
           CASE WHEN l_orderkey * 10 + l_linenumber = 59796 THEN '{"n": 1}' END AS "RESULTS" FROM lineitem""")
def registry_update(spark, sf_dir):
    updated = registry.update_request(
        b.executions(spark, sf_dir), "ID_EXECUTION", 59796, STATUS="done", RESULTS='{"n": 1}', PARAMS=None)
    return updated.select("ID_EXECUTION", "FK_MODEL", "DATE_EXECUTION", "STATUS", "RESULTS")


@check("registry_delete_cascade", """
    SELECT 'model' AS kind, p_partkey AS id, NULL AS model FROM part WHERE p_size <= 40 UNION ALL
    SELECT 'execution', l_orderkey * 10 + l_linenumber, l_partkey FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40)""")
def registry_delete_cascade(spark, sf_dir):
    models = b.models(spark, sf_dir)
    removed = models.filter(F.col("PARAMS").cast("int") > 40).select("ID_MODEL")
    kept = registry.delete_requests(models, "ID_MODEL", removed)
    kept_runs = registry.delete_requests(b.executions(spark, sf_dir), "FK_MODEL", removed.withColumnRenamed("ID_MODEL", "FK_MODEL"))
    return kept.select(F.lit("model").alias("kind"), F.col("ID_MODEL").alias("id"), F.lit(None).cast("bigint").alias("model")).unionByName(
        kept_runs.select(F.lit("execution").alias("kind"), F.col("ID_EXECUTION").alias("id"), F.col("FK_MODEL").alias("model")))


@check("registry_to_json", r"""
    SELECT '{"ID_SHAPE":' || o_orderkey || ',"SHAPEFILE":"order_' || o_orderkey || '.zip","STATUS":"' || o_orderstatus ||
           '","SRID":' || o_custkey || ',"PATH_SHAPEFILE":"c:/up/' || o_orderkey || '","USERFILE":["up/Area-' || o_orderkey ||
           '.shp","up\\' || o_custkey || ' b.xlsx"],"RESPONSE":null}' AS json FROM orders""")
def registry_to_json(spark, sf_dir):
    view = b.uploads(spark, sf_dir).select("ID_SHAPE", "SHAPEFILE", "STATUS", "SRID", "PATH_SHAPEFILE", "USERFILE", "RESPONSE")
    return view.select(registry.to_json(view).alias("json"))


@check("assign_ids", """
    SELECT 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey, o_orderdate FROM orders""")
def assign_ids(spark, sf_dir):
    requests = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return registry.assign_ids(requests, "id", ["o_orderdate", "o_orderkey"], last_id=1000)


@check("execution_lineage", """
    SELECT l_orderkey * 10 + l_linenumber AS "ID_EXECUTION", l_partkey AS "FK_MODEL", l_orderkey AS "FK_SHAPE",
           p_brand AS model_status, o_orderstatus AS upload_status, 'order_' || o_orderkey || '.zip' AS upload_file
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40 LEFT JOIN orders ON o_orderkey = 2 * l_orderkey""")
def execution_lineage(spark, sf_dir):
    return registry.execution_lineage(
        b.executions(spark, sf_dir), b.models(spark, sf_dir).filter("CAST(PARAMS AS INT) <= 40"), b.loads(spark, sf_dir), b.uploads(spark, sf_dir)
    ).select("ID_EXECUTION", "FK_MODEL", "FK_SHAPE", "model_status", "upload_status", "upload_file")


@check("fk_orphans", """
    SELECT l_orderkey * 10 + l_linenumber AS "ID_EXECUTION", 'FK_MODEL' AS broken FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) UNION ALL
    SELECT l_orderkey * 10 + l_linenumber, 'FK_SHAPE' FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def fk_orphans(spark, sf_dir):
    return registry.orphans(
        b.executions(spark, sf_dir), b.models(spark, sf_dir).filter("CAST(PARAMS AS INT) <= 40"),
        b.loads(spark, sf_dir).filter("STATUS <> 'P'"))


@check("execution_inputs", """
    SELECT l_orderkey * 10 + l_linenumber AS "ID_EXECUTION", 'area_' || l_orderkey || '.shp' AS filename,
           'area_' || l_orderkey AS "table", 'layer' AS kind FROM lineitem UNION ALL
    SELECT l_orderkey * 10 + l_linenumber, 'owner_' || o_custkey || '.csv', 'owner_' || o_custkey,
           CASE o_custkey % 2 WHEN 0 THEN 'layer' ELSE 'table' END
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def execution_inputs(spark, sf_dir):
    return registry.execution_inputs(b.executions(spark, sf_dir), b.loads(spark, sf_dir))


def _stored_loads(spark, sf_dir) -> str:
    """A schema with every order's load; each wrote a table of its own and one for all."""
    schema = b.check_schema(spark)
    registry.create_registries(spark, schema)
    publish.create_catalog(spark, schema)
    requests = b.loads(spark, sf_dir)
    registry.insert_requests(requests.drop("ID_SHAPE"), schema, registry.LOADS, _by_request_number())
    number = F.regexp_extract("REQUEST", r"area_([0-9]+)\.shp", 1)
    tables_of = F.explode(F.array(F.concat(F.lit("area_"), number), F.lit("everybody"))).alias("table")
    registry.stored(spark, schema, registry.LOADS).select(
        "ID_SHAPE", "GROUP_ID", F.lit(schema).alias("schema_name"), tables_of, F.lit("f.csv").alias("filename"), F.lit("append").alias("mode"),
        F.lit(True).alias("ok"), F.lit(False).alias("have_geom")).write.mode("append").insertInto(f"{schema}.{registry.OUTCOMES}")
    return schema


@check("delete_load", """
    SELECT 1 + o_orderkey AS "ID_SHAPE", o_orderstatus AS "STATUS", o_orderpriority AS "GROUP_ID", false AS table_left
    FROM orders WHERE o_orderkey <> 0""")
def delete_load(spark, sf_dir):
    schema = _stored_loads(spark, sf_dir)
    b.table(spark, sf_dir, "orders").write.saveAsTable(f"{schema}.area_0")
    ingest.delete_load(spark, schema, 1)
    left = tables.table_exists(spark, schema, "area_0")
    return registry.stored(spark, schema, registry.LOADS).select("ID_SHAPE", "STATUS", "GROUP_ID", F.lit(left).alias("table_left"))


@check("delete_load_shared", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 'mine' ELSE 'theirs' END AS group_id FROM lineitem
    WHERE l_orderkey % 2 = 1""")
def delete_load_shared(spark, sf_dir):
    """Two tenants' loads wrote one table; one of the loads goes, and one that only skipped the table."""
    schema = b.check_schema(spark)
    registry.create_registries(spark, schema)
    publish.create_catalog(spark, schema)
    tenant = F.when(F.col("l_orderkey") % 2 == 0, "mine").otherwise("theirs").alias("group_id")
    b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tenant).write.saveAsTable(f"{schema}.lines")
    request = {"data": [{"schema_name": schema, "table": "lines"}]}
    ids = [registry.insert_request(spark, schema, registry.LOADS, GROUP_ID=g, REQUEST=request) for g in ("mine", "theirs", "skipped")]
    for load, group in zip(ids, ("mine", "theirs")):
        report = spark.createDataFrame([("lines", "f.csv", True, 0.1, False, 0, None, "append")], ingest.OUTCOME_SCHEMA)
        ingest.record_outcomes(report, schema, load, group, schema)
    ingest.delete_load(spark, schema, ids[2])
    ingest.delete_load(spark, schema, ids[0])
    return tables.scan_table(spark, schema, "lines")


def _uploaded(spark, texts, docs, folder):
    """Registered uploads ``u<number>.zip`` of documents: ``upload``, its folder ``place``, ``name`` below the common folder.

    ``texts`` has ``name`` and ``text`` of each file; rows that come again write the same file again, so texts need no shuffle.
    """
    schema = b.check_schema(spark)
    registry.create_registries(spark, schema)
    samples.write_texts(texts.select("name", "text"), folder)
    uploads = docs.select(F.concat(F.lit("u"), F.col("upload").cast("string"), F.lit(".zip")).alias("SHAPEFILE"), "place").distinct()
    requests = uploads.select(
        "SHAPEFILE", F.col("place").alias("PATH_SHAPEFILE"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("DATE_UPLOAD", "timestamp_ntz"), ("STATUS", "string"), ("GROUP_ID", "string"), ("SRID", "int"),
                                                      ("MD5", "string"), ("USERFILE", "array<string>"), ("RESPONSE", "string"))])
    registry.insert_requests(requests, schema, registry.UPLOADS, ["SHAPEFILE"])
    number = F.regexp_extract("SHAPEFILE", "([0-9]+)", 1).cast("bigint").alias("upload")
    ids = registry.stored(spark, schema, registry.UPLOADS).select("ID_SHAPE", number)
    ownership.record_files(docs.join(ids, "upload").select("ID_SHAPE", F.concat(F.lit(folder + "/"), "name").alias("path")), schema)
    return schema, ids


def _left(spark, folder):
    return archive.whole_texts(spark, folder).select(
        F.substring_index("path", "/", -1).alias("filename"), F.length("value").cast("bigint").alias("n_chars"))


@check("delete_upload_files", r"""
    SELECT 'f' || doc_id || '.csv' AS filename, length(text) AS n_chars FROM documents WHERE doc_id % 2 = 1""")
def delete_upload_files(spark, sf_dir):
    """Uploads of at most 32 files share a folder; the files of every other one go."""
    folder = new_path(spark, "shared-upload")
    docs = b.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("name"), "text", F.lit(folder).alias("place"),
        F.expr("doc_id div 64 * 2 + doc_id % 2").alias("upload"))
    schema, ids = _uploaded(spark, docs, docs, folder)
    ownership.remove_files(spark, schema, ids.filter("upload % 2 = 0"))
    return _left(spark, folder)


@check("delete_uploads_owned_twice", r"""
    SELECT 'f' || doc_id || '.csv' AS filename, length(text) AS n_chars,
           (SELECT count(DISTINCT doc_id // 64) FROM documents WHERE (doc_id // 64) % 5 = 0) AS n_folders
    FROM documents WHERE (doc_id // 64) % 5 <> 0 AND (doc_id % 2 = 1 OR doc_id % 3 = 0)""")
def delete_uploads_owned_twice(spark, sf_dir):
    """Two uploads to a folder, every third file owned by both; one of each two goes, of every fifth folder both."""
    folder = new_path(spark, "owned-twice")
    d = b.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit(folder + "/d"), F.expr("doc_id div 64").cast("string")).alias("place"),
        F.concat(F.lit("d"), F.expr("doc_id div 64").cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("name"), "text")
    owners = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("doc_id") % 2).cast("int")))
    docs = d.select("name", "place", "doc_id", F.explode(owners).alias("owner")).withColumn("upload", F.expr("doc_id div 64 * 2 + owner"))
    schema, ids = _uploaded(spark, d, docs, folder)
    _, n_folders = ownership.remove_files(spark, schema, ids.filter("upload % 2 = 0 OR upload div 2 % 5 = 0"))
    return _left(spark, folder).withColumn("n_folders", F.lit(n_folders).cast("bigint"))


@check("assign_ids_after_delete", """
    SELECT o_orderkey + 1 AS "ID_SHAPE" FROM orders WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders)
    UNION ALL SELECT o_orderkey + 2 + (SELECT max(o_orderkey) FROM orders) FROM orders""")
def assign_ids_after_delete(spark, sf_dir):
    """The newest load goes; the ones after it do not get its id again."""
    schema = b.check_schema(spark)
    registry.create_registries(spark, schema)
    requests = b.loads(spark, sf_dir).drop("ID_SHAPE")
    registry.insert_requests(requests, schema, registry.LOADS, _by_request_number())
    registry.delete_stored(spark, schema, registry.LOADS, registry.last_id(spark, schema, registry.LOADS))
    registry.insert_requests(requests, schema, registry.LOADS, _by_request_number())
    return registry.stored(spark, schema, registry.LOADS).select("ID_SHAPE")


def _by_request_number():
    """Order of the requests' first file, ``area_<number>.shp``."""
    return [F.regexp_extract("REQUEST", r"area_([0-9]+)\.shp", 1).cast("bigint")]
