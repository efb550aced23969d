import datetime
import json

import pytest
from pyspark.sql import functions as F

from terraload.functions import geometry as geo
from terraload.operators import layers, manifest, ordering, ownership, registry, reports, sinks
from terraload.plans import ingest, models, publish
from terraload.sources import tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Manifests.


def spec(*entries):
    return [dict(zip(("column", "column_name", "tipo", "importing", "position"), (*e, i))) for i, e in enumerate(entries)]


def test_manifest_defaults_and_projection(spark):
    given = spark.createDataFrame([("a.csv", "a", "x", "text", None), ("a.csv", "a", "a.csv", "text", False)],
                                  "filename string, table string, column string, tipo string, importing boolean")
    full = manifest.normalize(given)
    first = full.first().asDict()
    assert first["importing"] and first["schema_name"] == "public" and first["srid"] == 0 and first["column_name"] == "x"
    assert manifest.importing_rows(full).count() == 1

    df = spark.createDataFrame([("1", "x", 2.0)], "a string, b string, c double")
    wanted = spec(("c", "third", "integer", True), ("a", "first", "integer", True), ("b", "b", "text", False))
    projected = manifest.project_importing(df, wanted)
    assert projected.columns == ["third", "first"]
    cast = manifest.cast_by_manifest(projected, wanted)
    assert [f.dataType.simpleString() for f in cast.schema] == ["bigint", "bigint"] and rows(cast) == [(2, 1)]


def test_manifest_json_round_trip(spark):
    data = manifest.from_rows(spark, [("f", "s", "t", "c", "text", "d", True, False, 32633, False, 1),
                                      ("f", "s", "t", "b", "text", "b", False, False, 0, True, 0)])
    text = manifest.to_json(data).select(F.concat(F.lit('{"data":'), "json", F.lit("}")).alias("j"))
    back = text.select(F.explode(manifest.from_json(F.col("j"))).alias("r")).select("r.*")
    shared = [c for c in data.columns if c != "filename"]
    assert rows(back.select(*shared), "position") == rows(data.select(*shared), "position")


def test_cast_errors(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert rows(manifest.cast_errors(df, spec(("a", "a", "integer", True)))) == [("a", 1)]
    assert rows(manifest.cast_errors(df, spec(("a", "a", "text", True)))) == []


# Numbers.


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_row_numbers(spark, partitions):
    # A third of the rows share one value.
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("v")).repartition(5)
    numbered = ordering.number_rows(df, ["v"], "n", start=10, partitions=partitions)
    found = rows(numbered.select("n", "v"), "n")
    assert [n for n, _ in found] == list(range(11, 3011))
    assert [v for _, v in found] == sorted(v for _, v in found)


def test_row_numbers_of_nothing(spark):
    assert ordering.number_rows(spark.range(0), ["id"], "n").count() == 0


# Upsert.

SCHEMA = "id int, a string, b string"


def test_upsert_rules(spark):
    target = spark.createDataFrame([(1, "a1", "b1"), (2, "a2", "b2"), (None, "an", "bn"), (2, "dup", "b3")], SCHEMA)
    batch = spark.createDataFrame([(2, None), (3, "new"), (None, "null key")], "id int, a string")
    assert sorted(rows(sinks.upsert(target, batch)), key=str) == sorted([
        (1, "a1", "b1"), (2, None, "b2"), (2, None, "b3"), (None, "an", "bn"), (3, "new", None), (None, "null key", None)], key=str)
    with pytest.raises(ValueError):
        sinks.upsert(target, batch.withColumn("z", F.lit(1)))
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "id int, a string")
    with pytest.raises(sinks.DuplicateKeyError):
        sinks.check_unique(twice, ["id"])
    sinks.check_unique(spark.createDataFrame([(None, "x"), (None, "y")], "id int, a string"), ["id"])


def test_upsert_twice_is_once(spark, schema):
    target = spark.createDataFrame([(i, f"a{i}", "b") for i in range(20)], SCHEMA)
    batch = spark.createDataFrame([(i, f"new{i}", None) for i in range(10, 30)], SCHEMA)
    sinks.load_table(target, schema, "t")
    sinks.load_table(batch, schema, "t", "append")
    once = rows(tables.scan_table(spark, schema, "t"), "id")
    sinks.load_table(batch, schema, "t", "append")
    assert rows(tables.scan_table(spark, schema, "t"), "id") == once and len(once) == 30
    assert [t.name for t in spark.catalog.listTables(schema)] == ["t"]


def test_load_modes(spark, schema):
    df = spark.createDataFrame([(1, "a", "b")], SCHEMA)
    assert sinks.load_table(df, schema, "t", "append") == "replace"
    assert sinks.load_table(df, schema, "t", "append") == "append"
    with pytest.raises(ValueError):
        sinks.load_table(df, schema, "t", "merge")


def test_partitioned_append_leaves_other_partitions_alone(spark, schema):
    base = spark.createDataFrame([(1, "x", "g1"), (2, "y", "g2"), (3, "z", None)], "id int, v string, group_id string")
    key = ["id", "group_id"]
    sinks.load_table(base, schema, "t", "replace", key, ["group_id"])
    before = {r["f"] for r in tables.scan_table(spark, schema, "t").filter("group_id = 'g2'").select(F.input_file_name().alias("f")).collect()}
    batch = spark.createDataFrame([(1, "x2", "g1"), (9, "n", "g1"), (2, "other tenant", "g3"), (8, "m", None)], base.schema)
    sinks.load_table(batch, schema, "t", "append", key)
    assert sorted(rows(tables.scan_table(spark, schema, "t")), key=str) == sorted([
        (1, "x2", "g1"), (9, "n", "g1"), (2, "y", "g2"), (2, "other tenant", "g3"), (3, "z", None), (8, "m", None)], key=str)
    after = {r["f"] for r in tables.scan_table(spark, schema, "t").filter("group_id = 'g2'").select(F.input_file_name().alias("f")).collect()}
    assert before == after


def test_touched_partitions_are_found_by_a_join(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, g string")
    batch = spark.createDataFrame([("a",), (None,), ("z",)], "g string")
    assert rows(sinks.touched_partitions(target, batch, ["g"]), "id") == [(1, "a"), (3, None)]


def test_failed_swap_keeps_the_table(spark, schema):
    sinks.replace_table(spark.range(5), schema, "t")
    with pytest.raises(RuntimeError):
        sinks.swap_table(spark.range(3), schema, "t", at_least=5)
    assert tables.scan_table(spark, schema, "t").count() == 5


def test_chunked_files(spark, folder):
    sinks.write_chunked(spark.range(0, 100, 1, 2), str(folder / "c"), 20)
    sizes = spark.read.parquet(str(folder / "c")).groupBy(F.input_file_name()).count()
    assert sizes.agg(F.max("count"), F.count("*")).first() == (20, 6)


# Registries.


def test_registry_life(spark, schema):
    registry.create_registries(spark, schema)
    ids = [registry.insert_request(spark, schema, registry.UPLOADS, GROUP_ID=g, STATUS="UPLOAD ZIP", USERFILE=["a"], RESPONSE={"data": []})
           for g in ("x", "y", "x")]
    assert ids == [1, 2, 3]
    stored = registry.stored(spark, schema, registry.UPLOADS)
    assert stored.filter("ID_SHAPE = 1").first()["RESPONSE"] == '{"data": []}'
    pick = lambda **by: [r["ID_SHAPE"] for r in registry.list_requests(stored, "ID_SHAPE", **by).orderBy("ID_SHAPE").collect()]
    assert pick() == [1, 2, 3] and pick(group_id="x") == [1, 3] and pick(id=2) == [2] and pick(id=2, group_id="x") == []
    assert [r["ID_SHAPE"] for r in registry.page(stored, "ID_SHAPE", 1, 1).collect()] == [2]
    assert registry.get_request(stored, "ID_SHAPE", 9).count() == 0
    registry.update_stored(spark, schema, registry.UPLOADS, 2, STATUS="done", SRID=None)
    registry.delete_stored(spark, schema, registry.UPLOADS, 1)
    assert rows(registry.stored(spark, schema, registry.UPLOADS).select("ID_SHAPE", "STATUS"), "ID_SHAPE") == [(2, "done"), (3, "UPLOAD ZIP")]
    with pytest.raises(ValueError):
        registry.update_stored(spark, schema, registry.UPLOADS, 2, HOST_WORKER="h")
    with pytest.raises(ValueError):
        registry.insert_request(spark, schema, registry.UPLOADS, NOPE=1)


def test_deleting_a_model_takes_its_executions(spark, schema):
    registry.create_registries(spark, schema)
    for _ in range(2):
        registry.insert_request(spark, schema, registry.MODELS, GROUP_ID="g", CODE="c", LIBRARY=False)
    for model in (1, 2, 1):
        registry.insert_request(spark, schema, registry.EXECUTIONS, GROUP_ID="g", FK_MODEL=model, FK_SHAPE=1)
    registry.delete_stored(spark, schema, registry.MODELS, 1)
    assert [r["FK_MODEL"] for r in registry.stored(spark, schema, registry.EXECUTIONS).collect()] == [2]
    assert registry.insert_request(spark, schema, registry.MODELS, GROUP_ID="g", CODE="c", LIBRARY=False) == 3


def test_many_requests_at_once(spark, schema):
    registry.create_registries(spark, schema)
    registry.insert_request(spark, schema, registry.LOADS, GROUP_ID="g")
    many = spark.range(100).select(
        F.lit(None).cast("timestamp_ntz").alias("DATE_LOAD"), F.lit("s").alias("STATUS"), F.col("id").cast("string").alias("GROUP_ID"),
        F.lit(None).cast("string").alias("REQUEST"))
    registry.insert_requests(many, schema, registry.LOADS, [F.col("GROUP_ID").cast("int")])
    stored = registry.stored(spark, schema, registry.LOADS)
    assert rows(stored.select("ID_SHAPE", "GROUP_ID"), "ID_SHAPE")[1:] == [(i + 2, str(i)) for i in range(100)]


# Layers.

NAMES = ["road_north_main", "road_north_side", "lake_deep", "hill_deep", "hill_deep_hill_deep_top_x", "alone", "v_deep_view", "x__y"]


def groups_of(spark, names, known=()):
    req = spark.createDataFrame([("g", n) for n in names], "group_id string, name string")
    old = spark.createDataFrame([("g", n) for n in known], req.schema)
    found = {}
    for r in layers.layer_groups(req, layers.new_layers(req, old)).orderBy("layer_group", "rank", "member").collect():
        found.setdefault(r["layer_group"], []).append(r["member"])
    return found


def expected_groups(names, known=()):
    """The plain statement of the rule."""
    tokens = {n.split("_")[1] for n in names if n not in known and not n.startswith("v_") and "_" in n}
    lead = [m for m in ("v_meta", "meta") if m in names]
    suffix = "_view" if "v_meta" in names else ""
    return {f"g_{t}{suffix}": [f"g.{m}" for m in lead] + sorted(f"g.{n}" for n in names if f"_{t}" in n) for t in tokens}


@pytest.mark.parametrize("extra", [[], ["meta"], ["meta", "v_meta"]])
@pytest.mark.parametrize("known", [[], ["nd_com", "tr_com", "tr_com_tr_com_tra_sg", "a__b"]])
def test_layer_groups(spark, extra, known):
    assert groups_of(spark, NAMES + extra, known) == expected_groups(NAMES + extra, known)


def test_publishing(spark, schema):
    publish.create_catalog(spark, schema)
    assert publish.publish_layers(spark, schema, "g", ["nd_com", "v_x"]).count() == 2
    assert publish.publish_layers(spark, schema, "g", ["nd_com", "tr_com"]).count() == 3
    assert publish.publish_layers(spark, schema, "h", ["nd_com"]).count() == 1
    stored = tables.scan_table(spark, schema, publish.GROUPS)
    # The group was there already and stays as it was.
    assert rows(stored.filter("group_id = 'g'").select("layer_group", "member"), "member") == [("g_com", "g.nd_com")]
    left = publish.remove_layers(spark, schema, "g", ["nd_com"])
    assert rows(left.select("name", "is_view", "title"), "name") == [("tr_com", False, "g.tr_com"), ("v_x", True, "g.v_x")]
    assert tables.scan_table(spark, schema, publish.GROUPS).filter("group_id = 'g'").count() == 0


def test_reports(spark):
    results = spark.createDataFrame([("a", True, 1.0, True), ("a", False, 2.0, True), ("b", True, 3.0, True), ("c", True, 1.0, False)],
                                    "table string, ok boolean, elapsed double, have_geom boolean")
    assert rows(reports.publishable_layers(results)) == [("b",)]
    files = spark.createDataFrame([("a", "p/a"), ("b", "p/b"), ("d", "p/d")], "table string, path string")
    assert rows(reports.load_report(results, files), "table") == [("a", "p/a", "Error", 3.0, True, 1), ("b", "p/b", "OK", 3.0, True, 0)]
    assert rows(reports.skip_loaded(files, results), "table") == [("d", "p/d")]
    assert rows(reports.already_loaded(files, results), "table") == [("a", "p/a"), ("b", "p/b")]


# Models.


def test_quadratic_features(spark):
    df = spark.createDataFrame([(7, "oak", 0.5), (-3, None, 4.0)], "height bigint, tree string, girth double")
    out = models.quadratic_features(df)
    assert out.columns == ["height", "tree", "girth", "girth*girth", "girth*height", "height*height"]
    assert sorted(rows(out)) == [(-3, None, 4.0, 16.0, -12.0, 9), (7, "oak", 0.5, 0.25, 3.5, 49)]


def test_output_classes(spark):
    layer = spark.range(1).select(geo.point(F.lit(1.0), F.lit(2.0)).alias("geometry"))
    found = models.classify_outputs({"l": layer, "t": spark.range(1), "output": "printed", "s": "x", "f": 1.0, "d": {}, "n": 1, "o": {1}})
    assert found == {"layers": ["l"], "tables": ["t"], "output": "printed", "variables": {"s": "x", "f": 1.0, "d": {}},
                     "object": {"n": "1", "o": "{1}"}}


def test_sql_models(spark):
    tables_ = {"t": spark.range(10)}
    out = models.run_sql_model(spark, {"big": "SELECT * FROM t WHERE id > %low%", "n": "SELECT count(*) AS n, %name% AS name FROM big"},
                               tables_, {"low": 6, "name": "a' OR '1'='1"})
    assert rows(out["n"]) == [(3, "a' OR '1'='1")]
    assert "t" not in [t.name for t in spark.catalog.listTables() if t.isTemporary]
    with pytest.raises(KeyError):
        models.run_sql_model(spark, "SELECT %x%", {}, {})
    with pytest.raises(KeyError):
        models.write_outputs(spark, {}, {"x": "t"}, "g")


def test_sql_models_leave_the_callers_views(spark):
    spark.range(3).createOrReplaceTempView("mine")
    try:
        inner = {"mine": spark.range(10), "other": spark.range(4)}
        out = models.run_sql_model(spark, "SELECT count(*) AS n FROM mine, other", inner)
        assert out[models.RESULT].first()["n"] == 40 and spark.table("mine").count() == 3
        with pytest.raises(Exception):
            models.run_sql_model(spark, "SELECT nothing FROM mine", inner)
        assert spark.table("mine").count() == 3 and not spark.catalog.tableExists("other")
    finally:
        spark.catalog.dropTempView("mine")


def test_model_store(spark, schema):
    registry.create_registries(spark, schema)
    sinks.replace_table(spark.range(4), schema, "nums")
    load = registry.insert_request(spark, schema, registry.LOADS, GROUP_ID="g", REQUEST={"data": [
        {"filename": "nums.csv", "schema_name": schema, "table": "nums", "column": "id", "tipo": "integer"}]})
    written = [("nums", "nums.csv", True, 0.1, False, 0, None, "replace"), ("lost", "lost.csv", False, 0.1, False, 0, "bad", "replace")]
    ingest.record_outcomes(spark.createDataFrame(written, ingest.OUTCOME_SCHEMA), schema, load, "g", schema)
    store = models.ModelStore(spark, schema)

    def trial(inputs, params):
        return {"t": spark.range(1), "output": "hi"}

    assert store.register("g", trial, {})["tables"] == ["t"]
    sql = store.register("g", "SELECT sum(id) * %k% AS s FROM nums")["id"]
    done = models.ModelStore(spark, schema).execute(schema, load, sql, {"k": 2}, {"result": "sums"})
    assert done["tables"] == ["sums"] and rows(tables.scan_table(spark, schema, "sums")) == [(12,)]
    kept = registry.stored(spark, schema, registry.EXECUTIONS).first()
    assert json.loads(kept["RESULTS"])["tables"] == ["sums"] and json.loads(kept["PARAMS"]) == {"k": 2}
    assert isinstance(kept["DATE_EXECUTION"], datetime.datetime)
    with pytest.raises(KeyError):
        store.load(99)
    given = store.execute(schema, load, None, {}, {"result": "most"}, code="SELECT max(id) AS m FROM nums")
    assert given["tables"] == ["most"] and rows(tables.scan_table(spark, schema, "most")) == [(3,)]
    other = store.register("g", trial)["id"]
    with pytest.raises(ValueError, match="another session"):
        models.ModelStore(spark, schema).load(other)


def test_files_go_with_the_last_upload_that_owns_them(spark, schema, folder):
    registry.create_registries(spark, schema)
    for name in ("a/1.csv", "a/sub/2.csv", "a/3.csv", "b/4.csv", "c/5.csv", "elsewhere/6.csv"):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)

    def upload(place, names, listed=()):
        new = registry.insert_request(spark, schema, registry.UPLOADS, PATH_SHAPEFILE=place and f"{folder}/{place}",
                                      USERFILE=[f"{folder}/{n}" for n in listed])
        ownership.record_files(spark.createDataFrame([(new, f"{folder}/{n}") for n in names] + [(new, None)], "ID_SHAPE long, path string"), schema)
        return new

    def remove(*ids):
        return ownership.remove_files(spark, schema, spark.createDataFrame([(i, "x") for i in ids], "ID_SHAPE long, path string"))

    def left():
        return sorted(str(p.relative_to(folder)) for p in folder.rglob("*.csv"))

    first = upload("a/", ["a/1.csv", "a/sub/2.csv", "a/gone.csv"])
    second = upload("a", ["a/3.csv"], listed=["a/1.csv"])
    outside = upload("b", ["b/4.csv", "elsewhere/6.csv"])
    third = upload("c", [])
    nowhere = upload(None, ["c/5.csv"])
    assert remove() == (0, 0) and remove(None, 99) == (0, 0)
    # What another upload owns, even by its list alone, stays, and so does the folder; repeated ids count once.
    assert remove(first, first) == (1, 0) and "a/1.csv" in left() and "a/sub/2.csv" not in left() and "a/3.csv" in left()
    assert remove(first) == (0, 0)
    # A file outside the upload's folder is not touched, a folder that holds another's file stays.
    assert remove(outside, third) == (1, 1) and left() == ["a/1.csv", "a/3.csv", "c/5.csv", "elsewhere/6.csv"]
    assert remove(nowhere) == (0, 0)
    # Paths of a deleted upload do not keep a later one's files.
    assert remove(second) == (2, 1) and not (folder / "a").exists()
    (folder / "a").mkdir()
    (folder / "a/1.csv").write_text("again")
    assert remove(upload("a", ["a/1.csv"])) == (1, 1)


def test_layer_names_are_not_broadcast(spark):
    """Small files may hold long names, so no size that Spark knows lets them go through the driver."""
    req = spark.createDataFrame([("g", n) for n in NAMES], "group_id string, name string")
    for kept in (layers.new_layers(req, req.limit(2)), layers.delete_layers(req, req.limit(2))):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_many_layer_groups(spark, monkeypatch):
    monkeypatch.setattr(layers, "FEW_GROUPS", 0)
    assert groups_of(spark, [*NAMES, "meta"], ["hill_deep"]) == expected_groups([*NAMES, "meta"], ["hill_deep"])


def test_upsert_by_rows_per_task(spark, schema, monkeypatch):
    """More rows take more partitions; the caller's session sees the new table and keeps its settings."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    assert sinks.sized_session(spark, sinks.ROWS_PER_TASK) is spark
    sized = sinks.sized_session(spark, 100 * sinks.ROWS_PER_TASK)
    assert sized.conf.get("spark.sql.shuffle.partitions") == "100" and sized.conf.get("spark.sql.session.timeZone") == "UTC"
    monkeypatch.setattr(sinks, "ROWS_PER_TASK", 3)
    for partition_by in ((), ("group_id",)):
        table = f"t{len(partition_by)}"
        sinks.load_table(spark.range(20).selectExpr("id", "'g' AS group_id", "'old' AS a"), schema, table, partition_by=partition_by)
        assert tables.scan_table(spark, schema, table).count() == 20
        sinks.load_table(spark.range(10, 30).selectExpr("id", "'g' AS group_id", "'new' AS a"), schema, table, "append")
        found = rows(tables.scan_table(spark, schema, table).select("id", "a"), "id")
        assert found == [(i, "old" if i < 10 else "new") for i in range(30)]
    assert spark.conf.get("spark.sql.shuffle.partitions") == usual
