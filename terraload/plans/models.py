"""Models: SQL templates or functions over tables, and what is done with their outputs."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraload.functions import templates
from terraload.functions.geometry import is_layer_schema
from terraload.functions.names import clean_name, quote_name
from terraload.operators import registry
from terraload.operators.sinks import replace_table
from terraload.plans.publish import publish_layers
from terraload.sources.tables import create_schema, scan_table

# A function model takes tables and parameters by name and returns outputs by name.
Model = Callable[[dict[str, DataFrame], dict], dict]

RESULT = "result"


def classify_outputs(outputs: dict) -> dict:
    """Sort outputs into layers, tables, text output, variables and the rest."""
    sorted_out: dict = {"layers": [], "tables": [], "output": None, "variables": {}, "object": {}}
    for name, value in outputs.items():
        if isinstance(value, DataFrame):
            sorted_out["layers" if is_layer_schema(value.schema) else "tables"].append(name)
        elif name == "output":
            sorted_out["output"] = value
        elif type(value) in (dict, list, str, float, datetime.datetime):
            sorted_out["variables"][name] = value
        else:
            sorted_out["object"][name] = str(value)
    return sorted_out


def quadratic_features(df: DataFrame) -> DataFrame:
    """Add the product ``a*b`` of every unordered pair of whole or decimal columns, squares included."""
    numeric = sorted(f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.DoubleType)))
    products = [
        (F.col(quote_name(a)) * F.col(quote_name(b))).alias(f"{a}*{b}") for a, b in combinations_with_replacement(numeric, 2)
    ]
    return df.select("*", *products)


def pandas_model(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                 schema: str | T.StructType) -> DataFrame:
    """Run a function over a table's batches, where they lie."""
    return df.mapInPandas(function, schema)


def run_sql_model(spark: SparkSession, code: str | dict[str, str], tables: dict[str, DataFrame],
                  params: dict | None = None) -> dict[str, DataFrame]:
    """Run SQL over tables known by name; several outputs run in order and see earlier ones.

    ``%name%`` stands for a value and is bound, never pasted. Temporary views of the caller with the same names are
    put aside meanwhile and are there again afterwards, also when the SQL fails.
    """
    steps = {RESULT: code} if isinstance(code, str) else code
    outputs: dict[str, DataFrame] = {}
    views: list[str] = []
    aside = _temporary_views(spark, [*tables, *steps])
    try:
        for name, table in tables.items():
            table.createOrReplaceTempView(quote_name(name))
            views.append(name)
        for name, text in steps.items():
            sql, args = templates.bind(text, params or {})
            outputs[name] = spark.sql(sql, args=args)
            outputs[name].createOrReplaceTempView(quote_name(name))
            views.append(name)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, view in aside.items():
            view.createOrReplaceTempView(quote_name(name))
    return outputs


def _temporary_views(spark: SparkSession, wanted: list[str]) -> dict[str, DataFrame]:
    """The session's temporary views among some names."""
    found = {}
    for name in wanted:
        try:
            known = spark.catalog.getTable(quote_name(name))
        except AnalysisException:  # no table or view has the name
            continue
        if known.isTemporary:
            found[name] = spark.table(quote_name(name))
    return found


class ModelStore:
    """Models of one registry schema; functions are known to the session that registers them."""

    def __init__(self, spark: SparkSession, registry_schema: str):
        self.spark = spark
        self.registry_schema = registry_schema
        self.functions: dict[int, Model] = {}

    def register(self, group_id: str, model: str | dict[str, str] | Model, trial_tables: dict[str, DataFrame] | None = None,
                 trial_params: dict | None = None) -> dict:
        """Store a model, try it and say what it gives."""
        code = f"function {model.__name__}" if callable(model) else json.dumps(model)
        model_id = registry.insert_request(
            self.spark, self.registry_schema, registry.MODELS, DATE_MODEL=datetime.datetime.now(), STATUS="LOAD MODEL",
            GROUP_ID=group_id, CODE=code, LIBRARY=False)
        if callable(model):
            self.functions[model_id] = model
        report = {"id": model_id, "group_id": group_id}
        if trial_tables is not None:
            report |= classify_outputs(self._outputs(model, trial_tables, trial_params or {}))
        return report

    def load(self, model_id: int) -> str | dict[str, str] | Model:
        if model_id in self.functions:
            return self.functions[model_id]
        models = registry.stored(self.spark, self.registry_schema, registry.MODELS)
        row = registry.get_request(models, registry.MODELS.key, model_id).first()
        if row is None:
            raise KeyError(f"no model {model_id}")
        if row["CODE"].startswith("function "):
            raise ValueError(f"model {model_id} is the {row['CODE']} of another session; register it in this one")
        return json.loads(row["CODE"])

    def _outputs(self, model, tables: dict[str, DataFrame], params: dict) -> dict:
        return model(tables, params) if callable(model) else run_sql_model(self.spark, model, tables, params)

    def input_tables(self, load_id: int) -> dict[str, DataFrame]:
        """Tables that a load wrote, by name, from where it put them; files that failed are left out."""
        outcomes = scan_table(self.spark, self.registry_schema, registry.OUTCOMES)
        named = outcomes.filter((F.col("ID_SHAPE") == load_id) & F.col("ok")).select("schema_name", "table").distinct().collect()
        return {r["table"]: scan_table(self.spark, r["schema_name"], r["table"]) for r in named}

    def execute(self, group_id: str, load_id: int, model_id: int | None, params: dict, mapping: dict[str, str],
                schema_location: str | None = None, code: str | dict[str, str] | Model | None = None) -> dict:
        """Run a stored model, or given code without one, on a load's tables; write its mapped outputs, publish
        those with geometry as layers, and list them."""
        if (model_id is None) == (code is None):
            raise ValueError("give either a model's id or code")
        store = self.registry_schema
        execution = registry.insert_request(
            self.spark, store, registry.EXECUTIONS, DATE_EXECUTION=datetime.datetime.now(), STATUS="Execution MODEL",
            GROUP_ID=group_id, FK_MODEL=model_id, FK_SHAPE=load_id, PARAMS=params, MAPPING_OUTPUT=mapping)
        outputs = self._outputs(self.load(model_id) if code is None else code, self.input_tables(load_id), params)
        written = write_outputs(self.spark, outputs, mapping, group_id, schema_location)
        if written["layers"]:
            publish_layers(self.spark, store, group_id, written["layers"])
        results = json.dumps({**written, "results": outputs.get("output")})
        registry.update_stored(self.spark, store, registry.EXECUTIONS, execution, RESULTS=results)
        return {"id": execution, **written, "results": outputs.get("output")}


def write_outputs(spark: SparkSession, outputs: dict, mapping: dict[str, str], group_id: str,
                  schema_location: str | None = None) -> dict:
    """Write ``{variable: table}`` to the tenant's schema; a variable the model lacks is an error."""
    absent = [v for v in mapping if v not in outputs]
    if absent:
        raise KeyError(f"the model gives no {absent}")
    schema = clean_name(group_id)
    create_schema(spark, schema, schema_location)
    written: dict = {"layers": [], "tables": []}
    for variable, table in mapping.items():
        frame = outputs[variable]
        if isinstance(frame, DataFrame):
            replace_table(frame, schema, table)
            written["layers" if is_layer_schema(frame.schema) else "tables"].append(table)
    return written

