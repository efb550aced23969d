"""Type labels and types inferred from values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraload.constants import LABEL_TYPES, TYPE_LABELS
from terraload.functions.parsing import DECIMAL_PATTERN, parse_float, parse_integer

# Bits a value sets, one per kind of text it is.
_WHOLE, _DECIMAL, _BOOL, _DATE, _OTHER = 1, 2, 4, 8, 16


def type_label(data_type: T.DataType) -> str:
    name = data_type.simpleString()
    if name not in TYPE_LABELS:
        raise ValueError(f"type {name} has no label")
    return TYPE_LABELS[name]


def spark_type(label: str) -> str:
    """Spark type for a label; timestamps and dates may be named as such."""
    key = label.strip().lower()
    if key not in LABEL_TYPES:
        raise ValueError(f"unknown type label {label!r}")
    return LABEL_TYPES[key]


def value_kind(value: Column, dates: bool) -> Column:
    """Bit for the kind of a text without blanks around it."""
    # The first character tells most texts from numbers and days; only the rest meet a pattern.
    numeric = F.substring(value, 1, 1).between("+", "9")
    fraction = value.contains(".") | value.contains("e") | value.contains("E")
    number = F.when(~fraction & value.try_cast("bigint").isNotNull(), F.lit(_WHOLE)).otherwise(F.lit(_DECIMAL))
    kind = (
        F.when(numeric & value.rlike(DECIMAL_PATTERN), number)
        .when(value.isin("True", "False", "TRUE", "FALSE", "true", "false"), F.lit(_BOOL))
    )
    if dates:
        is_date = numeric & value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
        kind = kind.when(is_date, F.lit(_DATE))
    return F.when(value.isNotNull(), kind.otherwise(F.lit(_OTHER)))


def label_of_kinds(mask: Column) -> Column:
    """Smallest type that holds every kind seen; a column without values counts as decimal."""
    return (
        F.when(mask.isNull(), F.lit("double precision"))
        .when(mask == _WHOLE, F.lit("integer"))
        .when(mask.isin(_DECIMAL, _WHOLE | _DECIMAL), F.lit("double precision"))
        .when(mask == _BOOL, F.lit("boolean"))
        .when(mask == _DATE, F.lit("date"))
        .otherwise(F.lit("text"))
    )


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, dates: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(ordinal, column, tipo, n_values)`` for text columns, with ``by`` for each group of rows.

    One pass with one bit mask per column, so nothing but the masks is shuffled.
    """
    names = list(columns or [c for c in df.columns if c not in by])
    # As a generator the trimming is one step; below an aggregate it would be repeated in every test.
    bare = df.select(*by, F.inline(F.array(F.struct(*[F.trim(F.col(f"`{n}`")).alias(f"t{i}") for i, n in enumerate(names)]))))
    masks = bare.groupBy(*by).agg(*[
        F.struct(F.bit_or(value_kind(F.col(f"t{i}"), dates)).alias("mask"), F.count(F.col(f"t{i}")).alias("n"))
        .alias(f"c{i}") for i in range(len(names))
    ])
    rows = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column"), F.col(f"c{i}.mask").alias("mask"),
                 F.col(f"c{i}.n").alias("n_values")) for i, n in enumerate(names)
    ])
    return masks.select(*by, F.inline(rows)).select(
        *by, "ordinal", "column", label_of_kinds(F.col("mask")).alias("tipo"), "n_values"
    )


def inferred_labels(df: DataFrame, dates: bool = True) -> dict[str, str]:
    """The same as a dict; its size is the number of columns."""
    return {r["column"]: r["tipo"] for r in infer_types(df, dates=dates).collect()}


def cast_value(value: Column, source: T.DataType, target: str) -> Column:
    """Value in another Spark type; what does not fit becomes null."""
    if isinstance(source, T.StringType):
        if target == "bigint":
            return parse_integer(value)
        if target == "double":
            return parse_float(value)
    return value.try_cast(target)


def to_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Give text columns the types their labels name."""
    return df.select(*[
        (cast_value(F.col(f"`{c}`"), T.StringType(), spark_type(labels[c])).alias(c) if c in labels else F.col(f"`{c}`"))
        for c in df.columns
    ])
