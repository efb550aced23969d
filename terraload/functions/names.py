"""Identifiers: cleaning, lower-casing, table names from paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraload.constants import RESERVED_SCHEMAS, SPECIAL_CHARACTERS

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def clean_identifier(name: Column, reserved: Sequence[str] = RESERVED_SCHEMAS) -> Column:
    """Make a text usable as a table, column or schema name."""
    lowered = F.lower(name)
    wrapped = F.when(lowered.isin(*reserved), F.concat(F.lit("__"), lowered, F.lit("__"))).otherwise(lowered)
    replaced = F.translate(wrapped, SPECIAL_CHARACTERS, "_" * len(SPECIAL_CHARACTERS))
    stripped = F.regexp_replace(replaced, _EDGE_SPACE, "")
    return F.when(stripped.rlike("^[0-9]"), F.concat(F.lit("_"), stripped, F.lit("_"))).otherwise(stripped)


def clean_name(name: str | None, reserved: Sequence[str] = RESERVED_SCHEMAS) -> str | None:
    """The same rule for a name the driver already holds (columns of a schema)."""
    if name is None:
        return None
    text = name.lower()
    if text in reserved:
        text = f"__{text}__"
    text = text.translate({ord(c): "_" for c in SPECIAL_CHARACTERS}).strip()
    return f"_{text}_" if text[:1] in tuple("0123456789") else text


def unique_names(names: Sequence[str]) -> list[str]:
    """Add ``_2``, ``_3`` … to names that repeat, in column order; case does not tell names apart."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, n = name, 1
        while candidate.lower() in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate.lower())
        result.append(candidate)
    return result


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([c.lower() for c in df.columns]))


def base_name(path: Column) -> Column:
    """Last part of a path with either slash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_stem(path: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def table_name(path: Column) -> Column:
    """Table a file is loaded into: its cleaned, lower-case stem."""
    return clean_identifier(file_stem(path))


def quote_name(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def tag_tenant(df: DataFrame, group_id: str | None) -> DataFrame:
    """Mark every row with its tenant; without one the table stays as it is."""
    return df.withColumn("group_id", F.lit(group_id)) if group_id else df
