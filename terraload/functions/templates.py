"""``%name%`` parameters in model code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAMETER = r"%([^%]+)%"


def parameter_names(code: Column) -> Column:
    """Names in order of appearance, each once."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(PARAMETER), F.lit(1)))


def fill(code: Column, values: dict[str, Column]) -> Column:
    """Put column values in place of parameters."""
    for name, value in values.items():
        code = F.replace(code, F.lit(f"%{name}%"), value.cast("string"))
    return code


# What bind looks at: quoted text and comments stay as they are, "%%" is a per cent sign.
_PIECES = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|%%|%([A-Za-z_]\w*)%""", re.DOTALL)


def bind(code: str, params: dict) -> tuple[str, dict]:
    """Turn ``%name%`` into named SQL markers with their values.

    Values never enter the SQL text. A name is an identifier outside of quoted text and comments, so
    ``LIKE '%road%'`` stays what it is; ``%%`` stands for one sign. A parameter without a value is an error.
    """
    names = list(dict.fromkeys(m[1] for m in _PIECES.finditer(code) if m[1]))
    absent = [n for n in names if n not in params]
    if absent:
        raise KeyError(f"no value for model parameters {absent}")
    markers = {n: f"p{i}_{n}" for i, n in enumerate(names)}
    text = _PIECES.sub(lambda m: f":{markers[m[1]]}" if m[1] else "%" if m[0] == "%%" else m[0], code)
    return text, {markers[n]: params[n] for n in names}
