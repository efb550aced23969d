"""Text to value: fixed-width fields, missing markers, file bytes to characters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraload.constants import MISSING_TEXTS, SEPARATORS

# Casts come behind these patterns: a failing cast costs far more than a pattern, and some
# texts (1d, NaN) would be cast although they are not written as numbers.
INTEGER_PATTERN = r"^[+-]?[0-9]++$"
DECIMAL_PATTERN = r"^[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?$"
DAY_PATTERN = r"^(?!0000)[0-9]{4}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])$"

# Bytes 0x80-0x9F mean control characters in ISO-8859-1 and these characters in Windows-1252.
# The five bytes that Windows-1252 leaves undefined come last and are dropped.
_C1_DEFINED = [0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E,
               0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F]
_C1_UNDEFINED = [0x81, 0x8D, 0x8F, 0x90, 0x9D]
_C1_FROM = "".join(chr(b) for b in _C1_DEFINED + _C1_UNDEFINED)
_C1_TO = bytes(_C1_DEFINED).decode("cp1252")


def parse_char(value: Column) -> Column:
    """C field: trimmed, empty means missing."""
    return F.nullif(F.trim(value), F.lit(""))


def parse_integer(value: Column) -> Column:
    """N field without decimals; anything unreadable is missing."""
    text = F.trim(value)
    return F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint"))


def parse_float(value: Column) -> Column:
    """F field, or N field with decimals; anything unreadable is missing."""
    text = F.trim(value)
    return F.when(text.rlike(DECIMAL_PATTERN), text.try_cast("double"))


def parse_date(value: Column) -> Column:
    """D field ``YYYYMMDD``; zero parts and impossible days are missing."""
    text = F.trim(value)
    iso = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.when(text.rlike(DAY_PATTERN), iso.try_cast("date"))


def parse_bool(value: Column) -> Column:
    """L field."""
    text = F.trim(value)
    return F.when(text.isin("T", "t", "Y", "y"), F.lit(True)).when(text.isin("N", "n", "F", "f"), F.lit(False))


def escape_quotes(value: Column, escape: str = "\\") -> Column:
    """Put ``escape`` before every double quote."""
    return F.replace(value, F.lit('"'), F.lit(escape + '"'))


def missing_to_null(value: Column, texts: Sequence[str] = MISSING_TEXTS) -> Column:
    """Texts that mean "missing" become null; with blanks around them they are ordinary texts."""
    return F.when(~value.isin(*texts), value)


def decode_line(raw: Column, encoding: str = "auto") -> Column:
    """Characters of a line whose bytes were read as ISO-8859-1.

    ``auto`` takes UTF-8 where the line is valid UTF-8 and Windows-1252 otherwise;
    with a named encoding, bytes it cannot decode are dropped.
    """
    western = F.translate(raw, _C1_FROM, _C1_TO)
    as_text = F.encode(raw, "ISO-8859-1").cast("string")
    if encoding in ("windows-1252", "iso-8859-1"):
        decoded = western
    elif encoding == "utf-8":
        decoded = F.translate(F.make_valid_utf8(as_text), "\ufffd", "")
    elif encoding == "auto":
        decoded = F.when(F.is_valid_utf8(as_text), as_text).otherwise(western)
    else:
        raise ValueError(f"encoding {encoding!r} is not one of auto, utf-8, windows-1252, iso-8859-1")
    # ASCII is the same in all of them and most lines are ASCII.
    return F.when(F.octet_length(raw) == F.length(raw), raw).otherwise(decoded)


def drop_marks(line: Column) -> Column:
    """Lines lose single quotes; their ends are gone already."""
    return F.replace(line, F.lit("'"), F.lit(""))


def sniff_separator(header: Column, separators: Sequence[str] = SEPARATORS) -> Column:
    """First separator that cuts the header into more than one field; the last one otherwise."""
    choice = F.lit(separators[-1])
    for sep in reversed(separators[:-1]):
        choice = F.when(header.contains(sep), F.lit(sep)).otherwise(choice)
    return choice
