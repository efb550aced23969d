"""Fixed values that decide results."""

# Spark type name -> type label used in manifests.
TYPE_LABELS = {
    "string": "text",
    "date": "text",
    "timestamp": "text",
    "timestamp_ntz": "text",
    "tinyint": "integer",
    "smallint": "integer",
    "int": "integer",
    "bigint": "integer",
    "float": "double precision",
    "double": "double precision",
    "boolean": "boolean",
    "decimal(38,0)": "numeric",
}

# Type label -> Spark type a column is cast to.
LABEL_TYPES = {
    "text": "string",
    "integer": "bigint",
    "double precision": "double",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "numeric": "decimal(38,0)",
}

# Schema names that tenants may not take; they get wrapped in double underscores.
RESERVED_SCHEMAS = ("information_schema", "public", "pg_catalog")

# Characters that become "_" in identifiers.
SPECIAL_CHARACTERS = "-&|+:;%* "

# Reference systems a load may ask for, besides "auto".
ALLOWED_SRIDS = (
    3003, 3004, 23032, 23033, 23034, 32632, 32633, 32634, 25832, 25833, 6707,
    6708, 6709, 6875, 3857, 7794, 26591, 26592, 6705, 102091, 102092,
)

GEOGRAPHIC_SRID = 4326

# File suffix -> format; matched as written, capitals do not count.
FORMAT_SUFFIXES = {
    ".dbf": "dbf",
    ".shp": "shapefile",
    ".csv": "csv",
    ".xls": "excel",
    ".xlsx": "excel",
}

# Column pairs (x, y) that turn a table into a point layer, in order of preference.
COORDINATE_COLUMNS = (("longitudine", "latitudine"), ("longitude", "latitude"))

# Text values that mean "missing" in delimited files and sheets.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Separators tried on a header line, in order.
SEPARATORS = (";", "\t", ",")

LOAD_MODES = ("append", "replace")
