"""Readers: files written from the given tables must give the tables back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraload.checks import bindings as b
from terraload.checks import sample_files as samples
from terraload.checks.catalog import check
from terraload.constants import SEPARATORS
from terraload.functions import digest, geometry, names, parsing
from terraload.runtime import new_path, stage
from terraload.sources import archive, dbf, delimited, files, shapefile, tables, xlsx

LON = "(CAST(user_id % 360 AS DOUBLE) - 180)"
LAT = "(CAST(event_id % 181 AS DOUBLE) - 90)"


def _doc_id(entry):
    return F.regexp_extract(entry, r"Doc-([0-9]+)\.", 1).cast("bigint")


@check("scan_zip", """
    SELECT doc_id, source, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS md5 FROM documents""")
def scan_zip(spark, sf_dir):
    found = archive.scan_archives(spark, b.document_zips(spark, sf_dir))
    return found.select(_doc_id("entry").alias("doc_id"), F.split_part("entry", F.lit("/"), F.lit(1)).alias("source"),
                        "size", F.md5("content").alias("md5"))


ODD_NAMES = ("part[1].csv", "part{a,b}*.csv", "_part.csv", ".part.csv")


@check("scan_csv_odd_names", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_csv_odd_names(spark, sf_dir):
    """Files whose names are patterns, or begin with a mark."""
    customer = b.table(spark, sf_dir, "customer")

    def write(path):
        line = F.concat_ws(";", "c_custkey", "c_name", "c_acctbal").alias("line")
        for k, name in enumerate(ODD_NAMES):
            samples.write_files(customer.filter(F.col("c_custkey") % len(ODD_NAMES) == k).select(line), "c_custkey;c_name;c_acctbal", path, name)

    folder = b.once(spark, sf_dir, "csv-odd-names", write)
    read = [delimited.read_text_columns(spark, path) for path, _ in files.list_files(folder) if path.endswith(".csv")]
    return reduce(DataFrame.unionByName, read).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


RANGE_SIZES = (997, 20_000, 1 << 24)


@check("scan_csv_line_ends", f"""
    SELECT range_bytes, c_custkey, c_name || chr(10) || '"' || c_mktsegment || '";' || chr(10) AS note, c_acctbal
    FROM customer, (VALUES {", ".join(f"({n}::BIGINT)" for n in RANGE_SIZES)}) AS sizes(range_bytes)
    WHERE range_bytes >= 20000 OR c_custkey % 10 = 0""")
def scan_csv_line_ends(spark, sf_dir):
    """Quoted fields over several lines, with quotes and separators in them, cut into ranges of several sizes."""
    def write(path, customer):
        note = F.concat("c_name", F.lit('\n""'), "c_mktsegment", F.lit('"";\n'))
        line = F.concat(F.col("c_custkey").cast("string"), F.lit(';"'), note, F.lit('";'), F.col("c_acctbal").cast("string"))
        samples.write_lines(customer.select(line.alias("line")), "c_custkey;note;c_acctbal", path)

    customer = b.table(spark, sf_dir, "customer")
    whole = b.once(spark, sf_dir, "csv-line-ends", lambda path: write(path, customer))
    tenth = b.once(spark, sf_dir, "csv-line-ends-tenth", lambda path: write(path, customer.filter("c_custkey % 10 = 0")))
    parts = [delimited.read_text_columns(spark, whole if n >= 20_000 else tenth, range_bytes=n).withColumn("range_bytes", F.lit(n).cast("bigint")) for n in RANGE_SIZES]
    return reduce(DataFrame.unionByName, parts).select("range_bytes", F.col("c_custkey").cast("bigint").alias("c_custkey"), "note",
                                                       F.col("c_acctbal").cast("double").alias("c_acctbal"))


@check("scan_csv_control_marks", """
    SELECT c_custkey, chr(1) || c_name || chr(2) AS name, c_mktsegment || chr(1) AS segment, c_acctbal FROM customer""")
def scan_csv_control_marks(spark, sf_dir):
    """Fields that hold control characters."""
    def write(path):
        line = F.concat_ws(";", "c_custkey", F.concat(F.lit("\u0001"), "c_name", F.lit("\u0002")), F.concat("c_mktsegment", F.lit("\u0001")), "c_acctbal")
        samples.write_files(b.table(spark, sf_dir, "customer").select(line.alias("line")), "c_custkey;name;segment;c_acctbal", path, "marks.csv")

    text = delimited.read_text_columns(spark, b.once(spark, sf_dir, "csv-marks", write))
    return text.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "name", "segment", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@check("scan_csv_mixed_headers", """
    SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer""")
def scan_csv_mixed_headers(spark, sf_dir):
    """A folder whose files order their columns differently; one lacks a column."""
    customer = b.table(spark, sf_dir, "customer")

    def write(path):
        for k, header in enumerate(("c_custkey;c_name;c_acctbal", "c_acctbal,c_name,c_custkey", "c_name;c_custkey")):
            line = F.concat_ws("," if "," in header else ";", *header.replace(",", ";").split(";"))
            samples.write_files(customer.filter(F.col("c_custkey") % 3 == k).select(line.alias("line")), header, path, f"{k}_.csv")

    text = delimited.read_text_columns(spark, b.once(spark, sf_dir, "csv-mixed", write))
    return text.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@check("scan_zip_same_entries", "SELECT doc_id % 3 AS folder, doc_id // 3 AS number, md5(text) AS md5 FROM documents")
def scan_zip_same_entries(spark, sf_dir):
    """Archives whose entries have equal names are unpacked side by side."""
    target = new_path(spark, "same-entries")
    stage(archive.extract_archives(spark, b.same_entry_zips(spark, sf_dir), target), "entries")
    place = r"/([0-9]+)/archive_[^/]+\.zip/data/r([0-9]+)\.csv$"
    return archive.content_md5(spark, target).select(
        F.regexp_extract("path", place, 1).cast("bigint").alias("folder"), F.regexp_extract("path", place, 2).cast("bigint").alias("number"), "md5")


_EXT = "CASE doc_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'dbf' WHEN 2 THEN 'shp' WHEN 3 THEN 'xlsx' ELSE 'txt' END"


@check("file_inventory", f"""
    SELECT doc_id, 'Doc-' || doc_id || '.' || ext AS filename, ext, 'doc_' || doc_id AS "table",
           CASE ext WHEN 'shp' THEN 'shapefile' WHEN 'xlsx' THEN 'excel' ELSE ext END AS format,
           CAST(octet_length(encode(text)) AS BIGINT) AS size
    FROM (SELECT *, {_EXT} AS ext FROM documents) WHERE ext <> 'txt'""")
def file_inventory(spark, sf_dir):
    entries = archive.archive_entries(spark, b.document_zips(spark, sf_dir))
    found = archive.inventory(entries.select(F.col("entry").alias("path"), "size"))
    return found.select(_doc_id("path").alias("doc_id"), "filename", "ext", "table", "format", "size")


@check("files_per_format", f"""
    SELECT {_EXT} AS ext, count(*) AS n_files FROM documents WHERE {_EXT} <> 'txt' GROUP BY 1""")
def files_per_format(spark, sf_dir):
    entries = archive.archive_entries(spark, b.document_zips(spark, sf_dir))
    return archive.files_per_format(archive.inventory(entries.select(F.col("entry").alias("path"))))


_SHARED = """
    SELECT doc_id, source || '/f' || (doc_id // 3) AS stem,
           CASE (doc_id + n_chars) % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'dbf' WHEN 2 THEN 'shp' ELSE 'xls' END AS ext
    FROM documents"""


@check("exclude_sidecars", f"""
    WITH f AS ({_SHARED}), g AS (SELECT *, split_part(stem, '/', 2) AS base FROM f)
    SELECT doc_id, stem || '.' || ext AS path FROM g
    WHERE ext = 'shp' OR NOT EXISTS (SELECT 1 FROM g s WHERE s.ext = 'shp' AND s.base = g.base)""")
def exclude_sidecars(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("csv", "dbf", "shp", "xls")]),
                          ((F.col("doc_id") + F.col("n_chars")) % 4 + 1).cast("int"))
    path = F.concat("source", F.lit("/f"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("."), suffix)
    docs = b.table(spark, sf_dir, "documents").select(path.alias("path"), "doc_id")
    return archive.exclude_sidecars(archive.inventory(docs)).select("doc_id", "path")


@check("path_table_name", r"""
    SELECT page_id, path, regexp_replace(split_part(replace(path, '\', '/'), '/', -1), '\.[^.]*$', '') AS stem,
           CASE WHEN regexp_matches(n, '^[0-9]') THEN '_' || n || '_' ELSE n END AS "table"
    FROM (SELECT *, translate(lower(regexp_replace(split_part(replace(path, '\', '/'), '/', -1), '\.[^.]*$', '')),
                              '-&|+:;%* ', '_________') AS n
          FROM (SELECT page_id, 'up\' || replace(url, '.', '-') || CASE page_id % 3 WHEN 0 THEN '/9 A.dbf'
                                    WHEN 1 THEN '\Area+Tot.xlsx' ELSE '/noext' END AS path FROM pages))""")
def path_table_name(spark, sf_dir):
    tail = F.element_at(F.array(F.lit("/9 A.dbf"), F.lit("\\Area+Tot.xlsx"), F.lit("/noext")), (F.col("page_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("up\\"), F.replace("url", F.lit("."), F.lit("-")), tail)
    return b.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select(
        "page_id", "path", names.file_stem(F.col("path")).alias("stem"), names.table_name(F.col("path")).alias("table"))


@check("content_md5", """
    WITH e AS (SELECT source, md5(source || '/' || name || ' ' || md5(text)) AS h
               FROM (SELECT *, 'Doc-' || doc_id || '.' || %s AS name FROM documents)),
    w AS (SELECT source, count(*) AS n,
                 sum(('0x' || substr(h, 1, 8))::BIGINT) AS a, sum(('0x' || substr(h, 9, 8))::BIGINT) AS b,
                 sum(('0x' || substr(h, 17, 8))::BIGINT) AS c, sum(('0x' || substr(h, 25, 8))::BIGINT) AS d
          FROM e GROUP BY source)
    SELECT source, n AS n_files, md5(n || '-' || a || '-' || b || '-' || c || '-' || d) AS digest FROM w""" % _EXT)
def content_md5(spark, sf_dir):
    def unpack(path):
        archive.extract_archives(spark, b.document_zips(spark, sf_dir), path).agg(F.sum("size")).collect()

    root = b.once(spark, sf_dir, "unpacked", unpack)
    files = archive.content_md5(spark, root).withColumn("path", F.substring_index("path", "/", -2))
    return digest.folder_digest(files.withColumn("source", F.split_part("path", F.lit("/"), F.lit(1))), ["source"])


_CUSTOMER = """c_custkey, 'd' || c_name AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
           'é ' || c_mktsegment AS "qualità" """


@check("scan_csv_sniffed", f"SELECT {_CUSTOMER}, 'acme' AS group_id FROM customer")
def scan_csv_sniffed(spark, sf_dir):
    return delimited.read_delimited(spark, b.customer_csv(spark, sf_dir, False), group_id="acme")


@check("csv_skip_bad", f"""
    SELECT {_CUSTOMER} FROM customer UNION ALL
    SELECT c_custkey, 'q;' || c_name, NULL, NULL, NULL FROM customer""")
def csv_skip_bad(spark, sf_dir):
    return delimited.read_delimited(spark, b.customer_csv(spark, sf_dir, True))


@check("sniff_separator", r"""
    SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'semicolon' WHEN 1 THEN 'tab' ELSE 'comma' END AS separator FROM customer""")
def sniff_separator(spark, sf_dir):
    fields = ("c_name", "c_mktsegment", "c_acctbal")
    joined = F.element_at(F.array(*[F.concat_ws(s, *fields) for s in SEPARATORS]), F.col("c_nationkey") % 3 + 1)
    named = F.create_map(*[F.lit(v) for v in (";", "semicolon", "\t", "tab", ",", "comma")])
    return b.table(spark, sf_dir, "customer").select(
        "c_custkey", F.element_at(named, parsing.sniff_separator(joined)).alias("separator"))


@check("scan_dbf", """
    SELECT o_orderkey AS o_key, CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice END AS o_price,
           CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS o_date,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_prio,
           CASE WHEN o_orderstatus = 'O' THEN true WHEN o_custkey > 700 THEN NULL ELSE false END AS o_open,
           CASE WHEN o_custkey > 100 THEN o_totalprice * 2 END AS o_factor
    FROM orders WHERE o_orderstatus <> 'P'""")
def scan_dbf(spark, sf_dir):
    return dbf.read_dbf(spark, b.order_dbf(spark, sf_dir), splitBytes=200_000)


@check("scan_dbf_wide_numbers", """
    SELECT o_orderkey AS o_key, CAST('12345678901234567' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS DECIMAL(38, 0)) AS o_wide FROM orders""")
def scan_dbf_wide_numbers(spark, sf_dir):
    """Whole numbers of 25 digits."""
    fields = [("O_KEY", "N", 12, 0), ("O_WIDE", "N", 25, 0)]

    def write(path):
        wide = F.concat(F.lit("12345678901234567"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
        record = samples.dbf_record(fields, [F.col("o_orderkey"), wide], F.lit(False))
        samples.write_dbf(b.table(spark, sf_dir, "orders").select(record.alias("record")), fields, path)

    return dbf.read_dbf(spark, b.once(spark, sf_dir, "dbf-wide", write))


@check("scan_dbf_fractions", "SELECT o_orderkey AS o_key, o_totalprice AS o_price, o_custkey AS o_cust FROM orders")
def scan_dbf_fractions(spark, sf_dir):
    """A column declared whole that holds fractions."""
    fields = [("O_KEY", "N", 12, 0), ("O_PRICE", "N", 14, 0), ("O_CUST", "N", 12, 0)]

    def write(path):
        record = samples.dbf_record(fields, [F.col("o_orderkey"), F.format_string("%.2f", "o_totalprice"), F.col("o_custkey")], F.lit(False))
        samples.write_dbf(b.table(spark, sf_dir, "orders").select(record.alias("record")), fields, path)

    folder = b.once(spark, sf_dir, "dbf-fractions", write)
    by_values = dbf.read_dbf(spark, folder)
    by_labels = dbf.read_dbf(spark, folder, labels={"o_key": "integer", "o_price": "double precision", "o_cust": "integer"})
    assert by_values.schema == by_labels.schema
    return by_labels


@check("scan_dbf_codepage", """
    SELECT kind, c_custkey, 'Ж' || c_name AS c_name FROM customer, (VALUES ('header'), ('beside'), ('utf')) k(kind)""")
def scan_dbf_codepage(spark, sf_dir):
    """Letters of another code page, told by the header, by a file beside the table, or UTF-8."""
    fields = [("C_CUSTKEY", "N", 12, 0), ("C_NAME", "C", 40, 0)]
    name = F.concat(F.lit("Ж"), "c_name")
    kinds = {"header": ("cp1251", 0xC9, None), "beside": ("cp866", 0, "866"), "utf": ("utf-8", 0x57, "UTF-8")}

    def write(path):
        for kind, (encoding, language, cpg) in kinds.items():
            # In UTF-8 the letter takes two of the field's bytes.
            own = fields if encoding != "utf-8" else [fields[0], ("C_NAME", "C", 39, 0)]
            record = samples.dbf_record(own, [F.col("c_custkey"), name], F.lit(False))
            samples.write_dbf(b.table(spark, sf_dir, "customer").select(record.alias("record")), fields, f"{path}/{kind}", encoding, language, cpg)

    folder = b.once(spark, sf_dir, "dbf-codepage", write)
    read = [dbf.read_dbf(spark, f"{folder}/{kind}").select(F.lit(kind).alias("kind"), "c_custkey", "c_name") for kind in kinds]
    return reduce(DataFrame.unionByName, read)


def _shape_scalars(df, *more):
    v = F.col("geometry")["coords"][0][0][0]
    g = F.col("geometry")
    return df.select("event_id", v["x"].alias("x"), v["y"].alias("y"), g["srid"].alias("srid"), g["gtype"].alias("gtype"),
                     g["has_z"].alias("has_z"), *more)


@check("scan_shapefile", f"""
    SELECT event_id, {LON} AS x, {LAT} AS y, 32633 AS srid, 'Point' AS gtype, false AS has_z, event_type AS kind,
           CAST(value AS DECIMAL(14, 3)) AS value FROM events""")
def scan_shapefile(spark, sf_dir):
    read = shapefile.read_shapefile(spark, b.point_files(spark, sf_dir, False), splitBytes=50_000)
    return _shape_scalars(read, "kind", F.col("value").cast("decimal(14,3)").alias("value"))


@check("scan_shapefile_without_index", f"""
    SELECT event_id, {LON} AS x, {LAT} AS y, 32633 AS srid, 'Point' AS gtype, true AS has_z, value AS z, event_type AS kind FROM events""")
def scan_shapefile_without_index(spark, sf_dir):
    """Many byte ranges a file, none of which begins at a record."""
    read = shapefile.read_shapefile(spark, b.point_files(spark, sf_dir, True), index="false", splitBytes=5_001)
    return _shape_scalars(read, F.col("geometry")["coords"][0][0][0]["z"].alias("z"), "kind")


@check("geom_type_z", f"""
    SELECT event_id, {LON} AS x, {LAT} AS y, 32632 AS srid, 'Point' AS gtype, true AS has_z, value AS z,
           1 AS n_vertices, 'geometry(PointZ,32632)' AS label FROM events""")
def geom_type_z(spark, sf_dir):
    read = shapefile.read_shapefile(spark, b.point_files(spark, sf_dir, True), srid=32632, columns=["event_id"])
    g = F.col("geometry")
    return _shape_scalars(read, g["coords"][0][0][0]["z"].alias("z"), geometry.vertex_count(g).alias("n_vertices"),
                          geometry.geometry_label(g["gtype"], g["has_z"], g["srid"]).alias("label"))


@check("scan_xlsx_sheets", """
    SELECT 'accounts' AS sheet, c_custkey, c_name, c_acctbal, NULL AS c_mktsegment FROM customer UNION ALL
    SELECT 'Market Segments', c_custkey, NULL, NULL, c_mktsegment FROM customer""")
def scan_xlsx_sheets(spark, sf_dir):
    rows = xlsx.scan_sheets(spark, b.customer_books(spark, sf_dir)).filter("row_no > 1")
    cell = [F.get("cells", F.lit(i))["value"] for i in range(3)]
    first = F.col("sheet") == "accounts"
    return rows.select(
        "sheet", cell[0].try_cast("bigint").alias("c_custkey"), F.when(first, cell[1]).alias("c_name"),
        F.when(first, cell[2].try_cast("double")).alias("c_acctbal"), F.when(~first, cell[1]).alias("c_mktsegment"))


@check("read_xlsx_typed", """
    SELECT c_custkey, c_name, c_acctbal, c_mktsegment AS segment, 'acme' AS group_id FROM customer""")
def read_xlsx_typed(spark, sf_dir):
    """Typed tables of all workbooks' sheets; the two sheets of a book meet again by their key."""
    paths = [r["path"] for r in archive.list_paths(spark, b.customer_books(spark, sf_dir), ".xlsx").select("path").collect()]
    books = [xlsx.read_xlsx(spark, path, "acme") for path in paths]
    accounts, segments = (reduce(DataFrame.unionByName, [book[s] for book in books]) for s in ("accounts", "Market Segments"))
    return accounts.join(segments.select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey")


@check("scan_table", "SELECT * FROM orders")
def scan_table(spark, sf_dir):
    schema = b.check_schema(spark)
    b.table(spark, sf_dir, "orders").write.saveAsTable(names.quote_name(schema, "orders"))
    return tables.scan_table(spark, schema, "orders")


@check("named_tables", """
    SELECT 'customer' AS name, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier
    UNION ALL SELECT 'customer again', c_custkey FROM customer""")
def named_tables(spark, sf_dir):
    schema = b.check_schema(spark)

    def read(name):
        source = b.table(spark, sf_dir, name)
        return source.toDF(*[c.upper() for c in source.columns])

    def unread(name):
        raise AssertionError(f"{name} is stored already")

    first = tables.named_tables(spark, ["customer", "supplier"], schema, read)
    again = tables.named_tables(spark, "customer", schema, unread)
    return (
        first["customer"].select(F.lit("customer").alias("name"), F.col("c_custkey").alias("id"))
        .unionByName(first["supplier"].select(F.lit("supplier").alias("name"), F.col("s_suppkey").alias("id")))
        .unionByName(again["customer"].select(F.lit("customer again").alias("name"), F.col("c_custkey").alias("id"))))


@check("parse_dbf_number", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
           CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_partkey END AS whole,
           CASE WHEN l_returnflag = 'N' THEN l_partkey + 0.5 WHEN l_returnflag = 'A' THEN l_partkey END::DOUBLE AS decimal
    FROM lineitem""")
def parse_dbf_number(spark, sf_dir):
    key = F.col("l_partkey").cast("string")
    whole = F.when(F.col("l_returnflag") == "R", F.lit("*****")).otherwise(F.lpad(key, 12, " "))
    decimal = F.when(F.col("l_returnflag") == "N", F.concat(key, F.lit(".5"))).when(F.col("l_returnflag") == "A", key).otherwise("   ")
    return b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", parsing.parse_integer(whole).alias("whole"),
        parsing.parse_float(decimal).alias("decimal"))


@check("parse_dbf_float", """
    SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events""")
def parse_dbf_float(spark, sf_dir):
    text = F.when(F.col("event_type") == "click", F.lit("n/a")).otherwise(F.lpad(F.col("value").cast("string"), 20, " "))
    return b.table(spark, sf_dir, "events").select("event_id", parsing.parse_float(text).alias("value"))


@check("parse_dbf_date", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def parse_dbf_date(spark, sf_dir):
    good = F.date_format("o_orderdate", "yyyyMMdd")
    impossible = F.concat(F.year("o_orderdate").cast("string"), F.lit("0230"))
    zero_part = F.concat(F.year("o_orderdate").cast("string"), F.lit("0011"))
    text = F.when(F.col("o_orderstatus") == "O", good).when(F.col("o_orderstatus") == "F", impossible).otherwise(zero_part)
    return b.table(spark, sf_dir, "orders").select("o_orderkey", parsing.parse_date(text).alias("day"))


@check("parse_dbf_bool", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
           CASE WHEN l_linenumber IN (1, 2, 3, 4) THEN true WHEN l_linenumber IN (5, 6) THEN false END AS flag
    FROM lineitem""")
def parse_dbf_bool(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(c) for c in ("T", "t", "Y", "y", "F", "n", "?")]), F.col("l_linenumber"))
    return b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", parsing.parse_bool(text).alias("flag"))


@check("parse_dbf_char", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS label FROM orders""")
def parse_dbf_char(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "F", F.lit("    ")).otherwise(F.rpad("o_orderpriority", 20, " "))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", parsing.parse_char(text).alias("label"))


