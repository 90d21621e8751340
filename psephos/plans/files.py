"""Queries of sources and sinks: given tables are written in each format and read back by its source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import archives, delimited, documents, snapshots, staging
from .catalog import register, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@register(
    "bronze_scan",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, 'made' AS source_id, '2026-01-02' AS snapshot_date,
    sha256('{"c_custkey":"' || c_custkey || '","c_name":"' || c_name || '","c_nationkey":"' || c_nationkey || '","c_mktsegment":"' || c_mktsegment || '"}') AS row_hash FROM customer""",
)
def bronze_scan(spark, sf_dir):
    """Customers as tab-separated files, whose delimiter is found, read as text with lineage."""
    path = _folder(spark, "tsv")
    _customers(spark, sf_dir).write.option("header", True).option("sep", "\t").csv(path)
    return delimited.bronze(spark, path, "made", "2026-01-02").drop("source_file")


@register("path_values", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def path_values(spark, sf_dir):
    """Orders in a folder for each year, whose name gives the rows their year."""
    path = _folder(spark, "by-year")
    table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")).write.partitionBy("year").option("header", True).csv(path)
    rows = spark.read.option("recursiveFileLookup", True).option("header", True).csv(path).withColumn("year", delimited.path_value("year"))
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.min(F.col("o_orderkey").cast("bigint")).alias("first_key"))


@register("files_of", "SELECT DISTINCT 'n_nationkey=' || n_nationkey AS folder FROM nation WHERE n_regionkey <> 2")
def files_of(spark, sf_dir):
    """Nations in a folder each; those of a region lie below a documentation folder's name and are not found."""
    path = _folder(spark, "scan")
    rows = table(spark, sf_dir, "nation")
    for kept, name in ((F.col("n_regionkey") != 2, "data"), (F.col("n_regionkey") == 2, "old")):
        rows.where(kept).select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").option("compression", "none").text(f"{path}/{name}")
    found = delimited.files_of(spark, f"{path}/data", "*.txt")
    return found.select(F.regexp_extract("path", "(n_nationkey=[0-9]+)", 1).alias("folder")).distinct()


@register("commented_csv", "SELECT CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_custkey AS VARCHAR) AS customer FROM customer")
def commented_csv(spark, sf_dir):
    """Files of a nation's customers with lines of # above the header."""
    path = _folder(spark, "commented")
    text = F.concat(F.lit("# made\n# nation "), F.col("c_nationkey").cast("string"), F.lit("\nnation,customer\n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")))), "\n"))
    table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(text.alias("value")).write.partitionBy("c_nationkey").text(path)
    return delimited.commented(spark, f"{path}/*", "nation string, customer string")


_NAMES = "SELECT c_custkey, 'Señor ' || c_name || ' ß' AS said FROM customer"


@register("headerless_latin", f"SELECT CAST(c_custkey AS VARCHAR) AS k, said FROM ({_NAMES})")
def headerless_latin(spark, sf_dir):
    """Semicolon files in Latin-1 without a header."""
    path = _folder(spark, "latin")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Señor "), "c_name", F.lit(" ß")).alias("said"))
    rows.write.option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return delimited.headerless(spark, path, ["k", "said"])


@register("any_charset", f"SELECT c_custkey % 3 AS charset, said AS line FROM ({_NAMES})")
def any_charset(spark, sf_dir):
    """Lines in UTF-8, UTF-16 with a mark and Latin-1, told apart file by file."""
    path = _folder(spark, "charsets")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Señor "), "c_name", F.lit(" ß")).alias("said"))
    for k, encoding in enumerate(("UTF-8", "UTF-16", "ISO-8859-1")):
        rows.where(F.col("c_custkey") % 3 == k).select("said").write.option("encoding", encoding).option("emptyValue", "").csv(f"{path}/{k}")
    found = delimited.any_charset(spark, f"{path}/*/*.csv").where("line <> ''")
    return found.select(F.regexp_extract("path", "/([0-2])/[^/]*$", 1).cast("bigint").alias("charset"), "line")


@register("zip_lines", "SELECT 'a' || (o_custkey % 4) || '.zip' AS archive, o_orderstatus || '.txt' AS member, CAST(row_number() OVER (PARTITION BY o_custkey % 4, o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS pos, o_orderkey AS k FROM orders")
def zip_lines(spark, sf_dir):
    """Orders in zip archives with a member for each status, read by a task for each member."""
    path = _folder(spark, "zips")
    o = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("a"), (F.col("o_custkey") % 4).cast("string"), F.lit(".zip")).alias("archive"), F.concat("o_orderstatus", F.lit(".txt")).alias("member"))
    archives.write_archives(o.agg(F.concat(F.lit("key\r\n"), F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), "\r\n")).alias("content")), path)
    found = documents.zip_lines(spark, path, ".*[.]txt").where("pos > 0")
    return found.select(F.substring_index("path", "/", -1).alias("archive"), "member", "pos", F.col("line").cast("bigint").alias("k"))


_BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Votes" r:id="a"/></sheets></workbook>'
_RELS = '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>'


@register("sheet_rows", "SELECT 'book' || (c_nationkey % 5) || '.xlsx' AS book, CAST(c_custkey AS VARCHAR) AS customer, c_mktsegment AS segment FROM customer")
def sheet_rows(spark, sf_dir):
    """Customers in workbooks, by the names in the sheet's header row."""
    path = _folder(spark, "books")
    book = F.concat(F.lit("book"), (F.col("c_nationkey") % 5).cast("string"), F.lit(".xlsx"))
    rows = table(spark, sf_dir, "customer").select(book.alias("archive"), "c_custkey", "c_mktsegment", (F.row_number().over(Window.partitionBy(book).orderBy("c_custkey")) + 1).cast("string").alias("n"))
    cell = lambda at, value: F.concat(F.lit(f'<c r="{at}'), F.col("n"), F.lit('" t="inlineStr"><is><t>'), value, F.lit("</t></is></c>"))
    line = F.concat(F.lit('<row r="'), "n", F.lit('">'), cell("A", F.col("c_custkey").cast("string")), cell("C", F.col("c_mktsegment")), F.lit("</row>"))
    head = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Customer</t></is></c><c r="C1" t="inlineStr"><is><t>Segment</t></is></c></row>'
    sheet = rows.groupBy("archive").agg(F.concat(F.lit(head), F.array_join(F.collect_list(line), ""), F.lit("</sheetData></worksheet>")).alias("content"))
    fixed = sheet.select("archive", F.explode(F.array(F.struct(F.lit("xl/workbook.xml").alias("member"), F.lit(_BOOK).alias("content")), F.struct(F.lit("xl/_rels/workbook.xml.rels").alias("member"), F.lit(_RELS).alias("content")))).alias("m")).select("archive", "m.*")
    archives.write_archives(sheet.select("archive", F.lit("xl/worksheets/sheet1.xml").alias("member"), "content").unionByName(fixed), path)
    found = documents.with_header(documents.sheet_cells(spark, path, "Votes"), ["path", "sheet"], 1, ["Customer", "Segment"])
    return found.select(F.substring_index("path", "/", -1).alias("book"), "customer", "segment")


@register("xml_contests", "SELECT 'Nation ' || c_nationkey AS contest, c_name AS choice, c_mktsegment AS party, CAST(floor(abs(c_acctbal)) AS BIGINT) AS votes FROM customer")
def xml_contests(spark, sf_dir):
    """Contests of nations with a choice for each customer, as XML."""
    path = _folder(spark, "xml")
    choice = F.struct(F.col("c_mktsegment").alias("_party"), F.col("c_name").alias("_text"), F.floor(F.abs("c_acctbal")).cast("bigint").alias("_totalVotes"))
    rows = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("_text")).agg(F.collect_list(choice).alias("Choice"))
    rows.write.format("xml").option("rowTag", "Contest").option("rootTag", "Result").save(path)
    return documents.xml_contests(spark, path)


@register("json_pages", "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders")
def json_pages(spark, sf_dir):
    """Orders as pages of an API: an object with a list of results in a file of its own, by the customers' last digit."""
    path = _folder(spark, "json")
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("page")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))).alias("results"))
    rows.write.partitionBy("page").json(path)
    return documents.json_pages(spark, f"{path}/*", "k:bigint,status:string")


@register("keyed_json", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_nationkey AS nation FROM customer")
def keyed_json(spark, sf_dir):
    """Customers as one object of objects for each nation, in a file each."""
    path = _folder(spark, "keyed")
    entry = F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))))
    rows = table(spark, sf_dir, "customer").withColumn("n", F.col("c_nationkey")).groupBy("n").agg(F.to_json(entry).alias("value"))
    rows.write.partitionBy("n").text(path)
    return documents.keyed_json(spark, f"{path}/*", "name:string,nation:bigint")


@register("matrix_json", "SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def matrix_json(spark, sf_dir):
    """Nations as one array of arrays below a header row."""
    path = _folder(spark, "matrix")
    row = F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    rows = table(spark, sf_dir, "nation").agg(F.to_json(F.concat(F.array(F.array(F.lit("NATION"), F.lit("name"), F.lit(" region "))), F.sort_array(F.collect_list(row)))).alias("value"))
    rows.write.text(path)
    return documents.matrix_json(spark, path)


@register("csv_mirror", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def csv_mirror(spark, sf_dir):
    """The CSV side of a mirrored table, where the Parquet side has the same rows; all of them, or none where they differ."""
    path = _folder(spark, "mirror")
    snapshots.write_mirrored(_customers(spark, sf_dir), path)
    mirror = spark.read.option("header", True).csv(f"{path}/csv")
    rows = spark.read.parquet(f"{path}/parquet").select(*(F.col(c).cast("string").alias(c) for c in mirror.columns))
    return mirror.join(rows, mirror.columns, "left_semi")


@register("snapshots_as_of", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE year(o_orderdate) <= 1997")
def snapshots_as_of(spark, sf_dir):
    """Write-once snapshots of the orders of each year, read as of a date."""
    path = _folder(spark, "snapshots")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    for (year,) in o.select("y").distinct().orderBy("y").collect():  # a row per snapshot
        snapshots.write_once(o.where(F.col("y") == year), path, f"{year}-12-31")
    return snapshots.read_snapshots(spark, path, "1997-12-31").select("o_orderkey", "y")


@register("manifest", "SELECT 'made__2026-01-02' AS manifest_id, n_regionkey AS region, sum(length(n_name) + 1) AS bytes, 2 AS tier, 'public' AS license, count(*) AS n_rows FROM nation GROUP BY n_regionkey")
def manifest(spark, sf_dir):
    """Checksummed files of nations with their rows, summed by region."""
    path = _folder(spark, "manifest")
    table(spark, sf_dir, "nation").select("n_regionkey", "n_name").repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    found = snapshots.with_rows(snapshots.checksums(spark, path, "made", "2026-01-02", 2, "public"), path).where(F.length("sha256") == 64)
    region = F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("bigint").alias("region")
    return found.where("bytes > 0").groupBy("manifest_id", region, "tier", "license").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
