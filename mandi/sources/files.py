"""Quote files, dimension files and Parquet tables."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mandi.operators import contracts, tables

RAW_COLUMNS = ("raw_date", "raw_index", "raw_province", "raw_market", "raw_price", "raw_previous_price", "raw_change")


def read_quotes(spark: SparkSession, paths, products: DataFrame, columns: tuple[str, ...] = RAW_COLUMNS, parsed: list[str] | None = None, depth: int = 1) -> DataFrame:
    """Rows of quote CSVs as text, with file name, place in the file and product.

    The header must have exactly these columns, else the read fails.  An empty field is an empty
    string.  products (source_file, product_id) says which product a file has; a file that isn't
    listed fails the check.  With ``parsed``, lines are written once as these columns of parse_quotes() and not as
    text.  A file's name is the last ``depth`` pieces of its path: with 2, files of one name in two folders are two.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    # a pruned column would not be looked for in the header
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("columnPruning", False).csv(paths)
    lines = raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    if parsed is not None:
        lines = parse_quotes(lines).select(*parsed, "path", "block", "place")
    contracts.assert_unique(products, ["source_file"])
    files = spark.createDataFrame([("/".join(unquote(f).split("/")[-depth:]),) for f in raw.inputFiles()], "source_file string")
    unlisted = files.join(products, "source_file", "left_anti").take(3)
    if unlisted:
        raise ValueError(f"files without a product: {[r.source_file for r in unlisted]}")
    return _in_file_order(lines, products, depth)


def _in_file_order(lines: DataFrame, products: DataFrame, depth: int) -> DataFrame:
    """lines with source_file, product_id and row_in_file: a task reads a file's split in its order and whole, so lines are
    counted where they lie and never sorted; what a file has for all its lines is joined by split and not written with each."""
    split = ["path", "block"]
    lines = tables.kept(lines, "lines", "zstd")
    counted = lines.groupBy(*split).agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    counted = counted.withColumn("source_file", F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/", -depth))
    before = Window.partitionBy("source_file").orderBy("block", "first").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*split, "source_file", (F.coalesce(F.sum("rows").over(before), F.lit(0)) + 1 - F.col("first")).alias("start"))
    starts = tables.kept(starts.join(products, "source_file", "left"), "starts")
    return lines.join(tables.small(starts, tables.MOST_GROUPS), split).withColumn("row_in_file", F.col("start") + F.col("place")).drop(*split, "place", "start")


def with_trace_key(df: DataFrame, file: str, order: list) -> DataFrame:
    """1-based number of each data row within its file; a large file's splits are counted and numbered on their own."""
    return tables.numbered(df, [file], order, "row_in_file")


def parse_quotes(df: DataFrame) -> DataFrame:
    """Typed columns beside the raw text; a field that doesn't parse is NULL."""
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    return df.withColumns({
        "date": F.expr("try_to_date(raw_date, 'yyyy-MM-dd')"),
        "row_index": F.expr("try_cast(raw_index AS int)"),
        "price": number("raw_price"),
        "previous_price": number("raw_previous_price"),
        "reported_change_pct": number("replace(raw_change, '%', '')"),
    })


def parse_failures(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Fields of each type that didn't parse."""
    bad = lambda *cs: sum((F.count_if(F.col(c).isNull()) for c in cs[1:]), F.count_if(F.col(cs[0]).isNull()))
    return parsed.groupBy(*by).agg(F.count("*").alias("rows"), bad("date").alias("bad_dates"), bad("row_index").alias("bad_integers"), bad("price", "previous_price", "reported_change_pct").alias("bad_numbers"))


def assert_parsed(parsed: DataFrame) -> DataFrame:
    """parsed, if every field did; else ValueError."""
    r = parse_failures(parsed, []).first()
    if r.bad_dates or r.bad_integers or r.bad_numbers:
        raise ValueError(f"fields that don't parse: {r.asDict()}")
    return parsed


def read_dimension(spark: SparkSession, path: str, schema: T.StructType, key: list[str], rows: int | None = None) -> DataFrame:
    """A dimension CSV whose key is unique and which has the expected number of rows."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    contracts.assert_unique(df, key)
    if rows is not None and df.count() != rows:
        raise ValueError(f"{path}: {df.count()} rows instead of {rows}")
    return df


def scan(spark: SparkSession, path: str, columns: list[str], where=None) -> DataFrame:
    """Columns of a Parquet table; filter and projection reach the files."""
    df = spark.read.parquet(path)
    return (df.filter(where) if where is not None else df).select(*columns)
