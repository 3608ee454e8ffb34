"""Tables, JSON marts, manifests and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mandi.operators import contracts, tables


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None, by: str = "product_id", files: int = 1, rows: int = 0) -> None:
    """Parquet (zstd), one directory per product; ``files`` spreads a large product over several tasks, ``rows`` cuts files (0: not).

    Only products of df are replaced: those that the table has beside them stay as they are.
    """
    if schema is not None:
        contracts.assert_schema(df, schema)
    spread = df.repartition(by) if files == 1 else df.repartition(F.col(by), F.pmod(F.xxhash64(*df.columns), F.lit(files)))
    how = {"compression": "zstd", "partitionOverwriteMode": "dynamic"} | ({"maxRecordsPerFile": rows} if rows else {})
    spread.write.mode("overwrite").partitionBy(by).options(**how).parquet(path)


def product_json(df: DataFrame, by: str | list[str], records: list[str], order: list[str], meta: dict[str, F.Column] | None = None) -> DataFrame:
    """One JSON text per product (or product and city): metadata and its records in order.

    A mart for a page: records are bounded by a product's cities, months and horizons; give the city
    too where a product's would not fit in one row.
    """
    by = [by] if isinstance(by, str) else by
    row = F.struct(*order, *(c for c in records if c not in order))
    out = df.groupBy(*by).agg(*((c.alias(k)) for k, c in (meta or {}).items()), F.sort_array(F.collect_list(row)).alias("records"))
    return out.select(*by, F.to_json(F.struct(*by, *(meta or {}), "records")).alias("value"))


def write_product_json(df: DataFrame, path: str, by: str, **how) -> None:
    product_json(df, by, **how).repartition(by).write.partitionBy(by).text(path)


def manifest(df: DataFrame, by: list[str], date: str, flags: dict[str, F.Column] | None = None) -> DataFrame:
    """Rows, dates and counts of each group, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), *(F.count_if(c).alias(k) for k, c in (flags or {}).items()))


def columns_of(df: DataFrame) -> list[tuple[str, str, bool]]:
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a sum of row hashes: equal for equal tables in any order."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def statistics(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row: rows of a Parquet table, and least and greatest value of each column, from the files' footers.

    Read by the version-2 source, to which Spark pushes counts, minima and maxima of whole numbers, doubles and dates; a
    column of another type (a timestamp, a string) is scanned alone.  An empty table has no rows and nulls.
    """
    own = spark.newSession()  # settings of a session: the caller's stay as they are
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    n = F.count("*")  # pushed, it is null where there is no file to ask
    return own.read.parquet(path).agg(F.when(n > 0, n).otherwise(0).alias("rows"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("first", F.min), ("last", F.max))))


def date_range(spark: SparkSession, path: str, date: str) -> DataFrame:
    """First and last date of a Parquet table, from statistics alone where the column is a date."""
    return statistics(spark, path, [date]).select(F.col(f"first_{date}").alias("first_date"), F.col(f"last_{date}").alias("last_date"), "rows")


# ---------------------------------------------------------------- documents larger than a row


def documents(keys: DataFrame, by: list[str], sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Lines of one JSON document for each row of keys (columns by, which are unique, and further ones as metadata), in order.

    sections: an array of records under each name: a table with the columns by, and the columns its records are ordered
    by.  A document's lines are its opening, each array's opening, a line for each record, and the ends.  Records
    stay rows of their own from the first to the last step: no array is ever put together, so an array may have any number.
    A section without records for a key is an empty array.
    """
    at = lambda s, n: (F.lit(s).alias("section__"), (n if isinstance(n, Column) else F.lit(n)).cast("long").alias("n__"))
    last = 2**62
    head = F.expr("concat(left(j__, length(j__) - 1), ',')")  # the metadata's object, left open
    frame = [F.struct(*at(0, 0), head.alias("value"))]
    for i, name in enumerate(sections, 1):
        frame += [F.struct(*at(i, 0), F.lit(f'"{name}":[').alias("value")), F.struct(*at(i, last), F.lit("]," if i < len(sections) else "]}").alias("value"))]
    every = keys.withColumn("j__", F.to_json(F.struct(*keys.columns), {"ignoreNullFields": "false"}))
    lines = every.select(*by, F.explode(F.array(*frame)).alias("x")).select(*by, "x.*")
    for i, (df, order) in enumerate(sections.values(), 1):
        record = F.to_json(F.struct(*(c for c in df.columns if c not in by)), {"ignoreNullFields": "false"})
        placed = tables.numbered(df.join(keys.select(*by), by, "left_semi").select(*by, *order, record.alias("record__")), by, order, "n__")
        comma = F.when(F.col("n__") > 1, F.lit(",")).otherwise("")
        lines = lines.unionByName(placed.select(*by, *at(i, F.col("n__")), F.concat(comma, "record__").alias("value")))
    return lines


def write_documents(lines: DataFrame, path: str, by: list[str]) -> None:
    """documents() as text, one folder for each document: a task sorts its documents' lines and writes them as they come."""
    order = [*by, "section__", "n__"]
    lines.repartition(*by).sortWithinPartitions(*order).select(*by, "value").write.partitionBy(*by).text(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that write_documents() wrote, one row each, with the columns of schema."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
