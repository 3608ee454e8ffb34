"""The given tables (orders, suppliers, nations) as daily quotes of products in markets.

A market is a supplier, its city the supplier's nation, the province the region; a product is a
part type; the price is the unit price.  ``dense`` takes the region as the city, for analyses that
need a price on most days.  SQL is the same in DuckDB, for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mandi.operators import tables
from mandi.operators.mapping import MOST_MARKETS

TIES = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
PRICED = TIES[:6]  # lines that tie in these have one day and one price, so their order is the same for prices
CALENDAR = ("1995-01-02", "2001-11-04")
SPLITS = {"train": ("1995-01-01", "1999-12-31"), "validation": ("2000-01-01", "2000-12-31"), "final_test": ("2001-01-01", "2001-12-31")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market mapping: one row per supplier."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    code = F.col("s_suppkey") % 10
    confidence = F.when(code == 0, "none").when(code == 1, "medium").otherwise("high")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("market_id"), F.when(code != 0, F.col("n_nationkey")).alias("city_id"), F.when(code != 0, F.col("n_name")).alias("city"), F.when(code != 0, F.col("r_name")).alias("province"),
        F.when(code == 0, "unmapped_new_city").otherwise("mapped_existing_city").alias("mapping_status"), confidence.alias("mapping_confidence"),
        F.when(code == 0, 0.0).when(code == 1, 0.75).otherwise(1.0).alias("confidence"),
        (70 + F.col("n_nationkey") * 37 % 70).cast("double").alias("longitude"), (10 + F.col("n_nationkey") * 23 % 50).cast("double").alias("latitude"), F.lit("v1").alias("mapping_version"),
    )


def raw_quotes(spark: SparkSession, sf_dir: str, markets: DataFrame | None = None) -> DataFrame:
    """product_id, market_id, date, price, discount and the line's own columns, in cents-exact arithmetic; of these markets only, if given."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    if markets is not None:
        line = line.join(tables.small(markets.select(F.col("market_id").alias("l_suppkey")), MOST_MARKETS), "l_suppkey", "left_semi")
    cents, qty = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")
    unit = F.expr("div(2 * cents + qty, 2 * qty)") / 100.0
    rows = line.withColumns({"cents": cents, "qty": qty}).join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("p_type").alias("product_id"), F.col("l_suppkey").alias("market_id"), F.col("l_shipdate").cast("date").alias("date"), unit.alias("price"), F.col("l_discount").alias("discount"), *TIES)


def prices(spark: SparkSession, sf_dir: str, markets: DataFrame) -> DataFrame:
    """Quotes of the given markets with what market-days are made of; ("date", *PRICED) is their order and stands for the trace."""
    w = Window.partitionBy("market_id", "product_id").orderBy("date", *PRICED)
    df = raw_quotes(spark, sf_dir, markets).select("product_id", "market_id", "date", "price", *PRICED)
    return df.withColumns({"previous_price": F.lag("price").over(w), "reported_change_pct": F.lit(None).cast("double")})


def reported_change() -> Column:
    """Change to the previous price in percent; every seventh is wrong by one point."""
    return F.bround(F.try_divide(F.col("price") - F.col("previous_price"), F.col("previous_price")) * 100, 2) + F.when(F.col("l_orderkey") % 7 == 0, 1.0).otherwise(0.0)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with previous price, reported change and a trace number within product and market."""
    w = Window.partitionBy("market_id", "product_id").orderBy(*TIES)  # the number first: sorts compare it at once, products are few
    df = raw_quotes(spark, sf_dir).withColumns({"trace": F.row_number().over(w), "previous_price": F.lag("price").over(w)})
    return df.select("product_id", "market_id", "date", "price", "previous_price", reported_change().alias("reported_change_pct"), "discount", F.col("trace").cast("long").alias("trace"), "l_orderkey")


def products(spark: SparkSession, sf_dir: str) -> list[str | None]:
    """The products in order: a dimension of some dozens."""
    return [r.p_type for r in table(spark, sf_dir, "part").select("p_type").distinct().orderBy("p_type").collect()]


def numbered_quotes(spark: SparkSession, sf_dir: str, names: list[str | None], tasks: int) -> DataFrame:
    """quotes() by the product's place in names (product) and sorted by it within tasks, for a job that takes every quote to disk.

    Lines travel in as few columns as order them and are priced where they arrive: lines that tie in PRICED have one
    day, price and order, so these stand for TIES.
    """
    line, numbers = table(spark, sf_dir, "lineitem"), spark.createDataFrame(list(enumerate(names)), "product int, product_id string")
    part = table(spark, sf_dir, "part").join(F.broadcast(numbers), F.col("p_type").eqNullSafe(F.col("product_id"))).select(F.col("p_partkey").alias("l_partkey"), "product")
    by = ["product", "l_suppkey"]
    moved = line.select("l_suppkey", *PRICED).join(tables.small(part, MOST_MARKETS, "shuffle_hash"), "l_partkey").select(*by, *PRICED).repartition(tasks, *by)
    cents, qty = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")
    priced = moved.withColumns({"cents": cents, "qty": qty}).withColumns({"price": F.expr("div(2 * cents + qty, 2 * qty)") / 100.0, "date": F.col("l_shipdate").cast("date")})
    w = Window.partitionBy(*by).orderBy(*PRICED)
    df = priced.withColumns({"trace": F.row_number().over(w).cast("long"), "previous_price": F.lag("price").over(w)})
    return df.select("product", F.col("l_suppkey").alias("market_id"), "date", "price", "previous_price", reported_change().alias("reported_change_pct"), "trace")


def discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse values (discounts) as prices of product and region: they tie, and 0 is not a valid price."""
    df = raw_quotes(spark, sf_dir).join(mapping(spark, sf_dir).filter("city_id IS NOT NULL").select("market_id", "province"), "market_id")
    w = Window.partitionBy("product_id", "province").orderBy(*TIES)
    return df.select("product_id", F.col("province").alias("market_id"), "date", F.col("discount").alias("price"), F.lag("discount").over(w).alias("previous_price"), F.lit(None).cast("double").alias("reported_change_pct"), F.row_number().over(w).cast("long").alias("trace"))


QUOTES_SQL = """
mapping AS (
  SELECT s_suppkey AS market_id, CASE WHEN s_suppkey % 10 <> 0 THEN n_nationkey END AS city_id, CASE WHEN s_suppkey % 10 <> 0 THEN n_name END AS city,
    CASE WHEN s_suppkey % 10 <> 0 THEN r_name END AS province, CASE s_suppkey % 10 WHEN 0 THEN 'unmapped_new_city' ELSE 'mapped_existing_city' END AS mapping_status,
    CASE s_suppkey % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'medium' ELSE 'high' END AS mapping_confidence,
    CASE s_suppkey % 10 WHEN 0 THEN 0.0 WHEN 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence,
    (70 + n_nationkey * 37 % 70)::DOUBLE AS longitude, (10 + n_nationkey * 23 % 50)::DOUBLE AS latitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (
  SELECT p_type AS product_id, l_suppkey AS market_id, l_shipdate::DATE AS date,
    ((2 * round(l_extendedprice * 100)::BIGINT + l_quantity::BIGINT) // (2 * l_quantity::BIGINT)) / 100.0::DOUBLE AS price, l_discount AS discount, lineitem.*
  FROM lineitem JOIN part ON l_partkey = p_partkey),
numbered AS (
  SELECT *, row_number() OVER w AS trace, lag(price) OVER w AS previous_price FROM raw
  WINDOW w AS (PARTITION BY product_id, market_id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)),
quotes AS (
  SELECT product_id, market_id, date, price, previous_price,
    round_even((price - previous_price) / previous_price * 100, 2) + CASE WHEN l_orderkey % 7 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS reported_change_pct, discount, trace, l_orderkey FROM numbered),
discounts AS (
  SELECT product_id, province AS market_id, date, discount AS price, lag(discount) OVER w AS previous_price, row_number() OVER w AS trace FROM raw JOIN mapping USING (market_id) WHERE city_id IS NOT NULL
  WINDOW w AS (PARTITION BY product_id, province ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus))
"""
