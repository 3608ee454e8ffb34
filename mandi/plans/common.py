"""What all registered queries share: output types, and the measured layers they start from."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mandi.operators import cityday, mapping, quality, tables
from mandi.sources import given


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and small integers as long, so that results compare across engines."""
    def tidy(f: T.StructField):
        if isinstance(f.dataType, T.DoubleType):
            # cut a third below a step: means of decimals often lie on its middle, where engines differ
            return (F.floor(F.col(f.name) * 10.0**digits + 0.3) / 10.0**digits).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(f.name).cast("long").alias(f.name)
        return F.col(f.name)

    return df.select(*map(tidy, df.schema.fields))


def sql(body: str, select: str, longs: str = "", doubles: str = "", digits: int = 6) -> str:
    """WITH body SELECT select, with the named columns as BIGINT or rounded."""
    change = [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + [f"floor(CAST({c} AS DOUBLE) * {10**digits}::DOUBLE + 0.3::DOUBLE) / {10**digits}::DOUBLE AS {c}" for c in doubles.split()]
    star = f"* REPLACE ({', '.join(change)})" if change else "*"
    return f"WITH {body}\nSELECT {star} FROM ({select})"


_layers: dict = {}


def _listing(spark: SparkSession, folder: str) -> tuple:
    """Name, length and time of what a folder holds: a layer of other files is another layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def layer(f):
    """Write a measured layer once per application, table folder and state of its files; the queries above read it.

    Plans stay small, and a lost executor costs nothing that is below the layer.
    """
    @wraps(f)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (f.__module__, f.__name__, sf_dir, _listing(spark, sf_dir), spark.sparkContext.applicationId)
        if key not in _layers:
            df = f(spark, sf_dir)
            _layers[key] = tables.kept(df, f.__name__)
        return _layers[key]

    return get


def folder_of(written: DataFrame) -> str:
    """The folder of a layer's files."""
    return written.inputFiles()[0].rpartition("/")[0]


def forget_layers() -> None:
    """Let the next query measure its layers anew."""
    _layers.clear()


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality-flagged quotes with their market's mapping."""
    mapped = mapping.map_markets(given.quotes(spark, sf_dir), given.mapping(spark, sf_dir), check=False)
    return quality.add_quality(mapped, at_least=10, window=90)


@layer
def market_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market's quotes are flagged among themselves, so those of markets without a city go first, and columns that no market-day shows."""
    mapped = given.mapping(spark, sf_dir).filter(F.col("mapping_status") == mapping.STATUSES[0]).select("market_id", "city_id", "province", "mapping_status", "confidence")
    quotes = mapping.map_markets(given.prices(spark, sf_dir, mapped), mapped, check=False)
    return cityday.market_day(cityday.eligible(quality.add_quality(quotes, given.PRICED, at_least=10, window=90)))


@layer
def city_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cityday.city_day(market_days(spark, sf_dir))


@layer
def region_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City-days with the region as the city: dense series (city_id is the region's name)."""
    days = market_days(spark, sf_dir)
    return cityday.city_day(days.withColumn("city_id", F.col("province")))


FLAGS_SQL = given.QUOTES_SQL + """,
f1 AS (
  SELECT q.*, m.* EXCLUDE (market_id), price > 0 AS price_valid,
    CASE WHEN price IS NULL THEN 'missing' WHEN price <= 0 THEN 'not_positive' END AS invalid_reason,
    CASE WHEN price > 0 AND previous_price > 0 AND reported_change_pct IS NOT NULL THEN abs(round_even((price - previous_price) / previous_price * 100, 2) - reported_change_pct) <= 0.011 END AS change_consistent,
    count(*) OVER (PARTITION BY product_id, q.market_id, date) > 1 AS duplicate,
    coalesce(abs(price - previous_price) <= 1e-12 AND date - lag(date) OVER w = 1, false) AS zero_change,
    CASE WHEN price > 0 THEN ln(price) END AS lp
  FROM quotes q LEFT JOIN mapping m ON q.market_id = m.market_id WINDOW w AS (PARTITION BY product_id, q.market_id ORDER BY date, trace)),
f2 AS (SELECT *, sum(CASE WHEN zero_change THEN 0 ELSE 1 END) OVER w AS island, last_value(CASE WHEN price_valid THEN date END IGNORE NULLS) OVER w AS last_valid,
    count(lp) OVER b AS n_before, quantile_cont(lp, 0.25) OVER b AS q25, quantile_cont(lp, 0.5) OVER b AS q50, quantile_cont(lp, 0.75) OVER b AS q75
  FROM f1 WINDOW w AS (PARTITION BY product_id, market_id ORDER BY date, trace), b AS (PARTITION BY product_id, market_id ORDER BY date, trace ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)),
f3 AS (SELECT *, CASE WHEN zero_change THEN sum(zero_change::INT) OVER (PARTITION BY product_id, market_id, island ORDER BY date, trace) ELSE 0 END AS zero_run, date - last_valid AS days_since_valid,
    CASE WHEN n_before < 10 OR lp IS NULL THEN false WHEN q75 > q25 THEN abs(lp - q50) > 6 * (q75 - q25) / 1.349 ELSE abs(lp - q50) > ln(1.5) END AS outlier FROM f2),
flags AS (SELECT *, zero_run >= 7 AS stale FROM f3)"""
DAYS_SQL = FLAGS_SQL + """,
market_day AS (SELECT product_id, city_id, province, market_id, date, median(price) AS price, count(*) AS source_rows, bool_or(stale) AS stale, bool_or(outlier) AS outlier, max(confidence) AS confidence, count(*) > 1 AS duplicate
  FROM flags WHERE mapping_status = 'mapped_existing_city' AND price_valid GROUP BY ALL),
ranked_day AS (SELECT *, row_number() OVER (PARTITION BY product_id, city_id, province, date ORDER BY price, market_id) AS rank, count(*) OVER (PARTITION BY product_id, city_id, province, date) AS n FROM market_day),
day0 AS (SELECT product_id, city_id, province, date, median(price) AS price, avg(price) FILTER (rank > floor(n * 0.1) AND rank <= n - floor(n * 0.1)) AS trimmed_mean_price, count(*) AS markets, sum(source_rows) AS source_rows,
    avg(stale::INT) AS stale_share, avg(outlier::INT) AS outlier_share, avg(duplicate::INT) AS duplicate_share, avg(confidence) AS mean_confidence FROM ranked_day GROUP BY ALL),
day1 AS (SELECT *, 0.4 * (1 - stale_share) + 0.25 * (1 - outlier_share) + 0.1 * (1 - duplicate_share) + 0.1 * mean_confidence + 0.15 * least(markets / 2, 1) AS reliability FROM day0),
city_day AS (SELECT *, CASE WHEN round(reliability, 9) >= 0.85 THEN 'good' WHEN round(reliability, 9) >= 0.65 THEN 'caution' ELSE 'poor' END AS quality FROM day1)"""
REGION_SQL = FLAGS_SQL + """,
market_day AS (SELECT product_id, province AS city_id, province, market_id, date, median(price) AS price, count(*) AS source_rows, bool_or(stale) AS stale, bool_or(outlier) AS outlier, max(confidence) AS confidence, count(*) > 1 AS duplicate
  FROM flags WHERE mapping_status = 'mapped_existing_city' AND price_valid GROUP BY ALL),
day0 AS (SELECT product_id, city_id, province, date, median(price) AS price, count(*) AS markets, sum(source_rows) AS source_rows,
    avg(stale::INT) AS stale_share, avg(outlier::INT) AS outlier_share, avg(duplicate::INT) AS duplicate_share, avg(confidence) AS mean_confidence FROM market_day GROUP BY ALL),
day1 AS (SELECT *, 0.4 * (1 - stale_share) + 0.25 * (1 - outlier_share) + 0.1 * (1 - duplicate_share) + 0.1 * mean_confidence + 0.15 * least(markets / 2, 1) AS reliability FROM day0),
region_day AS (SELECT *, CASE WHEN round(reliability, 9) >= 0.85 THEN 'good' WHEN round(reliability, 9) >= 0.65 THEN 'caution' ELSE 'poor' END AS quality FROM day1)"""
