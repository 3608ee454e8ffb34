"""Features at rolling origins over dense series (product and region)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandi.functions.scalar import split_of
from mandi.operators import temporal
from mandi.sources import given

from .common import REGION_SQL, layer, out, region_days, sql

Q, SQL = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


START, END, HISTORY = "1996-01-01", "2001-10-01", 60


def series(spark, sf_dir) -> DataFrame:
    return region_days(spark, sf_dir).filter("quality <> 'poor'").select("product_id", "city_id", "date", "price", "stale_share", "outlier_share", "reliability")


@layer
def spine(spark, sf_dir) -> DataFrame:
    return temporal.origin_spine(series(spark, sf_dir), START, END, "1 month", HISTORY)


SERIES_SQL = REGION_SQL + """,
series AS (SELECT product_id, city_id, date, price, stale_share, outlier_share, reliability FROM region_day WHERE quality <> 'poor')"""
SPINE_SQL = SERIES_SQL + f""",
origins AS (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH))::DATE AS origin_date),
spine AS (SELECT k.product_id, k.city_id, origin_date, count(*) AS history FROM (SELECT DISTINCT product_id, city_id FROM series) k, origins JOIN series s ON s.product_id = k.product_id AND s.city_id = k.city_id AND s.date < origin_date GROUP BY ALL HAVING count(*) >= {HISTORY})"""


def _recent_sql() -> str:
    cols = ["arg_max(price, date) FILTER (date >= origin_date - 1) AS origin_price", "origin_date - max(date) FILTER (date >= origin_date - 1) AS origin_fill_days"]
    for k in temporal.LAGS:
        near = f"FILTER (date BETWEEN origin_date - {k + 3} AND origin_date - {k})"
        cols += [f"arg_max(price, date) {near} AS lag_price_{k}d", f"origin_date - {k} - max(date) {near} AS lag_gap_{k}d"]
    for w in temporal.WINDOWS:
        near = f"FILTER (date >= origin_date - {w - 1})"
        cols += [f"count(price) {near} AS rolling_count_{w}d", f"avg(price) {near} AS rolling_mean_{w}d", f"median(price) {near} AS rolling_median_{w}d", f"CASE WHEN count(price) {near} = 1 THEN 0 ELSE stddev_samp(price) {near} END AS rolling_std_{w}d"]
    extra = [f"lag_price_{k}d IS NULL AS lag_missing_{k}d, CASE WHEN origin_price > 0 AND lag_price_{k}d > 0 THEN ln(origin_price / lag_price_{k}d) END AS return_{k}d" for k in temporal.LAGS]
    return f"""recent0 AS (SELECT s.product_id, s.city_id, origin_date, {', '.join(cols)} FROM spine JOIN series s ON s.product_id = spine.product_id AND s.city_id = spine.city_id AND date BETWEEN origin_date - 89 AND origin_date GROUP BY s.product_id, s.city_id, origin_date),
recent AS (SELECT spine.*, r.* EXCLUDE (product_id, city_id, origin_date) REPLACE ({', '.join(f'coalesce(rolling_count_{w}d, 0) AS rolling_count_{w}d' for w in temporal.WINDOWS)}), {', '.join(extra)} FROM spine LEFT JOIN recent0 r ON r.product_id = spine.product_id AND r.city_id = spine.city_id AND r.origin_date = spine.origin_date)"""


_LONGS = " ".join(["origin_fill_days", *(f"lag_gap_{k}d" for k in temporal.LAGS)])
_DOUBLES = " ".join(["origin_price", *(f"lag_price_{k}d return_{k}d" for k in temporal.LAGS), *(f"rolling_mean_{w}d rolling_median_{w}d rolling_std_{w}d" for w in temporal.WINDOWS)])


@query(sql(SPINE_SQL, "SELECT * FROM spine"))
def origin_spine(spark, sf_dir):
    return out(spine(spark, sf_dir))


@query(sql(SPINE_SQL + ",\n" + _recent_sql(), "SELECT * FROM recent", _LONGS, _DOUBLES))
def recent_features(spark, sf_dir):
    return out(temporal.recent_features(spine(spark, sf_dir), series(spark, sf_dir)))


UNCHANGED_SQL = """steps AS (SELECT *, date - lag(date) OVER w = 1 AS step, date - lag(date) OVER w = 1 AND abs(price - lag(price) OVER w) <= 1e-12 AS same FROM series WINDOW w AS (PARTITION BY product_id, city_id ORDER BY date)),
unchanged AS (SELECT product_id, city_id, origin_date, CASE WHEN count(*) FILTER (step) > 0 THEN count(*) FILTER (same) / count(*) FILTER (step) END AS unchanged_share FROM spine JOIN steps USING (product_id, city_id) WHERE date <= origin_date GROUP BY ALL)"""


@query(sql(SPINE_SQL + ",\n" + UNCHANGED_SQL, "SELECT * FROM unchanged", "", "unchanged_share"))
def unchanged_share(spark, sf_dir):
    return out(temporal.unchanged_share(spine(spark, sf_dir), series(spark, sf_dir)))


DIRECTION_SQL = """direction AS (SELECT product_id, city_id, origin_date, avg((c > 0)::INT) AS up_share, avg((c < 0)::INT) AS down_share FROM (SELECT product_id, city_id, origin_date, price - lag(price) OVER (PARTITION BY product_id, city_id, origin_date ORDER BY date) AS c FROM spine JOIN series USING (product_id, city_id) WHERE date BETWEEN origin_date - 14 AND origin_date) WHERE c IS NOT NULL GROUP BY ALL)"""


@query(sql(SPINE_SQL + ",\n" + DIRECTION_SQL, "SELECT product_id, city_id, origin_date, up_share, down_share FROM spine LEFT JOIN direction USING (product_id, city_id, origin_date)", "", "up_share down_share"))
def direction_share(spark, sf_dir):
    return out(temporal.direction_share(spine(spark, sf_dir), series(spark, sf_dir)))


TARGET_SQL = """targets AS (SELECT spine.*, h AS horizon, origin_date + h AS target_date, s.price AS target_price FROM spine, (VALUES (7), (14), (28)) v(h) JOIN series s ON s.product_id = spine.product_id AND s.city_id = spine.city_id AND s.date = origin_date + h),
past AS (SELECT t.product_id, t.city_id, origin_date, target_date, date, price FROM targets t JOIN series s ON s.product_id = t.product_id AND s.city_id = t.city_id AND date <= origin_date),
season AS (SELECT product_id, city_id, origin_date, target_date, count(*) FILTER (month(date) = month(target_date)) AS seasonal_count, CASE WHEN count(*) FILTER (month(date) = month(target_date)) >= 3 THEN median(price) FILTER (month(date) = month(target_date)) ELSE median(price) END AS seasonal_median FROM past GROUP BY ALL),
weekly AS (SELECT product_id, city_id, origin_date, target_date, median(price) AS weekly_median, count(*) AS weekly_count FROM (SELECT *, row_number() OVER (PARTITION BY product_id, city_id, origin_date, target_date ORDER BY date DESC) AS r FROM past WHERE isodow(date) = isodow(target_date)) WHERE r <= 4 GROUP BY ALL)"""


def targets(spark, sf_dir) -> DataFrame:
    t = spine(spark, sf_dir).withColumn("horizon", F.explode(F.array(*map(F.lit, (7, 14, 28))))).withColumn("target_date", F.date_add("origin_date", F.col("horizon")))
    return temporal.attach_target(t, series(spark, sf_dir))


@query(sql(SPINE_SQL + ",\n" + TARGET_SQL, "SELECT * FROM season", "", "seasonal_median"))
def seasonal_median(spark, sf_dir):
    return out(temporal.seasonal_median(targets(spark, sf_dir).select("product_id", "city_id", "origin_date", "target_date"), series(spark, sf_dir)))


@query(sql(SPINE_SQL + ",\n" + TARGET_SQL, "SELECT * FROM weekly", "", "weekly_median"))
def weekly_pattern(spark, sf_dir):
    return out(temporal.weekly_pattern(targets(spark, sf_dir).select("product_id", "city_id", "origin_date", "target_date"), series(spark, sf_dir)))


@layer
def mart(spark, sf_dir) -> DataFrame:
    return temporal.forecast_mart(series(spark, sf_dir), spine(spark, sf_dir)).withColumn("split", split_of(F.col("target_date"), given.SPLITS))


MART_SQL = SPINE_SQL + ",\n" + _recent_sql() + ",\n" + UNCHANGED_SQL + ",\n" + TARGET_SQL + """,
mart AS (SELECT t.*, r.* EXCLUDE (product_id, city_id, origin_date, history), unchanged_share, seasonal_count, seasonal_median, weekly_median, weekly_count,
  month(origin_date) AS origin_month, sin(2 * pi() * dayofyear(origin_date) / 365.25::DOUBLE) AS origin_day_sin, cos(2 * pi() * dayofyear(origin_date) / 365.25::DOUBLE) AS origin_day_cos,
  month(t.target_date) AS target_month, sin(2 * pi() * dayofyear(t.target_date) / 365.25::DOUBLE) AS target_day_sin, cos(2 * pi() * dayofyear(t.target_date) / 365.25::DOUBLE) AS target_day_cos,
  ln(origin_price) AS log_origin_price, ln(target_price) AS log_target_price, target_price - origin_price AS target_change, ln(target_price / origin_price) AS target_return, sign(target_price - origin_price)::DOUBLE AS target_direction,
  CASE WHEN year(t.target_date) < 2000 THEN 'train' WHEN year(t.target_date) = 2000 THEN 'validation' ELSE 'final_test' END AS split
 FROM targets t JOIN recent r USING (product_id, city_id, origin_date) JOIN unchanged USING (product_id, city_id, origin_date) LEFT JOIN season USING (product_id, city_id, origin_date, target_date) LEFT JOIN weekly USING (product_id, city_id, origin_date, target_date) WHERE origin_price IS NOT NULL)"""


@query(sql(MART_SQL, "SELECT * FROM mart", "horizon origin_month target_month " + _LONGS, "target_price unchanged_share seasonal_median weekly_median origin_day_sin origin_day_cos target_day_sin target_day_cos log_origin_price log_target_price target_change target_return " + _DOUBLES))
def forecast_mart(spark, sf_dir):
    return out(mart(spark, sf_dir))


@query(sql(SERIES_SQL + ", long AS (SELECT *, count(*) OVER (PARTITION BY product_id, city_id) AS n FROM series), o AS (SELECT l.*, h, coalesce(a.price, b.price) AS predicted FROM (SELECT * FROM long, (VALUES (7), (14), (28)) v(h) WHERE n >= 200) l LEFT JOIN series a ON a.product_id = l.product_id AND a.city_id = l.city_id AND a.date = l.date - h LEFT JOIN series b ON b.product_id = l.product_id AND b.city_id = l.city_id AND b.date = l.date - h - 1)", "SELECT h AS horizon, count(*) AS rows, sum(abs(price - predicted)) / sum(price) AS wape FROM o WHERE predicted IS NOT NULL GROUP BY 1", "horizon", "wape"))
def last_value_wape(spark, sf_dir):
    return out(temporal.last_value_wape(series(spark, sf_dir), [7, 14, 28], 200))


@query(sql(SERIES_SQL + ", c AS (SELECT product_id, city_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM series GROUP BY 1, 2)", "SELECT c.product_id, c.city_id, c.date, a.price, coalesce(a.price, b.price) AS filled_price FROM c LEFT JOIN series a ON a.product_id = c.product_id AND a.city_id = c.city_id AND a.date = c.date LEFT JOIN series b ON b.product_id = c.product_id AND b.city_id = c.city_id AND b.date = c.date - 1", "", "price filled_price"))
def dense_calendar(spark, sf_dir):
    return out(temporal.dense_calendar(series(spark, sf_dir)))


@query(sql(SPINE_SQL + ",\n" + TARGET_SQL, "SELECT count(*) AS rows, count(*) FILTER (target_date <= origin_date) AS target_not_later, count(*) FILTER (history < 60) AS short_history FROM targets"))
def leakage_check(spark, sf_dir):
    from mandi.operators import contracts

    return out(contracts.broken(targets(spark, sf_dir), {"target_not_later": F.col("target_date") > F.col("origin_date"), "short_history": F.col("history") >= HISTORY}))
