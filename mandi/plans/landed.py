"""Landed cost over the latest city prices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandi.functions.scalar import haversine
from mandi.operators import forecast, landed, tables
from mandi.sources import given, sinks

from . import forecast as forecasts
from .common import DAYS_SQL, FLAGS_SQL, city_days, layer, out, sql

Q, SQL = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


AT = "2001-06-30"
SCENARIO = landed.Scenario(max_distance_km=6000.0, transport_cost=0.05, quantity_kg=100.0)
_HAV = "CASE WHEN a.longitude + a.latitude + b.longitude + b.latitude IS NOT NULL THEN 2 * 6371.0088::DOUBLE * asin(least(1, sqrt(pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin((radians(b.longitude) - radians(a.longitude)) / 2), 2)))) END"
GEO_SQL = "geo AS (SELECT n_nationkey AS city_id, (70 + n_nationkey * 37 % 70)::DOUBLE AS longitude, (10 + n_nationkey * 23 % 50)::DOUBLE AS latitude FROM nation)"


def geo(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    return given.table(spark, sf_dir, "nation").select(n.alias("city_id"), (70 + n * 37 % 70).cast("double").alias("longitude"), (10 + n * 23 % 50).cast("double").alias("latitude"))


@query(sql(GEO_SQL, f"SELECT a.city_id AS a, b.city_id AS b, {_HAV} AS km FROM geo a, geo b WHERE a.city_id < b.city_id", "a b", "km"))
def haversine_km(spark, sf_dir):
    g = geo(spark, sf_dir)
    a, b = (g.select(*(F.col(c).alias(f"{c}_{s}") for c in g.columns)) for s in "ab")
    return out(a.join(b, F.col("city_id_a") < F.col("city_id_b")).select(F.col("city_id_a").alias("a"), F.col("city_id_b").alias("b"), haversine(F.col("longitude_a"), F.col("latitude_a"), F.col("longitude_b"), F.col("latitude_b")).alias("km")))


@query(sql(given.QUOTES_SQL + ", anchor AS (SELECT city_id, avg(longitude) AS longitude, avg(latitude) + 0.4 AS latitude FROM mapping GROUP BY 1)", f"SELECT a.market_id, {_HAV} AS distance_km, CASE WHEN distance_km IS NULL THEN 'missing' WHEN distance_km > 100 THEN 'far' WHEN distance_km > 50 THEN 'check' WHEN distance_km > 25 THEN 'note' ELSE 'ok' END AS status FROM mapping a LEFT JOIN anchor b USING (city_id)", "", "distance_km"))
def geo_audit(spark, sf_dir):
    m = given.mapping(spark, sf_dir)
    anchor = m.groupBy("city_id").agg(F.avg("longitude").alias("anchor_longitude"), (F.avg("latitude") + 0.4).alias("anchor_latitude"))
    return out(landed.geo_audit(m.join(anchor, "city_id", "left")).select("market_id", "distance_km", "status"))


HORIZONS, CALIBRATED = [7, 14, 28], 10


def calibration(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Usual relative error of each group's released route before the scenario; and the groups' release status and conformal quantile."""
    df = forecasts.frame(spark, sf_dir)
    quantile = forecast.conformal_quantiles(forecasts._residuals(df.filter("split = 'validation'")), forecasts.QUANTILE_LEVELS)
    matrix = forecast.release_matrix(forecasts._with_intervals(spark, sf_dir), "model", "last_valid").select("product_id", "horizon", "release_status")
    released = forecast.attach_quantile(matrix, quantile, forecasts.QUANTILE_LEVELS, at_least=10).select("product_id", "horizon", "release_status", "quantile")
    released = released.withColumn("route", F.when(F.col("release_status") == "baseline_fallback", "baseline").otherwise("model"))
    point = F.when(F.col("route") == "model", F.col("model")).otherwise(F.col("last_valid"))
    res = df.join(released, ["product_id", "horizon"]).select("product_id", "horizon", "route", F.date_add("origin_date", F.col("horizon")).alias("target_date"), F.abs(F.ln(F.col("actual") / point)).alias("residual"))
    return landed.risk_calibration(res, AT, CALIBRATED), released


CAL_SQL = forecasts.RELEASE_SQL + f""",
route_ AS (SELECT product_id, horizon, release_status, CASE WHEN release_status = 'baseline_fallback' THEN 'baseline' ELSE 'model' END AS route, any_value(quantile) AS quantile FROM matrix JOIN wq USING (product_id, horizon) GROUP BY ALL),
cal AS (SELECT product_id, horizon, route, count(*) AS rows, quantile_cont(residual, 0.8) AS q80_error, median(residual) AS median_error, min(target_date) AS first_target, max(target_date) AS last_target FROM
  (SELECT product_id, horizon, route, (origin_date + horizon)::DATE AS target_date, abs(ln(actual / CASE WHEN route = 'model' THEN model ELSE last_valid END)) AS residual FROM frame JOIN route_ USING (product_id, horizon)) WHERE target_date < DATE '{AT}' GROUP BY 1, 2, 3 HAVING count(*) >= {CALIBRATED})"""


@query(sql(CAL_SQL, "SELECT * FROM cal", "horizon", "q80_error median_error"))
def risk_calibration(spark, sf_dir):
    return out(calibration(spark, sf_dir)[0])


@layer
def snapshot(spark, sf_dir) -> DataFrame:
    """Latest price of each product and city by the scenario date, per horizon, with reliability and uncertainty."""
    days = city_days(spark, sf_dir).filter(F.col("date") <= F.lit(AT).cast("date"))
    latest = days.groupBy("product_id", "city_id").agg(F.max_by("price", "date").alias("point"), F.max("date").alias("last_day"))
    # the origin's price is a fortnight old for some cities: their reliability is the trailing median
    latest = latest.withColumn("origin_price_date", F.when(F.col("city_id") % 4 == 0, F.date_sub("last_day", 400)).otherwise(F.col("last_day")))
    got = landed.attach_reliability(latest, days, AT).filter("reliability IS NOT NULL").withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    errors, released = calibration(spark, sf_dir)
    # an interval around the point where its group's is released
    got = landed.attach_calibration(got, errors, released).join(released.select("product_id", "horizon", "release_status", "quantile"), ["product_id", "horizon"], "left")
    full = F.coalesce(F.col("release_status").isin("model_target", "model_minimum"), F.lit(False))
    got = got.withColumn("p90", F.when(full, F.col("point") * F.exp("quantile")))
    got = landed.price_labels(got, interval=full).withColumn("risk_basis", F.when(full, "released_p90_minus_point").otherwise(F.col("risk_basis")))
    got = got.withColumn("uncertainty", landed.base_uncertainty(F.col("point"), F.col("p90"), F.col("q80_error"))).join(geo(spark, sf_dir), "city_id")
    return got.select("product_id", "city_id", "horizon", "point", "reliability", "reliability_source", "route", "risk_basis", "price_label", "interval_status", "p90", "uncertainty", "longitude", "latitude")


_CITY_DAYS = DAYS_SQL[len(FLAGS_SQL):]
for _a, _b in (("market_day", "nation_market_day"), ("ranked_day", "nation_ranked_day"), ("day0", "nation_day0"), ("day1", "nation_day1")):
    _CITY_DAYS = _CITY_DAYS.replace(_a, _b)
SNAP_SQL = CAL_SQL + _CITY_DAYS + f""", {GEO_SQL},
near AS (SELECT * FROM city_day WHERE date BETWEEN DATE '{AT}' - 28 AND DATE '{AT}'),
latest AS (SELECT product_id, city_id, arg_max(price, date) AS point, max(date) AS last_day FROM city_day WHERE date <= DATE '{AT}' GROUP BY 1, 2),
snap0 AS (SELECT l.product_id, l.city_id, point, coalesce(e.reliability, t.r) AS reliability, CASE WHEN e.reliability IS NOT NULL THEN 'origin_price_date_exact' ELSE 'trailing_28d_median' END AS reliability_source
  FROM latest l LEFT JOIN near e ON e.product_id = l.product_id AND e.city_id = l.city_id AND e.date = CASE WHEN l.city_id % 4 = 0 THEN last_day - 400 ELSE last_day END
  LEFT JOIN (SELECT product_id, city_id, median(reliability) AS r FROM near GROUP BY 1, 2) t ON t.product_id = l.product_id AND t.city_id = l.city_id),
snap1 AS (SELECT s.*, h.horizon, coalesce(r.route, 'baseline') AS route, coalesce(r.release_status IN ('model_target', 'model_minimum'), false) AS full_, r.quantile AS quantile, CASE WHEN coalesce(r.release_status IN ('model_target', 'model_minimum'), false) THEN 'released_p90_minus_point' WHEN c.q80_error IS NOT NULL THEN 'route_q80_error' ELSE 'widest_q80_error' END AS risk_basis, coalesce(c.q80_error, w.q) AS q80
  FROM snap0 s, (VALUES (7), (14), (28)) h(horizon) LEFT JOIN route_ r ON r.product_id = s.product_id AND r.horizon = h.horizon LEFT JOIN cal c ON c.product_id = s.product_id AND c.horizon = h.horizon AND c.route = coalesce(r.route, 'baseline') LEFT JOIN (SELECT horizon, max(q80_error) AS q FROM cal GROUP BY 1) w ON w.horizon = h.horizon WHERE reliability IS NOT NULL),
snap AS (SELECT product_id, s.city_id, horizon, point, reliability, reliability_source, route, risk_basis, CASE WHEN route = 'baseline' THEN 'last price carried forward, not a model' WHEN full_ THEN 'model point with calibrated interval' ELSE 'model point without interval' END AS price_label, CASE WHEN route = 'baseline' THEN 'not_applicable_baseline' WHEN full_ THEN 'calibrated_released' ELSE 'not_released' END AS interval_status, CASE WHEN full_ THEN point * exp(quantile) END AS p90, CASE WHEN full_ THEN greatest(point * exp(quantile) - point, 0) ELSE point * (exp(q80) - 1) END AS uncertainty, longitude, latitude FROM snap1 s JOIN geo USING (city_id))"""


@query(sql(SNAP_SQL, "SELECT * FROM snap", "city_id horizon", "point reliability p90 uncertainty longitude latitude"))
def scenario_snapshot(spark, sf_dir):
    return out(snapshot(spark, sf_dir))


def _pairs(spark, sf_dir) -> DataFrame:
    """Every source of every target of a product and horizon: targets are the cities that have a place, whether or not they sell."""
    s = snapshot(spark, sf_dir)
    targets = geo(spark, sf_dir).select(F.col("city_id").alias("target_city"), F.col("longitude").alias("target_longitude"), F.col("latitude").alias("target_latitude"))
    return s.join(s.select("product_id", "horizon").distinct().crossJoin(targets), ["product_id", "horizon"])


def _costs_sql(parameters: str = "0.05::DOUBLE AS transport_cost, 0.08::DOUBLE AS loss_rate, 0.5::DOUBLE AS risk_aversion", name: str = "cost", source: str = "") -> str:
    return f"""{name}0 AS (SELECT a.*, b.city_id AS target_city, {_HAV} AS distance_km, {parameters} FROM snap a, geo b{source}),
{name}1 AS (SELECT *, distance_km * 1.25 AS road_km, distance_km * 1.25 * transport_cost AS transport, greatest(1, least(1.5, 1 + (1 - reliability))) AS multiplier FROM {name}0),
{name} AS (SELECT *, risk_aversion * uncertainty * multiplier AS risk_penalty, point + transport + risk_aversion * uncertainty * multiplier AS before_loss, (point + transport + risk_aversion * uncertainty * multiplier) / (1 - loss_rate) AS unit_cost FROM {name}1)"""


@query(sql(SNAP_SQL + ",\n" + _costs_sql(), "SELECT product_id, city_id, horizon, target_city, distance_km, transport, multiplier, risk_penalty, before_loss, unit_cost, unit_cost - before_loss AS loss_cost, unit_cost * 100 AS total_cost FROM cost", "city_id horizon target_city", "distance_km transport multiplier risk_penalty before_loss unit_cost loss_cost total_cost"))
def landed_cost(spark, sf_dir):
    return out(landed.costs(_pairs(spark, sf_dir), SCENARIO).select("product_id", "city_id", "horizon", "target_city", "distance_km", "transport", "multiplier", "risk_penalty", "before_loss", "unit_cost", "loss_cost", "total_cost"))


RANK_SQL = """ranked_cost AS (SELECT *, local_cost - unit_cost AS saving, (local_cost - unit_cost) / local_cost AS saving_rate FROM (SELECT *, row_number() OVER (PARTITION BY product_id, horizon, target_city ORDER BY unit_cost, reliability DESC, city_id) AS rank FROM (SELECT *, max(unit_cost) FILTER (city_id = target_city) OVER (PARTITION BY product_id, horizon, target_city) AS local_cost FROM cost WHERE reliability >= 0.65) WHERE city_id <> target_city AND road_km <= 6000) WHERE rank <= 3)"""


@query(sql(SNAP_SQL + ",\n" + _costs_sql() + ",\n" + RANK_SQL, "SELECT product_id, horizon, target_city, city_id, rank, unit_cost, local_cost, saving, saving_rate FROM ranked_cost", "horizon target_city city_id", "unit_cost local_cost saving saving_rate"))
def rank_sources(spark, sf_dir):
    ranked = landed.rank_sources(landed.costs(_pairs(spark, sf_dir), SCENARIO), SCENARIO)
    return out(ranked.select("product_id", "horizon", "target_city", "city_id", "rank", "unit_cost", "local_cost", "saving", "saving_rate"))


@query(sql(SNAP_SQL + ",\n" + _costs_sql() + ",\nfun AS (SELECT product_id, horizon, target_city, count(*) AS sources, count(*) FILTER (reliability >= 0.65) AS reliable, count(*) FILTER (reliability >= 0.65 AND road_km <= 6000) AS near, count(*) FILTER (reliability >= 0.65 AND road_km <= 6000 AND city_id <> target_city) AS candidates FROM cost GROUP BY 1, 2, 3)", "SELECT p.product_id, h.horizon, g.city_id AS target_city, coalesce(sources, 0) AS sources, coalesce(reliable, 0) AS reliable, coalesce(near, 0) AS near, coalesce(candidates, 0) AS candidates, CASE WHEN sources IS NULL THEN 'no_product_horizon_data' WHEN candidates > 0 THEN 'ok' ELSE 'no_candidates' END AS status FROM (SELECT DISTINCT product_id FROM snap) p, (VALUES (7), (14), (28), (56)) h(horizon), geo g LEFT JOIN fun f ON f.product_id = p.product_id AND f.horizon = h.horizon AND f.target_city = g.city_id", "horizon target_city"))
def source_funnel(spark, sf_dir):
    """Every product, place and horizon that may be asked for; nothing is forecast for the last horizon."""
    asked = snapshot(spark, sf_dir).select("product_id").distinct().withColumn("horizon", F.explode(F.array(*map(F.lit, [*HORIZONS, 56]))))
    asked = asked.crossJoin(geo(spark, sf_dir).select(F.col("city_id").alias("target_city")))
    return out(landed.funnel(landed.costs(_pairs(spark, sf_dir), SCENARIO), SCENARIO, asked=asked))


GRID = {"transport_cost": [0.02, 0.05, 0.08, 0.12], "loss_rate": [0.03, 0.08, 0.15], "risk_aversion": [0.0, 0.5, 1.0]}


def _sensitivity(spark, sf_dir) -> DataFrame:
    fixed = {"road_factor": 1.25, "reliability_gamma": 1.0, "most_multiplier": 1.5, "quantity_kg": 100.0, "least_reliability": 0.65, "max_distance_km": 6000.0}
    each = landed.parameter_grid(landed.distances(_pairs(spark, sf_dir)), GRID).withColumns({k: F.lit(v) for k, v in fixed.items()})
    return landed.rank_sources(landed.costs(each), None, by=("product_id", "horizon", "target_city", "combination"))


GRID_SQL = SNAP_SQL + ",\n" + _costs_sql() + ",\n" + RANK_SQL + ",\n" + _costs_sql("transport_cost, loss_rate, risk_aversion, (ti * 9 + li * 3 + ri) AS combination", "grid", ", (VALUES (0, 0.02::DOUBLE), (1, 0.05::DOUBLE), (2, 0.08::DOUBLE), (3, 0.12::DOUBLE)) t(ti, transport_cost), (VALUES (0, 0.03::DOUBLE), (1, 0.08::DOUBLE), (2, 0.15::DOUBLE)) l(li, loss_rate), (VALUES (0, 0.0::DOUBLE), (1, 0.5::DOUBLE), (2, 1.0::DOUBLE)) r(ri, risk_aversion)") + """,
gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, horizon, target_city, combination ORDER BY unit_cost, reliability DESC, city_id) AS rank FROM grid WHERE reliability >= 0.65 AND city_id <> target_city AND road_km <= 6000) WHERE rank <= 3),
gs AS (SELECT product_id, horizon, target_city, city_id, count(DISTINCT combination) AS top_count, count(DISTINCT combination) FILTER (rank = 1) AS first_count, avg(rank) AS mean_rank, min(unit_cost) AS least_cost, max(unit_cost) AS most_cost FROM gr GROUP BY 1, 2, 3, 4)"""


@query(sql(GRID_SQL, "SELECT gs.*, top_count / 36 AS top_share, first_count / 36 AS first_share, count(*) OVER w AS distinct_top, count(*) FILTER (first_count > 0) OVER w AS distinct_first, r.rank AS default_rank FROM gs LEFT JOIN ranked_cost r USING (product_id, horizon, target_city, city_id) WINDOW w AS (PARTITION BY product_id, horizon, target_city)", "horizon target_city city_id", "mean_rank least_cost most_cost top_share first_share"))
def sensitivity(spark, sf_dir):
    default = landed.rank_sources(landed.costs(_pairs(spark, sf_dir), SCENARIO), SCENARIO)
    return out(landed.sensitivity_summary(_sensitivity(spark, sf_dir), 36, default))


AUDIT_SQL = ", anchor AS (SELECT city_id, avg(longitude) AS longitude, avg(latitude) + 0.4 AS latitude FROM mapping GROUP BY 1)"


@query(sql(given.QUOTES_SQL + AUDIT_SQL, f"SELECT a.market_id, {_HAV} AS distance_km FROM mapping a JOIN anchor b USING (city_id) ORDER BY distance_km DESC, market_id LIMIT 15", "", "distance_km"))
def top_deviations(spark, sf_dir):
    m = given.mapping(spark, sf_dir)
    anchor = m.groupBy("city_id").agg(F.avg("longitude").alias("anchor_longitude"), (F.avg("latitude") + 0.4).alias("anchor_latitude"))
    return out(landed.top_deviations(landed.geo_audit(m.join(anchor, "city_id", "left"))).select("market_id", "distance_km"))


@query(sql(GEO_SQL, "SELECT n_nationkey AS city_id, n_name AS city, r_name AS province, CASE WHEN n_nationkey = 7 THEN 1.5 WHEN r_name <> 'ASIA' THEN longitude END AS longitude, CASE WHEN n_nationkey = 7 THEN 2.5 WHEN r_name <> 'ASIA' THEN latitude END AS latitude, CASE WHEN n_nationkey = 7 THEN 'override' WHEN r_name <> 'ASIA' THEN 'city_centre' ELSE 'unresolved' END AS method, CASE WHEN n_nationkey = 7 THEN 'market place' END AS rule, 'v1' AS geo_version FROM nation JOIN region ON n_regionkey = r_regionkey JOIN geo ON geo.city_id = n_nationkey", "city_id", "longitude latitude"))
def city_geo(spark, sf_dir):
    """Places by name and province; one city by an override row, a province's cities unresolved."""
    m = given.table(spark, sf_dir, "nation").join(given.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cities = m.select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city"), F.col("r_name").alias("province"))
    known = cities.join(geo(spark, sf_dir), "city_id").filter("province <> 'ASIA'")
    override = cities.filter("city_id = 7").select("city_id", F.lit(1.5).alias("longitude"), F.lit(2.5).alias("latitude"), F.lit("market place").alias("rule"))
    return out(landed.city_geo(cities, known, override))


@query(sql(SNAP_SQL, "SELECT product_id, count(DISTINCT city_id) AS cities, count(*) FILTER (NOT point > 0) AS not_positive, 0 AS without_place, any_value(h) AS horizons, min(n) AS least_cities, max(n) AS most_cities, any_value(h) = 3 AND count(*) FILTER (NOT point > 0) = 0 AS feasible FROM (SELECT *, count(DISTINCT city_id) OVER (PARTITION BY product_id, horizon) AS n, count(DISTINCT horizon) OVER (PARTITION BY product_id) AS h FROM snap) GROUP BY 1", "without_place"))
def scenario_feasibility(spark, sf_dir):
    return out(landed.feasibility(snapshot(spark, sf_dir), geo(spark, sf_dir), HORIZONS))


def scenario_documents(spark, sf_dir) -> DataFrame:
    """Lines of a document for each product and target city: its ranked sources at each horizon."""
    ranked = landed.rank_sources(landed.costs(_pairs(spark, sf_dir), SCENARIO), SCENARIO)
    records = ranked.select("product_id", "target_city", "horizon", "rank", "city_id", "unit_cost", "local_cost", "saving", "distance_km", "road_km", "price_label", "risk_basis")
    heads = records.groupBy("product_id", "target_city").agg(F.count("*").alias("sources"))
    return sinks.documents(heads, ["product_id", "target_city"], {"records": (records, ["horizon", "rank"])})


@query(sql(SNAP_SQL + ",\n" + _costs_sql() + ",\n" + RANK_SQL, "SELECT product_id, target_city, count(*) AS sources, string_agg(horizon || ':' || rank || ':' || city_id, ',' ORDER BY horizon, rank) AS ranking, sum(unit_cost) AS unit_cost, sum(road_km) AS road_km, arg_min(price_label, horizon * 10 + rank) AS price_label FROM ranked_cost GROUP BY 1, 2", "target_city", "unit_cost road_km", 3))
def scenario_export(spark, sf_dir):
    """The scenario mart: documents written line by line, read back, and summed up."""
    path = f"{tables.shared_dir(spark)}/mandi-scenarios-{uuid.uuid4().hex}"
    sinks.write_documents(scenario_documents(spark, sf_dir), path, ["product_id", "target_city"])
    docs = sinks.read_documents(spark, path, "product_id string, target_city long, sources long, records array<struct<horizon: bigint, rank: bigint, city_id: bigint, unit_cost: double, road_km: double, price_label: string>>")
    r = F.col("records")
    total = lambda c: F.aggregate(F.transform(r, lambda x: x[c]), F.lit(0.0), lambda s, x: s + x)
    ranking = F.array_join(F.transform(r, lambda x: F.concat_ws(":", *(x[c].cast("string") for c in ("horizon", "rank", "city_id")))), ",")
    return out(docs.select("product_id", "target_city", "sources", ranking.alias("ranking"), total("unit_cost").alias("unit_cost"), total("road_km").alias("road_km"), r[0]["price_label"].alias("price_label")), 3)


@query(sql(forecasts.RELEASE_SQL, "SELECT product_id, horizon, release_status, improvement, CASE WHEN release_status = 'baseline_fallback' THEN 'baseline' ELSE 'model' END AS route FROM matrix", "horizon", "improvement", 4))
def release_routes(spark, sf_dir):
    """The release matrix as nested documents, one for each product, and flat again."""
    matrix = forecast.release_matrix(forecasts._with_intervals(spark, sf_dir), "model", "last_valid")
    nested = matrix.groupBy("product_id").agg(F.to_json(F.struct(F.collect_list(F.struct("product_id", "horizon", "release_status", "improvement")).alias("groups"))).alias("value"))
    return out(landed.flatten_release(nested), 4)
