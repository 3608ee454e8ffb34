"""Forecast scores, intervals and release over the forecast mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandi.functions.scalar import split_of
from mandi.operators import contracts, forecast, metrics, monitor
from mandi.sources import given, sinks

from .common import layer, out, sql
from .temporal import MART_SQL, SERIES_SQL, SPINE_SQL, mart, series, spine

Q, SQL = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


LEVELS = [[], ["product_id"], ["horizon"], ["product_id", "horizon"]]
QUANTILE_LEVELS = [["product_id", "horizon"], ["horizon"], []]


def frame(spark, sf_dir) -> DataFrame:
    """Actual price, baselines and one closed-form model (a quarter of the way to the weekly pattern)."""
    m = mart(spark, sf_dir)
    return m.select("product_id", "city_id", "origin_date", "horizon", "split", F.col("target_price").alias("actual"), F.col("origin_price").alias("last_valid"), F.coalesce("weekly_median", "origin_price").alias("weekly_pattern"), F.coalesce("seasonal_median", "origin_price").alias("historical_seasonal"), forecast.heuristics()["weekly_0.25"].alias("model"))


FRAME_SQL = MART_SQL + """,
frame AS (SELECT product_id, city_id, origin_date, horizon, split, target_price AS actual, origin_price AS last_valid, coalesce(weekly_median, origin_price) AS weekly_pattern, coalesce(seasonal_median, origin_price) AS historical_seasonal,
  origin_price * exp(greatest(-1, least(1, coalesce(ln(weekly_median / origin_price), 0) * 0.25::DOUBLE))) AS model FROM mart),
preds AS (UNPIVOT (SELECT product_id, city_id, horizon, split, actual, last_valid, weekly_pattern, historical_seasonal FROM frame) ON last_valid, weekly_pattern, historical_seasonal INTO NAME method VALUE predicted)"""
_POINT = "count(*) AS rows, sum(abs(actual - predicted)) AS abs_error, sum(abs(actual)) AS abs_actual, sum(abs(actual - predicted)) / sum(abs(actual)) AS wape, avg(abs(actual - predicted)) AS mae, avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) AS smape"


def _predictions(spark, sf_dir, split: str) -> DataFrame:
    df = contracts.assert_splits(frame(spark, sf_dir).filter(F.col("split") == split), {split})
    return metrics.long_predictions(df, {n: n for n in forecast.BASELINES}, ["product_id", "city_id", "horizon", "split", "actual"])


@query(sql(FRAME_SQL, f"SELECT method, product_id, horizon, {_POINT} FROM preds WHERE split = 'validation' GROUP BY GROUPING SETS ((method), (method, product_id), (method, horizon), (method, product_id, horizon))", "horizon", "abs_error abs_actual wape mae smape", 4))
def baseline_scores(spark, sf_dir):
    return out(metrics.scorecard(_predictions(spark, sf_dir, "validation"), LEVELS), 4)


@query(sql(FRAME_SQL + f", s AS (SELECT method, product_id, horizon, {_POINT} FROM preds WHERE split = 'validation' GROUP BY 1, 2, 3)", "SELECT product_id, horizon, first(method ORDER BY wape, list_position(['last_valid', 'weekly_pattern', 'historical_seasonal'], method)) AS best_method, min(wape) AS best_wape FROM s GROUP BY 1, 2", "horizon", "best_wape"))
def best_baseline(spark, sf_dir):
    scores = metrics.scorecard(_predictions(spark, sf_dir, "validation"), [["product_id", "horizon"]])
    return out(metrics.best_method(scores, ["product_id", "horizon"], list(forecast.BASELINES)))


@query(sql(SPINE_SQL + """,
priced AS (SELECT p.product_id, p.city_id, origin_date, origin_date - max(date) AS fill FROM spine p JOIN series s ON s.product_id = p.product_id AND s.city_id = p.city_id AND date BETWEEN origin_date - 1 AND origin_date GROUP BY p.product_id, p.city_id, origin_date),
got AS (SELECT p.*, h AS horizon, CASE WHEN year(origin_date) < 2000 THEN 'train' WHEN year(origin_date) = 2000 THEN 'validation' ELSE 'final_test' END AS split FROM priced p, (VALUES (7), (14), (28)) v(h) JOIN series s ON s.product_id = p.product_id AND s.city_id = p.city_id AND s.date = origin_date + h),
each AS (SELECT product_id, split, horizon, origin_date, count(*) AS series, count(*) FILTER (fill = 0) AS exact, count(*) FILTER (fill > 0) AS filled FROM got GROUP BY ALL)""", "SELECT product_id, split, horizon, count(*) AS origins, min(series) AS least_series, median(series) AS median_series, max(series) AS most_series, sum(exact) AS exact, sum(filled) AS filled, count(*) >= 12 AS usable FROM each GROUP BY 1, 2, 3", "horizon exact filled", "median_series"))
def origin_audit(spark, sf_dir):
    return out(forecast.origin_audit(spine(spark, sf_dir), series(spark, sf_dir), split_of(F.col("origin_date"), given.SPLITS)))


ROUTES_SQL = FRAME_SQL + """,
city AS (SELECT product_id, horizon, split, city_id, sum(abs(actual - model)) AS em, sum(abs(actual - last_valid)) AS eb, sum(actual) AS a, count(*) AS n FROM frame GROUP BY ALL),
imp AS (SELECT product_id, horizon, split, sum(n) AS rows, sum(em) / sum(a) AS model_wape, sum(eb) / sum(a) AS baseline_wape, avg((em < eb)::INT) AS improved_share, CASE WHEN sum(eb) > 0 THEN 1 - sum(em) / sum(a) / (sum(eb) / sum(a)) ELSE 0 END AS improvement FROM city GROUP BY ALL)"""


@query(sql(ROUTES_SQL, "SELECT product_id, horizon, rows, model_wape, baseline_wape, improved_share, improvement, CASE WHEN improvement > 0 AND improved_share > 0.5 THEN 'model' ELSE 'baseline' END AS route FROM imp WHERE split = 'validation'", "horizon rows", "model_wape baseline_wape improved_share improvement"))
def group_routes(spark, sf_dir):
    return out(forecast.routes(frame(spark, sf_dir).filter("split = 'validation'"), "model", "last_valid"))


def _residuals(df: DataFrame) -> DataFrame:
    return df.select("product_id", "horizon", F.abs(F.ln(F.col("actual") / F.col("model"))).alias("residual"))


QUANTILES_SQL = FRAME_SQL + """,
res AS (SELECT product_id, horizon, abs(ln(actual / model)) AS residual FROM frame WHERE split = 'validation'),
q0 AS (SELECT product_id, horizon, residual AS quantile, n FROM (SELECT *, row_number() OVER (PARTITION BY product_id, horizon ORDER BY residual) AS r, count(*) OVER (PARTITION BY product_id, horizon) AS n FROM res) WHERE r = least(n, ceil((n + 1) * 0.8::DOUBLE))),
q1 AS (SELECT horizon, residual AS quantile, n FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY residual) AS r, count(*) OVER (PARTITION BY horizon) AS n FROM res) WHERE r = least(n, ceil((n + 1) * 0.8::DOUBLE))),
q2 AS (SELECT residual AS quantile, n FROM (SELECT *, row_number() OVER (ORDER BY residual) AS r, count(*) OVER () AS n FROM res) WHERE r = least(n, ceil((n + 1) * 0.8::DOUBLE)))"""


@query(sql(QUANTILES_SQL, "SELECT 0 AS level, product_id, horizon, quantile, n FROM q0 UNION ALL SELECT 1, NULL, horizon, quantile, n FROM q1 UNION ALL SELECT 2, NULL, NULL, quantile, n FROM q2", "level horizon", "quantile"))
def conformal_quantiles(spark, sf_dir):
    return out(forecast.conformal_quantiles(_residuals(frame(spark, sf_dir).filter("split = 'validation'")), QUANTILE_LEVELS))


def _with_intervals(spark, sf_dir) -> DataFrame:
    df = frame(spark, sf_dir)
    q = forecast.conformal_quantiles(_residuals(df.filter("split = 'validation'")), QUANTILE_LEVELS)
    return forecast.intervals(forecast.attach_quantile(df.filter("split = 'final_test'"), q, QUANTILE_LEVELS, at_least=10), "model")


INTERVALS_SQL = QUANTILES_SQL + """,
wq AS (SELECT f.*, CASE WHEN q0.n >= 10 THEN q0.quantile WHEN q1.n >= 10 THEN q1.quantile ELSE q2.quantile END AS quantile, CASE WHEN q0.n >= 10 THEN 0 WHEN q1.n >= 10 THEN 1 ELSE 2 END AS quantile_level FROM frame f LEFT JOIN q0 ON q0.product_id = f.product_id AND q0.horizon = f.horizon LEFT JOIN q1 ON q1.horizon = f.horizon, q2 WHERE split = 'final_test'),
iv AS (SELECT *, model * exp(-quantile) AS p10, model AS p50, model * exp(quantile) AS p90 FROM wq)"""
_INTERVAL = "count(*) AS rows, avg((actual >= p10 AND actual <= p90)::INT) AS coverage, avg(p90 - p10) AS mean_width, avg(greatest(0.1 * (actual - p10), -0.9 * (actual - p10))) AS pinball_10, avg(greatest(0.5 * (actual - p50), -0.5 * (actual - p50))) AS pinball_50, avg(greatest(0.9 * (actual - p90), -0.1 * (actual - p90))) AS pinball_90, avg((0.5 * abs(actual - p50) + 0.1 * ((p90 - p10) + 10 * greatest(p10 - actual, 0) + 10 * greatest(actual - p90, 0))) / 1.5) AS wis"


@query(sql(INTERVALS_SQL, "SELECT product_id, city_id, origin_date, horizon, quantile, quantile_level, p10, p50, p90 FROM iv", "horizon quantile_level", "quantile p10 p50 p90"))
def intervals(spark, sf_dir):
    return out(_with_intervals(spark, sf_dir).select("product_id", "city_id", "origin_date", "horizon", "quantile", "quantile_level", "p10", "p50", "p90"))


@query(sql(INTERVALS_SQL, f"SELECT horizon, {_INTERVAL} FROM iv GROUP BY 1", "horizon", "coverage mean_width pinball_10 pinball_50 pinball_90 wis", 4))
def probability_metrics(spark, sf_dir):
    return out(_with_intervals(spark, sf_dir).groupBy("horizon").agg(*metrics.interval_aggregates()), 4)


@query(sql(INTERVALS_SQL + f", sc AS (SELECT scale, {_INTERVAL} FROM (SELECT * REPLACE (model * exp(-quantile * scale) AS p10, model * exp(quantile * scale) AS p90) FROM iv, (VALUES (0.6::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE)) v(scale)) GROUP BY 1)", "SELECT *, coverage BETWEEN 0.75 AND 0.85 AS in_band FROM sc", "", "coverage mean_width pinball_10 pinball_50 pinball_90 wis", 4))
def interval_scales(spark, sf_dir):
    return out(forecast.choose_scale(_with_intervals(spark, sf_dir).drop("p10", "p50", "p90"), "model", [0.6, 0.8, 1.0, 1.2]), 4)


RELEASE_SQL = INTERVALS_SQL.replace("preds AS", "city AS (SELECT product_id, horizon, split, city_id, sum(abs(actual - model)) AS em, sum(abs(actual - last_valid)) AS eb, sum(actual) AS a, count(*) AS n FROM frame GROUP BY ALL),\nimp AS (SELECT product_id, horizon, split, sum(n) AS rows, sum(em) / sum(a) AS model_wape, sum(eb) / sum(a) AS baseline_wape, avg((em < eb)::INT) AS improved_share, CASE WHEN sum(eb) > 0 THEN 1 - sum(em) / sum(a) / (sum(eb) / sum(a)) ELSE 0 END AS improvement FROM city GROUP BY ALL),\npreds AS") + f""",
im AS (SELECT product_id, horizon, {_INTERVAL} FROM iv GROUP BY 1, 2),
matrix AS (SELECT imp.product_id, imp.horizon, imp.rows, model_wape, baseline_wape, improved_share, coverage, mean_width, wis, improvement, CASE WHEN improvement > 0 AND improved_share > 0.5 AND coverage BETWEEN 0.75 AND 0.85 AND improvement >= 0.08 THEN 'model_target' WHEN improvement > 0 AND improved_share > 0.5 AND coverage BETWEEN 0.75 AND 0.85 THEN 'model_minimum' WHEN improvement > 0 AND improved_share > 0.5 THEN 'point_only_model' ELSE 'baseline_fallback' END AS release_status FROM imp JOIN im USING (product_id, horizon) WHERE split = 'final_test')"""


@query(sql(RELEASE_SQL, "SELECT * FROM matrix", "horizon rows", "model_wape baseline_wape improved_share coverage mean_width wis improvement", 4))
def release_matrix(spark, sf_dir):
    return out(forecast.release_matrix(_with_intervals(spark, sf_dir), "model", "last_valid"), 4)


@query(sql(RELEASE_SQL, "SELECT product_id, horizon, city_id, origin_date, release_status, CASE WHEN release_status = 'baseline_fallback' THEN last_valid ELSE model END AS released_point, CASE WHEN release_status IN ('model_target', 'model_minimum') THEN p10 END AS released_p10, CASE WHEN release_status IN ('model_target', 'model_minimum') THEN p90 END AS released_p90 FROM iv JOIN matrix USING (product_id, horizon)", "horizon", "released_point released_p10 released_p90"))
def released_forecasts(spark, sf_dir):
    df = _with_intervals(spark, sf_dir)
    rel = forecast.release(df, forecast.release_matrix(df, "model", "last_valid"), "model", "last_valid")
    return out(rel.select("product_id", "horizon", "city_id", "origin_date", "release_status", "released_point", "released_p10", "released_p90"))


@query(sql(RELEASE_SQL + ", g AS (SELECT horizon, count(*) AS products, count(*) FILTER (improvement > 0) AS improved FROM matrix GROUP BY 1)", "SELECT *, improved >= 3 AS passed, (SELECT bool_and(improved >= 3) FROM g WHERE horizon IN (7, 14)) AS gate_passed FROM g", "horizon"))
def horizon_gate(spark, sf_dir):
    return out(forecast.horizon_gate(forecast.release_matrix(_with_intervals(spark, sf_dir), "model", "last_valid"), 3))


@query(sql(ROUTES_SQL, "SELECT a.product_id, a.horizon, a.improvement AS validation_improvement, b.improvement AS test_improvement, sign(a.improvement) = sign(b.improvement) AS same_sign FROM imp a JOIN imp b ON a.product_id = b.product_id AND a.horizon = b.horizon WHERE a.split = 'validation' AND b.split = 'final_test'", "horizon", "validation_improvement test_improvement"))
def sign_stability(spark, sf_dir):
    df = frame(spark, sf_dir)
    a, b = (forecast.routes(df.filter(F.col("split") == s), "model", "last_valid") for s in ("validation", "final_test"))
    return out(forecast.sign_stability(a, b))


@query(sql(FRAME_SQL + ", w AS (SELECT origin_date, count(*) AS rows, sum(abs(actual - model)) / sum(actual) AS model_wape, sum(abs(actual - last_valid)) / sum(actual) AS baseline_wape FROM frame WHERE split = 'final_test' GROUP BY 1)", "SELECT *, model_wape - baseline_wape AS gap FROM w ORDER BY model_wape - baseline_wape DESC, origin_date LIMIT 10", "", "model_wape baseline_wape gap"))
def weakest_origins(spark, sf_dir):
    return out(forecast.weakest_origins(frame(spark, sf_dir).filter("split = 'final_test'"), "model", "last_valid"))


@query(sql(FRAME_SQL, "SELECT product_id, city_id, horizon, origin_date, actual, model, abs(actual - model) / actual AS ape FROM frame WHERE origin_date = (SELECT max(origin_date) FROM frame)", "horizon", "actual model ape"))
def forecast_snapshot(spark, sf_dir):
    df = frame(spark, sf_dir)
    last = df.agg(F.max("origin_date").alias("origin_date"))
    return out(df.join(F.broadcast(last), "origin_date", "left_semi").select("product_id", "city_id", "horizon", "origin_date", "actual", "model", (F.abs(F.col("actual") - F.col("model")) / F.col("actual")).alias("ape")))


@query(sql(FRAME_SQL, "SELECT product_id, origin_date, sum(n) AS rows, min(city_id) FILTER (held = 3) AS default_city FROM (SELECT product_id, origin_date, city_id, count(*) AS n, count(DISTINCT horizon) AS held FROM frame WHERE origin_date = (SELECT max(origin_date) FROM frame) GROUP BY 1, 2, 3) GROUP BY 1, 2", "rows"))
def default_selections(spark, sf_dir):
    return out(forecast.default_selections(frame(spark, sf_dir)))


@query(sql(RELEASE_SQL, "SELECT product_id, horizon, DATE '2001-10-01' AS evidence_as_of, release_status, CASE WHEN release_status = 'baseline_fallback' THEN 'no_improvement' END AS fallback_reason, CASE WHEN release_status IN ('model_target', 'model_minimum') THEN 'usable' WHEN release_status = 'point_only_model' THEN 'usable_without_interval' ELSE 'reference_only' END AS decision_status FROM matrix", "horizon"))
def evidence_envelope(spark, sf_dir):
    m = forecast.release_matrix(_with_intervals(spark, sf_dir), "model", "last_valid")
    m = m.withColumn("as_of", F.lit("2001-10-01").cast("date")).withColumn("reason", F.when(F.col("release_status") == "baseline_fallback", "no_improvement"))
    return out(monitor.evidence_envelope(m, "as_of", "release_status", "reason", ["product_id", "horizon"]))


@layer
def scored(spark, sf_dir) -> DataFrame:
    """Validation and final rows with the prices of all candidates, learned on train."""
    m = mart(spark, sf_dir)
    got, names = forecast.score(m.filter("split <> 'train'"), forecast.fit_candidates(m.filter("split = 'train'")))
    return got.select(*(F.col(c).alias(n.replace(".", "p")) for n, c in names.items()), *(c for c in got.columns if c not in names.values()))


def _names(df: DataFrame) -> dict[str, str]:
    return {c: c for c in df.columns if c.startswith(("ridge_", "hurdle_", "trend_", "weekly_0", "seasonal_0"))}


@layer
def selected(spark, sf_dir) -> DataFrame:
    """Rows with the selected candidate as ``model`` and the group's best baseline on validation as ``baseline``."""
    df = scored(spark, sf_dir)
    best = forecast.select_candidate(df.filter("split = 'validation'"), _names(df)).first().method
    base = F.coalesce  # a baseline without a value falls back to the last price
    df = df.select(*forecast.KEYS, "split", F.col("target_price").alias("actual"), F.col("origin_price").alias("last_valid"), base("weekly_median", "origin_price").alias("weekly_pattern"), base("seasonal_median", "origin_price").alias("historical_seasonal"), F.col(best).alias("model"))
    scores = metrics.scorecard(metrics.long_predictions(df.filter("split = 'validation'"), {n: n for n in forecast.BASELINES}, ["product_id", "horizon", "actual"]), [["product_id", "horizon"]])
    chosen = metrics.best_method(scores, ["product_id", "horizon"], list(forecast.BASELINES))
    df = df.join(chosen.select("product_id", "horizon", "best_method"), ["product_id", "horizon"], "left")
    return df.withColumn("baseline", F.coalesce(forecast.pick(F.col("best_method"), {n: n for n in forecast.BASELINES}), "last_valid"))


def _routed(spark, sf_dir) -> DataFrame:
    """selected() with the routed point: the model where it is better on validation, else the best baseline."""
    df = selected(spark, sf_dir)
    routes = forecast.routes(df.filter("split = 'validation'"), "model", "baseline").select("product_id", "horizon", "route")
    df = df.join(routes, ["product_id", "horizon"], "left")
    return df.withColumn("routed", F.when(F.col("route") == "model", F.col("model")).otherwise(F.col("baseline")))


def _routed_intervals(spark, sf_dir) -> DataFrame:
    """Final rows with conformal intervals around the routed point, of validation residuals at the chosen width."""
    df = _routed(spark, sf_dir)
    res = lambda x: x.select("product_id", "horizon", F.abs(F.ln(F.col("actual") / F.col("routed"))).alias("residual"))
    q = forecast.conformal_quantiles(res(df.filter("split = 'validation'")), QUANTILE_LEVELS)
    attached = lambda s: forecast.attach_quantile(df.filter(F.col("split") == s), q, QUANTILE_LEVELS, at_least=10)
    scale = forecast.choose_scale(attached("validation"), "routed", [0.6, 0.8, 1.0, 1.2]).first().scale
    return forecast.intervals(attached("final_test"), "routed", scale)


@query()
def point_candidates(spark, sf_dir):
    """Ridge, hurdle and heuristic candidates, trained on train, ranked on validation."""
    df = scored(spark, sf_dir)
    return out(forecast.select_candidate(df.filter("split = 'validation'"), _names(df)))


@query()
def model_routes(spark, sf_dir):
    """The selected candidate on the final split, against each group's best baseline, with its routes."""
    return out(forecast.routes(selected(spark, sf_dir).filter("split = 'final_test'"), "model", "baseline"))


@query()
def model_intervals(spark, sf_dir):
    """Interval scores of the routed point on the final split."""
    return out(_routed_intervals(spark, sf_dir).groupBy("horizon").agg(*metrics.interval_aggregates()), 4)


@query()
def model_release(spark, sf_dir):
    """Release status of each product and horizon for the selected candidate's route."""
    return out(forecast.release_matrix(_routed_intervals(spark, sf_dir), "routed", "baseline"), 4)


@query()
def forecast_export(spark, sf_dir):
    """One JSON document for each product and city: routed points and intervals of the final split in order."""
    df = _routed_intervals(spark, sf_dir)
    return sinks.product_json(df, ["product_id", "city_id"], ["actual", "routed", "p10", "p90", "route"], ["origin_date", "horizon"], {"latest_origin": F.max("origin_date"), "horizons": F.count_distinct("horizon")})
