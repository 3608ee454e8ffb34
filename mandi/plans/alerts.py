"""Spike alerts over weekly origins of dense series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandi.functions.scalar import severity, split_of
from mandi.operators import alerts, metrics, temporal
from mandi.sources import given, sinks

from .common import layer, out, sql
from .temporal import SERIES_SQL, series

Q, SQL = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


LEVELS = {"city_product_month": 8, "city_product_all": 20, "product_month": 30, "product_all": 1, "global": 1}
K = "product_id, city_id, origin_date"


@layer
def weekly_spine(spark, sf_dir) -> DataFrame:
    return temporal.origin_spine(series(spark, sf_dir), "1996-01-01", "2001-10-15", "7 days", 60).select("product_id", "city_id", "origin_date")


@layer
def peaks(spark, sf_dir) -> DataFrame:
    return alerts.future_peak(weekly_spine(spark, sf_dir), series(spark, sf_dir), at_least=3)


@layer
def labels(spark, sf_dir) -> DataFrame:
    df = alerts.alert_labels(peaks(spark, sf_dir), levels=LEVELS)
    return df.withColumn("split", split_of(F.col("origin_date"), given.SPLITS))


PEAK_SQL = SERIES_SQL + """,
worigins AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-10-15', INTERVAL 7 DAY))::DATE AS origin_date),
wspine AS (SELECT k.product_id, k.city_id, origin_date FROM (SELECT DISTINCT product_id, city_id FROM series) k, worigins JOIN series s ON s.product_id = k.product_id AND s.city_id = k.city_id AND s.date < origin_date GROUP BY ALL HAVING count(*) >= 60),
peak0 AS (SELECT w.product_id, w.city_id, origin_date, arg_max(price, date) FILTER (date <= origin_date) AS origin_price, count(*) FILTER (date > origin_date) AS future_days, max(price) FILTER (date > origin_date) AS peak_price FROM wspine w JOIN series s ON s.product_id = w.product_id AND s.city_id = w.city_id AND date BETWEEN origin_date - 1 AND origin_date + 14 GROUP BY ALL),
peak AS (SELECT p.*, (SELECT min(date) FROM series s WHERE s.product_id = p.product_id AND s.city_id = p.city_id AND date > origin_date AND date <= origin_date + 14 AND price = peak_price) AS peak_date, origin_date + 14 AS window_end, peak_price / origin_price - 1 AS peak_return FROM peak0 p WHERE origin_price IS NOT NULL AND future_days >= 3)"""


@query(sql(PEAK_SQL, "SELECT * FROM peak", "", "origin_price peak_price peak_return"))
def future_peak(spark, sf_dir):
    return out(peaks(spark, sf_dir).drop("future"))


def _level(name: str, on: str) -> str:
    join = f" AND {on}" if on else ""
    return f"(SELECT a.product_id, a.city_id, a.origin_date, count(*) AS n, quantile_cont(b.peak_return, 0.9) AS q90, quantile_cont(b.peak_return, 0.95) AS q95 FROM peak a JOIN peak b ON b.window_end <= a.origin_date{join} GROUP BY 1, 2, 3) {name}"


_P, _C, _M = "b.product_id = a.product_id", "b.city_id = a.city_id", "month(b.origin_date) = month(a.origin_date)"
THRESHOLD_SQL = PEAK_SQL + f""",
thr0 AS (SELECT p.*, l1.n AS n1, l1.q90 AS a1, l1.q95 AS b1, l2.n AS n2, l2.q90 AS a2, l2.q95 AS b2, l3.n AS n3, l3.q90 AS a3, l3.q95 AS b3, l4.n AS n4, l4.q90 AS a4, l4.q95 AS b4 FROM peak p
  LEFT JOIN {_level('l1', ' AND '.join((_P, _C, _M)))} USING (product_id, city_id, origin_date) LEFT JOIN {_level('l2', ' AND '.join((_P, _C)))} USING (product_id, city_id, origin_date)
  LEFT JOIN {_level('l3', ' AND '.join((_P, _M)))} USING (product_id, city_id, origin_date) LEFT JOIN {_level('l4', _P)} USING (product_id, city_id, origin_date)),
gl AS (SELECT o.origin_date, count(*) AS n5, quantile_cont(b.peak_return, 0.9) AS a5, quantile_cont(b.peak_return, 0.95) AS b5, max(b.window_end) AS history_end FROM (SELECT DISTINCT origin_date FROM peak) o JOIN peak b ON b.window_end <= o.origin_date GROUP BY 1),
thr AS (SELECT product_id, city_id, origin_date, origin_price, future_days, peak_price, peak_date, window_end, peak_return, history_end,
  CASE WHEN n1 >= 8 THEN 'city_product_month' WHEN n2 >= 20 THEN 'city_product_all' WHEN n3 >= 30 THEN 'product_month' WHEN n4 >= 1 THEN 'product_all' ELSE 'global' END AS threshold_level,
  CASE WHEN n1 >= 8 THEN n1 WHEN n2 >= 20 THEN n2 WHEN n3 >= 30 THEN n3 WHEN n4 >= 1 THEN n4 ELSE n5 END AS threshold_count,
  CASE WHEN n1 >= 8 THEN a1 WHEN n2 >= 20 THEN a2 WHEN n3 >= 30 THEN a3 WHEN n4 >= 1 THEN a4 ELSE a5 END AS threshold_q90,
  CASE WHEN n1 >= 8 THEN b1 WHEN n2 >= 20 THEN b2 WHEN n3 >= 30 THEN b3 WHEN n4 >= 1 THEN b4 ELSE b5 END AS threshold_q95
  FROM thr0 JOIN gl USING (origin_date))"""
_RAW = [f"raw_abs{int(a * 100)}_q{int(q * 100)}" for a, q in alerts.GRID]
EVENT_SQL = THRESHOLD_SQL + """,
raw_ev AS (SELECT *, """ + ", ".join(f"peak_return >= {a} AND peak_return >= threshold_q{int(q * 100)} AS {n}" for n, (a, q) in zip(_RAW, alerts.GRID, strict=True)) + """ FROM thr),
ev AS (SELECT *, row_number() OVER (PARTITION BY product_id, city_id ORDER BY origin_date) AS i FROM (SELECT product_id, city_id, origin_date FROM raw_ev WHERE raw_abs20_q90)),
walk(product_id, city_id, i, origin_date, last_kept, kept) AS (SELECT product_id, city_id, i, origin_date, origin_date, true FROM ev WHERE i = 1 UNION ALL
  SELECT e.product_id, e.city_id, e.i, e.origin_date, CASE WHEN e.origin_date - w.last_kept > 21 THEN e.origin_date ELSE w.last_kept END, e.origin_date - w.last_kept > 21 FROM walk w JOIN ev e ON e.product_id = w.product_id AND e.city_id = w.city_id AND e.i = w.i + 1),
lab0 AS (SELECT r.*, raw_abs20_q90 AS primary_raw_event, coalesce(kept, false) AS event_label, greatest(0.2::DOUBLE, threshold_q90) AS effective_threshold FROM raw_ev r LEFT JOIN walk w ON w.product_id = r.product_id AND w.city_id = r.city_id AND w.origin_date = r.origin_date),
lab1 AS (SELECT l.*, CASE WHEN event_label THEN (SELECT min(date) FROM series s WHERE s.product_id = l.product_id AND s.city_id = l.city_id AND date > origin_date AND date <= origin_date + 14 AND price / origin_price - 1 >= effective_threshold) END AS crossing_date FROM lab0 l),
lab2 AS (SELECT *, crossing_date - origin_date AS lead_days,
  count(*) OVER y AS series_count_52w, avg(event_label::INT) OVER y AS series_rate_52w, avg(event_label::INT) OVER a AS series_rate_all,
  count(*) OVER p AS product_count_52w, avg(event_label::INT) OVER p AS product_rate_52w FROM lab1
  WINDOW y AS (PARTITION BY product_id, city_id ORDER BY origin_date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND INTERVAL 14 DAY PRECEDING), a AS (PARTITION BY product_id, city_id ORDER BY origin_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 14 DAY PRECEDING), p AS (PARTITION BY product_id ORDER BY origin_date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND INTERVAL 14 DAY PRECEDING)),
labels_ AS (SELECT *, CASE WHEN year(origin_date) < 2000 THEN 'train' WHEN year(origin_date) = 2000 THEN 'validation' ELSE 'final_test' END AS split FROM lab2)"""


def _rec(body: str) -> str:
    return "RECURSIVE " + body


@query(sql(THRESHOLD_SQL, f"SELECT {K}, threshold_level, threshold_count, threshold_q90, threshold_q95, history_end FROM thr", "", "threshold_q90 threshold_q95"))
def seasonal_threshold(spark, sf_dir):
    return out(alerts.seasonal_thresholds(peaks(spark, sf_dir).drop("future"), LEVELS).select(*K.split(", "), "threshold_level", "threshold_count", "threshold_q90", "threshold_q95", "history_end"))


_LABELS = f"{K}, {', '.join(_RAW)}, primary_raw_event, event_label, effective_threshold, crossing_date, lead_days, series_count_52w, series_rate_52w, series_rate_all, product_count_52w, product_rate_52w, split"


@query(sql(_rec(EVENT_SQL), f"SELECT {_LABELS} FROM labels_", "lead_days", "effective_threshold series_rate_52w series_rate_all product_rate_52w"))
def alert_labels(spark, sf_dir):
    return out(labels(spark, sf_dir).select(*_LABELS.split(", ")))


@query(sql(_rec(EVENT_SQL), "SELECT split, product_id, count(*) AS rows, count(*) FILTER (primary_raw_event) AS raw_windows, count(*) FILTER (event_label) AS events, avg(event_label::INT) AS rate, avg(lead_days) AS mean_lead FROM labels_ GROUP BY GROUPING SETS ((split), (split, product_id))", "", "rate mean_lead"))
def event_audit(spark, sf_dir):
    df = labels(spark, sf_dir)
    return out(df.groupingSets([[F.col("split")], [F.col("split"), F.col("product_id")]], "split", "product_id").agg(F.count("*").alias("rows"), F.count_if("primary_raw_event").alias("raw_windows"), F.count_if("event_label").alias("events"), F.avg(F.col("event_label").cast("int")).alias("rate"), F.avg("lead_days").alias("mean_lead")))


@query(sql(_rec(EVENT_SQL), f"SELECT {K}, avg(primary_raw_event::INT) OVER (PARTITION BY product_id, origin_date) AS regional_share, CASE WHEN avg(primary_raw_event::INT) OVER (PARTITION BY product_id, origin_date) >= 0.25 THEN 'regional' WHEN avg(primary_raw_event::INT) OVER (PARTITION BY product_id, origin_date) >= 0.1 THEN 'multi_city' ELSE 'local' END AS scope, CASE WHEN peak_return < 0.2 THEN 'below_20pct' WHEN peak_return < 0.5 THEN 'elevated' WHEN peak_return < 1 THEN 'high' ELSE 'extreme' END AS severity FROM labels_", "", "regional_share"))
def event_scope(spark, sf_dir):
    return out(alerts.event_scope(labels(spark, sf_dir)).select(*K.split(", "), "regional_share", "scope", severity(F.col("peak_return")).alias("severity")))


SCORED_SQL = EVENT_SQL + """,
prev AS (SELECT product_id, avg(event_label::INT) AS prevalence FROM labels_ WHERE split = 'train' GROUP BY 1),
scored AS (SELECT l.*, event_label::INT AS label, round(greatest(0.0001, least(0.9999, coalesce(series_rate_52w, prevalence, (SELECT avg(event_label::INT) FROM labels_ WHERE split = 'train')))), 9) AS score FROM labels_ l LEFT JOIN prev USING (product_id) WHERE split <> 'train'),
pts AS (SELECT split, score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1, 2),
run AS (SELECT split, score AS threshold, sum(pos) OVER d AS tp, sum(n) OVER d AS alerts, sum(pos) OVER (PARTITION BY split) AS positives, sum(n) OVER (PARTITION BY split) AS total, row_number() OVER d AS place FROM pts WINDOW d AS (PARTITION BY split ORDER BY score DESC)),
run1 AS (SELECT split, threshold, tp, alerts, positives, total, place FROM run UNION ALL SELECT split, threshold, 0, 0, positives, total, 0 FROM run WHERE place = 1),
curve AS (SELECT *, alerts - tp AS fp, CASE WHEN alerts = 0 THEN 1 ELSE tp / alerts END AS precision, CASE WHEN positives > 0 THEN tp / positives ELSE 0 END AS recall, CASE WHEN total > positives THEN (alerts - tp) / (total - positives) ELSE 0 END AS fpr, CASE WHEN alerts > 0 THEN (alerts - tp) / alerts ELSE 0 END AS false_alert_share FROM run1)"""


def _scored(spark, sf_dir) -> DataFrame:
    df = labels(spark, sf_dir)
    train = df.filter("split = 'train'")
    prev = train.groupBy("product_id").agg(F.avg(F.col("event_label").cast("int")).alias("prevalence"))
    overall = train.agg(F.avg(F.col("event_label").cast("int")).alias("overall"))
    got = df.filter("split <> 'train'").join(prev, "product_id", "left").join(F.broadcast(overall))
    score = F.round(F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), F.coalesce("series_rate_52w", "prevalence", "overall"))), 9)
    return got.withColumns({"label": F.col("event_label").cast("int"), "score": score})


_CURVE = "split, place, threshold, tp, fp, alerts, precision, recall, fpr, false_alert_share"


@query(sql(_rec(SCORED_SQL), f"SELECT {_CURVE} FROM curve", "tp fp alerts", "threshold precision recall fpr false_alert_share"))
def pr_curve(spark, sf_dir):
    return out(metrics.pr_curve(_scored(spark, sf_dir), ["split"]).select(*_CURVE.split(", ")))


@query(sql(_rec(SCORED_SQL), "SELECT split, sum((recall - before) * precision) AS average_precision FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY split ORDER BY place), 0) AS before FROM curve) GROUP BY 1", "", "average_precision"))
def average_precision(spark, sf_dir):
    return out(metrics.average_precision(metrics.pr_curve(_scored(spark, sf_dir), ["split"]), ["split"]))


@query(sql(_rec(SCORED_SQL), "SELECT split, threshold, tp, fp, precision, recall, fpr FROM curve WHERE fpr <= 0.1 + 1e-12 QUALIFY row_number() OVER (PARTITION BY split ORDER BY recall DESC, precision DESC, threshold DESC) = 1", "tp fp", "threshold precision recall fpr"))
def fpr_threshold(spark, sf_dir):
    return out(metrics.threshold_at_fpr(metrics.pr_curve(_scored(spark, sf_dir), ["split"]), ["split"], 0.1))


@query(sql(_rec(SCORED_SQL), "SELECT product_id, count(*) FILTER (score >= 0.05 AND label = 1) AS tp, count(*) FILTER (score >= 0.05 AND label = 0) AS fp, count(*) FILTER (score < 0.05 AND label = 1) AS fn, count(*) FILTER (score < 0.05 AND label = 0) AS tn, coalesce(tp / nullif(tp + fp, 0), 1) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, coalesce(fp / nullif(tp + fp, 0), 0) AS false_alert_share FROM scored GROUP BY 1", "", "precision recall fpr false_alert_share"))
def confusion(spark, sf_dir):
    return out(_scored(spark, sf_dir).groupBy("product_id").agg(*metrics.confusion_aggregates(F.lit(0.05))))


@query(sql(_rec(SCORED_SQL), "SELECT CASE WHEN label = 1 AND score >= 0.05 THEN 'true_positive' WHEN label = 0 AND score >= 0.05 THEN 'false_positive' WHEN label = 1 THEN 'false_negative' ELSE 'true_negative' END AS outcome, month(origin_date) AS month, count(*) AS rows FROM scored GROUP BY 1, 2", "month"))
def outcome_slices(spark, sf_dir):
    df = _scored(spark, sf_dir).withColumn("outcome", alerts.outcome(F.col("label") == 1, F.col("score") >= 0.05))
    return out(df.groupBy("outcome", F.month("origin_date").alias("month")).agg(F.count("*").alias("rows")))


@query(sql(PEAK_SQL, "SELECT product_id, count(DISTINCT city_id) AS series, count(DISTINCT origin_date) AS origins, count(*) AS rows, sum(future_days) AS future_days, " + ", ".join(f"count(*) FILTER (peak_return >= {a}::DOUBLE) AS spikes_{int(100 * a)}" for a in (0.15, 0.20, 0.25)) + ", " + ", ".join(f"count(*) FILTER (peak_return >= {a}::DOUBLE) / count(*) AS rate_{int(100 * a)}" for a in (0.15, 0.20, 0.25)) + " FROM peak GROUP BY 1", "future_days", "rate_15 rate_20 rate_25"))
def weekly_audit(spark, sf_dir):
    return out(alerts.weekly_audit(peaks(spark, sf_dir)))


@layer
def mart(spark, sf_dir) -> DataFrame:
    """Labels with all features known at the origin."""
    return alerts.alert_mart(labels(spark, sf_dir), weekly_spine(spark, sf_dir), series(spark, sf_dir))


def _features_sql() -> str:
    """Features known at each weekly origin, written from their definitions."""
    at = lambda k: f"arg_max(price, date) FILTER (date BETWEEN origin_date - {k + 3} AND origin_date - {k})"
    cols = ["arg_max(price, date) FILTER (date >= origin_date - 1) AS op", "origin_date - max(date) FILTER (date >= origin_date - 1) AS fill"] + [f"{at(k)} AS p{k}" for k in temporal.LAGS]
    for w in temporal.WINDOWS:
        near = f"FILTER (date >= origin_date - {w - 1})"
        cols += [f"avg(price) {near} AS m{w}", f"CASE WHEN count(price) {near} = 1 THEN 0 ELSE stddev_samp(price) {near} END AS s{w}"]
    ln = [f"CASE WHEN op > 0 AND p{k} > 0 THEN ln(op / p{k}) END AS return_{k}d" for k in temporal.LAGS]
    level = [x for w in temporal.WINDOWS for x in (f"CASE WHEN m{w} > 0 THEN s{w} / m{w} END AS rolling_cv_{w}d", f"CASE WHEN m{w} > 0 THEN ln(l.origin_price / m{w}) END AS vs_mean_{w}d")]
    return f"""rec AS (SELECT w.product_id, w.city_id, origin_date, {', '.join(cols)} FROM wspine w JOIN series s ON s.product_id = w.product_id AND s.city_id = w.city_id AND date BETWEEN origin_date - 89 AND origin_date GROUP BY w.product_id, w.city_id, origin_date),
seas AS (SELECT w.product_id, w.city_id, origin_date, CASE WHEN count(*) FILTER (month(date) = month(origin_date)) >= 3 THEN median(price) FILTER (month(date) = month(origin_date)) ELSE median(price) END AS seasonal_median FROM wspine w JOIN series s ON s.product_id = w.product_id AND s.city_id = w.city_id AND date <= origin_date GROUP BY ALL),
own AS (SELECT l.product_id, l.city_id, l.origin_date, {', '.join(ln)}, {', '.join(level)}, CASE WHEN seasonal_median > 0 THEN ln(l.origin_price / seasonal_median) END AS vs_season, q.stale_share, q.outlier_share, q.reliability, fill AS origin_fill_days
  FROM labels_ l JOIN rec USING (product_id, city_id, origin_date) LEFT JOIN seas USING (product_id, city_id, origin_date) LEFT JOIN series q ON q.product_id = l.product_id AND q.city_id = l.city_id AND q.date = l.origin_date - fill::INT),
feat AS (SELECT *, median(return_7d) OVER r AS regional_return_7d, median(return_14d) OVER r AS regional_return_14d, median(return_28d) OVER r AS regional_return_28d, median(rolling_cv_28d) OVER r AS regional_cv_28d, avg(coalesce((return_14d > 0)::INT, 0)) OVER r AS regional_up_share, return_14d - median(return_14d) OVER r AS city_minus_regional FROM own WINDOW r AS (PARTITION BY product_id, origin_date))"""


_OWN = [*(f"return_{k}d" for k in temporal.LAGS), *(f"rolling_cv_{w}d" for w in temporal.WINDOWS), *(f"vs_mean_{w}d" for w in temporal.WINDOWS), "vs_season", "stale_share", "outlier_share", "reliability", *(f"regional_return_{k}d" for k in (7, 14, 28)), "regional_cv_28d", "regional_up_share", "city_minus_regional"]


@query(sql(_rec(EVENT_SQL + ",\n" + _features_sql()), f"SELECT {K}, origin_fill_days, {', '.join(_OWN)} FROM feat", "origin_fill_days", " ".join(_OWN)))
def alert_features(spark, sf_dir):
    """The mart's features: returns, levels, season, quality of the origin's price, and the region's medians."""
    return out(mart(spark, sf_dir).select(*K.split(", "), "origin_fill_days", *_OWN))


BASE_SQL = EVENT_SQL + """,
cvs AS (SELECT w.product_id, w.city_id, origin_date, arg_max(price, date) FILTER (date >= origin_date - 1) AS op, arg_max(price, date) FILTER (date BETWEEN origin_date - 17 AND origin_date - 14) AS p14, avg(price) FILTER (date >= origin_date - 27) AS m28,
  CASE WHEN count(price) FILTER (date >= origin_date - 27) = 1 THEN 0 ELSE stddev_samp(price) FILTER (date >= origin_date - 27) END AS s28
  FROM wspine w JOIN series s ON s.product_id = w.product_id AND s.city_id = w.city_id AND date BETWEEN origin_date - 89 AND origin_date GROUP BY ALL),
feats AS (SELECT l.*, CASE WHEN m28 > 0 THEN s28 / m28 END AS rolling_cv_28d, CASE WHEN op > 0 AND p14 > 0 THEN ln(op / p14) END AS return_14d FROM labels_ l LEFT JOIN cvs USING (product_id, city_id, origin_date)),
tr AS (SELECT * FROM feats WHERE split = 'train'),
ov AS (SELECT avg(event_label::INT) AS overall, median(rolling_cv_28d) AS mc, median(return_14d) AS mr FROM tr),
sd AS (SELECT stddev_pop(coalesce(rolling_cv_28d, mc)) AS sc, stddev_pop(coalesce(return_14d, mr)) AS sr FROM tr, ov),
prv AS (SELECT product_id, avg(event_label::INT) AS prevalence FROM tr GROUP BY 1),
based0 AS (SELECT f.*, coalesce(prevalence, overall) AS p, greatest(-5, least(5, (coalesce(rolling_cv_28d, mc) - mc) / CASE WHEN sc > 1e-12 THEN sc ELSE 1 END)) AS zc, greatest(-5, least(5, (coalesce(return_14d, mr) - mr) / CASE WHEN sr > 1e-12 THEN sr ELSE 1 END)) AS zr FROM feats f LEFT JOIN prv USING (product_id), ov, sd WHERE split <> 'train'),
based1 AS (SELECT *, ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) + 0.6 * zc + 0.4 * zr AS logit FROM based0),
based AS (SELECT *, greatest(0.0001, least(0.9999, p)) AS train_product_prevalence, greatest(0.0001, least(0.9999, coalesce(series_rate_52w, p))) AS series_event_rate_52w, greatest(0.0001, least(0.9999, 1 / (1 + exp(-logit)))) AS volatility_momentum FROM based1)"""


def _based(spark, sf_dir) -> DataFrame:
    df = mart(spark, sf_dir)
    return alerts.baselines(df.filter("split = 'train'"), df.filter("split <> 'train'"))


@query(sql(_rec(BASE_SQL), f"SELECT {K}, {', '.join(alerts.BASELINES)} FROM based", "", " ".join(alerts.BASELINES)))
def alert_baselines(spark, sf_dir):
    """Three scores of validation and final rows, learned on train."""
    return out(_based(spark, sf_dir).select(*K.split(", "), *alerts.BASELINES))


_KEEP = ["split", "product_id", "city_id", "origin_date", "peak_return", "lead_days"]

# The release chain on two closed-form scores, which SQL can follow to the end; the learned scores take the same operators.
RATE, PRIOR = "series_event_rate_52w", "train_product_prevalence"
FINAL_SQL = BASE_SQL + f""",
long_ AS (SELECT l.*, event_label::INT AS label, 'rate' AS score_source, round({RATE}, 9) AS score FROM based l UNION ALL SELECT l.*, event_label::INT, 'prior', round({PRIOR}, 9) FROM based l),
pts AS (SELECT split, score_source, score, sum(label) AS pos, count(*) AS n FROM long_ GROUP BY 1, 2, 3),
run AS (SELECT split, score_source, score AS threshold, sum(pos) OVER d AS tp, sum(n) OVER d AS alerts, sum(pos) OVER (PARTITION BY split, score_source) AS positives, sum(n) OVER (PARTITION BY split, score_source) AS total, row_number() OVER d AS place FROM pts WINDOW d AS (PARTITION BY split, score_source ORDER BY score DESC)),
run1 AS (SELECT split, score_source, threshold, tp, alerts, positives, total, place FROM run UNION ALL SELECT split, score_source, threshold, 0, 0, positives, total, 0 FROM run WHERE place = 1),
curve AS (SELECT *, CASE WHEN alerts = 0 THEN 1 ELSE tp / alerts END AS precision, CASE WHEN positives > 0 THEN tp / positives ELSE 0 END AS recall, CASE WHEN total > positives THEN (alerts - tp) / (total - positives) ELSE 0 END AS fpr FROM run1),
frozen AS (SELECT threshold AS limit_ FROM curve WHERE split = 'validation' AND score_source = 'rate' AND fpr <= 0.1 + 1e-12 ORDER BY recall DESC, precision DESC, threshold DESC LIMIT 1),
ap AS (SELECT split, score_source, sum((recall - before) * precision) AS average_precision FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY split, score_source ORDER BY place), 0) AS before FROM curve) GROUP BY 1, 2),
played AS (SELECT split, product_id, city_id, origin_date, peak_return, lead_days, score, label, score >= limit_ AS alert, raw_abs20_q90,
  CASE WHEN label = 1 AND score >= limit_ THEN 'true_positive' WHEN label = 0 AND score >= limit_ THEN 'false_positive' WHEN label = 1 THEN 'false_negative' ELSE 'true_negative' END AS outcome,
  row_number() OVER (PARTITION BY product_id, origin_date ORDER BY score DESC, city_id) AS risk_place, count(*) FILTER (label = 1) OVER (PARTITION BY product_id, origin_date) AS impacted_cities, CASE WHEN label = 1 THEN score END AS event_point,
  avg(raw_abs20_q90::INT) OVER (PARTITION BY product_id, origin_date) AS regional_share FROM long_, frozen WHERE split = 'final_test' AND score_source = 'rate')"""


def _rated(spark, sf_dir, split: str) -> DataFrame:
    """Rows of a split with both scores, one row for each."""
    df = _based(spark, sf_dir).filter(F.col("split") == split).withColumns({"rate": F.round(RATE, 9), "prior": F.round(PRIOR, 9)})
    return alerts.by_source(df, {"rate": "rate", "prior": "prior"}, [*_KEEP, "raw_abs20_q90"])


def _limit(spark, sf_dir) -> DataFrame:
    """One row: the threshold that validation freezes."""
    curve = metrics.pr_curve(_rated(spark, sf_dir, "validation").filter("score_source = 'rate'"), ["split"])
    return metrics.threshold_at_fpr(curve, ["split"], 0.1).select(F.col("threshold").alias("limit"))


def _rate_played(spark, sf_dir) -> DataFrame:
    df = _rated(spark, sf_dir, "final_test").filter("score_source = 'rate'").crossJoin(_limit(spark, sf_dir))
    return alerts.event_scope(alerts.replay(df, F.col("limit")), "raw_abs20_q90")


@query(sql(_rec(FINAL_SQL), f"SELECT {K}, score, label, outcome, risk_place, impacted_cities, event_point, regional_share, CASE WHEN regional_share >= 0.25 THEN 'regional' WHEN regional_share >= 0.1 THEN 'multi_city' ELSE 'local' END AS scope FROM played", "label", "score event_point regional_share"))
def baseline_replay(spark, sf_dir):
    """The final split played back with the series' rate as score, at the threshold frozen on validation."""
    return out(_rate_played(spark, sf_dir).select(*K.split(", "), "score", "label", "outcome", "risk_place", "impacted_cities", "event_point", "regional_share", "scope"))


@query(sql(_rec(FINAL_SQL), f"""SELECT {K}, outcome, score, peak_return, "case" FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY CASE WHEN outcome = 'false_negative' THEN peak_return ELSE score END DESC, CASE WHEN outcome = 'false_negative' THEN score ELSE peak_return END DESC, product_id, city_id, origin_date) AS "case" FROM played WHERE outcome <> 'true_negative') WHERE "case" <= 10""", "", "score peak_return"))
def baseline_cases(spark, sf_dir):
    """Ten examples of each outcome."""
    return out(alerts.top_cases(_rate_played(spark, sf_dir)).select(*K.split(", "), "outcome", "score", "peak_return", "case"))


_SLICE = "count(*) AS rows, sum(label) AS events, avg(label) AS prevalence, avg(pow(score - label, 2)) AS brier, count(*) FILTER (alert AND label = 1) AS tp, count(*) FILTER (alert AND label = 0) AS fp, count(*) FILTER (NOT alert AND label = 1) AS fn, count(*) FILTER (NOT alert AND label = 0) AS tn"


@query(sql(_rec(FINAL_SQL), f"SELECT 'product' AS kind, product_id AS slice, {_SLICE} FROM played GROUP BY 2 UNION ALL SELECT 'month', strftime(origin_date, '%Y-%m'), {_SLICE} FROM played GROUP BY 2 UNION ALL SELECT 'scope', CASE WHEN regional_share >= 0.25 THEN 'regional' WHEN regional_share >= 0.1 THEN 'multi_city' ELSE 'local' END, {_SLICE} FROM played GROUP BY 2", "events", "prevalence brier"))
def baseline_slices(spark, sf_dir):
    """The final split by product, month and scope at the frozen threshold."""
    df = _rate_played(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("slice")) for k, c in (("product", F.col("product_id")), ("month", F.date_format("origin_date", "yyyy-MM")), ("scope", F.col("scope")))))
    long = df.select("score", "label", "limit", F.explode(each).alias("x")).select("x.*", "score", "label", "limit")
    got = alerts.slices(long, F.col("limit"), ["kind", "slice"])
    return out(got.select("kind", "slice", "rows", "events", "prevalence", "brier", "tp", "fp", "fn", "tn"))


@query(sql(_rec(FINAL_SQL), """SELECT score_source, place, threshold, precision, recall, fpr FROM (SELECT *, row_number() OVER (PARTITION BY score_source, slot ORDER BY place) AS k FROM (SELECT *, floor((row_number() OVER w - 1) * 159 / greatest(count(*) OVER (PARTITION BY score_source) - 1, 1)) AS slot FROM curve WHERE split = 'final_test' WINDOW w AS (PARTITION BY score_source ORDER BY place))) WHERE k = 1""", "", "threshold precision recall fpr"))
def baseline_curves(spark, sf_dir):
    """Curves of both scores on the final split, at most 160 points each."""
    curve = metrics.pr_curve(_rated(spark, sf_dir, "final_test"), ["score_source"])
    return out(alerts.sample_curve(curve, ["score_source"]).select("score_source", "place", "threshold", "precision", "recall", "fpr"))


@query(sql(_rec(FINAL_SQL) + """,
g AS (SELECT count(*) FILTER (alert AND label = 1) AS tp, count(*) FILTER (alert) AS n, sum(label) AS events, count(*) AS rows, avg(label) AS prevalence FROM played),
h AS (SELECT tp, events, rows, prevalence, coalesce(tp / nullif(n, 0), 1) AS precision, coalesce(tp / nullif(events, 0), 0) AS recall, coalesce((n - tp) / nullif(rows - events, 0), 0) AS fpr, (SELECT average_precision FROM ap WHERE split = 'final_test' AND score_source = 'rate') AS average_precision, (SELECT average_precision FROM ap WHERE split = 'final_test' AND score_source = 'prior') AS base FROM g),
c AS (SELECT *, base > 0 AND average_precision / base - 1 >= 0.2 AS lift_ok, fpr <= 0.12 AS fpr_ok, recall >= 0.3 AS recall_ok, precision >= prevalence * 2 AS precision_ok, tp >= 20 AS positives_ok FROM h)""", "SELECT rows, events, precision, recall, fpr, average_precision, lift_ok, fpr_ok, recall_ok, precision_ok, positives_ok, CASE WHEN lift_ok AND fpr_ok AND recall_ok AND precision_ok AND positives_ok THEN 'alert_release' WHEN average_precision > base AND recall >= 0.2 THEN 'research_only' ELSE 'no_signal' END AS release_status FROM c", "events", "precision recall fpr average_precision"))
def baseline_release(spark, sf_dir):
    """The series' rate on the final split at its frozen threshold, gated against the product's prevalence."""
    final = _rated(spark, sf_dir, "final_test")
    base = metrics.average_precision(metrics.pr_curve(final.filter("score_source = 'prior'"), ["score_source"]), ["score_source"]).select(F.col("average_precision").alias("base"))
    got = alerts.slices(final.filter("score_source = 'rate'").crossJoin(_limit(spark, sf_dir)), F.col("limit"), ["score_source"]).crossJoin(base)
    gated = alerts.release_gate(got, F.col("base"))
    return out(gated.select("rows", "events", "precision", "recall", "fpr", "average_precision", "lift_ok", "fpr_ok", "recall_ok", "precision_ok", "positives_ok", "release_status"))


@layer
def scored_alerts(spark, sf_dir) -> DataFrame:
    """Validation and final rows with the scores of all baselines and candidates."""
    based = _based(spark, sf_dir)
    score, names = alerts.fit_logistic(mart(spark, sf_dir).filter("split = 'train'"), [*alerts.NUMERIC, *alerts.DERIVED], alerts.CATEGORIES)
    return score(based).select(*_KEEP, "event_label", *(c for c in based.columns if c.startswith("raw_abs")), *alerts.BASELINES, *(F.col(c).alias(n.replace(".", "p").replace("-", "m")) for c, (n, _, _) in names.items()))


def _candidates() -> dict[str, tuple[float, float]]:
    return {f"logistic_r{r:g}_pw{w:g}".replace(".", "p").replace("-", "m"): (r, w) for r in alerts.RIDGES for w in alerts.WEIGHTS}


def _bundle(spark, sf_dir, scores: list[str], split: str) -> DataFrame:
    df = scored_alerts(spark, sf_dir).filter(F.col("split") == split)
    return alerts.score_bundle(alerts.by_source(df, {c: c for c in scores}, _KEEP), ["score_source"])


@layer
def ranked_candidates(spark, sf_dir) -> DataFrame:
    bundle = _bundle(spark, sf_dir, list(_candidates()), "validation")
    grid = spark.createDataFrame([(n, r, w) for n, (r, w) in _candidates().items()], "score_source string, ridge double, weight double")
    return alerts.rank_candidates(bundle.join(grid, "score_source"))


def _frozen(spark, sf_dir) -> tuple[str, float, str]:
    """The selected candidate, its threshold on validation, and the best baseline there: one row each."""
    best = alerts.rank_candidates(ranked_candidates(spark, sf_dir)).first()
    base = _bundle(spark, sf_dir, list(alerts.BASELINES), "validation").orderBy(F.desc("average_precision"), "score_source").first()
    return best.score_source, best.threshold, base.score_source


@query()
def alert_logistic(spark, sf_dir):
    """All ridge and weight candidates on validation, best first."""
    return out(ranked_candidates(spark, sf_dir))


@query()
def alert_release(spark, sf_dir):
    """The selected candidate on the final split at its frozen threshold, gated against the best baseline."""
    model, threshold, base = _frozen(spark, sf_dir)
    final = alerts.by_source(scored_alerts(spark, sf_dir).filter("split = 'final_test'"), {model: model}, _KEEP)
    got = alerts.slices(final, F.lit(threshold), ["score_source"])
    best = _bundle(spark, sf_dir, [base], "final_test").select(F.col("average_precision").alias("baseline_precision"))
    return out(alerts.release_gate(got.crossJoin(best), F.col("baseline_precision")).withColumn("threshold", F.lit(threshold)))


def _final(spark, sf_dir) -> tuple[DataFrame, float]:
    model, threshold, _ = _frozen(spark, sf_dir)
    df = scored_alerts(spark, sf_dir).filter("split = 'final_test'")
    return df.withColumns({"label": F.col("event_label").cast("int"), "score": F.col(model)}), threshold


@query()
def alert_slices(spark, sf_dir):
    """The final split by product, by month and by label definition, at the frozen threshold."""
    df, threshold = _final(spark, sf_dir)
    month = F.date_format("origin_date", "yyyy-MM")
    raws = [c for c in df.columns if c.startswith("raw_abs")]
    each = F.array(F.struct(F.lit("product").alias("kind"), F.col("product_id").alias("slice"), F.col("label").alias("l")), F.struct(F.lit("month").alias("kind"), month.alias("slice"), F.col("label").alias("l")), *(F.struct(F.lit("label").alias("kind"), F.lit(c).alias("slice"), F.col(c).cast("int").alias("l")) for c in raws))
    long = df.select("score", F.explode(each).alias("x")).select("x.kind", "x.slice", F.col("x.l").alias("label"), "score")
    return out(alerts.slices(long, F.lit(threshold), ["kind", "slice"]))


@query()
def alert_replay(spark, sf_dir):
    """All final rows with outcome, place among the origin's risks, and impacted cities."""
    df, threshold = _final(spark, sf_dir)
    return out(alerts.event_scope(alerts.replay(df, F.lit(threshold)), "raw_abs20_q90").select(*_KEEP, "score", "label", "outcome", "risk_place", "impacted_cities", "event_point", "regional_share", "scope"))


@query()
def alert_cases(spark, sf_dir):
    df, threshold = _final(spark, sf_dir)
    return out(alerts.top_cases(alerts.replay(df, F.lit(threshold))).select(*_KEEP, "score", "outcome", "case"))


@query()
def alert_curves(spark, sf_dir):
    """Curves of the selected candidate and all baselines on the final split, at most 160 points each."""
    model, _, _ = _frozen(spark, sf_dir)
    long = alerts.by_source(scored_alerts(spark, sf_dir).filter("split = 'final_test'"), {c: c for c in (model, *alerts.BASELINES)}, ["split"])
    return out(alerts.sample_curve(metrics.pr_curve(long, ["score_source"]), ["score_source"]).select("score_source", "place", "threshold", "precision", "recall", "fpr"))


@query()
def alert_export(spark, sf_dir):
    """One JSON document for each product and city: its records in order, with the page's default case marked."""
    df, threshold = _final(spark, sf_dir)
    played = alerts.replay(df, F.lit(threshold))
    first = alerts.default_case(played).select(*alerts.KEYS, "origin_date", F.lit(True).alias("is_default"))
    df = played.join(first, [*alerts.KEYS, "origin_date"], "left").withColumn("is_default", F.coalesce("is_default", F.lit(False)))
    return sinks.product_json(df, ["product_id", "city_id"], ["score", "outcome", "peak_return", "lead_days", "is_default"], ["origin_date"], {"rows": F.count("*")})
