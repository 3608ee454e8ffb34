"""Forecasts: features, ridge and hurdle models, heuristics, routes, conformal intervals, release.

Ridge models are solved from cross-products that one pass sums up; everything else is expressions and aggregates over the forecast mart.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .temporal import LAGS, WINDOWS

BASELINES = {"last_valid": "origin_price", "weekly_pattern": "weekly_median", "historical_seasonal": "seasonal_median"}
RIDGE, SHRINK = (0.1, 1.0, 10.0, 100.0), (0.25, 0.5, 0.75, 1.0)
KEYS = ["product_id", "city_id", "origin_date", "horizon"]


def baselines(mart: DataFrame) -> DataFrame:
    """Long predictions of the baselines; one without a value falls back to the last price."""
    filled = mart.select(*KEYS, "split", F.col("target_price").alias("actual"), *(F.coalesce(c, "origin_price").alias(name) for name, c in BASELINES.items()))
    return metrics.long_predictions(filled, {n: n for n in BASELINES}, [*KEYS, "split", "actual"])


def features(mart: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numeric features of the mart: ratios to rolling levels, lags and their gaps, calendar, history."""
    ln = lambda a, b: F.when((a > 0) & (b > 0), F.ln(a / b))
    new = {f"vs_mean_{w}d": ln(F.col(f"rolling_mean_{w}d"), F.col("origin_price")) for w in WINDOWS}
    new |= {f"vs_median_{w}d": ln(F.col(f"rolling_median_{w}d"), F.col("origin_price")) for w in WINDOWS}
    new |= {f"cv_{w}d": F.when(F.col(f"rolling_mean_{w}d") > 0, F.col(f"rolling_std_{w}d") / F.col(f"rolling_mean_{w}d")) for w in WINDOWS}
    new |= {f"missing_{k}d": F.col(f"lag_missing_{k}d").cast("double") for k in LAGS}
    new |= {"vs_season": ln(F.col("seasonal_median"), F.col("origin_price")), "vs_week": ln(F.col("weekly_median"), F.col("origin_price"))}
    direct = ["log_origin_price", "origin_fill_days", "unchanged_share", "origin_day_sin", "origin_day_cos", "target_day_sin", "target_day_cos", *(f"return_{k}d" for k in LAGS), "history"]
    lags = [f"lag_gap_{k}d" for k in LAGS]
    df = mart.withColumns(new).withColumns({c: F.col(c).cast("double") for c in [*direct, *lags]})
    return df, [*direct, *lags, *new]


def fit_preparation(train: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median, and mean and population deviation after filling with it, of each feature that isn't constant: two aggregates.

    A constant feature has no weight in a ridge model, and would leave its equations singular.
    """
    medians = train.agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in names)).first()
    fill = {c: medians[c] if medians[c] is not None else 0.0 for c in names}
    filled = train.select(*(F.coalesce(c, F.lit(fill[c])).alias(c) for c in names))
    row = filled.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    return {c: (fill[c], row[f"m_{c}"], row[f"s_{c}"]) for c in names if row[f"s_{c}"] and row[f"s_{c}"] > 1e-12}


def prepare(df: DataFrame, fitted: dict) -> DataFrame:
    """df with each feature filled and scaled as x_<feature>, and the product-horizon group."""
    return df.withColumns({f"x_{c}": (F.coalesce(c, F.lit(m)) - mean) / sd for c, (m, mean, sd) in fitted.items()}).withColumn("group", F.concat_ws("|", "product_id", "horizon"))


def normal_equations(ready: DataFrame, names: list[str], levels: list[str], labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-products of the design (constant, features x_<name>, one column for each level of group) and the labels: of all rows, and of those with moved = 1.

    One pass: a task adds its rows' products up, entries are summed over tasks, and their number is fixed by the
    columns.  Every ridge model of any label and penalty follows from them.
    """
    size = 1 + len(names) + len(levels)
    width = size + len(labels)
    place = {v: i for i, v in enumerate(levels)}

    def partial(batches):
        total = np.zeros((2, size, width))
        for pdf in batches:
            x = np.zeros((len(pdf), width))
            x[:, 0] = 1
            x[:, 1 : 1 + len(names)] = pdf[[f"x_{c}" for c in names]].to_numpy(float)
            x[np.arange(len(pdf)), 1 + len(names) + pdf["group"].map(place).to_numpy(int)] = 1
            x[:, size:] = pdf[labels].to_numpy(float)
            for k, rows in enumerate((x, x[pdf["moved"].to_numpy() == 1])):
                total[k] += rows[:, :size].T @ rows
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    sums = ready.select(*(f"x_{c}" for c in names), "group", *dict.fromkeys([*labels, "moved"])).mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(2 * size * width)
    for r in sums.collect():
        out[r.i] = r.v
    return tuple(out.reshape(2, size, width))


def ridge(products: np.ndarray, label: int, alpha: float) -> np.ndarray:
    """Coefficients (constant first, which has no penalty) from normal_equations()."""
    size = len(products)
    penalty = alpha * np.eye(size)
    penalty[0, 0] = 0
    return np.linalg.solve(products[:, :size] + penalty, products[:, size + label])


def linear(coefficients: np.ndarray, names: list[str], levels: list[str]) -> Column:
    """The prediction of prepared rows; a group that wasn't learned adds nothing."""
    own = F.aggregate(F.zip_with(F.array(*(F.col(f"x_{c}") for c in names)), F.array(*(F.lit(float(w)) for w in coefficients[1 : 1 + len(names)])), lambda x, w: x * w), F.lit(float(coefficients[0])), lambda acc, v: acc + v)
    of_group = F.create_map(*(F.lit(x) for v, w in zip(levels, coefficients[1 + len(names) :], strict=True) for x in (v, float(w))))
    return own + F.coalesce(F.try_element_at(of_group, F.col("group")), F.lit(0.0))


def price_of(ret: Column, shrink: float = 1.0) -> Column:
    """A price from a shrunk return, held at one in either direction."""
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ret * shrink))
    return F.col("origin_price") * F.exp(r)


def heuristics() -> dict[str, Column]:
    """Nine candidates: damped trend, weekly blend, seasonal blend."""
    trend = F.coalesce("return_7d", F.lit(0.0)) * F.col("horizon") / 7
    week, season = F.coalesce(F.ln(F.col("weekly_median") / F.col("origin_price")), F.lit(0.0)), F.coalesce(F.ln(F.col("seasonal_median") / F.col("origin_price")), F.lit(0.0))
    return {f"{name}_{w}": price_of(r, w) for name, r, ws in (("trend", trend, (0.1, 0.2, 0.4)), ("weekly", week, (0.25, 0.5, 0.75)), ("seasonal", season, (0.1, 0.25, 0.5))) for w in ws}


def fit_candidates(train: DataFrame, alphas=RIDGE, shrinks=SHRINK, moved: float = 0.01) -> dict:
    """Frozen parts of all candidates: preparation, levels, and for each penalty the ridge model and the hurdle's two."""
    df, names = features(train)
    fitted = fit_preparation(df, names)
    ready = prepare(df, fitted).withColumn("moved", (F.abs("target_return") > moved).cast("double"))
    levels = sorted(r.group for r in ready.select("group").distinct().collect())  # products times horizons
    every, large = normal_equations(ready, list(fitted), levels, ["target_return", "moved"])
    models = {a: (ridge(every, 0, a), ridge(every, 1, a), ridge(large, 0, a)) for a in alphas}
    return {"names": names, "fitted": fitted, "levels": levels, "models": models, "shrinks": shrinks}


def score(mart: DataFrame, frozen: dict) -> tuple[DataFrame, dict[str, str]]:
    """mart with a price column for each candidate, and the columns by candidate."""
    df = prepare(features(mart)[0], frozen["fitted"])
    parts = {f"{kind}_{i}": linear(w, list(frozen["fitted"]), frozen["levels"]) for i, trio in enumerate(frozen["models"].values()) for kind, w in zip(("ridge", "move", "size"), trio, strict=True)}
    df, columns = df.withColumns(parts), {}
    for i, a in enumerate(frozen["models"]):
        for s in frozen["shrinks"]:
            columns[f"ridge_a{a}_s{s}"] = price_of(F.col(f"ridge_{i}"), s)
            columns[f"hurdle_a{a}_s{s}"] = price_of(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"move_{i}"))) * F.col(f"size_{i}"), s)
    columns |= heuristics()
    names = {name: f"c{i}" for i, name in enumerate(columns)}
    keep = [*KEYS, "split", "origin_price", "target_price", "weekly_median", "seasonal_median"]
    return df.select(*keep, *(c.alias(names[n]) for n, c in columns.items())), names


def select_candidate(scored: DataFrame, names: dict[str, str]) -> DataFrame:
    """Candidates by (WAPE, name), best first."""
    long = metrics.long_predictions(scored.withColumn("actual", F.col("target_price")), names, ["actual"])
    return metrics.scorecard(long, [[]]).select("method", "rows", "wape").orderBy("wape", "method")


def improved_share(df: DataFrame, model: str, baseline: str, by: list[str]) -> DataFrame:
    """Share of a group's cities where the model's WAPE is below the baseline's."""
    e = lambda c: F.sum(F.abs(F.col("actual") - F.col(c)))
    city = df.groupBy(*by, "city_id").agg((e(model) < e(baseline)).cast("double").alias("better"), e(model).alias("em"), e(baseline).alias("eb"), F.sum("actual").alias("a"), F.count("*").alias("n"))
    return city.groupBy(*by).agg(F.sum("n").alias("rows"), (F.sum("em") / F.sum("a")).alias("model_wape"), (F.sum("eb") / F.sum("a")).alias("baseline_wape"), F.avg("better").alias("improved_share"))


def routes(df: DataFrame, model: str, baseline: str) -> DataFrame:
    """Per product and horizon: the model if it is better overall and in most cities."""
    r = improved_share(df, model, baseline, ["product_id", "horizon"])
    gain = F.when(F.col("baseline_wape") > 0, 1 - F.col("model_wape") / F.col("baseline_wape")).otherwise(0.0)
    return r.withColumn("improvement", gain).withColumn("route", F.when((F.col("improvement") > 0) & (F.col("improved_share") > 0.5), "model").otherwise("baseline"))


def pick(name: Column, columns: dict[str, str]) -> Column:
    """The column whose label is in ``name``."""
    return reduce(lambda acc, kv: acc.when(name == kv[0], F.col(kv[1])), list(columns.items())[1:], F.when(name == next(iter(columns)), F.col(next(iter(columns.values())))))


def conformal_quantiles(residuals: DataFrame, levels: list[list[str]], alpha: float = 0.2, fine: int = 4096) -> DataFrame:
    """Per level, the k-th smallest residual with k = min(n, ceil((n + 1)(1 - alpha))), and n.

    Rows are counted by slices of the residual, ``fine`` for each unit, with map-side combine; running
    counts over slices find the one that holds rank k, and only its rows are ranked.
    """
    every = list(dict.fromkeys(c for level in levels for c in level))
    sliced = residuals.select(*every, "residual", F.floor(F.col("residual") * fine).alias("slice"))
    counts, frames = sliced.groupBy(*every, "slice").agg(F.count("*").alias("n")), []
    for i, by in enumerate(levels):
        w = Window.partitionBy(*by)
        run = counts.groupBy(*by, "slice").agg(F.sum("n").alias("n")).select(*by, "slice", "n", F.sum("n").over(w).alias("total"), F.sum("n").over(w.orderBy("slice")).alias("upto"))
        run = run.withColumn("k", F.least("total", F.ceil((F.col("total") + 1) * F.lit(1 - alpha)))).filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        held = sliced.join(run.select(*by, "slice", "total", (F.col("k") - F.col("upto") + F.col("n")).alias("k")), [*by, "slice"])
        ranked = held.withColumn("rank", F.row_number().over(w.orderBy("residual"))).filter("rank = k")
        frames.append(ranked.select(F.lit(i).alias("level"), *(F.col(c) if c in by else F.lit(None).cast(residuals.schema[c].dataType).alias(c) for c in every), F.col("residual").alias("quantile"), F.col("total").alias("n")))
    return reduce(DataFrame.unionByName, frames)


def attach_quantile(df: DataFrame, quantiles: DataFrame, levels: list[list[str]], at_least: int = 100) -> DataFrame:
    """The finest level with enough residuals; the last level always counts.  Adds quantile, quantile_level."""
    for i, by in enumerate(levels):
        q = quantiles.filter(F.col("level") == i).select(*by, F.col("quantile").alias(f"q{i}"), F.col("n").alias(f"n{i}"))
        df = df.join(q, by, "left") if by else df.join(q, how="left")  # one row without columns to join on
    last = len(levels) - 1
    chosen = F.coalesce(*(F.when((F.col(f"n{i}") >= at_least) | F.lit(i == last), F.col(f"q{i}")) for i in range(last + 1)))
    level = F.coalesce(*(F.when((F.col(f"n{i}") >= at_least) | F.lit(i == last), F.lit(i)) for i in range(last + 1)))
    return df.withColumn("quantile", chosen).withColumn("quantile_level", level).drop(*(f"{c}{i}" for i in range(last + 1) for c in "qn"))


def intervals(df: DataFrame, point: str, scale: Column | float = 1.0) -> DataFrame:
    """p10, p50, p90 around the point, by a factor in either direction."""
    half = F.col("quantile") * (scale if isinstance(scale, Column) else F.lit(scale))
    return df.withColumns({"p10": F.col(point) * F.exp(-half), "p50": F.col(point), "p90": F.col(point) * F.exp(half)})


def choose_scale(df: DataFrame, point: str, scales: list[float], low: float = 0.75, high: float = 0.85) -> DataFrame:
    """Scores of each width scale, the chosen one first: in-band coverage, then least WIS; else nearest to 0.8."""
    each = df.withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    scored = intervals(each, point, F.col("scale")).groupBy("scale").agg(*metrics.interval_aggregates())
    inside = F.col("coverage").between(low, high)
    return scored.withColumn("in_band", inside).orderBy(F.desc("in_band"), F.when(inside, F.col("wis")).otherwise(F.abs(F.col("coverage") - 0.8)), "scale")


def release_matrix(df: DataFrame, model: str, baseline: str, target: float = 0.08) -> DataFrame:
    """Status of each product and horizon on the final split, from points and intervals."""
    r = improved_share(df, model, baseline, ["product_id", "horizon"])
    i = df.groupBy("product_id", "horizon").agg(*metrics.interval_aggregates()).select("product_id", "horizon", "coverage", "mean_width", "wis")
    gain = F.when(F.col("baseline_wape") > 0, 1 - F.col("model_wape") / F.col("baseline_wape")).otherwise(0.0)
    point, covered = (F.col("improvement") > 0) & (F.col("improved_share") > 0.5), F.col("coverage").between(0.75, 0.85)
    status = F.when(point & covered & (F.col("improvement") >= target), "model_target").when(point & covered, "model_minimum").when(point, "point_only_model").otherwise("baseline_fallback")
    return r.join(i, ["product_id", "horizon"]).withColumn("improvement", gain).withColumn("release_status", status)


def release(df: DataFrame, matrix: DataFrame, model: str, baseline: str) -> DataFrame:
    """Released point and interval; no interval unless the model's is released."""
    out = df.join(matrix.select("product_id", "horizon", "release_status"), ["product_id", "horizon"])
    full = F.col("release_status").isin("model_target", "model_minimum")
    return out.withColumns({"released_point": F.when(F.col("release_status") == "baseline_fallback", F.col(baseline)).otherwise(F.col(model)), "released_p10": F.when(full, F.col("p10")), "released_p90": F.when(full, F.col("p90"))})


def horizon_gate(matrix: DataFrame, need: int, horizons: tuple[int, ...] = (7, 14)) -> DataFrame:
    """Products that improve at each horizon, and whether the gate horizons all have enough."""
    n = matrix.groupBy("horizon").agg(F.count("*").alias("products"), F.count_if(F.col("improvement") > 0).alias("improved"))
    return n.withColumn("passed", F.col("improved") >= need).withColumn("gate_passed", F.min(F.when(F.col("horizon").isin(*horizons), F.col("passed"))).over(Window.partitionBy()))


def sign_stability(validation: DataFrame, test: DataFrame) -> DataFrame:
    """Whether improvement keeps its sign from validation to test, per product and horizon."""
    a, b = (m.select("product_id", "horizon", F.col("improvement").alias(n)) for m, n in ((validation, "validation_improvement"), (test, "test_improvement")))
    return a.join(b, ["product_id", "horizon"]).withColumn("same_sign", F.signum("validation_improvement") == F.signum("test_improvement"))


def weakest_origins(df: DataFrame, model: str, baseline: str, n: int = 10) -> DataFrame:
    e = lambda c: F.sum(F.abs(F.col("actual") - F.col(c))) / F.sum("actual")
    return df.groupBy("origin_date").agg(F.count("*").alias("rows"), e(model).alias("model_wape"), e(baseline).alias("baseline_wape")).withColumn("gap", F.col("model_wape") - F.col("baseline_wape")).orderBy(F.desc("gap"), "origin_date").limit(n)


def default_selections(df: DataFrame, horizons: int = 3) -> DataFrame:
    """What a page of forecasts opens with, for each product: the last origin of all, its rows, and the first city that has every horizon there (null: none)."""
    last = df.agg(F.max("origin_date").alias("origin_date"))
    shown = df.join(F.broadcast(last), "origin_date", "left_semi")  # one row
    cities = shown.groupBy("product_id", "origin_date", "city_id").agg(F.count("*").alias("n"), F.count_distinct("horizon").alias("held"))
    return cities.groupBy("product_id", "origin_date").agg(F.sum("n").alias("rows"), F.min(F.when(F.col("held") == horizons, F.col("city_id"))).alias("default_city"))


def origin_audit(spine: DataFrame, series: DataFrame, split: Column, horizons=(7, 14, 28), need: int = 12) -> DataFrame:
    """Origins with a price and an observed target, per product, split and horizon."""
    from .temporal import origin_price_columns, window_join

    priced = window_join(spine, series, 1, 0, ["price"]).groupBy("product_id", "city_id", "origin_date").agg(*origin_price_columns()).filter("origin_price IS NOT NULL")
    asked = priced.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("target_date", F.date_add("origin_date", F.col("horizon")))
    got = asked.join(series.select("product_id", "city_id", F.col("date").alias("target_date")), ["product_id", "city_id", "target_date"]).withColumn("split", split)
    each = got.groupBy("product_id", "split", "horizon", "origin_date").agg(F.count("*").alias("series"), F.count_if(F.col("origin_fill_days") == 0).alias("exact"), F.count_if(F.col("origin_fill_days") > 0).alias("filled"))
    return each.groupBy("product_id", "split", "horizon").agg(F.count("*").alias("origins"), F.min("series").alias("least_series"), F.percentile("series", F.lit(0.5)).alias("median_series"), F.max("series").alias("most_series"), F.sum("exact").alias("exact"), F.sum("filled").alias("filled"), (F.count("*") >= need).alias("usable"))
