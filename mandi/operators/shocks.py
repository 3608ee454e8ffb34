"""Common shocks and lead-lag edges: binned panels, leave-one-out factors, exposure, networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mandi.functions.scalar import bin_start, haversine, median

KEYS = ["product_id", "city_id"]


def binned_panel(days: DataFrame, anchor: str, size: int, at_least: int) -> DataFrame:
    """Median price per series and bin; log return against exactly the bin before."""
    bins = days.withColumn("bin_start", bin_start(F.col("date"), anchor, size)).groupBy(*KEYS, "bin_start").agg(median("price").alias("price"), F.count_distinct("date").alias("observed_days"), F.avg("reliability").alias("mean_reliability"))
    w = Window.partitionBy(*KEYS).orderBy("bin_start")
    follows = F.datediff("bin_start", F.lag("bin_start").over(w)) == size
    return bins.filter(F.col("observed_days") >= at_least).withColumn("log_return", F.when(follows, F.ln(F.col("price") / F.lag("price").over(w))))


def seasonal_adjust(panel: DataFrame, position: Column, split: str = "train", at_least: int = 3) -> DataFrame:
    """Return less the train median of its season: the series' own if it has enough, else the product's."""
    df = panel.withColumn("season", position)
    train = df.filter((F.col("split") == split) & F.col("log_return").isNotNull())
    own = train.groupBy(*KEYS, "season").agg(F.count("*").alias("own_n"), median("log_return").alias("own_median"))
    product = train.groupBy("product_id", "season").agg(median("log_return").alias("product_median"))
    out = df.join(own, [*KEYS, "season"], "left").join(product, ["product_id", "season"], "left")
    season = F.when(F.col("own_n") >= at_least, F.col("own_median")).otherwise(F.col("product_median"))
    return out.withColumn("seasonal_return", season).withColumn("adjusted_return", F.col("log_return") - F.col("seasonal_return")).drop("own_n", "own_median", "product_median")


def loo_median(panel: DataFrame, value: str = "adjusted_return", by: tuple[str, ...] = ("product_id", "bin_start"), at_least: int = 10) -> DataFrame:
    """Median of the other series of the bin, and how many there are.

    Each bin's values are sorted once, in an aggregate; the median of the rest is an order statistic of
    them with places from this row's on moved by one, so a row takes three values and no array along.
    """
    have = F.col(value).isNotNull()
    bins = panel.filter(have).groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("sorted"))
    df = panel.join(bins, list(by), "left")
    rank = F.array_position("sorted", F.col(value))  # of equal values any may go
    peers = F.when(have, F.size("sorted") - 1).otherwise(0)
    at = lambda k: F.element_at("sorted", (k + F.when(k >= rank, 1).otherwise(0)).cast("int"))
    lo, hi = F.floor((peers + 1) / 2), F.floor((peers + 2) / 2)
    return df.select(*panel.columns, peers.alias("peers"), F.when(have & (peers >= at_least), (at(lo) + at(hi)) / 2).alias("common_factor"))


def shock_flags(panel: DataFrame, q: float = 0.95) -> DataFrame:
    """Residual against the common factor, the series' train quantile of it, and strict exceedance."""
    df = panel.withColumn("residual", F.col("adjusted_return") - F.col("common_factor"))
    limits = df.filter("split = 'train' AND residual IS NOT NULL").groupBy(*KEYS).agg(F.percentile("residual", F.lit(q)).alias("shock_threshold"))
    return df.join(limits, KEYS, "left").withColumn("positive_shock", F.coalesce(F.col("residual") > F.col("shock_threshold"), F.lit(False)))


def shock_timeline(panel: DataFrame, q: float = 0.95) -> DataFrame:
    """Per product and bin: median factor and return, exposed and observed cities; flag above the train quantile."""
    bins = panel.groupBy("product_id", "bin_start", "split").agg(median("common_factor").alias("common_factor"), median("adjusted_return").alias("median_return"), F.count_if("positive_shock").alias("exposed"), F.count("*").alias("observed"))
    limit = bins.filter("split = 'train'").groupBy("product_id").agg(F.percentile("common_factor", F.lit(q)).alias("limit"))
    return bins.join(limit, "product_id", "left").withColumn("common_shock", F.coalesce(F.col("common_factor") > F.col("limit"), F.lit(False)))


def city_exposure(panel: DataFrame, windows: dict[str, list[str]]) -> DataFrame:
    """Shocks, beta, correlation, volatility and a composite rank of each city, per window of splits."""
    each = F.array_compact(F.array(*(F.when(F.col("split").isin(v), F.lit(k)) for k, v in windows.items())))
    df = panel.withColumn("window", F.explode(each))
    x, y = F.when(F.col("adjusted_return").isNotNull(), F.col("common_factor")), F.when(F.col("common_factor").isNotNull(), F.col("adjusted_return"))
    enough = (F.count(x) >= 4) & (F.var_samp(x) > 0)
    got = df.groupBy("window", *KEYS).agg(
        F.count("*").alias("bins"), F.count_if("positive_shock").alias("shocks"), F.avg(F.col("positive_shock").cast("double")).alias("shock_rate"), F.when(enough, F.covar_samp(x, y) / F.var_samp(x)).alias("beta"), F.when(enough, F.corr(x, y)).alias("correlation"),
        F.stddev_samp("residual").alias("volatility"), F.avg("mean_reliability").alias("mean_reliability"), F.max_by("price", "bin_start").alias("latest_price"),
    )
    w = Window.partitionBy("window", "product_id")

    def share(c: Column) -> Column:  # ties share the mean rank; missing values have none
        have = c.isNotNull()
        ties = F.count("*").over(Window.partitionBy("window", "product_id", c))
        return F.when(have, (F.rank().over(w.orderBy(c.asc_nulls_last())) + (ties - 1) / 2) / F.count(c).over(w))

    got = got.withColumn("held_beta", F.greatest("beta", F.lit(0.0))).withColumn("held_beta", F.when(F.col("beta").isNotNull(), F.col("held_beta")))
    score = 100 * (0.45 * share(F.col("shock_rate")) + 0.35 * share(F.col("held_beta")) + 0.20 * share(F.col("volatility")))
    out = got.withColumn("exposure_score", score)
    return out.withColumn("exposure_rank", F.row_number().over(w.orderBy(F.round("exposure_score", 9).desc_nulls_last(), "city_id"))).drop("held_beta")


def exposure_view(cities: DataFrame, timeline: DataFrame, top: int = 10) -> DataFrame:
    """The top cities of each window and product by rank, with the product's common shocks and its highest factor."""
    peak = timeline.groupBy("product_id").agg(F.count_if("common_shock").alias("common_shocks"), F.max("common_factor").alias("peak_factor"), F.max_by("bin_start", "common_factor").alias("peak_start"))
    return cities.filter(F.col("exposure_rank") <= top).join(peak, "product_id", "left")


def coverage_table(panel: DataFrame, splits: list[str]) -> DataFrame:
    return panel.groupBy(*KEYS).pivot("split", splits).count().na.fill(0, splits)


def eligible_series(primary: DataFrame, weekly: DataFrame, least: dict[str, int], least_weekly: dict[str, int]) -> DataFrame:
    """Series with enough bins in every split at both frequencies."""
    a, b = coverage_table(primary, list(least)), coverage_table(weekly, list(least_weekly))
    for s, n in least.items():
        a = a.filter(F.col(s) >= n)
    for s, n in least_weekly.items():
        b = b.filter(F.col(s) >= n)
    return a.join(b.select(*KEYS), KEYS, "left_semi")


def candidate_edges(cities: DataFrame, most: int = 8, share: float = 0.35) -> DataFrame:
    """Sources of each target within a product: same province first, then nearest; at most a share of the others.

    cities: product_id, city_id, province, longitude, latitude; a product's cities are few.
    """
    a = cities.select("product_id", *(F.col(c).alias(f"target_{c}") for c in ("city_id", "province", "longitude", "latitude")))
    b = cities.select("product_id", *(F.col(c).alias(f"source_{c}") for c in ("city_id", "province", "longitude", "latitude")))
    pairs = a.join(b, "product_id").filter("target_city_id <> source_city_id")
    same = F.col("source_province") == F.col("target_province")
    km = haversine(F.col("source_longitude"), F.col("source_latitude"), F.col("target_longitude"), F.col("target_latitude"))
    w = Window.partitionBy("product_id", "target_city_id")
    df = pairs.withColumns({"same_province": same, "distance_km": km, "others": F.count("*").over(w)})
    rank = F.row_number().over(w.orderBy(F.desc("same_province"), F.round("distance_km", 9), "source_city_id"))
    return df.withColumn("candidate_rank", rank).filter(F.col("candidate_rank") <= F.least(F.lit(most), F.floor(F.col("others") * share))).select("product_id", "source_city_id", "target_city_id", "candidate_rank", "same_province", "distance_km")


def gram(panel: DataFrame, columns: list[str], bins: int = 64) -> DataFrame:
    """product_id, a, b (cities, a < b) and for each column n, means' and products' sums over the bins in which both have a value.

    The matrix of a product's bins by cities is cut into blocks of ``bins`` days' bins; a block's partial products of
    columns are one matrix product, and blocks add up.  The panel isn't joined with itself.
    """
    names = [f"{x}_{c}" for c in columns for x in ("n", "sa", "sb", "qa", "qb", "ab")]

    def partial(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cities, at = np.unique(rows["city_id"].to_numpy(str), return_inverse=True)
        days, day = np.unique(rows["day"].to_numpy(), return_inverse=True)
        i, j = np.triu_indices(len(cities), 1)
        out = {"product_id": key[0], "a": cities[i], "b": cities[j]}
        for c in columns:
            x, m = np.zeros((2, len(days), len(cities)))
            value = rows[c].to_numpy(float)
            x[day, at], m[day, at] = np.nan_to_num(value), ~np.isnan(value)
            n, s, q, xy = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
            out |= dict(zip((f"{k}_{c}" for k in ("n", "sa", "sb", "qa", "qb", "ab")), (n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], xy[i, j]), strict=True))
        found = pd.DataFrame(out)
        return found[found[[f"n_{c}" for c in columns]].max(axis=1) > 0]

    day = F.unix_date("bin_start")
    blocks = panel.select("product_id", F.col("city_id").cast("string").alias("city_id"), day.alias("day"), F.floor(day / bins).alias("block"), *(F.col(c).cast("double").alias(c) for c in columns)).groupBy("product_id", "block")
    ddl = f"product_id {panel.schema['product_id'].dataType.simpleString()}, a string, b string, " + ", ".join(f"{n} double" for n in names)
    return blocks.applyInPandas(partial, ddl).groupBy("product_id", "a", "b").agg(*(F.sum(n).alias(n) for n in names))


def correlations(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """gram()'s pairs with rho and n of each column (a column without variance: null)."""
    v = lambda c, x: F.col(f"n_{c}") * F.col(f"q{x}_{c}") - F.col(f"s{x}_{c}") * F.col(f"s{x}_{c}")
    spread = lambda c: F.sqrt(F.greatest(v(c, "a"), F.lit(0.0)) * F.greatest(v(c, "b"), F.lit(0.0)))
    rho = lambda c: F.when(spread(c) > 0, (F.col(f"n_{c}") * F.col(f"ab_{c}") - F.col(f"sa_{c}") * F.col(f"sb_{c}")) / spread(c))
    return pairs.select("product_id", "a", "b", *(x for c in columns for x in (rho(c).alias(f"rho_{c}"), F.col(f"n_{c}").cast("long").alias(f"n_{c}"))))


def pairwise_corr(panel: DataFrame, columns: list[str], at_least: int = 30) -> DataFrame:
    """Mean and median absolute correlation of a product's pairs of cities over common bins."""
    pair = correlations(gram(panel, columns), columns)
    ok = lambda c: F.when(F.col(f"n_{c}") >= at_least, F.abs(f"rho_{c}"))
    return pair.groupBy("product_id").agg(*(x for c in columns for x in (F.count(ok(c)).alias(f"pairs_{c}"), F.avg(ok(c)).alias(f"mean_{c}"), median(ok(c)).alias(f"median_{c}"))))


# ---------------------------------------------------------------- regressions per group


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by a continued fraction."""
    from math import exp, lgamma, log, log1p

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """Two-sided P(|T| > t)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def _ols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def _predict(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x]) @ beta


def edge_frame(lagged: DataFrame, edges: DataFrame, own: list[str], source: list[str], target: str) -> DataFrame:
    """Rows of each edge: the target's value and lags with the source's lags of the same bin."""
    t = lagged.select("product_id", F.col("city_id").alias("target_city_id"), "bin_start", "split", target, *own)
    s = lagged.select("product_id", F.col("city_id").alias("source_city_id"), "bin_start", *(F.col(c).alias(f"source_{c}") for c in source))
    return edges.join(t, ["product_id", "target_city_id"]).join(s, ["product_id", "source_city_id", "bin_start"]).dropna(subset=[target, *own, *(f"source_{c}" for c in source)])


EDGE = ["product_id", "source_city_id", "target_city_id"]
_EDGE_DDL = "product_id string, source_city_id string, target_city_id string, fit_rows long, test_rows long, f_statistic double, p_value double, source_sum double, source_coefficients array<double>, dominant_lag long, rmse double, rmse_full double, mae double, mae_full double"


def edge_models(frame: DataFrame, own: list[str], source: list[str], target: str, fit: tuple[str, ...] = ("train",), test: str = "validation", least_fit: int = 300, least_test: int = 60, bin_days: int = 3) -> DataFrame:
    """Restricted and full regression of each edge: joint F test of the source lags, and test errors.

    An edge with too few rows has NULL results.  One edge's bins are one group: a series is at most
    some thousand bins long.  Gains are shares of the restricted model's error.
    """
    lags = [f"source_{c}" for c in source]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.split.isin(fit)].sort_values("bin_start"), pdf[pdf.split == test].sort_values("bin_start")
        row = {k: pdf[k].iloc[0] for k in EDGE} | {"fit_rows": len(a), "test_rows": len(b)} | dict.fromkeys(("f_statistic", "p_value", "source_sum", "source_coefficients", "dominant_lag", "rmse", "rmse_full", "mae", "mae_full"))
        if len(a) >= least_fit and len(b) >= least_test:
            y, yt, few, all_ = a[target].to_numpy(float), b[target].to_numpy(float), a[own].to_numpy(float), a[own + lags].to_numpy(float)
            r, f = _ols(few, y), _ols(all_, y)
            rss_r, rss_f = ((y - _predict(few, r)) ** 2).sum(), ((y - _predict(all_, f)) ** 2).sum()
            df2 = len(a) - len(own) - len(lags) - 1
            if df2 > 0 and rss_f > 0:
                row["f_statistic"] = float(max(0.0, (rss_r - rss_f) / len(lags) / (rss_f / df2)))
                row["p_value"] = f_tail(row["f_statistic"], len(lags), df2)
            beta = f[1 + len(own) :]
            er, ef = yt - _predict(b[own].to_numpy(float), r), yt - _predict(b[own + lags].to_numpy(float), f)
            rms, mean = (lambda e: float(np.sqrt((e**2).mean()))), (lambda e: float(np.abs(e).mean()))
            row |= {"source_sum": float(beta.sum()), "source_coefficients": beta.tolist(), "dominant_lag": int(np.argmax(np.abs(beta))) + 1, "rmse": rms(er), "rmse_full": rms(ef), "mae": mean(er), "mae_full": mean(ef)}
        return pd.DataFrame([row])

    gain = lambda m: F.when(F.col(m) > 0, 1 - F.col(f"{m}_full") / F.col(m)).alias(f"{m}_gain")
    return frame.groupBy(*EDGE).applyInPandas(one, _EDGE_DDL).select("*", (F.col("dominant_lag") * bin_days).alias("expected_delay_days"), gain("rmse"), gain("mae"))


def validation_gate(tested: DataFrame, rmse: float = 0.01, mae: float = 0.005) -> DataFrame:
    ok = F.col("reject") & (F.col("source_sum") > 0) & (F.col("rmse_gain") >= rmse) & (F.col("mae_gain") >= -mae)
    return tested.withColumn("validated", F.coalesce(ok, F.lit(False)))


def funnel(tested: DataFrame) -> DataFrame:
    """How many edges of each product every step leaves."""
    return tested.groupBy("product_id").agg(F.count("*").alias("candidates"), F.count("source_sum").alias("modelled"), F.count_if("reject").alias("rejected"), F.count_if("validated").alias("validated"))


def series_ols(lagged: DataFrame, names: list[str], target: str, least_fit: int = 300, least_test: int = 60) -> DataFrame:
    """Regression of each series on its own and the factor's lags; errors against a forecast of zero."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[target, *names])
        a, b = pdf[pdf.split == "train"], pdf[pdf.split == "validation"]
        row = {"product_id": pdf.product_id.iloc[0] if len(pdf) else None, "city_id": pdf.city_id.iloc[0] if len(pdf) else None, "fit_rows": len(a), "test_rows": len(b), "rmse": None, "rmse_zero": None, "mae": None, "mae_zero": None}
        if len(a) >= least_fit and len(b) >= least_test:
            e = b[target].to_numpy(float) - _predict(b[names].to_numpy(float), _ols(a[names].to_numpy(float), a[target].to_numpy(float)))
            z = b[target].to_numpy(float)
            row |= {"rmse": float(np.sqrt((e**2).mean())), "rmse_zero": float(np.sqrt((z**2).mean())), "mae": float(np.abs(e).mean()), "mae_zero": float(np.abs(z).mean())}
        return pd.DataFrame([row])

    return lagged.select("product_id", "city_id", "split", target, *names).groupBy(*KEYS).applyInPandas(one, "product_id string, city_id string, fit_rows long, test_rows long, rmse double, rmse_zero double, mae double, mae_zero double")


def _source_sums(products: np.ndarray, own: int) -> np.ndarray:
    """Sum of the source coefficients of each fit, from its matrix of cross-products (constant, own, source lags, target); nan where it is singular."""
    xx, xy = products[:, :-1, :-1], products[:, :-1, -1:]
    scale = 1 / np.sqrt(np.maximum(np.diagonal(xx, axis1=1, axis2=2), 1e-300))
    xx, xy = xx * scale[:, :, None] * scale[:, None, :], xy * scale[:, :, None]
    sound = np.linalg.cond(xx) < 1e10
    out = np.full(len(xx), np.nan)
    if sound.any():
        out[sound] = (np.linalg.solve(xx[sound], xy[sound])[:, :, 0] * scale[sound])[:, 1 + own :].sum(axis=1)
    return out


def resampled_sums(x: np.ndarray, y: np.ndarray, starts: np.ndarray, block: int, own: int) -> np.ndarray:
    """Sum of the source coefficients of each resample: a row of starts is a resample of blocks, cut to as many rows as there are.

    A block's cross-products are the difference of two running sums, and a resample's the sum of its blocks': rows are
    read once, not for each resample.  Resamples whose cross-products are near singular are fitted on rows.
    """
    n, k = len(x), starts.shape[1]
    z = np.column_stack([np.ones(n), x, y])
    upto = np.concatenate([np.zeros((1, z.shape[1], z.shape[1])), np.cumsum(z[:, :, None] * z[:, None, :], axis=0)])
    whole, odd = starts[:, : k - 1], starts[:, k - 1]
    times = np.zeros((len(starts), n - block + 1))
    np.add.at(times, (np.repeat(np.arange(len(starts)), k - 1), whole.ravel()), 1)
    size = z.shape[1]
    blocks = (upto[block:] - upto[: n - block + 1]).reshape(n - block + 1, size * size)
    products = (times @ blocks).reshape(-1, size, size) + upto[odd + n - block * (k - 1)] - upto[odd]
    sums = _source_sums(products, own)
    for i in np.flatnonzero(np.isnan(sums)):
        at = (starts[i][:, None] + np.arange(block)).ravel()[:n]
        sums[i] = _ols(x[at], y[at])[1 + own :].sum()
    return sums


def block_bootstrap(frame: DataFrame, own: list[str], source: list[str], target: str, draws: int = 250, block: int = 8, seed: int = 20260914) -> DataFrame:
    """Share of moving-block resamples in which the source lags of an edge sum to more than zero, and the sum in either half.

    An edge's draws come from a seed of its own keys, so they don't depend on partitions.  Fewer rows
    than a block: no rate.
    """
    import hashlib

    lags = [f"source_{c}" for c in source]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin_start")
        x, y, n = pdf[own + lags].to_numpy(float), pdf[target].to_numpy(float), len(pdf)
        k = [str(pdf[c].iloc[0]) for c in EDGE]
        rate = None
        if n >= block:
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256("|".join([str(seed), *k]).encode()).digest()[:8], "little"))
            starts = np.stack([rng.integers(0, n - block + 1, size=-(-n // block)) for _ in range(draws)])
            rate = float((resampled_sums(x, y, starts, block, len(own)) > 0).mean())
        half = n // 2
        first, second = (float(_ols(x[at], y[at])[1 + len(own) :].sum()) if n > 1 else None for at in (slice(0, half), slice(half, n)))
        return pd.DataFrame([dict(zip(EDGE, k, strict=True)) | {"rows": n, "positive_rate": rate, "first_half_sum": first, "second_half_sum": second, "halves_positive": bool(n > 1 and first > 0 and second > 0)}])

    return frame.groupBy(*EDGE).applyInPandas(one, "product_id string, source_city_id string, target_city_id string, rows long, positive_rate double, first_half_sum double, second_half_sum double, halves_positive boolean")


def weekly_diagnostic(weekly: DataFrame) -> DataFrame:
    """What weekly edge_models() say of each edge; an edge without them isn't available."""
    have = F.col("source_sum").isNotNull()
    return weekly.select(*EDGE, have.alias("weekly_available"), F.col("fit_rows").alias("weekly_fit_rows"), F.col("test_rows").alias("weekly_test_rows"), F.col("source_sum").alias("weekly_source_sum"), F.col("rmse_gain").alias("weekly_rmse_gain"), F.col("mae_gain").alias("weekly_mae_gain"), (have & (F.col("source_sum") > 0)).alias("weekly_consistent"))


def stability_gate(validated: DataFrame, bootstrap: DataFrame, weekly: DataFrame, least_rate: float = 0.60) -> DataFrame:
    """Validated edges with their stability: both halves positive and a high enough bootstrap rate.

    The weekly diagnostic only marks edges as sensitive to the frequency.
    """
    df = validated.join(bootstrap.drop("rows"), EDGE, "left").join(weekly_diagnostic(weekly), EDGE, "left")
    stable = F.coalesce(F.col("halves_positive") & (F.col("positive_rate") >= least_rate), F.lit(False))
    return df.withColumns({"frequency_sensitive": ~F.coalesce("weekly_consistent", F.lit(False)), "stable": stable})


def frozen_edges_final(stable: DataFrame, refit: DataFrame, least_gain: float = 0.0, strong: float = 0.01) -> DataFrame:
    """Stable edges with their gains on the final split, of models refitted on all earlier ones."""
    got = refit.select(*EDGE, F.col("fit_rows").alias("refit_rows"), F.col("test_rows").alias("final_rows"), F.col("rmse_gain").alias("final_rmse_gain"), F.col("mae_gain").alias("final_mae_gain"))
    df = stable.filter("stable").join(got, EDGE)
    return df.withColumns({"confirmed": F.coalesce(F.col("final_rmse_gain") > least_gain, F.lit(False)), "strong": F.coalesce(F.col("final_rmse_gain") >= strong, F.lit(False))})


RELEASE = {"products": 5, "edges_per_product": 3, "positive_share": 0.70, "median_gain": 0.01}


def release_decision(final: DataFrame, network: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    """One row: the gates' figures, whether each passes, and network_release or common_shock_only.

    network: edges with reject_raw and reject_residual, for whether the common factor thins it out.
    """
    g = RELEASE | (gates or {})
    products = final.groupBy("product_id").agg(F.count_if("confirmed").alias("n")).agg(F.count_if(F.col("n") >= g["edges_per_product"]).alias("qualifying_products"))
    edges = final.agg(F.count("*").alias("frozen_edges"), F.count_if("confirmed").alias("confirmed_edges"), F.count_if("strong").alias("strong_edges"), median("final_rmse_gain").alias("median_gain"), F.coalesce(F.bool_and(F.col("reject") & F.col("stable")), F.lit(True)).alias("complete"))
    reduced = network.agg(F.count_if("reject_raw").alias("raw_edges"), F.count_if("reject_residual").alias("residual_edges"))
    df = edges.crossJoin(products).crossJoin(reduced)  # one row each
    df = df.withColumn("positive_share", F.when(F.col("frozen_edges") > 0, F.col("confirmed_edges") / F.col("frozen_edges")).otherwise(0.0))
    passed = {"products_ok": F.col("qualifying_products") >= g["products"], "share_ok": F.col("positive_share") >= g["positive_share"], "gain_ok": F.coalesce(F.col("median_gain") >= g["median_gain"], F.lit(False)), "complete_ok": F.col("complete"), "reduced_ok": F.col("residual_edges") < F.col("raw_edges")}
    df = df.withColumns(passed)
    every = F.col("products_ok") & F.col("share_ok") & F.col("gain_ok") & F.col("complete_ok") & F.col("reduced_ok")
    return df.withColumn("release_status", F.when(every, "network_release").otherwise("common_shock_only"))


def feasibility(eligible: DataFrame, edges: DataFrame, panel: DataFrame, splits: list[str]) -> DataFrame:
    """Per product: eligible cities, candidate edges and their density, sources per target, distances, shocks by split."""
    cities = eligible.groupBy("product_id").agg(F.count_distinct("city_id").alias("eligible_cities"))
    per = edges.groupBy("product_id", "target_city_id").agg(F.count("*").alias("n")).groupBy("product_id").agg(F.min("n").alias("least_sources"), F.max("n").alias("most_sources"))
    all_ = edges.groupBy("product_id").agg(F.count("*").alias("candidate_edges"), median("distance_km").alias("median_distance_km"), F.avg(F.col("same_province").cast("double")).alias("same_province_share"))
    shocks = panel.filter("positive_shock").groupBy("product_id").agg(*(F.count_if(F.col("split") == s).alias(f"shocks_{s}") for s in splits))
    df = cities.join(all_, "product_id", "left").join(per, "product_id", "left").join(shocks, "product_id", "left").na.fill(0, ["candidate_edges", "least_sources", "most_sources", *(f"shocks_{s}" for s in splits)])
    possible = F.col("eligible_cities") * (F.col("eligible_cities") - 1)
    return df.withColumn("possible_edges", possible).withColumn("density", F.when(F.col("possible_edges") > 0, F.col("candidate_edges") / F.col("possible_edges")).otherwise(0.0))


def correlation_tests(edges: DataFrame, pairs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Contemporaneous correlation of each edge's two cities and its two-sided t test, from gram()'s pairs; columns: name of a test, its column."""
    both = correlations(pairs, list(columns.values())).withColumnsRenamed({f"{x}_{c}": f"{x}_{n}" for n, c in columns.items() for x in ("rho", "n")})
    ends = {"a": F.least("source_city_id", "target_city_id"), "b": F.greatest("source_city_id", "target_city_id")}
    got = edges.select(*EDGE).withColumns(ends).join(both, ["product_id", "a", "b"]).drop("a", "b")
    tail = F.pandas_udf(lambda t, df: pd.Series([t_tail(x, d) if x == x and d > 0 else None for x, d in zip(t, df, strict=True)]), "double")
    for n in columns:
        rho, df = F.col(f"rho_{n}"), F.col(f"n_{n}") - 2
        got = got.withColumn(f"p_{n}", tail(F.abs(rho) * F.sqrt(df / F.greatest(1 - rho * rho, F.lit(1e-12))), df.cast("double")))
    return got
