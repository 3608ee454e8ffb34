"""Price-spike events ahead of weekly origins: labels, thresholds known at the time, rates, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mandi.functions.scalar import median

from . import metrics, tables, temporal

KEYS = temporal.KEYS
# How many past windows each level of the seasonal threshold needs.
LEVELS = {"city_product_month": 20, "city_product_all": 52, "product_month": 100, "product_all": 1, "global": 1}
QUANTILES = (0.90, 0.95)
GRID = [(a, q) for a in (0.15, 0.20, 0.25) for q in QUANTILES]


def future_peak(spine: DataFrame, series: DataFrame, days: int = 14, at_least: int = 10) -> DataFrame:
    """Highest price in (origin, origin + days], its first date, and the return from the origin's price.

    Rows without an origin price (at most a day old) or with too few future days go.
    """
    hit = temporal.window_join(spine, series, 1, days, ["price"])
    ahead = F.col("day") > F.col("origin_date")
    near = ~ahead
    got = hit.groupBy(*KEYS, "origin_date").agg(
        F.max_by("price", F.when(near, F.col("day"))).alias("origin_price"), F.count_if(ahead).alias("future_days"), F.max(F.when(ahead, F.col("price"))).alias("peak_price"),
        F.min_by("day", F.when(ahead, F.struct(-F.col("price"), "day"))).alias("peak_date"), F.array_sort(F.collect_list(F.when(ahead, F.struct("day", "price")))).alias("future"),
    )
    got = got.filter(F.col("origin_price").isNotNull() & (F.col("future_days") >= at_least))
    return got.withColumns({"window_end": F.date_add("origin_date", days), "peak_return": F.col("peak_price") / F.col("origin_price") - 1})


_BY = {"city_product_month": ["product_id", "city_id", "month"], "city_product_all": ["product_id", "city_id"], "product_month": ["product_id", "month"], "product_all": ["product_id"], "global": []}


def seasonal_thresholds(peaks: DataFrame, levels: dict[str, int] = LEVELS) -> DataFrame:
    """q90 and q95 of peak returns of windows that ended by the origin, at the finest level with enough.

    A window counts under its own origin's month.  Running counts over weeks say how many windows each level
    has seen at each origin, and so at which level an origin asks; the quantiles of all levels come from one rank
    descent, in which an origin costs a few rows a round and never meets the windows themselves.
    """
    df = peaks.withColumn("month", F.month("origin_date"))
    # a slice is what one level puts together
    slice_of = {n: F.concat_ws("|", F.lit(n), *(F.col(c).cast("string") for c in _BY[n])) for n in _BY}
    sliced = df.select("window_end", "peak_return", F.explode(F.array(*slice_of.values())).alias("slice"))
    weekly = sliced.groupBy("slice", "window_end").agg(F.count("*").alias("rows"))
    asks = df.select("origin_date", F.explode(F.array(*slice_of.values())).alias("slice")).distinct()
    counts = tables.kept(temporal.so_far(asks, weekly, ["slice"], "origin_date", "window_end", {"n": F.sum("rows")}).na.fill(0, ["n"]), "seen")
    for name, slice_ in slice_of.items():
        seen = counts.select(F.col("slice").alias("slice_"), F.col("origin_date").alias("at_"), F.col("n").alias(f"n_{name}"))
        df = df.join(seen, (slice_ == F.col("slice_")) & (F.col("origin_date") == F.col("at_"))).drop("slice_", "at_")
    enough = {n: F.col(f"n_{n}") >= m for n, m in levels.items()}
    pick = lambda f: F.coalesce(*(F.when(ok, f(n)) for n, ok in enough.items()))
    df = df.withColumns({"threshold_level": pick(F.lit), "threshold_count": pick(lambda n: F.col(f"n_{n}")), "slice": pick(slice_of.get)}).filter("threshold_level IS NOT NULL")
    df = tables.kept(df.drop(*(f"n_{n}" for n in _BY)), "levels")
    q = temporal.quantiles_so_far(df.select("slice", "origin_date").distinct(), sliced, ["slice"], "origin_date", "window_end", "peak_return", QUANTILES)
    ends = weekly.groupBy("window_end").agg(F.sum("rows").alias("rows")).select(F.lit(0).alias("one"), "window_end", F.col("window_end").alias("end"))  # one row a week
    latest = temporal.so_far(df.select("origin_date").distinct().withColumn("one", F.lit(0)), ends, ["one"], "origin_date", "window_end", {"history_end": F.max("end")}).drop("one")
    out = df.join(q.drop("n"), ["slice", "origin_date"]).join(latest, "origin_date", "left")
    return out.withColumns({"threshold_q90": F.col("q")[0], "threshold_q95": F.col("q")[1]}).drop("q", "slice")


def raw_events(df: DataFrame) -> DataFrame:
    """raw_abs.._q..: whether the peak reaches both the absolute and the seasonal threshold."""
    return df.withColumns({f"raw_abs{int(a * 100)}_q{int(q * 100)}": (F.col("peak_return") >= a) & (F.col("peak_return") >= F.col(f"threshold_q{int(q * 100)}")) for a, q in GRID})


def dedup_events(df: DataFrame, raw: str, event: str, days: int = 21) -> DataFrame:
    """Keep an event only if it starts more than ``days`` after the last kept one of its series."""
    dates = F.array_sort(F.collect_list(F.when(F.col(raw), F.col("origin_date"))))
    none = F.array().cast("array<date>")
    kept = F.aggregate("dates", none, lambda acc, d: F.when(F.size(acc) == 0, F.array(d)).when(F.datediff(d, F.try_element_at(acc, F.lit(-1))) > days, F.concat(acc, F.array(d))).otherwise(acc))
    series = df.groupBy(*KEYS).agg(dates.alias("dates")).select(*KEYS, kept.alias("kept"))
    return df.join(series, KEYS).withColumn(event, F.coalesce(F.array_contains("kept", F.col("origin_date")), F.lit(False))).drop("kept")


def event_lead(df: DataFrame, event: str = "event_label", absolute: float = 0.20) -> DataFrame:
    """Effective threshold, first day that reaches it, and the days until then, of events."""
    limit = F.greatest(F.lit(absolute), F.col("threshold_q90"))
    crossed = F.filter("future", lambda x: x["price"] / F.col("origin_price") - 1 >= limit)
    day = F.when(F.col(event), F.try_element_at(crossed, F.lit(1))["day"])
    return df.withColumns({"effective_threshold": limit, "crossing_date": day}).withColumn("lead_days", F.datediff("crossing_date", "origin_date"))


def event_rates(df: DataFrame, event: str = "event_label", days: int = 364, lag: int = 14) -> DataFrame:
    """Past event rates of the series (a year, all) and the product (a year) from windows that ended by the origin."""
    day = F.unix_date("origin_date").cast("long")
    df = df.withColumn("origin_day", day).withColumn("hit", F.col(event).cast("int"))
    w = Window.partitionBy(*KEYS).orderBy("origin_day")
    year, all_ = w.rangeBetween(-days, -lag), w.rangeBetween(Window.unboundedPreceding, -lag)
    share = lambda n, d: F.when(d > 0, n / d)
    out = df.withColumns({"series_count_52w": F.count("hit").over(year), "series_rate_52w": F.avg("hit").over(year), "series_rate_all": F.avg("hit").over(all_)})
    weekly = df.groupBy("product_id", "origin_day").agg(F.sum("hit").alias("hits"), F.count("*").alias("rows"))
    p = Window.partitionBy("product_id").orderBy("origin_day").rangeBetween(-days, -lag)
    weekly = weekly.select("product_id", "origin_day", F.coalesce(F.sum("rows").over(p), F.lit(0)).alias("product_count_52w"), share(F.sum("hits").over(p), F.sum("rows").over(p)).alias("product_rate_52w"))
    return out.join(weekly, ["product_id", "origin_day"]).drop("origin_day", "hit")


def alert_labels(peaks: DataFrame, levels: dict[str, int] = LEVELS) -> DataFrame:
    """Thresholds, raw and kept events, lead days and past rates of the origins of future_peak().

    peaks is read once per threshold level: give a written or kept table.
    """
    df = raw_events(seasonal_thresholds(peaks, levels))
    df = dedup_events(df.withColumn("primary_raw_event", F.col("raw_abs20_q90")), "primary_raw_event", "event_label")
    return event_rates(event_lead(df)).drop("future")


def regional_features(df: DataFrame) -> DataFrame:
    """Medians over the cities of a product and origin, the share of rising ones, and the distance to them."""
    w = Window.partitionBy("product_id", "origin_date")
    out = df.withColumns({f"regional_return_{k}d": median(f"return_{k}d").over(w) for k in (7, 14, 28)})
    cv = F.when(F.col("rolling_mean_28d") > 0, F.col("rolling_std_28d") / F.col("rolling_mean_28d"))
    return out.withColumns({"regional_cv_28d": median(cv).over(w), "regional_up_share": F.avg(F.coalesce((F.col("return_14d") > 0).cast("double"), F.lit(0.0))).over(w), "city_minus_regional": F.col("return_14d") - F.col("regional_return_14d")})


def event_scope(df: DataFrame, raw: str = "primary_raw_event") -> DataFrame:
    share = F.avg(F.col(raw).cast("double")).over(Window.partitionBy("product_id", "origin_date"))
    return df.withColumn("regional_share", share).withColumn("scope", F.when(F.col("regional_share") >= 0.25, "regional").when(F.col("regional_share") >= 0.10, "multi_city").otherwise("local"))


# What a model may use: known at the origin, and made from it.
NUMERIC = [*(f"return_{k}d" for k in temporal.LAGS), *(f"rolling_cv_{w}d" for w in temporal.WINDOWS), "up_share", "down_share", "vs_season", "series_rate_52w", "series_rate_all", "product_rate_52w", "unchanged_share", "stale_share", "outlier_share", "reliability", "origin_fill_days"]
DERIVED = [*(f"vs_mean_{w}d" for w in temporal.WINDOWS), *(f"regional_return_{k}d" for k in (7, 14, 28)), "regional_cv_28d", "regional_up_share", "city_minus_regional"]
CATEGORIES = ["product_id", "origin_month"]


def alert_mart(labels: DataFrame, spine: DataFrame, series: DataFrame) -> DataFrame:
    """Labels with all features known at the origin: returns, rolling levels, direction, season, quality, rates, region.

    series carries stale_share, outlier_share and reliability of each day; the origin's price day gives them.
    """
    keys = [*KEYS, "origin_date"]
    recent = temporal.recent_features(spine.select(*keys), series).drop("origin_price", "history")
    season = temporal.seasonal_median(spine.select(*keys).withColumn("target_date", F.col("origin_date")), series).drop("target_date", "seasonal_count")
    day = series.select(*KEYS, F.col("date").alias("price_day"), "stale_share", "outlier_share", "reliability")
    df = labels.join(recent, keys).join(temporal.unchanged_share(spine.select(*keys), series), keys, "left").join(temporal.direction_share(spine.select(*keys), series), keys, "left").join(season, keys, "left")
    df = df.withColumn("price_day", F.date_sub("origin_date", F.col("origin_fill_days"))).join(day, [*KEYS, "price_day"], "left").drop("price_day")
    ln = lambda b: F.when(F.col(b) > 0, F.ln(F.col("origin_price") / F.col(b)))
    cv = lambda w: F.when(F.col(f"rolling_mean_{w}d") > 0, F.col(f"rolling_std_{w}d") / F.col(f"rolling_mean_{w}d"))
    df = df.withColumns({f"rolling_cv_{w}d": cv(w) for w in temporal.WINDOWS} | {f"vs_mean_{w}d": ln(f"rolling_mean_{w}d") for w in temporal.WINDOWS} | {"vs_season": ln("seasonal_median"), "origin_month": F.month("origin_date")})
    return regional_features(df)


def weekly_audit(peaks: DataFrame, limits: tuple[float, ...] = (0.15, 0.20, 0.25)) -> DataFrame:
    """Per product: eligible series, origins and rows, and how many peaks reach each raw limit, with rates."""
    n = {f"spikes_{int(100 * a)}": F.count_if(F.col("peak_return") >= a) for a in limits}
    got = peaks.groupBy("product_id").agg(F.count_distinct("city_id").alias("series"), F.count_distinct("origin_date").alias("origins"), F.count("*").alias("rows"), F.sum("future_days").alias("future_days"), *(c.alias(k) for k, c in n.items()))
    return got.withColumns({f"rate_{k[7:]}": F.col(k) / F.col("rows") for k in n})


def outcome(label: Column, alert: Column) -> Column:
    return F.when(label & alert, "true_positive").when(~label & alert, "false_positive").when(label & ~alert, "false_negative").otherwise("true_negative")


BASELINES = ("train_product_prevalence", "series_event_rate_52w", "volatility_momentum")


def baselines(train: DataFrame, df: DataFrame, momentum: tuple[str, ...] = ("rolling_cv_28d", "return_14d"), weights: tuple[float, ...] = (0.6, 0.4), clip: float = 5.0, floor: float = 1e-4) -> DataFrame:
    """df with three scores: the product's prevalence in train, the series' rate, a volatility-momentum logit."""
    event = F.col("event_label").cast("double")
    base = train.groupBy("product_id").agg(F.avg(event).alias("prevalence"))
    # one row of figures each
    overall = train.agg(F.avg(event).alias("overall"), *(median(f).alias(f"m_{f}") for f in momentum))
    filled = train.crossJoin(overall).agg(*(F.stddev_pop(F.coalesce(f, f"m_{f}")).alias(f"s_{f}") for f in momentum))
    out = df.join(base, "product_id", "left").crossJoin(overall).crossJoin(filled)
    held = lambda c: F.greatest(F.lit(floor), F.least(F.lit(1 - floor), c))
    p = F.coalesce("prevalence", "overall")
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    z = lambda f: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.coalesce(f, f"m_{f}") - F.col(f"m_{f}")) / F.when(F.col(f"s_{f}") > 1e-12, F.col(f"s_{f}")).otherwise(1.0)))
    logit = reduce(Column.__add__, (w * z(f) for f, w in zip(momentum, weights, strict=True)), F.ln(clipped / (1 - clipped)))
    scores = dict(zip(BASELINES, (held(p), held(F.coalesce("series_rate_52w", p)), held(1 / (1 + F.exp(-logit)))), strict=True))
    return out.select(*df.columns, *(c.alias(n) for n, c in scores.items()))


def by_source(df: DataFrame, scores: dict[str, str], keep: list[str]) -> DataFrame:
    """A row for each score: keep, score_source, score (0/1 label from event_label)."""
    each = F.array(*(F.struct(F.lit(n).alias("score_source"), F.col(c).cast("double").alias("score")) for n, c in scores.items()))
    return df.withColumn("label", F.col("event_label").cast("int")).select(*keep, "label", F.explode(each).alias("s")).select(*keep, "label", "s.*")


def rank_candidates(bundle: DataFrame) -> DataFrame:
    """Candidates best first: average precision, recall, least Brier score, most ridge, least weight."""
    return bundle.orderBy(F.desc("average_precision"), F.desc("recall"), "brier", F.desc("ridge"), "weight", "score_source")


def slices(scored: DataFrame, threshold: Column, by: list[str]) -> DataFrame:
    """Rows, events, prevalence and average precision of each slice, and what a frozen threshold does there."""
    ap = metrics.average_precision(metrics.pr_curve(scored, by), by)
    got = scored.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("label").alias("events"), F.avg("label").alias("prevalence"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"), *metrics.confusion_aggregates(threshold))
    return got.join(ap, by, "left")


def replay(scored: DataFrame, threshold: Column) -> DataFrame:
    """Each series' timeline with its score, outcome and place among its origin's risks, and the origin's cities with an event."""
    w = Window.partitionBy("product_id", "origin_date")
    place = F.row_number().over(w.orderBy(F.desc("score"), "city_id"))
    hit = F.count_if(F.col("label") == 1).over(w)
    return scored.withColumns({"outcome": outcome(F.col("label") == 1, F.col("score") >= threshold), "risk_place": place, "impacted_cities": hit, "event_point": F.when(F.col("label") == 1, F.col("score"))})


def default_case(df: DataFrame) -> DataFrame:
    """The record a page opens with: the best true positive, or without one the highest score."""
    return df.orderBy(F.desc(F.col("outcome") == "true_positive"), F.desc("score"), F.desc("peak_return"), *KEYS, "origin_date").limit(1)


def score_bundle(scored: DataFrame, by: list[str], fpr: float = 0.10) -> DataFrame:
    """Prevalence, average precision, Brier score, the point at the fixed false-positive rate, lead days on hits, and the share of the top tenth of peaks that is alerted."""
    curve = metrics.pr_curve(scored, by)
    at = metrics.threshold_at_fpr(curve, by, fpr)
    base = scored.groupBy(*by).agg(F.avg("label").alias("prevalence"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))
    top = scored.groupBy(*by).agg(F.percentile("peak_return", F.lit(0.9)).alias("top"))
    hits = scored.join(at.select(*by, "threshold"), by).join(top, by)
    alert = F.col("score") >= F.col("threshold")
    lead = F.when(alert & (F.col("label") == 1), F.col("lead_days"))
    more = hits.groupBy(*by).agg(F.avg(lead).alias("mean_lead"), median(lead).alias("median_lead"), (F.count_if(alert & (F.col("peak_return") >= F.col("top"))) / F.count_if(F.col("peak_return") >= F.col("top"))).alias("top_decile_recall"))
    return base.join(metrics.average_precision(curve, by), by).join(at, by).join(more, by)


def top_cases(df: DataFrame, n: int = 10) -> DataFrame:
    """Examples of each outcome but true negatives: missed events by peak and then score, others by score and then peak."""
    missed = F.col("outcome") == "false_negative"
    first, second = F.when(missed, F.col("peak_return")).otherwise(F.col("score")), F.when(missed, F.col("score")).otherwise(F.col("peak_return"))
    rank = F.row_number().over(Window.partitionBy("outcome").orderBy(F.desc(first), F.desc(second), *KEYS, "origin_date"))
    return df.filter("outcome <> 'true_negative'").withColumn("case", rank).filter(F.col("case") <= n)


def sample_curve(curve: DataFrame, by: list[str], points: int = 160) -> DataFrame:
    """At most ``points`` points of an ordered curve, evenly spread, both ends included."""
    w = Window.partitionBy(*by)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("place")) - 1
    slot = F.floor(F.col("i") * (points - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    numbered = curve.withColumns({"n": n, "i": i}).withColumn("slot", slot)
    return numbered.withColumn("first", F.row_number().over(Window.partitionBy(*by, "slot").orderBy("i"))).filter("first = 1").drop("n", "i", "slot", "first")


def release_gate(bundle: DataFrame, best_ap: Column, gates: dict[str, float] | None = None) -> DataFrame:
    """alert_release, research_only or no_signal from five gates."""
    g = {"lift": 0.20, "fpr": 0.12, "recall": 0.30, "multiple": 2.0, "positives": 20, "research": 0.20} | (gates or {})
    checks = {"lift_ok": F.when(best_ap > 0, F.col("average_precision") / best_ap - 1 >= g["lift"]).otherwise(False), "fpr_ok": F.col("fpr") <= g["fpr"], "recall_ok": F.col("recall") >= g["recall"], "precision_ok": F.col("precision") >= F.col("prevalence") * g["multiple"], "positives_ok": F.col("tp") >= g["positives"]}
    out = bundle.withColumns(checks)
    return out.withColumn("release_status", F.when(reduce(Column.__and__, (F.col(c) for c in checks)), "alert_release").when((F.col("average_precision") > best_ap) & (F.col("recall") >= g["research"]), "research_only").otherwise("no_signal"))


RIDGES, WEIGHTS = (1e-4, 1e-3, 1e-2), (1.0, 3.0)


def fit_logistic(train: DataFrame, names: list[str], categories: list[str], ridges: tuple[float, ...] = RIDGES, weights: tuple[float, ...] = WEIGHTS, clip: float = 8.0):
    """Weighted ridge logistic regressions, one for each ridge and weight of positives, and how to score with them.

    Features are filled with and centred on train medians and clipped; of a category's levels, sorted
    as strings, the first is left out, and unknown ones are like it.  Returns score(df), which adds a
    column s<i> for each candidate, and the candidates by column: (name, ridge, weight).
    """
    medians = train.agg(*(median(c).alias(c) for c in names)).first()
    fill = {c: float(medians[c] or 0.0) for c in names}
    row = train.agg(*(F.stddev_pop(F.coalesce(c, F.lit(fill[c]))).alias(c) for c in names)).first()
    sd = {c: row[c] if row[c] and row[c] >= 1e-12 else 1.0 for c in names}

    def prepare(df: DataFrame) -> DataFrame:
        z = {f"x_{c}": F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.coalesce(c, F.lit(fill[c])) - fill[c]) / sd[c])) for c in names}
        return df.withColumns(z | {f"x_{c}": F.col(c).cast("string") for c in categories})

    ready = prepare(train).withColumn("label", F.col("event_label").cast("double"))
    levels = {c: sorted(r[0] for r in ready.select(f"x_{c}").filter(F.col(f"x_{c}").isNotNull()).distinct().collect())[:0:-1] for c in categories}
    flags = [F.when(F.col(f"x_{c}") == v, 1.0).otherwise(0.0) for c in categories for v in levels[c]]
    features = F.array(*(F.col(f"x_{c}") for c in names), *flags)
    shown = {f"x_level_{i}": flag for i, flag in enumerate(flags)}
    assembler = VectorAssembler(inputCols=[*(f"x_{c}" for c in names), *shown], outputCol="features")
    ready = assembler.transform(ready.withColumns(shown)).select("features", "label", *(F.when(F.col("event_label"), w).otherwise(1.0).alias(f"w{j}") for j, w in enumerate(weights))).persist()
    grid = [(r, j) for r in ridges for j in range(len(weights))]
    models = [LogisticRegression(featuresCol="features", labelCol="label", weightCol=f"w{j}", regParam=r, standardization=False).fit(ready) for r, j in grid]
    ready.unpersist()
    # figures only: a fitted model in a plan goes to the executors with all that it refers to, which Spark can't always serialize
    fitted = [(m.coefficients.toArray().tolist(), float(m.intercept)) for m in models]

    def score(df: DataFrame, floor: float = 1e-4) -> DataFrame:
        out = prepare(df).withColumn("x_all", features)

        def chance(coefficients: list[float], intercept: float) -> Column:
            terms = F.zip_with("x_all", F.array(*map(F.lit, coefficients)), lambda x, c: x * c)
            return 1 - 1 / (1 + F.exp(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + intercept))

        held = lambda c: F.greatest(F.lit(floor), F.least(F.lit(1 - floor), c))
        return out.select(*df.columns, *(held(chance(*m)).alias(f"s{i}") for i, m in enumerate(fitted)))

    return score, {f"s{i}": (f"logistic_r{r:g}_pw{weights[j]:g}", r, weights[j]) for i, (r, j) in enumerate(grid)}
