"""Features at forecast origins, without looking ahead.

A *spine* has a row per series and origin (product_id, city_id, origin_date); a *series* has the
observed days (product_id, city_id, date, price, ...).  Range joins are equi-joins on the series and
a month bucket, so a long history isn't compared with every origin: each row of the spine asks for
the few buckets that its window touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mandi.functions.scalar import calendar, log_return, median

from . import tables

KEYS = ["product_id", "city_id"]
LAGS, TOLERANCE = (1, 7, 14, 28, 56), 3
WINDOWS = (7, 14, 28, 56, 90)
BUCKET = 64  # days


def origin_spine(series: DataFrame, start: str, end: str, step: str, at_least: int) -> DataFrame:
    """Origins every ``step`` (an interval) of each series with enough days strictly before them."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step}"))
    w = Window.partitionBy(*KEYS).orderBy(F.col("date"), F.col("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    origins = series.select(*KEYS).distinct().withColumn("date", F.explode(days)).withColumn("kind", F.lit(0))
    both = origins.unionByName(series.select(*KEYS, "date").withColumn("kind", F.lit(1)))
    # origins sort before the observation of the same day, so the running count is of earlier days
    counted = both.withColumn("history", F.sum("kind").over(w))
    return counted.filter((F.col("kind") == 0) & (F.col("history") >= at_least)).select(*KEYS, F.col("date").alias("origin_date"), "history")


def _bucket(date: Column) -> Column:
    return F.floor(F.unix_date(date) / BUCKET)


def window_join(spine: DataFrame, series: DataFrame, before: int, after: int, columns: list[str]) -> DataFrame:
    """Each spine row with the series' days from ``before`` days earlier to ``after`` days later; left join."""
    s = series.select(*KEYS, F.col("date").alias("day"), *columns, _bucket(F.col("date")).alias("bucket"))
    buckets = F.sequence(_bucket(F.date_sub("origin_date", before)), _bucket(F.date_add("origin_date", after)))
    asked = spine.select(*KEYS, "origin_date", F.explode(buckets).alias("bucket"))
    hit = asked.join(s, [*KEYS, "bucket"]).filter(F.col("day").between(F.date_sub("origin_date", before), F.date_add("origin_date", after)))
    return hit.drop("bucket")


def asof_columns(lags=LAGS, tolerance: int = TOLERANCE) -> list[Column]:
    """Aggregates: latest price at most ``tolerance`` days before each lag's date, and how much earlier it is."""
    out = []
    for k in lags:
        near = F.col("day").between(F.date_sub("origin_date", k + tolerance), F.date_sub("origin_date", k))
        day = F.max(F.when(near, F.col("day")))
        out += [F.max_by(F.col("price"), F.when(near, F.col("day"))).alias(f"lag_price_{k}d"), F.datediff(F.date_sub("origin_date", k), day).alias(f"lag_gap_{k}d")]
    return out


def rolling_columns(windows=WINDOWS, single_sd: bool = True) -> list[Column]:
    """Aggregates: count, mean, median and deviation of the last w calendar days, the origin's included.

    The deviation of one observation is 0.
    """
    out = []
    for w in windows:
        p = F.when(F.col("day").between(F.date_sub("origin_date", w - 1), F.col("origin_date")), F.col("price"))
        sd = F.when(F.count(p) == 1, 0.0).otherwise(F.stddev_samp(p))
        out += [F.count(p).alias(f"rolling_count_{w}d"), F.avg(p).alias(f"rolling_mean_{w}d"), median(p).alias(f"rolling_median_{w}d"), sd.alias(f"rolling_std_{w}d")]
    return out


def origin_price_columns(most_fill: int = 1) -> list[Column]:
    near = F.col("day").between(F.date_sub("origin_date", most_fill), F.col("origin_date"))
    return [F.max_by(F.col("price"), F.when(near, F.col("day"))).alias("origin_price"), F.datediff(F.max("origin_date"), F.max(F.when(near, F.col("day")))).alias("origin_fill_days")]


def recent_features(spine: DataFrame, series: DataFrame, lags=LAGS, windows=WINDOWS, tolerance: int = TOLERANCE) -> DataFrame:
    """Origin price, lags, returns and rolling statistics: one range join and one aggregate."""
    reach = max(max(windows) - 1, max(lags) + tolerance)
    got = window_join(spine, series, reach, 0, ["price"]).groupBy(*KEYS, "origin_date").agg(*origin_price_columns(), *asof_columns(lags, tolerance), *rolling_columns(windows))
    out = spine.join(got, [*KEYS, "origin_date"], "left")
    extra = {}
    for k in lags:
        extra[f"lag_missing_{k}d"] = F.col(f"lag_price_{k}d").isNull()
        extra[f"return_{k}d"] = log_return(F.col("origin_price"), F.col(f"lag_price_{k}d"))
    for w in windows:
        extra[f"rolling_count_{w}d"] = F.coalesce(f"rolling_count_{w}d", F.lit(0))
    return out.withColumns(extra)


def _asof_latest(spine: DataFrame, running: DataFrame, columns: list[str]) -> DataFrame:
    """spine with the columns of the latest row of running (date) at or before the origin, by one sorted pass."""
    a = spine.select(*KEYS, F.col("origin_date").alias("date"), F.lit(1).alias("kind"), *(F.lit(None).cast(running.schema[c].dataType).alias(c) for c in columns))
    b = running.select(*KEYS, "date", F.lit(0).alias("kind"), *columns)
    w = Window.partitionBy(*KEYS).orderBy("date", "kind")
    both = a.unionByName(b).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return both.filter("kind = 1").drop("kind").withColumnRenamed("date", "origin_date")


def unchanged_share(spine: DataFrame, series: DataFrame) -> DataFrame:
    """Share of unchanged prices among steps of one day, up to the origin."""
    w = Window.partitionBy(*KEYS).orderBy("date")
    step = F.datediff("date", F.lag("date").over(w)) == 1
    same = step & (F.abs(F.col("price") - F.lag("price").over(w)) <= 1e-12)
    marked = series.select(*KEYS, "date", F.coalesce(step, F.lit(False)).cast("int").alias("step"), F.coalesce(same, F.lit(False)).cast("int").alias("same"))
    running = marked.withColumns({"steps": F.sum("step").over(w), "sames": F.sum("same").over(w)})
    got = _asof_latest(spine, running, ["steps", "sames"])
    return got.select(*KEYS, "origin_date", F.when(F.col("steps") > 0, F.col("sames") / F.col("steps")).alias("unchanged_share"))


def direction_share(spine: DataFrame, series: DataFrame, days: int = 14) -> DataFrame:
    """Shares of rises and falls among changes between successive days in [origin - days, origin]."""
    hit = window_join(spine, series, days, 0, ["price"])
    change = F.col("price") - F.lag("price").over(Window.partitionBy(*KEYS, "origin_date").orderBy("day"))
    changes = hit.withColumn("change", change).filter("change IS NOT NULL")
    got = changes.groupBy(*KEYS, "origin_date").agg(F.avg((F.col("change") > 0).cast("double")).alias("up_share"), F.avg((F.col("change") < 0).cast("double")).alias("down_share"))
    return spine.select(*KEYS, "origin_date").join(got, [*KEYS, "origin_date"], "left")


def so_far(asked: DataFrame, seen: DataFrame, keys: list[str], at: str, day: str, columns: dict[str, Column]) -> DataFrame:
    """asked with columns: window aggregates over the rows of seen (same keys) whose day is at or before ``at``.

    One sorted pass over both, so no row meets all earlier ones of its group.  Aggregates see nulls in
    the asked rows.  A group must fit in a task: a series, or a part of one.
    """
    held = [c for c in seen.columns if c not in (*keys, day)]
    a = asked.select(*keys, F.col(at).alias("at_"), F.lit(1).alias("kind_"), F.struct(*asked.columns).alias("asked_"), *(F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in held))
    b = seen.select(*keys, F.col(day).alias("at_"), F.lit(0).alias("kind_"), F.lit(None).cast(a.schema["asked_"].dataType).alias("asked_"), *held)
    w = Window.partitionBy(*keys).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumns({n: c.over(w) for n, c in columns.items()}).filter("kind_ = 1").select("asked_.*", *columns)


def quantiles_so_far(asked: DataFrame, seen: DataFrame, keys: list[str], at: str, day: str, value: str, qs: tuple[float, ...], bits: int = 6) -> DataFrame:
    """asked (keys, at; distinct) with n and q: exact quantiles qs of the values of seen whose day is at or before ``at``; none seen: no row.

    Rank descent.  Values are replaced by their ranks among all distinct values, and a rank is read as digits
    of ``bits`` bits.  From the first digit on, rows are counted by digit and day, running counts over days and then
    digits tell which digit the wanted rank has, and the next round counts only rows that begin so.  Counts merge in
    any order; an asked row costs at most 2**bits rows a round, whatever its history.
    """
    seen = seen.filter(F.col(value).isNotNull())
    codes = tables.kept(tables.numbered(seen.select(F.col(value).alias("value__")).distinct(), [], ["value__"], "code__"), "codes")
    rounds = max(1, -(-int(codes.count()).bit_length() // bits))
    rows = seen.join(codes, seen[value] == F.col("value__")).groupBy(*keys, "code__", day).agg(F.count("*").alias("rows__"))
    rows = tables.kept(rows, "counts")
    every = so_far(asked, rows.groupBy(*keys, day).agg(F.sum("rows__").alias("rows__")), keys, at, day, {"n": F.sum("rows__")}).filter("n > 0")
    # a quantile lies between two ranks; each has its part
    place = [(F.col("n") - 1) * q for q in qs]
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), (F.floor(p) + side + 1).alias("rank"), F.abs(1 - side - (p - F.floor(p))).alias("part")) for i, p in enumerate(place) for side in (0, 1)))
    wanted = every.withColumn("r", F.explode(ranks)).filter("r.part > 0").select(*keys, at, "n", "r.*", F.lit(0).cast("long").alias("prefix__"))
    for shift in range((rounds - 1) * bits, -1, -bits):
        cut = rows.withColumns({"prefix__": F.shiftright("code__", shift + bits), "digit__": F.shiftright("code__", shift).bitwiseAND(F.lit(2**bits - 1))})
        heads = wanted.select(*keys, "prefix__").distinct()
        counts = cut.join(heads, [*keys, "prefix__"], "left_semi").groupBy(*keys, "prefix__", "digit__", day).agg(F.sum("rows__").alias("rows__"))
        each = wanted.select(*keys, "prefix__", at).distinct().join(counts.select(*keys, "prefix__", "digit__").distinct(), [*keys, "prefix__"])
        run = so_far(each, counts, [*keys, "prefix__", "digit__"], at, day, {"rows__": F.sum("rows__")}).filter("rows__ > 0")
        run = run.withColumn("upto__", F.sum("rows__").over(Window.partitionBy(*keys, "prefix__", at).orderBy("digit__")))
        hit = wanted.join(run, [*keys, "prefix__", at]).filter((F.col("rank") <= F.col("upto__")) & (F.col("rank") > F.col("upto__") - F.col("rows__")))
        wanted = hit.select(*keys, at, "n", "i", (F.col("rank") - F.col("upto__") + F.col("rows__")).alias("rank"), "part", (F.col("prefix__") * 2**bits + F.col("digit__")).alias("prefix__"))
        wanted = tables.kept(wanted, "ranks")
    named = wanted.join(codes, F.col("prefix__") == F.col("code__"))
    return named.groupBy(*keys, at, "n").agg(F.array(*(F.sum(F.when(F.col("i") == i, F.col("part") * F.col("value__"))) for i in range(len(qs)))).alias("q"))


def seasonal_median(targets: DataFrame, series: DataFrame, at_least: int = 3) -> DataFrame:
    """Median price of the target's calendar month so far; of the whole history if there are too few days.

    Counts say which of both a target takes; then all medians come from one rank descent.
    """
    keys = [*KEYS, "origin_date", "target_date"]
    asked = targets.select(*keys).withColumn("scope_", F.month("target_date"))
    days = series.select(*KEYS, F.month("date").alias("scope_"), F.col("date").alias("day"), "price")
    got = so_far(asked, days, [*KEYS, "scope_"], "origin_date", "day", {"seasonal_count": F.count("price")})
    got = got.withColumn("scope_", F.when(F.col("seasonal_count") >= at_least, F.col("scope_")).otherwise(0))
    both = days.unionByName(days.withColumn("scope_", F.lit(0)))
    median_ = quantiles_so_far(got.select(*KEYS, "scope_", "origin_date").distinct(), both, [*KEYS, "scope_"], "origin_date", "day", "price", (0.5,))
    return got.join(median_, [*KEYS, "scope_", "origin_date"], "left").select(*keys, "seasonal_count", F.col("q")[0].alias("seasonal_median"))


def weekly_pattern(targets: DataFrame, series: DataFrame, last: int = 4) -> DataFrame:
    """Median of the last ``last`` prices on the target's weekday: each day carries them, and the latest day answers."""
    keys = [*KEYS, "weekday_"]
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(1 - last, 0)
    seen = series.select(*KEYS, F.weekday("date").alias("weekday_"), F.col("date").alias("day"), "price")
    seen = seen.select(*keys, "day", F.struct(median("price").over(w).alias("median"), F.count("price").over(w).alias("count")).alias("x"))
    asked = targets.select(*KEYS, "origin_date", "target_date").withColumn("weekday_", F.weekday("target_date"))
    got = so_far(asked, seen, keys, "origin_date", "day", {"latest": F.last("x", ignorenulls=True)}).filter("latest IS NOT NULL")
    return got.select(*KEYS, "origin_date", "target_date", F.col("latest.median").alias("weekly_median"), F.col("latest.count").alias("weekly_count"))


def attach_target(targets: DataFrame, series: DataFrame) -> DataFrame:
    """The price on the target date; rows whose target day wasn't observed go."""
    return targets.join(series.select(*KEYS, F.col("date").alias("target_date"), F.col("price").alias("target_price")), [*KEYS, "target_date"])


def forecast_mart(series: DataFrame, spine: DataFrame, horizons=(7, 14, 28)) -> DataFrame:
    """One row per series, origin and horizon with an observed target and an origin price."""
    targets = spine.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("target_date", F.date_add("origin_date", F.col("horizon")))
    targets = attach_target(targets, series)
    keys = [*KEYS, "origin_date"]
    # history is asked once per series, origin and target date
    season = seasonal_median(targets.select(*keys, "target_date"), series)
    week = weekly_pattern(targets.select(*keys, "target_date"), series)
    out = targets.join(recent_features(spine.select(*keys), series), keys).filter("origin_price IS NOT NULL")
    out = out.join(unchanged_share(spine.select(*keys), series), keys).join(season, [*keys, "target_date"], "left").join(week, [*keys, "target_date"], "left")
    change = F.col("target_price") - F.col("origin_price")
    return out.withColumns({
        **calendar(F.col("origin_date"), "origin"), **calendar(F.col("target_date"), "target"), "log_origin_price": F.ln("origin_price"), "log_target_price": F.ln("target_price"),
        "target_change": change, "target_return": log_return(F.col("target_price"), F.col("origin_price")), "target_direction": F.signum(change),
    })


def exact_lags(panel: DataFrame, columns: list[str], lags: list[int], bin_days: int, keys: list[str] = KEYS) -> DataFrame:
    """Lag k is the value exactly k bins earlier; a gap gives NULL, not an older value."""
    # a RANGE frame of one point on the bin number
    w = Window.partitionBy(*keys).orderBy("bin_number")
    df = panel.withColumn("bin_number", F.unix_date("bin_start").cast("long"))
    return df.withColumns({f"{c}_lag{k}": F.max(c).over(w.rangeBetween(-k * bin_days, -k * bin_days)) for c in columns for k in lags}).drop("bin_number")


def last_value_wape(series: DataFrame, horizons: list[int], at_least: int, most_fill: int = 1) -> DataFrame:
    """Error of the last value (at most one day old) h days ahead, over all observed targets."""
    long = series.withColumn("n", F.count("*").over(Window.partitionBy(*KEYS))).filter(F.col("n") >= at_least).drop("n")
    targets = long.select(*KEYS, F.col("date").alias("target_date"), F.col("price").alias("actual"), F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    # a day fills itself and the next ``most_fill`` days; the freshest wins
    fills = long.select(*KEYS, "price", F.explode(F.sequence(F.lit(0), F.lit(most_fill))).alias("age"), "date").withColumn("origin_date", F.date_add("date", F.col("age")))
    fills = fills.groupBy(*KEYS, "origin_date").agg(F.min_by("price", "age").alias("predicted"))
    got = targets.withColumn("origin_date", F.date_sub("target_date", F.col("horizon"))).join(fills, [*KEYS, "origin_date"])
    return got.groupBy("horizon").agg(F.count("*").alias("rows"), F.sum(F.abs(F.col("actual") - F.col("predicted"))).alias("error"), F.sum("actual").alias("total")).select("horizon", "rows", (F.col("error") / F.col("total")).alias("wape"))


def dense_calendar(series: DataFrame, fill: int = 1) -> DataFrame:
    """Every day between a series' first and last, its price carried forward over at most ``fill`` days."""
    span = series.groupBy(*KEYS).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(*KEYS, F.explode(F.sequence("a", "b")).alias("date"))
    w = Window.partitionBy(*KEYS).orderBy("date").rowsBetween(-fill, 0)
    return span.join(series.select(*KEYS, "date", "price"), [*KEYS, "date"], "left").withColumn("filled_price", F.last("price", ignorenulls=True).over(w))
