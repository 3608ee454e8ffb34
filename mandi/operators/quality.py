"""Flags of market quotes.  No row is dropped and none is changed; all windows share one sort.

Input: product_id, market_id, date, price, previous_price, reported_change_pct and a trace column, or
more than one, that orders quotes of one day.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mandi.functions.scalar import price_valid

SERIES = ["market_id", "product_id"]  # the number first: sorts compare it at once, products are few


def _with_quantiles(df: DataFrame, ordered: str, shares: list[float]) -> DataFrame:
    """df with q0, q1, ...: interpolated quantiles of a sorted array.

    Each step is a column of its own: written out in one expression they repeat each other, and the code that Spark makes of it gets long and slow.
    """
    n, names = F.size(ordered), [f"q{i}" for i in range(len(shares))]
    df = df.withColumns({f"{q}_place": (n - 1) * share for q, share in zip(names, shares)})
    df = df.withColumns({f"{q}_{end}": f(f"{q}_place").cast("int") for q in names for end, f in (("low", F.floor), ("high", F.ceil))})
    df = df.withColumns({f"{q}_{end}_value": F.get(ordered, F.col(f"{q}_{end}")) for q in names for end in ("low", "high")})

    def between(q: str) -> Column:
        place, low, high, a, b = (F.col(f"{q}_{c}") for c in ("place", "low", "high", "low_value", "high_value"))
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    return df.withColumns({q: between(q) for q in names}).drop(*(f"{q}_{c}" for q in names for c in ("place", "low", "high", "low_value", "high_value")))


def add_quality(quotes: DataFrame, trace: str | list[str] = "trace", tolerance: float = 0.011, stale_after: int = 7, window: int = 90, at_least: int = 30, widths: float = 6.0, flat_ratio: float = 1.5, series: list[str] = SERIES) -> DataFrame:
    """quotes and their flags.

    price_valid, invalid_reason; change_consistent (NULL where it can't be judged); duplicate (all
    quotes of one series and day); zero_change (equal to the previous price, the day after the
    previous quote), zero_run (length so far) and stale; days_since_valid (NULL before the first
    valid one); outlier (log price far from the earlier ``window`` rows' quartiles, of which
    ``at_least`` are valid; where they coincide, a factor of flat_ratio).
    """
    w = Window.partitionBy(*series).orderBy("date", *([trace] if isinstance(trace, str) else trace))
    before = w.rowsBetween(-window, -1)
    valid = price_valid(F.col("price"))
    reason = F.when(F.col("price").isNull() | F.isnan("price"), "missing").when(F.col("price") <= 0, "not_positive").when(~valid, "not_finite")
    change = F.bround(F.try_divide(F.col("price") - F.col("previous_price"), F.col("previous_price")) * 100, 2)
    judged = valid & price_valid(F.col("previous_price")) & F.col("reported_change_pct").isNotNull()
    gap = F.datediff("date", F.lag("date").over(w))
    zero = F.coalesce((F.abs(F.col("price") - F.col("previous_price")) <= 1e-12) & (gap == 1), F.lit(False))
    df = quotes.withColumns({
        "price_valid": valid,
        "invalid_reason": reason,
        "change_consistent": F.when(judged, F.abs(change - F.col("reported_change_pct")) <= tolerance),
        "duplicate": reduce(Column.__or__, (F.coalesce(near(F.struct("date")).over(w).eqNullSafe(F.struct("date")), F.lit(False)) for near in (F.lag, F.lead))),
        "zero_change": zero,
        "log_price": F.when(valid, F.ln("price")),
        "earlier": F.collect_list(F.when(valid, F.ln("price"))).over(before),
    })
    # a short array, sorted: cheaper than a percentile for each frame; it is left behind before the next window
    df = df.withColumn("earlier", F.sort_array("earlier"))
    df = _with_quantiles(df, "earlier", [0.25, 0.5, 0.75]).withColumn("enough", F.size("earlier") >= at_least).drop("earlier")
    df = df.withColumns({"scale": (F.col("q2") - F.col("q0")) / 1.349, "far": F.abs(F.col("log_price") - F.col("q1"))})
    outlier = F.col("enough") & F.when(F.col("scale") > 0, F.col("far") > widths * F.col("scale")).otherwise(F.col("far") > math.log(flat_ratio))
    df = df.withColumn("outlier", F.coalesce(outlier, F.lit(False))).drop("log_price", "enough", "scale", "far", "q0", "q1", "q2")
    # zero changes so far, less those before the last quote that changed: all windows have one order
    zero = F.col("zero_change").cast("int")
    df = df.withColumns({"zeros": F.sum(zero).over(w), "stale": F.sum(zero).over(w.rowsBetween(1 - stale_after, 0)) == stale_after})
    run = F.col("zeros") - F.coalesce(F.last(F.when(~F.col("zero_change"), F.col("zeros")), ignorenulls=True).over(w), F.lit(0))
    last_valid = F.last(F.when(F.col("price_valid"), F.col("date")), ignorenulls=True).over(w)
    df = df.withColumns({"zero_run": F.when(F.col("zero_change"), run).otherwise(0).cast("int"), "days_since_valid": F.datediff("date", last_valid)})
    return df.drop("zeros")


def quality_summary(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each flag, per product and for all (NULL product)."""
    n = {"rows": F.count("*"), "invalid": F.count_if(~F.col("price_valid")), "evaluable": F.count("change_consistent"), "inconsistent": F.count_if(~F.col("change_consistent"))}
    n |= {f"{c}_rows": F.count_if(F.col(c)) for c in ("duplicate", "zero_change", "stale", "outlier")}
    n["before_first_valid"] = F.count_if(F.col("days_since_valid").isNull())
    return flagged.rollup(*(by or ["product_id"])).agg(*(c.alias(k) for k, c in n.items()))
