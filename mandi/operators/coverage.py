"""How well each product and city is covered, and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mandi.functions.scalar import median

# Gates of the tiers, in the order in which failures are named, and weights of the score.
GATES = {
    "A": {"valid_days": 2500, "active_span_coverage": 0.80, "internal_gap": 60, "trailing_gap": 365, "stale_share": 0.25, "outlier_share": 0.10, "poor_day_share": 0.20},
    "B": {"valid_days": 365, "active_span_coverage": 0.20, "internal_gap": 365, "trailing_gap": 730, "poor_day_share": 0.60},
}
SCORE = {"coverage": 0.45, "active": 0.20, "recency": 0.15, "fresh": 0.10, "inlier": 0.05, "not_poor": 0.05}
# What each gate looks at, and whether it is a least or a most value.
_GATED = {
    "valid_days": ("valid_days", True), "active_span_coverage": ("active_coverage", True), "internal_gap": ("longest_internal_gap", False), "trailing_gap": ("trailing_gap", False),
    "stale_share": ("mean_stale_share", False), "outlier_share": ("mean_outlier_share", False), "poor_day_share": ("poor_share", False),
}


def dense_grid(products: DataFrame, cities: DataFrame) -> DataFrame:
    """Every product with every city: both are small dimensions, and empty pairs are a result."""
    return products.crossJoin(F.broadcast(cities))


def coverage_metrics(days: DataFrame, grid: DataFrame, start: str, end: str, fade_days: int = 365) -> DataFrame:
    """Dates, gaps, shares and a score (0 to 1) of each pair of the grid.

    A pair without a day has no dates and shares, zero counts, and the whole calendar as its gap.
    """
    by = ["product_id", "city_id"]
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    total = F.datediff(last, first) + 1
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(*by).orderBy("date"))) - 1
    share = lambda q: F.avg((F.col("quality") == q).cast("double")).alias(f"{q}_share")
    got = days.withColumn("gap", gap).groupBy(*by).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("days"), F.max("gap").alias("gap"),
        F.avg("markets").alias("mean_markets"), F.max("markets").alias("markets"), F.avg((F.col("markets") == 1).cast("double")).alias("single_market_share"),
        F.avg("stale_share").alias("mean_stale_share"), F.avg("outlier_share").alias("mean_outlier_share"), F.avg("duplicate_share").alias("mean_duplicate_share"), F.avg("reliability").alias("mean_reliability"),
        share("good"), share("caution"), share("poor"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = grid.join(got, by, "left").withColumns({
        "valid_days": zero(F.col("days")), "coverage_rate": zero(F.col("days")) / total,
        "active_span": zero(F.datediff("last_date", "first_date") + 1),
        "leading_gap": F.coalesce(F.datediff("first_date", first), total), "trailing_gap": F.coalesce(F.datediff(last, "last_date"), total),
        "longest_internal_gap": zero(F.col("gap")), "max_markets": zero(F.col("markets")),
    })
    active = F.when(F.col("active_span") > 0, F.col("valid_days") / F.col("active_span")).otherwise(0.0)
    recency = F.greatest(F.lit(0.0), 1 - F.col("trailing_gap") / fade_days)
    parts = {"coverage": F.col("coverage_rate"), "active": active, "recency": recency, "fresh": 1 - F.col("mean_stale_share"), "inlier": 1 - F.col("mean_outlier_share"), "not_poor": 1 - F.col("poor_share")}
    score = sum((SCORE[k] * c for k, c in parts.items()), F.lit(0.0))
    return out.withColumns({
        "active_coverage": active, "longest_gap": F.greatest("leading_gap", "trailing_gap", "longest_internal_gap"),
        "coverage_score": F.when(F.col("valid_days") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))),
    }).drop("days", "gap", "markets")


def failed_gates(gates: dict) -> Column:
    """Names of the gates that fail, comma-joined; a missing value fails."""
    check = lambda k: F.col(_GATED[k][0]) >= gates[k] if _GATED[k][1] else F.col(_GATED[k][0]) <= gates[k]
    return F.concat_ws(",", *(F.when(~F.coalesce(check(k), F.lit(False)), F.lit(k)) for k in gates))


def assign_tier(metrics: DataFrame, gates: dict = GATES) -> DataFrame:
    """Tier A, B or C with the failed gates of A (for B) or of B (for C)."""
    a, b = failed_gates(gates["A"]), failed_gates(gates["B"])
    tier = F.when(a == "", "A").when(b == "", "B").otherwise("C")
    reason = F.when(a == "", "meets_all_tier_a_gates").otherwise(F.concat(F.lit("tier_a_failed:"), a, F.when(b == "", ";meets_all_tier_b_gates").otherwise(F.concat(F.lit(";tier_b_failed:"), b))))
    return metrics.withColumns({"tier": tier, "tier_reason": reason, "forecast_eligible": tier == "A", "monitor_eligible": tier != "C"})


def tier_summary(tiers: DataFrame) -> DataFrame:
    count = lambda t: F.count_if(F.col("tier") == t).alias(f"tier_{t.lower()}")
    return tiers.groupBy("product_id").agg(count("A"), count("B"), count("C"), F.count_if(F.col("valid_days") == 0).alias("no_data_cities"), median("valid_days").alias("median_valid_days"), median("coverage_rate").alias("median_coverage"), F.max("valid_days").alias("max_valid_days"))


def transition_diagnostics(days: DataFrame) -> DataFrame:
    """Pairs of consecutive days: how many, the unchanged share, the median absolute log return."""
    w = Window.partitionBy("product_id", "city_id").orderBy("date")
    steps = days.select("product_id", "price", F.lag("price").over(w).alias("before"), F.datediff("date", F.lag("date").over(w)).alias("gap")).filter("gap = 1")
    return steps.groupBy("product_id").agg(F.count("*").alias("transitions"), F.avg((F.abs(F.col("price") - F.col("before")) <= 1e-12).cast("double")).alias("unchanged_share"), median(F.abs(F.ln(F.col("price") / F.col("before")))).alias("median_abs_log_return"))


def period_counts(days: DataFrame, split) -> DataFrame:
    """City-days of each quality in each split."""
    return days.withColumn("split", split).groupBy("split").agg(F.count("*").alias("rows"), *(F.count_if(F.col("quality") == q).alias(q) for q in ("good", "caution", "poor")))
