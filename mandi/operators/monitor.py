"""Monthly monitor and the questions its pages ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mandi.functions.scalar import median

QUARTILES = (0.25, 0.5, 0.75)


def _quartiles(column: str):
    return F.percentile(column, F.array(*map(F.lit, QUARTILES)))


def monthly_monitor(days: DataFrame) -> DataFrame:
    """One row per product, city and month."""
    out = days.groupBy("product_id", "city_id", "province", F.date_format("date", "yyyy-MM").alias("month")).agg(
        _quartiles("price").alias("q"), F.count("*").alias("valid_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("reliability").alias("mean_reliability"),
        *(F.count_if(F.col("quality") == x).alias(f"{x}_days") for x in ("good", "caution", "poor")), median("markets").alias("median_markets"), F.max("markets").alias("max_markets"), F.sum("source_rows").alias("source_rows"),
    )
    return out.select("*", *(F.col("q")[i].alias(c) for i, c in enumerate(("p25_price", "median_price", "p75_price")))).drop("q")


def city_profiles(tiers: DataFrame) -> DataFrame:
    return tiers.select("product_id", "city_id", "tier", "monitor_eligible", "forecast_eligible", "valid_days", "coverage_rate", "coverage_score")


def product_summary(months: DataFrame, tiers: DataFrame) -> DataFrame:
    """Records, cities and months of each product, and its cities by tier."""
    a = months.groupBy("product_id").agg(F.count("*").alias("records"), F.count_distinct("city_id").alias("observed_cities"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    b = tiers.groupBy("product_id").agg(F.count_if("monitor_eligible").alias("eligible_cities"), *(F.count_if(F.col("tier") == t).alias(f"tier_{t.lower()}") for t in "ABC"))
    return a.join(b, "product_id")


def city_ranking(months: DataFrame, profiles: DataFrame, least_days: int = 15, by: tuple[str, ...] = ("product_id", "month")) -> DataFrame:
    """Cities of tier A or B with enough days, dearest first, per product and month."""
    good = profiles.filter("monitor_eligible").select("product_id", "city_id", "tier")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("median_price"), "city_id"))
    return months.filter(F.col("valid_days") >= least_days).join(good, ["product_id", "city_id"]).select(*by, "city_id", "province", "tier", "median_price", "valid_days", rank.alias("rank"))


def cross_city_spread(ranked: DataFrame) -> DataFrame:
    """Dearest and cheapest city, quartiles and the gap in percent, per product and month."""
    out = ranked.groupBy("product_id", "month").agg(
        F.count("*").alias("cities"), F.max(F.struct("median_price", (-F.col("city_id")).alias("other"))).alias("hi"), F.min(F.struct("median_price", "city_id")).alias("lo"), _quartiles("median_price").alias("q"),
    )
    hi, lo = F.col("hi.median_price"), F.col("lo.median_price")
    return out.select("product_id", "month", "cities", (-F.col("hi.other")).alias("highest_city"), hi.alias("highest_price"), F.col("lo.city_id").alias("lowest_city"), lo.alias("lowest_price"), *(F.col("q")[i].alias(c) for i, c in enumerate(("p25", "median", "p75"))), F.when(lo > 0, (hi / lo - 1) * 100).alias("spread_pct"))


def province_summary(ranked: DataFrame, least_cities: int = 2) -> DataFrame:
    """Median of city medians of provinces with enough cities."""
    return ranked.groupBy("product_id", "month", "province").agg(median("median_price").alias("province_median"), F.count("*").alias("cities")).filter(F.col("cities") >= least_cities)


def seasonal_profile(months: DataFrame) -> DataFrame:
    """Per product and city: quartiles of monthly medians by calendar month, and the high and low month."""
    m = months.withColumn("calendar_month", F.substring("month", 6, 2).cast("int"))
    by = m.groupBy("product_id", "city_id", "calendar_month").agg(_quartiles("median_price").alias("q"), F.count_distinct(F.substring("month", 1, 4)).alias("years"))
    by = by.select("product_id", "city_id", "calendar_month", "years", *(F.col("q")[i].alias(c) for i, c in enumerate(("p25", "median", "p75"))))
    w = Window.partitionBy("product_id", "city_id")
    hi = F.max(F.struct(F.col("median"), (-F.col("calendar_month")).alias("m"))).over(w)
    lo = F.min(F.struct("median", F.col("calendar_month").alias("m"))).over(w)
    out = by.withColumns({"high_month": -hi["m"], "low_month": lo["m"], "gap_pct": F.when(lo["median"] > 0, (hi["median"] / lo["median"] - 1) * 100)})
    return out


def month_change(months: DataFrame) -> DataFrame:
    """Change in percent against the previous month that has a record."""
    w = Window.partitionBy("product_id", "city_id").orderBy("month")
    before = F.lag("median_price").over(w)
    return months.select("product_id", "city_id", "month", "median_price", F.lag("month").over(w).alias("previous_month"), F.when(before > 0, (F.col("median_price") / before - 1) * 100).alias("change_pct"))


def data_quality_story(months: DataFrame, profiles: DataFrame) -> DataFrame:
    """Tier, days, poor share and coverage of each month's days."""
    days = F.day(F.last_day(F.to_date(F.concat("month", F.lit("-01")))))
    return months.join(profiles.select("product_id", "city_id", "tier"), ["product_id", "city_id"], "left").select("product_id", "city_id", "month", "tier", "valid_days", (F.col("poor_days") / F.col("valid_days")).alias("poor_share"), (F.col("valid_days") / days).alias("month_coverage"))


def peer_percentile(months: DataFrame) -> DataFrame:
    """Where a city's median stands among cities that month, and among its own same calendar months."""
    season = Window.partitionBy("product_id", "city_id", F.substring("month", 6, 2)).orderBy("median_price")
    return months.select("product_id", "city_id", "month", F.percent_rank().over(Window.partitionBy("product_id", "month").orderBy("median_price")).alias("peer_percentile"), F.cume_dist().over(season).alias("seasonal_percentile"))


def evidence_envelope(rows: DataFrame, as_of: str, status: str, reason: str, subject: list[str]) -> DataFrame:
    """What a reader may rely on: date, release status, why it falls back, and the decision it allows."""
    decision = F.when(F.col(status).isin("model_target", "model_minimum"), "usable").when(F.col(status) == "point_only_model", "usable_without_interval").otherwise("reference_only")
    return rows.select(*subject, F.col(as_of).alias("evidence_as_of"), F.col(status).alias("release_status"), F.col(reason).alias("fallback_reason"), decision.alias("decision_status"))
