"""City-day prices: every market has one price a day, every city the median of its markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the reliability score, and its bounds.
WEIGHTS = {"stale": 0.40, "outlier": 0.25, "duplicate": 0.10, "confidence": 0.10, "markets": 0.15}
GOOD, CAUTION = 0.85, 0.65


def eligible(flagged: DataFrame) -> DataFrame:
    """Quotes of mapped markets with a valid price."""
    return flagged.filter((F.col("mapping_status") == "mapped_existing_city") & F.col("price_valid"))


def _middle(price: str = "price", rank: str = "rank", n: str = "n") -> Column:
    """Aggregate: the median of prices ranked from 1 to n, as the mean of the one or two in the middle."""
    return F.avg(F.when((2 * F.col(rank)).between(F.col(n), F.col(n) + 2), F.col(price)))


def market_day(quotes: DataFrame) -> DataFrame:
    """One row per product, market and day: median price and whether any quote has a flag.

    A market-day has mostly one quote, so there are almost as many as quotes: they are told from one sort, whose first quote
    of each stays with what the window found, and not from a hash table of them.
    """
    by = ["product_id", "city_id", "province", "market_id", "date"]
    # the number first: sorts compare it at once
    w = Window.partitionBy("market_id", "product_id", "date", "city_id", "province").orderBy(F.asc_nulls_last("price"))
    day = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = quotes.select(
        *by, F.row_number().over(w).alias("first"), F.collect_list("price").over(day).alias("prices"), F.count("*").over(day).alias("source_rows"),
        F.bool_or("stale").over(day).alias("stale"), F.bool_or("outlier").over(day).alias("outlier"), F.max("confidence").over(day).alias("confidence"),
    )
    n = F.size("prices")
    at = lambda k: F.try_element_at("prices", F.floor(k / 2).cast("int"))
    price = F.when(n > 0, (at(n + 1) + at(n + 2)) / 2)
    return found.filter("first = 1").select(*by, price.alias("price"), "source_rows", "stale", "outlier", "confidence", (F.col("source_rows") > 1).alias("duplicate"))


def trimmed_mean(days: DataFrame, by: list[str], share: float = 0.10) -> DataFrame:
    """Mean of the markets' prices without floor(n * share) at either end."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("price", "market_id"))
    n = F.count("*").over(Window.partitionBy(*by))
    cut = F.floor(F.col("n") * share)
    ranked = days.withColumn("rank", rank).withColumn("n", n)
    return ranked.filter((F.col("rank") > cut) & (F.col("rank") <= F.col("n") - cut)).groupBy(*by).agg(F.avg("price").alias("trimmed_mean_price"))


def reliability(w: dict[str, float] = WEIGHTS) -> Column:
    """Score of a city-day from its shares."""
    return (
        w["stale"] * (1 - F.col("stale_share")) + w["outlier"] * (1 - F.col("outlier_share")) + w["duplicate"] * (1 - F.col("duplicate_share"))
        + w["confidence"] * F.col("mean_confidence") + w["markets"] * F.least(F.col("markets") / 2, F.lit(1.0))
    )


def quality_label(score: Column) -> Column:
    score = F.round(score, 9)  # sums of weights may miss a bound by float noise
    return F.when(score >= GOOD, "good").when(score >= CAUTION, "caution").otherwise("poor")


def city_day(days: DataFrame, trim: float = 0.10) -> DataFrame:
    """One row per product, city and day from market-days; markets count alike."""
    by = ["product_id", "city_id", "province", "date"]
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_share")
    w = Window.partitionBy("date", "city_id", "product_id", "province")  # the day first: sorts compare it at once
    rank = F.row_number().over(w.orderBy("price", "market_id"))
    n = F.count("*").over(w)
    cut = F.floor(F.col("n") * trim)
    # the trimmed mean rides on the same grouping: one sort, one shuffle
    ranked = days.withColumn("rank", rank).withColumn("n", n)
    inside = (F.col("rank") > cut) & (F.col("rank") <= F.col("n") - cut)
    out = ranked.groupBy(*by).agg(
        _middle().alias("price"), F.avg(F.when(inside, F.col("price"))).alias("trimmed_mean_price"), F.count("*").alias("markets"), F.sum("source_rows").alias("source_rows"),
        share("stale"), share("outlier"), share("duplicate"), F.avg("confidence").alias("mean_confidence"),
    )
    return out.withColumn("reliability", reliability()).withColumn("quality", quality_label(F.col("reliability")))


def exclusions(flagged: DataFrame) -> DataFrame:
    """What becomes of the rows of each product on the way to city-days."""
    mapped = F.col("mapping_status") == "mapped_existing_city"
    return flagged.groupBy("product_id").agg(
        F.count("*").alias("rows"), F.count_if(~mapped).alias("unmapped"), F.count_if(mapped & ~F.col("price_valid")).alias("invalid_price"), F.count_if(mapped & F.col("price_valid")).alias("eligible"),
        F.count_distinct(F.when(mapped & F.col("price_valid"), F.struct("market_id", "date"))).alias("market_days"), F.count_distinct(F.when(mapped & F.col("price_valid"), F.struct("city_id", "date"))).alias("city_days"),
    )
