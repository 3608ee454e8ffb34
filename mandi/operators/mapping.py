"""Markets to cities: lookup, rules of the mapping table, conflicts, and the dimensions derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mandi.functions.scalar import market_key

from . import contracts, tables

STATUSES = ("mapped_existing_city", "unmapped_new_city", "unmapped_unknown")
CONFIDENCE = {"high": 1.0, "medium": 0.75, "low": 0.5}  # fixed values; any other is 0
MOST_MARKETS = 1_000_000  # a row each of about 100 bytes: more are joined, which moves all quotes once more


def map_markets(quotes: DataFrame, mapping: DataFrame, key: str = "market_id", check: bool = True) -> DataFrame:
    """quotes with the mapping's columns; every market must be mapped exactly once.

    A mapping of usual size is broadcast after a count, so quotes stay where they are and a busy market isn't one task.
    """
    if check:
        contracts.assert_unique(mapping, [key])
        contracts.assert_none(quotes.select(key).distinct().join(mapping, key, "left_anti"), "markets that the mapping lacks")
    return quotes.join(tables.small(mapping, MOST_MARKETS), key, "left")


def mapping_rule_breaks(mapping: DataFrame) -> DataFrame:
    """Rows that break a rule of the mapping table, with the rule's name."""
    mapped = F.col("mapping_status") == STATUSES[0]
    rules = {
        "unknown_status": ~F.col("mapping_status").isin(*STATUSES),
        "mapped_without_city": mapped & (F.col("city_id").isNull() | F.col("province").isNull()),
        "unmapped_with_city": ~mapped & F.col("city_id").isNotNull(),
        "unknown_with_place": (F.col("mapping_status") == STATUSES[2]) & F.col("longitude").isNotNull(),
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    rows = mapping.withColumn("rule", F.explode(broken)).select("market_id", "rule")
    versions = mapping.agg(F.count_distinct("mapping_version").alias("n")).filter("n > 1").select(F.lit(None).cast(mapping.schema["market_id"].dataType).alias("market_id"), F.lit("mixed_versions").alias("rule"))
    return rows.unionByName(versions)


def province_conflicts(mapped: DataFrame) -> DataFrame:
    """Pairs of raw and mapped province that differ, per market, ranked by rows.

    Shares are of the market's rows and of all rows.
    """
    totals = mapped.groupBy("market_id").agg(F.count("*").alias("market_rows"))
    all_rows = totals.agg(F.sum("market_rows").alias("all_rows"))
    bad = mapped.filter(F.col("raw_province") != F.col("province")).groupBy("market_id", "raw_province", "province").agg(F.count("*").alias("rows"), F.count_distinct("product_id").alias("products"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    out = bad.join(totals, "market_id").join(F.broadcast(all_rows))
    out = out.withColumns({"share_of_market": F.col("rows") / F.col("market_rows"), "share_of_all": F.col("rows") / F.col("all_rows")})
    decision = F.when(F.col("share_of_market") >= 0.5, "review_mapping").when(F.col("share_of_market") >= 0.05, "keep_mapping_flag_source").otherwise("keep_mapping")
    # a row for each conflicting pair: metadata, ranked in one task
    rank = F.row_number().over(Window.orderBy(F.desc("rows"), "market_id", "raw_province"))
    return out.withColumn("decision", decision).withColumn("conflict_id", rank).drop("all_rows")


def city_dimension(mapping: DataFrame) -> DataFrame:
    """Mapped cities with their markets, numbered by province and city in byte order."""
    cities = mapping.filter("city IS NOT NULL").groupBy("province", "city").agg(F.count_distinct("market_id").alias("markets"))
    number = F.row_number().over(Window.orderBy("province", "city"))
    return cities.withColumn("city_code", F.concat(F.lit("C"), F.lpad(number.cast("string"), 3, "0")))


def product_price_level(quotes: DataFrame) -> DataFrame:
    """Counts and quartiles of each product's valid prices; its level among product medians' thirds."""
    valid = (F.col("price") > 0) & ~F.isnan("price")
    q = F.percentile(F.when(valid, F.col("price")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = quotes.groupBy("product_id").agg(F.count("*").alias("observations"), F.count_if(valid).alias("valid_observations"), q.alias("q"))
    stats = stats.select("product_id", "observations", "valid_observations", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))))
    thirds = stats.agg(F.percentile("p50", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("t"))
    level = F.when(F.col("p50") <= F.col("t")[0], "low").when(F.col("p50") <= F.col("t")[1], "medium").otherwise("high")
    return stats.join(F.broadcast(thirds)).withColumn("price_level", level).drop("t")


def name_candidates(raw: DataFrame, known: DataFrame, most: int = 1) -> DataFrame:
    """raw_name, known_name, distance: names (column name) whose keys are at most ``most`` (1 or 0) edits apart.

    Names meet in blocks: keys one edit apart have a form in common among themselves and their forms with one
    character left out, so only names of one block are compared, and none that are near are missed.
    """
    if most not in (0, 1):
        raise ValueError("one edit at most")

    def forms(df: DataFrame, name: str, key: str) -> DataFrame:
        keyed = df.select(F.col("name").alias(name), market_key(F.col("name")).alias(key)).filter(F.col(key).isNotNull()).distinct()
        less = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substring(F.col(key), F.lit(1), i - 1), F.substring(F.col(key), i + 1, F.length(key))))
        every = F.array_union(F.array(key), F.when(F.length(key) > 0, less).otherwise(F.array().cast("array<string>"))) if most else F.array(key)
        return keyed.withColumn("form", F.explode(every))

    met = forms(raw, "raw_name", "raw_key").join(forms(known, "known_name", "known_key"), "form").drop("form").distinct()
    return met.withColumn("distance", F.levenshtein("raw_key", "known_key")).filter(F.col("distance") <= most).select("raw_name", "known_name", "distance")
