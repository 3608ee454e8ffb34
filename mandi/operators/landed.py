"""Landed cost of buying in another city: distance, risk, loss, ranking and sensitivity."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mandi.functions.scalar import haversine, median

from . import contracts


@dataclass(frozen=True)
class Scenario:
    """Parameters of a purchase; fixed values are the defaults."""

    quantity_kg: float = 10000.0
    transport_cost: float = 0.0025
    loss_rate: float = 0.08
    max_distance_km: float = 1500.0
    road_factor: float = 1.25
    risk_aversion: float = 0.5
    least_reliability: float = 0.65
    reliability_gamma: float = 1.0
    most_multiplier: float = 1.5

    def __post_init__(self):
        bad = [n for n in ("quantity_kg", "max_distance_km") if not 0 < getattr(self, n) < float("inf")]
        bad += [n for n in ("transport_cost", "risk_aversion", "reliability_gamma") if not 0 <= getattr(self, n) < float("inf")]
        bad += ["loss_rate"] * (not 0 <= self.loss_rate < 1) + ["least_reliability"] * (not 0 <= self.least_reliability <= 1) + [n for n in ("most_multiplier", "road_factor") if not 1 <= getattr(self, n) < float("inf")]
        if bad:
            raise ValueError(f"out of range: {bad}")


def risk_calibration(residuals: DataFrame, before: str, at_least: int = 30, q: float = 0.8) -> DataFrame:
    """q80 and median absolute log error per product, horizon and route, of targets before a date."""
    past = residuals.filter(F.col("target_date") < F.lit(before).cast("date"))
    got = past.groupBy("product_id", "horizon", "route").agg(F.count("*").alias("rows"), F.percentile("residual", F.lit(q)).alias("q80_error"), median("residual").alias("median_error"), F.min("target_date").alias("first_target"), F.max("target_date").alias("last_target"))
    return got.filter(F.col("rows") >= at_least)


def attach_calibration(snapshot: DataFrame, calibration: DataFrame, routes: DataFrame) -> DataFrame:
    """snapshot with its group's route and usual relative error, and the error of the route over all groups where a group has none."""
    group = calibration.select("product_id", "horizon", "route", "q80_error")
    wide = calibration.groupBy("horizon").agg(F.max("q80_error").alias("widest_error"))
    df = snapshot.join(routes.select("product_id", "horizon", "route"), ["product_id", "horizon"], "left").withColumn("route", F.coalesce("route", F.lit("baseline")))
    df = df.join(group, ["product_id", "horizon", "route"], "left").join(wide, "horizon", "left")
    return df.withColumns({"risk_basis": F.when(F.col("q80_error").isNotNull(), "route_q80_error").otherwise("widest_q80_error"), "q80_error": F.coalesce("q80_error", "widest_error")}).drop("widest_error")


def price_labels(df: DataFrame, route: str = "route", interval: Column | None = None) -> DataFrame:
    """What a point price is, and whether its interval is released."""
    full = F.lit(False) if interval is None else interval
    base = F.col(route) == "baseline"
    return df.withColumns({"price_label": F.when(base, "last price carried forward, not a model").when(full, "model point with calibrated interval").otherwise("model point without interval"), "interval_status": F.when(base, "not_applicable_baseline").when(full, "calibrated_released").otherwise("not_released")})


def attach_reliability(snapshot: DataFrame, days: DataFrame, at: str, lookback: int = 28) -> DataFrame:
    """Reliability of the origin price's day, else the median of the trailing days, and which it is."""
    near = days.filter(F.col("date").between(F.date_sub(F.lit(at).cast("date"), lookback), F.lit(at).cast("date")))
    exact = near.select("product_id", "city_id", F.col("date").alias("origin_price_date"), F.col("reliability").alias("exact_reliability"))
    trailing = near.groupBy("product_id", "city_id").agg(median("reliability").alias("trailing_reliability"))
    out = snapshot.join(exact, ["product_id", "city_id", "origin_price_date"], "left").join(trailing, ["product_id", "city_id"], "left")
    return out.withColumns({"reliability": F.coalesce("exact_reliability", "trailing_reliability"), "reliability_source": F.when(F.col("exact_reliability").isNotNull(), "origin_price_date_exact").otherwise("trailing_28d_median")}).drop("exact_reliability", "trailing_reliability")


def base_uncertainty(point: Column, p90: Column, q80: Column) -> Column:
    """Released upper bound minus the point, else the point times the usual relative error."""
    return F.when(p90.isNotNull(), F.greatest(p90 - point, F.lit(0.0))).otherwise(point * (F.exp(q80) - 1))


def distances(pairs: DataFrame) -> DataFrame:
    """pairs with the straight line between source and target place, which no parameter of a scenario changes."""
    return pairs.withColumn("distance_km", haversine(F.col("longitude"), F.col("latitude"), F.col("target_longitude"), F.col("target_latitude")))


def costs(pairs: DataFrame, s: Scenario | None = None) -> DataFrame:
    """Unit and total cost of each pair (source and target place or their distance, point, reliability, uncertainty).

    With s None the parameters are columns of pairs.
    """
    p = (lambda n: F.col(n)) if s is None else (lambda n: F.lit(getattr(s, n)))
    df = pairs if "distance_km" in pairs.columns else distances(pairs)
    df = df.withColumn("road_km", F.col("distance_km") * p("road_factor")).withColumn("transport", F.col("road_km") * p("transport_cost"))
    multiplier = F.greatest(F.lit(1.0), F.least(p("most_multiplier"), 1 + p("reliability_gamma") * (1 - F.col("reliability"))))
    df = df.withColumn("multiplier", multiplier).withColumn("risk_penalty", p("risk_aversion") * F.col("uncertainty") * F.col("multiplier"))
    df = df.withColumn("before_loss", F.col("point") + F.col("transport") + F.col("risk_penalty"))
    df = df.withColumn("unit_cost", F.col("before_loss") / (1 - p("loss_rate")))
    return df.withColumns({"loss_cost": F.col("unit_cost") - F.col("before_loss"), "total_cost": F.col("unit_cost") * p("quantity_kg")})


def rank_sources(costed: DataFrame, s: Scenario | None = None, top: int = 3, by: tuple[str, ...] = ("product_id", "horizon", "target_city")) -> DataFrame:
    """The cheapest sources of each target, with savings against buying locally.

    Sources must be reliable and near enough by road, and not the target itself.
    """
    p = (lambda n: F.col(n)) if s is None else (lambda n: F.lit(getattr(s, n)))
    reliable = costed.filter(F.col("reliability") >= p("least_reliability"))
    w = Window.partitionBy(*by)
    local = F.max(F.when(F.col("city_id") == F.col("target_city"), F.col("unit_cost"))).over(w)
    near = reliable.withColumn("local_cost", local).filter((F.col("city_id") != F.col("target_city")) & (F.col("road_km") <= p("max_distance_km")))
    rank = F.row_number().over(w.orderBy("unit_cost", F.desc("reliability"), "city_id"))
    out = near.withColumn("rank", rank).filter(F.col("rank") <= top)
    return out.withColumns({"saving": F.col("local_cost") - F.col("unit_cost"), "saving_rate": F.when(F.col("local_cost") > 0, (F.col("local_cost") - F.col("unit_cost")) / F.col("local_cost"))})


def funnel(costed: DataFrame, s: Scenario, by: tuple[str, ...] = ("product_id", "horizon", "target_city"), asked: DataFrame | None = None) -> DataFrame:
    """How many sources each filter leaves, and what the answer is; asked: keys to answer for, with or without data."""
    other = F.col("city_id") != F.col("target_city")
    reliable = F.col("reliability") >= s.least_reliability
    near = F.col("road_km") <= s.max_distance_km
    counts = {"sources": F.count("*"), "reliable": F.count_if(reliable), "near": F.count_if(reliable & near), "candidates": F.count_if(reliable & near & other)}
    out = costed.groupBy(*by).agg(*(c.alias(n) for n, c in counts.items()))
    if asked is not None:
        out = asked.select(*by).distinct().join(out, list(by), "left").na.fill(0, list(counts))
    return out.withColumn("status", F.when(F.col("candidates") > 0, "ok").when(F.col("sources") == 0, "no_product_horizon_data").otherwise("no_candidates"))


def parameter_grid(df: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """df with every combination of the parameters, and its number: one explode of a small literal."""
    combos = reduce(lambda acc, kv: [c | {kv[0]: v} for c in acc for v in kv[1]], grid.items(), [{}])
    each = F.array(*(F.struct(F.lit(i).alias("combination"), *(F.lit(v).alias(k) for k, v in c.items())) for i, c in enumerate(combos)))
    return df.withColumn("g", F.explode(each)).select("*", "g.*").drop("g")


def sensitivity_summary(ranked: DataFrame, combinations: int, default: DataFrame, by: tuple[str, ...] = ("product_id", "horizon", "target_city")) -> DataFrame:
    """How often each source is first or among the top over all combinations; its default rank."""
    out = ranked.groupBy(*by, "city_id").agg(
        F.count_distinct("combination").alias("top_count"), F.count_distinct(F.when(F.col("rank") == 1, F.col("combination"))).alias("first_count"), F.avg("rank").alias("mean_rank"), F.min("unit_cost").alias("least_cost"), F.max("unit_cost").alias("most_cost"),
    )
    w = Window.partitionBy(*by)
    out = out.withColumns({"top_share": F.col("top_count") / combinations, "first_share": F.col("first_count") / combinations, "distinct_top": F.count("*").over(w), "distinct_first": F.count_if(F.col("first_count") > 0).over(w)})
    return out.join(default.select(*by, "city_id", F.col("rank").alias("default_rank")), [*by, "city_id"], "left")


def geo_audit(pairs: DataFrame, bounds: tuple[tuple[float, str], ...] = ((100, "far"), (50, "check"), (25, "note"))) -> DataFrame:
    """Distance of each market from its city's anchor, with a band; no place: missing."""
    d = haversine(F.col("longitude"), F.col("latitude"), F.col("anchor_longitude"), F.col("anchor_latitude"))
    band = reduce(lambda acc, b: acc.when(F.col("distance_km") > b[0], b[1]), bounds, F.when(F.col("distance_km").isNull(), "missing"))
    return pairs.withColumn("distance_km", d).withColumn("status", band.otherwise("ok"))


def top_deviations(audited: DataFrame, n: int = 15) -> DataFrame:
    """The markets farthest from their city's anchor."""
    return audited.filter("distance_km IS NOT NULL").orderBy(F.desc("distance_km"), "market_id").limit(n)


def city_geo(cities: DataFrame, known: DataFrame, override: DataFrame, version: str = "v1") -> DataFrame:
    """A place for each city (city_id, city, province): by name and province, or from an override row (city_id, longitude, latitude, rule)."""
    o = override.select("city_id", F.col("longitude").alias("o_longitude"), F.col("latitude").alias("o_latitude"), "rule")
    k = known.select("city", "province", F.col("longitude").alias("k_longitude"), F.col("latitude").alias("k_latitude"))
    df = cities.join(k, ["city", "province"], "left").join(o, "city_id", "left")
    method = F.when(F.col("o_longitude").isNotNull(), "override").when(F.col("k_longitude").isNotNull(), "city_centre").otherwise("unresolved")
    return df.select("city_id", "city", "province", F.coalesce("o_longitude", "k_longitude").alias("longitude"), F.coalesce("o_latitude", "k_latitude").alias("latitude"), method.alias("method"), "rule", F.lit(version).alias("geo_version"))


def feasibility(snapshot: DataFrame, geo: DataFrame, horizons: list[int]) -> DataFrame:
    """Per product: horizons and cities with a point, the fewest and most cities of a horizon, points that aren't positive, cities without a place, and whether all is there."""
    per = snapshot.groupBy("product_id", "horizon").agg(F.count_distinct("city_id").alias("n"))
    span = per.groupBy("product_id").agg(F.count("*").alias("horizons"), F.min("n").alias("least_cities"), F.max("n").alias("most_cities"))
    placed = snapshot.join(geo.select("city_id", F.lit(True).alias("placed")), "city_id", "left")
    got = placed.groupBy("product_id").agg(F.count_distinct("city_id").alias("cities"), F.count_if(~(F.col("point") > 0)).alias("not_positive"), F.count_if(F.col("placed").isNull()).alias("without_place"))
    return got.join(span, "product_id").withColumn("feasible", (F.col("horizons") == len(horizons)) & (F.col("not_positive") == 0) & (F.col("without_place") == 0))


def flatten_release(documents: DataFrame, column: str = "value") -> DataFrame:
    """Rows of nested release documents ({"groups": [{product_id, horizon, release_status, ...}]}): one for each group, keys unique."""
    ddl = "groups array<struct<product_id:string,horizon:int,release_status:string,improvement:double>>"
    each = documents.select(F.explode(F.from_json(column, ddl)["groups"]).alias("g")).select("g.*")
    return contracts.assert_unique(each, ["product_id", "horizon"]).withColumn("route", F.when(F.col("release_status") == "baseline_fallback", "baseline").otherwise("model"))
