"""Common shocks and lead-lag edges over products and cities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandi.functions.scalar import split_of
from mandi.operators import cityday, metrics, shocks, tables, temporal
from mandi.sources import given, sinks

from .common import DAYS_SQL, city_days, layer, market_days, out, sql
from .landed import _HAV, GEO_SQL

Q, SQL = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


ANCHOR, BIN = "1995-01-02", 3


WEEK = 7


def _panel(spark, sf_dir, size: int, season) -> DataFrame:
    days = city_days(spark, sf_dir).filter("quality <> 'poor'").withColumn("city_id", F.lpad(F.col("city_id").cast("string"), 2, "0"))
    bins = shocks.binned_panel(days, ANCHOR, size, 1).withColumn("split", split_of(F.col("bin_start"), given.SPLITS))
    return shocks.shock_flags(shocks.loo_median(shocks.seasonal_adjust(bins, season), at_least=3))


@layer
def panel(spark, sf_dir) -> DataFrame:
    return _panel(spark, sf_dir, BIN, F.floor((F.dayofyear("bin_start") - 1) / 30))


@layer
def week_panel(spark, sf_dir) -> DataFrame:
    return _panel(spark, sf_dir, WEEK, F.weekofyear("bin_start").cast("long"))


PANEL_SQL = DAYS_SQL + """,
b0 AS (SELECT product_id, lpad(city_id::VARCHAR, 2, '0') AS city_id, DATE '1995-01-02' + ((date - DATE '1995-01-02') // 3 * 3)::INT AS bin_start, median(price) AS price, count(DISTINCT date) AS observed_days, avg(reliability) AS mean_reliability FROM city_day WHERE quality <> 'poor' GROUP BY ALL),
b1 AS (SELECT *, CASE WHEN bin_start - lag(bin_start) OVER w = 3 THEN ln(price / lag(price) OVER w) END AS log_return, (dayofyear(bin_start) - 1) // 30 AS season,
  CASE WHEN year(bin_start) < 2000 THEN 'train' WHEN year(bin_start) = 2000 THEN 'validation' ELSE 'final_test' END AS split FROM b0 WINDOW w AS (PARTITION BY product_id, city_id ORDER BY bin_start)),
own AS (SELECT product_id, city_id, season, count(*) AS n, median(log_return) AS m FROM b1 WHERE split = 'train' AND log_return IS NOT NULL GROUP BY 1, 2, 3),
prod AS (SELECT product_id, season, median(log_return) AS m FROM b1 WHERE split = 'train' AND log_return IS NOT NULL GROUP BY 1, 2),
b2 AS (SELECT b1.*, CASE WHEN own.n >= 3 THEN own.m ELSE prod.m END AS seasonal_return, log_return - CASE WHEN own.n >= 3 THEN own.m ELSE prod.m END AS adjusted_return FROM b1 LEFT JOIN own USING (product_id, city_id, season) LEFT JOIN prod USING (product_id, season)),
loo AS (SELECT a.product_id, a.city_id, a.bin_start, count(*) AS peers, median(b.adjusted_return) AS m FROM b2 a JOIN b2 b ON b.product_id = a.product_id AND b.bin_start = a.bin_start AND b.city_id <> a.city_id WHERE a.adjusted_return IS NOT NULL AND b.adjusted_return IS NOT NULL GROUP BY 1, 2, 3),
b3 AS (SELECT b2.*, coalesce(peers, 0) AS peers, CASE WHEN peers >= 3 THEN m END AS common_factor, adjusted_return - CASE WHEN peers >= 3 THEN m END AS residual FROM b2 LEFT JOIN loo USING (product_id, city_id, bin_start)),
lim AS (SELECT product_id, city_id, quantile_cont(residual, 0.95) AS shock_threshold FROM b3 WHERE split = 'train' AND residual IS NOT NULL GROUP BY 1, 2),
panel AS (SELECT b3.*, shock_threshold, coalesce(residual > shock_threshold, false) AS positive_shock FROM b3 LEFT JOIN lim USING (product_id, city_id))"""


@query(sql(PANEL_SQL, "SELECT product_id, city_id, bin_start, price, observed_days, mean_reliability, log_return, season, split, seasonal_return, adjusted_return, peers, common_factor, residual, shock_threshold, positive_shock FROM panel", "", "price mean_reliability log_return seasonal_return adjusted_return common_factor residual shock_threshold"))
def propagation_panel(spark, sf_dir):
    return out(panel(spark, sf_dir))


def _weekly(text: str) -> str:
    """The panel's SQL for bins of a week and seasons by week of year."""
    for a, b in (("// 3 * 3", "// 7 * 7"), ("OVER w = 3 THEN", "OVER w = 7 THEN"), ("(dayofyear(bin_start) - 1) // 30 AS season", "weekofyear(bin_start) AS season")):
        assert a in text
        text = text.replace(a, b)
    return text


WEEK_SQL = _weekly(PANEL_SQL)


@query(sql(WEEK_SQL, "SELECT product_id, city_id, bin_start, price, observed_days, mean_reliability, log_return, season, split, seasonal_return, adjusted_return, peers, common_factor, residual, shock_threshold, positive_shock FROM panel", "", "price mean_reliability log_return seasonal_return adjusted_return common_factor residual shock_threshold"))
def weekly_panel(spark, sf_dir):
    return out(week_panel(spark, sf_dir))


@query(sql(PANEL_SQL + ", t AS (SELECT product_id, bin_start, split, median(common_factor) AS common_factor, median(adjusted_return) AS median_return, count(*) FILTER (positive_shock) AS exposed, count(*) AS observed FROM panel GROUP BY 1, 2, 3)", "SELECT t.*, shock_limit, coalesce(common_factor > shock_limit, false) AS common_shock FROM t LEFT JOIN (SELECT product_id, quantile_cont(common_factor, 0.95) AS shock_limit FROM t WHERE split = 'train' GROUP BY 1) USING (product_id)", "", "common_factor median_return shock_limit"))
def shock_timeline(spark, sf_dir):
    return out(shocks.shock_timeline(panel(spark, sf_dir)).withColumnRenamed("limit", "shock_limit"))


@query(sql(PANEL_SQL + """, lagged AS (SELECT a.product_id, a.city_id, a.bin_start, b.residual AS residual_lag1, c.residual AS residual_lag2 FROM panel a LEFT JOIN panel b ON b.product_id = a.product_id AND b.city_id = a.city_id AND b.bin_start = a.bin_start - 3 LEFT JOIN panel c ON c.product_id = a.product_id AND c.city_id = a.city_id AND c.bin_start = a.bin_start - 6)""", "SELECT * FROM lagged", "", "residual_lag1 residual_lag2"))
def exact_lags(spark, sf_dir):
    return out(temporal.exact_lags(panel(spark, sf_dir), ["residual"], [1, 2], BIN).select("product_id", "city_id", "bin_start", "residual_lag1", "residual_lag2"))


@query(sql(PANEL_SQL + """, w AS (SELECT 'full' AS "window", * FROM panel UNION ALL SELECT split, * FROM panel),
g AS (SELECT "window", product_id, city_id, count(*) AS bins, count(*) FILTER (positive_shock) AS shocks, avg(positive_shock::INT) AS shock_rate,
  count(*) FILTER (common_factor IS NOT NULL AND adjusted_return IS NOT NULL) AS k, regr_slope(adjusted_return, common_factor) AS slope, corr(adjusted_return, common_factor) AS rho, stddev_samp(residual) AS volatility, avg(mean_reliability) AS mean_reliability, arg_max(price, bin_start) AS latest_price FROM w GROUP BY 1, 2, 3)""", 'SELECT "window", product_id, city_id, bins, shocks, shock_rate, CASE WHEN k >= 4 THEN slope END AS beta, CASE WHEN k >= 4 THEN rho END AS correlation, volatility, mean_reliability, latest_price FROM g', "", "shock_rate beta correlation volatility mean_reliability latest_price"))
def city_exposure(spark, sf_dir):
    windows = {"full": ["train", "validation", "final_test"], "train": ["train"], "validation": ["validation"], "final_test": ["final_test"]}
    return out(shocks.city_exposure(panel(spark, sf_dir), windows).drop("exposure_score", "exposure_rank"))


_WEEKS = "weeks AS (SELECT product_id, lpad(city_id::VARCHAR, 2, '0') AS city_id, count(DISTINCT (date - DATE '1995-01-02') // 7) AS n FROM city_day WHERE quality <> 'poor' AND year(DATE '1995-01-02' + ((date - DATE '1995-01-02') // 7 * 7)::INT) < 2000 GROUP BY 1, 2)"
ELIGIBLE_SQL = PANEL_SQL + ", " + _WEEKS + """,
eligible AS (SELECT product_id, city_id, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'final_test') AS final_test FROM panel SEMI JOIN (SELECT product_id, city_id FROM weeks WHERE n >= 40) USING (product_id, city_id) GROUP BY 1, 2 HAVING count(*) FILTER (split = 'train') >= 40 AND count(*) FILTER (split = 'validation') >= 5)"""


def eligible(spark, sf_dir) -> DataFrame:
    return shocks.eligible_series(panel(spark, sf_dir), week_panel(spark, sf_dir), {"train": 40, "validation": 5, "final_test": 0}, {"train": 40})


@query(sql(ELIGIBLE_SQL, "SELECT * FROM eligible"))
def eligible_series(spark, sf_dir):
    return out(eligible(spark, sf_dir))


def edges(spark, sf_dir) -> DataFrame:
    m = given.mapping(spark, sf_dir).filter("city_id IS NOT NULL").select(F.lpad(F.col("city_id").cast("string"), 2, "0").alias("city_id"), "province", "longitude", "latitude").distinct()
    cities = panel(spark, sf_dir).select("product_id", "city_id").distinct().join(m, "city_id")
    return shocks.candidate_edges(cities)


EDGES_SQL = PANEL_SQL + f""", {GEO_SQL},
cities AS (SELECT DISTINCT product_id, p.city_id, province, longitude, latitude FROM (SELECT DISTINCT product_id, city_id FROM panel) p JOIN (SELECT DISTINCT lpad(city_id::VARCHAR, 2, '0') AS city_id, province, longitude, latitude FROM mapping WHERE city_id IS NOT NULL) m USING (city_id)),
edges AS (SELECT *, row_number() OVER (PARTITION BY product_id, target_city_id ORDER BY same_province DESC, round(distance_km, 9), source_city_id) AS candidate_rank, count(*) OVER (PARTITION BY product_id, target_city_id) AS others FROM (SELECT a.product_id, a.city_id AS source_city_id, b.city_id AS target_city_id, a.province = b.province AS same_province, {_HAV} AS distance_km FROM cities a JOIN cities b ON a.product_id = b.product_id AND a.city_id <> b.city_id))"""


@query(sql(EDGES_SQL, "SELECT product_id, source_city_id, target_city_id, candidate_rank, same_province, distance_km FROM edges WHERE candidate_rank <= least(8, floor(others * 0.35))", "", "distance_km"))
def candidate_edges(spark, sf_dir):
    return out(edges(spark, sf_dir))


PAIRS_SQL = PANEL_SQL + ", pr AS (SELECT a.product_id, a.city_id AS a, b.city_id AS b, corr(a.adjusted_return, b.adjusted_return) AS c, count(a.adjusted_return + b.adjusted_return) AS n, corr(a.residual, b.residual) AS d, count(a.residual + b.residual) AS m FROM panel a JOIN panel b ON a.product_id = b.product_id AND a.bin_start = b.bin_start AND a.city_id < b.city_id GROUP BY 1, 2, 3)"


@query(sql(PAIRS_SQL, "SELECT product_id, count(abs(c)) FILTER (n >= 10) AS pairs_adjusted_return, avg(abs(c)) FILTER (n >= 10) AS mean_adjusted_return, median(abs(c)) FILTER (n >= 10) AS median_adjusted_return, count(abs(d)) FILTER (m >= 10) AS pairs_residual, avg(abs(d)) FILTER (m >= 10) AS mean_residual, median(abs(d)) FILTER (m >= 10) AS median_residual FROM pr GROUP BY 1", "", "mean_adjusted_return median_adjusted_return mean_residual median_residual"))
def pairwise_corr(spark, sf_dir):
    """Raw and factor-adjusted co-movement."""
    return out(shocks.pairwise_corr(panel(spark, sf_dir), ["adjusted_return", "residual"], 10))


@query(sql(PAIRS_SQL, "SELECT product_id, a, b, n, m, CASE WHEN n >= 10 THEN c END AS rho, CASE WHEN m >= 10 THEN d END AS rho_residual FROM pr WHERE n > 0 OR m > 0", "", "rho rho_residual", 5))
def city_pairs(spark, sf_dir):
    """Every pair's correlations."""
    got = shocks.correlations(shocks.gram(panel(spark, sf_dir), ["adjusted_return", "residual"]), ["adjusted_return", "residual"])
    n, m = F.col("n_adjusted_return"), F.col("n_residual")
    return out(got.select("product_id", "a", "b", n.alias("n"), m.alias("m"), F.when(n >= 10, F.col("rho_adjusted_return")).alias("rho"), F.when(m >= 10, F.col("rho_residual")).alias("rho_residual")), 5)


@query(sql(PANEL_SQL + ", p AS (SELECT product_id, city_id, round(stddev_samp(residual) / 10, 9) AS p_value FROM panel GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY p_value NULLS LAST, city_id) AS k, count(p_value) OVER (PARTITION BY product_id) AS n FROM p), q AS (SELECT *, least(1, min(p_value * n / k) OVER (PARTITION BY product_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM r WHERE p_value IS NOT NULL)", "SELECT p.product_id, p.city_id, q.q_value, coalesce(q.q_value <= 0.05, false) AS reject FROM p LEFT JOIN q USING (product_id, city_id)", "", "q_value"))
def benjamini_hochberg(spark, sf_dir):
    p = panel(spark, sf_dir).groupBy("product_id", "city_id").agg(F.round(F.stddev_samp("residual") / 10, 9).alias("p_value"))
    return out(metrics.benjamini_hochberg(p, ["product_id"], key=["city_id"]).select("product_id", "city_id", "q_value", "reject"))


LAGS, WEEK_LAGS = [1, 2, 3, 4], [1, 2]
FEW = {"least_fit": 40, "least_test": 5}  # the given tables are shorter


FOLLOWS = {"ASIA": "AMERICA", "AFRICA": "EUROPE"}


@layer
def basket_days(spark, sf_dir) -> DataFrame:
    """Days of two baskets (all products of a half of the markets) by region: a row for each basket, region and day, from all market-days once."""
    quotes = market_days(spark, sf_dir).withColumns({"product_id": F.concat(F.lit("basket "), (F.col("market_id") % 2).cast("string")), "city_id": F.col("province")})
    return cityday.city_day(quotes)


def coupled_days(spark, sf_dir) -> DataFrame:
    """Days of two baskets (all products of a half of the markets) by region, in which two regions also follow another's price of a bin before.

    Baskets have a price on almost every day.  Unit prices of the given tables move on their own, so no gate would ever open: the coupling gives the edge models
    something that is there to find, beside the pairs in which it is not.  A follower's days after a bin without leader go.
    """
    days = basket_days(spark, sf_dir).filter("quality <> 'poor'").withColumn("bin", F.floor(F.datediff("date", F.lit(ANCHOR).cast("date")) / BIN))
    follower = F.create_map(*(F.lit(x) for f, leader in FOLLOWS.items() for x in (leader, f)))
    lead = days.groupBy("product_id", F.try_element_at(follower, F.col("city_id")).alias("city_id"), (F.col("bin") + 1).alias("bin")).agg(F.percentile("price", F.lit(0.5)).alias("lead")).filter("city_id IS NOT NULL")
    got = days.join(lead, ["product_id", "city_id", "bin"], "left").filter(F.col("lead").isNotNull() | ~F.col("city_id").isin(*FOLLOWS))
    return got.withColumn("price", F.col("price") * F.pow(F.coalesce("lead", F.lit(1.0)), F.lit(0.8))).drop("lead", "bin")


def _region_panel(spark, sf_dir, size: int, season) -> DataFrame:
    days = coupled_days(spark, sf_dir)
    bins = shocks.binned_panel(days, ANCHOR, size, 1).withColumn("split", split_of(F.col("bin_start"), given.SPLITS))
    return shocks.shock_flags(shocks.loo_median(shocks.seasonal_adjust(bins, season), at_least=3))


@layer
def region_panel(spark, sf_dir) -> DataFrame:
    """The panel over regions: series with a price in most bins, as lead-lag models need."""
    return _region_panel(spark, sf_dir, BIN, F.floor((F.dayofyear("bin_start") - 1) / 30))


@layer
def region_weeks(spark, sf_dir) -> DataFrame:
    return _region_panel(spark, sf_dir, WEEK, F.weekofyear("bin_start").cast("long"))


def region_edges(spark, sf_dir) -> DataFrame:
    """Candidate edges between regions: so few that each target takes all others."""
    m = given.mapping(spark, sf_dir).filter("city_id IS NOT NULL").groupBy(F.col("province").alias("city_id")).agg(F.first("province").alias("province"), F.avg("longitude").alias("longitude"), F.avg("latitude").alias("latitude"))
    return shocks.candidate_edges(region_panel(spark, sf_dir).select("product_id", "city_id").distinct().join(m, "city_id"), share=1.0)


_KEY = ["target_city_id", "source_city_id"]


def _frame(spark, sf_dir, of=region_panel, lags: list[int] = LAGS, size: int = BIN) -> tuple[DataFrame, list[str], list[str]]:
    """Rows of all candidate edges, the target's own and factor lags, and the source's lags."""
    lagged = temporal.exact_lags(of(spark, sf_dir), ["residual", "common_factor"], lags, size)
    own, source = [f"{c}_lag{k}" for c in ("residual", "common_factor") for k in lags], [f"residual_lag{k}" for k in lags]
    return shocks.edge_frame(lagged, region_edges(spark, sf_dir), own, source, "residual"), own, source


@layer
def tested_edges(spark, sf_dir) -> DataFrame:
    frame, own, source = _frame(spark, sf_dir)
    tested = shocks.edge_models(frame.filter("split <> 'final_test'"), own, source, "residual", **FEW, bin_days=BIN)
    return shocks.validation_gate(metrics.benjamini_hochberg(tested, ["product_id"], key=_KEY))


@layer
def stable_edges(spark, sf_dir) -> DataFrame:
    frame, own, source = _frame(spark, sf_dir)
    chosen = tested_edges(spark, sf_dir).filter("validated")
    train = frame.filter("split = 'train'").join(chosen.select(*shocks.EDGE), shocks.EDGE, "left_semi")
    weekly, own_w, source_w = _frame(spark, sf_dir, region_weeks, WEEK_LAGS, WEEK)
    weekly = shocks.edge_models(weekly.filter("split <> 'final_test'").join(chosen.select(*shocks.EDGE), shocks.EDGE, "left_semi"), own_w, source_w, "residual", **FEW, bin_days=WEEK)
    return shocks.stability_gate(chosen, shocks.block_bootstrap(train, own, source, "residual"), weekly)


@query()
def edge_models(spark, sf_dir):
    """Joint F tests and test errors of all candidate edges, false discoveries held within a product."""
    return out(tested_edges(spark, sf_dir))


@query()
def edge_funnel(spark, sf_dir):
    return out(shocks.funnel(tested_edges(spark, sf_dir)))


@query()
def edge_bootstrap(spark, sf_dir):
    """Bootstrap, halves and weekly diagnostic of validated edges."""
    return out(stable_edges(spark, sf_dir))


@layer
def final_edges(spark, sf_dir) -> DataFrame:
    frame, own, source = _frame(spark, sf_dir)
    stable = stable_edges(spark, sf_dir)
    frame = frame.join(stable.filter("stable").select(*shocks.EDGE), shocks.EDGE, "left_semi")
    return shocks.frozen_edges_final(stable, shocks.edge_models(frame, own, source, "residual", ("train", "validation"), "final_test", **FEW, bin_days=BIN))


@query()
def frozen_edges(spark, sf_dir):
    """Stable edges, refitted on train and validation, on the final split."""
    return out(final_edges(spark, sf_dir))


@query()
def network_release(spark, sf_dir):
    return out(shocks.release_decision(final_edges(spark, sf_dir), network_tests(spark, sf_dir)))


FEASIBLE_SQL = EDGES_SQL.replace("WITH ", "") + """,
chosen AS (SELECT * FROM edges WHERE candidate_rank <= least(8, floor(others * 0.35))),
""" + ELIGIBLE_SQL[len(PANEL_SQL) + 2:] + """,
feasible1 AS (SELECT product_id, count(*) AS eligible_cities FROM eligible GROUP BY 1),
feasible2 AS (SELECT product_id, count(*) AS candidate_edges, median(distance_km) AS median_distance_km, avg(same_province::INT) AS same_province_share FROM chosen GROUP BY 1),
feasible3 AS (SELECT product_id, min(n) AS least_sources, max(n) AS most_sources FROM (SELECT product_id, target_city_id, count(*) AS n FROM chosen GROUP BY 1, 2) GROUP BY 1),
feasible4 AS (SELECT product_id, count(*) FILTER (split = 'train') AS shocks_train, count(*) FILTER (split = 'validation') AS shocks_validation, count(*) FILTER (split = 'final_test') AS shocks_final_test FROM panel WHERE positive_shock GROUP BY 1)"""


@query(sql(FEASIBLE_SQL, "SELECT product_id, eligible_cities, coalesce(candidate_edges, 0) AS candidate_edges, median_distance_km, same_province_share, coalesce(least_sources, 0) AS least_sources, coalesce(most_sources, 0) AS most_sources, coalesce(shocks_train, 0) AS shocks_train, coalesce(shocks_validation, 0) AS shocks_validation, coalesce(shocks_final_test, 0) AS shocks_final_test, eligible_cities * (eligible_cities - 1) AS possible_edges, CASE WHEN eligible_cities > 1 THEN coalesce(candidate_edges, 0) / (eligible_cities * (eligible_cities - 1)) ELSE 0 END AS density FROM feasible1 LEFT JOIN feasible2 USING (product_id) LEFT JOIN feasible3 USING (product_id) LEFT JOIN feasible4 USING (product_id)", "", "median_distance_km same_province_share density"))
def shock_feasibility(spark, sf_dir):
    """Density is against the eligible cities; candidates are between all cities of a product."""
    return out(shocks.feasibility(eligible(spark, sf_dir), edges(spark, sf_dir), panel(spark, sf_dir), list(given.SPLITS)))


@query()
def series_ols(spark, sf_dir):
    lagged = temporal.exact_lags(panel(spark, sf_dir), ["residual", "common_factor"], LAGS, BIN)
    return out(shocks.series_ols(lagged, [f"{c}_lag{k}" for c in ("residual", "common_factor") for k in LAGS], "residual", 20, 5))


@layer
def network_tests(spark, sf_dir) -> DataFrame:
    """Edges with contemporaneous correlation tests, raw and residual, false discoveries held within a product."""
    p = panel(spark, sf_dir)  # both tests over the bins in which both cities have a residual
    both = shocks.gram(p.withColumn("adjusted", F.when(F.col("residual").isNotNull(), F.col("adjusted_return"))), ["adjusted", "residual"])
    tests = shocks.correlation_tests(edges(spark, sf_dir), both, {"raw": "adjusted", "residual": "residual"})
    raw = metrics.benjamini_hochberg(tests, ["product_id"], key=_KEY, p="p_raw").withColumnsRenamed({"q_value": "q_raw", "reject": "reject_raw"})
    return metrics.benjamini_hochberg(raw, ["product_id"], key=_KEY, p="p_residual").withColumnsRenamed({"q_value": "q_residual", "reject": "reject_residual"})


# The tail of t for whole degrees of freedom v is a finite series in cos(atan(t / sqrt(v))).
T_TAIL = """CASE WHEN v % 2 = 0 THEN 1 - sin(th) * coalesce(list_sum(list_transform(range(0, v // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(th), 2 * k))), 0)
  ELSE 1 - 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos(th), 2 * k + 1))), 0)) END"""


def _bh(name: str) -> str:
    return f"""bh_{name}0 AS (SELECT *, atan(abs(rho_{name}) * sqrt(v / greatest(1 - rho_{name} * rho_{name}, 1e-12)) / sqrt(v)) AS th FROM tested WHERE v > 0 AND rho_{name} IS NOT NULL),
bh_{name}1 AS (SELECT *, {T_TAIL} AS p FROM bh_{name}0),
bh_{name}2 AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY p, target_city_id, source_city_id) AS k, count(*) OVER (PARTITION BY product_id) AS m FROM bh_{name}1),
bh_{name} AS (SELECT *, least(1, min(p * m / k) OVER (PARTITION BY product_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM bh_{name}2)"""


NETWORK_SQL = EDGES_SQL + """,
pairs_ AS (SELECT a.product_id, a.city_id AS a, b.city_id AS b, corr(a.adjusted_return, b.adjusted_return) AS rho_raw, corr(a.residual, b.residual) AS rho_residual, count(*)::INT - 2 AS v FROM panel a JOIN panel b ON a.product_id = b.product_id AND a.bin_start = b.bin_start AND a.city_id < b.city_id WHERE a.residual IS NOT NULL AND b.residual IS NOT NULL GROUP BY 1, 2, 3),
tested AS (SELECT e.product_id, source_city_id, target_city_id, rho_raw, rho_residual, v FROM edges e JOIN pairs_ x ON x.product_id = e.product_id AND x.a = least(source_city_id, target_city_id) AND x.b = greatest(source_city_id, target_city_id) WHERE candidate_rank <= least(8, floor(others * 0.35))),
""" + _bh("raw") + ",\n" + _bh("residual")


@query(sql(NETWORK_SQL, "SELECT product_id, count(*) AS edges, (SELECT count(*) FROM bh_raw r WHERE r.product_id = t.product_id AND q <= 0.05) AS raw, (SELECT count(*) FROM bh_residual r WHERE r.product_id = t.product_id AND q <= 0.05) AS residual FROM tested t GROUP BY 1"))
def correlation_network(spark, sf_dir):
    return out(network_tests(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("edges"), F.count_if("reject_raw").alias("raw"), F.count_if("reject_residual").alias("residual")))


EXPOSURE_SQL = PANEL_SQL + """,
g AS (SELECT product_id, city_id, count(*) AS bins, count(*) FILTER (positive_shock) AS shocks, avg(positive_shock::INT) AS shock_rate, count(*) FILTER (common_factor IS NOT NULL AND adjusted_return IS NOT NULL) AS k, regr_slope(adjusted_return, common_factor) AS slope, corr(adjusted_return, common_factor) AS rho, stddev_samp(residual) AS volatility, avg(mean_reliability) AS mean_reliability, arg_max(price, bin_start) AS latest_price FROM panel GROUP BY 1, 2),
g1 AS (SELECT *, CASE WHEN k >= 4 THEN slope END AS beta, CASE WHEN k >= 4 THEN rho END AS correlation, CASE WHEN k >= 4 AND slope IS NOT NULL THEN greatest(slope, 0) END AS held FROM g),
g2 AS (SELECT *, (rank() OVER (PARTITION BY product_id ORDER BY shock_rate NULLS LAST) + (count(*) OVER (PARTITION BY product_id, shock_rate) - 1) / 2) / count(shock_rate) OVER (PARTITION BY product_id) AS r1,
  CASE WHEN held IS NOT NULL THEN (rank() OVER (PARTITION BY product_id ORDER BY held NULLS LAST) + (count(*) OVER (PARTITION BY product_id, held) - 1) / 2) / count(held) OVER (PARTITION BY product_id) END AS r2,
  CASE WHEN volatility IS NOT NULL THEN (rank() OVER (PARTITION BY product_id ORDER BY volatility NULLS LAST) + (count(*) OVER (PARTITION BY product_id, volatility) - 1) / 2) / count(volatility) OVER (PARTITION BY product_id) END AS r3 FROM g1),
g3 AS (SELECT *, 100 * (0.45::DOUBLE * r1 + 0.35::DOUBLE * r2 + 0.2::DOUBLE * r3) AS exposure_score FROM g2)"""


@query(sql(EXPOSURE_SQL, "SELECT 'full' AS \"window\", product_id, city_id, bins, shocks, shock_rate, beta, correlation, volatility, mean_reliability, latest_price, exposure_score, row_number() OVER (PARTITION BY product_id ORDER BY round(exposure_score, 9) DESC NULLS LAST, city_id) AS exposure_rank FROM g3", "", "shock_rate beta correlation volatility mean_reliability latest_price exposure_score"))
def exposure_rank(spark, sf_dir):
    return out(shocks.city_exposure(panel(spark, sf_dir), {"full": ["train", "validation", "final_test"]}))


TIMELINE_SQL = """
t AS (SELECT product_id, bin_start, split, median(common_factor) AS common_factor, median(adjusted_return) AS median_return, count(*) FILTER (positive_shock) AS exposed, count(*) AS observed FROM panel GROUP BY 1, 2, 3),
line AS (SELECT t.*, shock_limit, coalesce(common_factor > shock_limit, false) AS common_shock FROM t LEFT JOIN (SELECT product_id, quantile_cont(common_factor, 0.95) AS shock_limit FROM t WHERE split = 'train' GROUP BY 1) USING (product_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY round(exposure_score, 9) DESC NULLS LAST, city_id) AS exposure_rank FROM g3)"""
FULL = {"full": ["train", "validation", "final_test"]}


@query(sql(EXPOSURE_SQL + "," + TIMELINE_SQL, "SELECT 'full' AS \"window\", r.product_id, city_id, bins, shocks, shock_rate, beta, correlation, volatility, mean_reliability, latest_price, exposure_score, exposure_rank, common_shocks, peak_factor, peak_start FROM ranked r LEFT JOIN (SELECT product_id, count(*) FILTER (common_shock) AS common_shocks, max(common_factor) AS peak_factor, arg_max(bin_start, common_factor) AS peak_start FROM line GROUP BY 1) USING (product_id) WHERE exposure_rank <= 10", "", "shock_rate beta correlation volatility mean_reliability latest_price exposure_score peak_factor"))
def exposure_view(spark, sf_dir):
    """Each product's ten most exposed cities of the whole window, with its common shocks and the highest factor."""
    cities = shocks.city_exposure(panel(spark, sf_dir), FULL)
    return out(shocks.exposure_view(cities, shocks.shock_timeline(panel(spark, sf_dir))))


def propagation_documents(spark, sf_dir) -> DataFrame:
    """Lines of a document for each product: its cities, common shocks and limit, its timeline, its cities' exposure."""
    line = shocks.shock_timeline(panel(spark, sf_dir)).withColumnRenamed("limit", "shock_limit")
    exposure = shocks.city_exposure(panel(spark, sf_dir), FULL)
    cities = exposure.groupBy("product_id").agg(F.count_distinct("city_id").alias("city_count"))
    heads = line.groupBy("product_id").agg(F.count_if("common_shock").alias("common_shock_bins"), F.max("shock_limit").alias("shock_limit")).join(cities, "product_id")
    heads = heads.select("product_id", F.lit(True).alias("historical_only"), F.lit("common_shock_only").alias("release_status"), "city_count", "common_shock_bins", "shock_limit")
    return sinks.documents(heads, ["product_id"], {"timeline": (line.drop("shock_limit"), ["bin_start"]), "city_exposures": (exposure, ["window", "exposure_rank"])})


@query(sql(EXPOSURE_SQL + "," + TIMELINE_SQL + """,
tl AS (SELECT product_id, count(*) AS timeline_rows, min(bin_start) AS first_bin, max(bin_start) AS last_bin, count(*) FILTER (common_shock) AS common_shock_bins, max(shock_limit) AS shock_limit, sum(common_factor) AS factor_sum, sum(exposed) AS exposed FROM line GROUP BY 1),
ex AS (SELECT product_id, count(*) AS exposure_rows, count(DISTINCT city_id) AS city_count, sum(exposure_score) AS score_sum, arg_min(city_id, exposure_rank) AS most_exposed FROM ranked GROUP BY 1)""", "SELECT *, 'common_shock_only' AS release_status, true AS in_order FROM tl JOIN ex USING (product_id)", "exposed", "shock_limit factor_sum score_sum", 4))
def propagation_export(spark, sf_dir):
    """The propagation mart: documents written line by line, read back, and summed up."""
    path = f"{tables.shared_dir(spark)}/mandi-propagation-{uuid.uuid4().hex}"
    sinks.write_documents(propagation_documents(spark, sf_dir), path, ["product_id"])
    line = "bin_start: date, common_factor: double, exposed: bigint, common_shock: boolean"
    city = "city_id: string, exposure_rank: bigint, exposure_score: double"
    docs = sinks.read_documents(spark, path, f"product_id string, release_status string, city_count long, common_shock_bins long, shock_limit double, timeline array<struct<{line}>>, city_exposures array<struct<{city}>>")
    total = lambda a, c: F.aggregate(F.transform(a, lambda x: F.coalesce(x[c].cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    t, e = F.col("timeline"), F.col("city_exposures")
    ordered = (F.array_sort(t["bin_start"]) == t["bin_start"]) & (e["exposure_rank"] == F.sequence(F.lit(1).cast("long"), F.size(e).cast("long")))
    return out(docs.select(
        "product_id", F.size(t).alias("timeline_rows"), F.array_min(t["bin_start"]).alias("first_bin"), F.array_max(t["bin_start"]).alias("last_bin"), "common_shock_bins", "shock_limit", total(t, "common_factor").alias("factor_sum"), total(t, "exposed").cast("long").alias("exposed"),
        F.size(e).alias("exposure_rows"), "city_count", total(e, "exposure_score").alias("score_sum"), e[0]["city_id"].alias("most_exposed"), "release_status", ordered.alias("in_order"),
    ), 4)
