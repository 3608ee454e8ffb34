"""Small hand-computed cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mandi.functions.scalar import haversine
from mandi.operators import alerts, cityday, contracts, coverage, forecast, landed, mapping, metrics, quality, shocks, temporal
from mandi.plans import common, measure
from mandi.sources import files, given, sinks

D = dt.date


def near(a, b, tol=1e-9):
    return abs(a - b) <= tol


def test_point_metrics(spark):
    df = spark.createDataFrame([("m", 1.0, 1.0), ("m", 2.0, 1.0), ("m", 3.0, 5.0)], "method string, actual double, predicted double")
    r = metrics.scorecard(df, [[]]).first()
    assert near(r.wape, 0.5) and near(r.mae, 1) and near(r.smape, (0 + 2 / 3 + 1 / 2) / 3)


def test_conformal_order_statistic(spark):
    df = spark.createDataFrame([("p", 7, float(i)) for i in range(1, 11)], "product_id string, horizon int, residual double")
    assert forecast.conformal_quantiles(df, [[]]).first().quantile == 9


def test_average_precision_and_threshold(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("a", 1, 0.7), ("a", 0, 0.1)], "g string, label int, score double")
    assert near(metrics.average_precision(metrics.pr_curve(df, ["g"]), ["g"]).first().average_precision, (1 + 2 / 3) / 2)
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("a", 1, 0.7), ("a", 0, 0.2), ("a", 0, 0.1)], "g string, label int, score double")
    r = metrics.threshold_at_fpr(metrics.pr_curve(df, ["g"]), ["g"], 1 / 3).first()
    assert (r.recall, r.tp, r.fp) == (1, 2, 1)


def test_haversine(spark):
    km = spark.range(1).select(haversine(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("km")).first().km
    assert near(km, 111.195, 1e-3)


def test_landed_cost(spark):
    s = landed.Scenario(quantity_kg=100, transport_cost=0, loss_rate=0.1, risk_aversion=0.5)
    df = spark.createDataFrame([("p", 7, "a", "t", 4.0, 0.8, 1.0, 0.0, 0.0, 0.0, 0.0)], "product_id string, horizon int, city_id string, target_city string, point double, reliability double, uncertainty double, longitude double, latitude double, target_longitude double, target_latitude double")
    r = landed.costs(df, s).first()
    assert near(r.multiplier, 1.2) and near(r.risk_penalty, 0.6) and near(r.unit_cost, 4.6 / 0.9) and near(r.total_cost, 460 / 0.9)
    for bad in ({"loss_rate": 1.0}, {"quantity_kg": 0}, {"least_reliability": 2}, {"most_multiplier": 0.5}, {"transport_cost": -1}):
        with pytest.raises(ValueError):
            landed.Scenario(**bad)


def test_sources_are_near_by_road(spark):
    """A source whose straight line is below the limit and whose road is above; limits of parameters; released bounds; nothing forecast."""
    degree = 6371.0088 * math.pi / 180
    rows = [("p", 7, c, 9, 10.0, 0.9, 1.0, lon, 0.0, 0.0, 0.0) for c, lon in ((1, 1000 / degree), (2, 1150 / degree), (3, 1250 / degree), (9, 0.0))]
    pairs = spark.createDataFrame(rows, "product_id string, horizon int, city_id int, target_city int, point double, reliability double, uncertainty double, longitude double, latitude double, target_longitude double, target_latitude double")
    s = landed.Scenario(max_distance_km=1400.0, road_factor=1.25, transport_cost=0.001)
    costed = landed.costs(pairs, s)
    assert {r.city_id: near(r.road_km, 1.25 * r.distance_km) for r in costed.collect()} == dict.fromkeys((1, 2, 3, 9), True)
    assert [r.city_id for r in landed.rank_sources(costed, s).collect()] == [1]
    asked = spark.createDataFrame([("p", 7, 9), ("p", 28, 9)], "product_id string, horizon int, target_city int")
    got = {r.horizon: r for r in landed.funnel(costed, s, asked=asked).collect()}
    assert (got[7].sources, got[7].near, got[7].candidates, got[7].status) == (4, 2, 1, "ok")
    assert (got[28].sources, got[28].candidates, got[28].status) == (0, 0, "no_product_horizon_data")
    for wrong in ({"road_factor": 0.99}, {"road_factor": float("nan")}, {"most_multiplier": 0.5}):
        with pytest.raises(ValueError):
            landed.Scenario(**wrong)
    bounds = spark.createDataFrame([(10.0, 12.0, 0.5), (10.0, 9.0, 0.5), (10.0, None, 0.5)], "point double, p90 double, q double")
    got = [r.u for r in bounds.select(landed.base_uncertainty(F.col("point"), F.col("p90"), F.col("q")).alias("u")).collect()]
    assert got[:2] == [2.0, 0.0] and near(got[2], 10 * (math.exp(0.5) - 1))


def test_exact_lag_does_not_bridge_gaps(spark):
    df = spark.createDataFrame([("p", "c", D(2020, 1, 1), 1.0), ("p", "c", D(2020, 1, 7), 2.0), ("p", "c", D(2020, 1, 10), 3.0)], "product_id string, city_id string, bin_start date, x double")
    got = {r.bin_start.day: r.x_lag1 for r in temporal.exact_lags(df, ["x"], [1], 3).collect()}
    assert got == {1: None, 7: None, 10: 2.0}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 1, 0.04), ("a", 2, 0.001), ("a", 3, 0.02), ("a", 4, None)], "g string, k int, p_value double")
    got = sorted((r.p_value, r.q_value) for r in metrics.benjamini_hochberg(df, ["g"], key=["k"]).collect() if r.p_value)
    assert [round(q, 6) for _, q in got] == [0.003, 0.03, 0.04]


def test_dedup_keeps_first_and_those_after_three_weeks(spark):
    rows = [("p", "c", D(2020, 1, 1) + dt.timedelta(d), d in (1, 5, 30, 40)) for d in range(50)] + [("p", "d", D(2020, 1, 1), False)]
    df = spark.createDataFrame(rows, "product_id string, city_id string, origin_date date, raw boolean")
    got = [(r.origin_date - D(2020, 1, 1)).days for r in alerts.dedup_events(df, "raw", "event").filter("event").collect()]
    assert sorted(got) == [1, 30]


def test_tails_of_f_and_t():
    assert near(shocks.t_tail(2.776445, 4), 0.05, 1e-5) and near(shocks.f_tail(4.964603, 1, 10), 0.05, 1e-5)


def test_loo_median(spark):
    rows = [("p", str(i), D(2020, 1, 1), v) for i, v in enumerate([1.0, 2.0, 2.0, 5.0, None])]
    df = spark.createDataFrame(rows, "product_id string, city_id string, bin_start date, adjusted_return double")
    got = {r.city_id: (r.common_factor, r.peers) for r in shocks.loo_median(df, at_least=3).collect()}
    assert got == {"0": (2.0, 3), "1": (2.0, 3), "2": (2.0, 3), "3": (2.0, 3), "4": (None, 0)}
    assert {r.common_factor for r in shocks.loo_median(df, at_least=4).collect()} == {None}


def test_quality_flags(spark):
    days = [1, 2, 3, 3, 5]
    rows = [("p", 1, D(2020, 1, d), 2.0, 2.0, 0.0, i) for i, d in enumerate(days)] + [("p", 2, D(2020, 1, 1), -1.0, None, None, 0), ("p", 2, D(2020, 1, 2), float("nan"), 1.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "product_id string, market_id int, date date, price double, previous_price double, reported_change_pct double, trace int")
    got = {(r.market_id, r.trace): r for r in quality.add_quality(df, stale_after=2).collect()}
    assert [got[1, i].zero_run for i in range(5)] == [0, 1, 2, 0, 0]
    assert [got[1, i].duplicate for i in range(5)] == [False, False, True, True, False]
    assert got[1, 2].stale and not got[1, 3].stale and got[1, 0].change_consistent
    assert [got[2, i].invalid_reason for i in range(2)] == ["not_positive", "missing"] and got[2, 1].days_since_valid is None


def test_trimmed_mean_cuts_from_ten_markets(spark):
    df = spark.createDataFrame([("p", 1, "x", m, D(2020, 1, 1), float(m if m < 10 else 1000), 1, False, False, 1.0, False) for m in range(1, 11)], "product_id string, city_id int, province string, market_id int, date date, price double, source_rows long, stale boolean, outlier boolean, confidence double, duplicate boolean")
    r = cityday.city_day(df).first()
    assert near(r.trimmed_mean_price, sum(range(2, 10)) / 8) and near(r.price, 5.5) and r.markets == 10 and near(r.reliability, 1.0) and r.quality == "good"


def test_coverage_of_an_empty_pair(spark):
    grid = spark.createDataFrame([("p", 1)], "product_id string, city_id int")
    days = spark.createDataFrame([], "product_id string, city_id int, date date, markets long, stale_share double, outlier_share double, duplicate_share double, reliability double, quality string")
    r = coverage.assign_tier(coverage.coverage_metrics(days, grid, "2020-01-01", "2020-12-31")).first()
    assert (r.valid_days, r.leading_gap, r.trailing_gap, r.longest_gap, r.coverage_score, r.tier) == (0, 366, 366, 366, 0.0, "C")
    assert r.tier_reason.startswith("tier_a_failed:valid_days,active_span_coverage,") and ";tier_b_failed:valid_days," in r.tier_reason


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError):
        contracts.assert_unique(df, ["k"])
    contracts.assert_unique(df, ["k", "v"])
    with pytest.raises(ValueError):
        contracts.assert_splits(df.withColumnRenamed("v", "split"), {"a", "b"})
    with pytest.raises(ValueError):
        contracts.assert_schema(df, spark.range(1).schema)
    with pytest.raises(ValueError):
        contracts.joined_once(df, spark.createDataFrame([(1, 2)], "k int, w int"), ["k"])
    diff = {r.k: (r.difference, r.columns) for r in contracts.table_diff(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()}
    assert diff == {1: ("removed", ""), 2: ("changed", "v"), 3: ("added", "")}


def test_quote_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿raw_date,raw_index,raw_province,raw_market,raw_price,raw_previous_price,raw_change\n2020-01-02,1,X,M,2.5,2.0,25%\n2020-01-03,x,,M,n/a,2.5,-\n", encoding="utf-8")
    products = spark.createDataFrame([("a.csv", "p1")], "source_file string, product_id string")
    raw = files.read_quotes(spark, str(tmp_path / "a.csv"), products)
    parsed = files.parse_quotes(raw)
    rows = sorted(parsed.collect(), key=lambda r: r.row_in_file)
    assert rows[0].reported_change_pct == 25.0 and rows[0].product_id == "p1" and rows[1].raw_province == "" and rows[1].price is None
    with pytest.raises(ValueError):
        files.assert_parsed(parsed)
    with pytest.raises(ValueError, match="without a product"):
        files.read_quotes(spark, str(tmp_path / "a.csv"), products.filter("source_file <> 'a.csv'"))
    products = products.union(spark.createDataFrame([("b.csv", "p2")], products.schema))
    (tmp_path / "b.csv").write_text("raw_date,other\n2020-01-02,1\n")
    with pytest.raises(Exception):
        files.read_quotes(spark, str(tmp_path / "b.csv"), products).collect()


def test_lines_of_split_files_are_numbered_where_they_lie(spark, tmp_path, monkeypatch):
    """A file of many splits, files of one name in two folders, and a file without lines: numbers follow the file, and no line is dealt or sorted."""
    header = ",".join(files.RAW_COLUMNS) + "\n"
    line = lambda f, i: f"2020-01-02,{i},{f},M,2.5,2.0,25%\n"
    for f, n in (("x/a.csv", 3000), ("y/b.csv", 700), ("x/same.csv", 5), ("y/same.csv", 4), ("y/none.csv", 0)):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text(header + "".join(line(f, i) for i in range(1, n + 1)))
    products = spark.createDataFrame([(f, f"p-{f}") for f in ("a.csv", "b.csv", "same.csv", "none.csv")], "source_file string, product_id string")
    monkeypatch.setattr(files.tables, "numbered", lambda *_: pytest.fail("lines are sorted"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = files.read_quotes(spark, str(tmp_path / "*"), products)
        got = raw.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert {*raw.columns} == {*files.RAW_COLUMNS, "source_file", "row_in_file", "product_id"} and len(got) == 3709
    assert all(r.row_in_file == int(r.raw_index) and r.product_id == f"p-{r.source_file}" for r in got if r.source_file in ("a.csv", "b.csv"))
    same = sorted((r.row_in_file, r.raw_province, int(r.raw_index)) for r in got if r.source_file == "same.csv")
    assert [n for n, _, _ in same] == list(range(1, 10)) and all([i for _, f, i in same if f == g] == list(range(1, k + 1)) for g, k in (("x/same.csv", 5), ("y/same.csv", 4)))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, 2.0), ("q", 2, 3.0)], "product_id string, city_id int, price double")
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_table(df, str(tmp_path / "u"), files=3)
    assert sinks.table_fingerprint(df).first() == sinks.table_fingerprint(df.orderBy(F.desc("city_id"))).first()
    back = spark.read.parquet(str(tmp_path / "t")).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_product_json(df, str(tmp_path / "j"), "product_id", records=["price"], order=["city_id"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_queries_and_sql_agree_on_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["product_id", "month", "city_id", "province", "tier", "median_price", "valid_days", "rank"]


def test_mapping_rules_of_every_row(spark):
    """Each row against the rules written out; market 143 breaks two, as its status doesn't exist and it has a city."""
    rows = [(143, 3, "x", "other", 80.0, "v1"), (110, 1, "x", "unmapped_new_city", 80.0, "v1"), (130, None, "x", "other", 80.0, "v1"), (1430, 1, "x", "other", 80.0, "v1"), (1, 1, None, "mapped_existing_city", 80.0, "v1"), (2, 2, "x", "mapped_existing_city", 80.0, "v1"), (3, None, "x", "unmapped_unknown", 1.0, "v1")]
    m = spark.createDataFrame(rows, "market_id long, city_id long, province string, mapping_status string, longitude double, mapping_version string")
    got = sorted((r.market_id, r.rule) for r in mapping.mapping_rule_breaks(m).collect())
    both = [(n, r) for n in (143, 1430) for r in ("unknown_status", "unmapped_with_city")]
    assert got == sorted([*both, (110, "unmapped_with_city"), (130, "unknown_status"), (1, "mapped_without_city"), (3, "unknown_with_place")])


def test_medians_by_rank(spark):
    """Market-days and city-days have the interpolated median, for odd and even counts, ties and missing prices; no percentile keeps a map for each group."""
    prices = [[3.0], [1.0, 2.0], [5.0, 1.0, 2.0], [4.0, 4.0, 1.0, 9.0], [None], [7.0, None, 2.5], [0.1, 0.7, 0.3, 0.2, 0.6]]
    rows = [("p", 1 if m % 3 else 2, "north", m, D(2000, 1, 1 + d), x, False, m == 2, 1.0) for m, day in enumerate(prices) for d in (0, 1) for x in day[: len(day) - d]]
    df = spark.createDataFrame(rows, "product_id string, city_id int, province string, market_id long, date date, price double, stale boolean, outlier boolean, confidence double")
    days = cityday.market_day(df)
    middle = lambda xs: float(np.median(xs)) if xs else None
    want = {(m, D(2000, 1, 1 + d)): (middle([x for x in day[: len(day) - d] if x is not None]), len(day) - d) for m, day in enumerate(prices) for d in (0, 1) if day[: len(day) - d]}
    assert {(r.market_id, r.date): (r.price, r.source_rows) for r in days.collect()} == want
    cities = cityday.city_day(days.filter("price IS NOT NULL"))
    got = {(r.city_id, r.date): r.price for r in cities.collect()}
    of = lambda c, at: [p for (m, d), (p, _) in want.items() if p is not None and (1 if m % 3 else 2) == c and d == at]
    assert got == {(c, at): middle(of(c, at)) for c, at in got} and len(got) == 4
    for plan in (days, cities):
        assert "percentile" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_mapping_of_many_markets_leaves_quotes_in_place(spark):
    """300,000 markets are broadcast: the quotes are not moved for them."""
    m = spark.range(300_000).select(F.col("id").alias("market_id"), (F.col("id") % 7).alias("city_id"))
    q = spark.range(1000).select((F.col("id") * 300).alias("market_id"), F.col("id").alias("n"))
    joined = mapping.map_markets(q, m, check=False)
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString() and joined.filter(F.col("city_id") == F.col("market_id") % 7).count() == 1000


def test_market_days_come_from_one_sort(spark):
    """Almost every quote is a market-day: no hash table of them, and sorts start with the number."""
    rows = [(p, m, D(2000, 1, 1 + d), x, s, o) for p in ("a", "b") for m in (1, 2) for d, x, s, o in ((0, 3.0, False, False), (1, 5.0, True, False), (1, 2.0, False, True), (2, 1.0, False, False), (2, None, False, False), (2, 4.0, False, False), (2, 4.0, True, True), (3, None, False, False))]
    df = spark.createDataFrame(rows, "product_id string, market_id long, date date, price double, stale boolean, outlier boolean").withColumns({"city_id": F.col("market_id") * 10, "province": F.lit("x"), "confidence": F.when(F.col("price") > 4, 1.0).otherwise(0.5)})
    days = cityday.market_day(df)
    got = {(r.product_id, r.market_id, r.date.day): (r.price, r.source_rows, r.stale, r.outlier, r.confidence, r.duplicate) for r in days.collect()}
    want = {1: (3.0, 1, False, False, 0.5, False), 2: (3.5, 2, True, True, 1.0, True), 3: (4.0, 4, True, True, 0.5, True), 4: (None, 1, False, False, 0.5, False)}
    assert got == {(p, m, d): w for p in ("a", "b") for m in (1, 2) for d, w in want.items()}
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort [market_id" in plan


def test_market_days_of_mapped_markets_only(spark):
    """Lines of unmapped markets are neither moved nor numbered, one sort serves numbers and flags, and rows are those of all flagged quotes."""
    sf = "/root/testdata/sf0.001"
    mapped = given.mapping(spark, sf).filter("city_id IS NOT NULL")
    quotes = given.prices(spark, sf, mapped)
    assert quotes.filter("market_id % 10 = 0").count() == 0 and not {"l_discount", "l_tax", "l_returnflag", "l_linestatus"} & set(quotes.columns)
    assert quotes.count() == given.quotes(spark, sf).filter("market_id % 10 <> 0").count() > 0
    flags = cityday.eligible(quality.add_quality(mapping.map_markets(quotes, mapped, check=False), given.PRICED, at_least=10, window=90))
    plan = flags.select("market_id", "product_id", "date", "price", "stale", "outlier")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    want = cityday.market_day(cityday.eligible(common.flagged(spark, sf)))
    got = common.market_days(spark, sf)
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()


def test_flags_ordered_by_more_than_one_column(spark):
    """Stale rows and outliers against lists, where quotes of one day follow by two columns and some prices are missing."""
    rng = np.random.default_rng(5)
    prices = [float(x) if x != 3 else None for x in rng.integers(1, 9, 120)] + [4.0] * 15 + [400.0, 4.0]
    order = [(D(2000, 1, 1) + dt.timedelta(i // 2 if i < 120 else i), i % 2, -i) for i in range(len(prices))]
    rows = [("p", 1, d, a, b, x, y) for (d, a, b), x, y in zip(order, prices, [None, *prices])]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], "product_id string, market_id int, date date, a int, b int, price double, previous_price double").withColumn("reported_change_pct", F.lit(None).cast("double"))
    got = {r.b: r for r in quality.add_quality(df, ["a", "b"], stale_after=3, window=20, at_least=5).collect()}
    run = 0
    for i, x in enumerate(prices):
        same = i > 0 and x is not None and prices[i - 1] == x and (order[i][0] - order[i - 1][0]).days == 1
        run = run + 1 if same else 0
        past = [math.log(y) for y in prices[max(0, i - 20) : i] if y is not None]
        low, middle, high = np.quantile(past, [0.25, 0.5, 0.75]) if len(past) >= 5 and x is not None else (0, 0, 0)
        far = x is not None and len(past) >= 5 and abs(math.log(x) - middle) > (6 * (high - low) / 1.349 if high > low else math.log(1.5))
        assert (got[-i].zero_run, got[-i].stale, got[-i].outlier) == (run, run >= 3, far), i
    assert any(r.stale for r in got.values()) and any(r.outlier for r in got.values())


def test_numbers_that_count_up(spark):
    """1 to n, each once: gaps, repeats, zeros, negative ones and missing ones against a set; rows aren't moved one by one."""
    groups = {"a": [*range(1, 201)], "b": [1], "c": [2], "d": [1, 2, 2], "e": [1, 1, 3], "f": [0, 1, 2], "g": [*range(1, 64), 65], "h": [1, None], "i": [None], "j": [-1, 1, 2], "k": [*range(64, 129)], "l": [1, 2, 64], "m": [*range(300, 0, -1)]}
    df = spark.createDataFrame([(g, n) for g, ns in groups.items() for n in ns], "g string, n long")
    found = contracts.counted_up(df, "g", "n")
    assert {r.g: r.whole for r in found.collect()} == {g: sorted(ns, key=lambda n: (n is None, n)) == [*range(1, len(ns) + 1)] for g, ns in groups.items()}
    assert found.filter("whole").count() == 3
    many = contracts.counted_up(spark.range(1, 64_001, 1, 2).select(F.lit("g").alias("g"), F.col("id").alias("n")), "g", "n")
    assert [r.whole for r in many.collect()] == [True] and "distinct" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_quote_files_of_one_name_in_two_folders(spark, tmp_path):
    """Two pieces of the path tell files apart, also odd names; a header's wrong column is seen if its text isn't kept; text isn't written again."""
    header = ",".join(files.RAW_COLUMNS) + "\n"
    for f, n in (("product=0/q.csv", 3), ("product=1/q.csv", 5), ("product=1/a b+c%41.csv", 2)):
        (tmp_path / "in" / f).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / "in" / f).write_text(header + "".join(f"2020-01-0{i},{i},X,{i},2.5,2.0,25%\n" for i in range(1, n + 1)))
    products = spark.createDataFrame([("product=0/q.csv", "p"), ("product=1/q.csv", None), ("product=1/a b+c%41.csv", "r")], "source_file string, product_id string")
    keep = ["raw_market", "date", "row_index", "price"]
    got = files.read_quotes(spark, str(tmp_path / "in"), products, parsed=keep, depth=2)
    assert {*got.columns} == {*keep, "source_file", "row_in_file", "product_id"}
    want = {(f, p, i, D(2020, 1, i)) for f, p, n in (("product=0/q.csv", "p", 3), ("product=1/q.csv", None, 5), ("product=1/a b+c%41.csv", "r", 2)) for i in range(1, n + 1)}
    rows = got.collect()
    assert {(r.source_file, r.product_id, r.row_in_file, r.date) for r in rows} == want and len(rows) == 10 and all(r.row_in_file == r.row_index for r in rows)
    wrong = tmp_path / "wrong" / "product=0" / "q.csv"
    wrong.parent.mkdir(parents=True)
    wrong.write_text(header.replace("raw_province", "raw_place") + "2020-01-01,1,X,1,2.5,2.0,25%\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_quotes(spark, str(tmp_path / "wrong"), products, parsed=keep, depth=2).collect()


@pytest.mark.parametrize("parts", [1_000_000, 0])
def test_csv_quotes_of_odd_lines_on_less_disk(spark, tmp_path, monkeypatch, parts):
    """Tied, copied and unpriced lines, a part without a type and a supplier listed twice, with parts broadcast or not: rows are the quotes'.

    On disk there are the text and the parsed rows, once each; rows are moved once to be grouped.
    """
    sf, odd = "/root/testdata/sf0.001", str(tmp_path / "odd")
    line, part, supplier = (given.table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    some = line.filter("l_orderkey % 5 = 0")
    lines = line.unionByName(some).unionByName(some.withColumn("l_discount", F.col("l_discount") + 0.01)).unionByName(some.limit(50).withColumn("l_extendedprice", F.lit(0.0)))
    lines.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 31 != 0, F.col("l_suppkey"))).write.parquet(f"{odd}/lineitem.parquet")
    part.withColumn("p_type", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type"))).write.parquet(f"{odd}/part.parquet")
    supplier.unionByName(supplier.filter("s_suppkey % 4 = 0")).write.parquet(f"{odd}/supplier.parquet")
    for t in ("nation", "region"):
        given.table(spark, sf, t).write.parquet(f"{odd}/{t}.parquet")
    monkeypatch.setattr(given, "MOST_MARKETS", parts)
    written = []
    kept = files.tables.kept
    monkeypatch.setattr(files.tables, "kept", lambda df, tag, *how: written.append((tag, set(df.columns))) or kept(df, tag, *how))
    got = measure.csv_quotes(spark, odd)
    assert [tag for tag, _ in written] == ["lines", "starts"] and not {"raw_date", "raw_price", "source_file", "product_id"} & written[0][1]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and plan.count("RepartitionByExpression") == 1
    quotes = given.quotes(spark, odd).join(given.mapping(spark, odd), "market_id", "left").filter("previous_price IS NOT NULL AND reported_change_pct IS NOT NULL")
    quotes = quotes.withColumn("reported_change_pct", F.bround("reported_change_pct", 2))
    want = common.out(quotes.groupBy("product_id", F.col("market_id").cast("string").alias("raw_market"), "date", "price", "previous_price", "reported_change_pct").agg(F.count("*").alias("rows"), F.lit(True).alias("numbered")), 2)
    assert got.columns == want.columns and got.filter("product_id IS NULL").count() > 0 and got.filter("rows > 2").count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
