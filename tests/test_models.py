"""Models, quantiles and gates against closed forms and brute force in NumPy."""

import hashlib
import random
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from mandi.operators import alerts, forecast, metrics, shocks, tables, temporal
from mandi.plans import temporal as plans

SF = "/root/testdata/sf0.001"


def closed_form(x, y, alpha):
    x = np.column_stack([np.ones(len(x)), x])
    penalty = alpha * np.eye(x.shape[1])
    penalty[0, 0] = 0
    return np.linalg.solve(x.T @ x + penalty, x.T @ y)


def test_ridge_and_hurdle_are_closed_forms(spark):
    mart = plans.mart(spark, SF)
    train, rest = mart.filter("split = 'train'"), mart.filter("split <> 'train'")
    frozen = forecast.fit_candidates(train, alphas=(0.1, 10.0), shrinks=(0.5, 1.0))
    scored, names = forecast.score(rest, frozen)
    keys = ["product_id", "city_id", "origin_date", "horizon"]

    def design(df, fit=None):
        pdf = forecast.features(df)[0].select(*keys, "origin_price", "target_return", *frozen["names"]).toPandas()
        x = pdf[frozen["names"]].astype(float)
        group = pdf.product_id + "|" + pdf.horizon.astype(str)
        fill = x.median().fillna(0.0) if fit is None else fit[0]
        x = x.fillna(fill)
        mean, sd, levels = (x.mean(), x.std(ddof=0).replace(0.0, 1.0), sorted(set(group))) if fit is None else fit[1:]
        return pdf, np.column_stack([(x - mean) / sd, *((group == v).astype(float) for v in levels)]), (fill, mean, sd, levels)

    a, x, fit = design(train)
    b, z, _ = design(rest, fit)
    y = a.target_return.to_numpy(float)
    moved = np.abs(y) > 0.01
    ones = np.column_stack([np.ones(len(z)), z])
    want = {}
    for alpha in (0.1, 10.0):
        straight = ones @ closed_form(x, y, alpha)
        hurdle = np.clip(ones @ closed_form(x, moved.astype(float), alpha), 0, 1) * (ones @ closed_form(x[moved], y[moved], alpha))
        for s in (0.5, 1.0):
            want[f"ridge_a{alpha}_s{s}"] = b.origin_price * np.exp(np.clip(straight * s, -1, 1))
            want[f"hurdle_a{alpha}_s{s}"] = b.origin_price * np.exp(np.clip(hurdle * s, -1, 1))
    got = scored.toPandas().set_index(keys).loc[list(map(tuple, b[keys].to_numpy()))]
    assert len(got) == len(b) > 10
    for name, prices in want.items():
        np.testing.assert_allclose(got[names[name]].to_numpy(float), prices.to_numpy(float), rtol=1e-5, err_msg=name)


def edge_rows(n, seed, effect, splits=("train", "validation", "final_test")):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 0.3 * x[:, 0] + effect * x[:, 2] + rng.normal(size=n) * 0.5
    return [("p", f"s{seed}", "t", date(2000, 1, 1) + timedelta(days=3 * i), splits[min(2, 3 * i // n)], *map(float, (y[i], *x[i]))) for i in range(n)]


EDGE_DDL = "product_id string, source_city_id string, target_city_id string, bin_start date, split string, y double, a double, b double, source_c double"


def test_edges_bootstrap_and_release(spark):
    rows = edge_rows(240, 1, 0.8) + edge_rows(240, 2, 0.0) + edge_rows(12, 3, 0.5)
    frame = spark.createDataFrame(rows, EDGE_DDL).repartition(3)
    tested = shocks.edge_models(frame, ["a", "b"], ["c"], "y", least_fit=40, least_test=20)
    got = {r.source_city_id: r for r in tested.collect()}
    data = np.array([r[5:] for r in rows[:240]])
    fit, test = data[:80], data[80:160]
    beta = closed_form(fit[:, 1:], fit[:, 0], 0.0)
    few = closed_form(fit[:, 1:3], fit[:, 0], 0.0)
    rss = [((fit[:, 0] - np.column_stack([np.ones(80), fit[:, c]]) @ w) ** 2).sum() for c, w in (([1, 2], few), ([1, 2, 3], beta))]
    assert got["s1"].source_sum == pytest.approx(beta[3]) and got["s1"].f_statistic == pytest.approx((rss[0] - rss[1]) / (rss[1] / 76))
    full = test[:, 0] - np.column_stack([np.ones(80), test[:, 1:]]) @ beta
    assert got["s1"].rmse_full == pytest.approx(np.sqrt((full**2).mean())) and got["s1"].expected_delay_days == 3
    assert got["s1"].p_value < 1e-6 < got["s2"].p_value and got["s3"].source_sum is None
    validated = shocks.validation_gate(metrics.benjamini_hochberg(tested, ["product_id"], key=["source_city_id"]))
    assert {r.source_city_id: r.validated for r in validated.collect()} == {"s1": True, "s2": False, "s3": False}
    assert shocks.funnel(validated).first().asDict() == {"product_id": "p", "candidates": 3, "modelled": 2, "rejected": 1, "validated": 1}

    train = frame.filter("split = 'train'")
    boot = {r.source_city_id: r for r in shocks.block_bootstrap(train, ["a", "b"], ["c"], "y", draws=40).collect()}
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(b"20260914|p|s2|t").digest()[:8], "little"))
    data = np.array([r[5:] for r in rows[240:320]])
    hits = 0
    for _ in range(40):
        at = np.concatenate([np.arange(s, s + 8) for s in rng.integers(0, 73, size=10)])[:80]
        hits += closed_form(data[at, 1:], data[at, 0], 0.0)[3] > 0
    assert boot["s2"].positive_rate == hits / 40 and boot["s1"].positive_rate == 1.0 and boot["s1"].halves_positive
    assert boot["s3"].positive_rate is None, "fewer rows than a block"

    stable = shocks.stability_gate(validated.filter("validated"), shocks.block_bootstrap(train, ["a", "b"], ["c"], "y", draws=40), tested)
    final = shocks.frozen_edges_final(stable, shocks.edge_models(frame, ["a", "b"], ["c"], "y", ("train", "validation"), "final_test", least_fit=40, least_test=20))
    row = final.first()
    assert row.stable and row.confirmed and row.strong and row.refit_rows == 160 and row.final_rows == 80
    network = spark.createDataFrame([(True, True), (True, False)], "reject_raw boolean, reject_residual boolean")
    assert shocks.release_decision(final, network).first().release_status == "common_shock_only"
    assert shocks.release_decision(final, network, {"products": 1, "edges_per_product": 1}).first().release_status == "network_release"
    assert shocks.release_decision(final.filter("false"), network).first().frozen_edges == 0


def test_resamples_from_running_products():
    """Sums of block cross-products against fits on rows, with columns of very different size and a constant one."""
    rng = np.random.default_rng(3)
    for n, block in ((8, 8), (9, 8), (61, 8), (200, 5)):
        x = rng.normal(size=(n, 3)) * np.array([1.0, 1e3, 1e-3])
        y = rng.normal(size=n) + x[:, 1] / 1e3
        starts = np.stack([rng.integers(0, n - block + 1, size=-(-n // block)) for _ in range(50)])
        for z in (x, np.column_stack([x[:, :2], np.full(n, 2.0)])):
            rows = [(s[:, None] + np.arange(block)).ravel()[:n] for s in starts]
            want = [np.linalg.lstsq(np.column_stack([np.ones(n), z[at]]), y[at], rcond=None)[0][2:].sum() for at in rows]
            np.testing.assert_allclose(shocks.resampled_sums(z, y, starts, block, 1), want, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_quantiles_of_growing_histories(spark, bits):
    """Rank descent with few and many digits: ties, nulls, a group without history, all groups as one."""
    rng = random.Random(2)
    start = date(2000, 1, 3)
    past = [(p, "x", start + timedelta(days=7 * rng.randrange(30)), rng.choice([None, round(rng.gauss(0, 0.3), 2)])) for p in "ab" for _ in range(120)]
    asked = [(p, "x", start + timedelta(days=7 * w)) for p in "abc" for w in range(0, 32, 3)]
    frame = spark.createDataFrame(past, "product_id string, every string, window_end date, peak_return double").repartition(3)
    spine = spark.createDataFrame(asked, "product_id string, every string, origin_date date")
    for by in ("product_id", "every"):
        got = temporal.quantiles_so_far(spine.select(by, "origin_date").distinct(), frame, [by], "origin_date", "window_end", "peak_return", (0.9, 0.95, 0.5, 1.0), bits).collect()
        want = {}
        for p, _, day in asked:
            values = [v for q, _, end, v in past if end <= day and v is not None and by in ("every", {p: "product_id"}.get(q))]
            if values:
                want[p if by == "product_id" else "x", day] = (len(values), *np.quantile(values, (0.9, 0.95, 0.5, 1.0)))
        assert {(r[by], r.origin_date): (r.n, *map(pytest.approx, r.q)) for r in got} == want


def test_numbers_over_many_tasks(spark):
    """One group over all tasks, small and null groups, ties."""
    rng = random.Random(4)
    rows = [(rng.choice(["big"] * 20 + ["a", "b", None]), rng.randrange(200), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "file string, place int, id int").repartition(7)
    got = tables.numbered(df, ["file"], ["place", "id"], "row").collect()
    want, counts = {}, defaultdict(int)
    for f, p, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        counts[f] += 1
        want[i] = counts[f]
    assert {r.id: r.row for r in got} == want and len(got) == 3000
    everywhere = tables.numbered(df, [], ["place"], "row").collect()
    assert sorted(r.row for r in everywhere) == list(range(1, 3001)) and [r.place for r in sorted(everywhere, key=lambda r: r.row)] == sorted(p for _, p, _ in rows)
    assert tables.numbered(df.filter("id < 0"), ["file"], ["place"], "row").count() == 0


def test_ranks_curves_and_medians_by_slices(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([7, 14]), round(abs(rng.gauss(0, 1)), 3)) for _ in range(300)]
    levels = [["product_id", "horizon"], ["horizon"], []]
    got = forecast.conformal_quantiles(spark.createDataFrame(rows, "product_id string, horizon int, residual double"), levels, fine=4).collect()
    for r in got:
        held = sorted(x for p, h, x in rows if r.product_id in (None, p) and r.horizon in (None, h))
        assert r.n == len(held) and r["quantile"] == held[min(len(held), int(np.ceil((len(held) + 1) * 0.8))) - 1]
    assert len(got) == 4 + 2 + 1

    scored = [(g, rng.randint(0, 1), round(rng.random(), 2)) for g in "xy" for _ in range(100)]
    curve = metrics.pr_curve(spark.createDataFrame(scored, "slice string, label int, score double"), ["slice"], fine=8).collect()
    for r in curve:
        tp, n = (sum(1 for g, y, s in scored if g == r.slice and s >= r.threshold and (y or k)) for k in (0, 1))
        assert (r.tp, r.alerts) == (tp, n)
    for g in "xy":
        assert sorted(r.place for r in curve if r.slice == g) == list(range(len({s for k, _, s in scored if k == g}) + 1))

    panel = [("p", date(2000, 1, 1 + rng.randrange(9)), f"c{i}", rng.choice([None, round(rng.gauss(0, 1), 1)])) for i in range(90)]
    got = shocks.loo_median(spark.createDataFrame(panel, "product_id string, bin_start date, city_id string, adjusted_return double"), at_least=3)
    for r in got.collect():
        others = [v for _, d, c, v in panel if d == r.bin_start and c != r.city_id and v is not None]
        assert r.peers == (len(others) if r.adjusted_return is not None else 0)
        assert r.common_factor == (pytest.approx(np.median(others)) if r.adjusted_return is not None and len(others) >= 3 else None)


def test_history_medians(spark):
    rng = random.Random(9)
    start = date(2000, 1, 1)
    series = [("p", c, start + timedelta(days=d), float(rng.randrange(50))) for c in "ab" for d in sorted(rng.sample(range(500), 160))]
    targets = [("p", c, start + timedelta(days=o), start + timedelta(days=o + h)) for c in "ab" for o in range(3, 480, 29) for h in (7, 28)]
    frame = spark.createDataFrame(series, "product_id string, city_id string, date date, price double")
    asked = spark.createDataFrame(targets, "product_id string, city_id string, origin_date date, target_date date")
    past = lambda t: [(d, x) for _, c, d, x in series if c == t[1] and d <= t[2]]
    want = defaultdict(tuple)
    for t in targets:
        month = [x for d, x in past(t) if d.month == t[3].month]
        week = [x for d, x in sorted(past(t)) if d.weekday() == t[3].weekday()][-4:]
        every = [x for _, x in past(t)]
        season = np.median(month) if len(month) >= 3 else np.median(every) if every else None
        want[t] = (len(month), season, np.median(week) if week else None)
    season = {tuple(r[:4]): r for r in temporal.seasonal_median(asked, frame).select("product_id", "city_id", "origin_date", "target_date", "seasonal_count", "seasonal_median").collect()}
    week = {tuple(r[:4]): r for r in temporal.weekly_pattern(asked, frame).select("product_id", "city_id", "origin_date", "target_date", "weekly_median").collect()}
    assert {t: (season[t].seasonal_count, season[t].seasonal_median, week[t].weekly_median if t in week else None) for t in targets} == want


def test_logistic_grid_ranks_and_selects(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    event = rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))
    rows = [("p" if i % 2 else "q", f"c{i % 5}", date(2000, 1, 1) + timedelta(days=i), 1 + i % 12, *map(float, x[i]), bool(event[i]), 5, float(x[i, 0])) for i in range(400)]
    df = spark.createDataFrame(rows, "product_id string, city_id string, origin_date date, origin_month int, a double, b double, event_label boolean, lead_days int, peak_return double")
    score, names = alerts.fit_logistic(df, ["a", "b"], ["product_id", "origin_month"], ridges=(1e-4, 1e-1), weights=(1.0, 3.0))
    scored = score(df.withColumn("product_id", F.when(F.col("city_id") == "c0", "new").otherwise(F.col("product_id"))))
    assert scored.columns[: len(df.columns)] == df.columns and len(names) == 4
    long = alerts.by_source(scored, {n: c for c, (n, _, _) in names.items()}, ["peak_return", "lead_days"])
    bundle = alerts.score_bundle(long, ["score_source"])
    grid = spark.createDataFrame([(n, r, w) for n, r, w in names.values()], "score_source string, ridge double, weight double")
    best = alerts.rank_candidates(bundle.join(grid, "score_source")).collect()
    assert [r.average_precision for r in best] == sorted((r.average_precision for r in best), reverse=True) and best[0].average_precision > 0.7
    heavy = {n: scored.agg(F.avg(c)).first()[0] for c, (n, _, _) in names.items()}
    assert heavy["logistic_r0.0001_pw3"] > heavy["logistic_r0.0001_pw1"]


def test_logistic_scores_are_plain_figures(spark):
    """Scores follow from coefficients in the plan, which holds no fitted model; a level that train lacks is like the first."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=300)
    event = rng.random(300) < 1 / (1 + np.exp(-(1.5 * x + np.arange(300) % 3 - 2)))
    df = spark.createDataFrame([("abc"[i % 3], None if i % 50 == 7 else float(x[i]), bool(event[i])) for i in range(300)], "kind string, a double, event_label boolean")
    score, names = alerts.fit_logistic(df, ["a"], ["kind"], ridges=(1e-2,), weights=(1.0, 3.0))
    new = score(df.unionByName(df.limit(30).withColumn("kind", F.lit("new"))).unionByName(df.limit(30).withColumn("kind", F.lit("a"))))
    assert "UDF" not in new._jdf.queryExecution().optimizedPlan().toString()
    got = new.toPandas()
    assert got.notna().s0.all() and (got[got.kind == "new"].s0.to_numpy() == got[300:][got.kind[300:] == "a"].s0.to_numpy()).all()
    a = df.toPandas()
    middle = a.a.median()
    z = ((a.a.fillna(middle) - middle) / a.a.fillna(middle).std(ddof=0)).clip(-8, 8).to_numpy()
    design = np.column_stack([z, a.kind == "c", a.kind == "b", np.ones(300)]).astype(float)
    for s, w in (("s0", 1.0), ("s1", 3.0)):
        weight, y, beta = np.where(a.event_label, w, 1.0), a.event_label.to_numpy(float), np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ beta))
            ridge = 1e-2 * weight.sum() * np.diag([1.0, 1.0, 1.0, 0.0])
            beta -= np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge, design.T @ (weight * (p - y)) + ridge @ beta)
        np.testing.assert_allclose(got[s][:300], 1 / (1 + np.exp(-design @ beta)), rtol=1e-3)
