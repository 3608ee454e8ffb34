"""Ranges from footers, documents written line by line, and partial products of correlations."""

import json
import random
import unicodedata
from datetime import date, timedelta
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from mandi.functions.scalar import market_key
from mandi.operators import contracts, mapping, shocks
from mandi.sources import sinks


def test_ranges_come_from_footers(spark, tmp_path):
    rows = [(date(2000, 1, 1) + timedelta(days=i % 400), i, i / 7, f"s{i}") for i in range(1000)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "date date, n int, x double, s string").repartition(5).write.parquet(path)
    got = sinks.date_range(spark, path, "date")
    assert tuple(got.first()) == (date(2000, 1, 1), date(2000, 1, 1) + timedelta(days=399), 1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(date), MAX(date), COUNT(*)]" in plan and "ReadSchema: struct<min(date):date,max(date):date,count(*):bigint>" in plan
    assert tuple(sinks.statistics(spark, path, ["n", "x", "s"]).first()) == (1000, 0, 999, 0.0, 999 / 7, "s0", "s999")
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "date date").write.parquet(empty)
    assert tuple(sinks.date_range(spark, empty, "date").first()) == (None, None, 0)


def test_documents_of_any_number_of_records(spark, tmp_path):
    """A document over many tasks, one without records of a section, nulls, quotes in text, records of no document."""
    rng = random.Random(1)
    keys = spark.createDataFrame([("big", 1.5, None), ('q"x', None, "t"), ("none", 2.0, "t")], "product string, limit double, note string")
    line = [("big", i, rng.choice([None, 0.5])) for i in range(5000)] + [('q"x', 3, 1.0), ('q"x', 1, 2.0), ("other", 1, 1.0)]
    city = [("big", 'a"\n', 2), ("big", "b", 1), ("none", "c", 1)]
    rng.shuffle(line)
    lines = sinks.documents(keys, ["product"], {"timeline": (spark.createDataFrame(line, "product string, at long, v double"), ["at"]), "cities": (spark.createDataFrame(city, "product string, city string, rank int"), ["rank"])})
    path = str(tmp_path / "docs")
    sinks.write_documents(lines, path, ["product"])
    got = {}
    for f in glob(f"{path}/product=*/*.txt"):
        with open(f, newline="") as t:
            d = json.loads(t.read())
        got[d["product"]] = d
    records = lambda p, rows, names, by: [dict(zip(names, r[1:], strict=True)) for r in sorted((r for r in rows if r[0] == p), key=lambda r: r[by])]
    for name, limit, note in (("big", 1.5, None), ('q"x', None, "t"), ("none", 2.0, "t")):
        assert got[name] == {"product": name, "limit": limit, "note": note, "timeline": records(name, line, ["at", "v"], 1), "cities": records(name, city, ["city", "rank"], 2)}
    assert set(got) == {"big", 'q"x', "none"}
    back = sinks.read_documents(spark, path, "product string, timeline array<struct<at: bigint, v: double>>, cities array<struct<city: string>>").collect()
    assert {r["product"]: (len(r.timeline), len(r.cities)) for r in back} == {"big": (5000, 2), 'q"x': (2, 0), "none": (0, 1)}


@pytest.mark.parametrize("bins", [3, 64])
def test_correlations_from_partial_products(spark, bins):
    rng = random.Random(2)
    rows = [(p, c, date(2000, 1, 1) + timedelta(days=3 * d), rng.choice([None, rng.gauss(0, 1)]), 1.0 if c == "c0" else rng.gauss(0, 1)) for p in "pq" for c in ("c0", "c1", "c2", "c3") for d in range(60) if rng.random() < 0.8]
    pairs = shocks.correlations(shocks.gram(spark.createDataFrame(rows, "product_id string, city_id string, bin_start date, x double, y double"), ["x", "y"], bins), ["x", "y"]).collect()
    assert len(pairs) == 2 * 6
    for r in pairs:
        for k, c in ((3, "x"), (4, "y")):
            a, b = ({d: v for *_, d, v in ((q[0], q[1], q[2], q[k]) for q in rows if q[0] == r.product_id and q[1] == city) if v is not None} for city in (r.a, r.b))
            common = sorted(a.keys() & b.keys())
            assert r[f"n_{c}"] == len(common)
            want = None if c == "y" and r.a == "c0" else pytest.approx(np.corrcoef([a[d] for d in common], [b[d] for d in common])[0, 1])
            assert r[f"rho_{c}"] == want


def test_checks_in_flight_raise_after_the_write(spark):
    rows = [(1, 2.0, "train"), (2, -1.0, "train"), (3, None, "validation")]
    df = spark.createDataFrame(rows, "k int, x double, split string").repartition(2)
    rule, splits = {"positive": F.col("x") > 0}, {"train", "validation"}
    written, found = contracts.checked(df, rule, "t", {"positive": 1}, splits, df.schema)
    assert found == {"rows": 3, "positive": 1, "split train": 2, "split validation": 1, "other splits": 0} and sorted(map(tuple, written.collect())) == sorted(rows)
    for how in ({"rules": rule}, {"rules": {}, "splits": {"train"}}, {"rules": {}, "splits": {*splits, "final"}}, {"rules": {}, "schema": df.select("k").schema}):
        with pytest.raises(ValueError):
            contracts.checked(df, tag="t", **how)
    assert contracts.checked(df.filter("k > 9"), rule, "t")[1] == {"rows": 0, "positive": 0}
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, y string")
    joined, _ = contracts.joined_checked(df, right, ["k"], "j", many=False)
    assert sorted((r.k, r.y) for r in joined.collect()) == [(1, "a"), (2, "b"), (3, "c")] and joined.columns == ["k", "x", "split", "y"]
    for a, b, many in ((df, right.filter("k < 3"), True), (df, right.union(right), True), (df.union(df), right, False)):
        with pytest.raises(ValueError):
            contracts.joined_checked(a, b, ["k"], "j", many)
    assert contracts.joined_checked(df.union(df), right, ["k"], "j")[0].count() == 6


def test_partitions_are_replaced_and_pruned(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("product_id"), "id")
    path = str(tmp_path / "t")
    sinks.write_table(df, path, rows=10)
    sinks.write_table(df.filter("product_id = '1' AND id > 50"), path)
    got = {r.product_id: r["count"] for r in spark.read.schema("id long, product_id string").parquet(path).groupBy("product_id").count().collect()}
    assert got == {"0": 34, "1": 16, "2": 33} and len(glob(f"{path}/product_id=0/*.parquet")) == 4
    one = spark.read.schema("id long, product_id string").parquet(path).filter("product_id = '1'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(product_id" in plan and one.count() == 16


def test_names_one_edit_apart(spark):
    """Full- and half-width forms, ligatures, composed marks, brackets; all pairs against brute force."""
    rng = random.Random(7)
    odd = {"ﾄﾏﾄ市場": "トマト市場", "ＡＢＣ　市場": "abc市場", "ﬁsh (old)": "fishold", "Cafe\u0301【x】": "caféx", "㌔ market": "キロmarket", "ｶﾞ": "ガ", "": "", "[ ]": ""}
    got = spark.createDataFrame([(k,) for k in odd] + [(None,)], "name string").select("name", market_key(F.col("name")).alias("key")).collect()
    assert {r.name: r.key for r in got if r.name is not None} == odd and [r.key for r in got if r.name is None] == [None]
    names = ["".join(rng.choice("abＡ ") for _ in range(rng.randint(0, 6))) for _ in range(120)]
    known, raw = (spark.createDataFrame([(n,) for n in names[i::2]] + [(None,)], "name string") for i in (0, 1))

    def key(n):
        return unicodedata.normalize("NFKC", n).lower().replace(" ", "")

    def near(a, b):
        if a == b:
            return 0
        if len(a) == len(b):
            return 1 if sum(x != y for x, y in zip(a, b, strict=True)) == 1 else None
        a, b = sorted((a, b), key=len)
        return 1 if len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))) else None

    want = {(r, k, near(key(r), key(k))) for r in names[1::2] for k in names[0::2] if near(key(r), key(k)) is not None}
    assert {tuple(r) for r in mapping.name_candidates(raw, known).collect()} == want and len(want) > 50
    assert {tuple(r) for r in mapping.name_candidates(raw, known, 0).collect()} == {x for x in want if x[2] == 0}


def test_basket_days_are_measured_once(spark, monkeypatch):
    """Panels of three days and of a week share the baskets' days: market-days are read for them once."""
    from mandi.plans import common, shocks

    asked = []
    monkeypatch.setattr(shocks, "market_days", lambda s, d: asked.append(d) or common.market_days(s, d))
    sf = "/root/testdata/sf0.001"
    first, again = shocks.coupled_days(spark, sf).count(), shocks.coupled_days(spark, sf).count()
    assert first == again > 0 and asked == [sf]
