"""Scores of predictions, intervals and alerts, and false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_predictions(df: DataFrame, methods: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per method: keep, method, predicted."""
    each = F.array(*(F.struct(F.lit(name).alias("method"), F.col(c).cast("double").alias("predicted")) for name, c in methods.items()))
    return df.select(*keep, F.explode(each).alias("m")).select(*keep, "m.method", "m.predicted")


def point_aggregates(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    a, p = F.col(actual), F.col(predicted)
    both = F.abs(a) + F.abs(p)
    smape = F.when(both == 0, 0.0).otherwise(2 * F.abs(a - p) / both)
    return [F.count("*").alias("rows"), F.sum(F.abs(a - p)).alias("abs_error"), F.sum(F.abs(a)).alias("abs_actual"), (F.sum(F.abs(a - p)) / F.sum(F.abs(a))).alias("wape"), F.avg(F.abs(a - p)).alias("mae"), F.avg(smape).alias("smape")]


def scorecard(predictions: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Point scores of each method over all rows and over each set of columns: one pass."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    sets = [["method", *level] for level in levels]
    return predictions.groupingSets([[F.col(c) for c in s] for s in sets], "method", *columns).agg(*point_aggregates())


def best_method(scores: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The method of least WAPE per group; ties go to the first in order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("method"))
    return scores.groupBy(*by).agg(F.min_by("method", F.struct("wape", place)).alias("best_method"), F.min("wape").alias("best_wape"))


def interval_aggregates(alpha: float = 0.2) -> list[Column]:
    """Coverage, width, pinball losses of 10, 50 and 90 %, and the weighted interval score."""
    a, lo, mid, hi = (F.col(c) for c in ("actual", "p10", "p50", "p90"))
    pin = lambda q, p: F.greatest(q * (a - p), (q - 1) * (a - p))
    score = (hi - lo) + 2 / alpha * F.greatest(lo - a, F.lit(0.0)) + 2 / alpha * F.greatest(a - hi, F.lit(0.0))
    wis = (0.5 * F.abs(a - mid) + alpha / 2 * score) / 1.5
    return [F.count("*").alias("rows"), F.avg(((a >= lo) & (a <= hi)).cast("double")).alias("coverage"), F.avg(hi - lo).alias("mean_width"), *(F.avg(pin(q, p)).alias(f"pinball_{int(q * 100)}") for q, p in ((0.1, lo), (0.5, mid), (0.9, hi))), F.avg(wis).alias("wis")]


def pr_curve(scored: DataFrame, by: list[str], fine: int = 4096) -> DataFrame:
    """Precision and recall at each distinct score (ties are one point), and the point before the first.

    scored: by, label (0/1), score.  Thresholds fall; the first point alerts nothing: precision 1,
    recall 0, at a threshold just above the highest score.  Running sums go over slices of the score,
    ``fine`` for each unit, and then within each slice, so no task orders all scores.
    """
    points = scored.groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).withColumn("slice_", F.floor(F.col("score") * fine))
    slices = points.groupBy(*by, "slice_").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count("*").alias("points"))
    w = Window.partitionBy(*by)
    above = w.orderBy(F.desc("slice_")).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{c}_before": F.coalesce(F.sum(c).over(above), F.lit(0)) for c in ("pos", "n", "points")}
    slices = slices.withColumns(before | {"positives": F.sum("pos").over(w), "total": F.sum("n").over(w)}).drop("pos", "n", "points")
    down = Window.partitionBy(*by, "slice_").orderBy(F.desc("score"))
    held = points.join(slices, [*by, "slice_"])
    run = held.select(*by, F.col("score").alias("threshold"), (F.col("pos_before") + F.sum("pos").over(down)).alias("tp"), (F.col("n_before") + F.sum("n").over(down)).alias("alerts"), "pos", "positives", "total", (F.col("points_before") + F.row_number().over(down)).alias("place"))
    first = run.filter("place = 1").withColumns({"threshold": F.col("threshold") + F.greatest(F.abs("threshold"), F.lit(1e-300)) * 2.220446049250313e-16, "tp": F.lit(0).cast("long"), "alerts": F.lit(0).cast("long"), "pos": F.lit(0).cast("long"), "place": F.lit(0).cast("long")})
    fp = F.col("alerts") - F.col("tp")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return first.unionByName(run).withColumns({
        "fp": fp, "precision": F.when(F.col("alerts") == 0, 1.0).otherwise(F.col("tp") / F.col("alerts")), "recall": part(F.col("tp"), F.col("positives")),
        "fpr": part(fp, F.col("total") - F.col("positives")), "false_alert_share": part(fp, F.col("alerts")), "recall_step": part(F.col("pos"), F.col("positives")),
    }).drop("pos")


def average_precision(curve: DataFrame, by: list[str]) -> DataFrame:
    """Sum of recall steps times precision."""
    return curve.groupBy(*by).agg(F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"))


def threshold_at_fpr(curve: DataFrame, by: list[str], most: float) -> DataFrame:
    """The point of most recall with fpr at most ``most``; then precision, then threshold.

    Every group has one: the point before the first alerts nothing.
    """
    ok = curve.filter(F.col("fpr") <= most + 1e-12)
    top = F.max_by(F.struct("threshold", "tp", "fp", "precision", "recall", "fpr"), F.struct("recall", "precision", "threshold"))
    return ok.groupBy(*by).agg(top.alias("x")).select(*by, "x.*")


def confusion_aggregates(threshold: Column, label: str = "label", score: str = "score") -> list[Column]:
    """Counts and rates of score >= threshold; precision is 1 without an alert."""
    alert, hit = F.col(score) >= threshold, F.col(label) == 1
    tp, fp, fn, tn = (F.count_if(c) for c in (alert & hit, alert & ~hit, ~alert & hit, ~alert & ~hit))
    part = lambda a, b, none: F.when(b > 0, a / b).otherwise(none)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), part(tp, tp + fp, 1.0).alias("precision"), part(tp, tp + fn, 0.0).alias("recall"), part(fp, fp + tn, 0.0).alias("fpr"), part(fp, tp + fp, 0.0).alias("false_alert_share")]


def benjamini_hochberg(tests: DataFrame, by: list[str], q: float = 0.05, key: list[str] | None = None, p: str = "p_value") -> DataFrame:
    """q_value and reject within each group; NULL p-values are left out of the count and not rejected."""
    w = Window.partitionBy(*by)
    known = F.col(p).isNotNull()
    n = F.count(p).over(w)
    rank = F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), *(key or [])))
    ranked = tests.withColumns({"bh_rank": rank, "bh_raw": F.when(known, F.col(p) * n / rank)})
    value = F.least(F.lit(1.0), F.min("bh_raw").over(w.orderBy(F.desc("bh_rank")).rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("q_value", F.when(known, value)).withColumn("reject", F.coalesce(F.col("q_value") <= q, F.lit(False))).drop("bh_rank", "bh_raw")
