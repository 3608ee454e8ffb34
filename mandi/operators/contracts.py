"""Checks of tables.  A check is a DataFrame with what breaks the rule; assert_ functions raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    have, want = ([(f.name, f.dataType, f.nullable) for f in s] for s in (df.schema, schema))
    if have != want:
        raise ValueError(f"schema is {have}, not {want}")
    return df


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    bad = duplicates(df, key).take(3)
    if bad:
        raise ValueError(f"{key} isn't unique: {bad}")
    return df


def counted_up(df: DataFrame, by: str, number: str) -> DataFrame:
    """by, whole: whether a group's numbers are 1, 2, ... up to its rows, each once.

    Numbers are marked in words of 64 bits where the rows lie, so what moves is a word for up to 64 rows, and no row.
    """
    bit = F.pmod(F.col(number), F.lit(64))
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    words = df.groupBy(by, (F.col(number) - bit).alias("word")).agg(F.bit_or(mark).alias("bits"), F.count("*").alias("rows"), F.min(number).alias("least"), F.max(number).alias("most"))
    found = words.groupBy(by).agg(F.sum(F.bit_count("bits")).alias("different"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
    return found.select(by, F.coalesce((F.col("different") == F.col("rows")) & (F.col("least") == 1) & (F.col("most") == F.col("rows")), F.lit(False)).alias("whole"))


def missing(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys of one side that the other lacks, with the side that has them."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))


def conservation(parts: dict[str, Column], df: DataFrame) -> DataFrame:
    """Row counts or sums that must be equal, side by side."""
    return df.agg(*(c.alias(k) for k, c in parts.items()))


def broken(df: DataFrame, rules: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows that break each rule; NULL doesn't break one."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), *(F.count_if(~c).alias(k) for k, c in rules.items()))


def dependency_breaks(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(*key).agg(F.count_distinct(value).alias("values")).filter("values > 1")


def joined_once(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left with right's columns; raises unless right's key is unique and holds every left key."""
    assert_unique(right, key)
    if not left.join(right, key, "left_anti").isEmpty():
        raise ValueError(f"right side lacks some {key}")
    return left.join(right, key)


def table_diff(old: DataFrame, new: DataFrame, key: list[str], allowed: dict[str, list] | None = None) -> DataFrame:
    """Rows that were added, removed or changed, with the names of the changed columns.

    allowed: values of the first key whose difference is expected.
    """
    others = [c for c in new.columns if c not in key]
    a, b = old.alias("a"), new.alias("b")
    on = reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in others)))
    both = a.withColumn("in_old", F.lit(True)).alias("a").join(b.withColumn("in_new", F.lit(True)).alias("b"), on, "full_outer")
    kind = F.when(F.col("a.in_old").isNull(), "added").when(F.col("b.in_new").isNull(), "removed").when(F.size(changed) > 0, "changed")
    out = both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key), kind.alias("difference"), F.when(kind == "changed", F.concat_ws(",", changed)).otherwise("").alias("columns")).filter("difference IS NOT NULL")
    for k, values in (allowed or {}).items():
        out = out.filter(~F.col(k).isin(values))
    return out


def assert_splits(df: DataFrame, expected: set[str], column: str = "split") -> DataFrame:
    """Refuse a mart whose splits aren't exactly the expected ones."""
    found = {r[0] for r in df.select(column).distinct().limit(len(expected) + 1).collect()}
    if found != expected:
        raise ValueError(f"splits are {found}, not {expected}")
    return df


def assert_none(df: DataFrame, what: str) -> None:
    bad = df.take(3)
    if bad:
        raise ValueError(f"{what}: {bad}")


# ---------------------------------------------------------------- checks in flight


def checked(df: DataFrame, rules: dict[str, Column], tag: str, expected: dict[str, int] | None = None, splits: set[str] | None = None, schema: T.StructType | None = None, split: str = "split") -> tuple[DataFrame, dict[str, int]]:
    """df written to the shared folder, and what was counted on the way: rows, and rows that break each rule (NULL doesn't).

    Counts are observed while the table is written, so no check is a job of its own.  Raises after the write, and the
    table isn't given out, if a rule is broken other than as often as ``expected`` says (by default never), if split
    values aren't exactly ``splits``, or, before it, if the schema isn't the given one.
    """
    if schema is not None:
        assert_schema(df, schema)
    watch = Observation(f"checks of {tag}")
    counts = {"rows": F.count(F.lit(1))} | {k: F.count_if(~c) for k, c in rules.items()}
    if splits is not None:
        counts |= {f"split {x}": F.count_if(F.col(split) == x) for x in sorted(splits)} | {"other splits": F.count_if(F.coalesce(~F.col(split).isin(*splits), F.lit(True)))}
    written = tables.kept(df.observe(watch, *(c.alias(k) for k, c in counts.items())), tag)
    found = {k: int(watch.get.get(k, 0) or 0) for k in counts}  # an empty table observes nothing
    want = expected or {}
    bad = {k: found[k] for k in rules if found[k] != want.get(k, 0)}
    if splits is not None:
        bad |= {k: n for k, n in found.items() if (k.startswith("split ") and not n) or (k == "other splits" and n)}
    if bad:
        raise ValueError(f"{tag}: {bad} of {found['rows']} rows")
    return written, found


def joined_checked(left: DataFrame, right: DataFrame, key: list[str], tag: str, many: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """left with right's columns, written: raises if right's key repeats or a row of left has none, and with many False if left's key repeats.

    How often a key stands on the right is counted where the right side is grouped for the join, so cardinality
    and missing keys show in the one write.
    """
    others = [c for c in right.columns if c not in key]
    held = right.groupBy(*key).agg(F.count("*").alias("times__"), *(F.first(c).alias(c) for c in others))
    rows = left if many else left.withColumn("same__", F.count("*").over(Window.partitionBy(*key)))
    df = rows.join(held, key, "left")
    rules = {"missing on the right": F.col("times__").isNotNull(), "repeated on the right": F.coalesce(F.col("times__") == 1, F.lit(True))} | ({} if many else {"repeated on the left": F.col("same__") == 1})
    written, found = checked(df, rules, tag)
    return written.drop("times__", "same__"), found
