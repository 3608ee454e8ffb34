"""Tables written once in the shared folder, and numbers that a sorted table's rows have, without one task for all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
MOST_GROUPS = 500_000  # rows of offsets that are broadcast; more are joined
TASK_ROWS = 1_000_000  # rows of some 100 to 300 bytes that a task sorts or groups in memory


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a single machine, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/mandi-tables"
    return _own_dirs.setdefault(context.applicationId, _own_dirs.get(context.applicationId) or tempfile.mkdtemp(prefix="mandi-"))


def kept(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends, and what it holds is decided."""
    path = f"{shared_dir(df.sparkSession)}/mandi-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 200_000, otherwise: str | None = None) -> DataFrame:
    """df, to be broadcast in a join if it has at most ``most`` rows; a larger one is joined as Spark chooses, or by the hint ``otherwise``."""
    if df.limit(most + 1).count() <= most:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def parts(df: DataFrame) -> int:
    """Tasks to deal df's rows to, so that none holds more than about TASK_ROWS."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with 1-based row numbers within each group, in the order given (rows that tie in it follow as they come).

    Two passes: rows are dealt by ranges of (by, order) and sorted, and each task's rows of a group are counted;
    running sums of these counts are where a task's first row stands.  So a group may fill any number of tasks.
    """
    at, part, place = "at__", "part__", "place__"
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = kept(dealt.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "ordered")
    counted = dealt.groupBy(*by, part).agg(F.count("*").alias("rows__"), F.min(place).alias("first__"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(*by, part, (F.coalesce(F.sum("rows__").over(before), F.lit(0)) + 1 - F.col("first__")).alias(at))
    same = F.lit(True)
    other = offsets.select(*(F.col(c).alias(f"{c}__") for c in by), F.col(part).alias("part2__"), at)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    joined = dealt.join(small(other, MOST_GROUPS), same & (F.col(part) == F.col("part2__")))
    return joined.select(*df.columns, (F.col(at) + F.col(place)).cast("long").alias(name))
