"""Operator 6: mixing sources to target weights with a splitting tree of block quotas.

Every source is cut into blocks by a hash of the document id, and its blocks are put in a random
but fixed order.  The source's target in words becomes a number of draws: whole passes over its
blocks, and then blocks of one more pass until the target is met; the last block, and in it one
document, is cut at the word.  A binary tree over the output shards splits the exact numbers of
draws of all sources at once, each node by one multivariate hypergeometric draw, so each shard gets
its quota of every source; a shard then takes that many consecutive draws, so blocks of different
shards are disjoint.  Within a shard documents are in hash order.

Targets and quotas are a table of sources, of which there may be any number; the driver holds a row for each
4096 of them.  Documents meet the draws by an equi-join on (source, block): a source with a third of
all rows is dealt over its 1024 blocks.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mandi.operators import tables

from .common import WORD, boxed, materialize, scratch, unboxed, word_count

BLOCKS, SHARDS, SEED = 1024, 64, 23
PART = 16_000_000  # words of a shard that one task takes
GROUP = 4096  # sources whose quotas one task splits
LOT = 500_000_000  # draws that are split at once
WEIGHTS = (3, 1, 2)
MOST_PLAN = 200_000  # rows of what blocks give, in a broadcast


def _sources(blocks: DataFrame, weights: dict | None, share: Fraction, most: Fraction) -> DataFrame:
    """source, source_size, source_id (by code point, null last), target, passes and rest of each source.

    Targets fill like water: with a unit of words for each weight, sources whose weight asks for more than ``most``
    times their size take just that, and what they leave raises the unit for the others, until no source is new.  Each
    step is two sums over the sources, of which there may be any number; all numbers are whole or exact fractions.
    """
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("missing", F.col("source").isNull())
    named = tables.numbered(sizes, [], ["missing", "source"], "nth").withColumn("source_id", F.col("nth") - 1).drop("nth", "missing")
    if weights is None:
        named = named.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("source_id") % len(WEIGHTS)).cast("int")).cast("decimal(38,0)"))
    else:
        scale = lcm(1, *(Fraction(w).denominator for w in weights.values()))
        given = blocks.sparkSession.createDataFrame([(s, Decimal(int(Fraction(w) * scale))) for s, w in weights.items()], "known_source string, weight decimal(38,0)")
        named = named.join(given, named.source.eqNullSafe(given.known_source), "left").drop("known_source").withColumn("weight", F.coalesce("weight", F.lit(0).cast("decimal(38,0)")))
    named = materialize(named, "sources")
    whole = lambda n: F.lit(Decimal(int(n))).cast("decimal(38,0)")
    size = F.col("source_size").cast("decimal(38,0)")
    total = int(named.agg(F.sum("source_size")).first()[0] or 0)
    unit, full = Fraction(0), F.col("weight") <= 0
    seen = -1
    while True:
        r = named.agg(F.sum(F.when(full & (F.col("weight") > 0), size)).alias("held"), F.count_if(full).alias("n"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not r.w or r.n == seen:
            break
        seen, unit = r.n, (share * total - most * int(r.held or 0)) / int(r.w)
        full = (F.col("weight") <= 0) | (F.col("weight") * whole(unit.numerator * most.denominator) > size * whole(most.numerator * unit.denominator))
    # target = weight * unit or most * size, as a fraction of whole numbers; the quota is the nearest whole number
    over = full & (F.col("weight") > 0)
    top = F.when(over, size * whole(most.numerator)).when(F.col("weight") > 0, F.col("weight") * whole(unit.numerator)).otherwise(whole(0))
    under = F.when(over, whole(most.denominator)).otherwise(whole(unit.denominator))
    quota = F.call_function("div", top.cast("decimal(37,0)") * 2 + under, under.cast("decimal(37,0)") * 2)
    df = named.withColumns({"target": top.cast("double") / under.cast("double"), "quota": quota})
    has = F.col("source_size") > 0
    return df.select("source", "source_size", "source_id", "target", F.when(has, F.call_function("div", F.col("quota"), F.col("source_size"))).otherwise(0).alias("passes"), F.when(has, F.col("quota") % F.col("source_size")).otherwise(0).alias("rest"))


def drawn_from(colors: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n draws without replacement from colors: one multivariate hypergeometric draw.

    The generator takes fewer than 10**9 draws at once; of more, whole lots of equal size are drawn first, then the odd rest.
    """
    total = int(colors.sum())
    if total < LOT:
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    lot = -(-total // LOT) + 1
    lots = colors // lot
    out = rng.multivariate_hypergeometric(lots, min(n // lot, int(lots.sum())), method="marginals") * lot
    rest = n - int(out.sum())
    return out + drawn_from(np.minimum(colors - out, rest), rest, rng)


def splitting_tree(draws: list[int] | np.ndarray, shards: int, seed: list[int], leaves: np.ndarray | None = None) -> np.ndarray:
    """Draws of each source (columns) in each shard (rows); every column keeps its sum, and rows sum to leaves (None: even)."""
    draws = np.array(draws, np.int64)
    total = int(draws.sum())
    leaves = np.diff([total * i // shards for i in range(shards + 1)]) if leaves is None else leaves
    upto = np.concatenate([[0], np.cumsum(leaves)])

    def split(quota: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = quota
            return
        mid = (lo + hi) // 2
        left = drawn_from(quota, int(upto[mid] - upto[lo]), np.random.default_rng([*seed, lo, hi]))
        split(left, lo, mid)
        split(quota - left, mid, hi)

    out = np.zeros((shards, len(draws)), np.int64)
    if len(draws):
        split(draws, 0, shards)
    return out


def _ranges(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """source_id, shard, lo, hi: which of a source's draws (counts: source_id, n) each shard takes.

    The tree is drawn in two steps with one outcome in law: first how many draws of each group of sources a shard
    takes, on the driver (a number for a shard and GROUP sources), then, a task for each group, of each source.
    """
    grouped = counts.withColumn("group", F.floor(F.col("source_id") / GROUP).cast("int"))
    totals = sorted(tuple(r) for r in grouped.groupBy("group").agg(F.sum("n").alias("n")).collect())
    tree = splitting_tree([n for _, n in totals], shards, [seed])
    leaves = counts.sparkSession.createDataFrame([(g, tree[:, i].tolist()) for i, (g, _) in enumerate(totals)], "group int, leaves array<bigint>")

    def of_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_id")
        each = splitting_tree(rows["n"].to_numpy(), shards, [seed, 1 + int(key[0])], np.array(rows["leaves"].iloc[0]))
        hi = each.cumsum(axis=0)
        shard, at = np.nonzero(each)
        return pd.DataFrame({"source_id": rows["source_id"].to_numpy()[at], "shard": shard.astype(np.int32), "lo": (hi - each)[shard, at], "hi": hi[shard, at]})

    return grouped.join(leaves, "group").groupBy("group").applyInPandas(of_group, "source_id long, shard int, lo long, hi long")


def by_code_point(sources: list) -> list:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def _plan(docs: DataFrame, weights: dict | None, share: Fraction, most: Fraction, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Sizes of docs by row, and what each block gives: source, block, its words, what the mix takes of them and where."""
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), _key().alias("key")).withColumn("block", _block(seed)), "sized")
    blocks = materialize(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    known = materialize(_sources(blocks, weights, share, most).withColumnRenamed("source", "known_source"), "known")

    # Each source's blocks in their order; the block in which the words of the last pass end.
    w = Window.partitionBy("source_id").orderBy(F.col("words") == 0, F.xxhash64(F.lit(seed + 1), "source_id", "block"), "block")
    placed = blocks.join(known, blocks.source.eqNullSafe(known.known_source)).drop("known_source")
    placed = placed.select("*", (F.row_number().over(w) - 1).alias("place"), (F.sum("words").over(w) - F.col("words")).alias("before"), F.count("*").over(Window.partitionBy("source_id")).alias("blocks"))
    placed = materialize(placed.withColumn("take", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before")))), "placed")
    counts = placed.groupBy("source_id").agg((F.max(F.col("passes") * F.col("blocks")) + F.count_if(F.col("take") > 0)).alias("n"))
    ranges = materialize(_ranges(counts, shards, seed), "ranges")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).filter((F.col("copy") < F.col("passes")) | (F.col("take") > 0))
    # the last pass counts only the blocks it takes, which are the first in the order
    each = each.withColumn("nth", F.col("copy") * F.col("blocks") + F.col("place")).select("source_id", "block", "copy", "nth")
    each = each.join(ranges, "source_id").filter((F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")))
    drawn = each.groupBy("source_id", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("drawn"))
    plan = placed.select("source_id", F.col("source").alias("plan_source"), "block", "source_size", "target", "words", "take", "passes").join(drawn, ["source_id", "block"], "left")
    return sized, plan.withColumnRenamed("block", "plan_block")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, block) with their block's plan: a source with a third of all rows is dealt over its blocks."""
    return rows.join(plan, rows.source.eqNullSafe(plan.plan_source) & (rows.block == plan.plan_block)).drop("plan_source", "plan_block")


def draw(docs: DataFrame, weights: dict | None = None, share: Fraction = Fraction(3, 2), most: Fraction = Fraction(2), shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """What the mix takes of each row of docs (doc_id, text, source; other columns are dropped).

    Returns doc_id, source, size (words), source_size, target, and draws, an array of (copy, shard,
    words).  weights: by source; by default 3, 1, 2, repeating over the sources by code point, null
    last.  Null text has size 0; a null source is a source; a row without doc_id is known by its text.
    Repeated rows are drawn alike.  Empty table: empty result.
    """
    with scratch(docs.sparkSession) as written:
        out = materialize(_draw(docs, weights, share, most, shards, seed), "draws")
        written.pop()
    return out


def _draw(docs: DataFrame, weights: dict | None, share: Fraction, most: Fraction, shards: int, seed: int) -> DataFrame:
    sized, plan = _plan(docs, weights, share, most, shards, seed)
    rows = _with_plan(sized, plan)
    cut = (F.col("take") > 0) & (F.col("take") < F.col("words"))
    inside = Window.partitionBy("source_id", "block").orderBy(F.xxhash64(F.lit(seed + 2), "key"), "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    part = F.greatest(F.lit(0), F.least("size", F.col("take") - (F.sum("size").over(inside) - F.col("size"))))
    rows = rows.filter(~cut).withColumn("part", F.when(F.col("take") > 0, F.col("size")).otherwise(F.lit(0))).unionByName(rows.filter(cut).withColumn("part", part))
    words = F.transform(F.coalesce("drawn", F.array().cast("array<struct<copy:bigint,shard:int>>")), lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.when(d["copy"] < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words")))
    return rows.select("doc_id", "source", "size", "source_size", "target", words.alias("draws"))


def taken() -> Column:
    return F.aggregate("draws", F.lit(0).cast("long"), lambda acc, d: acc + d["words"])


def mix(docs: DataFrame, weights: dict | None = None, share: Fraction = Fraction(3, 2), most: Fraction = Fraction(2), shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs as the mix has them: rows of all columns of docs, a row for each time one is taken.

    Adds mix_shard and mix_copy (with underscores after them if docs has such columns).  A document
    that is taken in part keeps its first words, joined by one space; rows that repeat that document
    are cut alike.  Documents without words (null text too) are left out: they add no word.  A null
    source is a source; a row without doc_id is known by its text.  Empty table: empty result.

    Texts move once, to their shard, which is dealt in parts of about PART words and in hash order in
    each: what each block gives, and where each source is cut, is known from sizes alone and is
    broadcast if it has at most MOST_PLAN rows.
    """
    sized, plan = _plan(docs, weights, share, most, shards, seed)
    cut = (F.col("take") > 0) & (F.col("take") < F.col("words"))
    here = _with_plan(sized, plan.filter(cut).select("source_id", "plan_source", "plan_block", "take"))
    upto = F.sum("size").over(Window.partitionBy("source_id").orderBy("place_in_block").rowsBetween(Window.unboundedPreceding, 0))
    edge = here.withColumn("place_in_block", _place(seed)).withColumn("upto", upto).filter((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("size") < F.col("take")))
    edge = edge.select("source_id", F.col("block").alias("plan_block"), F.col("place_in_block").alias("edge"), (F.col("take") - F.col("upto") + F.col("size")).alias("edge_words"))
    plan = materialize(plan.join(edge, ["source_id", "plan_block"], "left").filter("drawn IS NOT NULL"), "plan")
    if plan.limit(MOST_PLAN + 1).count() <= MOST_PLAN:
        plan = F.broadcast(plan)
    words = sized.agg(F.sum("size").alias("n")).first().n or 0
    # docs' own columns ride in a struct, so that none clashes
    text = F.col("text").cast("string")
    rows = boxed(docs, text=text, key=_key(), source=F.col("source").cast("string"), size=word_count(text)).withColumn("block", _block(seed))
    rows = _with_plan(rows, plan)
    place = _place(seed)
    part = F.when(F.col("edge").isNull(), F.when(F.col("take") > 0, F.col("size")).otherwise(0)).when(place < F.col("edge"), F.col("size")).when(place == F.col("edge"), F.col("edge_words")).otherwise(0)
    each = rows.withColumn("d", F.explode("drawn")).withColumn("mix_words", F.when(F.col("d.copy") < F.col("passes"), F.col("size")).otherwise(part)).filter("mix_words > 0")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("mix_words").cast("int")), " ")
    order = F.xxhash64(F.lit(seed + 3), "d.copy", "key")
    parts = max(1, -(-int(share * words) // (shards * PART)))
    dealt = each.withColumn("slot", F.col("d.shard") * parts + F.pmod(order, F.lit(parts)).cast("int")).repartitionById(shards * parts, "slot").sortWithinPartitions("slot", order)
    shard, copy = (_fresh(c, docs.columns) for c in ("mix_shard", "mix_copy"))
    return dealt.select(*unboxed(docs.columns, text=F.when(F.col("mix_words") < F.col("size"), first).otherwise(F.col("text"))), F.col("d.shard").alias(shard), F.col("d.copy").alias(copy))


def _fresh(name: str, taken_: list[str]) -> str:
    """name, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in taken_}:
        name += "_"
    return name


def _key() -> Column:
    """What tells a document in the mix: its id, or without one a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.lit(BLOCKS)).cast("int")


def _place(seed: int) -> Column:
    """A document's place in its block: a hash, then what tells equal hashes apart."""
    return F.struct(F.xxhash64(F.lit(seed + 2), F.col("key")).alias("hash"), F.col("key").alias("id"), F.col("size").alias("words"))
