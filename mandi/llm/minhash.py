"""Operator 1: near-duplicate groups by HyperMinHash.

Each document's set of word shingles becomes 256 registers.  A register holds what is left of the
smallest hash of its bucket: the count of leading zeros and ten mantissa bits after them.  Bands of
six registers find candidates; the share of equal registers, corrected for chance collisions, drops
hopeless ones of 64 shingles or more; the rest are confirmed on full sets.

How groups stay linear:

* documents with equal sets are one *class*, found by an aggregate with map-side combine, so a
  group of a million copies is one node from then on;
* the first round gives each class one candidate, the most central class in any of its bands (the
  one that meets most others): copies of one text mostly join it at once;
* then bands of at most 16 members test all their pairs of different components;
* in larger bands of several components each member is compared with a *pivot*, the most central class
  of the component that the band's most central class is in, on full sets, and keeps only its differences from it: shingles that one has and the
  other lacks.  Two members can be linked, and not yet be connected by the pivot, only if they share
  enough differences (below), so those whose differences no one else has leave at once.  Of the others
  a fixed number of leaders per pivot meet the rest in each round, exactly, by counting shared
  differences, and retire; only links that join two components are given out.

Every pair that shares a band is thus tested, excluded by exact counts, or already connected.  What a
round gives out is at most a fixed multiple of its members, whatever their similarities.

Differences.  Let C be the pivot with c shingles, A lack d of them and have e others, B likewise, and s
the differences that A and B share.  Then |A and B| = c - d_A - d_B + s.  If B isn't linked with C, a
link of A and B takes (num + den) * s > num * e_A + den * d_A: about half of what tells A from C.
If both are linked with C, they are connected.

With similarity 0.85 a linked pair shares no band with probability (1 - 0.85**6)**42, 2e-9; with 0.8,
3e-6.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import Words, chunks, materialize, mix, scratch, text_hash, texts_of

REGISTERS, ROWS = 256, 6
SMALL = 16  # members of a band whose pairs are all tested
FEW = 64  # sets of fewer shingles are compared whole: their registers depend on each other
PART = 2048  # partners of one class, or members of a pivot, that one task takes
MANTISSA = 10
LOW = np.uint64(2**56 - 1)
# For each attempt, the bucket that an empty bucket borrows from.
_DONORS = np.random.default_rng(77).integers(0, REGISTERS, (32, REGISTERS))
SKETCH = "doc_id long, text_hash long, n_shingles long, set_id binary, registers binary"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("registers", pa.binary())])


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (56 bits) of at most 256 texts, and their bounds by text."""
    words = Words(texts, lower=True)
    starts, hashes = words.grams(k, short=True)
    owner = words.owner()[starts].astype(np.uint64)
    keys = np.sort((owner << np.uint64(56)) | (hashes >> np.uint64(8)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    bounds = np.searchsorted(keys >> np.uint64(56), np.arange(len(texts) + 1).astype(np.uint64))
    return keys & LOW, bounds


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits for each set, whatever the order."""
    out = np.empty((len(bounds) - 1, 2), np.uint64)
    for i, salt in enumerate((0x1B873593, 0xCC9E2D51)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, i] = sums[bounds[1:]] - sums[bounds[:-1]]
    return out


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each set; empty buckets borrow from others by a fixed draw."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    flat = owner * REGISTERS + (values & np.uint64(REGISTERS - 1)).astype(np.int64)
    rest = values >> np.uint64(8)  # 48 bits, in ascending order within a set
    least = np.zeros(n * REGISTERS, np.uint64)
    full = np.zeros(n * REGISTERS, bool)
    least[flat[::-1]] = rest[::-1]  # the last one written is the smallest
    full[flat] = True
    bits = np.frexp(least.astype(np.float64))[1]
    zeros = 48 - bits
    mantissa = ((least << zeros.astype(np.uint64)) >> np.uint64(47 - MANTISSA)) & np.uint64(2**MANTISSA - 1)
    out = ((zeros << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16).reshape(n, REGISTERS)
    full = full.reshape(n, REGISTERS)
    own = full.any(axis=1)
    filled = full.copy()
    for donors in _DONORS:
        need = ~filled & full[:, donors]
        if not need.any():
            if filled[own].all():
                break
            continue
        out = np.where(need, out[:, donors], out)
        filled |= need
    for row in np.flatnonzero(own & ~filled.all(axis=1)):  # then the next full bucket to the right
        have = np.flatnonzero(full[row])
        lack = np.flatnonzero(~filled[row])
        out[row, lack] = out[row, have[np.searchsorted(have, lack) % len(have)]]
    return out


def band_keys() -> Column:
    """Array of the keys of the bands of a registers column."""
    width = 2 * ROWS
    return F.array(*(F.xxhash64(F.lit(b), F.substring("registers", b * width + 1, width)) for b in range(REGISTERS // ROWS)))


def sketch(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id and registers of each document; no words: null registers."""

    def run(batches):
        for batch in batches:
            texts, ids, hashes = texts_of(batch), batch.column(0), batch.column(1)
            for a, b in chunks(texts):
                values, bounds = shingle_sets(texts[a:b], k)
                n = np.diff(bounds)
                none = n == 0
                regs = registers(values, bounds)
                found = pc.if_else(pa.array(~none), common.binary_array(regs), pa.nulls(b - a, pa.binary()))
                yield common.batch_of(_SKETCH, [ids[a:b], hashes[a:b], pa.array(n, pa.int64()), common.binary_array(set_ids(values, bounds)), found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """set_id and the whole set of each document, as sorted hashes."""
    schema = pa.schema([("set_id", pa.binary()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            for a, b in chunks(texts, docs=64):
                values, bounds = shingle_sets(texts[a:b], k)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                yield common.batch_of(schema, [common.binary_array(set_ids(values, bounds)), lists])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "set_id binary, hashes array<long>")


def hopeful(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """The least share of equal registers at which sets of n and m shingles may have similarity t.

    The estimate is the share of equal registers, corrected for registers of different values that
    collide: about 0.17 * 2**-10 * 4r / (1 + r)**2 for sets whose sizes have the ratio r.  It may be
    4.75 standard errors low, 1e-6 for registers that are independent.  Small sets fill few buckets and
    the others copy them, so one shingle can own many registers: a pair with a set of fewer than FEW
    shingles always passes, and its full sets decide.
    """
    chance = 0.169919487159739 / 2**MANTISSA * 4 * (n / m) / (1 + n / m) ** 2
    least = chance + (1 - chance) * (t - 4.75 * (t * (1 - t) / REGISTERS) ** 0.5)
    return np.where(np.minimum(n, m) < FEW, 0.0, least)


def plausible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Drop pairs whose estimated similarity is hopeless.  Keeps the columns a, b."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("registers_a", "registers_b"))
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            chance = 0.169919487159739 / 2**MANTISSA * 4 * (n / m) / (1 + n / m) ** 2
            keep = (x == y).mean(axis=1) >= hopeful(n, m, num / den)
            yield common.batch_of(schema, [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))])

    return pairs.select("a", "b", "registers_a", "registers_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def _meet(pairs: DataFrame, table: DataFrame, part: int = PART) -> DataFrame:
    """Pairs a, b with the columns of table (by node) of both, named c_a and c_b.

    A class with many partners is copied to as many tasks as they need.
    """
    side = lambda x: table.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in table.columns if c != "node"))
    pairs = materialize(pairs.select("a", "b"), "pairs")
    many = pairs.groupBy("a").agg(F.floor(F.count("*") / part).cast("int").alias("last")).filter("last > 0")
    if many.isEmpty():
        return pairs.join(side("a"), "a").join(side("b"), "b")
    last = F.coalesce("last", F.lit(0))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), last + 1).cast("int").alias("share"))
    left = side("a").join(many, "a", "left").withColumn("share", F.explode(F.sequence(F.lit(0), last))).drop("last")
    return dealt.join(left, ["a", "share"]).join(side("b"), "b").drop("share")


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b with den * |A and B| >= num * |A or B|, on full sets."""
    both = F.size(F.array_intersect("hashes_a", "hashes_b")).cast("long")
    met = _meet(pairs, sets).select("a", "b", both.alias("i"), (F.size("hashes_a") + F.size("hashes_b")).cast("long").alias("s"))
    return met.filter(F.lit(den) * F.col("i") >= F.lit(num) * (F.col("s") - F.col("i"))).select("a", "b")


def connect(links: DataFrame, tag: str = "cc") -> DataFrame:
    """node, component (smallest node) of all nodes of the links a, b.

    Each step takes the smallest label among the neighbours' and then the label's own label, so
    labels travel twice as far each time.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{tag}-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), f"{tag}-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        onward = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = step.join(onward, "component").select("node", F.least("component", "further").alias("component"), "was")
        step = materialize(step, f"{tag}-step")
        labels = step.select("node", "component")
        if step.filter(F.col("was") != F.col("component")).isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after the links a, b: components are the nodes of a smaller graph."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = materialize(ends, "ends")
    joined = connect(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("now"))
    seen = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("component")), F.struct(F.col("b").alias("node"), F.col("cb").alias("component")))).alias("x")).select("x.*")
    every = labels.select("node", "component").union(seen).distinct()
    return materialize(every.join(joined, "component", "left").select("node", F.coalesce("now", "component").alias("component")), "labels")


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100, leaders: int = 512, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text; others are ignored).

    Two documents are linked if den * |A and B| >= num * |A or B| for their sets of k-word shingles
    (words lower-cased in A-Z; fewer words than k: the whole sequence).  component_id is the
    smallest doc_id that links reach; kept marks that document.

    Null text and text without words: n_shingles 0, linked with nothing.  Null doc_id: component_id
    null, kept; it links nothing.  Repeated rows: each gets its own output row.  Empty table: empty
    result.
    """
    return grouped_rows(docs, k, num, den, leaders, part).drop("text_hash", "group")


def grouped_rows(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100, leaders: int = 512, part: int = PART) -> DataFrame:
    """near_duplicates() with text_hash and group, which tell apart documents of one doc_id and their components.

    group is null where a row is linked with nothing by rule: no words, or no doc_id.
    """
    with scratch(docs.sparkSession) as written:
        groups = materialize(_groups(docs, k, num, den, leaders, part), "groups")
        written.pop()
    return groups


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_hash of the one document of each group that stays: the smallest doc_id, then text_hash.

    Documents without words are groups of their own; rows without doc_id aren't listed.
    """
    rows = grouped_rows(docs, k, num, den).filter("doc_id IS NOT NULL")
    first = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    return first.unionByName(rows.filter("group IS NULL").select("doc_id", "text_hash")).distinct()


def _groups(docs: DataFrame, k: int, num: int, den: int, leaders: int, part: int) -> DataFrame:
    sketches = materialize(sketch(docs, k), "sketch")
    usable = sketches.filter(F.col("registers").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", F.posexplode(band_keys()).alias("nth", "band"))
    shared = members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialize(members.join(shared, "band"), "members")
    # how many others a class meets in all its bands: the text that many copies were made from meets most
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    nodes = materialize(classes.join(weights, "node").select("node", "doc_id", "n", "registers", "weight"), "nodes")
    known = nodes.select("node", "n", "weight")
    members = materialize(members.drop("size").join(known, "node"), "members")
    sets = full_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(nodes.select("doc_id").distinct(), "doc_id", "left_semi"), k)
    sets = materialize(sets.join(classes.select("set_id", "node").join(known.select("node"), "node", "left_semi"), "set_id").dropDuplicates(["node"]).select("node", "hashes"), "sets")

    hopeful = lambda pairs: _plausible(pairs.select("a", "b").distinct(), nodes, num, den)
    labels = components(members, sets, num, den, leaders, part, hopeful, hopeful)
    return rows_of(sketches.drop("registers"), classes, nodes, labels)


def rows_of(sketches: DataFrame, classes: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """sketches' doc_id, n_shingles and other columns, with component_id (smallest doc_id), kept and group, from the components of nodes."""
    named = nodes.select("node", "doc_id").join(labels, "node")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component", "component_id")
    reached = classes.select("set_id", "node", F.col("doc_id").alias("alone")).join(named, "node", "left").select("set_id", F.coalesce("component_id", "alone").alias("component_id"), F.coalesce("component", "node").alias("group"))
    rows = sketches.withColumn("set_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_id"))).join(reached, "set_id", "left").drop("set_id")
    rows = rows.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def components(members: DataFrame, sets: DataFrame, num: int, den: int, leaders: int, part: int, central_pairs: Callable[[DataFrame], DataFrame], small_pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, component of all nodes that links reach; a link joins two nodes that share a band and are similar on full sets.

    members: node, band, n (size of its set) and weight (how many it meets in all its bands), further columns
    for small_pairs; sets: node, hashes.  central_pairs and small_pairs may drop pairs a, b that can't be links before
    full sets meet; small_pairs gets a row for each small band of a pair, with members' columns of both, and gives each pair once.
    """
    # One candidate for each class: the most central class in any of its bands.
    central = members.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("top"))
    first = members.join(central, "band").groupBy(F.col("node").alias("b")).agg(F.max("top").alias("top")).select(F.col("top.node").alias("a"), "b").filter("a <> b")
    links = materialize(confirm(central_pairs(first), sets, num, den), "links")
    labels = connect(links)
    labels = _small_bands(members, labels, sets, num, den, small_pairs)
    held = materialize(_held(members, labels), "all-held")
    # one pivot for all bands whose most central class is of one component
    large = materialize(held.join(_mixed(held).filter(F.col("size") > SMALL).select("band"), "band", "left_semi"), "large")
    middle = large.select("node", "component", "weight").distinct().groupBy("component").agg(F.max(F.struct("weight", "node")).alias("middle"))
    tops = large.groupBy("band").agg(F.max(F.struct("weight", "node", "component")).alias("top")).select("band", F.col("top.component").alias("component"))
    tops = tops.join(middle, "component").select("band", F.col("middle.node").alias("pivot"))
    near = large.join(tops, "band").select(F.col("pivot").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    rivals = materialize(_differences(near, sets, num, den), "rivals")
    fresh = rivals.filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    if not fresh.isEmpty():
        labels = merged(labels, fresh)
    rivals = materialize(_sharing_extra(_placed(rivals, labels), num, den), "sharing")
    while True:
        fresh, rivals = _round(rivals, labels, num, den, leaders, part)
        if fresh.isEmpty():
            break
        labels = merged(labels, fresh)
    return labels


def _held(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _mixed(held: DataFrame) -> DataFrame:
    """Bands that hold two components or more, with their size."""
    return held.groupBy("band").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band", "size")


def sizes_fit(num: int, den: int) -> Column:
    return F.lit(den) * F.least("n_a", "n_b") >= F.lit(num) * F.greatest("n_a", "n_b")


def _small_bands(members: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int, small_pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """labels after testing all pairs of different components in bands of at most SMALL members."""
    held = materialize(_held(members, labels), "all-held")
    held = materialize(held.join(_mixed(held).filter(F.col("size") <= SMALL).select("band"), "band"), "held")
    side = lambda x: held.select("band", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in held.columns if c not in ("band", "node")))
    pairs = side("a").join(side("b"), "band").filter((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & sizes_fit(num, den))
    fresh = materialize(confirm(small_pairs(pairs), sets, num, den), "links")
    return labels if fresh.isEmpty() else merged(labels, fresh)


def _differences(near: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pivot, node, c, n (sizes), lacks, extra (counts), linked, and the shingles that only one of both has: missing, added."""
    lacks, extra = F.array_except("hashes_a", "hashes_b"), F.array_except("hashes_b", "hashes_a")
    met = _meet(near, sets).select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.size("hashes_a").cast("long").alias("c"), F.size("hashes_b").cast("long").alias("n"), lacks.alias("missing"), extra.alias("added"))
    met = met.withColumns({"lacks": F.size("missing").cast("long"), "extra": F.size("added").cast("long")})
    return met.withColumn("linked", F.lit(num + den) * (F.col("c") - F.col("lacks")) >= F.lit(num) * (F.col("c") + F.col("n")))


def _round(rivals: DataFrame, labels: DataFrame, num: int, den: int, leaders: int, part: int) -> tuple[DataFrame, DataFrame]:
    """Links between components that some leaders find, and the rivals that are left."""
    while True:
        live = _placed(rivals, labels)
        ranked = materialize(_ranked(materialize(_sharing(live, num, den), "live"), leaders, part), "ranked")
        if ranked.isEmpty():
            return ranked.select(F.col("pivot").alias("a"), F.col("node").alias("b")), ranked
        fresh = materialize(_leader_links(ranked, leaders, num, den, part), "links")
        rivals = ranked.filter(F.col("rank") > leaders).drop("rank", "parts")
        if not fresh.isEmpty():
            return fresh, rivals


def _placed(rivals: DataFrame, labels: DataFrame) -> DataFrame:
    """Rivals with their components now."""
    return rivals.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _shared(live: DataFrame, column: str, name: str) -> DataFrame:
    """pivot, node, the shingles in a column that members of other components share, and how often that is one who
    isn't linked with the pivot (apart) or, for those who aren't themselves, one who is (joined).

    One of a pair isn't linked with the pivot, so a linked one counts the former only.
    """
    each = live.select("pivot", "node", "component", "linked", F.explode(column).alias("x"))
    apart, joined = F.when(~F.col("linked"), F.col("component")), F.when(F.col("linked"), F.col("component"))
    who = each.groupBy("pivot", "x").agg(F.min(apart).alias("low"), F.max(apart).alias("high"), F.min(joined).alias("joined")).filter("low <> high OR low <> joined")
    from_apart = (F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))
    from_joined = ~F.col("linked") & F.coalesce(F.col("joined") != F.col("component"), F.lit(False))
    return each.join(who, ["pivot", "x"]).filter(from_apart | from_joined).groupBy("pivot", "node").agg(F.collect_list("x").alias(name), F.count_if(from_apart).alias("apart"), F.count_if(from_joined).alias("joined"))


def _sharing_extra(live: DataFrame, num: int, den: int) -> DataFrame:
    """Rivals whose added shingles leave a link possible, with diff: what they lack and what they add and share.

    At most all that A lacks is shared, so a link with B, who isn't linked with the pivot, takes
    (num + den) * (shared added ones) > num * (extra - lacks).
    """
    drops = live.groupBy("pivot").agg(F.max(F.col("linked") & (F.col("extra") < F.col("lacks"))).alias("drops"))
    df = live.join(_shared(live, "added", "kept"), ["pivot", "node"], "left").join(drops, "pivot").na.fill(0, ["apart", "joined"])
    enough = F.lit(num + den) * F.col("apart") > F.lit(num) * (F.col("extra") - F.col("lacks"))
    df = df.filter(enough | (~F.col("linked") & ((F.col("joined") > 0) | F.col("drops"))))
    return df.withColumn("diff", F.concat("missing", F.coalesce("kept", F.array().cast("array<bigint>")))).drop("apart", "joined", "drops", "kept", "missing", "added")


def _sharing(live: DataFrame, num: int, den: int) -> DataFrame:
    """Rivals that share enough differences with members of other components; diff keeps the shared ones."""
    df = live.drop("diff").join(_shared(live, "diff", "diff"), ["pivot", "node"])
    enough = F.lit(num + den) * F.col("apart") > F.lit(num) * F.col("extra") + F.lit(den) * F.col("lacks")
    return df.filter(enough | (F.col("joined") > 0)).drop("apart", "joined")


def _share_of(part: int) -> Column:
    return F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")


def _ranked(live: DataFrame, leaders: int, part: int) -> DataFrame:
    """live with parts (that its pivot's members are dealt in) and rank: 1 to leaders, and leaders + 1 for the rest.

    Leaders are members that aren't linked with the pivot.  Only the first of each task are ordered
    together: Spark applies such a limit on ranks before it moves rows.
    """
    live = live.join(live.groupBy("pivot").agg((F.floor(F.count("*") / part) + 1).cast("int").alias("parts")), "pivot")
    place = F.row_number().over(Window.partitionBy("pivot").orderBy("node"))
    first = live.filter(~F.col("linked")).select("pivot", "node", place.alias("rank")).filter(F.col("rank") <= leaders)
    return live.join(first, ["pivot", "node"], "left").withColumn("rank", F.coalesce("rank", F.lit(leaders + 1)))


_RIVALS = ["pivot", "part", "passes", "node", "component", "c", "n", "lacks", "diff"]


def _leader_links(ranked: DataFrame, leaders: int, num: int, den: int, part: int) -> DataFrame:
    """Links a, b of a pivot's leaders and members of other components, as many as join components.

    A task holds one pivot's leaders and streams a part's members past them.
    """
    lead = ranked.filter(F.col("rank") <= leaders).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("passes", F.lit(False))
    rest = ranked.withColumn("part", _share_of(part)).withColumn("passes", F.lit(True))
    dealt = lead.select(*_RIVALS).unionByName(rest.select(*_RIVALS)).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "passes", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        key, held, roots = None, [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot, part_, passes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            turn = np.flatnonzero((pivot[1:] != pivot[:-1]) | (part_[1:] != part_[:-1]) | (passes[1:] != passes[:-1])) + 1
            for a, b in zip([0, *turn], [*turn, len(pivot)], strict=True):
                if key != (pivot[a], part_[a]):
                    key, held, roots = (pivot[a], part_[a]), [], {}
                if not passes[a]:
                    held.append(_Rivals(batch.slice(a, b - a)))
                elif held:
                    if len(held) > 1:
                        held = [_Rivals.joined(held)]
                    for c in range(a, b, 64):
                        found = held[0].links(_Rivals(batch.slice(c, min(b, c + 64) - c)), num, den, roots)
                        if len(found):
                            yield common.batch_of(schema, [found[:, 0], found[:, 1]])

    return dealt.mapInArrow(run, "a long, b long")


class _Rivals:
    """Members of one pivot: numbers (node, component, c, n, lacks), and their differences in one array."""

    def __init__(self, batch: pa.RecordBatch | None = None):
        if batch is not None:
            self.numbers = np.stack([batch.column(i).to_numpy() for i in range(3, 8)], axis=1)
            self.diff = batch.column(8).flatten().to_numpy()
            self.owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(8).offsets.to_numpy()))

    @classmethod
    def joined(cls, parts: list[_Rivals]) -> _Rivals:
        out, before = cls(), np.cumsum([0, *(len(p.numbers) for p in parts)])
        out.numbers, out.diff = np.concatenate([p.numbers for p in parts]), np.concatenate([p.diff for p in parts])
        out.owner = np.concatenate([p.owner + n for p, n in zip(parts, before, strict=False)])
        return out

    def links(self, rest: _Rivals, num: int, den: int, roots: dict) -> np.ndarray:
        """Linked pairs (one of these, one of rest) that join components which roots has apart; roots is kept up."""
        if not hasattr(self, "order"):
            self.order = np.argsort(self.diff, kind="stable")
            self.sorted = self.diff[self.order]
        n, m = len(self.numbers), len(rest.numbers)
        shared = np.zeros(n * m, np.int64)
        for c in range(0, len(rest.diff), 512):  # each meets at most all leaders
            x, owner = rest.diff[c : c + 512], rest.owner[c : c + 512]
            lo, hi = np.searchsorted(self.sorted, x, "left"), np.searchsorted(self.sorted, x, "right")
            mine = self.owner[self.order[common.ragged(lo, hi - lo)]]
            shared += np.bincount(np.repeat(owner, hi - lo) * n + mine, minlength=n * m)
        (node, component, size, k, lacks), (node_, component_, _, k_, lacks_) = self.numbers.T[:, None, :], rest.numbers.T[:, :, None]
        both = size - lacks - lacks_ + shared.reshape(m, n)
        j, i = np.nonzero(((num + den) * both >= num * (k + k_)) & (component != component_))
        out = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = _root(roots, int(self.numbers[a, 1])), _root(roots, int(rest.numbers[b, 1]))
            if x != y:
                roots[x] = y
                out.append((self.numbers[a, 0], rest.numbers[b, 0]))
        return np.array(out, np.int64).reshape(-1, 2)


def _root(roots: dict, x: int) -> int:
    while (up := roots.get(x, x)) != x:
        roots[x] = roots.get(up, up)
        x = up
    return x


def _plausible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    return plausible(_meet(pairs, nodes.select("node", "n", "registers")).filter(sizes_fit(num, den)), num, den)
