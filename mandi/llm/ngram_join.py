"""Operator 11: Jaccard join of documents by word n-grams, as a blocked sparse product of the incidence matrix.

Rows of the matrix are documents (one for each different set), columns are n-grams, and entry (a, b) of
the matrix times its transpose is the overlap of a and b.  Columns are put in one order, rare ones first, and
cut for each document into two blocks whose bounds follow from its size n and the threshold t:

* the *head*, its first n - ceil(t n) + 1 columns.  Linked documents share a column of their heads: else the
  one whose head ends first shares with the other only columns after it, fewer than ceil(t n);
* the *rest*, ceil(t n) - 1 columns.

The product of the heads comes first.  A pair with c common columns in its heads has an overlap of at most
c plus the larger of both rests, and a link needs an overlap of t / (1 + t) times both sizes: pairs below that
bound, or whose sizes differ too much, are dropped with no other column read.  The others take the product of
all columns, on full sets, and are judged exactly.

Columns that many documents hold would make the product dense.  They are cut by classes of size (linked
documents are in the same or the next), and what is still held by more than 16 is multiplied as
differences from a pivot row, which is a sparse product again (see ``minhash.components``): so copies of one
text cost their number, not its square, and no pair that shares a column is left out.

The order of columns takes counts of all n-grams in a table of fixed size, indexed by hash.  It decides how
much work there is, never the result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, minhash
from .common import chunks, materialize, scratch, texts_of

BITS = 20  # the table of counts has 2**BITS entries of two bytes in a task
SLICE = 1 << 14  # entries that move as one row
MOST_IDS = 1_000_000  # ids that are broadcast to pick the texts whose full sets are needed; more are joined
SALTS = 64  # tasks' tables are first added up in this many groups a slice
_FIRST = "doc_id long, n_shingles long, set_id binary, slice int, counts binary"
_PASS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])


def head_sizes(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many columns the head of a set of n has."""
    return np.where(n > 0, n + num * -n // den + 1, 0)


def _first_pass(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """A row (doc_id, n_shingles, set_id) for each document, and rows (slice, counts) of each task's n-grams by hash."""

    def run(batches):
        table = np.zeros(1 << bits, np.int64)
        for batch in batches:
            texts, ids = texts_of(batch), batch.column(0)
            for a, b in chunks(texts):
                values, bounds = minhash.shingle_sets(texts[a:b], k)
                np.add.at(table, (values & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
                yield common.batch_of(_PASS, [ids[a:b], np.diff(bounds), common.binary_array(minhash.set_ids(values, bounds)), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())])
        if table.any():
            packed = np.minimum(table, 2**16 - 1).astype(np.uint16).reshape(-1, min(SLICE, 1 << bits))
            n = len(packed)
            yield common.batch_of(_PASS, [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), np.arange(n, dtype=np.int32), common.binary_array(packed)])

    return docs.mapInArrow(run, _FIRST)


def _added(slices: DataFrame, keys: list[str]) -> DataFrame:
    """slices with the counts of equal keys added up, at most 2**32 - 1 each: a task holds one sum."""
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
    dealt = slices.repartition(*keys).sortWithinPartitions(*keys).select("slice", F.concat_ws(",", *keys).alias("key"), "width", "counts")

    def run(batches):
        at = key = total = None
        for batch in batches:
            for s, name, width, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                value = np.frombuffer(counts, f"u{width}").astype(np.uint64)
                if name == key:
                    total += value
                    continue
                if key is not None:
                    yield common.batch_of(schema, [[at], common.binary_array(np.minimum(total, 2**32 - 1).astype(np.uint32)[None])])
                at, key, total = s, name, value
        if key is not None:
            yield common.batch_of(schema, [[at], common.binary_array(np.minimum(total, 2**32 - 1).astype(np.uint32)[None])])

    return dealt.mapInArrow(run, "slice int, counts binary")


def _frequencies(first: DataFrame, bits: int) -> np.ndarray:
    """How many n-grams of all documents have each hash: a table of fixed size."""
    slices = first.filter("slice IS NOT NULL").select("slice", F.lit(2).alias("width"), "counts", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    once = _added(slices, ["slice", "salt"]).select("slice", F.lit(4).alias("width"), "counts")
    table = np.zeros((max(1, (1 << bits) // SLICE), min(SLICE, 1 << bits)), np.uint32)
    for row in _added(once, ["slice"]).collect():  # as many rows as the table has slices
        table[row.slice] = np.frombuffer(row.counts, np.uint32)
    return table.reshape(-1)


def _heads(docs: DataFrame, k: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """doc_id, set_id and the head's columns of each document: its rarest n-grams by the table of counts."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("doc_id", pa.int64()), ("set_id", pa.binary()), ("head", pa.list_(pa.int64()))])

    def run(batches):
        table = shared.value
        for batch in batches:
            texts, ids = texts_of(batch), batch.column(0)
            for a, b in chunks(texts):
                values, bounds = minhash.shingle_sets(texts[a:b], k)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(b - a), n)
                order = np.lexsort((values, table[(values & np.uint64(len(table) - 1)).astype(np.int64)], owner))
                place = np.arange(len(values)) - np.repeat(bounds[:-1], n)
                sizes = head_sizes(n, num, den)
                head = values[order[place < np.repeat(sizes, n)]].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(head))
                yield common.batch_of(schema, [ids[a:b], common.binary_array(minhash.set_ids(values, bounds)), lists])

    return docs.mapInArrow(run, "doc_id long, set_id binary, head array<bigint>")


def _by_size(members: DataFrame, num: int, den: int) -> DataFrame:
    """members with the columns that many hold cut by classes of size: a document is in its own class and the next.

    Linked sizes differ by a factor of at most den / num, so linked documents meet in the larger one's class at least.
    The classes are a little wider than that factor, for rounding.
    """
    step = log(den / num) + 1e-6
    own = F.floor(F.ln(F.col("n").cast("double")) / step).cast("int")
    classes = F.when(F.col("size") > minhash.SMALL, F.array(own, own + 1)).otherwise(F.array(F.lit(-1)))
    cut = members.withColumn("class", F.explode(classes))
    keyed = cut.withColumn("band", F.xxhash64("column", "class"))
    sizes = keyed.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    return keyed.drop("size", "class").join(sizes, "band")


def _overlaps(num: int, den: int) -> Callable[[DataFrame], DataFrame]:
    """The product of heads over columns that few hold: pairs whose overlap can still be enough.

    A pair that shares a column which many hold meets there, so here it has none beyond those counted.
    """

    def product(pairs: DataFrame) -> DataFrame:
        counted = pairs.groupBy("a", "b").agg(F.count_distinct("column_a").alias("c"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
        rest = lambda n: F.ceil(F.lit(num) * n / den) - 1
        most = F.col("c") + F.greatest(rest(F.col("n_a")), rest(F.col("n_b")))
        return counted.filter(F.lit(num + den) * most >= F.lit(num) * (F.col("n_a") + F.col("n_b"))).select("a", "b")

    return product


def _within_reach(members: DataFrame, num: int, den: int) -> DataFrame:
    """node of members that a link may have: in a pair that the product of heads leaves, or in a band that many hold."""
    few = members.filter(F.col("size") <= minhash.SMALL)
    side = lambda x: few.select("band", *(F.col(c).alias(f"{c}_{x}") for c in ("n", "column")), F.col("node").alias(x))
    pairs = side("a").join(side("b"), "band").filter((F.col("a") < F.col("b")) & minhash.sizes_fit(num, den))
    left = _overlaps(num, den)(pairs).select(F.explode(F.array("a", "b")).alias("node"))
    return left.union(members.filter(F.col("size") > minhash.SMALL).select("node")).distinct()


def jaccard_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, bits: int = BITS, leaders: int = 512, part: int = minhash.PART) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text; others are ignored).

    Two documents are linked if den * |A and B| >= num * |A or B| for their sets of k-word shingles
    (words lower-cased in A-Z; fewer words than k: the whole sequence).  component_id is the
    smallest doc_id that links reach; kept marks that document.  Links aren't counted: a group of
    copies has the square of its size.

    Null text and text without words: n_shingles 0, linked with nothing.  Null doc_id: component_id
    null, kept; it links nothing.  Repeated rows: each gets its own output row.  Very long texts: whole sets, in
    memory of one task.  Ties (n-grams of one count): by hash; they change no result.  Empty table: empty result.
    """
    with scratch(docs.sparkSession) as written:
        joined = materialize(_joined(docs, k, num, den, bits, leaders, part), "joined")
        written.pop()
    return joined


def _joined(docs: DataFrame, k: int, num: int, den: int, bits: int, leaders: int, part: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = materialize(_first_pass(texts, k, bits), "first")
    sketches = first.filter("slice IS NULL").select("doc_id", "n_shingles", "set_id")
    usable = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # rows that repeat a document give one head
    heads = _heads(texts.filter("doc_id IS NOT NULL"), k, num, den, _frequencies(first, bits)).join(classes, ["doc_id", "set_id"]).dropDuplicates(["doc_id", "set_id"])
    columns = materialize(heads.select("node", F.col("n").cast("int").alias("n"), F.explode("head").alias("column")), "columns")
    shared = columns.groupBy("column").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialize(_by_size(materialize(columns.join(shared, "column"), "shared"), num, den), "bands")
    members = members.join(_within_reach(members, num, den), "node").drop("size")
    members = materialize(members, "reached")
    sizes = members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    weights = members.join(sizes, "band").groupBy("node").agg(F.sum("size").alias("weight"))
    nodes = materialize(classes.join(weights, "node").select("node", "set_id", "doc_id", "weight"), "nodes")
    members = materialize(members.join(nodes.select("node", "weight"), "node"), "members")
    ids = nodes.select("doc_id").distinct()
    held = texts.join(F.broadcast(ids) if nodes.count() <= MOST_IDS else ids, "doc_id", "left_semi")
    sets = minhash.full_sets(held, k).join(nodes.select("set_id", "node"), "set_id").dropDuplicates(["set_id"])
    sets = materialize(sets.select("node", "hashes"), "sets")
    labels = minhash.components(members, sets, num, den, leaders, part, lambda pairs: pairs, _overlaps(num, den))
    return minhash.rows_of(sketches, classes, nodes, labels).drop("group")
