"""Operator 10: document fingerprints by locally consistent parsing.

A text is parsed into a hierarchy of phrases.  On each level runs of one symbol become one symbol;
then deterministic coin tossing labels each symbol by the lowest bit in which it differs from its
left neighbour, three times, which leaves eight labels and never equal neighbours; a phrase starts
at each local maximum of the labels.  A phrase's name is a hash of its content.  Where a phrase
starts depends on a few symbols around it only, so equal substrings have equal phrases in their
interior, wherever they stand.

A fingerprint has 64 slots of 16 bits: the smallest name of each slot among the phrases of levels 3
to 6 (about 30 to 800 characters).  Likeness is the share of equal slots among those that either
fills.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, batch_of, chunks, materialize, mix

SLOTS, LEVELS, FIRST = 64, 6, 3
_TOP = np.uint64(2**64 - 1)


def _lowest(d: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit; 0 for 0."""
    low = (d & (~d + np.uint64(1))).astype(np.float64)
    return np.maximum(np.frexp(low)[1] - 1, 0).astype(np.uint64)


def _toss(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A label of each value from the lowest bit in which it differs from its left neighbour."""
    left = np.empty_like(v)
    left[1:] = v[:-1]
    left[first] = ~v[first]
    k = _lowest(v ^ left)
    return (k << np.uint64(1)) | ((v >> k) & np.uint64(1))


def phrases(names: np.ndarray, bounds: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and bounds; bounds has the first symbol of each text, and the end."""
    total = len(names)
    if not total:
        return names, bounds
    head = np.zeros(total + 1, bool)
    head[bounds] = True
    head = head[:-1]
    # runs of one symbol
    new = head.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, total)).astype(np.uint64)
    names = np.where(size > 1, mix(names[at] ^ mix(size)), names[at])
    bounds = np.searchsorted(at, bounds)
    total = len(names)
    first = np.unique(bounds[:-1][bounds[:-1] < bounds[1:]])
    # labels, and phrases from one local maximum to the next
    label = names
    for _ in range(3):
        label = _toss(label, first)
    start = np.zeros(total, bool)
    start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.append(first[1:], total) - 1
    start[last] = False  # no right neighbour in its text
    start[first] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], total)
    out = mix(Rolling(names).slices(begin, end) ^ np.uint64(level))
    return out, np.searchsorted(begin, bounds)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of 64 slots for each text; an empty slot is 0."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=bounds[1:])
    names = mix(points.astype(np.uint64) + np.uint64(1))
    least = np.full(len(texts) * SLOTS, _TOP)
    for level in range(1, LEVELS + 1):
        names, bounds = phrases(names, bounds, level)
        if level >= FIRST:
            owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
            np.minimum.at(least, owner * SLOTS + (names & np.uint64(SLOTS - 1)).astype(np.int64), names >> np.uint64(6))
    # any 16 bits of the smallest name tell it from others; 0 is kept for empty
    slots = np.where(least == _TOP, np.uint64(0), mix(least) % np.uint64(65535) + np.uint64(1))
    return slots.astype(np.uint16).reshape(len(texts), SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those filled in either row; 1 for two empty fingerprints."""
    filled = (a > 0) | (b > 0)
    equal = filled & (a == b)
    n = filled.sum(axis=1)
    return np.where(n > 0, equal.sum(axis=1) / np.maximum(n, 1), 1.0)


def hexed(rows: np.ndarray) -> list[str]:
    data = rows.astype(">u2").tobytes().hex()
    width = 4 * rows.shape[1]
    return [data[i : i + width] for i in range(0, len(data), width)]


def edit(text: str, after: str) -> str:
    """text with its last half replaced by the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row of docs (doc_id, text).

    Null text is empty; an empty text has an empty fingerprint (all zeros).  Null doc_id and repeated
    rows are rows of their own.  Empty table: empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a in range(0, len(texts), 64):
                part = texts[a : a + 64]
                yield batch_of(schema, [batch.column(0).slice(a, 64), list(map(len, part)), hexed(fingerprints(part))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    """Rows come sorted in buckets; each bucket ends with guards, copies of the next bucket's first text."""
    waiting: list[tuple] = []  # (bucket, guard, doc_id, text); the last may lack its successor

    def out(rows: list[tuple], after: list[str]) -> pa.RecordBatch:
        texts, n = [r[3] for r in rows], len(rows)
        edited = [edit(t, x) for t, x in zip(texts, after, strict=True)]
        # successors are mostly the rows themselves, one on
        own = fingerprints([*texts, after[-1]])
        odd = [i for i in range(n - 1) if after[i] is not texts[i + 1]]
        follow = own[1:].copy()
        if odd:
            follow[odd] = fingerprints([after[i] for i in odd])
        changed = fingerprints(edited)
        return batch_of(_OUT, [[r[2] for r in rows], list(map(len, texts)), [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], hexed(own[:n]), hexed(changed), likeness(own[:n], changed), likeness(own[:n], follow)])

    def ready(last: bool):
        rows, after, size = [], [], 0
        for i, r in enumerate(waiting):
            follows = i + 1 < len(waiting) and waiting[i + 1][0] == r[0]
            if not follows and not last and i + 1 == len(waiting):
                break
            if not r[1]:
                rows.append(r)
                after.append(waiting[i + 1][3] if follows else r[3])
                size += len(r[3])
            if len(rows) == 64 or size > 1 << 18:
                yield out(rows, after)
                rows, after, size = [], [], 0
        if rows:
            yield out(rows, after)
        waiting[:] = [] if last else waiting[-1:]

    for batch in batches:
        waiting += zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
        yield from ready(False)
    yield from ready(True)


BUCKET_BYTES = 1 << 26  # text of a bucket, about
MOST_BUCKETS = 1_000_000  # cuts are broadcast, 17 bytes each; larger tables have larger buckets
MOST_REPEATED = 1_000_000  # keys that are broadcast; more are joined
_KEY = ["none", "id", "hash"]


def _order_keys(none: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(doc_id missing, doc_id, hash of the text) as 17 bytes that sort alike."""
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = none
    for at, x in ((1, ids), (9, hashes)):
        out[:, at : at + 8] = (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").reshape(-1)


def _alone(batches):
    """Rows (doc_id, text, times) that follow themselves, with the result of one and how often it counts."""
    schema = pa.schema([*_OUT, ("times", pa.int64())])
    for batch in batches:
        ids, texts, times = (batch.column(i).to_pylist() for i in range(3))
        for a, b in chunks([t.encode("utf-8", "surrogatepass") for t in texts], docs=64):
            edited = [edit(t, t) for t in texts[a:b]]
            own, changed = fingerprints(texts[a:b]), fingerprints(edited)
            yield batch_of(schema, [ids[a:b], list(map(len, texts[a:b])), [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], hexed(own), hexed(changed), likeness(own, changed), likeness(own, own), times[a:b]])


def _once(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows without repeats of a doc_id with its text, and those repeated with how many more of each there are (None: none)."""
    often = rows.groupBy(*_KEY).agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    n = often.limit(MOST_REPEATED + 1).count()
    if not n:
        return rows, None
    often = F.broadcast(often) if n <= MOST_REPEATED else often
    counted = rows.join(often, _KEY, "left_semi").groupBy(*_KEY, "doc_id", "text").agg(F.count("*").alias("times"))
    counted = materialize(counted, "repeated")
    single = rows.join(often, _KEY, "left_anti")
    return single.unionByName(counted.select(*rows.columns)), counted.filter("times > 1").select("doc_id", "text", (F.col("times") - 1).alias("times"))


def compare(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each row of docs (doc_id, text) with its edited text's fingerprint and the next document's likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next
    document's first ones; documents are in ascending order of doc_id, then of a hash of the text, then the text;
    null doc_ids come last; the first document follows the last.  A single document follows itself.  Null text is
    empty.  Repeated rows follow one another: all but the last follow themselves.  Very long texts: whole, in memory
    of one task.  Empty table: empty result.

    Documents are dealt to buckets of ranges of that order (each text moves once) and stream through
    sorted; a bucket also gets the first document of the next filled one.  Rows without doc_id, and different
    texts under one doc_id, lie at their hashes, so they spread over buckets like all others.  Rows that are equal
    altogether are counted, and one of them is dealt.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("hash"))
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    rows, repeated = _once(rows)
    # where each range of the list of keys begins: one row of metadata for each bucket
    listed = rows.select(*_KEY).repartitionByRange(min(buckets, MOST_BUCKETS), *_KEY)
    firsts = [r.first for r in listed.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*_KEY)).alias("first")).select("first").collect()]
    cuts = np.sort(_order_keys(*(np.array([r[i] for r in firsts], t) for i, t in enumerate((bool, np.int64, np.int64)))))
    shared = spark.sparkContext.broadcast(cuts)

    def bucket_of(none: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        at = np.searchsorted(shared.value, _order_keys(none.to_numpy(bool), ids.to_numpy(), hashes.to_numpy()), "right")
        return pd.Series(np.maximum(at - 1, 0).astype(np.int32))

    rows = rows.withColumn("bucket", F.pandas_udf(bucket_of, "int")(*_KEY))
    heads = sorted((r.bucket, *r.first) for r in rows.groupBy("bucket").agg(F.min(F.struct(*_KEY)).alias("first")).collect())
    guards = spark.createDataFrame([(heads[i - 1][0], *head) for i, (_, *head) in enumerate(heads)], "guards int, g_none boolean, g_id long, g_hash long")
    same = (F.col("none") == F.col("g_none")) & (F.col("id") == F.col("g_id")) & (F.col("hash") == F.col("g_hash"))
    after = rows.join(F.broadcast(guards), same).groupBy("guards").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"))
    both = rows.select("bucket", F.lit(False).alias("guard"), "doc_id", "text", "hash").unionByName(after.select(F.col("guards").alias("bucket"), F.lit(True).alias("guard"), "doc_id", "text", "hash"))
    dealt = both.repartitionById(max(1, len(cuts)), "bucket").sortWithinPartitions("bucket", "guard", F.col("doc_id").asc_nulls_last(), "hash", "text")
    out = dealt.select("bucket", "guard", "doc_id", "text").mapInArrow(_pairs, _OUT_DDL)
    if repeated is None:
        return out
    more = repeated.mapInArrow(_alone, f"{_OUT_DDL}, times long")
    return out.unionByName(more.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("nth", "times"))
