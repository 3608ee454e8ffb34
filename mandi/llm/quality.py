"""Operator 9: quality rules with adaptive thresholds from mergeable quantile sketches.

Fixed rules (too few words, too much repetition) reject first.  The rest is judged by rates per
document (symbols per word, letters per word, upper case, repeated lines, repeated words) against
thresholds learned for its language and source.

A sketch is a log-linear histogram of integers: 64 exact values and then 32 buckets for each power
of two, so a quantile is off by less than 1/32 of its value.  Sketches merge by adding counts, in
any order and with map-side combine; (language, source) sketches add up to language sketches, and
those to one for all.  A group with few documents takes the next level's.  A threshold is a fence
outside the middle half of the group, a multiple of its width away: a group without outliers loses
nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, batch_of, chunks, materialize, mix, text_hash, texts_of

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True
RUN = 8
# rate: numerator, denominator, scale, least distance from the middle half, whether low values fail too
RATES = {
    "symbol_rate": ("n_symbols", "n_words", 1000, 200, False),
    "word_length": ("word_chars", "n_words", 100, 200, True),
    "upper_rate": ("n_upper", "word_chars", 1000, 300, False),
    "mark_rate": ("n_marks", "n_words", 1000, 300, False),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000, 500, False),
    "repeat_rate": ("n_repeat_words", "n_words", 1000, 250, False),
}
WIDTHS = 6
ENOUGH = 200  # documents in a sketch


def counts(texts: list[bytes]) -> list[np.ndarray]:
    """The columns of _COUNTS for a chunk of texts."""
    w = Words(texts)
    n, raw, owner = len(texts), np.frombuffer(w.buf, np.uint8), w.owner()
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.offsets])  # noqa: E731  sums of byte flags by text
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = np.bincount(owner, points[w.ends] - points[w.starts], n).astype(np.int64)

    # words inside a run of 8 that the text has twice
    repeat = np.zeros(n, np.int64)
    starts, hashes = w.grams(RUN)
    if len(starts):
        keys = mix(hashes ^ mix(owner[starts].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        equal = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        cover = np.zeros(len(owner) + 1, np.int64)
        np.add.at(cover, starts[twice], 1)
        np.add.at(cover, np.minimum(starts[twice] + RUN, len(owner)), -1)
        repeat = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n)

    # lines that have a word and equal an earlier one
    breaks = np.flatnonzero(raw == 10)
    ends = np.union1d(breaks, w.offsets[1:] - 1)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    line_owner = np.searchsorted(w.offsets, begins, "right") - 1
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, begins)
    begins, ends, line_owner = begins[has], ends[has], line_owner[has]
    lines = np.bincount(line_owner, minlength=n)
    keys = mix(w.bytes.slices(begins, ends) ^ mix(line_owner.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    dup = lines - np.bincount(line_owner[first], minlength=n)
    return [w.counts, chars, per(_SYMBOL[raw]), dup, repeat, lines, per((raw >= 65) & (raw <= 90)), per(_MARK[raw])]


def measure(docs: DataFrame) -> DataFrame:
    """docs' doc_id, text_hash, lang, source and the counts of each text (null text: none)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lang", pa.string()), ("source", pa.string())] + [(c, pa.int64()) for c in _COUNTS])

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            for a, b in chunks(texts):
                part = batch.slice(a, b - a)
                yield batch_of(schema, [*part.columns[:4], *(np.asarray(x, np.int64) for x in counts(texts[a:b]))])

    text = lambda c: F.col(c).cast("string").alias(c)
    ddl = "doc_id long, text_hash long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), text("lang"), text("source"), text("text")).mapInArrow(run, ddl)


def bucket(v: Column) -> Column:
    """The smallest value in the sketch bucket of a long of 0 or more."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(rates: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of each rate: by, metric, bucket, n."""
    named = [F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in RATES]
    return rates.select(*by, F.explode(F.array(*named)).alias("x")).groupBy(*by, "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], qs: dict[str, float]) -> DataFrame:
    """by, metric, total and a column for each quantile."""
    w = Window.partitionBy(*by, "metric")
    run = sketch.select("*", F.sum("n").over(w).alias("total"), F.sum("n").over(w.orderBy("bucket")).alias("upto"))
    return run.groupBy(*by, "metric").agg(F.max("total").alias("total"), *(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket"))).alias(name) for name, q in qs.items()))


def fences(rates: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """lang, source, and the lowest and highest value that passes for each rate; a group of fewer than ``enough`` documents has the next level's."""
    fine = materialize(sketches(rates, ["lang", "source"]), "sketches")
    levels = [fine, merge(fine, ["lang"]), merge(fine, [])]
    qs = {"low": 0.25, "high": 0.75}
    own, lang, all_ = (quantiles(s, by, qs).select(*by, "metric", *(F.col(c).alias(f"{c}_{i}") for c in ("total", *qs))) for i, (s, by) in enumerate(zip(levels, (["lang", "source"], ["lang"], []), strict=True)))
    lang = lang.withColumnRenamed("lang", "lang_").withColumnRenamed("metric", "metric_")
    each = own.join(lang, own.lang.eqNullSafe(lang.lang_) & (own.metric == lang.metric_)).drop("lang_", "metric_").join(all_, "metric")
    pick = lambda c: F.when(F.col("total_0") >= enough, F.col(f"{c}_0")).when(F.col("total_1") >= enough, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    gap = F.greatest(WIDTHS * (pick("high") - pick("low")), F.element_at(F.create_map(*(x for m, r in RATES.items() for x in (F.lit(m), F.lit(r[3])))), F.col("metric")))
    each = each.select("lang", "source", "metric", (pick("low") - gap).alias("least"), (pick("high") + gap).alias("most"))
    return each.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in RATES for c in ("least", "most")))


def judge(docs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """doc_id, text_hash, lang, source, the counts, base_failed, kept and failed_rates of each row of docs.

    enough: how many documents a (language, source) group needs for thresholds of its own; smaller ones take their
    language's, and those of a smaller language the whole table's.  text_hash is xxhash64 of the text.

    Null text has no words and fails.  Null lang or source is a group of its own.  Null doc_id and
    repeated rows are judged like others.  Very long texts are counted whole, in memory of one task.  Ties: a value on
    a fence passes.  Empty table: empty result.
    """
    counted = measure(docs)
    # 0 / 0 is a rate of 0
    rate = {m: F.when(F.col(b) > 0, (F.col(a) * scale / F.col(b)).cast("long")).otherwise(F.lit(0).cast("long")) for m, (a, b, scale, _, _) in RATES.items()}
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rated = materialize(counted.withColumns(rate).withColumn("base_failed", failed), "rates")
    bounds = fences(rated.filter(~F.col("base_failed")), enough).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    out = rated.join(bounds, rated.lang.eqNullSafe(bounds.lang_) & rated.source.eqNullSafe(bounds.source_), "left")
    wrong = [F.when((F.col(m) > F.col(f"{m}_most")) | (F.lit(r[4]) & (F.col(m) < F.col(f"{m}_least"))), F.lit(m)) for m, r in RATES.items()]
    out = out.withColumn("failed_rates", F.array_compact(F.array(*wrong)))
    return out.select("doc_id", "text_hash", "lang", "source", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed_rates") == 0)).alias("kept"), "failed_rates")
