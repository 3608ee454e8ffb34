"""Operator 13: periodic runs of words, by a sparse diagonal table.

A cell of the table is a word i and a lag p; it holds how many words up to i equal the words p before
them, and a diagonal (one lag, i growing) that ends long enough is a run of period p.  Of a word's
earlier occurrences only those count that can lie on such a diagonal, and there is one for each scale:

* a run of smallest period p and at least 4p words holds, for the scale g of 1, 2, 3, 4, 6, 8, 12, ...
  that comes first from 2p on (it is at most 3p), grams of g words whose occurrence before is in the run;
* the nearest earlier occurrence of such a gram is exactly p back: if it were nearer, at q, the gram would
  have the periods p and q with p + q <= g, so also their common divisor, and p were not the smallest.

So at each scale a gram ending at word i has one earlier occurrence, the nearest; it lengthens the
diagonal of its lag if the word before did the same and starts one otherwise, and where the lag changes
the diagonal is at its end and gives out its run.  Grams of a scale are named by pairs of names of the
scale below (exact, no hashing), and those that occur once in their text have no name: a text without
repeats is done after the first scales, and any text takes n log n steps, however frequent its words.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import boxed, chunks, texts_of, unboxed

LEAST, TIMES = 6, 4  # a run has at least LEAST words and TIMES of its periods
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_codes(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text; a code for each word, equal for equal words of one text only; bounds by text."""
    words = [t.split() for t in texts]  # bytes split at ASCII white space
    bounds = np.cumsum([0, *map(len, words)])
    place = count()
    codes = np.fromiter(chain.from_iterable(map({}.setdefault, ws, place) for ws in words if ws), np.int64, int(bounds[-1]))
    return words, codes, bounds


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names by place (-1: none) of keys at places that occur twice or more, and the place of each one's nearest earlier equal (-1: none)."""
    names, before = np.full(n, -1), np.full(n, -1)
    if not len(at):
        return names, before
    order = np.argsort(keys, kind="stable")  # places ascend within equal keys
    keys, at = keys[order], at[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(new) - 1
    again = ~new
    before[at[again]] = at[np.flatnonzero(again) - 1]
    often = np.bincount(group)[group] > 1
    names[at[often]] = group[often]
    return names, before


def _longer(names: np.ndarray, back: int, tail: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and nearest earlier places of the grams that end at i: the gram of names at i - back, then that of tail at i."""
    at = np.flatnonzero(tail[back:] >= 0) + back if back < len(tail) else np.empty(0, np.int64)
    at = at[(names[at - back] >= 0) & (owner[at - back] == owner[at])]
    return _named(names[at - back] * (len(tail) + 1) + tail[at], at, len(tail))


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    codes of different texts must differ.  times must be 4 or more (the scales rest on it).
    """
    n, found = len(codes), []
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = bounds[:-1][owner]

    def emit(before: np.ndarray, g: int, periods: tuple[int, int]) -> None:
        """Runs of the diagonals of scale g with lags in periods (both ends included)."""
        at = np.flatnonzero(before >= 0)
        lag = at - before[at]
        fits = (lag >= periods[0]) & (lag <= periods[1])
        at, lag = at[fits], lag[fits]
        if not len(at):
            return
        # a diagonal goes on while the next word's lag is the same, in the same text
        turn = np.flatnonzero((np.diff(at) != 1) | (np.diff(lag) != 0) | (np.diff(owner[at]) != 0)) + 1
        begin, end = np.concatenate([[0], turn]), np.concatenate([turn, [len(at)]]) - 1
        period = lag[begin]
        start = at[begin] - g + 1 - period
        length = at[end] - start + 1
        long = length >= np.maximum(least, times * period)
        found.append(np.stack([owner[at[begin]], start - first[at[begin]], length, period], axis=1)[long])

    one, _ = _named(codes, np.arange(n), n)
    # names of grams of the two lengths that stand next: 2**k and 3 * 2**(k - 1)
    two, before = _longer(one, 1, one, owner)
    emit(before, 2, (1, 1))
    three, _ = _longer(one, 2, two, owner)
    g, smaller, larger = 2, two, three
    longest = int(np.diff(bounds).max(initial=0))
    while 8 * g <= 3 * longest and ((smaller >= 0).any() or (larger >= 0).any()):  # a run of period p has 4p words, and its scale is at most 3p
        # grams of g and 3g/2 words have names; the periods of scale g' are those whose double comes after the scale below
        smaller, before = _longer(smaller, g, smaller, owner)
        emit(before, 2 * g, (3 * g // 4 + 1, g))
        larger, before = _longer(larger, 3 * g // 2, larger, owner)
        emit(before, 3 * g, (g + 1, 3 * g // 2))
        g *= 2
    rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words without those that any run holds after its first period."""
    if not len(runs):
        return words
    deep = np.zeros(len(words) + 1, np.int64)
    np.add.at(deep, runs[:, 1] + runs[:, 3], 1)
    np.add.at(deep, runs[:, 1] + runs[:, 2], -1)
    return list(compress(words, (np.cumsum(deep)[:-1] == 0).tolist()))


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period), collapsed and its digest, for each row of docs (doc_id, text).

    A run is a stretch of words with smallest period p, at least max(least, times * p) of them, that no word
    beside it extends with that period.  collapsed is the text without the words that a run holds after its
    first period, joined by one space; with_text False leaves it null (the digest stays).

    Null and empty texts and texts without a word: no words, no runs, empty collapsed text.  Null doc_id:
    as any other.  Repeated rows: a row each.  Very long texts: whole, in memory of one task, n log n steps.
    Ties: runs of one start are told apart by period, and no two have both.  Empty table: empty result.
    Other columns of docs are ignored.
    """
    if times < 4:
        raise ValueError("a run must hold at least four periods")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.binary()), ("collapsed_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            texts, ids = texts_of(batch), batch.column(0)
            for a, b in chunks(texts):
                words, codes, bounds = word_codes(texts[a:b])
                rows = runs_of(codes, bounds, least, times)
                upto = np.searchsorted(rows[:, 0], np.arange(b - a + 1))
                kept = [b" ".join(_collapsed(w, rows[x:y])) for w, x, y in zip(words, upto[:-1], upto[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)], ["start", "length", "period"]))
                digests = [hashlib.sha256(k).hexdigest() for k in kept]
                yield common.batch_of(out, [ids[a:b], np.diff(bounds), lists, kept if with_text else pa.nulls(b - a, pa.binary()), digests])

    ddl = f"doc_id long, n_words long, runs array<{RUN}>, collapsed binary, collapsed_sha256 string"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _stronger(a: Column, b: Column) -> Column:
    """b if it has the greater length / period (exactly), else a: the first of equals stays."""
    return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)


def digests(found: DataFrame) -> DataFrame:
    """Per row of find_runs: n_runs, the strongest run (nulls without one), and digests of runs and collapsed text."""
    df = found.withColumn("best", F.aggregate("runs", F.lit(None).cast(RUN), _stronger))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period")))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), "collapsed_sha256", "n_words")


def planted(docs: DataFrame) -> DataFrame:
    """docs with a tenth of the texts made periodic, chosen and cut by crc32 of the doc_id: the contract's planted runs.

    With h = crc32, g = h div 10, n words, a = g % n and p = 1 + (n - a) div (3 + g % 8): each word i >= a becomes
    word a + (i - a) % p, and words are joined by one space.  Texts without a word and rows without doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = boxed(docs, text=F.col("text").cast("string"), h=h, words=F.when(h % 10 == 0, words)).withColumns({"n": F.size("words").cast("long"), "g": F.expr("h div 10")})
    df = df.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    cut = F.expr("array_join(transform(sequence(0L, n - 1), i -> element_at(words, int(1 + if(i < a, i, a + (i - a) % p)))), ' ')")
    return df.select(*unboxed(docs.columns, text=F.when(F.col("n") > 0, cut).otherwise(F.col("text"))))
