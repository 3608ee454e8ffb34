"""Operator 7: substring dedup by suffix trees that are split over prefixes.

A window of 35 words that occurs twice is an inner node at depth 35 or more of the tree of all word
suffixes.  Its suffixes are split over prefixes of variable length, so that each group's subtree fits
in a task's memory:

* the first prefix is ten words long.  Of each window the ten-word run with the smallest hash among
  its 26 is taken, so equal windows take the same run at the same offset and about 2 in 27 runs
  travel.  Windows whose run occurs once are leaves and leave the job (an exact filter: no equal);
* windows that share a repeated run are a group.  They travel as one stretch of text for each
  occurrence of the run, words and all.  A group's task sorts the suffixes that begin its windows and
  takes common prefixes of neighbours: neighbours that share 35 words are under one deep inner node.
  Words are compared, not hashes;
* a run whose stretches are more text than a task should hold is split at the longest prefix: its windows
  are groups of their own, all whose 35 words have one hash, and stream through a task that compares words and
  keeps one row for each different window.  Windows of a chunk of texts that have the same words are known to
  repeat; one of them bears witness to the others, which are dealt by row without words, so a
  passage that many texts share sends its words once for each chunk.

Texts that other rows have whole are found first, by 128 bits of the text: one row stands for them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, Words, batch_of, chunks, materialize, ragged, scratch, texts_of

WINDOW, RUN = 35, 10
BUDGET = 1 << 23  # bytes of text whose suffixes one task sorts
FEW_KEYS = 1_000_000  # runs with more occurrences, up to which they are broadcast
_KEYS = pa.schema([("key", pa.int64()), ("row_id", pa.int64()), ("pos", pa.int32()), ("bytes", pa.int64()), ("known", pa.int8())])
_KEYS_DDL = "key long, row_id long, pos int, bytes long, known byte"


def chosen_runs(words: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, the run (its first word) that each chooses, and its hash."""
    n = np.maximum(words.counts - window + 1, 0)
    at = ragged(words.first[:-1], n)
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    total = len(words.hashes)
    rolling = Rolling(words.hashes)
    begin = np.arange(total - run + 1)
    h = rolling.slices(begin, begin + run)
    best, width, among = begin, 1, window - run + 1
    while width < among:  # the rightmost smallest of runs i .. i + width - 1
        step = min(width, among - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(h[right] <= h[left], right, left)
        width += step
    picked = best[at]
    return at, picked, h[picked]


def _keyed(parts: list[tuple]) -> pa.RecordBatch:
    """Rows (key, row_id, pos, bytes) of a batch; known: 0 alone in it, 1 the witness of several, 2 another of several."""
    key, row, pos, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 4
    key = key.view(np.int64) if key.dtype == np.uint64 else key
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    known = np.zeros(len(s), np.int8)
    known[:-1][same] = 1
    known[1:][same] = 2
    return batch_of(_KEYS, [s, row[order], pos[order].astype(np.int32), size[order], known])


def _repeated(keyed: DataFrame) -> DataFrame:
    """key, row_id, pos, bytes of keys that occur twice or more."""
    salt = F.when(F.col("known") == 2, F.pmod(F.xxhash64("row_id", "pos"), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
    n = F.count("*").over(Window.partitionBy("key", "salt"))
    return keyed.withColumn("salt", salt).withColumn("n", n).filter((F.col("known") > 0) | (F.col("n") > 1)).select("key", "row_id", "pos", "bytes")


def _places(runs: DataFrame, budget: int) -> DataFrame:
    """row_id, places: where its repeated runs begin, doubled, and one more if the run's stretches of text have over ``budget`` bytes."""
    deep = materialize(runs.groupBy("key").agg(F.sum("bytes").alias("n")).filter(F.col("n") > budget).select("key", F.lit(1).alias("deep")), "deep")
    deep = F.broadcast(deep) if deep.limit(FEW_KEYS + 1).count() <= FEW_KEYS else deep
    at = F.col("pos") * 2 + F.coalesce("deep", F.lit(0))
    return runs.join(deep, "key", "left").groupBy("row_id").agg(F.collect_list(at).alias("places"))


def _prefixes(window: int, run: int):
    def go(batches):
        for batch in batches:
            texts, ids = texts_of(batch), batch.column(0).to_numpy()
            parts = []
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                at, picked, h = chosen_runs(words, window, run)
                if len(picked):
                    fresh = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
                    last = np.append(fresh[1:], len(picked)) - 1  # the last window that took the run
                    size = words.ends[at[last] + window - 1] - words.starts[at[fresh]]
                    picked, h = picked[fresh], h[fresh]
                    owner = words.owner()[picked]
                    parts.append((h, ids[a:b][owner], picked - words.first[owner], size))
            yield _keyed(parts)

    return go


# Stretches of a short prefix (n windows, all their words) and windows of the longest one (words of all but those that are
# known to equal another of their batch).
_GROUPED = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("row_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("known", pa.int8()), ("words", pa.binary())])
_GROUPED_DDL = "key long, key2 long, row_id long, pos int, n int, known byte, words binary"


def _windows(window: int, run: int):
    def go(batches):
        for batch in batches:
            # copies of a text that another row stands for repeat anyway; one row bears witness
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(2)), pc.not_equal(pc.fill_null(batch.column(3), 0), 1)))
            texts, ids, places = texts_of(batch), batch.column(0).to_numpy(), batch.column(2)
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                at, picked, h = chosen_runs(words, window, run)
                part = places.slice(a, b - a)
                found, sizes = part.flatten().to_numpy(), np.diff(part.offsets.to_numpy())
                shared = np.zeros(len(words.hashes), np.int8)
                shared[(found >> 1) + np.repeat(words.first[:-1], sizes)] = 1 + (found & 1)
                owner = words.owner()
                # windows that took one run follow one another
                near = np.flatnonzero(shared[picked] == 1)
                if len(near):
                    fresh = np.flatnonzero(np.concatenate([[True], (picked[near[1:]] != picked[near[:-1]])]))
                    first, n = near[fresh], np.diff(np.append(fresh, len(near)))
                    begin = at[first]
                    one = b" ".join(words.buf.split()) + b" "  # all words, one space after each
                    upto = np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])
                    text = [one[i : j - 1] for i, j in zip(upto[begin].tolist(), upto[begin + n + window - 1].tolist(), strict=True)]
                    zero = np.zeros(len(first), np.int64)
                    yield batch_of(_GROUPED, [h[first].view(np.int64), zero, ids[a:b][owner[begin]], (begin - words.first[owner[begin]]).astype(np.int32), n.astype(np.int32), np.full(len(first), -1, np.int8), pa.array(text, pa.binary())])
                far = at[shared[picked] == 2]
                if len(far):
                    keys = (Rolling(x).slices(far, far + window).view(np.int64) for x in (words.hashes, words.other_hashes()))
                    one = b" ".join(words.buf.split()) + b" "
                    upto = np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])
                    yield _deep(*keys, ids[a:b][owner[far]], far - words.first[owner[far]], [one[i : j - 1] for i, j in zip(upto[far].tolist(), upto[far + window].tolist(), strict=True)])

    return go


def _deep(key: np.ndarray, key2: np.ndarray, row: np.ndarray, pos: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
    """Windows of the longest prefix; known: 0 alone in the chunk, 1 the witness of several, 2 another, whose words equal the witness's."""
    witness: dict[bytes, int] = {}
    first = np.fromiter((witness.setdefault(w, i) for i, w in enumerate(words)), np.int64, len(words))
    known = np.where(first < np.arange(len(words)), 2, 0).astype(np.int8)
    known[first[known == 2]] = 1
    return batch_of(_GROUPED, [key, key2, row, pos.astype(np.int32), np.ones(len(key), np.int32), known, pa.array([None if k == 2 else w for k, w in zip(known, words, strict=True)], pa.binary())])


def equal_suffixes(codes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether the ``window`` codes from each start also begin at another start.

    Suffixes are sorted by their first ``window`` codes; one whose neighbour has them all in common is
    under a deep inner node of their tree.
    """
    if not len(starts):
        return np.zeros(0, bool)
    bits = max(1, int(codes.max()).bit_length())
    per = min(window, 63 // bits)
    packed = codes[: len(codes) - per + 1].astype(np.int64)
    for j in range(1, per):
        packed = (packed << bits) | codes[j : len(codes) - per + 1 + j]
    keys = [packed[starts + i] for i in [*range(0, window - per, per), window - per]]
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order) - 1, bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


_NODES = pa.schema([("row_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])


def _subtrees(window: int):
    """Windows that repeat, as runs of n that follow one another, of whole groups that come sorted by their keys."""

    def stretches(rows: pa.RecordBatch) -> pa.RecordBatch:
        words, n = rows.column("words"), rows.column("n").to_numpy().astype(np.int64)
        raw = b" ".join(words.to_pylist()) + b" "
        ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        each = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        codes = each.dictionary_encode().indices.to_numpy()
        size = n + window - 1
        found = equal_suffixes(codes, ragged(np.cumsum(size) - size, n), window)
        head = np.zeros(len(found), bool)
        head[np.cumsum(n) - n] = True
        before = np.concatenate([[False], found[:-1]])
        first = np.flatnonzero(found & (head | ~before))
        after = np.concatenate([found[1:] & ~head[1:], [False]])
        last = np.flatnonzero(found & ~after)
        owner = np.searchsorted(np.cumsum(n), first, "right")
        begin = first - (np.cumsum(n) - n)[owner]
        return batch_of(_NODES, [rows.column("row_id").to_numpy()[owner], (rows.column("pos").to_numpy()[owner] + begin).astype(np.int32), (last - first + 1).astype(np.int32)])

    def go(batches):
        held: list[pa.RecordBatch] = []  # stretches of the groups that may go on
        at, seen = None, {}  # the windows' group, and for each sequence of words in it the row that waits for an equal
        for batch in batches:
            if not batch.num_rows:
                continue
            single = batch.column("known").to_numpy() >= 0
            windows, rows = batch.filter(pa.array(single)), batch.filter(pa.array(~single))
            if windows.num_rows:
                out = []
                for key, key2, row, pos, known, words in zip(*(windows.column(c).to_pylist() for c in ("key", "key2", "row_id", "pos", "known", "words")), strict=True):
                    if known == 2:
                        out.append((row, pos))
                        continue
                    if at != (key, key2):
                        at, seen = (key, key2), {}
                    if words in seen:
                        waits, seen[words] = seen[words], None
                        out += [(row, pos), *([waits] if waits else [])]
                    else:
                        seen[words] = None if known else (row, pos)
                        out += [(row, pos)] if known else []
                yield batch_of(_NODES, [*zip(*out, strict=True), [1] * len(out)] if out else [[], [], []])
            if rows.num_rows:
                key = rows.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if held and (cut or key[0] != held[-1].column("key")[-1].as_py()):
                    yield stretches(pa.concat_batches([*held, rows.slice(0, cut)]))
                    held = []
                elif cut:
                    yield stretches(rows.slice(0, cut))
                held.append(rows.slice(cut))
        if held:
            yield stretches(pa.concat_batches(held))

    return go


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _removed(window: int, with_text: bool):
    def go(batches):
        for batch in batches:
            texts, places, ids, copy = texts_of(batch), batch.column(2), batch.column(3), batch.column(4).is_valid().to_numpy(False)
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                n = words.counts
                part = places.slice(a, b - a)
                cover = np.zeros(len(words.hashes) + 1, np.int64)
                sizes = np.where(part.is_valid().to_numpy(False), np.diff(part.offsets.to_numpy()), 0)
                runs = part.flatten()
                at = runs.field(0).to_numpy() + np.repeat(words.first[:-1], sizes)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + runs.field(1).to_numpy() + window - 1, -1)
                whole = copy[a:b] & (n >= window)
                np.add.at(cover, words.first[:-1][whole], 1)
                np.add.at(cover, words.first[1:][whole], -1)
                gone = np.cumsum(cover[:-1]) > 0
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                kept = []
                for i in range(b - a):
                    found = texts[a + i].split()  # bytes split at the same white space as Words
                    if lost[i]:
                        found = [w for w, g in zip(found, gone[words.first[i] : words.first[i + 1]].tolist(), strict=True) if not g]
                    kept.append(b" ".join(found))
                yield batch_of(_OUT, [ids[a:b], n.astype(np.int64), lost.astype(np.int64), [hashlib.sha256(k).hexdigest() for k in kept], [k.decode() for k in kept] if with_text else pa.nulls(b - a, pa.string())])

    return go


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, with_text: bool = True, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of each row of docs (doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in the
    same text included.  kept_text joins the other words by one space (null unless with_text).
    ``budget`` bytes of text around a run of ``run`` words are sorted by one task; it doesn't change the result.

    docs must read the same each time (a scan, or materialize()'s result): rows are told apart by
    their place in it.  Null text has no words; null doc_id stays null; repeated rows repeat each
    other's windows, so their words all go if they have a window.  Very long texts: whole, in memory of one task.
    Ties (equal windows): all of them go.  Empty table: empty result.
    """
    if not 0 < run <= window:
        raise ValueError("0 < run <= window")
    with scratch(docs.sparkSession) as written:
        out = materialize(_removal(docs, window, run, with_text, budget), "kept")
        written.pop()
    return out


def _removal(docs: DataFrame, window: int, run: int, with_text: bool, budget: int) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    runs = materialize(_repeated(rows.select("row_id", "text").mapInArrow(_prefixes(window, run), _KEYS_DDL)), "runs")
    copies = _copies(rows, window)
    # both joins deal rows by row_id with the same columns, so the texts move once
    held = rows.join(_places(runs, budget), "row_id", "left").join(copies, "row_id", "left").select("row_id", "text", "places", "copy", "doc_id")
    grouped = held.mapInArrow(_windows(window, run), _GROUPED_DDL)
    grouped = grouped.withColumn("share", F.when(F.col("known") == 2, F.pmod(F.xxhash64("row_id", "pos"), F.lit(1 << 20)) + 1).otherwise(F.lit(0)))
    grouped = grouped.repartition("key", "key2", "share").sortWithinPartitions("key", "key2", "share").drop("share")
    nodes = grouped.mapInArrow(_subtrees(window), "row_id long, pos int, n int").groupBy("row_id").agg(F.collect_list(F.struct("pos", "n")).alias("places"))
    out = rows.join(nodes, "row_id", "left").join(copies, "row_id", "left").select("row_id", "text", "places", "doc_id", "copy")
    return out.mapInArrow(_removed(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def _copies(rows: DataFrame, window: int) -> DataFrame:
    """row_id and copy of rows whose whole text another row has: 0 for one of them, 1 for the others.

    Only of texts that are long enough for a window.
    """
    named = rows.filter(F.length("text") >= 2 * window - 1).select("row_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    several = named.groupBy("h", "g").agg(F.min("row_id").alias("one"), F.count("*").alias("n")).filter("n > 1")
    return named.join(several, ["h", "g"]).select("row_id", (F.col("row_id") != F.col("one")).cast("int").alias("copy"))
