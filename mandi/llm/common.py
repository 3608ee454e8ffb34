"""Helpers that several operators share: shared-folder tables and vectorised word hashing.

The numpy helpers work on a *chunk*: a few hundred documents joined into one byte buffer, so that
numpy's per-call cost is spread over many documents while arrays stay small.  They run inside
tasks; Spark decides which documents a task sees.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word, in every operator that counts words: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a single machine, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/mandi-tables"
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="mandi-")
    return _own_dirs[context.applicationId]


def named(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """df's row as one struct, ``row``, beside the columns in more: no name of df's can clash with ours."""
    return df.select(F.struct(*map(named, df.columns)).alias("row"), *(c.alias(n) for n, c in more.items()))


def unboxed(columns: list[str], **changed: Column) -> list[Column]:
    """The columns of a boxed row, with some of them changed."""
    return [changed.get(c, F.col("row").getField(c)).alias(c) for c in columns]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here.

    Every executor can read the files, so a lost executor costs no recomputation of what is above.
    """
    path = f"{shared_dir(df.sparkSession)}/mandi-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for written in _scopes:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that materialize() writes inside go at the end, but for those taken off the list."""
    written: list[str] = []
    _scopes.append(written)
    try:
        yield written
    finally:
        _scopes.pop()
        for path in written:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_hash() -> Column:
    """What tells rows of one doc_id apart: a hash of the text column (null text: a fixed value)."""
    return F.xxhash64(F.col("text").cast("string"))


def word_count(text: Column) -> Column:
    """Words of a text as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- numpy side

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64)
_OTHER_BYTES = np.random.default_rng(20_012).integers(1, 2**63, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15  # an odd multiplier


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """base**i modulo 2**64 for i = 0, 1, ...; grown when a longer run is asked for."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(max(n, 1 << 16), self.base % 2**64, np.uint64)
            steps[0] = 1
            self.known = np.cumprod(steps, dtype=np.uint64)
        return self.known[:n]


_up, _down = _Powers(_P), _Powers(pow(_P, -1, 2**64))


class Rolling:
    """Hashes of any slices of one sequence, equal for equal slices wherever they stand."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _up(len(values)), dtype=np.uint64, out=self.sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _down(len(self.sums))[starts])


class Words:
    """The words of a chunk of texts.

    buf: all bytes; starts, ends: byte span of each word; first: index of each text's first word,
    with the number of words at the end; hashes: a hash of each word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buf, self.lower = b" ".join(texts) + b" ", lower
        raw = np.frombuffer(self.buf, np.uint8)
        if lower:
            raw = _LOWER[raw]
        space = np.empty(len(raw) + 1, np.int8)
        space[0] = 1
        space[1:] = _SPACE[raw]
        turn = np.diff(space)
        self.starts, self.ends = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths + 1, out=self.offsets[1:])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.bytes = Rolling(_BYTES[raw])
        self.hashes = self.bytes.slices(self.starts, self.ends)

    def other_hashes(self) -> np.ndarray:
        """A second hash of each word, from other random numbers."""
        raw = np.frombuffer(self.buf, np.uint8)
        return Rolling(_OTHER_BYTES[_LOWER[raw] if self.lower else raw]).slices(self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """Text index of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each run of k words within one text.

        short: a text with fewer words, but some, gives its whole sequence as one run.
        """
        rolling = Rolling(self.hashes)
        n = np.maximum(self.counts - k + 1, 0)
        starts = ragged(self.first[:-1], n)
        hashes = rolling.slices(starts, starts + k)
        if short and (few := (self.counts > 0) & (self.counts < k)).any():
            at, size = self.first[:-1][few], self.counts[few]
            # another length is another kind of run
            extra = mix(rolling.slices(at, at + size) ^ size.astype(np.uint64))
            starts, hashes = np.concatenate([starts, at]), np.concatenate([hashes, extra])
        return starts, hashes


def ragged(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... for sizes[i] values each, joined."""
    total = int(sizes.sum())
    back = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=back[1:])
    return np.arange(total) + np.repeat(begin - back, sizes)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], docs: int = 256, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of at most docs texts and about size bytes; a longer text stands alone."""
    begin = used = 0
    for i, text in enumerate(texts):
        if i > begin and (i - begin >= docs or used + len(text) > size):
            yield begin, i
            begin, used = i, 0
        used += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def binary_array(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * rows.shape[1]
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])
