"""Operator 5: language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1.  A three-letter run is the elementwise product
of its letters' vectors, the first rolled twice, the second once (so order counts).  A text is the
sum of its runs' vectors; a language prototype is the sum over its training texts.  A text gets the
language whose prototype has the largest cosine with it.

Training is an aggregate of partial sums (language, dimension, sum), one vector per language and
task, so a language with a third of all texts is summed where it is read.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DIM, CLASSES, SEED = 1024, 128, 4_111
MOST_RUNS = 32_768  # run vectors that a task keeps: at most 32768 * 1024 * 4 bytes, 128 MB
MOST_LANGUAGES = 4096  # prototypes sent to each task at once: at most 4096 * 1024 * 4 bytes, 16 MB
_OUT = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """Class of each code point: 0 for all but letters, a-z from 1, other letters spread over the rest."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            table[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % (CLASSES - 27)
    return table


class Profiles:
    """Vectors of three-letter runs, made when first met; the kept ones are forgotten when there are too many."""

    def __init__(self, dim: int = DIM, most: int = MOST_RUNS):
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (CLASSES, dim))
        self.first, self.second, self.third = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
        self.place, self.most = np.full(CLASSES**3, -1, np.int32), most
        self.rows, self.used = np.empty((1024, dim), np.float32), 0

    def codes(self, text: str) -> np.ndarray:
        """The code of each of the text's runs, in order."""
        letters = letter_classes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters = np.concatenate([[0], letters, [0]]).astype(np.int32)
        letters = letters[np.concatenate([[True], (letters[1:] > 0) | (letters[:-1] > 0)])]  # one gap between words
        if len(letters) < 3:
            return np.empty(0, np.int32)
        return (letters[:-2] * CLASSES + letters[1:-1]) * CLASSES + letters[2:]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        return self.first[codes // CLASSES**2] * self.second[codes // CLASSES % CLASSES] * self.third[codes % CLASSES]

    def vector(self, text: str) -> np.ndarray | None:
        """None for a text without a letter."""
        codes = self.codes(text)
        if not len(codes):
            return None
        at = self.place[codes]
        if (at < 0).any():
            new = np.unique(codes[at < 0])
            if self.used + len(new) > self.most:
                self.place.fill(-1)
                self.used, new = 0, np.unique(codes)
            if len(new) > self.most:  # more than are ever kept: bound block by block
                found, counts = np.unique(codes, return_counts=True)
                return sum(counts[i : i + 4096].astype(np.float32) @ self.bind(found[i : i + 4096]) for i in range(0, len(found), 4096))
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.place[new] = np.arange(self.used, self.used + len(new))
            self.rows[self.used : self.used + len(new)] = self.bind(new)
            self.used += len(new)
            at = self.place[codes]
        counts = np.bincount(at, minlength=1)
        found = np.flatnonzero(counts)
        return counts[found].astype(np.float32) @ self.rows[found]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's digits, modulo 5, is 0; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sums_of(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """lang and the sum of the vectors of its texts, as an array of i and x, from docs (text, lang); rows with a null are left out.

    Texts count with unit length each, so long ones don't outweigh the rest.
    """
    schema = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))])

    def run(batches):
        profiles, sums = Profiles(dim), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = profiles.vector(text)
                if v is not None:
                    total = sums.setdefault(lang, np.zeros(dim))
                    total += v / max(np.linalg.norm(v), 1e-9)
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]}, schema=schema)

    texts = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).dropna()
    parts = texts.mapInArrow(run, "lang string, vector array<double>")
    # rounded to whole units of 2**-20 first: sums don't depend on the order of the tasks
    sums = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * 2**20).cast("long")).alias("x"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("v"))


def prototypes(sums: DataFrame) -> dict[str, np.ndarray]:
    """Vectors of unit length by language, of sums_of(): the columns come as they are, with no object for a number."""
    table = sums.toArrow().combine_chunks()
    if not table.num_rows:
        return {}
    values = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).astype(float)
    unit = (values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return dict(sorted(zip(table.column("lang").to_pylist(), unit, strict=True), key=lambda kv: kv[0]))


def train(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototypes of all languages; for at most MOST_LANGUAGES of them."""
    return prototypes(sums_of(docs, dim).limit(MOST_LANGUAGES + 1))


def predict(docs: DataFrame, known: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine, 0 to 1) of each row of docs; only text decides."""
    langs = list(known)
    matrix = np.array([known[x] for x in langs], np.float32).reshape(len(langs), dim)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        profiles = Profiles(dim)
        for batch in batches:
            pred, score = [], []
            for text in batch.column(2).to_pylist():
                v = profiles.vector(text) if text and langs else None
                if v is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                cos = matrix @ v / max(float(np.linalg.norm(v)), sys.float_info.min)
                best = int(np.argmax(cos))
                pred.append(langs[best])
                score.append(float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=schema)

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def identify(docs: DataFrame, most: int = MOST_LANGUAGES) -> DataFrame:
    """Learn from the rows that aren't held out and predict all.

    Null text, or text without a letter: ``und`` with score 0.  Null lang: not learned from.
    Null doc_id: learned from like others.  No row to learn from: all ``und``.  Ties go to the
    language that sorts first.  Repeated rows count as often as they occur.  Very long texts are read whole.  Empty
    table: empty result.

    More than ``most`` languages are compared in blocks, and the best of the blocks counts; docs must
    then read the same each time.
    """
    sums = sums_of(docs.filter(~held_out(F.col("doc_id"))))
    known = prototypes(sums.limit(most + 1))
    if len(known) <= most:
        return predict(docs, known)
    sums = materialize(sums, "prototypes")
    names = sums.select("lang", F.floor((F.row_number().over(Window.orderBy("lang")) - 1) / most).alias("block"))  # names alone are ordered in one task
    names = materialize(names, "languages")
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row_id"))
    numbered, best = materialize(numbered, "numbered"), None
    for block in range(names.agg(F.max("block")).first()[0] + 1):
        own = sums.join(names.filter(F.col("block") == block).select("lang"), "lang", "left_semi")
        one = predict(numbered.select(F.col("row_id").alias("doc_id"), "text"), prototypes(own)).select(F.col("doc_id").alias("row_id"), F.struct(F.col("score"), F.lit(-block).alias("block"), F.col("lang_pred")).alias("x"))
        best = one if best is None else best.unionByName(one)
    best = best.groupBy("row_id").agg(F.max("x").alias("x"))
    return numbered.join(best, "row_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("x.lang_pred").alias("lang_pred"), F.col("x.score").alias("score"))
