"""Operator 4: packing documents into sequences by bounded-space online best fit.

A task keeps a fixed number of open windows.  A document's tokens go to the window with the least
room that still holds them; when none does, the fullest window is filled to the brim with a cut
from the document and emitted, which makes room to open another.  At the end of a partition its
open windows are left over, as pieces that carry their ids.  Left-over pieces are packed again in a
thirty-second of the partitions, and so on until one partition is left; it cuts its last windows
into sequences whose lengths are powers of two, so nothing is padded.

Only left-over pieces move (a fixed number of windows per partition); documents' tokens don't.
Each round is written to the shared folder, so ids and cuts are decided once.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ragged

LENGTH, WINDOWS, FAN_IN = 4096, 16, 32
EOS = 2
TOKENIZER = "word_bpe_49k.json"
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_SCHEMA = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# The rules under which a text's ids are those of its parts between ASCII white space.
# These normalisers join nothing across it, and every match of the split is free of it.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_spaces(rules: dict) -> bool:
    """Whether a tokenizer's definition is known to encode parts between ASCII white space on their own."""
    steps = lambda x, key: [] if not x else x[key] if x["type"] == "Sequence" else [x]
    normal, pre = steps(rules.get("normalizer"), "normalizers"), steps(rules.get("pre_tokenizer"), "pretokenizers")
    squeezed = [x for x in normal if x["type"] == "Replace"]
    return (
        [x["type"] for x in normal] == _NORMALIZERS and squeezed[0]["pattern"] == {"Regex": r"\s+"} and squeezed[0]["content"] == " "
        and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": _SPLIT} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
        and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"]) for x in rules.get("added_tokens", []))
        and not rules.get("post_processor") and not rules.get("truncation") and not rules.get("padding")
    )


_ASCII = re.compile(_SPLIT.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace("[[", "[").replace("]]", "]"))
# The letters' range holds capitals too: a piece is plain only if it is its own lower case.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+" + r"|[0-9]|[!-/:-@\[-`{-~]+|'(?:s|t|re|ve|m|ll|d)")
# Letters that are one code point in every form, and stay such in lower case; then a stop or comma.
_LATIN = re.compile("([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+)([.,]?)")


def pieces(part: str) -> list[str]:
    """A part cut where the tokenizer cuts it, as far as that is plain; a piece's ids don't depend on the others."""
    if part.isascii() and part.isprintable() and "<|" not in part:
        return _ASCII.findall(part.lower())
    found = _LATIN.fullmatch(part)
    return [found[1].lower(), found[2]] if found and found[2] else [found[1].lower()] if found else [part]


def byte_spelling() -> dict[int, str]:
    """How byte-level models spell a byte: visible Latin-1 as itself, the rest by code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)} | {b: chr(b) for b in shown}


class Encoder:
    """Token ids of texts, as uint32.

    Where the tokenizer's rules allow it, each different part between white space is encoded once,
    whole or cut into pieces, and texts are put together from their parts' ids by array lookups; any other
    tokenizer encodes whole texts.
    """

    def __init__(self, path: str, most: int = 800_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.by_part = splits_at_spaces(json.loads(self.tokenizer.to_str()))
        self._forget()

    def __call__(self, texts: pa.Array, size: int = 1 << 23) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of about ``size`` bytes: its first text, all ids with EOS after each text, and the texts' bounds."""
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size, "right")))
            ids, counts = (self._by_part if self.by_part else self._whole)(texts.slice(a, b - a))
            ends = np.cumsum(counts)
            bounds = np.concatenate([[0], ends + np.arange(1, b - a + 1)])
            yield a, np.insert(ids, ends, np.uint32(EOS)), bounds
            a = b

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._encode(texts.to_pylist())

    def _by_part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.ascii_split_whitespace(texts)
        named = parts.flatten().dictionary_encode()
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        places = self._places(named.dictionary.to_pylist())[named.indices.to_numpy()] if len(named) else np.empty(0, np.int64)
        sizes = self.sizes[places]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[ragged(self.begins[places], sizes)] if len(places) else np.empty(0, np.uint32), np.diff(upto[offsets])

    def _forget(self) -> None:
        self.known, self.ids_of = {}, {}
        self.ids, self.begins, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _places(self, parts: list[str]) -> np.ndarray:
        """Where begins and sizes have each part; unknown ones are learned."""
        if len(self.known) > self.most:
            self._forget()
        new = [p for p in parts if p not in self.known]
        if new:
            split = list(map(pieces, new))
            self._learn(set().union(*split).difference(self.ids_of))
            find = self.ids_of.__getitem__
            found = [find(xs[0]) if len(xs) == 1 else b"".join(map(find, xs)) for xs in split]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _learn(self, new: set[str]) -> None:
        tokenize, spelling = self.tokenizer.model.tokenize, byte_spelling()
        others = []
        for x in new:
            if _PLAIN.fullmatch(x) and x == x.lower():  # one piece in lower case: what the model gets is its bytes' spelling
                self.ids_of[x] = array("I", [t.id for t in tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(spelling))]).tobytes()
            else:
                others.append(x)
        for x, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.ids_of[x] = array("I", e.ids).tobytes()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The process's encoder: what one task has learned serves the next."""
    return Encoder(path)


class Packer:
    """Open windows of one task.  A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, task: int, length: int = LENGTH, windows: int = WINDOWS):
        self.length, self.windows = length, windows
        self.open: list[tuple[int, list]] = []  # room, pieces
        self.next = task << 32
        self.out: list[tuple] = []

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.length:
            self._emit([(doc_id, start, ids[: self.length], doc_tokens)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [(room, i) for i, (room, _) in enumerate(self.open) if room >= len(ids)]
            if fits:
                room, i = min(fits)
                self._put(i, (doc_id, start, ids, doc_tokens))
                return
            if len(self.open) < self.windows:
                self.open.append((self.length, []))
                continue
            room, i = min((room, i) for i, (room, _) in enumerate(self.open))
            self._put(i, (doc_id, start, ids[:room], doc_tokens))
            start, ids = start + room, ids[room:]

    def _put(self, i: int, piece: tuple) -> None:
        room, pieces = self.open[i]
        pieces.append(piece)
        self.open[i] = (room - len(piece[2]), pieces)
        if self.open[i][0] == 0:
            self._emit(self.open.pop(i)[1])

    def _emit(self, pieces: list[tuple], keep_ids: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            data = ids.astype("<u4", copy=False).tobytes()
            self.out.append((doc_id, start, len(ids), zlib.crc32(data), doc_tokens, self.next, offset, data if keep_ids else None))
            offset += len(ids)
        self.next += 1

    def own(self) -> None:
        """Copy what open windows hold of a large array, so that it can go."""
        self.open = [(room, [(d, s, ids.copy() if ids.base is not None else ids, n) for d, s, ids, n in pieces]) for room, pieces in self.open]

    def leave(self) -> None:
        """The open windows as left-over pieces with their ids."""
        for _, pieces in self.open:
            self._emit(pieces, keep_ids=True)
        self.open = []

    def finish(self) -> None:
        """Everything that is open, in full sequences and then powers of two."""
        rest = [p for _, pieces in self.open for p in pieces]
        self.open = []
        size, pieces = self.length, []
        left = sum(len(p[2]) for p in rest)
        while left and size > left:
            size //= 2
        room = size
        while rest:
            doc_id, start, ids, doc_tokens = rest.pop(0)
            pieces.append((doc_id, start, ids[:room], doc_tokens))
            if len(ids) > room:
                rest.insert(0, (doc_id, start + room, ids[room:], doc_tokens))
            left -= len(pieces[-1][2])
            room -= len(pieces[-1][2])
            if not room:
                self._emit(pieces)
                pieces = []
                while left and size > left:
                    size //= 2
                room = size

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, windows: int = WINDOWS) -> DataFrame:
    """Pieces of the packed documents (doc_id, text; other columns are ignored).

    length must be a power of two.  Each row of docs is a document: its ids, then id 2.  Null text
    is empty; null doc_id stays null; repeated rows are documents of their own; a document longer
    than a sequence is cut.  Empty table: empty result.
    """
    path = tokenizer or default_tokenizer()
    if length & (length - 1):
        raise ValueError("length must be a power of two")

    def first(batches):
        encode, packer = encoder(path), Packer(_task(), length, windows)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, bounds in encode(pc.fill_null(batch.column(1), "")):
                ends = bounds.tolist()
                for i, doc_id in enumerate(doc_ids[first : first + len(ends) - 1]):
                    packer.add(doc_id, 0, ids[ends[i] : ends[i + 1]], ends[i + 1] - ends[i])
                packer.own()
                if len(packer.out) > 20_000:
                    yield packer.batch()
        packer.leave()
        yield packer.batch()

    def merge(level: int, last: bool):
        def run(batches):
            packer = Packer((level << 24) + _task(), length, windows)
            for batch in batches:
                for doc_id, start, doc_tokens, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                    packer.add(doc_id, start, np.frombuffer(ids, "<u4"), doc_tokens)
                if packer.out:
                    yield packer.batch()
            (packer.finish if last else packer.leave)()
            yield packer.batch()

        return run

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, level = source.rdd.getNumPartitions(), 1
    done = materialize(source.mapInArrow(first, _DDL), "packed")
    out = done.filter(F.col("ids").isNull())
    while True:
        parts = -(-parts // FAN_IN)
        over = done.filter(F.col("ids").isNotNull())
        # the window's id decides the task, so that a task that runs again sees the same pieces
        over = over.repartition(parts, "sequence_id").sortWithinPartitions("sequence_id", "offset")
        done = materialize(over.mapInArrow(merge(level, parts == 1), _DDL), "packed")
        out = out.union(done.filter(F.col("ids").isNull()))
        if parts == 1:
            return out.drop("ids")
        level += 1
