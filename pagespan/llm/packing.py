"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Overlong documents are first cut into full windows. The other pieces go, longest first, each into the open
window with the least room that still holds it; a segment tree over the remaining capacities finds it. A task
packs its own documents in groups of bounded size, so nothing is shuffled and memory doesn't grow with the table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import documents, prepare, public_id, table

CAPACITY, END_ID, GROUP_TOKENS, CACHE_WORDS, ENCODE_WORDS = 2048, 1, 6_000_000, 1_000_000, 2048
TOKENIZER = "word_bpe_49k.json"
_LETTER, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), 123, 125, 126]] = True
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity. node[i]: whether any window below that node is open."""

    def __init__(self, capacity: int) -> None:
        self.leaf = 1
        while self.leaf <= capacity:
            self.leaf *= 2
        self.node = bytearray(2 * self.leaf)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        i = room + self.leaf
        while i and not self.node[i]:
            self.node[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least need."""
        i = need + self.leaf
        if not self.node[i]:
            while i > 1 and (i & 1 or not self.node[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaf:
                i *= 2
                if not self.node[i]:
                    i += 1
        room = i - self.leaf
        window = self.at[room].pop()
        while i and not (self.at[i - self.leaf] if i >= self.leaf else self.node[2 * i] or self.node[2 * i + 1]):
            self.node[i] = 0
            i >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (0 < length <= capacity), and the number of windows. Ties keep their order."""
    window, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    open_ = OpenWindows(capacity)
    size = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = size[i]
        found = open_.take(need) if need < capacity else None
        if found is None:
            room, w = capacity, n
            n += 1
        else:
            room, w = found
        window[i], offset[i] = w, capacity - room
        if room > need:
            open_.add(room - need, w)
    return window, offset, n


class WordTokenizer:
    """Token ids of whole texts. Distinct pieces of words are encoded once and kept in a bounded table, by 64-bit hash.

    That equals encoding the text: the vocabulary drops white space, and no token or normalisation spans it or the
    end of an ASCII letter run before ASCII punctuation. A bar is no cut, as special-token strings hold letters before one.
    A-Z count as a-z where no combining mark can follow and no special token can be meant.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only hold more memory
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, key: np.ndarray, pieces: list[str]) -> None:
        """Adds pieces of new, ascending hashes."""
        size, ids = [], [self.flat]
        for i in range(0, len(pieces), ENCODE_WORDS):
            got = [e.ids for e in self.tok.encode_batch_fast(pieces[i : i + ENCODE_WORDS], add_special_tokens=False)]
            size += map(len, got)
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
        size = np.array(size, np.int64)
        to = np.searchsorted(self.key, key)
        self.at = np.insert(self.at, to, len(self.flat) + np.cumsum(size) - size)
        self.size, self.key, self.flat = np.insert(self.size, to, size), np.insert(self.key, to, key), np.concatenate(ids)

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that lie in buf between the offsets, each with the end id; and how many each has."""
        low, start, end = _pieces(buf, off)
        u, first, at = np.unique(W.span_hashes(low, start, end), return_index=True, return_inverse=True)
        new = ~np.isin(u, self.key, assume_unique=True)
        if len(self.key) + new.sum() > CACHE_WORDS:
            self.clear()
            new[:] = True
        data, k = low.tobytes(), first[new]
        self.learn(u[new], [data[x:y].decode() for x, y in zip(start[k].tolist(), end[k].tolist(), strict=True)])
        i = np.searchsorted(self.key, u)[at]
        size = self.size[i]
        cum = np.concatenate([[0], np.cumsum(size)])
        text = np.searchsorted(start, off)
        n = cum[text[1:]] - cum[text[:-1]] + 1
        out = np.full(n.sum(), END_ID, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(n) - 1] = False
        out[inner] = self.flat[np.repeat(self.at[i] - cum[:-1], size) + np.arange(cum[-1])]
        return out, n


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker: its tasks share the vocabulary and the bounded table."""
    return WordTokenizer(path)


def _pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case where that changes no id, and the spans of the pieces that are encoded alone."""
    w = W.split(buf, off)
    low, cut = buf, np.zeros(0, np.int64)
    if len(buf):
        cut = np.flatnonzero(_LETTER[buf[:-1]] & _PUNCTUATION[buf[1:]]) + 1
        if not ((buf[:-1] == 60) & (buf[1:] == 124)).any():  # no special token
            low = np.where(np.append(buf[1:] < 128, True), W.lower(buf), buf)
    a, b = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
    a[w.start] = a[cut] = True
    b[w.end] = b[cut] = True
    return low, np.flatnonzero(a), np.flatnonzero(b)


def _pack(path: str, capacity: int, group: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, base, done = word_tokenizer(path), TaskContext.get().partitionId() << 40, 0
        held, size = [], 0

        def flush():
            nonlocal done
            doc, start, length, ids, total = [], [], [], [], []
            for d, t in held:
                for s in range(0, len(t), capacity):
                    x = t[s : s + capacity]
                    doc.append(d)
                    start.append(s)
                    length.append(len(x))
                    ids.append(x.astype("<u4").tobytes())
                    total.append(len(t))
            window, offset, n = best_fit_decreasing(np.array(length, np.int64), capacity)
            window += base + done
            done += n
            for i in range(0, len(doc), 4096):
                j = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays([pa.array(doc[j], pa.int64()), pa.array(start[j], pa.int64()), pa.array(length[j], pa.int64()), pa.array(ids[j], pa.binary()), pa.array(total[j], pa.int64()), pa.array(window[j]), pa.array(offset[j])], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j in W.slices(batch.column(1), 2 << 20):
                t, n = tok(*W.raw(batch.column(1).slice(i, j - i)))
                held += zip(ids[i:j], np.split(t, np.cumsum(n)[:-1]), strict=True)
                size += len(t)
                if size >= group:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return pack


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, group: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (its place in the sequence; pieces leave no gaps).

    A document's ids are those of its whole text, then the end id; null and empty texts are the end id alone.
    Repeated rows are packed each. vocabulary: path of the vocabulary file on every executor; unset, the public one there.
    """
    prepare(docs.sparkSession)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(TOKENIZER)
    out = documents(docs).mapInArrow(_pack(str(vocabulary), capacity, group), SCHEMA)
    return out.select(public_id(), *out.columns[1:])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
