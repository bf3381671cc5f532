"""Language-model scoring of whole documents.

Words are split, hashed and numbered once: a chunk is a task's share of texts as numbers of its distinct words, with
those words' hashes and training counts beside it. The words go to buckets by hash and come back with their counts over
all training texts, so no table of words is ever on one machine. With the counts, texts become arrays of units (frequent
words, or a band of rarer ones) and the exact unigram score. The recurrent model is trained in every task on every token
of its own share's training documents, and the tasks' weights are averaged by tokens. Then every document is scored with
the state carried from its first word to its end.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from . import words as W
from .common import NO_ID, durable, partitions, prepare, public_id, table

#: Frequent words with a unit of their own.
UNITS = 2000
#: Bytes of text in a chunk, and of packed words that meet in a bucket.
CHUNK, BUCKET = 128 << 20, 32 << 20
_END = np.uint64(0x0123456789ABCDEF)  # stands among the hashes of words for a text's end
_CHUNKS = "chunk long, blob binary, words binary"


def _numbered(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, tokens as numbers of distinct words, the words' hashes, and whether they go beyond ASCII."""
    w = W.split(W.lower(buf), off)
    size = np.diff(w.first) + 1
    word = np.ones(int(size.sum()), bool)
    word[np.cumsum(size) - 1] = False
    h = np.full(len(word), _END)
    h[word] = w.hashes()
    code, known = pd.factorize(h)
    wide = np.zeros(len(known), bool)
    if (buf >= 128).any():
        high = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(buf >= 128, out=high[1:])
        wide[code[word][high[w.end] > high[w.start]]] = True
    return size, code.astype(np.uint32), known, wide


class Chunk:
    """Texts as numbers of distinct words. rank: place of each word among the chunk's words by hash."""

    def __init__(self, ids, held, parts) -> None:
        self.ids, self.held = np.concatenate(ids), np.concatenate(held)
        size, code, known, wide = zip(*parts, strict=True)
        self.size = np.concatenate(size)
        to, self.hash = pd.factorize(np.concatenate(known))
        self.wide = np.zeros(len(self.hash), bool)
        self.wide[to[np.concatenate(wide)]] = True
        at = np.cumsum([0, *map(len, known)])
        self.code = np.concatenate([to[a : a + len(k)].astype(np.uint32)[c] for a, k, c in zip(at, known, code, strict=False)])

    def row(self, chunk: int) -> pa.RecordBatch:
        count = np.bincount(self.code[np.repeat(~self.held, self.size)], minlength=len(self.hash))
        order = np.argsort(self.hash)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        z = zstandard.ZstdCompressor(level=1)
        blob = struct.pack("<qqq", len(self.ids), len(self.hash), len(self.code)) + self.ids.astype(np.int64).tobytes() + self.size.astype(np.int64).tobytes() + self.held.astype(np.uint8).tobytes() + rank.tobytes() + self.code.tobytes()
        words = self.hash[order].tobytes() + (2 * count + self.wide)[order].astype(np.int64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([z.compress(blob)], pa.binary()), pa.array([z.compress(words)], pa.binary())], ["chunk", "blob", "words"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, n, ids, held, parts, size = TaskContext.get().partitionId() << 32, 0, [], [], [], 0
    for batch in batches:
        d, h = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for i, j in W.slices(batch.column(2)):
            buf, off = W.raw(batch.column(2).slice(i, j - i))
            ids.append(d[i:j])
            held.append(h[i:j].astype(bool))
            parts.append(_numbered(buf, off))
            size += len(buf) + 16 * (j - i)
            if size >= CHUNK:
                yield Chunk(ids, held, parts).row(base + n)
                n, ids, held, parts, size = n + 1, [], [], [], 0
    if ids:
        yield Chunk(ids, held, parts).row(base + n)


def _open_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = zstandard.ZstdDecompressor().decompress(blob)
    n = len(x) // 16
    return np.frombuffer(x, np.uint64, n), np.frombuffer(x, np.int64, n, 8 * n)


def _bucket(h: np.ndarray, n_bucket: int) -> np.ndarray:
    """Ranges of hashes, so that words by hash are by bucket too."""
    return ((h >> np.uint64(32)) * np.uint64(n_bucket) >> np.uint64(32)).astype(np.int64)


def _ask(n_bucket: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, count = _open_words(blob.as_py())
                bucket = _bucket(h, n_bucket)
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                out = [z.compress(h[a:b].tobytes() + count[a:b].tobytes()) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(h)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array([chunk] * len(cut), pa.int64()), pa.array(out, pa.binary())], ["bucket", "chunk", "blob"])

    return ask


def _band(c: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Band of a word that has no unit of its own: 0 unseen, else by the count's logarithm and whether it is ASCII."""
    return np.where(c > 0, 1 + 2 * np.log2(np.maximum(c, 1)).astype(np.int64) + wide, 0)


_ANSWER = "kind string, chunk long, bucket int, blob binary, a long, b long"
_MODEL, _FREQUENT = "id long, tokens double, weights binary", "id long, blob binary"


def _pack_words(word: np.ndarray, wide: np.ndarray, count: np.ndarray) -> bytes:
    """The UNITS most frequent words, as ties fall by hash."""
    own = np.lexsort((word, -count))[:UNITS]
    return np.stack([word[own].view(np.int64), wide[own].astype(np.int64), count[own]]).tobytes()


def _words(blob: bytes) -> np.ndarray:
    """Hashes, whether beyond ASCII, and counts."""
    return np.frombuffer(blob, np.int64).reshape(3, -1)


def _frequent(t: pa.Table) -> pa.Table:
    word, wide, count = np.concatenate([_words(x.as_buffer()) for x in t.column("blob")], axis=1)
    return pa.table({"id": pa.array([t.column("id")[0].as_py()], pa.int64()), "blob": pa.array([_pack_words(word.view(np.uint64), wide, count)], pa.binary())})


def _folded(parts: DataFrame, fold, schema: str):
    """The one row that parts (with a column id) fold to, or None: 32 rows meet in a task, again and again."""
    parts = durable(parts)
    count = parts.count()
    while count > 1:
        groups = -(-count // 32)
        parts = durable(parts.groupBy(F.pmod("id", F.lit(groups)).alias("g")).applyInArrow(fold, schema))
        count = groups
    return parts.first()


def _answer(t: pa.Table) -> pa.Table:
    """Counts of the bucket's words for each chunk that asked; the bucket's frequent words; and its bands' sums."""
    z, bucket = zstandard.ZstdCompressor(level=1), t.column("bucket")[0].as_py()
    asked = [_open_words(x.as_py()) for x in t.column("blob")]
    code, word = pd.factorize(np.concatenate([h for h, _ in asked]))
    every = np.concatenate([c for _, c in asked])
    total, wide = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
    np.add.at(total, code, every >> 1)
    wide[code[every & 1 == 1]] = True
    rows, at = [], 0
    for chunk, (h, _) in zip(t.column("chunk").to_pylist(), asked, strict=True):
        rows.append(("chunk", chunk, bucket, z.compress(total[code[at : at + len(h)]].tobytes()), 0, 0))
        at += len(h)
    own = total > 1
    rows.append(("word", None, bucket, _pack_words(word[own], wide[own], total[own]), 0, 0))  # no others of a bucket can be among all words' UNITS
    seen = total > 0
    band = _band(total[seen], wide[seen])
    for b in np.unique(band).tolist():
        rows.append(("band", b, bucket, None, int((band == b).sum()), int(total[seen][band == b].sum())))
    types = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "chunk", "bucket", "blob", "a", "b"])


class Units:
    """Units by descending mass; the mass of all is that of the add-one unigram distribution, N + V + 1.

    top: (hash, beyond ASCII, count) of frequent words; bands: words and their counts' sum by band.
    """

    def __init__(self, top: list[tuple[int, int, int]], bands: dict[int, tuple[int, int]]) -> None:
        self.total = sum(c for _, c in bands.values())
        self.distinct = sum(n for n, _ in bands.values())
        rest = {b: n + c for b, (n, c) in bands.items()}
        for _, x, c in top:
            rest[int(_band(np.array([c]), np.array([x]))[0])] -= c + 1
        rest = {b: m for b, m in rest.items() if m > 0} | {0: 1}
        every = sorted([(-(c + 1), 0, w) for w, _, c in top] + [(-m, 1, b) for b, m in rest.items()])
        self.mass = np.array([-m for m, _, _ in every], np.float64)
        own = sorted((w, i) for i, (_, k, w) in enumerate(every) if k == 0)
        self.word, self.unit = np.array([w for w, _ in own], np.int64), np.array([i for _, i in own], np.int64)
        self.band = np.zeros(200, np.int64)
        for i, (_, k, b) in enumerate(every):
            if k:
                self.band[b] = i

    def encode(self, h: np.ndarray, wide: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each word, and the natural log-probability of the word within the unit."""
        unit = self.band[_band(c, wide)]
        inside = np.log((c + 1) / self.mass[unit])
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, h.view(np.int64)), len(self.word) - 1)
            own = self.word[at] == h.view(np.int64)
            unit[own], inside[own] = self.unit[at[own]], 0
        return unit, inside


_ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, units binary"


def _encode(units):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, z = units.value, zstandard.ZstdDecompressor()
        floor = np.log10(u.total + u.distinct + 1)
        for batch in batches:
            for blob, words, answers in zip(batch.column("blob"), batch.column("words"), batch.column("answers"), strict=True):
                x = z.decompress(blob.as_py())
                n, n_words, n_tokens = struct.unpack_from("<qqq", x)
                ids, size = np.frombuffer(x, np.int64, n, 24), np.frombuffer(x, np.int64, n, 24 + 8 * n)
                held = np.frombuffer(x, np.uint8, n, 24 + 16 * n).astype(bool)
                rank = np.frombuffer(x, np.uint32, n_words, 24 + 17 * n)
                token = np.frombuffer(x, np.uint32, n_tokens, 24 + 17 * n + 4 * n_words)
                got = sorted(answers.as_py(), key=lambda a: a["bucket"])
                c = np.concatenate([np.frombuffer(z.decompress(a["blob"]), np.int64) for a in got])
                h, count = _open_words(words.as_py())
                unit, inside = u.encode(h, count & 1 == 1, c)
                per_word = [(c > 0)[rank].astype(np.int32), np.log10(c + 1.0)[rank], inside[rank], unit.astype(np.uint16)[rank]]
                edge = np.concatenate([[0], np.cumsum(size)])
                for s, e in _pieces(edge, 1 << 21):
                    t, first = token[edge[s] : edge[e]], edge[s:e] - edge[s]
                    known, base, inner = (np.add.reduceat(p.take(t), first) for p in per_word[:3])
                    data = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer((2 * (edge[s : e + 1] - edge[s])).astype(np.int32)), pa.py_buffer(per_word[3].take(t))])
                    out = [pa.array(ids[s:e]), pa.array(held[s:e]), pa.array(size[s:e]), pa.array(known.astype(np.int64)), pa.array(base - size[s:e] * floor), pa.array(inner), data]
                    for k in range(0, e - s, 512):
                        yield pa.RecordBatch.from_arrays([p.slice(k, 512) for p in out], [p.split()[0] for p in _ENCODED.split(", ")])

    return encode


def _pieces(edge: np.ndarray, limit: int):
    """Ranges of texts of about `limit` tokens; a longer text stands alone."""
    i, n = 0, len(edge) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(edge, edge[i] + limit, "right")) - 1), n)
        yield i, j
        i = j


def _lots(batches: Iterator[pa.RecordBatch], size: int = 2_000_000) -> Iterator[tuple[list, list]]:
    """Rows of about `size` units together."""
    rows, units, n = [], [], 0
    for batch in batches:
        rows.append(batch)
        for u in batch.column("units"):
            units.append(np.frombuffer(u.as_buffer(), np.uint16))
            n += len(units[-1])
        if n >= size:
            yield rows, units
            rows, units, n = [], [], 0
    if rows:
        yield rows, units


def _train(units):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = units.value.mass
        t = gru.Trainer(gru.initial(mass), gru.classes(mass))
        for rows, docs in _lots(batches):
            held = np.concatenate([r.column("held_out").to_numpy(zero_copy_only=False) for r in rows])
            own = [d for d, h in zip(docs, held.tolist(), strict=True) if not h]
            t.learn(own)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(t.tokens)]), pa.array([gru.flat(t.p).tobytes()], pa.binary())], ["id", "tokens", "weights"])

    return train


def _average(t: pa.Table) -> pa.Table:
    """The mean of weights by tokens, in an order that doesn't hang on which task came first."""
    t = t.sort_by("id")
    n = t.column("tokens").to_numpy()
    share = n / n.sum() if n.sum() else np.full(len(n), 1 / len(n))
    w = sum(s * np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for s, x in zip(share, t.column("weights"), strict=True))
    return pa.table({"id": pa.array([t.column("id")[0].as_py()], pa.int64()), "tokens": pa.array([float(n.sum())]), "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary())})


def _score(units, weights):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = units.value.mass
        p, cut = gru.shaped(np.frombuffer(weights.value, np.float32), gru.initial(mass)), gru.classes(mass)
        for rows, docs in _lots(batches):
            got, at = gru.score(p, cut, docs), 0
            for r in rows:
                own = got[at : at + len(r)] + r.column("inside").to_numpy()
                at += len(r)
                yield pa.RecordBatch.from_arrays([*(r.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(own / np.log(10))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased (A-Z) words and one end. base_score: log10 of the add-one unigram probability, by
    counts over all rows that aren't held out. score: log10 of the model's probability of the text. Null and empty
    texts are the end alone. Repeated rows count as often as they stand. A null held_out counts as false. Words are
    told apart by 64-bit hashes. Every task fits weights on its own rows and they are averaged once, so scores (but
    no counts and no base_score) hang on how the rows are dealt to tasks; with the same dealing they are the same.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(held_out, F.lit(False)).cast("int").alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = durable(rows.mapInArrow(_chunks, _CHUNKS))
    # a chunk is a task's share, so the messages between chunks and buckets are few; buckets follow the words' bytes
    size = chunks.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(partitions(spark), -(-size // BUCKET))
    asked = chunks.select("chunk", "words").mapInArrow(_ask(n), "bucket int, chunk long, blob binary")
    answers = durable(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER))

    top = _folded(answers.where("kind = 'word'").select(F.col("bucket").cast("long").alias("id"), "blob"), _frequent, _FREQUENT)
    bands = answers.where("kind = 'band'").groupBy("chunk").agg(F.sum("a").alias("n"), F.sum("b").alias("c")).collect()
    units = Units(list(zip(*_words(top.blob).tolist(), strict=True)) if top else [], {r.chunk: (r.n, r.c) for r in bands})
    held = spark.sparkContext.broadcast(units)  # UNITS words and under 200 bands

    per = answers.where("kind = 'chunk'").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))
    encoded = durable(chunks.join(per.hint("shuffle_hash"), "chunk").select("blob", "words", "answers").mapInArrow(_encode(held), _ENCODED))
    first = _folded(encoded.mapInArrow(_train(held), _MODEL), _average, _MODEL)
    weights = spark.sparkContext.broadcast(bytes(first.weights) if first else gru.flat(gru.initial(units.mass)).tobytes())
    out = encoded.mapInArrow(_score(held, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(public_id(), "held_out", "n_tokens", "n_known", F.lit(units.total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
