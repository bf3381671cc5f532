"""Quality by nearest-neighbour voting in a latent-semantic space.

Features are counts of character-class trigrams and of hashed lower-case words, damped by log and by inverse
document frequency; a truncated singular value decomposition of a bounded sample of labelled documents gives the
latent space. The sample's vectors go to every executor (their number is bounded), each document is compared with
all of them by blocked matrix products, and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import documents, prepare, public_id, table

#: Labelled rows that fitting reads at most: half from each label, by least hash of the id.
SAMPLE, RANK, NEIGHBOURS, THRESHOLD = 4000, 48, 25, 0.3
_CLASSES, _WORD_BINS = 16, 2048
_DIM = _CLASSES**3 + _WORD_BINS + 1  # the last: a word that repeats the one before it
#: Weight of the last feature, which is one of thousands but says what all of them say of other texts.
_REPEAT_WEIGHT = 12
_BLOCK = 256

_CLASS = np.zeros(256, np.int32)
_CLASS[128:] = 1  # part of a letter beyond ASCII
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[9, 11, 12, 13, 32]] = 5
_CLASS[10] = 6
for _i, _c in enumerate("!.,|&$%*#"):
    _CLASS[ord(_c)] = 7 + _i


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Feature counts of each text, float32."""
    n = len(off) - 1
    out = np.zeros((n, _DIM), np.float32)
    c = _CLASS[buf]
    if len(c) > 2:
        code = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
        doc = np.repeat(np.arange(n), np.diff(off))
        same = doc[:-2] == doc[2:]
        out[:, : _CLASSES**3] = np.bincount((doc[:-2] * _CLASSES**3 + code)[same], minlength=n * _CLASSES**3).reshape(n, -1)
    low = W.lower(buf)
    w = W.split(low, off)
    if len(w.start):
        h, doc = w.hashes(), w.text_of()
        out[:, _CLASSES**3 : -1] = np.bincount(doc * _WORD_BINS + (h % np.uint64(_WORD_BINS)).astype(np.int64), minlength=n * _WORD_BINS).reshape(n, -1)
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[:, -1] = np.bincount(doc[1:][again], minlength=n) / np.maximum(np.diff(w.first), 1)
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped and normalised counts; the share of repeated words goes in by its own weight."""
    repeats = x[:, -1].copy()
    x = np.log1p(x)
    x *= idf
    x[:, -1] = 0
    x = _normal(x)
    x[:, -1] = repeats * _REPEAT_WEIGHT
    return _normal(x)


@dataclass
class QualityModel:
    """Inverse document frequencies, projection, and the labelled vectors with their labels. Its size is bounded by SAMPLE."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    weights: tuple[float, float] = (1.0, 1.0)  # of a vote for label 0 and for label 1: share among all labels over share here

    @property
    def mean(self) -> float:
        """Share of label 1 among all labels."""
        w = np.where(self.labels == 1, self.weights[1], self.weights[0])
        return float((w * self.labels).sum() / w.sum()) if len(self.labels) else 0.5

    def embed(self, x: np.ndarray) -> np.ndarray:
        return _normal(weighted(x, self.idf) @ self.basis)

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors; texts without features get the labels' mean."""
        out = np.full(len(off) - 1, self.mean)
        for i in range(0, len(out), _BLOCK):
            o = off[i : i + _BLOCK + 1]
            v = self.embed(counts(buf[o[0] : o[-1]], o - o[0]))
            if not len(self.labels):
                continue
            sim = v @ self.vectors.T
            k = min(self.neighbours, sim.shape[1])
            # all that are as near as the k-th share the places that are left, so ties don't hang on an order
            bound = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
            row, near = np.nonzero(sim >= bound[:, None])
            last = sim[row, near] == bound[row]
            tied = np.bincount(row, last, len(sim))
            place = np.where(last, ((k - np.bincount(row, ~last, len(sim))) / tied)[row], 1.0)
            weight = place * np.exp(8 * (sim[row, near].astype(np.float64) - 1)) * np.where(self.labels[near] == 1, self.weights[1], self.weights[0])
            vote = np.bincount(row, weight * self.labels[near], len(sim)) / np.bincount(row, weight, len(sim))
            real = np.abs(v).sum(1) > 0
            out[i : i + len(o) - 1][real] = vote[real]
        return np.clip(out, 0, 1)


def _rows(batch: pa.RecordBatch, name: str = "text", limit: int = 2 << 20):
    for i, j in W.slices(batch.column(name), limit):
        yield i, j, *W.raw(batch.column(name).slice(i, j - i))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS, seed: int = 1) -> QualityModel:
    """Model from at most `sample` labelled documents: half from each label, so that the rarer label is heard.

    Features of the sample are made on the executors; the driver gets sparse counts of bounded number and finds the
    latent space by randomised subspace iteration. Votes are weighted back to the shares that the labels have among all
    labelled rows, so scores don't drift as the table outgrows the sample.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    pick = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        pick = part if pick is None else pick.union(part)
    every = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = documents(docs).join(F.broadcast(pick), "doc_id")  # at most `sample` rows of two numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in _rows(batch):
                for s in range(0, j - i, _BLOCK):
                    o = off[s : s + _BLOCK + 1]
                    x = counts(buf[o[0] : o[-1]], o - o[0])
                    at = [np.flatnonzero(r).astype(np.int32) for r in x]
                    part = batch.slice(i + s, len(at))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)], pa.binary())], ["doc_id", "label", "at", "n"])

    got = chosen.mapInArrow(features, "doc_id long, label int, at binary, n binary").toArrow().to_pylist()
    got = sorted({r["doc_id"]: r for r in got}.values(), key=lambda r: r["doc_id"])
    x = np.zeros((len(got), _DIM), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.float32)
    y = np.array([r["label"] for r in got], np.float64)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0)) + 1).astype(np.float32)
    if not len(x):
        return QualityModel(idf, np.zeros((_DIM, 1), np.float32), np.zeros((0, 1), np.float32), y, neighbours)
    share = lambda k: every.get(k, 0) / max(sum(every.values()), 1) / max(float((y == k).mean()), 1e-9)
    x = weighted(x, idf)
    q = np.random.default_rng(seed).standard_normal((_DIM, min(rank + 16, *x.shape)), np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    u, s, _ = np.linalg.svd((x @ q).T @ (x @ q))
    basis = (q @ u[:, :rank]).astype(np.float32)
    return QualityModel(idf, basis, _normal(x @ basis), y, neighbours, (share(0), share(1)))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), for each row. Null and empty texts get the labels' mean.
    Neighbours that tie for the last places share them, so equal texts get equal scores up to rounding. Only text is an input of the score."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB at most: SAMPLE vectors of RANK numbers, and the basis

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in _rows(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(held.value.score(buf, off))], ["doc_id", "score"])

    return documents(docs).mapInArrow(score, "doc_id long, score double").select(public_id(), "score")


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is `threshold` or more, with all their columns; docs' order and columns stay."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.slices(batch.column(at), 2 << 20):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(held.value.score(*W.raw(part.column(at))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold: crc32 of the id's text modulo 5 is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
