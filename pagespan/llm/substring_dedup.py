"""Exact removal of repeated word windows by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket. Equal windows
have equal minimisers, so a bucket holds every copy of its windows, and sorting there counts them exactly.
A map task packs equal super-k-mers once, with the places where they start, so a passage that a third of the
documents hold reaches its bucket once per task and not once per document.

Windows are compared by two 64-bit hashes of their 20 word hashes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import keyed, partitions, prepare, public_id, table

WINDOW, MINIMISER = 20, 6
FLUSH = 32 << 20


def _pack(n_bucket: int, window: int, m: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in W.slices(batch.column(2)):
                buf, off = W.raw(batch.column(2).slice(i, j - i))
                got = _super(buf, off, ids[i:j], ties[i:j], window, m)
                if got is not None:
                    held.append(got)
                    size += sum(map(len, got[6]))
                if size > FLUSH:
                    yield _blobs(held, n_bucket)
                    held, size = [], 0
        if held:
            yield _blobs(held, n_bucket)

    return pack


def _super(buf, off, ids, ties, window, m):
    """Super-k-mers: minimiser, hash, document's id and tie, first word, number of words, text."""
    w = W.split(buf, off)
    at = W.inside(w.first, window)
    if not len(at):
        return None
    h = w.hashes()
    low = W.sliding_min(W.rolling(h, m), window - m + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1])
    k = np.flatnonzero(new)
    a = at[k]
    b = at[np.append(k[1:], len(at)) - 1] + window  # past the last word
    cum = np.zeros(len(h) + 1, np.uint64)
    q, qi = 0xA0761D6478BD642F, W.inverse(0xA0761D6478BD642F)
    np.cumsum(h * W.powers(q, len(h)), out=cum[1:])
    key = W.mix((cum[b] - cum[a]) * W.powers(qi, len(h) + 1)[a] + (b - a).astype(np.uint64))
    data = memoryview(buf.tobytes())
    text = [bytes(data[s:e]) for s, e in zip(w.start[a].tolist(), w.end[b - 1].tolist(), strict=True)]
    of = w.text_of()[a]
    return low[k], key, ids[of], ties[of], a - w.first[of], b - a, text


def _blobs(held, n_bucket: int) -> pa.RecordBatch:
    low, key, doc, tie, pos, n = (np.concatenate([x[i] for x in held]) for i in range(6))
    text = [t for x in held for t in x[6]]
    bucket = (low % np.uint64(n_bucket)).astype(np.int64)
    order = np.lexsort((pos, doc, n, key, bucket))
    bucket, key, doc, tie, pos, n = (x[order] for x in (bucket, key, doc, tie, pos, n))
    lead = np.ones(len(order), bool)
    lead[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])
    group = np.flatnonzero(lead)
    count = np.diff(np.append(group, len(order)))
    cut = np.flatnonzero(np.append(True, bucket[group][1:] != bucket[group][:-1]))
    z, out = zstandard.ZstdCompressor(level=3), []
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True):
        s, e = int(group[x]), int(group[y]) if y < len(group) else len(order)
        own = [text[i] for i in order[group[x:y]].tolist()]
        blob = struct.pack("<ii", y - x, e - s) + np.array([len(t) for t in own], np.int32).tobytes() + count[x:y].astype(np.int32).tobytes() + doc[s:e].astype(np.int64).tobytes() + tie[s:e].astype(np.int64).tobytes() + pos[s:e].astype(np.int32).tobytes() + b"".join(own)
        out.append(z.compress(blob))
    return pa.RecordBatch.from_arrays([pa.array(bucket[group[cut]].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "blob"])


def _count(window: int):
    def count(t: pa.Table) -> pa.Table:
        """Spans of words covered by windows that start earlier elsewhere."""
        d = zstandard.ZstdDecompressor()
        parts = []
        for blob in t.column("blob"):
            x = d.decompress(blob.as_py())
            n, occ = struct.unpack_from("<ii", x)
            at = 8
            lens = np.frombuffer(x, np.int32, n, at)
            times = np.frombuffer(x, np.int32, n, at + 4 * n)
            doc = np.frombuffer(x, np.int64, occ, at + 8 * n)
            tie = np.frombuffer(x, np.int64, occ, at + 8 * n + 8 * occ)
            pos = np.frombuffer(x, np.int32, occ, at + 8 * n + 16 * occ)
            buf = np.frombuffer(x, np.uint8, offset=at + 8 * n + 20 * occ)
            w = W.split(buf, np.concatenate([[0], np.cumsum(lens, dtype=np.int64)]))
            h = w.hashes()
            nw = np.diff(w.first) - window + 1
            start = np.repeat(w.first[:-1], nw) + steps(nw)
            parts.append((W.rolling(h, window)[start], W.rolling(h ^ np.uint64(0x5851F42D4C957F2D), window, 0xD1342543DE82EF95)[start], nw, times, doc, tie, pos))
        # one entry for each window and place: windows of super-k-mer i, place j
        rows = []
        for h1, h2, nw, times, doc, tie, pos in parts:
            sk = np.repeat(np.arange(len(nw)), times)  # super-k-mer of each place
            per = nw[sk]
            first = np.concatenate([[0], np.cumsum(nw)])[:-1]
            step = steps(per)
            i = np.repeat(first[sk], per) + step
            rows.append((h1[i], h2[i], np.repeat(doc, per), np.repeat(tie, per), np.repeat(pos.astype(np.int64), per) + step))
        return late_spans(*(np.concatenate([r[i] for r in rows]) for i in range(5)), window)

    return count


def late_spans(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, window: int) -> pa.Table:
    """Spans of adjacent windows that also occur earlier, from the hashes and places of windows."""
    order = np.argsort(h1)
    s = h1[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    order = order[same[1:] | same[:-1]]  # windows that occur once are done
    h1, h2, doc, tie, pos = (x[order] for x in (h1, h2, doc, tie, pos))
    order = np.lexsort((pos, tie, doc, h2, h1))
    h1, h2, doc, tie, pos = (x[order] for x in (h1, h2, doc, tie, pos))
    new = np.ones(len(order), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
    late = (doc != doc[lead]) | (tie != tie[lead]) | (pos != pos[lead])
    first_doc, first_tie, first_pos = doc[lead][late], tie[lead][late], pos[lead][late]
    doc, tie, pos = doc[late], tie[late], pos[late]
    order = np.lexsort((pos, tie, doc))
    doc, tie, pos, first_doc, first_tie, first_pos = (x[order] for x in (doc, tie, pos, first_doc, first_tie, first_pos))
    # adjacent windows of one document that repeat adjacent windows are one span
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (pos[1:] > pos[:-1] + 1) | (first_doc[1:] != first_doc[:-1]) | (first_tie[1:] != first_tie[:-1]) | (first_pos[1:] - first_pos[:-1] != pos[1:] - pos[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(doc)) - 1
    if not len(doc):
        a = b = np.zeros(0, np.int64)
    cols = {"doc_id": doc[a], "tie": tie[a], "start": pos[a], "stop": pos[b] + window, "first_doc_id": first_doc[a], "first_start": first_pos[a]}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in cols.items()})


def steps(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def _spans(rows: DataFrame, window: int, minimiser: int) -> DataFrame:
    spark = rows.sparkSession
    prepare(spark)
    n = 8 * partitions(spark)
    blobs = rows.mapInArrow(_pack(n, window, minimiser), "bucket int, blob binary")
    return blobs.groupBy("bucket").applyInArrow(_count(window), "doc_id long, tie long, start long, stop long, first_doc_id long, first_start long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """Word spans [start, stop) whose windows all occur earlier: by smaller doc_id, or earlier in the same document.

    first_doc_id and first_start name the earliest place of the span's first window. Spans of one document may
    overlap or touch. Rows that share a doc_id and a text are one document, and no copies of each other; rows that
    share a doc_id alone are documents in the order of a hash of their texts, and tie tells them apart. Null ids
    are shared in this sense and come first. Null, empty and short texts have no windows.
    """
    return _spans(keyed(docs), window, minimiser).select(public_id(), "tie", "start", "stop", public_id("first_doc_id"), "first_start")


def _keep(texts: bool):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, sha = [], [], [], []
            for text, start, stop in zip(batch.column("text"), batch.column("start").to_pylist(), batch.column("stop").to_pylist(), strict=True):
                w = text.as_py().encode().split()
                total = len(w)
                if start:
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, np.minimum(start, total), 1)
                    np.add.at(edge, np.minimum(stop, total), -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(edge)[:total] == 0).tolist()]
                joined = b" ".join(w)
                n_words.append(total)
                n_removed.append(total - len(w))
                kept.append(joined.decode() if texts else None)
                sha.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return keep


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by a space; null unless texts), kept_sha256.

    What is earlier, and which rows are one document, is said at repeated_spans(); repeated rows lose the same words."""
    rows = keyed(docs)
    spans = _spans(rows, window, minimiser).groupBy("doc_id", "tie").agg(F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop"))
    both = rows.join(spans.hint("shuffle_hash"), ["doc_id", "tie"], "left").select("doc_id", "text", "start", "stop")
    out = both.mapInArrow(_keep(texts), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.select(public_id(), "n_words", "n_removed", "kept_text", "kept_sha256")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept_text")
