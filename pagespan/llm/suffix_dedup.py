"""Repeated passages by a sparse suffix array.

Suffixes are kept at minimiser positions alone: the words whose hash of the next ANCHOR words is least in some
window, so that every passage of PASSAGE words holds at least one whole anchor. First the anchors are sorted by
hash, and those that occur once are dropped. The others travel with the words around them; there the suffixes are
sorted, and so are the words before the anchors, read backwards. Neighbours of both orders are compared: runs whose
common prefixes reach far enough match to the right, and those that lie in a run of the other order too extend to the
left, to all passages of PASSAGE words around the anchor.

Equal contexts of an anchor travel once with their places, are compared once, and are late as a whole at all places
but the first. A bucket holds an anchor's places, not texts that grow with documents: PASSAGE words to the right and the rest to
the left suffice, as longer repeats are chains of passages.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import words as W
from .common import keyed, partitions, prepare, public_id, table
from .substring_dedup import steps

PASSAGE, ANCHOR = 50, 25
FLUSH = 16 << 20
SPANS = "doc_id long, tie long, start long, stop long, first_doc_id long, first_start long"


def anchors(w: W.Words, h: np.ndarray, passage: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of minimisers, and their hashes."""
    at = W.inside(w.first, passage)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    g = W.rolling(h, anchor)
    reach = passage - anchor + 1
    low = np.zeros(len(g) + reach - 1, np.uint64)  # least hash of each window that lies in one text, else 0
    low[at + reach - 1] = W.sliding_min(g, reach)[at]
    # an anchor is kept if it is the least of a window that holds it, so if the greatest of their minima is its own
    p = np.flatnonzero(~W.sliding_min(~low, reach) == g)
    return p, g[p]


def _find(n_bucket: int, passage: int, anchor: int):
    """Places of anchors by bucket of the anchor's hash, compressed."""

    def blobs(held) -> pa.RecordBatch:
        g, doc, tie, pos = (np.concatenate([x[k] for x in held]) for k in range(4))
        bucket = (g % np.uint64(n_bucket)).astype(np.int64)
        order = np.lexsort((pos, doc, g, bucket))
        bucket, g, doc, tie, pos = (x[order] for x in (bucket, g, doc, tie, pos))
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        z = zstandard.ZstdCompressor(level=1)
        out = [z.compress(struct.pack("<i", j - i) + g[i:j].tobytes() + doc[i:j].astype(np.int64).tobytes() + tie[i:j].astype(np.int64).tobytes() + pos[i:j].astype(np.int32).tobytes()) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(g)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "blob"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in W.slices(batch.column(2)):
                w = W.split(*W.raw(batch.column(2).slice(i, j - i)))
                p, g = anchors(w, w.hashes(), passage, anchor)
                if not len(p):
                    continue
                doc = w.text_of()[p]
                held.append((g, ids[i:j][doc], ties[i:j][doc], p - w.first[doc]))
                size += 28 * len(p)
                if size > FLUSH:
                    yield blobs(held)
                    held, size = [], 0
        if held:
            yield blobs(held)

    return find


def _repeated(t: pa.Table) -> pa.Table:
    """Places of the anchors that occur at two places at least, one row for each document."""
    d, key, doc, tie, pos = zstandard.ZstdDecompressor(), [], [], [], []
    for blob in t.column("blob"):
        x = d.decompress(blob.as_py())
        (n,) = struct.unpack_from("<i", x)
        key.append(np.frombuffer(x, np.uint64, n, 4))
        doc.append(np.frombuffer(x, np.int64, n, 4 + 8 * n))
        tie.append(np.frombuffer(x, np.int64, n, 4 + 16 * n))
        pos.append(np.frombuffer(x, np.int32, n, 4 + 24 * n))
    key, doc, tie, pos = map(np.concatenate, (key, doc, tie, pos))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    order = order[same[1:] | same[:-1]]
    order = order[np.lexsort((pos[order], tie[order], doc[order]))]
    doc, tie, pos = doc[order], tie[order], pos[order]
    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return pa.table({"doc_id": pa.array(doc[cut]), "tie": pa.array(tie[cut]), "pos": pa.ListArray.from_arrays(pa.array(np.append(cut, len(doc)).astype(np.int32)), pa.array(pos.astype(np.int64)))})


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the last first; and where runs of equal keys begin in it."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def _context(n_bucket: int, passage: int, anchor: int):
    """Words around anchors, by bucket of the anchor's hash: equal contexts once, with all their places."""
    left = passage - anchor
    q, qi = 0xA0761D6478BD642F, W.inverse(0xA0761D6478BD642F)

    def blobs(held) -> pa.RecordBatch:
        key, ctx, before = (np.concatenate([x[k] for x in held]) for k in range(3))
        times, text = np.concatenate([x[3] for x in held]), [t for x in held for t in x[4]]
        doc, tie, pos = (np.concatenate([x[k] for x in held]) for k in (5, 6, 7))
        at = np.cumsum(times) - times  # first place of each context
        bucket = (key % np.uint64(n_bucket)).astype(np.int64)
        order, lead = _runs(before, ctx, key, bucket)
        end = np.append(lead[1:], len(order))
        kept = order[lead]
        of = bucket[kept]
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        z, out = zstandard.ZstdCompressor(level=1), []
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(kept)], strict=True):
            own, part = kept[x:y], order[lead[x] : end[y - 1]]
            places = np.repeat(at[part], times[part]) + steps(times[part])
            count = np.add.reduceat(times[part], lead[x:y] - lead[x])
            texts = [text[k] for k in own.tolist()]
            lens = np.array([len(s) for s in texts], np.int32)
            out.append(z.compress(struct.pack("<ii", y - x, len(places)) + key[own].tobytes() + ctx[own].tobytes() + before[own].astype(np.int32).tobytes() + count.astype(np.int32).tobytes() + lens.tobytes() + doc[places].astype(np.int64).tobytes() + tie[places].astype(np.int64).tobytes() + pos[places].astype(np.int32).tobytes() + b"".join(texts)))
        return pa.RecordBatch.from_arrays([pa.array(of[cut].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "blob"])

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "tie"))
            text, pos = batch.column("text"), batch.column("pos")
            for i, j in W.slices(text):
                w = W.split(*W.raw(text.slice(i, j - i)))
                own = pos.slice(i, j - i)
                off = own.offsets.to_numpy() - own.offsets[0].as_py()
                doc = np.repeat(np.arange(j - i), np.diff(off))
                p = own.flatten().to_numpy() + w.first[doc]
                if not len(p):
                    continue
                h = w.hashes()
                g = W.rolling(h, anchor)[p]
                a, b = np.maximum(p - left, w.first[doc]), np.minimum(p + passage, w.first[doc + 1])
                cum = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h * W.powers(q, len(h)), out=cum[1:])
                ctx = W.mix((cum[b] - cum[a]) * W.powers(qi, len(h) + 1)[a] + (b - a).astype(np.uint64))
                order, lead = _runs(p - a, ctx, g)
                k, data = order[lead], memoryview(w.buf.tobytes())
                held.append((g[k], ctx[k], (p - a)[k], np.diff(np.append(lead, len(order))), [bytes(data[s:e]) for s, e in zip(w.start[a[k]].tolist(), w.end[b[k] - 1].tolist(), strict=True)], ids[i:j][doc][order], ties[i:j][doc][order], (p - w.first[doc])[order]))
                size += sum(map(len, held[-1][4])) + 20 * len(order)
                if size > FLUSH:
                    yield blobs(held)
                    held, size = [], 0
        if held:
            yield blobs(held)

    return context


def _common(key: np.ndarray, words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix, in words, of each row and the one before it in the order; 0 between anchors."""
    r, k = words[order], key[order]
    return np.logical_and.accumulate(r[1:] == r[:-1], axis=1).sum(1) * (k[1:] == k[:-1])


def _best(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest prefix that a row shares with a neighbour, so with any other row."""
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = common
    out[order[:-1]] = np.maximum(out[order[:-1]], common)
    return out


def _alike(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Number of each row's run of neighbours with a common prefix of at least `depth` words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([np.zeros(min(1, len(order)), np.int64), np.cumsum(common < depth)])
    return out


def _sort(passage: int, anchor: int):
    left, width = passage - anchor, 2 * passage - anchor

    def read(t: pa.Table):
        """Distinct contexts (key, words before the anchor, text) and the places of each, the earliest first."""
        d = zstandard.ZstdDecompressor()
        cols, text = [[] for _ in range(7)], []
        for blob in t.column("blob"):
            x = d.decompress(blob.as_py())
            n, occ = struct.unpack_from("<ii", x)
            lens, at = np.frombuffer(x, np.int32, n, 8 + 24 * n), 8 + 28 * n
            for col, part in zip(cols, (np.frombuffer(x, np.uint64, n, 8), np.frombuffer(x, np.uint64, n, 8 + 8 * n), np.frombuffer(x, np.int32, n, 8 + 16 * n), np.frombuffer(x, np.int32, n, 8 + 20 * n), np.frombuffer(x, np.int64, occ, at), np.frombuffer(x, np.int64, occ, at + 8 * occ), np.frombuffer(x, np.int32, occ, at + 16 * occ)), strict=True):
                col.append(part)
            end = at + 20 * occ + np.cumsum(lens)
            text += [x[s:e] for s, e in zip((end - lens).tolist(), end.tolist(), strict=True)]
        key, ctx, before, times, doc, tie, pos = map(np.concatenate, cols)
        order, lead = _runs(before, ctx, key)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(order))))
        k = order[lead]
        kind = np.repeat(kind, times)
        o = np.lexsort((pos, tie, doc, kind))
        return key[k], before[k].astype(np.int64), [text[i] for i in k.tolist()], kind[o], doc[o], tie[o], pos[o].astype(np.int64)

    def compare(t: pa.Table) -> pa.Table:
        key, before, texts, kind, id_, tie, pos = read(t)
        # documents by number, in their order
        place, lead = _runs(tie, id_)
        doc = np.empty(len(place), np.int64)
        doc[place] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(place))))
        id_, tie = id_[place[lead]], tie[place[lead]]
        n = len(key)
        # words around each anchor, the anchor's first in column `left`; absent words equal nothing
        m = np.arange(n * width, dtype=np.uint64).reshape(n, width)
        off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        w = W.split(np.frombuffer(b"".join(texts), np.uint8), off)
        row, size = w.text_of(), np.diff(w.first)
        m[row, left - before[row] + np.arange(len(row)) - w.first[row]] = w.hashes()
        head = w.start[w.first[:-1] + before] - off[:-1]
        # a closing blank: suffixes that begin with the same words are neighbours, one that ends there too
        suffix = [b" ".join(x[s:].split()) + b" " for x, s in zip(texts, head.tolist(), strict=True)]
        # the suffix array of this bucket, and that of the words before the anchors, read backwards
        right = np.array(sorted(range(n), key=lambda i: (int(key[i]), suffix[i])), np.int64)
        back = np.ascontiguousarray(m[:, :left][:, ::-1])
        behind = np.argsort(np.column_stack([key, back]).view(f"S{8 * (left + 1)}").ravel())
        right_by, behind_by = _common(key, m[:, left:], right), _common(key, back, behind)
        first = np.searchsorted(kind, np.arange(n))  # the earliest place of each context
        lo, hi = left - before, left - before + size - passage  # passages by words before the anchor, both inclusive
        later = (doc != doc[first][kind]) | (pos != pos[first][kind])
        many = np.zeros(n, bool)
        many[kind[later]] = True
        # what the best neighbours share on both sides together bounds every match
        use = ((_best(right, right_by) + _best(behind, behind_by) >= passage) | many) & (hi >= lo)
        held = []
        for s in range(left + 1):  # passages that start `left - s` words before the anchor
            ok = np.flatnonzero(use & (lo <= s) & (s <= hi))
            # matches to the right by `passage - left + s` words, extended to the left by the others
            r, b = _alike(right, right_by, passage - left + s)[ok], _alike(behind, behind_by, left - s)[ok]
            wd, wp = doc[first[ok]], pos[first[ok]] - left + s
            order = np.lexsort((wp, wd, b, r))
            new = np.ones(len(order), bool)
            new[1:] = (r[order][1:] != r[order][:-1]) | (b[order][1:] != b[order][:-1])
            head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            held.append((ok[order], wd[order], wp[order], wd[head], wp[head]))
        # the earliest place of each passage is that of some context's earliest place
        c, wd, wp, ld, lp = map(np.concatenate, zip(*held, strict=True))
        late = (wd != ld) | (wp != lp)
        spans = [(wd[late], wp[late], wp[late] + passage, ld[late], lp[late])]
        # all passages of a context are late at its other places; the least of their earliest places names them
        o = np.lexsort((lp, ld, c))
        head = np.searchsorted(c[o], np.arange(n))
        x = np.flatnonzero(later & (hi >= lo)[kind])
        y, k = o[head[kind[x]]] if len(x) else np.zeros(0, np.int64), kind[x]
        spans.append((doc[x], pos[x] - left + lo[k], pos[x] - left + hi[k] + passage, ld[y], lp[y]))
        return _islands(id_, tie, *map(np.concatenate, zip(*spans, strict=True)))

    return compare


def _islands(id_, tie, doc, start, stop, first_doc, first_pos) -> pa.Table:
    """Spans of one document that overlap or touch as one span, with the least of their first places. doc: numbers into id_ and tie."""
    order = np.lexsort((start, doc))
    doc, start, stop, first_doc, first_pos = (x[order] for x in (doc, start, stop, first_doc, first_pos))
    reach = doc * (1 << 40)  # documents apart, so that one running maximum serves all
    far = np.maximum.accumulate(stop + reach) if len(doc) else stop
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | ((start + reach)[1:] > far[:-1])
    a = np.flatnonzero(new)
    last = np.append(a[1:], len(doc)) - 1 if len(a) else a
    island = np.cumsum(new) - 1
    o = np.lexsort((first_pos, first_doc, island))
    low = o[a]
    cols = {"doc_id": id_[doc[a]], "tie": tie[doc[a]], "start": start[a], "stop": far[last] - reach[last], "first_doc_id": id_[first_doc[low]], "first_start": first_pos[low]}
    return pa.table({k: pa.array(v.astype(np.int64)) for k, v in cols.items()})


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, anchor: int = ANCHOR) -> DataFrame:
    """Maximal word spans [start, stop) of each document whose every passage of `passage` words occurs earlier: by
    smaller doc_id, or earlier in the same document. first_doc_id, first_start: the earliest place of one of them.

    Null, empty and short texts have none. Rows that share a doc_id and a text are one document, and no copies of each
    other; rows that share a doc_id alone are documents in the order of a hash of their texts, and tie tells them apart.
    Null ids are shared in this sense and come first. Words are compared by 64-bit hashes, passages by their words' hashes.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = keyed(docs)
    n = 8 * partitions(spark)
    found = rows.mapInArrow(_find(n, passage, anchor), "bucket int, blob binary")
    again = found.groupBy("bucket").applyInArrow(_repeated, "doc_id long, tie long, pos array<long>")
    again = again.groupBy("doc_id", "tie").agg(F.array_distinct(F.flatten(F.collect_list("pos"))).alias("pos"))
    near = rows.join(again.hint("shuffle_hash"), ["doc_id", "tie"]).select("doc_id", "tie", "text", "pos").mapInArrow(_context(n, passage, anchor), "bucket int, blob binary")
    spans = near.groupBy("bucket").applyInArrow(_sort(passage, anchor), SPANS)
    order = Window.partitionBy("doc_id", "tie").orderBy("start", "stop")
    island = spans.withColumn("new", F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    island = island.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy("doc_id", "tie", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(F.struct("first_doc_id", "first_start")).alias("first"))
    return out.select(public_id(), "tie", "start", "stop", F.expr(f"nullif(first.first_doc_id, {-(1 << 63) + 1} - 1)").alias("first_doc_id"), F.col("first.first_start").alias("first_start"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("tie")
