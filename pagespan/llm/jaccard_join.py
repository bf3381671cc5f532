"""Exact similarity join on word shingles with a prefix tree.

All shingles have one global order, rare ones first. Their document counts are found without a table of shingles on
any machine: each share of the corpus sends its shingles to buckets by hash and gets classes of their counts back.
Two sets of the wanted similarity share a shingle among the first few of each (prefix filter), and shingles that one
document alone holds are shared by none, so sets meet by few shingles. Sets that meet, directly or over others, are
then joined exactly: they are stored in a prefix tree whose edges hold runs of shingles, and the sets walk the tree
once, together, sharing the overlap counted so far among all sets below an edge; a set leaves at subtrees that the
remaining length can't bring to the wanted overlap or that are linked to it already.

Equal sets are one set from the start, so groups of copies cost one set. Links are kept as spanning trees.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import documents, durable, partitions, prepare, public_id, table
from .components import components, local_components

SHINGLE, NUM, DEN = 5, 75, 100
#: Shingles, and sets, of one group that a task joins at once; larger groups are dealt out in pairs of blocks.
BLOCK, BLOCK_SETS = 12_000_000, 100_000
#: Orders in which neighbours are compared before the tree is walked.
ORDERS = 8
#: Bytes of text of a chunk, and of the slices in which its sets are made; of an Arrow batch, which then holds one chunk.
CHUNK, SLICE, BATCH = 8 << 20, 1 << 18, 4 << 20
_KEY_BITS = 24  # of a shingle's hash within its bucket; collisions only move a shingle in the order


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; and the first of each text."""
    w = W.split(W.lower(buf), off)
    h = w.hashes()
    at = W.inside(w.first, size)
    hashes, doc = [W.rolling(h, size)[at]], [np.searchsorted(w.first, at, "right") - 1]
    n = np.diff(w.first)
    for k in range(1, size):  # a shorter text is one shingle
        d = np.flatnonzero(n == k)
        if len(d):
            x = h[w.first[d]].copy()
            for j in range(1, k):
                x = x * np.uint64(0xA0761D6478BD642F) + h[w.first[d] + j]
            hashes.append(W.mix(x ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
            doc.append(d)
    hashes, doc = np.concatenate(hashes), np.concatenate(doc)
    order = np.argsort(hashes)
    hashes, doc = hashes[order], doc[order]
    order = np.argsort(doc.astype(np.uint16) if len(off) < 1 << 16 else doc, kind="stable")
    hashes, doc = hashes[order], doc[order]
    if len(doc):
        keep = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))
        hashes, doc = hashes[keep], doc[keep]
    return hashes, np.searchsorted(doc, np.arange(len(off)))


def _set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(W.mix(cum[first[1:]] - cum[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about CHUNK bytes of text, compressed."""
    base, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def row():
        ids = np.concatenate([x[0] for x in held])
        lens = np.concatenate([np.diff(x[2]) for x in held])
        blob = b"".join([struct.pack("<i", len(ids)), ids.astype(np.int64), lens.astype(np.int64), *(x[1] for x in held)])
        return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([zstandard.ZstdCompressor(level=1).compress(blob)], pa.binary())], ["chunk", "blob"])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in W.slices(batch.column(1), CHUNK // 4):
            held.append((ids[i:j], *W.raw(batch.column(1).slice(i, j - i))))
            size += len(held[-1][1]) + 16 * (j - i)
            if size >= CHUNK:
                yield row()
                n, held, size = n + 1, [], 0
    if held:
        yield row()


class Chunk:
    """Documents of a chunk: ids, sets, set keys; `one` are the documents whose set is the first of its kind here.

    A chunk has over a million shingles, and an executor runs several workers: sets are made by slices, and of the arrays
    as long as the chunk few are held at once."""

    def __init__(self, blob: pa.Buffer) -> None:
        x = zstandard.ZstdDecompressor().decompress(blob)
        (n,) = struct.unpack_from("<i", x)
        self.ids = np.frombuffer(x, np.int64, n, 4).copy()
        off = np.concatenate([[0], np.cumsum(np.frombuffer(x, np.int64, n, 4 + 8 * n))])
        buf, sets, i = np.frombuffer(x, np.uint8, offset=4 + 16 * n), [], 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
            h, first = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            sets.append((h, np.diff(first), *_set_keys(h, first)))
            i = j
        self.h, self.n, self.k1, self.k2 = (np.concatenate(part) for part in zip(*sets, strict=True))
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        _, one = np.unique(self.k1, return_index=True)
        self.one = np.zeros(n, bool)
        self.one[one] = True
        self.use = np.repeat(self.one, self.n)

    def keys(self, n_bucket: int) -> np.ndarray:
        """Bucket, and key in it, of the shingles of `one`."""
        key = self.h[self.use]
        low = key >> np.uint64(64 - _KEY_BITS)
        key %= np.uint64(n_bucket)
        key <<= np.uint64(32)
        key |= low
        return key

    def grades(self, n_bucket: int, answers: list[dict]) -> np.ndarray:
        """Grade of each shingle, of answers for all keys by bucket; 0 where `one` is not set."""
        out = np.zeros(len(self.h), np.uint8)
        if answers:
            d, key = zstandard.ZstdDecompressor(), self.keys(n_bucket)
            order = np.argsort(key)
            first = _starts(key[order])
            grade = np.concatenate([np.frombuffer(d.decompress(x["blob"]), np.uint8) for x in sorted(answers, key=lambda x: x["bucket"])])
            mine = np.empty(len(key), np.uint8)
            mine[order] = np.repeat(grade, np.diff(first, append=len(key)))
            out[self.use] = mine
        return out


def _starts(v: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)


def _ask(n_bucket: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = Chunk(blob.as_buffer()).keys(n_bucket)
                value.sort()
                first = _starts(value)
                count = np.minimum(np.diff(first, append=len(value)), 255).astype(np.uint8)
                value = value[first]
                bucket, key = (value >> np.uint64(32)).astype(np.int32), value.astype(np.uint32)
                cut = _starts(bucket)
                out = []
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=False):
                    step = np.diff(key[a:b], prepend=np.uint32(0))
                    out.append(z.compress(struct.pack("<i", b - a) + step.view(np.uint8).reshape(-1, 4).T.tobytes() + count[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array([chunk] * len(cut), pa.int64()), pa.array(out, pa.binary())], ["bucket", "chunk", "blob"])

    return ask


def _answer(t: pa.Table) -> pa.Table:
    """Class of each shingle's document count, twice its logarithm, for each chunk that asked."""
    d, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    keys, counts = [], []
    for blob in t.column("blob"):
        x = d.decompress(blob.as_py())
        (n,) = struct.unpack_from("<i", x)
        step = np.ascontiguousarray(np.frombuffer(x, np.uint8, 4 * n, 4).reshape(4, n).T).view(np.uint32).ravel()
        keys.append(np.cumsum(step, dtype=np.uint32))
        counts.append(np.frombuffer(x, np.uint8, n, 4 + 4 * n))
    key = np.concatenate(keys)
    order = np.argsort(key)
    first = _starts(key[order])
    total = np.add.reduceat(np.concatenate(counts)[order], first, dtype=np.int64)
    grade = np.empty(len(key), np.uint8)
    grade[order] = np.repeat(np.minimum(2 * np.log2(total), 255).astype(np.uint8), np.diff(first, append=len(key)))
    grades = np.split(grade, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "blob": pa.array([z.compress(g.tobytes()) for g in grades], pa.binary())})


_POSTED = "doc_id long, n long, k1 long, k2 long, items binary, bucket int, blob binary"


def _post(n_bucket: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _POSTED.split(", ")]
        for batch in batches:
            for blob, answers in zip(batch.column("blob"), batch.column("answers"), strict=True):
                c = Chunk(blob.as_buffer())
                grade = c.grades(n_bucket, answers.as_py())
                p = np.where(c.one & (c.n > 0), c.n - (NUM * c.n + DEN - 1) // DEN + 1, 0)
                posts = []
                for s in range(0, len(c.n), 512):
                    e = min(s + 512, len(c.n))
                    a, b = c.first[s], c.first[e]
                    doc = np.repeat(np.arange(s, e), c.n[s:e])
                    order = np.argsort((doc - s) * 256 + grade[a:b], kind="stable")  # by hash among equal grades
                    place = np.arange(a, b) - c.first[doc]
                    mine = order[(place < p[doc]) & (grade[a:b][order] > 0)]
                    posts.append((c.h[a:b][mine], doc[mine]))
                    held = np.zeros(e - s, bool)
                    held[doc[mine] - s] = True
                    items = [c.h[i:j].tobytes() if k else None for i, j, k in zip(c.first[s:e].tolist(), c.first[s + 1 : e + 1].tolist(), held.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.ids[s:e]), pa.array(c.n[s:e]), pa.array(c.k1[s:e]), pa.array(c.k2[s:e]), pa.array(items, pa.binary()), pa.nulls(e - s, pa.int32()), pa.nulls(e - s, pa.binary())], names)
                t, own = (np.concatenate(part) for part in zip(*posts, strict=True))
                bucket = (t % np.uint64(n_bucket)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                bucket, t, own = bucket[o], t[o], own[o]
                cut = _starts(bucket)
                out = [t[a:b].tobytes() + c.k1[own[a:b]].tobytes() + c.n[own[a:b]].astype(np.int32).tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=False)]
                none = pa.nulls(len(cut), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(cut), pa.binary()), pa.array(bucket[cut].astype(np.int32)), pa.array(out, pa.binary())], names)

    return post


def _meet(t: pa.Table) -> pa.Table:
    """Sets that share one of their first shingles and differ little in size, as links to the least of each group."""
    parts = [], [], []
    for blob in t.column("blob"):
        x = blob.as_buffer()
        m = len(x) // 20
        parts[0].append(np.frombuffer(x, np.uint64, m))
        parts[1].append(np.frombuffer(x, np.int64, m, 8 * m))
        parts[2].append(np.frombuffer(x, np.int32, m, 16 * m))
    s, k, n = map(np.concatenate, parts)
    order = np.argsort(s)
    v = s[order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = v[1:] == v[:-1]
    order = order[same[1:] | same[:-1]]
    order = order[np.lexsort((k[order], n[order], s[order]))]
    s, k, n = s[order], k[order], n[order].astype(np.int64)
    near = (s[1:] == s[:-1]) & (k[1:] != k[:-1]) & (DEN * n[:-1] >= NUM * n[1:])
    pair = np.unique(np.stack([k[:-1][near], k[1:][near]], 1), axis=0) if near.any() else np.zeros((0, 2), np.int64)
    node, low = local_components(pair[:, 0], pair[:, 1])
    use = node != low
    return pa.table({"a": pa.array(low[use], pa.int64()), "b": pa.array(node[use], pa.int64())})


class PrefixTree:
    """Sets of numbers in a path-compressed tree. Sets are ascending; equal beginnings are stored once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        key = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=key.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        lcp = np.zeros(max(len(sets) - 1, 0), np.int64)
        for i in range(len(lcp)):
            a, b = self.sets[i], self.sets[i + 1]
            m = min(len(a), len(b))
            d = np.flatnonzero(a[:m] != b[:m])
            lcp[i] = d[0] if len(d) else m
        # nodes: first and past-last set below, depth reached, depth above, children
        self.nodes: list[tuple[int, int, int, int, list[int]]] = []
        self.root = self._build(lcp)

    def _build(self, lcp: np.ndarray) -> int:
        def node(lo: int, hi: int, above: int) -> int:
            depth = int(lcp[lo : hi - 1].min()) if hi - lo > 1 else len(self.sets[lo])
            self.nodes.append((lo, hi, depth, above, []))
            return len(self.nodes) - 1

        root = node(0, len(self.sets), 0)
        todo = [root]
        while todo:
            lo, hi, depth, _, children = self.nodes[todo.pop()]
            if hi - lo == 1:
                continue
            cut = [lo, *(np.flatnonzero(lcp[lo : hi - 1] == depth) + lo + 1).tolist(), hi]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                children.append(node(a, b, depth))
                todo.append(children[-1])
        self.low = [int(self.size[lo:hi].min()) for lo, hi, *_ in self.nodes]
        self.high = [int(self.size[lo:hi].max()) for lo, hi, *_ in self.nodes]
        return root


def join_sets(sets: list[np.ndarray], left: int | None = None) -> list[tuple[int, int]]:
    """Spanning links of the sets whose similarity is NUM / DEN or more. left: only links between the first `left` sets
    and the others. Sets hold ascending numbers."""
    if len(sets) < 2:
        return []
    # the numbers that most sets hold come first here, so that the tree shares the most
    every = np.concatenate(sets)
    value, code, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(value), np.uint32)
    rank[np.lexsort((value, -count))] = np.arange(len(value), dtype=np.uint32)
    code = rank[code]
    cut = np.cumsum([len(s) for s in sets])[:-1]
    tree = PrefixTree([np.sort(s) for s in np.split(code, cut)])
    # all sets walk the tree together: an edge's shingles are looked up once, in lists of the sets that hold them
    held = np.concatenate(tree.sets).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), tree.size)
    post = owner[np.argsort(held, kind="stable")]
    n_post = np.bincount(held, minlength=len(value))
    first_post = np.cumsum(n_post) - n_post
    first_own = np.cumsum(tree.size) - tree.size
    flat = owner * len(value) + held
    side = None if left is None else np.array([i < left for i in tree.order])
    label, found = _neighbours(held, first_own, tree.size, flat, len(value), side)
    links = [(tree.order[i], tree.order[j]) for i, j in found]
    stack = [(tree.root, np.arange(len(sets)), np.zeros(len(sets), np.int64))]
    while stack:
        v, x, got = stack.pop()
        lo, hi, depth, above, children = tree.nodes[v]
        n = tree.size[x]
        # each pair meets once, at the earlier set's leaf
        use = (x > lo) & (tree.high[v] * DEN >= NUM * n) & (tree.low[v] * NUM <= DEN * n)
        if (label[lo:hi] == label[lo]).all():
            use &= label[x] != label[lo]
        if hi - lo == 1 and side is not None:
            use &= side[x] != side[lo]
        x, got, n = x[use], got[use], n[use]
        if not len(x):
            continue
        run = tree.sets[lo][above:depth]
        if len(run) * len(x) < len(sets):  # few sets are left: their shingles are looked up instead
            want = (x[:, None] * len(value) + run.astype(np.int64)).ravel()
            at = np.minimum(np.searchsorted(flat, want), len(flat) - 1)
            got = got + (flat[at] == want).reshape(len(x), -1).sum(1)
        else:
            many = n_post[run]
            at = np.repeat(first_post[run] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            got = got + np.bincount(post[at], minlength=len(sets))[x]
        past = np.searchsorted(flat, x * len(value) + int(tree.sets[lo][depth - 1]), "right") - first_own[x] if depth else 0
        # o >= t (n + m - o) for the least size m that lies below, if all that remains agrees
        most = got + np.minimum(n - past, tree.high[v] - depth)
        use = (NUM + DEN) * most >= NUM * (n + max(tree.low[v], depth))
        x, got = x[use], got[use]
        if hi - lo > 1:
            stack.extend((c, x, got) for c in children)
            continue
        joined, one = np.unique(label[x], return_index=True)
        links.extend((tree.order[i], tree.order[lo]) for i in x[one].tolist())
        label[np.isin(label, joined)] = label[lo]
    return links


def _neighbours(held, first, size, flat, n_values, side):
    """Labels of sets that links join, and those links: of neighbours in the tree's order, and by the least hash of their
    shingles under some hash functions. Such links are compared exactly like others. They are most links of a group of near
    copies, which the walk then need not compare pair by pair."""
    n = len(size)
    label, links = np.arange(n), []
    for turn in range(ORDERS):
        if turn:
            low = np.minimum.reduceat(W.mix(held.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * turn & (1 << 64) - 1)), first)
            order = np.lexsort((size, low))
        else:
            order = np.arange(n)
        i, j = order[:-1], order[1:]
        use = (label[i] != label[j]) & (DEN * np.minimum(size[i], size[j]) >= NUM * np.maximum(size[i], size[j]))
        if turn:
            use &= low[i] == low[j]
        if side is not None:
            use &= side[i] != side[j]
        i, j = i[use], j[use]
        if not len(i):
            continue
        row = np.repeat(np.arange(len(i)), size[j])
        at = np.repeat(first[j] - (np.cumsum(size[j]) - size[j]), size[j]) + np.arange(len(row))
        want = i[row] * n_values + held[at]
        hit = flat[np.minimum(np.searchsorted(flat, want), len(flat) - 1)] == want
        common = np.bincount(row[hit], minlength=len(i))
        ok = DEN * common >= NUM * (size[i] + size[j] - common)
        i, j = i[ok], j[ok]
        links.extend(zip(i.tolist(), j.tolist(), strict=True))
        to = np.arange(n)
        node, least = local_components(label[i], label[j])
        to[node] = least
        label = to[label]
    return label, links


def _link(t: pa.Table) -> pa.Table:
    x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
    key, block = t.column("k1").to_numpy(), t.column("block").to_numpy()
    _, one = np.unique(key, return_index=True)  # copies from several chunks
    one = one[np.argsort(block[one] != x, kind="stable")]  # the first block's sets come first
    items = t.column("items").take(pa.array(one))
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in items]
    links = join_sets(sets, None if x == y else int((block[one] == x).sum()))
    a, b = (np.array([key[one[p[i]]] for p in links], np.int64) for i in (0, 1))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z); a document's set is its distinct shingles of SHINGLE words, or all its words as one if
    they are fewer. Two documents link when their sets' Jaccard similarity is NUM / DEN or more. component_id is the
    least doc_id that links reach, the own one included. Null, empty and blank texts have an empty set and no links.
    Rows that share a doc_id are one document with several sets. Null ids come before all others.
    """
    spark = docs.sparkSession
    prepare(spark, BATCH)
    rows = documents(docs)
    n = 4 * partitions(spark)
    chunks = durable(rows.mapInArrow(_chunks, "chunk long, blob binary"))
    asked = chunks.mapInArrow(_ask(n), "bucket int, chunk long, blob binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, blob binary")
    per = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))
    posted = durable(chunks.join(per.hint("shuffle_hash"), "chunk", "left").select("blob", "answers").mapInArrow(_post(n), _POSTED))
    known = posted.where("n is not null").select("doc_id", "n", "k1", "k2")

    met = posted.where("n is null").select("bucket", "blob").groupBy("bucket").applyInArrow(_meet, "a long, b long")
    groups = components(met).select(F.col("node").alias("k1"), F.col("component").alias("group"))
    members = durable(posted.where("items is not null").select("k1", "n").distinct().join(groups, "k1"))
    weight = members.groupBy("group").agg(F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK)), F.ceil(F.count("*") / F.lit(BLOCK_SETS))).cast("int").alias("blocks"))
    placed = members.join(weight, "group").select("group", "k1", "blocks", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int").alias("block"))
    sets = posted.where("items is not null").select("k1", "items").join(placed, "k1")
    # a set of a group of many blocks goes to every pair of blocks that its own is in
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sets = sets.select("group", "k1", "block", "items", other.alias("other")).select("group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "k1", "block", "items")
    links = sets.groupBy("group", "x", "y").applyInArrow(_link, "a long, b long")
    linked = components(links).select(F.col("node").alias("k1"), "component")

    classes = known.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")).join(linked, "k1", "left")
    lowest = classes.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"))
    classes = classes.join(lowest, "component", "left").select("k1", "k2", "n", F.coalesce("low", "rep").alias("component_id"))
    out = known.join(classes, ["k1", "k2", "n"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(public_id(), F.col("n").alias("n_shingles"), public_id("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
