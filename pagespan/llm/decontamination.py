"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, windows of the template words are joined by hash with the
benchmark's windows, and aligned windows of one document and item are checked for slot consistency: equal values
of the item must stand for equal values of the document, and different ones for different ones. So a question that
was asked again with other numbers or names is caught, and one that merely shares a phrase is not.

The benchmark's index goes to the executors in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import NO_ID, documents, prepare, public_id, table
from .line_dedup import Sums

WINDOW, LEAST_LITERALS, COVERAGE, CONSISTENCY = 8, 5, 0.6, 0.8
#: Words of the longest window that is made for want of literals; literals of an item that is matched as a whole.
LONGEST, LEAST_WHOLE = 32, 3
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 8 << 20
UNITS = "mm cm m km g kg mg t ml l s ms min h hr hrs hour hours day days week weeks month months year years inch inches ft feet foot mile miles yd lb lbs oz usd eur gbp dollar dollars cent cents euro euros percent degree degrees mph kph w kw mw v a hz khz mhz ghz b kb mb gb tb".split()
SCHEMA = "doc_id long, item_id long, n_matched long, item_words long, coverage double, n_slots long, consistency double, verbatim boolean, start long, stop long"

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (11, 13, 17))


def _hash_words(ws: list[str]) -> np.ndarray:
    buf, off = W.raw(pa.array(ws, pa.string()))
    return W.span_hashes(buf, off[:-1], off[1:])


def templates(buf: np.ndarray, off: np.ndarray) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, hash of each word in lower case without outer punctuation, template hash, and whether it is a slot."""
    w = W.split(buf, off)
    n = len(w.start)
    if not n:
        z = np.zeros(0, np.uint64)
        return w, z, z, np.zeros(0, bool)
    s, e = w.start.copy(), w.end.copy()
    for _ in range(3):
        s += (s < e) & _PUNCT[buf[np.minimum(s, len(buf) - 1)]]
        e -= (s < e) & _PUNCT[buf[e - 1]]
    value = W.span_hashes(W.lower(buf), s, e)
    c = buf[np.minimum(s, len(buf) - 1)]
    d = buf[np.minimum(s + 1, len(buf) - 1)]
    number = (s < e) & (c >= 48) & (c < 58)
    lines = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(buf == 10, out=lines[1:])
    opens = np.ones(n, bool)
    opens[1:] = _STOP[buf[w.end[:-1] - 1]] | (lines[w.start[1:]] > lines[w.end[:-1]])
    opens[w.first[:-1][w.first[:-1] < n]] = True
    capital = ((c >= 65) & (c < 91) & (d >= 97) & (d < 123)) | ((c == 0xC3) & (d >= 0x80) & (d < 0x9F))
    name = (e - s > 1) & capital & ~opens
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1]
    at = np.flatnonzero(unit)
    unit[at] = np.isin(value[at], _UNIT_HASHES)
    t = value.copy()
    t[number], t[name], t[unit] = _NUM, _NAME, _UNIT
    return w, value, t, number | name | unit


_UNIT_HASHES = _hash_words(UNITS)


def _keys(sums: Sums, at: np.ndarray, n: np.ndarray | int, exact: bool) -> np.ndarray:
    """Hash of the n words from each place, apart for templates and values."""
    n = np.full(len(at), n) if np.isscalar(n) else n
    return W.mix(sums.range(at, at + n)) ^ (2 * n + exact).astype(np.uint64)


class Index:
    """Windows of some benchmark items, every one. An item of fewer than `window` words is one window of its own length.

    Windows of `literals` literal words or more are kept by template. The others are kept by their values, so that
    verbatim copies are found, and each by template in the shortest window of LONGEST words at most that holds it
    and enough literals, or in the whole item.
    """

    def __init__(self, ids: list[int], texts: list[str], window: int = WINDOW, literals: int = LEAST_LITERALS) -> None:
        buf, off = W.raw(pa.array(texts, pa.string()))
        w, self.value, t, self.slot = templates(buf, off)
        self.ids, self.first = ids, w.first
        size = np.diff(w.first)
        begin, end = np.repeat(w.first[:-1], size), np.repeat(w.first[1:], size)
        solid = np.concatenate([[0], np.cumsum(~self.slot)])
        at = np.arange(len(t))
        n = np.minimum(window, end - begin)
        at, n = at[at + n <= end], n[at + n <= end]
        few = solid[at + n] - solid[at] < np.minimum(literals, n)
        # an item's first word may be a name where it stands inside a sentence
        own = few | (at == begin[at])
        long_at, long_n = self._longer(at[few], n[few], begin, end, solid, literals)
        wide = np.unique(np.stack([np.concatenate([at[~few], long_at]), np.concatenate([n[~few], long_n])]), axis=1)
        key = np.concatenate([_keys(Sums(t), *wide, False), _keys(Sums(self.value), at[own], n[own], True)])
        place, length = np.concatenate([wide[0], at[own]]), np.concatenate([2 * wide[1], 2 * n[own] + 1])
        order = np.argsort(key, kind="stable")
        self.key, self.place, self.length = key[order], place[order], length[order]
        self.lengths = sorted(set(length.tolist()))  # twice the words, and one for values
        self.item = np.repeat(np.arange(len(ids)), size)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def _longer(at, n, begin, end, solid, literals):
        """For each window the shortest that extends it to the right, else to the left, and holds enough literals; else the item."""
        lo, hi, out = begin[at], end[at], []
        for left in (False, True):
            for m in range(int(n.min(initial=LONGEST)) + 1, LONGEST + 1):
                a = at + n - m if left else at
                ok = (m > n) & (a >= lo) & (a + m <= hi)
                ok[ok] = solid[a[ok] + m] - solid[a[ok]] >= literals
                out.append((a[ok], np.full(int(ok.sum()), m)))
                at, n, lo, hi = at[~ok], n[~ok], lo[~ok], hi[~ok]
        whole = (hi - lo <= LONGEST) & (solid[hi] - solid[lo] >= LEAST_WHOLE)
        out.append((lo[whole], (hi - lo)[whole]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def matches(self, doc_ids: np.ndarray, buf: np.ndarray, off: np.ndarray, coverage: float, consistency: float) -> list[tuple]:
        w, value, t, _ = templates(buf, off)
        mine, theirs, size = [], [], []
        sums = (Sums(t), Sums(value))
        for kind in self.lengths:
            n, exact = divmod(kind, 2)
            at = W.inside(w.first, n)
            h = _keys(sums[exact], at, n, bool(exact))
            may = self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            at, h = at[may], h[may]
            lo, hi = np.searchsorted(self.key, h), np.searchsorted(self.key, h, "right")
            k = hi - lo
            post = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            right = self.length[post] == kind
            mine.append(np.repeat(at, k)[right])
            theirs.append(self.place[post][right])
            size.append(np.full(int(right.sum()), n))
        mine, theirs, size = map(np.concatenate, (mine, theirs, size)) if mine else (np.zeros(0, np.int64),) * 3
        if not len(mine):
            return []
        doc = np.searchsorted(w.first, mine, "right") - 1
        item = self.item[theirs]
        order = np.lexsort((mine, mine - theirs, item, doc))
        mine, theirs, size, doc, item = mine[order], theirs[order], size[order], doc[order], item[order]
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
        out = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
            found = self._judge(mine[a:b], theirs[a:b], size[a:b], int(item[a]), value)
            if found and found[2] >= coverage and found[4] >= consistency:
                base = int(w.first[doc[a]])
                out.append((int(doc_ids[doc[a]]), int(self.ids[item[a]]), *found[:-2], int(found[-2] - base), int(found[-1] - base)))
        return out

    def _judge(self, mine, theirs, size, item, value):
        """Coverage of the item by aligned words, and how consistently its slots are filled."""
        words = int(self.first[item + 1] - self.first[item])
        best: dict[int, int] = {}  # word of the item -> word of the document, by the longest alignment
        shift = mine - theirs
        by = Counter()
        for d, n in zip(shift.tolist(), size.tolist(), strict=True):
            by[d] += n
        covered = defaultdict(set)
        for d, i, n in zip(shift.tolist(), theirs.tolist(), size.tolist(), strict=True):
            covered[d].update(range(i, i + n))
        for d, _ in sorted(by.items(), key=lambda x: (-x[1], x[0])):
            for i in sorted(covered[d]):  # of values that fill a slot equally often, the first in the item counts
                best.setdefault(i, i + d)
        slots = [(int(self.value[i]), int(value[j])) for i, j in best.items() if self.slot[i]]
        fill, back = defaultdict(Counter), defaultdict(Counter)
        for x, y in slots:
            fill[x][y] += 1
            back[y][x] += 1
        agree = sum(fill[x].most_common(1)[0][0] == y and back[y].most_common(1)[0][0] == x for x, y in slots)
        same = all(x == y for x, y in slots)
        return len(best), words, len(best) / words, len(slots), agree / len(slots) if slots else 1.0, same, min(best.values()), max(best.values()) + 1


def _blocks(benchmark: DataFrame):
    """The benchmark's items in blocks of BLOCK_CHARS: the driver holds one at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    ids, texts, size = [], [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
        if size >= BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """One row for each document and item where template windows cover at least `coverage` of the item's words and
    at least `consistency` of its slots are filled consistently.

    verbatim: all slots hold the item's own values. start, stop: words of the document. Null and empty texts match
    nothing. Windows of fewer than LEAST_LITERALS literal words match by their values, or by template as part of a
    longer window or of an item with LEAST_WHOLE literals: an item of numbers, units and names alone is found with
    its own values only. Repeated rows give equal rows. An empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = documents(docs)
    out = None
    for ids, texts in _blocks(benchmark):
        held = spark.sparkContext.broadcast(Index(ids, texts, window))  # of BLOCK_CHARS of text at most

        def match(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            for batch in batches:
                id_ = batch.column(0).to_numpy(zero_copy_only=False)
                for i, j in W.slices(batch.column(1)):
                    got = held.value.matches(id_[i:j], *W.raw(batch.column(1).slice(i, j - i)), coverage, consistency)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], names)

        part = rows.mapInArrow(match, SCHEMA)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], SCHEMA)
    return out.select(public_id(), public_id("item_id"), *out.columns[2:])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
