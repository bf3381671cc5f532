"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are compared as word sequences, within an edit bound of one word (inserted, deleted or replaced). In scripts
without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) each character is a word. A line and
all its variants with one word left out are hashed; lines within the bound share a variant, and the places of the
left-out words verify the distance: two lines of equal length are one replacement apart if the same place was left
out, and a whole line equals a variant of a line that is one word longer. So no pairs are listed: each group of
equal variants names its earliest line.

Exact copies collapse first. Of two lines one edit apart, either the first or the second halves agree, so variants
are made only for lines that share a half with another line, and only with words of the other half left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import keyed, partitions, prepare, public_id, table, tied

#: Bounds that a caller gets without asking: lines of fewer words stay; lines of fewer than NEAR_WORDS are compared exactly.
LEAST_WORDS, NEAR_WORDS = 4, 8
#: Bounds of the query and the pipeline: every line with a word goes if it stands earlier; one edit is looked for from
#: four words on, as it changes a third or more of a shorter line.
EVERY = {"least": 1, "near": 4}
REMOVED = "doc_id long, line long, first_doc_id long, first_line long, edits int"
_FULL = -1


def _lines(buf: np.ndarray, off: np.ndarray):
    """Words of each line: Words over lines, the text of each line, and its number in the text (from 0)."""
    ends = np.flatnonzero(buf == 10)
    cuts = np.unique(np.concatenate([off, ends + 1]))
    cuts = cuts[cuts <= len(buf)]
    low = W.lower(buf)
    w = _split(low, cuts)
    doc = np.searchsorted(off, cuts[:-1], "right") - 1
    first = np.searchsorted(cuts, off[doc])
    return w, doc, np.arange(len(cuts) - 1) - first


def _split(buf: np.ndarray, off: np.ndarray) -> W.Words:
    """Words between white space, cut before and after each character of a script without spaces."""
    w = W.split(buf, off)
    if not (buf >= 0xE0).any():
        return w
    a, b = buf[:-1], buf[1:]
    alone = ((a >= 0xE3) & (a <= 0xE9)) | ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB))
    alone |= (a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | ((b >= 0x9E) & (b <= 0x9F)))
    alone |= ((a == 0xEF) & (b >= 0xA4) & (b <= 0xAB)) | ((a == 0xF0) & (b >= 0xA0) & (b <= 0xAF))
    at = np.flatnonzero(alone)
    stop = at + np.where(buf[at] < 0xF0, 3, 4)
    cut = np.union1d(at[~np.isin(at, w.start)], stop[~np.isin(stop, w.end)])
    start = np.union1d(w.start, cut)
    return W.Words(buf, start, np.union1d(w.end, cut), np.searchsorted(start, off))


class Sums:
    """Prefix sums of word hashes: a hash of any range of words in constant time, and of a range less one word."""

    Q = 0xA0761D6478BD642F
    QI = W.inverse(0xA0761D6478BD642F)

    def __init__(self, h: np.ndarray) -> None:
        self.cum = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * W.powers(self.Q, len(h) + 1)[:-1], out=self.cum[1:])
        self.back = W.powers(self.QI, len(h) + 1)

    def range(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.cum[b] - self.cum[a]) * self.back[a]

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Words a .. b without i, as if they stood together."""
        left, right = self.cum[i] - self.cum[a], self.cum[b] - self.cum[i + 1]
        return (left + right * np.uint64(self.QI)) * self.back[a]


def _final(x: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    return W.mix(x + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind * 0x2545F4914F6CDD1D & (1 << 64) - 1))


def _whole(least: int):
    def whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each line of `least` words or more: its hash, and the hashes of its halves."""
        for batch in batches:
            ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in W.slices(batch.column(2)):
                w, doc, line = _lines(*W.raw(batch.column(2).slice(i, j - i)))
                n = np.diff(w.first)
                at = np.flatnonzero(n >= least)
                if not len(at):
                    continue
                sums, a, b, n = Sums(w.hashes()), w.first[:-1][at], w.first[1:][at], n[at]
                whole = _final(sums.range(a, b), n, 0)
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(ids[i:j][doc[at]]), pa.array(ties[i:j][doc[at]]), pa.array(line[at].astype(np.int64)), pa.array(n.astype(np.int32)), *(pa.array(k.view(np.int64)) for k in _halves(sums, a, b, n))], ["whole", "doc_id", "tie", "line", "n", "p0", "p1", "s0", "s1"])

    return whole_lines


def _halves(sums: Sums, a, b, n):
    """First and last words: half of n, and half of n - 1 for lines one word shorter."""
    out = []
    for m in (n // 2, (n - 1) // 2):
        out.append(_final(sums.range(a, a + m), m, 1))
    for m in (n // 2, (n - 1) // 2):
        out.append(_final(sums.range(b - m, b), m, 2))
    return out


def _variants(n_bucket: int, near: int):
    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "tie"))
            text, active = batch.column("text"), batch.column("active")
            for i, j in W.slices(text, 1 << 20):
                w, doc, line = _lines(*W.raw(text.slice(i, j - i)))
                own = active.slice(i, j - i)
                off = own.offsets.to_numpy() - own.offsets[0].as_py()
                code = own.flatten().to_numpy()  # line * 4 + sides
                of = np.repeat(np.arange(j - i), np.diff(off))
                start = np.searchsorted(doc, of)
                at = start + code // 4
                ok = at < len(doc)
                ok[ok] &= doc[at[ok]] == of[ok]
                at, side = at[ok], code[ok] % 4
                a, b = w.first[:-1][at], w.first[1:][at]
                n = b - a
                ok = n >= near
                at, side, a, b, n = at[ok], side[ok], a[ok], b[ok], n[ok]
                if not len(at):
                    continue
                sums = Sums(w.hashes())
                # side 1: the first half is shared, so the edit lies beyond it; side 2: the other way
                lo, hi = np.where(side == 1, a + (n - 1) // 2, a), np.where(side == 2, b - (n - 1) // 2, b)
                k = hi - lo
                row = np.repeat(np.arange(len(at)), k)
                gone = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                key = np.concatenate([_final(sums.range(a, b), n, 0), _final(sums.without(a[row], b[row], gone), n[row] - 1, 0)])
                row = np.concatenate([np.arange(len(at)), row])
                place = np.concatenate([np.full(len(at), _FULL), gone - a[row[len(at) :]]])
                for x in range(0, len(key), 1 << 16):
                    y = slice(x, x + (1 << 16))
                    r = at[row[y]]
                    yield pa.RecordBatch.from_arrays([pa.array((key[y] % np.uint64(n_bucket)).astype(np.int32)), pa.array(key[y].view(np.int64)), pa.array(ids[i:j][doc[r]]), pa.array(ties[i:j][doc[r]]), pa.array(line[r].astype(np.int32)), pa.array(place[y].astype(np.int32))], ["bucket", "key", "doc_id", "tie", "line", "place"])

    return variants


def _join(t: pa.Table) -> pa.Table:
    """Lines that have an earlier line within one edit, by equal variants."""
    key, doc, tie, line, place = (t.column(c).to_numpy() for c in ("key", "doc_id", "tie", "line", "place"))
    # a variant whose key occurs once joins nothing
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    order = order[same[1:] | same[:-1]]
    order = order[np.lexsort((line[order], tie[order], doc[order], place[order], key[order]))]
    key, doc, tie, line, place = (x[order] for x in (key, doc, tie, line, place))
    late, lead = [], []
    if len(order):
        # replaced: equal key and place; the first of each run is the earliest
        new = np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        at = np.flatnonzero((place != _FULL) & ((doc != doc[head]) | (tie != tie[head]) | (line != line[head])))
        late.append(at)
        lead.append(head[at])
        # inserted or deleted: whole lines against variants of the same key (whole lines sort first)
        group = np.append(True, key[1:] != key[:-1])
        head = np.flatnonzero(group)[np.cumsum(group) - 1]
        v = np.flatnonzero((place[head] == _FULL) & (place != _FULL))
        g = head[v]
        earlier = (doc[g] < doc[v]) | ((doc[g] == doc[v]) & ((tie[g] < tie[v]) | ((tie[g] == tie[v]) & (line[g] < line[v]))))
        late.append(v[earlier])
        lead.append(g[earlier])
        v, g = v[~earlier], g[~earlier]
        if len(v):  # the whole line is the later one: its earliest partner
            o = np.lexsort((line[v], tie[v], doc[v], g))
            v, g = v[o], g[o]
            f = np.append(True, g[1:] != g[:-1])
            late.append(g[f])
            lead.append(v[f])
    x, y = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (late, lead))
    cols = {"doc_id": doc[x], "tie": tie[x], "line": line[x], "first_doc_id": doc[y], "first_tie": tie[y], "first_line": line[y]}
    return pa.table({n: pa.array(c.astype(np.int64)) for n, c in cols.items()})


def _gone(rows: DataFrame, least: int, near: int) -> DataFrame:
    """doc_id, tie, line, first_doc_id, first_line, edits of the lines that go."""
    spark = rows.sparkSession
    prepare(spark)
    n = 8 * partitions(spark)
    lines = rows.mapInArrow(_whole(least), "whole long, doc_id long, tie long, line long, n int, p0 long, p1 long, s0 long, s1 long")
    place = ["doc_id", "tie", "line"]
    # distinct lines with their earliest place: tasks combine copies first, so a very common line stays small
    kinds = lines.groupBy("whole").agg(F.min(F.struct(*place)).alias("first"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("p0", "p1", "s0", "s1")))
    exact = lines.select("whole", *place).join(kinds.select("whole", "first"), "whole")
    exact = exact.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("tie") != F.col("first.tie")) | (F.col("line") != F.col("first.line")))
    exact = exact.select(*place, *(F.col(f"first.{c}").alias(f"first_{c}") for c in place), F.lit(0).alias("edits"))

    halves = kinds.where(F.col("n") >= near).select(*(F.col(f"first.{c}").alias(c) for c in place), F.explode(F.array(*(F.struct(F.col(c).alias("half"), F.lit(side).alias("side")) for c, side in (("p0", 1), ("p1", 1), ("s0", 2), ("s1", 2))))).alias("x"))
    halves = halves.select(*place, "x.*").distinct()
    bucketed = halves.withColumn("bucket", F.pmod("half", F.lit(n)).cast("int"))
    active = bucketed.groupBy("bucket").applyInArrow(_shared, "doc_id long, tie long, line long, side int")
    active = active.groupBy(*place).agg(F.bit_or("side").alias("side")).groupBy("doc_id", "tie").agg(F.collect_list(F.col("line") * 4 + F.col("side")).alias("active"))
    close = rows.join(active.hint("shuffle_hash"), ["doc_id", "tie"]).select("doc_id", "tie", "text", "active")
    close = close.mapInArrow(_variants(n, near), "bucket int, key long, doc_id long, tie long, line int, place int")
    close = close.groupBy("bucket").applyInArrow(_join, "doc_id long, tie long, line long, first_doc_id long, first_tie long, first_line long")
    every = exact.union(close.withColumn("edits", F.lit(1)))
    return every.groupBy(*place).agg(F.min(F.struct("edits", "first_doc_id", "first_tie", "first_line")).alias("x")).select(*place, "x.first_doc_id", "x.first_line", "x.edits")


def repeated_lines(docs: DataFrame, least: int = LEAST_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """One row per removed line: doc_id, tie, line (from 0), first_doc_id, first_line, edits (0: equal words, 1: one edit).

    A line goes if an earlier line (smaller doc_id, or the same document and earlier) has the same words (A-Z in lower
    case, white space aside) or, among lines of `near` words or more, is one word edit away; judged on the
    input, not on what is left. first_* name the earliest equal line, else the earliest line one edit away. Lines of
    fewer than `least` words stay. Rows that share a doc_id and a text are one document, and remove nothing from each
    other; rows that share a doc_id alone are documents in the order of a hash of their texts, and tie tells them apart.
    Null ids are shared in this sense and come first. Null and empty texts have no lines to remove. Words are
    compared by 64-bit hashes.
    """
    return _gone(keyed(docs), least, near).select(public_id(), "tie", "line", public_id("first_doc_id"), "first_line", "edits")


def _shared(t: pa.Table) -> pa.Table:
    """Lines whose half is another line's half too."""
    half = t.column("half").to_numpy()
    order = np.argsort(half, kind="stable")
    s = half[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    return t.select(["doc_id", "tie", "line", "side"]).take(pa.array(order[same[1:] | same[:-1]]))


def without_lines(docs: DataFrame, least: int = LEAST_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """docs with the repeated lines cut from text; the other columns pass through, but n_chars follows the text.

    Texts that lose nothing stay as they are, nulls too. A text that loses every line becomes empty. Which rows are one
    document is said at repeated_lines(): they lose the same lines.
    """
    gone = _gone(keyed(docs), least, near).groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_set(F.col("line").cast("int")).alias("_gone"))
    both = tied(docs).join(gone.hint("shuffle_hash"), ["_id", "_tie"], "left").withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("text", "\n", -1)))
    # set difference hashes, so long texts that lose many lines take linear time
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    out = both.withColumn("text", F.when(F.col("_lines").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents"), **EVERY).drop("tie")
