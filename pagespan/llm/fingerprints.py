"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a bag of words weighted by their counts. For slot j and term k with weight w, hashes of (j, k) give uniforms
u1, u2, u3, u4, and with them the gamma variates r = -ln u1 - ln u2 and c = -ln u3 - ln u4 and a uniform b = ln u2 /
(ln u1 + ln u2), which doesn't hang on r. t = floor(ln w / r + b), and the term's key is c exp(-r (t - b + 1)). The least
key over the terms is the slot's sample. Two texts agree in a slot with the probability of their generalised Jaccard
similarity: the sum of least weights over the sum of greatest. A key is a function of slot, term and t, so equal keys
stand for equal samples. As r (1 - b) = -ln u1, the key is c u1 exp(-r t): for terms that occur once, where t = 0,
that costs one hash and one logarithm.

Every term is sampled in every slot, so the share of equal slots is an unbiased estimate for skewed bags too. A slot is
kept as 16 bits, so unequal slots agree by chance once in 65,536 times.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import documents, durable, partitions, public_id, table

SLOTS = 64
SEPARATORS = "[\\x20\\x09-\\x0D]+"


def _uniform(bits: Column, n: int) -> Column:
    """(0, 1) from a number of n bits."""
    return (bits.cast("double") + 0.5) * 2.0**-n


def sample_key(term: Column, log_weight: Column, slot: int) -> Column:
    h = F.xxhash64(term, F.lit(slot))
    u1 = _uniform(F.shiftrightunsigned(h, 32), 32)
    c = -F.log(_uniform(h.bitwiseAND(0xFFFF), 16) * _uniform(F.shiftrightunsigned(h, 16).bitwiseAND(0xFFFF), 16))
    u2 = _uniform(F.shiftrightunsigned(F.xxhash64(term, F.lit(SLOTS + slot)), 32), 32)
    r = -F.log(u1 * u2)
    t = F.floor((log_weight - F.log(u2)) / r)
    # a branch is computed only where it holds; each use of a column is one more copy of its tree in all 64 slots' plan
    return c * u1 * F.when(log_weight == 0, 1.0).otherwise(F.exp(-r * t))


def samples(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, then slots: array of SLOTS doubles.

    No shuffle happens if texts is already dealt out by some of the keys. Texts without words have no row.
    """
    terms = texts.select(*keys, F.explode(F.split(F.col(text), SEPARATORS)).alias("w")).where("w != ''").select(*keys, F.xxhash64("w").alias("term"))
    bag = terms.groupBy(*keys, "term").agg(F.log(F.count("*").cast("double")).alias("lw"))
    least = bag.groupBy(*keys).agg(*(F.min(sample_key(F.col("term"), F.col("lw"), j)).alias(f"k{j}") for j in range(SLOTS)))
    return least.select(*keys, F.array(*(f"k{j}" for j in range(SLOTS))).alias("slots"))


def fingerprint(slots: Column) -> Column:
    """Sixteen bits of each slot as hexadecimal digits; an empty slot is four dashes."""
    one = lambda x: F.when(x.isNull(), F.lit("----")).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(0xFFFF))), 4, "0"))
    return F.array_join(F.transform(slots, one), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots of two fingerprints among those that either text fills; 1 if both are empty."""
    at = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    slot = lambda f, i: F.substring(f, i * 4 + 1, F.lit(4))
    used = F.size(F.filter(at, lambda i: (slot(a, i) != "----") | (slot(b, i) != "----")))
    same = F.size(F.filter(at, lambda i: (slot(a, i) != "----") & (slot(a, i) == slot(b, i))))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / F.greatest(used, F.lit(1))).cast("double")


def _bounds(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """At most n - 1 keys (order, tie) that cut rows into about equal ranges, of a sample of about 32 n keys. They only say
    where a row is worked on. The driver gets the sample as Arrow columns, 16 bytes a key."""
    keys = rows.select("order", "tie")
    count = keys.count()
    got = keys.sample(min(1.0, 32 * n / max(count, 1)), 1).toArrow()
    order, tie = (got[c].to_numpy() for c in ("order", "tie"))
    place = np.lexsort((tie, order))[np.arange(1, n) * len(got) // n] if len(got) else []
    return sorted(set(zip(order[place].tolist(), tie[place].tolist(), strict=True)))


def _range_of(order: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds that are not greater, by binary search."""
    if not bounds:
        return F.lit(0)
    # one literal each: an expression for each bound would be copied by every rule of the optimizer
    first, second = (F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>") for i in (0, 1))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, size: Column) -> Column:
        i = at + size - 1
        x, y = F.get(first, i), F.get(second, i)
        return F.when((i < len(bounds)) & ((x < order) | ((x == order) & (y <= tie))), at + size).otherwise(at)

    # never null, so both readers of the dealt rows share one exchange
    return F.coalesce(F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), step), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, place (in its range), last, doc_id, text, next_text: the text of the next row by descending doc_id, after the last the first.

    Rows are cut into ranges of about equal size by doc_id and, among equal ones, by a hash of the text; the successor
    is found within a range, and each range's last row takes the first of the next range that has rows. Rows that tie by
    id follow each other by that hash, then by text. Any 64-bit ids will do; those that are null come last.
    """
    spark = docs.sparkSession
    tasks = 4 * partitions(spark)
    rows = documents(docs).select(F.bitwise_not("doc_id").alias("order"), F.xxhash64("text").alias("tie"), "text")
    rows = rows.withColumn("bucket", _range_of(F.col("order"), F.col("tie"), _bounds(rows, 2 * tasks)))
    order = Window.partitionBy("bucket").orderBy("order", "tie", "text")
    # one text for each range; each task sends one row a range at most, and there are few ranges for each task
    firsts = durable(rows.groupBy("bucket").agg(F.min_by("text", F.struct("order", "tie", "text")).alias("value")))
    dealt = rows.repartition(tasks, "bucket").select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("following"), F.lead(F.lit(1)).over(order).isNull().alias("last"))
    # joined by range, and used by the last row of each alone: the rows stay where they are
    out = dealt.join(_after(firsts).hint("shuffle_hash"), "bucket", "left")
    return out.select("bucket", "place", "last", F.bitwise_not("order").alias("doc_id"), "text", F.when(F.col("last"), F.col("value")).otherwise(F.col("following")).alias("next_text"))


def _after(firsts: DataFrame) -> DataFrame:
    """bucket, value: the value of the next range that has rows; the last range takes the first's."""
    # a number for each range is all that meets in one task: eight for each shuffle partition, however long the table is
    seen = firsts.select("bucket", F.lead("bucket").over(Window.orderBy("bucket")).alias("next"), F.min("bucket").over(Window.partitionBy()).alias("top"))
    after = seen.select("bucket", F.coalesce("next", "top").alias("after"))
    return after.join(firsts.withColumnRenamed("bucket", "after"), "after").select("bucket", "value")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points, rounded down, replaced by as many of the following text's first, or all."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null and empty texts have no terms and one common fingerprint. Equal texts have equal fingerprints. Repeated
    rows follow each other. near_next compares with the next row's fingerprint; a lone row is its own next.
    """
    rows = with_next(docs)
    halves = rows.select("bucket", "place", "last", "doc_id", "text", edited(F.col("text"), F.col("next_text")).alias("edited"))
    meta = halves.select("bucket", "place", "last", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = halves.select("bucket", "place", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x")).select("bucket", "place", "x.*")
    made = samples(both, ["bucket", "place", "kind"]).select("bucket", "place", "kind", fingerprint(F.col("slots")).alias("f"))
    pair = made.groupBy("bucket", "place").agg(*(F.max(F.when(F.col("kind") == k, F.col("f"))).alias(name) for k, name in enumerate(("fingerprint", "edited_fingerprint"))))
    nothing = F.lit("-" * 4 * SLOTS)
    full = meta.join(pair, ["bucket", "place"], "left").withColumns({c: F.coalesce(c, nothing) for c in ("fingerprint", "edited_fingerprint")})
    full = durable(full)  # fingerprints and lengths only
    order = Window.partitionBy("bucket").orderBy("place")
    full = full.withColumn("following", F.lead("fingerprint").over(order))
    full = full.join(_after(full.where("place = 1").select("bucket", F.col("fingerprint").alias("value"))).hint("shuffle_hash"), "bucket", "left")
    following = F.when(F.col("last"), F.col("value")).otherwise(F.col("following"))
    f = F.col("fingerprint")
    return full.select(public_id(), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(f, F.col("edited_fingerprint")).alias("near_edited"), likeness(f, following).alias("near_next"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
