"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in every whole text. Each candidate value is hashed, and the hashes are counted
over the corpus by distinct owners and repositories. A value that one owner alone holds, in few repositories, looks live;
one that several owners hold, or one owner all over its repositories, is a widely copied example. Long mixed tokens that
no named pattern covers count as secrets only if they are owner-specific.

The text between matches and the matches themselves alternate, so running sums of their lengths give the places. They
are summed by a window over the matches' lengths, in linear time however many matches a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

# Patterns of the scan's contract. The last number is the group that holds the secret, then its least length.
BASE_KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "vendor": (r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    "mixed": (r"[A-Za-z0-9_+/-]{20,}", 0, 20),
}
#: What a value must hold to be of a kind, besides its pattern.
MUST = {"mixed": ("[0-9]", "[a-z]", "[A-Z]")}
#: At most so many owners, and repositories of theirs, for a value to be owner-specific.
OWNERS, REPOSITORIES = 1, 2


def found(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches as array of (gap, whole, rank, value): lengths in code points of the text before a
    match and of the match, and a hash of the value, or null if the value fails."""
    pattern, group, least = PATTERNS[kind]
    rank = list(PATTERNS).index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))

    def one(x: Column) -> Column:
        good = F.length(x["value"]) >= least
        for p in MUST.get(kind, ()):
            good &= x["value"].rlike(p)
        return F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), F.lit(rank).alias("rank"), F.when(good, F.sha2(x["value"], 256)).alias("value"))

    every = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), one)
    return F.when(text.rlike(pattern), every)


def listed(hits: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, PATTERNS))
    return F.array_join(F.transform(F.array_sort(hits), lambda x: F.concat_ws(":", names[x["rank"]], x["start"], x["stop"])), ",")


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base (list of base spans), spans (all spans),
    n_owner_specific, n_widely_copied (found values by ownership), most_repositories.

    Null and empty texts have no spans. Repeated rows are scanned each and count once per owner and repository.
    A null owner or repository counts as one unknown owner or repository.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit(None).cast("array<struct<gap: int, whole: int, rank: int, value: string>>")
    rows = docs.select("doc_id", F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"), F.array(*(F.coalesce(found(text, k), none) for k in PATTERNS)).alias("kinds"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))  # lengths and hashes only, no texts
    kinds = rows.where(F.exists("kinds", lambda k: k.isNotNull())).select("row", "owner", "repository", F.explode("kinds").alias("k")).where("k is not null")
    each = kinds.select("row", "owner", "repository", F.posexplode("k").alias("i", "hit")).select("row", "owner", "repository", "i", "hit.*")
    upto = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("stop", F.sum(F.col("gap") + F.col("whole")).over(upto)).where("value is not null")
    each = each.select("row", "owner", "repository", "value", "rank", (F.col("stop") - F.col("whole")).alias("start"), "stop")

    mixed = list(PATTERNS).index("mixed")
    held = each.select("value", "owner", "repository").distinct()  # combines in each task first, so a hot value stays small
    counts = held.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    # a value that a row holds many times meets its counts once for the row
    once = each.groupBy("row", "value").agg(F.collect_list(F.struct("start", "rank", "stop")).alias("hits"))
    known = once.join(counts, "value")
    specific = (F.col("owners") <= OWNERS) & (F.col("repositories") <= REPOSITORIES)
    known = known.withColumn("hits", F.when(specific, F.col("hits")).otherwise(F.filter("hits", lambda x: x["rank"] != mixed)))
    per = known.groupBy("row").agg(
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.sum(F.when(specific, F.size("hits")).otherwise(0)).alias("n_owner_specific"),
        F.sum(F.when(specific, 0).otherwise(F.size("hits"))).alias("n_widely_copied"),
        F.max("repositories").alias("most_repositories"),
    )
    count = lambda i: F.coalesce(F.size(F.filter("hits", lambda x: x["rank"] == i)), F.lit(0)).cast("long")
    base = F.filter("hits", lambda x: x["rank"] < len(BASE_KINDS))
    text_of = lambda hits: F.coalesce(listed(hits), F.lit(""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = rows.select("row", "doc_id").join(per, "row", "left")
    return out.select("doc_id", *(F.when(F.col("hits").isNull(), F.lit(0)).otherwise(count(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)), text_of(base).alias("base"), text_of(F.col("hits")).alias("spans"), zero("n_owner_specific"), zero("n_widely_copied"), zero("most_repositories"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_owner_specific", "n_widely_copied")
