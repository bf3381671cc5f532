"""Runs and their targets as tables: every change is a rewrite of the frame by column expressions.

runs: run_id, status, worker, generation, heartbeat_at, started_at, finished_at, captured_at, total, successful, failed.
targets: run_id, target_id, request_url, cleared_at, status, claimed_by, claim_generation, claimed_at, started_at,
lease_until, finished_at, attempts, last_error. `now` is a column or literal, so results don't hang on the clock.
A run has one writer at a time; an owner is known by worker and generation, which every change checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespan.functions.native import after
from pagespan.sources.sinks import insert_missing

RESUMABLE = ("abandoned", "failed")
TERMINAL = ("completed", "completed_with_errors", "failed", "canceled")
# Target statuses that bar a run's end, by the run's last status.
BLOCKING = {"canceled": ["pending", "running", "abandoned"], "failed": ["running", "abandoned"], "completed": ["pending", "running", "canceled", "abandoned"], "completed_with_errors": ["pending", "running", "canceled", "abandoned"]}
_CLAIM = ("claimed_by", "claim_generation", "claimed_at", "started_at", "lease_until", "finished_at")


def rewrite(df: DataFrame, where: Column, **to) -> DataFrame:
    """UPDATE: columns take new values where the condition holds (null: it doesn't)."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in to.items()})


def update_from(df: DataFrame, other: DataFrame, keys: list[str], **to: str) -> DataFrame:
    """UPDATE ... FROM: columns take the other frame's where the key is there. Its keys are unique."""
    right = other.select(*keys, *(F.col(v).alias(f"_{c}") for c, v in to.items()), F.lit(True).alias("_hit"))
    out = df.join(right, keys, "left")
    return out.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in df.columns))


def owned(runs: DataFrame, run_id: str, worker: str, generation: int) -> DataFrame:
    """The run's id if this owner holds it: one row or none."""
    return runs.filter((F.col("run_id") == run_id) & (F.col("status") == "running") & (F.col("worker") == worker) & (F.col("generation") == generation)).select("run_id")


def fenced(targets: DataFrame, runs: DataFrame, worker: str, generation: int) -> DataFrame:
    """Targets of runs that this owner holds."""
    mine = runs.filter((F.col("status") == "running") & (F.col("worker") == worker) & (F.col("generation") == generation))
    return targets.join(mine.select("run_id"), "run_id", "left_semi")


def with_run(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """targets with the run's status, worker and generation as run_status, run_worker and run_generation."""
    own = runs.select("run_id", F.col("status").alias("run_status"), F.col("worker").alias("run_worker"), F.col("generation").alias("run_generation"))
    return targets.join(own, "run_id")


def _by_run(targets: DataFrame, runs: DataFrame, where, **to) -> DataFrame:
    """rewrite() where the run fits too; all targets stay."""
    own = runs.select("run_id", F.col("status").alias("run_status"), F.col("worker").alias("run_worker"), F.col("generation").alias("run_generation"))
    return rewrite(targets.join(own, "run_id", "left"), where, **to).select(*targets.columns)


def acquire_run(runs: DataFrame, run_id: str, worker: str, now: Column) -> DataFrame:
    """Starts a new run, or takes over an abandoned or failed one with the next generation. Others stay as they are."""
    new = runs.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit("running").alias("status"), F.lit(worker).alias("worker"), F.lit(1).alias("generation"), now.alias("heartbeat_at"), now.alias("started_at"))
    new = insert_missing(runs, new, ["run_id"])
    mine = (F.col("run_id") == run_id) & F.col("status").isin(*RESUMABLE)
    old = rewrite(runs, mine, finished_at=None, heartbeat_at=now, worker=worker, generation=F.col("generation") + 1, status="running")
    typed = new.select(*(F.col(c).cast(f.dataType).alias(c) if c in new.columns else F.lit(0 if c in ("total", "successful", "failed") else None).cast(f.dataType).alias(c) for c, f in ((f.name, f) for f in runs.schema)))
    return old.unionByName(typed)


def _release(why: Column | str = "") -> dict:
    return {c: None for c in _CLAIM} | {"last_error": why}


def reset_resumable(targets: DataFrame, runs: DataFrame, run_id: str, worker: str, generation: int) -> DataFrame:
    """After a takeover: abandoned targets, and canceled ones whose URL is still there, are pending again."""
    again = (F.col("status") == "abandoned") | ((F.col("status") == "canceled") & (F.col("request_url") != "") & F.col("cleared_at").isNull())
    return _by_run(targets, runs, again & _mine(run_id, worker, generation), status="pending", **_release())


def _mine(run_id: str, worker: str, generation: int) -> Column:
    return (F.col("run_id") == run_id) & (F.col("run_status") == "running") & (F.col("run_worker") == worker) & (F.col("run_generation") == generation)


def claimable(worker: Column | str, generation: Column | int, now: Column) -> Column:
    """Pending, or running under a lease of another owner that has run out."""
    w, g = (x if isinstance(x, Column) else F.lit(x) for x in (worker, generation))
    foreign = ~F.col("claimed_by").eqNullSafe(w) | ~F.col("claim_generation").eqNullSafe(g)
    return (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_until") < now) & foreign)


def claim_batch(targets: DataFrame, runs: DataFrame, run_id: str, worker: str, generation: int, now: Column, lease_ms: int, limit: int) -> DataFrame:
    """The next targets by id for this owner, as they are after the claim. At most `limit` rows."""
    open_ = with_run(targets, runs).filter(_mine(run_id, worker, generation) & claimable(worker, generation, now))
    batch = open_.select(*targets.columns).orderBy("target_id").limit(limit)
    lease = after(now, lease_ms / 1000)
    return rewrite(batch, F.lit(True), status="running", claimed_by=worker, claim_generation=generation, claimed_at=now, started_at=None, lease_until=lease, finished_at=None, last_error="")


def claim_limit(batch: int, workers: int, free: int) -> int:
    """As many as workers and free places can take, one at least and a batch at most."""
    room = max(workers, 1) + free
    return batch if room > batch else max(room, 1)


def _claimed(worker: str, generation: int) -> Column:
    return (F.col("status") == "running") & (F.col("claimed_by") == worker) & (F.col("claim_generation") == generation)


def mark_started(targets: DataFrame, runs: DataFrame, run_id: str, target_id: int, worker: str, generation: int, now: Column, lease_ms: int) -> DataFrame:
    hit = (F.col("target_id") == target_id) & _claimed(worker, generation) & _mine(run_id, worker, generation)
    return _by_run(targets, runs, hit, attempts=F.col("attempts") + 1, started_at=now, claimed_at=F.coalesce("claimed_at", now), lease_until=after(now, lease_ms / 1000), finished_at=None, last_error="")


def mark_finished(targets: DataFrame, results: DataFrame, runs: DataFrame, run_id: str, worker: str, generation: int, now: Column) -> DataFrame:
    """Targets that this owner saved a result for are completed or failed. results: run_id, target_id, scan_status, error_message."""
    done = results.select("run_id", "target_id", F.when(F.col("scan_status") == "failed", "failed").otherwise("completed").alias("_to"), F.col("error_message").alias("_why"))
    both = targets.join(done, ["run_id", "target_id"], "left")
    hit = F.col("_to").isNotNull() & _claimed(worker, generation) & _mine(run_id, worker, generation)
    return _by_run(both, runs, hit, status=F.col("_to"), finished_at=now, lease_until=None, last_error=F.coalesce("_why", F.lit(""))).select(*targets.columns)


def heartbeat(runs: DataFrame, targets: DataFrame, run_id: str, worker: str, generation: int, now: Column, lease_ms: int) -> tuple[DataFrame, DataFrame]:
    """The owner's run lives on, and so do the leases of its claims."""
    mine = (F.col("run_id") == run_id) & (F.col("status") == "running") & (F.col("worker") == worker) & (F.col("generation") == generation)
    leased = _by_run(targets, runs, _claimed(worker, generation) & _mine(run_id, worker, generation), lease_until=after(now, lease_ms / 1000))
    return rewrite(runs, mine, heartbeat_at=now), leased


def abandon_stale(runs: DataFrame, cutoff: Column, now: Column) -> DataFrame:
    return rewrite(runs, (F.col("status") == "running") & (F.col("heartbeat_at") < cutoff), status="abandoned", finished_at=now)


def abandon_targets(targets: DataFrame, runs: DataFrame, now: Column, why: str = "run abandoned after stale heartbeat") -> DataFrame:
    """Open targets of abandoned runs are abandoned: one set-oriented pass, whatever their number."""
    hit = (F.col("run_status") == "abandoned") & F.col("status").isin("pending", "running")
    return _by_run(targets, runs, hit, status="abandoned", finished_at=F.coalesce("finished_at", now), lease_until=None, last_error=why)


def settle_targets(targets: DataFrame, runs: DataFrame, run_id: str, to: str, worker: str, generation: int, now: Column, why: str) -> DataFrame:
    """Before a run ends: a canceled run cancels its open targets, a failed one releases them; others change nothing."""
    kept = F.when(F.col("last_error") == "", F.lit(why)).otherwise(F.col("last_error"))
    if to == "canceled":
        hit = F.col("status").isin("pending", "running", "abandoned") & _mine(run_id, worker, generation)
        return _by_run(targets, runs, hit, status="canceled", finished_at=now, lease_until=None, last_error=kept)
    if to == "failed":
        hit = F.col("status").isin("running", "abandoned") & _mine(run_id, worker, generation)
        return _by_run(targets, runs, hit, status="pending", **_release(kept))
    return targets


def finalizable(runs: DataFrame, targets: DataFrame, to: str) -> DataFrame:
    """Runs without a target whose status bars that end."""
    return runs.join(targets.filter(F.col("status").isin(*BLOCKING[to])), "run_id", "left_anti")


def finalize_run(runs: DataFrame, targets: DataFrame, run_id: str, to: str, worker: str, generation: int, now: Column, total: int, successful: int, failed: int) -> DataFrame:
    """Ends the run with its counters; doing so again with the same status changes only the times."""
    check_completion(to, total, successful, failed)
    free = finalizable(runs, targets, to).select("run_id", F.lit(True).alias("_free"))
    both = runs.join(free, "run_id", "left")
    hit = F.col("_free") & (F.col("run_id") == run_id) & F.col("status").isin("running", to) & (F.col("worker") == worker) & (F.col("generation") == generation)
    return rewrite(both, hit, finished_at=now, heartbeat_at=now, total=total, successful=successful, failed=failed, status=to).select(*runs.columns)


def check_completion(status: str, total: int, successful: int, failed: int) -> None:
    if status not in BLOCKING:
        raise ValueError(f"not a final status: {status}")
    if min(total, successful, failed) < 0 or successful + failed > total:
        raise ValueError("counters don't add up")


def clear_urls(targets: DataFrame, runs: DataFrame, now: Column, run_id: str | None = None) -> DataFrame:
    """URLs of finished targets of ended runs are deleted. Pending targets and abandoned runs keep theirs."""
    hit = F.col("run_status").isin(*TERMINAL) & (F.col("request_url") != "") & F.col("status").isin("completed", "failed", "canceled")
    if run_id is not None:
        hit &= F.col("run_id") == run_id
    return _by_run(targets, runs, hit, request_url="", cleared_at=now)


def snapshot(queue: DataFrame, targets: DataFrame, run_id: str) -> DataFrame:
    """New target rows of the active queue for a run; those that are there already aren't repeated."""
    new = queue.filter("is_active").select(F.lit(run_id).alias("run_id"), F.col("id").cast("long").alias("target_id"), F.col("url").alias("request_url"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit("").alias("last_error"))
    return insert_missing(targets, new, ["run_id", "target_id"])


def drop_partial(targets: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """Without the targets of a run whose snapshot was never finished."""
    open_ = runs.filter((F.col("run_id") == run_id) & F.col("captured_at").isNull())
    return targets.join(open_.select("run_id"), "run_id", "left_anti")


def captured(runs: DataFrame, summary: DataFrame, now: Column) -> DataFrame:
    """Runs with their snapshot's totals; the time of capture is kept if there is one."""
    s = summary.select("run_id", F.col("total").alias("_total"), F.col("successful").alias("_successful"), F.col("failed").alias("_failed"), F.lit(True).alias("_hit"))
    out = rewrite(runs.join(s, "run_id", "left"), F.col("_hit"), captured_at=F.coalesce("captured_at", now), total=F.col("_total"), successful=F.col("_successful"), failed=F.col("_failed"))
    return out.select(*runs.columns)


def summarize(targets: DataFrame) -> DataFrame:
    """Totals of each run's targets in one aggregation."""
    return targets.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("target_id").alias("high_watermark"))


def run_counters(total: Column, before_ok: Column, before_failed: Column, queued: Column, skipped: Column, received: Column, ok: Column, failed: Column) -> Column:
    """struct(unprocessed, missing, successful, failed) of a run; negative differences count as none."""
    missing = F.greatest(F.lit(0), queued + skipped - received)
    return F.struct(F.greatest(F.lit(0), total - before_ok - before_failed - queued - skipped).alias("unprocessed"), missing.alias("missing"), (before_ok + ok).alias("successful"), (before_failed + failed + missing).alias("failed"))


def run_outcome(total: Column, stream_error: Column, heartbeat_lost: Column, shutdown: Column, persistence_failures: Column, missing: Column, unprocessed: Column, failed: Column) -> Column:
    """struct(status, exit_code): the first condition that holds decides."""
    out = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("exit_code"))
    return (
        F.when((total == 0) & ~shutdown, out("completed", 0))
        .when(stream_error, out("failed", 1))
        .when(heartbeat_lost, out("failed", 1))
        .when(shutdown, out("canceled", 130))
        .when((persistence_failures > 0) | (missing > 0), out("failed", 1))
        .when(unprocessed > 0, out("failed", 1))
        .when(failed > 0, out("completed_with_errors", 0))
        .otherwise(out("completed", 0))
    )


def stale_exists(runs: DataFrame, cutoff: Column) -> DataFrame:
    """Whether a running run's heartbeat is older: one row, also for an empty table."""
    return runs.agg(F.coalesce(F.bool_or((F.col("status") == "running") & (F.col("heartbeat_at") < cutoff)), F.lit(False)).alias("found"))


def newest(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The last n rows by time; of those that tie, the greatest keys."""
    return df.orderBy(F.desc(by), F.desc(key)).limit(n)
