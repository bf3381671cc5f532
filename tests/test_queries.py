"""Every query against its SQL, and state rules that pages don't reach."""

import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pagespan.functions import native
from pagespan.operators import audit, legacy, state
from pagespan.plans import registry
from pagespan.sources import sinks, tables
from pagespan.streaming.audit_stream import HeartbeatMonitor, audit_stream, stream_responses

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("pages", "documents"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    have = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert have == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def differing(spark, folder, name, pages):
    """Rows that a query and its SQL don't share, over pages of (page_id, url, html) of its own."""
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    df, rel = registry.queries()[name](spark, str(folder)), c.sql(registry.oracle_sql()[name])
    have, want = (Counter(tuple(r[x] for x in at) for r in rows) for at, rows in ((rel.columns, df.collect()), (range(len(rel.columns)), rel.fetchall())))
    return have - want, want - have


def test_legacy_results_whose_url_comes_again(spark, tmp_path):
    none = (Counter(), Counter())
    assert differing(spark, tmp_path, "legacy_import_results", [(i, f"https://a.example/{i % 5}", "") for i in range(20)]) == none
    old = registry.old_results(spark, str(tmp_path))
    once = legacy.import_results(old, "legacy:", registry.now())
    assert sorted(r.target_id for r in once.collect()) == [-4, -3, -2, -1, 0]  # five runs, each with one URL
    assert sum(r.total for r in legacy.import_runs(old, "legacy:", registry.now()).collect()) == 20


def test_durations_round_as_in_c(spark, tmp_path):
    assert differing(spark, tmp_path, "report_rows", [(i, "https://a.example/", "") for i in range(995, 4000)]) == (Counter(), Counter())
    ms = [0, 999, 1000, 1005, 1125, 1135, 1375, 1999, 59_995, 600_005, 2_048_005, 10**9 + 15, 2**53 - 1, 2**63 - 1]
    got = spark.createDataFrame([(x,) for x in ms], "ms long").select("ms", native.duration(F.col("ms")).alias("d")).collect()
    assert {r.ms: r.d for r in got} == {x: f"{x} ms" if x < 1000 else f"{x / 1000:.2f} s" for x in ms}


# what is cut within a reference, and references that close
TITLES = ["", "a title of some length that is&amp", "&amp;&amp;amp; x&am", "&ampx &quot y &quot;z&quot;", "a &copy b &copy; c &middot;&middot", "&lt", "&&amp;&#38"]


def titled():
    return [(i, f"https://h{i % 3}.example/{i}", f"<html><head><title>{TITLES[i % len(TITLES)]}</title></head><body><h1>h</h1><p>one&nbsp;two&nbsp three</p></body></html>") for i in range(154)]


def test_title_status_of_cut_references(spark, tmp_path):
    assert differing(spark, tmp_path, "title_status_by_host", titled()) == (Counter(), Counter())


def test_page_metrics_of_cut_references(spark, tmp_path):
    assert differing(spark, tmp_path, "page_metrics", titled()) == (Counter(), Counter())


def test_audit_run_of_cut_references(spark, tmp_path):
    assert differing(spark, tmp_path, "audit_run", titled()) == (Counter(), Counter())


def test_acquire_and_finalize(spark):
    runs, targets, now = registry.run_frame(spark, DATA), registry.target_frame(spark, DATA), registry.now()
    after = {r.run_id: (r.status, r.generation, r.worker) for r in state.acquire_run(state.acquire_run(runs, "run-2", "w9", now), "new", "w9", now).collect()}
    assert after["run-2"] == ("running", 4, "w9") and after["new"] == ("running", 1, "w9") and after["run-3"][0] == "canceled" and after["run-0"][:2] == ("running", 1)
    done = state.rewrite(targets, F.lit(True), status="completed")
    end = {r.run_id: (r.status, r.total) for r in state.finalize_run(runs, done, "run-0", "completed", "w0", 1, now, 5, 3, 2).collect()}
    assert end["run-0"] == ("completed", 5)
    held = {r.run_id: r.status for r in state.finalize_run(runs, targets, "run-0", "completed", "w0", 1, now, 5, 3, 2).collect()}
    assert held["run-0"] == "running"
    with pytest.raises(ValueError):
        state.check_completion("completed", 1, 1, 1)
    assert (state.claim_limit(100, 3, 2), state.claim_limit(4, 3, 2), state.claim_limit(10, 0, 0)) == (5, 4, 1)


def test_report_files(spark, tmp_path):
    rows = registry.report_rows(spark, DATA).limit(3)
    full = rows.select("*", *(F.lit("<'\">").alias(c) for c in sinks.FIELDS if c not in rows.columns))
    old = [tmp_path / f"audit-2020010{i}-000000-old.html" for i in range(3)]
    for p in old:
        p.write_text("x")
        time.sleep(0.02)
    archive, latest = sinks.write_report(full, str(tmp_path), "0123-4567-89", keep=2)
    assert latest.read_text() == archive.read_text() and "&lt;&#39;&#34;&gt;" in latest.read_text() and "01234567" in archive.name
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([archive.name, latest.name, old[2].name])


def test_report_head(spark, tmp_path):
    rows = registry.report_rows(spark, DATA).orderBy(F.desc("target_id")).limit(3)
    full = rows.select("*", *(F.lit("-").alias(c) for c in sinks.FIELDS if c not in rows.columns and c != "url"), F.col("target_id").cast("string").alias("url"))
    summary = audit.run_summary(registry.run_frame(spark, DATA), "run-3", registry.now())
    text = sinks.write_report(full, str(tmp_path), "run-3", summary=summary)[0].read_text()
    assert '<dd class="tone-warning">Скасовано</dd>' in text and "<dt>Завершення</dt><dd>-</dd>" in text and "<th>Посилання</th>" in text
    ids = [r.target_id for r in rows.orderBy("target_id").collect()]
    at = [text.index(f"<td>{i}</td>") for i in ids]
    assert at == sorted(at)


def test_host_schedule(spark):
    f = [("a", 1, 0, 900, None), ("a", 2, 0, 100, 2000), ("a", 3, 0, 100, None), ("b", 4, 70, None, None), (None, 5, 0, 1, None), ("a", 6, 9000, 1, None)]
    df = spark.createDataFrame(f, "host string, fetch_id long, ready_ms long, duration_ms long, retry_ms long")
    starts = lambda n: {r.fetch_id: r.start_ms for r in audit.host_schedule(df, 500, n).collect()}
    assert starts(1) == {1: 0, 2: 900, 3: 3000, 4: 70, 5: None, 6: 9000}
    assert starts(2) == {1: 0, 2: 500, 3: 2600, 4: 70, 5: None, 6: 9000}
    assert audit.host_schedule(df.limit(0), 500).count() == 0
    with pytest.raises(ValueError):
        audit.host_schedule(df, 500, 0)


def test_stale_exists_of_no_runs(spark):
    assert [r.found for r in state.stale_exists(registry.run_frame(spark, DATA).limit(0), registry.now()).collect()] == [False]


def test_sources_and_stream(spark, tmp_path):
    assert [tuple(r) for r in tables.from_arrays(spark, [1, 2], ["a", "b"]).collect()] == [(1, "a"), (2, "b")]
    r = registry.responses(spark, DATA)
    r.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        audit_stream(stream_responses(spark, str(tmp_path / "in"), r.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == r.count()
    m = HeartbeatMonitor(2)
    assert [m.beat(ok) for ok in (False, True, False, False)] == [True, True, True, False]
