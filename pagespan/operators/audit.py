"""From targets, robots rules and responses to result rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespan.functions import html, native, robots, udfs, urls
from pagespan.functions.text import BOUNDS, rebounded

_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64()}


def make_targets(df: DataFrame, key: bytes) -> DataFrame:
    """id, url -> target_id, request_url, safe_url, fingerprint, url_error. What is no target keeps its raw URL's fingerprint."""
    out = df.select(F.col("id").cast("long").alias("target_id"), F.col("url").alias("raw"), udfs.normalize_target("url").alias("request_url"), udfs.redact_url("url").alias("safe_url"), udfs.target_error("url").alias("url_error"))
    return out.select("target_id", "request_url", "safe_url", native.hmac_sha256(key, F.coalesce("request_url", "raw")).alias("fingerprint"), "url_error")


def robots_key(url: str) -> str | None:
    """Scheme and authority: what one robots.txt holds for."""
    try:
        u = urls.parse(url)
        return f"{u.scheme.lower()}://{urls.authority_key(u)}"
    except urls.UrlError:
        return None


def rule_matches(rule: Column, path: Column) -> Column:
    """robots.Rule.matches() of struct(pieces, anchored): the fold holds the place behind the last piece, or 0."""
    pieces, last = rule["pieces"], F.element_at(rule["pieces"], -1)
    first, n = F.get(pieces, F.lit(0)), F.size(pieces)
    middle = F.slice(pieces, F.lit(2), F.when(n == 1, 0).when(rule["anchored"], n - 2).otherwise(n - 1))

    def step(at: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, path, at)
        return F.when((at == 0) | (piece == ""), at).when(found == 0, 0).otherwise(found + F.length(piece))

    behind = F.aggregate(middle, F.length(first) + 1, step)
    end = F.when(rule["anchored"], path.endswith(last) & (F.length(path) - F.length(last) + 1 >= behind)).otherwise(True)
    return F.when(n == 1, F.when(rule["anchored"], path == first).otherwise(path.startswith(first))).otherwise(path.startswith(first) & (behind > 0) & end)


def robots_verdicts(targets: DataFrame, policies: DataFrame, user_agent: str) -> DataFrame:
    """targets with robots_outcome (allowed, disallowed, unavailable). targets: request_url; policies: authority, status,
    body, and fetched_at where an authority has several: the latest counts, of those that tie the greatest status and body.

    Policies are parsed once for each authority and joined as rule lists; Spark broadcasts them if they are small.
    An authority without a policy row is unavailable.
    """
    rule = "array<struct<allow: boolean, pieces: array<string>, anchored: boolean>>"

    @F.arrow_udf(rule)
    def compiled(body: pa.Array) -> pa.Array:
        out = []
        for b in body.to_pylist():
            try:
                found = sorted(robots.rules_for(b or "", user_agent), key=lambda r: (-r.specificity, not r.allow))
                out.append([{"allow": r.allow, "pieces": r.pieces, "anchored": r.anchored} for r in found])
            except robots.PolicyError:
                out.append(None)
        return pa.array(out, pa.list_(pa.struct([("allow", pa.bool_()), ("pieces", pa.list_(pa.string())), ("anchored", pa.bool_())])))

    @F.arrow_udf("struct<authority: string, path: string>")
    def located(url: pa.Array) -> pa.Array:
        out = []
        for v in url.to_pylist():
            key = robots_key(v) if v else None
            out.append(None if key is None else {"authority": key, "path": robots.request_path(urls.parse(v))})
        return pa.array(out, pa.struct([("authority", pa.string()), ("path", pa.string())]))

    s = F.col("status")
    state = F.when((s >= 200) & (s < 300), "parse").when((s >= 400) & (s < 500), "allow_all").otherwise("unavailable")
    age = ["fetched_at"] if "fetched_at" in policies.columns else []
    latest = policies.groupBy("authority").agg(F.max(F.struct(*age, "status", "body")).alias("x")).select("authority", "x.status", "x.body")
    one = latest.select("authority", state.alias("_state"), F.when(state == "parse", compiled("body")).alias("_rules"))
    at = targets.withColumn("_at", located("request_url"))
    both = at.join(one, at["_at.authority"] == one["authority"], "left")
    decide = F.filter(F.col("_rules"), lambda r: rule_matches(r, F.col("_at.path")))
    free = F.split_part(F.col("_at.path"), F.lit("?"), F.lit(1)) == "/robots.txt"
    verdict = (
        F.when(F.col("_state").isNull() | (F.col("_state") == "unavailable"), "unavailable")
        .when((F.col("_state") == "allow_all") | free, "allowed")
        .when(F.col("_rules").isNull(), "unavailable")
        .when(F.coalesce(F.get(decide, F.lit(0))["allow"], F.lit(True)), "allowed")
        .otherwise("disallowed")
    )
    return both.select(*targets.columns, verdict.alias("robots_outcome"))


def audit_pages(responses: DataFrame, max_body: int = 5 << 20, max_token: int = 512 << 10, bare: bool = True) -> DataFrame:
    """responses with one struct column `page` of all metrics and `parse_error`. responses: url, status, body (string or
    binary), content_type, x_robots (array). bare: whether character references may lack their semicolon, as HTML has it.
    One Arrow call a page; filter and narrow responses before."""
    names = responses.columns
    fields = ", ".join(f"{k}: {v}" for k, v in html.FIELDS.items())
    schema = responses.select("*", F.lit(None).cast(f"struct<{fields}>").alias("page"), F.lit("").alias("parse_error")).schema
    kind = pa.struct([(k, _ARROW[v]) for k, v in html.FIELDS.items()])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(names.index(n)) for n in ("url", "status", "body", "content_type", "x_robots")}
            pages, errors = [], []
            for i in range(len(b)):
                v = {n: c[i].as_py() for n, c in col.items()}
                body = v["body"] or b""
                page, error = html.parse_page(v["status"], body.encode() if isinstance(body, str) else body, v["url"] or "", v["content_type"], v["x_robots"] or [], max_body, max_token, bare)
                pages.append(page)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pages, kind), pa.array(errors, pa.string())], [*names, "page", "parse_error"])

    return responses.mapInArrow(parse, schema)


def classify(url_error: Column, robots_outcome: Column, request_error: Column, network_error: Column, status: Column, content_type: Column, parse_error: Column) -> Column:
    """struct(scan_status, error_code, robots_outcome, robots_allowed, status_code, is_redirect) of a target: the first that holds."""

    def row(scan, code, outcome, allowed, status_code, redirect=False):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(scan).alias("scan_status"), lit(code).alias("error_code"), lit(outcome).alias("robots_outcome"), lit(allowed).alias("robots_allowed"), lit(status_code).cast("int").alias("status_code"), lit(redirect).alias("is_redirect"))

    ok = ("allowed", True)
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(some(url_error), row("failed", "invalid_target_url", "not_checked", False, None))
        .when(robots_outcome == "unavailable", row("failed", "robots_unavailable", "unavailable", False, None))
        .when(robots_outcome == "disallowed", row("blocked_by_robots", "", "disallowed", False, None))
        .when(some(request_error), row("failed", "request_creation_failed", *ok, None))
        .when(some(network_error) | status.isNull(), row("failed", "request_failed", *ok, None))
        .when(status.between(300, 399), row("redirect", "", *ok, status, True))
        .when(status != 200, row("completed", "", *ok, status))
        .when(native.trim(F.coalesce(content_type, F.lit(""))) == "", row("failed", "missing_content_type", *ok, status))
        .when(~native.html_content_type(content_type), row("failed", "unsupported_content_type", *ok, status))
        .when(some(parse_error), row("failed", "response_parse_failed", *ok, status))
        .otherwise(row("completed", "", *ok, status))
    )


def with_defaults(df: DataFrame) -> DataFrame:
    """What saving fills in: codes of failures, blank statuses and outcomes."""
    return df.withColumns({
        "error_code": F.when((F.col("scan_status") == "failed") & (native.trim(F.coalesce("error_code", F.lit(""))) == ""), "internal_error").otherwise(F.col("error_code")),
        "scan_status": F.when(F.coalesce("scan_status", F.lit("")) == "", "completed").otherwise(F.col("scan_status")),
        "robots_outcome": F.when(F.coalesce("robots_outcome", F.lit("")) == "", "not_checked").otherwise(F.col("robots_outcome")),
    })


# Bounds of the fields that keep what is known of an earlier cut.
_REBOUND = {"title": "title", "h1": "h1", "og_title": "title", "og_image": "url", "twitter_card": "twitter_card", "canonical_url": "url", "meta_robots": "robots", "x_robots_tag": "robots"}


def sanitize_page(page: dict) -> dict:
    """A page's metrics for storage: URLs redacted, then all fields bounded again; earlier cuts stay known."""
    from pagespan.functions.redaction import redact_url

    out = dict(page, canonical_url=redact_url(page["canonical_url"]), og_image=redact_url(page["og_image"]))
    for f, b in _REBOUND.items():
        out[f], out[f"{f}_truncated"], out[f"{f}_original_length"] = rebounded(out[f], BOUNDS[b], page[f"{f}_truncated"], page[f"{f}_original_length"])
    for f in ("description", "og_description"):
        out[f] = out[f][: BOUNDS["description"]]
    return out


def sanitize(df: DataFrame) -> DataFrame:
    """sanitize_page() of the column `page`; safe_url, redirect_url and error_message redacted and bounded where they are."""
    page = F.col("page")

    def again(f: str, b: str) -> list[Column]:
        most = BOUNDS[b]
        v = udfs.redact_url(page[f]) if b == "url" else page[f]
        over, was = F.length(v) > most, page[f"{f}_truncated"]
        measured = F.when(over, F.length(v)).otherwise(0)
        return [F.left(v, F.lit(most)).alias(f), (was | over).alias(f"{f}_truncated"), F.when(was, F.greatest(page[f"{f}_original_length"], measured)).otherwise(measured).alias(f"{f}_original_length")]

    new = {}
    for f, b in _REBOUND.items():
        new |= dict(zip((f, f"{f}_truncated", f"{f}_original_length"), again(f, b), strict=True))
    for f in ("description", "og_description"):
        new[f] = F.left(page[f], F.lit(BOUNDS["description"])).alias(f)
    out = df.withColumn("page", F.struct(*(new.get(f, page[f]).alias(f) for f in html.FIELDS)))
    if "error_message" in df.columns:
        out = out.withColumn("error_message", udfs.sanitize_error("error_message"))
    for c in ("safe_url", "redirect_url"):
        if c in df.columns:
            out = out.withColumn(f"_{c}", native.bounded(udfs.redact_url(c), "url")).withColumns({c: F.col(f"_{c}.value"), f"{c}_truncated": F.col(f"_{c}.truncated"), f"{c}_original_length": F.col(f"_{c}.original_length")}).drop(f"_{c}")
    return out


def audit_run(queue: DataFrame, policies: DataFrame, responses: DataFrame, run_id: str, key: bytes, key_id: str, user_agent: str, now: Column, bare: bool = True) -> DataFrame:
    """The result row of each queued target, ready for append_log(). queue: id, url; policies: see robots_verdicts();
    responses: target_id, url, status, body, content_type, x_robots, request_error, network_error, location,
    duration_ms, one row at most for each target. bare: see audit_pages().

    Bodies are parsed where they are read and never shuffled; metrics and verdicts are joined by target. A response to a
    target that must not be fetched has no effect; a target without a response failed to be requested.
    """
    parsed = audit_pages(responses.withColumn("status", F.coalesce("status", F.lit(0))), bare=bare).drop("body", "x_robots", "url")
    rows = robots_verdicts(make_targets(queue, key), policies, user_agent).join(parsed, "target_id", "left")
    status = F.nullif("status", F.lit(0))
    c = classify(F.col("url_error"), F.col("robots_outcome"), F.col("request_error"), F.col("network_error"), status, F.col("content_type"), F.col("parse_error"))
    why = [F.when(F.col("c.error_code") == code, F.col(f)) for code, f in (("invalid_target_url", "url_error"), ("request_creation_failed", "request_error"), ("request_failed", "network_error"), ("response_parse_failed", "parse_error"))]
    rows = rows.withColumn("c", c).withColumns({
        "page": F.when((F.col("c.scan_status") == "completed") & (F.col("c.status_code") == 200), F.col("page")),
        "redirect_url": F.when(F.col("c.is_redirect"), F.coalesce("location", F.lit(""))).otherwise(""),
        "error_message": F.coalesce(*why, F.lit("")),
        "duration_ms": F.when(F.col("c.robots_allowed"), F.coalesce("duration_ms", F.lit(0))).otherwise(0).cast("long"),
    })
    out = sanitize(rows.select("target_id", "safe_url", "fingerprint", "c.*", "page", "redirect_url", "error_message", "duration_ms"))
    named = out.select(F.lit(run_id).alias("run_id"), *(x for x in out.columns if x != "page"), "page.*", F.lit(key_id).alias("fingerprint_key_id"), now.alias("created_at"))
    return with_defaults(named)


def result_counters(results: DataFrame) -> DataFrame:
    """received, saved, successful, failed, persistence_failures of result rows: those without a target can't be saved."""
    saved = F.coalesce(F.col("target_id") != 0, F.lit(False))
    return results.agg(F.count("*").alias("received"), F.count_if(saved).alias("saved"), F.count_if(saved & (F.col("scan_status") != "failed")).alias("successful"), F.count_if(saved & (F.col("scan_status") == "failed")).alias("failed"), F.count_if(~saved).alias("persistence_failures"))


def report_rows(results: DataFrame) -> DataFrame:
    """The report's columns, null-safe. Order by target_id when writing."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    part = lambda label, c: F.when(native.trim(text(c)) != "", F.concat(F.lit(label), F.col(c)))
    access = F.when(F.coalesce("robots_allowed", F.lit(False)), "дозволено").otherwise("заборонено")
    error = F.concat_ws(": ", F.nullif(native.trim(text("error_code")), F.lit("")), F.nullif(native.trim(text("error_message")), F.lit("")))
    return results.select(
        "target_id",
        native.shown(text("safe_url")).alias("url"),
        F.coalesce(F.col("status_code").cast("string"), F.lit("-")).alias("http_code"),
        native.labelled(text("scan_status"), native.STATUS_LABELS).alias("status"),
        native.tone(text("scan_status"), F.col("status_code"), F.col("error_code")).alias("tone"),
        native.shown(text("title")).alias("title"),
        native.shown(text("description")).alias("description"),
        native.shown(text("h1")).alias("h1"),
        F.format_string("Внутрішні: %d\nЗовнішні: %d\nУсього: %d", num("internal_links"), num("external_links"), num("links")).alias("links"),
        num("images_missing_alt").alias("images_missing_alt"),
        F.concat_ws("\n", F.concat(F.lit("Результат: "), native.labelled(text("robots_outcome"), native.OUTCOME_LABELS)), F.concat(F.lit("Доступ: "), access), part("Meta: ", "meta_robots"), part("X-Robots-Tag: ", "x_robots_tag")).alias("robots"),
        num("word_count").alias("word_count"),
        native.duration(num("duration_ms").cast("long")).alias("duration"),
        F.coalesce(F.nullif(error, F.lit("")), F.lit("-")).alias("error"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """Id of the run that started last; of those that tie, the greatest id."""
    return runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def run_summary(runs: DataFrame, run_id: str, generated: Column) -> DataFrame:
    """The report's header for one run: label and tone of its status, counters, times as text."""
    shown = lambda c: F.coalesce(F.date_format(c, "dd.MM.yyyy HH:mm:ss 'UTC'"), F.lit("-"))
    status = F.coalesce("status", F.lit(""))
    return runs.filter(F.col("run_id") == run_id).select(
        "run_id", native.labelled(status, native.STATUS_LABELS).alias("status"), native.tone(status, F.lit(None).cast("int"), F.lit("")).alias("tone"),
        "total", "successful", "failed", shown(F.col("started_at")).alias("started_at"), shown(F.col("finished_at")).alias("finished_at"), shown(generated).alias("generated_at"),
    )


def latest_failures(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Failed results of the run that started last."""
    return results.filter(F.col("scan_status") == "failed").join(F.broadcast(latest_run(runs)), "run_id", "left_semi")


def host_schedule(fetches: DataFrame, interval_ms: int, slots: int = 1) -> DataFrame:
    """fetches with start_ms: at the earliest when ready, `interval_ms` after the host's last start, with a free one of
    `slots`, and after every wait that the host has asked for by then. fetches: host, fetch_id, ready_ms, duration_ms,
    retry_ms (the wait asked for at the end of the fetch, or null).

    Hosts are served in order of ready_ms, fetch_id. Rows of a host stream through one task, which holds the open
    fetches alone. Rows without a host have no start.
    """
    if interval_ms < 0 or slots < 1:
        raise ValueError("interval_ms must be 0 or more, slots 1 or more")

    def plan(batches):
        host, last, hold, busy, asked = None, 0, 0, [], []
        for t in batches:
            starts = []
            for h, ready, took, wait in zip(t["host"], t["ready_ms"].tolist(), t["duration_ms"].tolist(), t["retry_ms"], strict=True):
                if h is None:
                    starts.append(None)
                    continue
                if h != host:
                    host, last, hold, busy, asked = h, ready - interval_ms, ready, [], []
                s = max(ready, last + interval_ms, hold)
                if len(busy) == slots:
                    s = max(s, heapq.heappop(busy))
                while asked and asked[0][0] <= s:
                    hold = max(hold, heapq.heappop(asked)[1])
                    s = max(s, hold)
                heapq.heappush(busy, s + took)
                if wait == wait and wait is not None:
                    heapq.heappush(asked, (s + took, s + took + int(wait)))
                last = s
                starts.append(s)
            yield t.assign(start_ms=pd.array(starts, dtype="Int64"))

    rows = fetches.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("ready_ms", "duration_ms")})
    rows = rows.select("host", "fetch_id", "ready_ms", "duration_ms", F.col("retry_ms").cast("long").alias("retry_ms"))
    dealt = rows.repartition("host").sortWithinPartitions("host", "ready_ms", "fetch_id")
    return dealt.mapInPandas(plan, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, start_ms long")
