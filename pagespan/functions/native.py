"""Column expressions that need no Python worker."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .redaction import SENSITIVE_KEYS, SENSITIVE_PARTS
from .text import BOUNDS, DESCRIPTION_LIMITS, SPACE_CLASS, TITLE_LIMITS


def trim(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def after(t: Column, seconds: Column | float) -> Column:
    """A time so many seconds later (earlier, if negative)."""
    s = (seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("decimal(18,6)")
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s)


def length_status(n: Column, limits: tuple[int, int]) -> Column:
    return F.when(n == 0, "Missing").when(n < limits[0], "Too Short").when(n > limits[1], "Too Long").otherwise("OK")


def title_status(c: Column) -> Column:
    return length_status(F.length(c), TITLE_LIMITS)


def description_status(c: Column) -> Column:
    return length_status(F.length(c), DESCRIPTION_LIMITS)


def bounded(c: Column, bound: str) -> Column:
    """struct(value, truncated, original_length)."""
    most = BOUNDS[bound]
    over = F.length(c) > most
    return F.struct(F.left(c, F.lit(most)).alias("value"), over.alias("truncated"), F.when(over, F.length(c)).otherwise(0).alias("original_length"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest, 32 bytes: the padded keys are constants of the plan."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(k ^ b for k in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256))


def legacy_fingerprint(run_id: Column, url: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", run_id, url)))


def as_uuid(hex32: Column) -> Column:
    return F.lower(F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def legacy_run_id(run_id: Column, prefix: str) -> Column:
    plain = F.regexp_replace(run_id, "-", "")
    return as_uuid(F.when(plain.rlike("(?i)^[0-9a-f]{32}$"), plain).otherwise(F.md5(F.concat(F.lit(prefix), run_id))))


def legacy_url(c: Column) -> Column:
    """Without fragment, and with a placeholder for the whole query."""
    plain = F.regexp_replace(c, "(?s)#.*$", "")
    at = F.instr(plain, "?")
    return F.when(at == 0, plain).otherwise(F.concat(F.substring(plain, F.lit(1), at), F.lit("[QUERY_REDACTED]")))


def legacy_text(c: Column) -> Column:
    cut = F.regexp_replace(c, r"""#[^\s"'<>]*""", "")
    return F.left(F.regexp_replace(cut, r"""\?[^\s"'<>]*""", "?[QUERY_REDACTED]"), F.lit(1000))


def sensitive_key(c: Column) -> Column:
    k = F.regexp_replace(trim(F.lower(c)), "[-_. ]", "")
    return k.isin(SENSITIVE_KEYS) | k.rlike("|".join(SENSITIVE_PARTS))


_TOKEN = r"[\w!#$%&'*+.^`|~-]+"


def html_content_type(c: Column) -> Column:
    """Whether a Content-Type header is well formed and names HTML, as html.content_type_is_html() says."""
    named = F.lower(trim(F.split_part(c, F.lit(";"), F.lit(1)))).isin("text/html", "application/xhtml+xml")
    return named & c.rlike(rf'^[^;]*(;\s*({_TOKEN}\s*=\s*({_TOKEN}|"[^";]*")\s*)?)*$')


# HTTP statuses, and SQL states for reads and writes, that may be tried again.
RETRY_HTTP = [408, 425, 429, 500, 502, 503, 504]
RETRY_WRITE = ["40001", "40P01", "55P03"]
RETRY_READ = [*RETRY_WRITE, "57P01", "57P02", "57P03"]


def retryable_http(status: Column, method: Column, network_error: Column | None = None) -> Column:
    """Only requests that may be repeated, after certain statuses or network errors (reset, refused, broken_pipe, timeout)."""
    again = status.isin(RETRY_HTTP)
    if network_error is not None:
        again = F.when(network_error.isNotNull(), network_error.isin("reset", "refused", "broken_pipe", "timeout")).otherwise(again)
    return F.coalesce(method.isin("GET", "HEAD", "OPTIONS") & again, F.lit(False))


def retryable_sqlstate(state: Column, mutation: bool) -> Column:
    known = state.isin(RETRY_WRITE if mutation else RETRY_READ)
    return F.coalesce(known if mutation else known | state.startswith("08"), F.lit(False))


def backoff_cap_ms(attempt: Column, base_ms: int, most_ms: int) -> Column:
    """Greatest delay before a retry; the delay itself is this times a uniform number."""
    return F.when(F.lit(base_ms <= 0), 0).otherwise(F.least(F.lit(most_ms).cast("double"), F.lit(base_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(60))))).cast("long")


def clamped_delay_ms(delay_ms: Column, left_ms: Column) -> Column:
    """A delay cut to what is left of a deadline (null: there is none). Null if a delay is due and nothing is left."""
    return F.when(delay_ms <= 0, 0).when(left_ms.isNull(), delay_ms).when(left_ms > 0, F.least(delay_ms, left_ms)).cast("long")


def retry_after(value: Column, now: Column, most_seconds: int = 300) -> Column:
    """When a Retry-After header allows the next request: seconds or an HTTP date, no later than most_seconds; else null."""
    v = trim(value)
    seconds = F.when(v.rlike(r"^\+?[0-9]+$"), F.coalesce(v.try_cast("bigint"), F.lit(most_seconds).cast("bigint")))
    clock = r"\d{2}:\d{2}:\d{2}"
    part = lambda p, i: F.regexp_extract(v, p, i)
    # the three forms of an HTTP date: of today, with a year of two digits, and as C writes it
    now_form, old_form, c_form = rf"^[A-Za-z]{{3}}, (\d{{2}} [A-Za-z]{{3}} \d{{4}} {clock}) GMT$", rf"^[A-Za-z]{{6,9}}, (\d{{2}}-[A-Za-z]{{3}}-)(\d{{2}})( {clock}) GMT$", rf"^[A-Za-z]{{3}} ([A-Za-z]{{3}}) ([ \d]\d) ({clock}) (\d{{4}})$"
    century = F.when(part(old_form, 2) >= "69", "19").otherwise("20")
    text = (
        F.when(v.rlike(now_form), part(now_form, 1))
        .when(v.rlike(old_form), F.concat(F.replace(part(old_form, 1), F.lit("-"), F.lit(" ")), century, part(old_form, 2), part(old_form, 3)))
        .when(v.rlike(c_form), F.concat_ws(" ", F.lpad(F.ltrim(part(c_form, 2)), 2, "0"), part(c_form, 1), part(c_form, 4), part(c_form, 3)))
    )
    date = F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm:ss"))
    delay = F.coalesce(seconds, F.when(date.isNotNull(), F.greatest(F.lit(0), F.unix_seconds(date) - F.unix_seconds(now.cast("timestamp")))))
    return F.when(delay.isNotNull(), after(now, F.least(delay, F.lit(most_seconds))))


# Labels of the report.
STATUS_LABELS = {"completed": "Завершено", "completed_with_errors": "Завершено з помилками", "failed": "Помилка", "canceled": "Скасовано", "abandoned": "Перервано", "redirect": "Редирект", "blocked_by_robots": "Заблоковано robots.txt"}
OUTCOME_LABELS = {"allowed": "дозволено", "disallowed": "заборонено", "unavailable": "недоступний", "not_checked": "не перевірено"}


def shown(c: Column) -> Column:
    return F.coalesce(F.nullif(trim(c), F.lit("")), F.lit("-"))


def labelled(c: Column, labels: dict[str, str]) -> Column:
    out = shown(c)
    for k, v in labels.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def tone(status: Column, code: Column, error: Column) -> Column:
    return (
        F.when((trim(F.coalesce(error, F.lit(""))) != "") | (status == "failed"), "tone-danger")
        .when(status.isin("completed_with_errors", "canceled", "redirect", "blocked_by_robots"), "tone-warning")
        .when((code < 200) | (code >= 300), "tone-warning")
        .when(status == "completed", "tone-success")
        .otherwise("tone-neutral")
    )


def duration(ms: Column) -> Column:
    """Milliseconds below a second, else seconds to two digits: the nearest to the double that ms / 1000 is, as C and Go
    print it. format_string() would round that double's shortest decimal form half up."""
    s = ms / 1000.0
    whole = s.cast("bigint")
    # a double from 1 on is a multiple of 2^-52, so all of this is exact
    scaled = ((s - whole) * 2.0**52).cast("bigint") * 100
    down, rest, half = F.shiftright(scaled, 52), scaled.bitwiseAND((1 << 52) - 1), 1 << 51
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    hundredths = down + up.cast("int")
    shown = F.format_string("%d.%02d s", whole + (hundredths == 100).cast("int"), hundredths % 100)
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(shown)
