"""Arrow-batched forms of the scalar functions, for DataFrames and for SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from . import redaction, urls


def _strings(f, kind: str = "string"):
    """f over a column of strings; null stays null."""
    arrow, spark = {"string": (pa.string(), StringType()), "boolean": (pa.bool_(), BooleanType())}[kind]

    @F.arrow_udf(spark)
    def call(c: pa.Array) -> pa.Array:
        seen: dict = {None: None}  # a batch's repeated values are worked out once
        out = []
        for v in c.to_pylist():
            if v not in seen:
                seen[v] = f(v)
            out.append(seen[v])
        return pa.array(out, arrow)

    return call


def _or_none(f):
    def call(v):
        try:
            return f(v)
        except urls.UrlError:
            return None

    return call


redact_url = _strings(redaction.redact_url)
redact_text = _strings(redaction.redact_text)
sanitize_error = _strings(redaction.sanitize_error)
normalize_target = _strings(_or_none(urls.normalize_target))
hostname_key = _strings(_or_none(urls.hostname_key))
authority_key = _strings(_or_none(lambda v: urls.authority_key(urls.parse(v))))
private_host = _strings(urls.private_host, "boolean")
blocked_ip = _strings(urls.blocked_ip, "boolean")


@F.arrow_udf(StringType())
def target_error(c: pa.Array) -> pa.Array:
    """Why a URL is no target; null if it is one."""
    out = []
    for v in c.to_pylist():
        try:
            urls.normalize_target(v or "")
            out.append(None)
        except urls.UrlError as e:
            out.append(str(e))
    return pa.array(out, pa.string())


def ips_allowed(ips: Column, allow_private: bool = False) -> Column:
    if allow_private:
        return F.size(ips) > 0

    @F.arrow_udf(BooleanType())
    def call(c: pa.Array) -> pa.Array:
        return pa.array([urls.resolved_ips_allowed(v or [], False) for v in c.to_pylist()], pa.bool_())

    return call(ips)


def register(spark: SparkSession) -> None:
    """All of them by name in SQL."""
    for name, f in {"redact_url": redact_url, "redact_text": redact_text, "sanitize_error": sanitize_error, "normalize_target": normalize_target, "hostname_key": hostname_key, "authority_key": authority_key, "private_host": private_host, "blocked_ip": blocked_ip, "target_error": target_error}.items():
        spark.udf.register(name, f)
