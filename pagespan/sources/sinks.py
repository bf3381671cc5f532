"""Sinks: the result log, the HTML report, structured logs."""

from __future__ import annotations

import html
import json
import logging
import os
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_log(df: DataFrame, path: str, partition: str = "run_id") -> None:
    """Adds rows to a log; nothing is rewritten, and readers take the latest of each key."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def latest(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key: an upsert as seen by readers. Among equal versions, all columns decide."""
    rest = sorted(c for c in log.columns if c not in (*keys, version))
    order = Window.partitionBy(*keys).orderBy(F.desc(version), *(F.desc(c) for c in rest))
    return log.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def insert_missing(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose key is not there yet, one for each key."""
    return new.dropDuplicates(keys).join(have.select(*keys), keys, "left_anti")


# Headings of the report's columns, counters and times.
COLUMNS = ["URL", "HTTP", "Статус", "Title", "Description", "H1", "Посилання", "Без alt", "Robots", "Слова", "Час", "Помилки"]
COUNTERS = {"status": "Статус", "total": "URL у запуску", "successful": "Успішно", "failed": "З помилками"}
TIMES = {"started_at": "Початок", "finished_at": "Завершення", "generated_at": "Звіт створено"}
FIELDS = ["url", "http_code", "status", "title", "description", "h1", "links", "images_missing_alt", "robots", "word_count", "duration", "error"]


_STYLE = """body{font:14px/1.4 sans-serif;margin:2em;color:#222}
table{border-collapse:collapse}
th,td{border:1px solid #ccc;padding:.4em .6em;text-align:left;vertical-align:top;white-space:pre-wrap;overflow-wrap:anywhere}
dl{display:flex;flex-wrap:wrap;gap:2em}dt{color:#666}dd{margin:0;font-weight:bold}
.tone-success{color:#064}.tone-warning{color:#850}.tone-danger{color:#a11}.tone-neutral{color:#456}"""


def _text(v) -> str:
    return html.escape(str(v), quote=False).replace('"', "&#34;").replace("'", "&#39;")


def _head(run_id: str, when: time.struct_time, summary) -> str:
    """The page up to the table's first row. summary: a row of run_summary(), or None."""
    made = {"generated_at": time.strftime("%d.%m.%Y %H:%M:%S UTC", when)}
    known = made if summary is None else summary.asDict() | made
    tone = {"status": f' class="{_text(known.get("tone", ""))}"'}
    facts = "".join(f"<div><dt>{label}</dt><dd{tone.get(f, '')}>{_text(known[f])}</dd></div>" for f, label in (COUNTERS | TIMES).items() if f in known)
    heads = "".join(f"<th>{c}</th>" for c in COLUMNS)
    return f'<!doctype html>\n<html lang="uk"><head><meta charset="utf-8"><title>{_text(run_id)}</title><style>{_STYLE}</style></head>\n<body><h1>{_text(run_id)}</h1><dl>{facts}</dl>\n<table><thead><tr>{heads}</tr></thead><tbody>\n'


def write_report(rows: DataFrame, folder: str, run_id: str, generated: time.struct_time | None = None, keep: int = 100, name: str = "audit", summary: DataFrame | None = None) -> tuple[Path, Path]:
    """Writes the archive and the latest report, and deletes the oldest archives. rows: as of report_rows(), written by
    target_id; summary: as of run_summary(), one row.

    Rows stream through the driver a partition at a time. Files appear whole or not at all.
    """
    out, when = Path(folder), generated or time.gmtime()
    out.mkdir(parents=True, exist_ok=True)
    suffix = run_id.replace("-", "")[:8] or "run"
    archive = out / f"{name}-{time.strftime('%Y%m%d-%H%M%S', when)}-{suffix}.html"
    latest_file = out / f"{name}-latest.html"
    fd, temp = tempfile.mkstemp(dir=out)
    try:
        with os.fdopen(fd, "w", encoding="utf-8", buffering=1 << 16) as f:
            f.write(_head(run_id, when, summary.first() if summary is not None else None))
            for r in rows.orderBy("target_id").toLocalIterator():
                cells = "".join(f"<td>{_text(r[c])}</td>" for c in FIELDS)
                f.write(f'<tr class="{_text(r.tone)}">{cells}</tr>\n')
            f.write("</tbody></table></body></html>\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, archive)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise
    copy = out / f".{latest_file.name}.tmp"
    shutil.copyfile(archive, copy)
    os.replace(copy, latest_file)
    prune_reports(out, archive, keep, name)
    return archive, latest_file


def prune_reports(folder: Path, current: Path, keep: int, name: str = "audit") -> None:
    """Keeps the current archive and the newest others, by time and then name."""
    found = [p for p in folder.glob(f"{name}-*.html") if p.name != f"{name}-latest.html"]
    newest = sorted(found, key=lambda p: p.name, reverse=True)
    newest.sort(key=lambda p: (p != current, -p.stat().st_mtime))
    for p in newest[max(1, keep) :]:
        p.unlink()


class JsonFormatter(logging.Formatter):
    """One JSON object a line, with the run's id."""

    def __init__(self, run_id: str) -> None:
        super().__init__()
        self.run_id = run_id

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname, "msg": record.getMessage(), "run_id": self.run_id}, ensure_ascii=False)
