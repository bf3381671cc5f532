"""DuckDB SQL that gives the rows of those queries that SQL can express. It is plain rather than quick: for small tables."""

from __future__ import annotations

import string

from .secrets import BASE_KINDS, MUST, OWNERS, PATTERNS, REPOSITORIES

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _windows(n: int) -> str:
    """w: words by document; late: windows of n words that also start earlier, with their earliest place."""
    return f"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
 windows AS (SELECT doc_id, unnest(range(len(words) - {n - 1})) AS pos, words FROM w WHERE len(words) >= {n}),
 named AS (SELECT doc_id, pos, array_to_string(words[pos + 1 : pos + {n}], ' ') AS window_text FROM windows),
 firsts AS (SELECT window_text, min((doc_id, pos)) AS head FROM named GROUP BY window_text),
 late AS (SELECT doc_id, pos, head FROM named JOIN firsts USING (window_text) WHERE (doc_id, pos) <> head)"""


OP1 = f"""WITH {_windows(50)},
 marked AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 1 ELSE 0 END AS fresh FROM late),
 islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marked)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 50 AS BIGINT) AS stop, min(head)[1] AS first_doc_id, CAST(min(head)[2] AS BIGINT) AS first_start FROM islands GROUP BY doc_id, island"""

OP4 = f"""WITH {_windows(20)},
 gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM late),
 each AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept_words FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept_words, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM documents),
 shingles AS (SELECT DISTINCT doc_id, array_to_string(words[pos + 1 : pos + 5], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 4, 1))) AS pos FROM w WHERE len(words) > 0)),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
 reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN sizes USING (doc_id)"""


def _matches(rank: int, kind: str) -> str:
    pattern, group, least = PATTERNS[kind]
    p = pattern.replace("'", "''")
    must = "".join(f" AND regexp_matches(value, '{m}')" for m in MUST.get(kind, ()))
    return f"""SELECT row_no, doc_id, owner, repository, {rank} AS rank, '{kind}' AS kind, value, pos + gaps - length(whole) AS start, pos + gaps AS stop FROM (
 SELECT *, CAST(list_sum(list_transform(wholes[1 : i], lambda x: length(x))) AS BIGINT) AS pos, CAST(list_sum(list_transform(parts[1 : i], lambda x: length(x))) AS BIGINT) AS gaps, wholes[i] AS whole, found[i] AS value FROM (
  SELECT *, unnest(range(1, len(wholes) + 1)) AS i FROM (SELECT *, regexp_extract_all(body, '{p}', 0) AS wholes, regexp_extract_all(body, '{p}', {group}) AS found, string_split_regex(body, '{p}') AS parts FROM rows_))) WHERE length(value) >= {least}{must}"""


_BASE = ", ".join(f"'{k}'" for k in BASE_KINDS)
_LIST = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
OP3 = f"""WITH rows_ AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
 hits AS ({" UNION ALL ".join(_matches(i, k) for i, k in enumerate(PATTERNS))}),
 counts AS (SELECT value, count(DISTINCT owner) <= {OWNERS} AND count(DISTINCT (owner, repository)) <= {REPOSITORIES} AS own FROM hits GROUP BY value),
 kept AS (SELECT * FROM hits JOIN counts USING (value) WHERE kind <> 'mixed' OR own),
 per AS (SELECT row_no, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)}, {_LIST[:-1]}) FILTER (WHERE kind IN ({_BASE})) AS base, {_LIST} AS spans, count(*) FILTER (WHERE own) AS n_owner_specific, count(*) FILTER (WHERE NOT own) AS n_widely_copied FROM kept GROUP BY row_no)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owner_specific, 0) AS n_owner_specific, coalesce(n_widely_copied, 0) AS n_widely_copied FROM rows_ LEFT JOIN per USING (row_no)"""
