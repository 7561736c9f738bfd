"""The working views of ``narralake.sources.tables`` as SQL, for the checks."""

from __future__ import annotations

from narralake.sources.tables import ATTEMPT_STATUS, INJECTED, INTAKE_STATUS

WS_SET = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WS = r"[ \t\n\r\f\v]"
NOT_WS = r"[^ \t\n\r\f\v]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS_SET})"


def case(column: str, names: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in names.items())
    return f"CASE {column} {arms} END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


_LINES = "(SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents)"

DOC_PAGES = f"""doc_pages AS (
  SELECT doc_id, lang, source, CAST(p AS INTEGER) AS page_number,
         array_to_string(ls[(p - 1) * 10 + 1 : p * 10], chr(10)) AS text
  FROM (SELECT *, unnest(range(1, (len(ls) + 9) // 10 + 1)) AS p FROM {_LINES}))"""

PARAGRAPHED = f"""paragraphed AS (
  SELECT doc_id, lang, source,
         array_to_string(list_transform(range(0, (len(ls) + 4) // 5),
           lambda g: array_to_string(ls[g * 5 + 1 : g * 5 + 5], chr(10))), chr(10) || chr(10)) AS text
  FROM {_LINES})"""

_EXTRA = (
    f"CASE doc_id % {len(INJECTED)} "
    + " ".join(f"WHEN {i} THEN chr(10) || {lit(t)}" for i, t in enumerate(INJECTED) if t)
    + " ELSE '' END"
)

DIRTY_PAGES = f"""dirty_pages AS (
  SELECT doc_id, lang, source, page_number, text || {_EXTRA} AS text FROM doc_pages)"""

DIRTY_DOCS = f"""dirty_docs AS (
  SELECT doc_id, lang, source, text || {_EXTRA} AS text FROM documents)"""

EXTRACTIONS = """extractions AS (
  SELECT doc_id // 4 AS page_id, 'm' || (doc_id % 4) AS method, doc_id % 4 AS method_order,
         lang, source, text, CASE WHEN doc_id % 97 = 0 THEN 'cannot open' END AS error
  FROM dirty_docs)"""

SCENES = """scenes AS (
  SELECT doc_id, text, doc_id % 5 <> 4 AS use_scene,
         CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN '' WHEN 4 THEN 'studio' END AS scene,
         CASE WHEN doc_id % 5 <= 1 THEN lang END AS style,
         CASE doc_id % 5 WHEN 2 THEN 'calm' WHEN 3 THEN '' END AS tone
  FROM documents)"""

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"

ATTEMPTS = f"""logged AS (
  SELECT user_id % 20 AS run_id, event_id AS seq, 'tok' || ({_K} % 4 + 1) AS token,
         {_K} AS chunk_id, {_EPOCH} AS epoch,
         coalesce(['begin', 'synced', 'ended'][event_id % 97 + 1], {case('event_type', ATTEMPT_STATUS)}) AS status
  FROM events),
attempts AS (
  SELECT *, CASE WHEN status = 'switched' THEN 'tok' || ((chunk_id % 4 + 1 + seq % 3) % 4 + 1) END AS from_token,
         CASE WHEN status = 'switched' THEN token END AS to_token,
         CASE WHEN status = 'switched' THEN if(seq % 2 = 0, '429_quota', 'manual') END AS reason
  FROM logged)"""

# The rows of each run after its last begin.
LIVE = """live AS (
  SELECT * FROM attempts a
  WHERE NOT EXISTS (FROM attempts b WHERE b.run_id = a.run_id AND b.status = 'begin' AND b.seq >= a.seq))"""

STATUS_LOG = f"""status_log AS (
  SELECT user_id AS intake_id, event_id AS seq, {case('event_type', INTAKE_STATUS)} AS status,
         {_K} AS current, CAST(100 AS BIGINT) AS total, {_EPOCH} AS epoch
  FROM events)"""

SAMPLES = """samples AS (
  SELECT user_id % 20 AS series_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS chunk_idx,
         row_number() OVER w - 1 AS sample_idx, CAST(round(value * 40) AS INTEGER) AS s,
         count(*) OVER (PARTITION BY user_id % 20, CAST(ts AS DATE)) AS n_samples,
         CASE WHEN user_id % 2 = 0 THEN 200 ELSE 300 END AS rate
  FROM events
  WINDOW w AS (PARTITION BY user_id % 20, CAST(ts AS DATE) ORDER BY event_id))"""

CHUNK_FILES = """chunk_files AS (
  SELECT run_id AS intake_id, path, arg_max(size, seq) AS size FROM (
    SELECT run_id, seq,
           CASE WHEN run_id % 5 = 0 THEN '/audio/it''s-' ELSE '/audio/' END || run_id || '/' ||
           CASE WHEN seq % 13 = 0 THEN chunk_id || '.wav'
                WHEN seq % 17 = 0 THEN lpad(CAST(chunk_id AS VARCHAR), 4, '0') || '.WAV'
                WHEN seq % 19 = 0 THEN 'x.wav'
                ELSE lpad(CAST(chunk_id AS VARCHAR), 4, '0') || '.wav' END AS path,
           CASE WHEN seq % 11 = 0 THEN 0 ELSE seq % 100000 + 1 END AS size
    FROM attempts WHERE status = 'success')
  GROUP BY run_id, path)"""

OUTPUT_FILES = """output_files AS (
  SELECT DISTINCT CASE user_id % 4
      WHEN 0 THEN '/outputs/custom-' || user_id || '.wav'
      WHEN 1 THEN '/outputs/' || user_id || '/final_audiobook.wav'
      WHEN 2 THEN '/outputs/' || user_id || '_final_audiobook.wav' END AS path
  FROM events WHERE user_id % 4 < 3)"""

ERROR_LOG = """error_log AS (
  SELECT run_id, seq, CASE chunk_id % 7
      WHEN 0 THEN '429 Too Many Requests'
      WHEN 1 THEN 'Resource_Exhausted: try later'
      WHEN 2 THEN 'quota used up'
      WHEN 3 THEN 'API_KEY_INVALID for project'
      WHEN 4 THEN '401 unauthenticated'
      WHEN 5 THEN ''
      ELSE 'connection reset ' || repeat('by peer ', 30) END AS message
  FROM attempts WHERE status = 'quota_failed')"""

RAW_TOKENS = """raw_tokens AS (
  SELECT position, CASE WHEN position % 3 = 0 THEN s_name || ' ' END AS name,
         CASE WHEN position % 3 = 1 THEN s_name END AS id,
         CASE position % 3 WHEN 0 THEN k WHEN 2 THEN '' END AS api_key,
         CASE WHEN position % 3 <> 0 THEN k END AS key,
         CASE position % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'no' WHEN 3 THEN 'YES' END AS enabled
  FROM (SELECT s_suppkey AS position, s_name,
               CASE WHEN s_suppkey % 7 = 0 THEN '  '
                    WHEN s_suppkey % 5 = 0 THEN 'k' || s_suppkey
                    ELSE 'key-' || s_suppkey || '-' || s_name END AS k
        FROM supplier))"""

TOKENS = """tokens AS (
  SELECT * FROM (
    SELECT position,
           trim(coalesce(nullif(name, ''), nullif(id, ''), 'token')) AS name,
           trim(coalesce(nullif(api_key, ''), nullif(key, ''), '')) AS api_key,
           coalesce(lower(enabled) IN ('1', 'true', 'yes'), true) AS enabled
    FROM raw_tokens) WHERE api_key <> '')"""


def mask(expr: str) -> str:
    k = f"trim(coalesce({expr}, ''))"
    return (
        f"CASE WHEN {k} = '' THEN '' WHEN length({k}) <= 8 "
        f"THEN left({k}, 3) || repeat('•', 6) "
        f"ELSE left({k}, 4) || repeat('•', 8) || right({k}, 4) END"
    )


EDITED = f"""edited AS (
  SELECT position, CASE WHEN position % 6 = 0 THEN name || '-new' ELSE name END AS name,
         CASE WHEN position % 2 = 0 THEN {mask('api_key')} ELSE 'new-' || api_key END AS api_key,
         enabled
  FROM tokens)"""
