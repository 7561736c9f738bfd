"""Chunking passes as SQL over lengths, for the checks.

Every pass maps a relation ``(doc_id, i, text)`` to another one.  The engine
that checks has no fold over arrays with state, so each pass is a recursive
query that hands out chunk numbers, followed by an ordered join of the texts.
"""

from __future__ import annotations

from narralake.plans.views_sql import WS, strip

MARKS = "؟!؛.۔:…?;"
SEP = "chr(31)"


def sentences_list(expr: str) -> str:
    pieces = (
        f"string_split(regexp_replace({expr}, '([{MARKS}]){WS}+', '\\1' || {SEP}, 'g'), {SEP})"
    )
    return (
        f"list_filter(list_transform({pieces}, lambda z: {strip('z')}), lambda z: z <> '')"
    )


def ends_sentence(expr: str) -> str:
    return f"regexp_matches({expr}, '[{MARKS}][\"'')\\]]*{WS}*$')"


def explode(name: str, src: str, list_expr: str) -> str:
    """Elements of a list per row, numbered over the whole document."""
    return f"""
{name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS i, l[j] AS text FROM (
  SELECT doc_id, i, l, unnest(range(1, len(l) + 1)) AS j FROM (
    SELECT doc_id, i, {list_expr} AS l FROM {src})))"""


def paragraphs(name: str, src: str) -> str:
    lines = (
        f"array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda z: {strip('z')}), "
        "lambda z: z <> ''), ' ')"
    )
    listed = (
        f"list_filter(list_transform(regexp_split_to_array(text, '\\n{WS}*\\n'), lambda p: {lines}), "
        "lambda z: z <> '')"
    )
    return explode(name, src, listed)


def sentences(name: str, src: str) -> str:
    return explode(name, src, sentences_list("text"))


def hard_pieces(name: str, src: str, limit: int) -> str:
    """Rows longer than the limit cut at spaces; the others as they are."""
    piece = f"substring(text, en + 1, {limit})"
    off = f"{limit} - instr(reverse({piece}), ' ')"
    return f"""
{name}_r AS (
  SELECT doc_id, i, text, CAST(0 AS BIGINT) AS st, CAST(0 AS BIGINT) AS en, 0 AS j FROM {src}
  UNION ALL
  SELECT doc_id, i, text, en, CASE WHEN length(text) - en <= {limit} THEN length(text)
     WHEN contains({piece}, ' ') AND {off} > {limit // 2}
     THEN en + {off} ELSE en + {limit} END, j + 1
  FROM {name}_r WHERE en < length(text)),
{name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS i, text FROM (
  SELECT doc_id, i, j, {strip('substring(text, st + 1, en - st)')} AS text FROM {name}_r WHERE j > 0)
  WHERE text <> '')"""


def regroup(name: str, src: str, numbered: str) -> str:
    """Join the texts of ``src`` by the chunk number in ``numbered``."""
    return f"""
{name} AS (SELECT doc_id, cid AS i, string_agg(text, ' ' ORDER BY i) AS text
  FROM {src} JOIN {numbered} USING (doc_id, i) GROUP BY doc_id, cid)"""


def _fold(name: str, src: str, start: str, columns: str, step: str) -> str:
    return f"""
{name}_n AS (
  SELECT doc_id, i, {start} FROM {src}_l WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, {step} FROM {name}_n r JOIN {src}_l s ON s.doc_id = r.doc_id AND s.i = r.i + 1)"""


def _lengths(src: str) -> str:
    return f"""
{src}_l AS (SELECT doc_id, i, length(text) AS len,
  lead(length(text)) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM {src})"""


def greedy(name: str, src: str, joins: str) -> str:
    """Join a row to the chunk before when ``joins`` (on ``r.cur``, ``s.len``)."""
    fold = _fold(
        name,
        src,
        "CAST(len AS BIGINT) AS cur, CAST(1 AS BIGINT) AS cid",
        "",
        f"CASE WHEN {joins} THEN r.cur + 1 + s.len ELSE s.len END, "
        f"CASE WHEN {joins} THEN r.cid ELSE r.cid + 1 END",
    )
    return ",".join([_lengths(src), fold, regroup(name, src, f"{name}_n")])


def pack_units(name: str, src: str, soft: int = 2000, hard: int = 2800) -> str:
    return greedy(
        name,
        src,
        f"(r.cur + 1 + s.len <= {soft} OR (r.cur < 350 AND r.cur + 1 + s.len <= {hard}))",
    )


def merge_small(name: str, src: str, small: int = 350, hard: int = 2800) -> str:
    return greedy(name, src, f"(s.len < {small} AND r.cur + 1 + s.len <= {hard})")


def semantic_units(name: str, src: str, soft: int = 2000) -> str:
    return ",".join(
        [
            paragraphs(f"{name}_p", src),
            explode(
                f"{name}_s",
                f"{name}_p",
                f"CASE WHEN length(text) <= {soft} THEN [text] ELSE {sentences_list('text')} END",
            ),
            hard_pieces(name, f"{name}_s", soft),
        ]
    )


def repack(name: str, src: str, cap: int) -> str:
    """Chunks over the cap packed again by sentence, chunk by chunk."""
    return f"""
{name}_a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS i, i AS k, l[j] AS text FROM (
  SELECT doc_id, i, l, unnest(range(1, len(l) + 1)) AS j FROM (
    SELECT doc_id, i, CASE WHEN length(text) <= {cap} THEN [text] ELSE {sentences_list('text')} END AS l
    FROM {src}))),
{name}_a_l AS (SELECT doc_id, i, k, length(text) AS len FROM {name}_a),
{name}_n AS (
  SELECT doc_id, i, k, CAST(len AS BIGINT) AS cur, CAST(1 AS BIGINT) AS cid FROM {name}_a_l WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, s.k,
    CASE WHEN s.k = r.k AND r.cur + 1 + s.len <= {cap} THEN r.cur + 1 + s.len ELSE s.len END,
    CASE WHEN s.k = r.k AND r.cur + 1 + s.len <= {cap} THEN r.cid ELSE r.cid + 1 END
  FROM {name}_n r JOIN {name}_a_l s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
{name} AS (SELECT doc_id, cid AS i, string_agg(text, ' ' ORDER BY i) AS text
  FROM {name}_a JOIN {name}_n USING (doc_id, i) GROUP BY doc_id, cid)"""


def merge_validation(name: str, src: str, floor: int, cap: int) -> str:
    total = "(coalesce(r.carry + 1, 0) + s.len)"
    back = f"({total} < {floor} AND r.prev + 1 + {total} <= {cap})"
    ahead = f"({total} < {floor} AND {total} + 1 + s.nxt <= {cap})"
    first_ahead = f"(len < {floor} AND len + 1 + nxt <= {cap})"
    return ",".join(
        [
            _lengths(src),
            f"""
{name}_n AS (
  SELECT doc_id, i, CASE WHEN {first_ahead} THEN CAST(NULL AS BIGINT) ELSE len END AS prev,
         CASE WHEN {first_ahead} THEN len ELSE CAST(NULL AS BIGINT) END AS carry,
         CASE WHEN {first_ahead} THEN 0 ELSE CAST(1 AS BIGINT) END AS top, CAST(1 AS BIGINT) AS cid
  FROM {src}_l WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i,
    CASE WHEN coalesce({back}, false) THEN r.prev + 1 + {total} WHEN coalesce({ahead}, false) THEN r.prev ELSE {total} END,
    CASE WHEN coalesce({back}, false) THEN NULL WHEN coalesce({ahead}, false) THEN {total} END,
    CASE WHEN coalesce({back}, false) OR coalesce({ahead}, false) THEN r.top ELSE r.top + 1 END,
    CASE WHEN coalesce({back}, false) THEN r.top ELSE r.top + 1 END
  FROM {name}_n r JOIN {src}_l s ON s.doc_id = r.doc_id AND s.i = r.i + 1)""",
            regroup(name, src, f"{name}_n"),
        ]
    )


def fix_endings(name: str, src: str, cap: int) -> str:
    """Sentence by sentence: fill the own chunk, or pull into the one before."""
    fits = f"r.cur + 1 + s.len <= {cap}"
    # mode: 0 the chunk under way is its own, 1 pulling, 2 pulling has stopped
    joins = (
        f"CASE WHEN s.first THEN r.mode = 0 AND NOT r.ends AND {fits} "
        f"ELSE r.mode = 0 OR (r.mode = 1 AND {fits}) END"
    )
    mode = (
        f"CASE WHEN s.first AND ({joins}) THEN CASE WHEN s.ends THEN 2 ELSE 1 END "
        f"WHEN r.mode = 1 AND ({joins}) AND s.ends THEN 2 "
        f"WHEN r.mode = 1 AND ({joins}) THEN 1 ELSE 0 END"
    )
    return f"""
{name}_a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS i, j = 1 AS first, l[j] AS text FROM (
  SELECT doc_id, i, l, unnest(range(1, len(l) + 1)) AS j FROM (
    SELECT doc_id, i, {sentences_list('text')} AS l FROM {src}))),
{name}_a_l AS (SELECT doc_id, i, first, length(text) AS len, {ends_sentence('text')} AS ends FROM {name}_a),
{name}_n AS (
  SELECT doc_id, i, CAST(len AS BIGINT) AS cur, ends, 0 AS mode, CAST(1 AS BIGINT) AS cid
  FROM {name}_a_l WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN {joins} THEN r.cur + 1 + s.len ELSE s.len END, s.ends, {mode},
         CASE WHEN {joins} THEN r.cid ELSE r.cid + 1 END
  FROM {name}_n r JOIN {name}_a_l s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
{name} AS (SELECT doc_id, cid AS i, string_agg(text, ' ' ORDER BY i) AS text
  FROM {name}_a JOIN {name}_n USING (doc_id, i) GROUP BY doc_id, cid)"""


def validate(name: str, src: str, cap: int = 1300, rounds: int = 4) -> str:
    ctes, at = [], src
    for k in range(1, rounds + 1):
        out = name if k == rounds else f"{name}{k}"
        ctes += [
            repack(f"{name}{k}a", at, cap),
            merge_validation(f"{name}{k}b", f"{name}{k}a", 300, cap),
            fix_endings(out, f"{name}{k}b", cap),
        ]
        at = out
    return ",".join(ctes)


def chunk_corpus(name: str, src: str, soft: int = 2000, cap: int = 1300) -> str:
    return ",".join(
        [
            semantic_units(f"{name}_u", src, soft),
            pack_units(f"{name}_k", f"{name}_u", soft),
            merge_small(f"{name}_m", f"{name}_k"),
            validate(name, f"{name}_m", cap),
        ]
    )


#: Texts without page marker lines.
BODY = r"""body AS (SELECT doc_id, i,
  regexp_replace(text, '(?m)^--- Page \d+ ---[ \t\n\r\f\v]*\n?', '', 'g') AS text FROM src)"""
