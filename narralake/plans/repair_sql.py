"""Repair steps as SQL stages, for the checks.

A stage maps ``(doc_id, page_number, text, <counters>)`` to the same columns;
the counters say how many changes of each kind were made, ``log`` lists them.
"""

from __future__ import annotations

from narralake.operators.repair import GLYPH_REPLACEMENTS, ordered_glyphs
from narralake.plans.views_sql import WS, lit, strip

DIGIT = "[۰-۹0-9٠-٩]"
NO_DIGIT = "[^۰-۹0-9٠-٩]"
TO_WEST = "translate({0}, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789')"
TO_PERSIAN = "translate({0}, '0123456789٠١٢٣٤٥٦٧٨٩', '۰۱۲۳۴۵۶۷۸۹۰۱۲۳۴۵۶۷۸۹')"
ENDS = "contains('.!?؟۔:])»\"''', right({0}, 1))"
BULLET = "contains('-•*#', left({0}, 1))"
LETTERS = r"length(regexp_replace({0}, '[^\p{{L}}\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}]', '', 'g'))"
PERSIAN = r"length(regexp_replace({0}, '[^\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}]', '', 'g'))"
LETTER_CLASS = r"[\p{L}\p{N}\x{0600}-\x{06FF}\x{0750}-\x{077F}]"
KINDS = ("replaced", "years", "joined_lines", "joined_paragraphs")


def heavy(e: str) -> str:
    return f"({LETTERS.format(e)} > 0 AND {PERSIAN.format(e)} * 5 >= {LETTERS.format(e)} * 2)"


def start(name: str, src: str) -> str:
    zeros = ", ".join(f"CAST(0 AS BIGINT) AS {k}" for k in KINDS)
    log = "CAST([] AS STRUCT(kind VARCHAR, before VARCHAR, after VARCHAR)[]) AS log"
    return f"{name} AS (SELECT doc_id, page_number, text, {zeros}, {log} FROM {src})"


def entry(kind: str, before: str, after: str) -> str:
    return f"struct_pack(kind := '{kind}', before := {before}, after := {after})"


def glyphs(name: str, src: str) -> str:
    ctes, at = [], src
    pairs = ordered_glyphs(GLYPH_REPLACEMENTS)
    for i, (bad, good) in enumerate(pairs, start=1):
        out = name if i == len(pairs) else f"{name}{i}"
        hits = f"(length(text) - length(replace(text, {lit(bad)}, ''))) // {len(bad)}"
        label = f"{lit(good)} || CASE WHEN {hits} = 1 THEN '' ELSE ' (×' || {hits} || ')' END"
        ctes.append(
            f"{out} AS (SELECT * REPLACE (replace(text, {lit(bad)}, {lit(good)}) AS text, "
            f"replaced + CASE WHEN contains(text, {lit(bad)}) THEN 1 ELSE 0 END AS replaced, "
            f"CASE WHEN contains(text, {lit(bad)}) THEN list_append(log, {entry('REPLACED', lit(bad), label)}) "
            f"ELSE log END AS log) FROM {at})"
        )
        at = out
    return ",\n".join(ctes)


def _year(digits: str) -> str:
    west = TO_WEST.format(digits)
    return (
        f"CASE WHEN length({digits}) <> 4 THEN NULL "
        f"WHEN {west} BETWEEN '1900' AND '2099' THEN {TO_PERSIAN.format(digits)} "
        f"WHEN reverse({west}) BETWEEN '1900' AND '2099' THEN {TO_PERSIAN.format(f'reverse({west})')} END"
    )


def _rewrite(name: str, src: str, pattern: str, out: str, before: str = "hits[i]", after: str = "outs[i]") -> str:
    """Replace hits of a pattern; ``out`` (of ``h``, ``i``) is null for "leave".

    ``before`` and ``after`` of the log are made of ``hits[i]`` and ``outs[i]``.
    """
    return f"""
{name}_t AS (SELECT *, regexp_extract_all(text, '{pattern}') AS hits,
  regexp_split_to_array(text, '{pattern}') AS pieces FROM {src}),
{name}_f AS (SELECT *, list_transform(hits, lambda h, i: {out}) AS outs FROM {name}_t),
{name} AS (SELECT * EXCLUDE (hits, pieces, outs) REPLACE (
    CASE WHEN len(hits) = 0 THEN text ELSE array_to_string(list_transform(pieces, lambda p, i:
      CASE WHEN i = 1 THEN '' ELSE coalesce(outs[i - 1], hits[i - 1]) END || p), '') END AS text,
    years + len(list_filter(outs, lambda o: o IS NOT NULL)) AS years,
    log || list_transform(list_filter(range(1, len(hits) + 1), lambda i: outs[i] IS NOT NULL),
      lambda i: {entry('YEAR_FIX', before, after)}) AS log) FROM {name}_f)"""


def _digits_of(h: str) -> str:
    return f"regexp_replace({h}, '{NO_DIGIT}', '', 'g')"


def year_join_lines(name: str, src: str) -> str:
    pattern = f"(?m)^{DIGIT}{{1,2}}{WS}*\\n{WS}*{DIGIT}{{2,3}}{WS}*$"
    runs = f"array_to_string(regexp_extract_all(hits[i], '{DIGIT}+'), chr(10))"
    return _rewrite(name, src, pattern, _year(_digits_of("h")), runs)


def year_after_context(name: str, src: str) -> str:
    """The pattern takes the line end along, so the output gives it back,
    unless the text ends there.
    """
    pattern = f"(?:سال|در سال){WS}*\\n{WS}*{DIGIT}{{4}}(?:{WS}*\\z|{WS}*\\n)"
    prefix = "regexp_extract(h, '^(سال|در سال)')"
    back = "CASE WHEN i = len(hits) AND pieces[len(pieces)] = '' THEN '' ELSE chr(10) END"
    before = f"{prefix.replace('(h,', '(hits[i],')} || chr(10) || {_digits_of('hits[i]')}"
    out = f"{prefix} || ' ' || ({_year(_digits_of('h'))}) || {back}"
    return _rewrite(name, src, pattern, out, before, "rtrim(outs[i], chr(10))")


def year_inline_join(name: str, src: str) -> str:
    pattern = f"{DIGIT}{WS}+{DIGIT}{{2,3}}(?:{NO_DIGIT}|\\z)"
    core = f"regexp_extract(h, '^{DIGIT}{WS}+{DIGIT}+')"
    out = f"({_year(_digits_of('h'))}) || substring(h, length({core}) + 1)"
    return _rewrite(name, src, pattern, out, core.replace("(h,", "(hits[i],"), "left(outs[i], 4)")


def year_reverse_fix(name: str, src: str) -> str:
    return _rewrite(name, src, f"{DIGIT}+", f"nullif({_year('h')}, h)")


def broken_words(name: str, src: str) -> str:
    """Joinable lines as gaps and islands: in a run every second line joins."""
    key = "doc_id, page_number"
    edge = "' ' || chr(9) || chr(13)"
    glued = (
        f"CASE WHEN regexp_matches(u, '{WS}') THEN regexp_replace(u, '{WS}+', ' ', 'g') "
        f"ELSE rtrim(x, {edge}) END || ltrim(nx, {edge})"
    )
    return rf"""
{name}_ln AS (SELECT {key}, i, ls[i] AS x FROM (
  SELECT {key}, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT {key}, string_split(text, chr(10)) AS ls FROM {src}))),
{name}_pr AS (SELECT *, {strip('x')} AS u, lead(x) OVER (PARTITION BY {key} ORDER BY i) AS nx FROM {name}_ln),
{name}_pt AS (SELECT *, {strip('nx')} AS low, regexp_extract(u, '[^ \t\n\r\f\v]+$') AS last FROM {name}_pr),
{name}_jn AS (SELECT *, coalesce(u <> '' AND low <> '' AND length(low) <= 24 AND length(last) <= 32
  AND NOT contains(low, ' ') AND NOT {ENDS.format('u')} AND NOT {BULLET.format('low')}
  AND NOT starts_with(u, '--- Page') AND NOT regexp_full_match(low, '{DIGIT}')
  AND NOT regexp_full_match(last, '{DIGIT}') AND regexp_matches(last, '{LETTER_CLASS}$')
  AND regexp_matches(low, '^{LETTER_CLASS}') AND {heavy('low')} AND {heavy('u')}, false) AS j
  FROM {name}_pt),
{name}_rn AS (SELECT *, i - row_number() OVER (PARTITION BY {key}, j ORDER BY i) AS run FROM {name}_jn),
{name}_ps AS (SELECT *, j AND (row_number() OVER (PARTITION BY {key}, j, run ORDER BY i)) % 2 = 1 AS joins
  FROM {name}_rn),
{name}_kp AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY {key} ORDER BY i), false) AS gone FROM {name}_ps),
{name}_ag AS (SELECT {key},
  string_agg(CASE WHEN joins THEN {glued} ELSE x END, chr(10) ORDER BY i) FILTER (NOT gone) AS t2,
  list({entry('JOINED_LINE', "u || ' + ' || low", strip(f'({glued})'))} ORDER BY i) FILTER (joins) AS l2,
  count(*) FILTER (joins) AS c2 FROM {name}_kp GROUP BY {key}),
{name} AS (SELECT * EXCLUDE (t2, c2, l2) REPLACE (t2 AS text, joined_lines + c2 AS joined_lines,
    log || coalesce(l2, []) AS log)
  FROM {src} JOIN {name}_ag USING ({key}))"""


def paragraph_lines(name: str, src: str) -> str:
    """A recursive query holds the piece that grows."""
    key = "doc_id, page_number"
    joins = (
        f"(s.para = r.para AND NOT {ENDS.format('r.cur')} AND NOT {BULLET.format('s.x')} "
        f"AND length(r.cur) <= 120 AND length(s.x) <= 120 AND {heavy('r.cur')} AND {heavy('s.x')})"
    )
    return rf"""
{name}_p AS (SELECT {key}, ps, unnest(range(1, len(ps) + 1)) AS para FROM (
  SELECT {key}, regexp_split_to_array(text, '\n{WS}*\n') AS ps FROM {src})),
{name}_l AS (SELECT {key}, para, list_filter(list_transform(string_split(ps[para], chr(10)),
    lambda z: {strip('z')}), lambda z: z <> '') AS ls FROM {name}_p),
{name}_x AS (SELECT {key}, para, row_number() OVER (PARTITION BY {key} ORDER BY para, i) AS i, x FROM (
  SELECT {key}, para, i, CASE WHEN len(ls) = 0 THEN '' ELSE ls[i] END AS x FROM (
    SELECT {key}, para, ls, unnest(range(1, greatest(len(ls), 1) + 1)) AS i FROM {name}_l))),
{name}_r AS (
  SELECT {key}, para, i, x AS cur, CAST(1 AS BIGINT) AS piece, false AS joined,
    CAST(NULL AS VARCHAR) AS two FROM {name}_x WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.page_number, s.para, s.i, CASE WHEN {joins} THEN r.cur || ' ' || s.x ELSE s.x END,
    CASE WHEN {joins} THEN r.piece ELSE r.piece + 1 END, {joins},
    CASE WHEN {joins} THEN r.cur || ' | ' || s.x END
  FROM {name}_r r JOIN {name}_x s ON s.doc_id = r.doc_id AND s.page_number = r.page_number AND s.i = r.i + 1),
{name}_g AS (SELECT {key}, para, piece, arg_max(cur, i) AS t, count(*) FILTER (joined) AS c
  FROM {name}_r GROUP BY {key}, para, piece),
{name}_q AS (SELECT {key}, para, string_agg(t, chr(10) ORDER BY piece) AS t, sum(c) AS c
  FROM {name}_g GROUP BY {key}, para),
{name}_a AS (SELECT {key}, string_agg(t, chr(10) || chr(10) ORDER BY para) AS t2, CAST(sum(c) AS BIGINT) AS c2
  FROM {name}_q GROUP BY {key}),
{name}_c AS (SELECT {key}, list({entry('JOINED_PARAGRAPH', 'two', 'cur')} ORDER BY i) FILTER (joined) AS l2
  FROM {name}_r GROUP BY {key}),
{name} AS (SELECT * EXCLUDE (t2, c2, l2) REPLACE ({strip('t2')} AS text,
    joined_paragraphs + c2 AS joined_paragraphs, log || coalesce(l2, []) AS log)
  FROM {src} JOIN {name}_a USING ({key}) JOIN {name}_c USING ({key}))"""


def newlines(name: str, src: str) -> str:
    return (
        f"{name} AS (SELECT * REPLACE (replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) "
        f"AS text) FROM {src})"
    )


def repair(name: str, src: str) -> str:
    stages = (newlines, glyphs, year_join_lines, year_after_context, year_inline_join,
              year_reverse_fix, broken_words, paragraph_lines)
    ctes, at = [start(f"{name}_0", src)], f"{name}_0"
    for i, stage in enumerate(stages, start=1):
        out = name if i == len(stages) else f"{name}_{i}"
        ctes.append(stage(out, at))
        at = out
    return ",\n".join(ctes)


FIX_COUNT = "+".join(KINDS)
