"""Queries of the narration-preparation operators, with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from narralake.functions import chunking as ck
from narralake.functions import narration as nr
from narralake.functions import text as tx
from narralake.functions.rows import explode_once
from narralake.plans import chunk_sql as cs
from narralake.plans.views_sql import PARAGRAPHED, SCENES, WS, lit, strip, with_recursive
from narralake.sources import tables as tb

# Chunk openings and endings by (doc_id + chunk_idx) modulo their number, so
# that every continuity rule has something to do.
PREFIXES = ("", "", "و ", ", ", "a b. ", "«cd ef. ", "اما  این. ", "")
SUFFIXES = ("", " and so,", "", " go on;", " wait!!", " so??", " hm..", " و،")
LONE_COMMA_EVERY = 31


def _chunk_array(text):
    """Sentences packed greedily into chunks."""
    return ck.pack_units(tx.split_sentences(text))


def _voiced(doc_id, chunks):
    def dress(x, i):
        kind = ((doc_id + i + 1) % len(PREFIXES)).cast("int")
        prefix = F.get(F.array(*[F.lit(p) for p in PREFIXES]), kind)
        suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), kind)
        return F.when((doc_id + i + 1) % LONE_COMMA_EVERY == 0, F.lit(",")).otherwise(
            F.concat(prefix, x, suffix)
        )

    return F.transform(chunks, dress)


def _documents(spark, sf_dir):
    """``doc_id, chunks`` with one array of chunk texts per document."""
    docs = tb.documents(spark, sf_dir).select("doc_id", tb.paragraphed(F.col("text")).alias("text"))
    return docs.select("doc_id", _voiced(F.col("doc_id"), _chunk_array(F.col("text"))).alias("chunks"))


def _chunks(spark, sf_dir):
    return explode_once(_documents(spark, sf_dir), F.col("chunks"), "text", "chunk_idx", "doc_id")


def _per_chunk(fn, name="text"):
    def query(spark, sf_dir):
        return _chunks(spark, sf_dir).select("doc_id", "chunk_idx", fn(F.col("text")).alias(name))

    return query


def _per_sentence(fn):
    def query(spark, sf_dir):
        pieces = fn(tx.split_sentences(F.col("text")))
        return explode_once(_chunks(spark, sf_dir), pieces, "text", "seq", "doc_id", "chunk_idx")

    return query


def adjust_opening(spark, sf_dir):
    opened = nr.adjust_openings(F.col("chunks"))
    return explode_once(_documents(spark, sf_dir), opened, "text", "chunk_idx", "doc_id")


def _prepared(spark, sf_dir):
    prepared = nr.prepare_chunks(F.col("chunks"))
    rows = explode_once(_documents(spark, sf_dir), prepared, "p", "chunk_idx", "doc_id")
    return rows.select("doc_id", "chunk_idx", "p.*")


def continuity_context(spark, sf_dir):
    return _prepared(spark, sf_dir).drop("conditioning_note")


def conditioning_note(spark, sf_dir):
    return _prepared(spark, sf_dir).select("doc_id", "chunk_idx", "conditioning_note")


def scene_block(spark, sf_dir):
    return tb.scene_settings(spark, sf_dir).select(
        "doc_id",
        nr.scene_block(F.col("use_scene"), F.col("scene"), F.col("style"), F.col("tone")).alias(
            "scene_context"
        ),
    )


def prompt_batch(spark, sf_dir):
    """One request row per chunk, with its size and place in the document."""
    docs = tb.scene_settings(spark, sf_dir).select(
        "doc_id",
        nr.scene_block(F.col("use_scene"), F.col("scene"), F.col("style"), F.col("tone")).alias(
            "scene_context"
        ),
        _voiced(F.col("doc_id"), _chunk_array(tb.paragraphed(F.col("text")))).alias("chunks"),
    )
    prepared = nr.prepare_chunks(F.col("chunks"))
    rows = explode_once(docs, prepared, "p", "chunk_idx", "doc_id", "scene_context")
    prompts = rows.select(
        "doc_id",
        "chunk_idx",
        nr.prompt_text(
            F.col("p.transcript_text"), F.col("p.conditioning_note"), F.col("scene_context")
        ).alias("prompt"),
        F.col("p.transcript_text").alias("transcript"),
    )
    return prompts.select(
        "*",
        F.length("prompt").cast("bigint").alias("prompt_char_count"),
        F.length("transcript").cast("bigint").alias("transcript_char_count"),
    )


def narration_pipeline(spark, sf_dir):
    """Documents to request rows: chunk, normalise, carry the context over, render.

    A document stays one row until its requests are made, so nothing is shuffled.
    """
    docs = tb.scene_settings(spark, sf_dir).select(
        "doc_id",
        nr.scene_block(F.col("use_scene"), F.col("scene"), F.col("style"), F.col("tone")).alias(
            "scene_context"
        ),
        ck.chunk_text(tb.paragraphed(F.col("text"))).alias("chunks"),
    )
    prepared = nr.prepare_chunks(F.transform("chunks", nr.normalize_chunk))
    rows = explode_once(docs, prepared, "p", "chunk_idx", "doc_id", "scene_context")
    return rows.select(
        "doc_id",
        "chunk_idx",
        "p.transcript_text",
        "p.conditioning_note",
        "p.last_punctuation_type",
        "p.continuity_flag",
        nr.prompt_text(
            F.col("p.transcript_text"), F.col("p.conditioning_note"), F.col("scene_context")
        ).alias("prompt"),
    )


def prompt_budget(spark, sf_dir):
    return prompt_batch(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("prompt_char_count").alias("prompt_chars"),
        F.sum("transcript_char_count").alias("transcript_chars"),
    )


QUERIES = {
    "normalize_punctuation": _per_chunk(nr.normalize_punctuation),
    "break_long_sentences": _per_sentence(nr.expand_long_sentences),
    "merge_short_fragments": _per_sentence(nr.merge_short_fragments),
    "stabilize_punctuation": _per_chunk(nr.stabilize_punctuation),
    "normalize_chunks": _per_chunk(nr.normalize_chunk),
    "end_punctuation": _per_chunk(nr.end_punctuation, "end_class"),
    "tail_sentences": _per_chunk(nr.tail_sentences, "tail"),
    "adjust_opening": adjust_opening,
    "continuity_context": continuity_context,
    "conditioning_note": conditioning_note,
    "scene_block": scene_block,
    "prompt_batch": prompt_batch,
    "prompt_budget": prompt_budget,
    "narration_pipeline": narration_pipeline,
}

# ----------------------------------------------------------------- SQL side --
_SRC = "src AS (SELECT doc_id, 1 AS i, text FROM paragraphed)"


def _pick(values) -> str:
    arms = " ".join(f"WHEN {n} THEN {lit(v)}" for n, v in enumerate(values) if v)
    return f"CASE (doc_id + i) % {len(values)} {arms} ELSE '' END"


_VOICED = f"""
v AS (SELECT doc_id, CAST(i AS BIGINT) AS chunk_idx, CASE WHEN (doc_id + i) % {LONE_COMMA_EVERY} = 0 THEN ','
  ELSE {_pick(PREFIXES)} || text || {_pick(SUFFIXES)} END AS text FROM hk)"""
_CHUNKS = with_recursive(
    PARAGRAPHED,
    _SRC,
    cs.sentences("s", "src"),
    cs.pack_units("k", "s"),
    cs.hard_pieces("hk", "k", ck.HARD_MAX),
    SCENES,
    _VOICED,
)
_WORDS = "len(regexp_extract_all({0}, '[^ \\t\\n\\r\\f\\v]+'))"


def _punctuation(expr: str) -> str:
    out = f"replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    out = rf"regexp_replace({out}, '[\x{{200C}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}\x{{FEFF}}]', '', 'g')"
    for pattern, mark in ((r"\.\.+", "."), ("…+", "…"), (r"[ \t\r\f\v]+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{mark}', 'g')"
    for mark in "،,؛;":
        out = f"regexp_replace({out}, '{WS}+{mark}', '{mark}', 'g')"
        out = f"regexp_replace(replace({out}, '{mark}', '{mark} '), '{mark} ({WS})', '{mark}\\1', 'g')"
    return strip(f"regexp_replace({out}, '{WS}+([.!?؟۔])', '\\1', 'g')")


def _steady(expr: str) -> str:
    out = strip(expr)
    for pattern, mark in (("!!+", "!"), (r"\?\?+", "؟"), (r"\.\.+", "."), ("——+", "—")):
        out = f"regexp_replace({out}, '{pattern}', '{mark}', 'g')"
    return out


def _class(expr: str) -> str:
    last = f"right(rtrim({expr}, ' ' || chr(9) || chr(10) || chr(13)), 1)"
    arms = " ".join(
        f"WHEN contains('{marks}', {last}) THEN '{name}'" for name, marks in nr.END_CLASSES
    )
    return f"CASE WHEN {last} = '' THEN 'none' {arms} ELSE 'other' END"


def _sentence_rows(name: str, src: str, expr: str) -> str:
    return f"""
{name} AS (SELECT doc_id, chunk_idx, j AS seq, l[j] AS text, {_WORDS.format('l[j]')} AS wc FROM (
  SELECT doc_id, chunk_idx, l, unnest(range(1, len(l) + 1)) AS j FROM (
    SELECT doc_id, chunk_idx, {cs.sentences_list(expr)} AS l FROM {src})))"""


def _broken(name: str, src: str) -> str:
    """Cuts of sentences over 40 words, by word position."""
    soft = "list_max(list_filter(range(en + 21, en + 41), lambda q: contains('،؛;:', right(ws[q], 1))))"
    return f"""
{name}_w AS (SELECT *, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS ws FROM {src} WHERE wc > 40),
{name}_r AS (
  SELECT doc_id, chunk_idx, seq, ws, wc, CAST(0 AS BIGINT) AS st, CAST(0 AS BIGINT) AS en, 0 AS j FROM {name}_w
  UNION ALL
  SELECT doc_id, chunk_idx, seq, ws, wc, en,
    CASE WHEN wc - en <= 40 THEN wc ELSE coalesce({soft}, en + 40) END, j + 1
  FROM {name}_r WHERE en < wc),
{name} AS (SELECT doc_id, chunk_idx, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY seq, j) AS seq,
  text, {_WORDS.format('text')} AS wc FROM (
    SELECT doc_id, chunk_idx, seq, j, array_to_string(ws[st + 1 : en], ' ') AS text FROM {name}_r WHERE j > 0
    UNION ALL SELECT doc_id, chunk_idx, seq, 0, text FROM {src} WHERE wc <= 40))"""


def _fragments(name: str, src: str) -> str:
    """Groups of sentences with at least six words; a leftover joins the last."""
    return f"""
{name}_r AS (
  SELECT doc_id, chunk_idx, seq, CASE WHEN wc < 6 THEN wc ELSE 0 END AS carry,
         CASE WHEN wc < 6 THEN 0 ELSE 1 END AS closed, 1 AS g FROM {src} WHERE seq = 1
  UNION ALL
  SELECT s.doc_id, s.chunk_idx, s.seq, CASE WHEN r.carry + s.wc < 6 THEN r.carry + s.wc ELSE 0 END,
         CASE WHEN r.carry + s.wc < 6 THEN r.closed ELSE r.closed + 1 END, r.closed + 1
  FROM {name}_r r JOIN {src} s ON s.doc_id = r.doc_id AND s.chunk_idx = r.chunk_idx AND s.seq = r.seq + 1),
{name}_g AS (SELECT doc_id, chunk_idx, seq,
  least(g, greatest(1, max(closed) OVER (PARTITION BY doc_id, chunk_idx))) AS g FROM {name}_r),
{name} AS (SELECT doc_id, chunk_idx, CAST(g AS BIGINT) AS seq, string_agg(text, ' ' ORDER BY {src}.seq) AS text
  FROM {name}_g JOIN {src} USING (doc_id, chunk_idx, seq) GROUP BY doc_id, chunk_idx, g)"""


_NORMAL = ",".join(
    [
        f"n1 AS (SELECT doc_id, chunk_idx, {_punctuation(strip('text'))} AS text FROM v)",
        _sentence_rows("n2", "n1", "text"),
        _broken("n3", "n2"),
        _fragments("n4", "n3"),
        f"""n5 AS (SELECT doc_id, chunk_idx, string_agg({_steady('text')}, ' ' ORDER BY seq) AS text
  FROM n4 GROUP BY doc_id, chunk_idx)""",
    ]
)

_CONN = "(?:" + "|".join(nr.CONNECTORS) + ")"
_FIRST = "l[1]"
_ADJUST = f"""
o AS (SELECT doc_id, chunk_idx, regexp_replace({strip('text')}, '^[،,]{WS}*', '') AS text FROM spoken),
oe AS (SELECT *, CASE WHEN {strip('text')} <> '' THEN {_class('text')} END AS k FROM o),
ol AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS pk,
       {cs.sentences_list('text')} AS l FROM oe),
of1 AS (SELECT *, CASE
    WHEN pk IN ('comma', 'semicolon') THEN CASE WHEN NOT regexp_matches({_FIRST}, '^{_CONN} ')
      AND {_WORDS.format(_FIRST)} < 6 AND regexp_matches({_FIRST}, '^[a-z0-9"«(]') THEN 'و ' || {_FIRST} ELSE {_FIRST} END
    WHEN pk = 'period' AND regexp_matches({_FIRST}, '^{_CONN}{WS}+') AND {_WORDS.format(_FIRST)} < 12
      THEN coalesce(nullif({strip(f"regexp_replace({_FIRST}, '^{_CONN}{WS}+', '')")}, ''), {_FIRST})
    ELSE {_FIRST} END AS f FROM ol),
adj AS (SELECT doc_id, chunk_idx, CASE WHEN pk IS NULL OR len(l) = 0 THEN text
  ELSE array_to_string(list_concat([f], l[2:]), ' ') END AS text FROM of1),
cx AS (SELECT *, {cs.sentences_list('text')} AS l FROM adj),
cy AS (SELECT doc_id, chunk_idx, text, coalesce(l[-1], '') AS last_s, array_to_string(l[-2:], ' ') AS tail,
  {_class("coalesce(l[-1], '')")} AS kind FROM cx),
prep AS (SELECT doc_id, chunk_idx, text AS transcript_text,
  coalesce(lag(last_s) OVER w, '') AS last_sentence_end,
  coalesce(lag(kind) OVER w, 'none') AS last_punctuation_type,
  coalesce(lag(kind) OVER w IN ('comma', 'semicolon'), false) AS continuity_flag,
  coalesce(lag(tail) OVER w, '') AS prior_sentences
  FROM cy WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_idx)),
noted AS (SELECT *, CASE WHEN prior_sentences = '' THEN {lit(nr.OPENING_NOTE)}
  ELSE {lit(nr.REFERENCE_NOTE)} || chr(10) || 'Previous ending (' || last_punctuation_type || '): «'
    || prior_sentences || '»' || chr(10)
    || CASE WHEN continuity_flag THEN {lit(nr.MID_THOUGHT_NOTE)} ELSE {lit(nr.FULL_STOP_NOTE)} END
  END AS conditioning_note FROM prep)"""
_BLOCK = f"""CASE WHEN use_scene AND coalesce(nullif(scene, ''), nullif(style, ''), nullif(tone, '')) IS NOT NULL
  THEN {lit(nr.SCENE_TITLE)} || chr(10) || '- Scene: ' || coalesce(nullif(scene, ''), {lit(nr.SCENE_DEFAULTS['scene'])})
    || chr(10) || '- Style: ' || coalesce(nullif(style, ''), {lit(nr.SCENE_DEFAULTS['style'])})
    || chr(10) || '- Tone: ' || coalesce(nullif(tone, ''), {lit(nr.SCENE_DEFAULTS['tone'])}) ELSE '' END"""
_PROMPTS = f""",
bl AS (SELECT doc_id, {_BLOCK} AS block FROM scenes),
pr AS (SELECT doc_id, chunk_idx, {lit(nr.DIRECTOR_PROMPT)} || chr(10) || chr(10)
  || {lit(nr.CONTINUITY_TITLE)} || chr(10) || conditioning_note
  || CASE WHEN block <> '' THEN chr(10) || chr(10) || block ELSE '' END
  || chr(10) || chr(10) || {strip('transcript_text')} AS prompt, transcript_text AS transcript
  FROM noted JOIN bl USING (doc_id))"""


def _on_chunks(expr: str, name: str = "text") -> str:
    return _CHUNKS + f"SELECT doc_id, chunk_idx, {expr} AS {name} FROM v"


_BASE = _CHUNKS.rstrip() + ","
_AS_CHUNKED = "\nspoken AS (SELECT * FROM v),"
_NORMALIZED = f"""
normalized AS (SELECT v.doc_id, v.chunk_idx, coalesce({_punctuation('n5.text')}, '') AS text
  FROM v LEFT JOIN n5 ON n5.doc_id = v.doc_id AND n5.chunk_idx = v.chunk_idx)"""
_PIPELINE = with_recursive(
    PARAGRAPHED,
    _SRC,
    cs.BODY,
    cs.chunk_corpus("c", "body"),
    SCENES,
    "v AS (SELECT doc_id, CAST(i AS BIGINT) AS chunk_idx, text FROM c)",
    _NORMAL,
    _NORMALIZED,
    "spoken AS (SELECT * FROM normalized)",
    _ADJUST.lstrip() + _PROMPTS,
)
ORACLES = {
    "normalize_punctuation": _on_chunks(_punctuation("text")),
    "break_long_sentences": _BASE + _sentence_rows("a", "v", "text") + "," + _broken("b", "a")
    + "\nSELECT doc_id, chunk_idx, seq, text FROM b",
    "merge_short_fragments": _BASE + _sentence_rows("a", "v", "text") + "," + _fragments("b", "a")
    + "\nSELECT doc_id, chunk_idx, seq, text FROM b",
    "stabilize_punctuation": _on_chunks(_steady("text")),
    "normalize_chunks": _BASE + _NORMAL + "," + _NORMALIZED + "\nSELECT * FROM normalized",
    "end_punctuation": _on_chunks(_class("text"), "end_class"),
    "tail_sentences": _on_chunks(
        f"coalesce(nullif(array_to_string(({cs.sentences_list('text')})[-2:], ' '), ''), {strip('text')})",
        "tail",
    ),
    "adjust_opening": _BASE + _AS_CHUNKED + _ADJUST + "\nSELECT doc_id, chunk_idx, text FROM adj",
    "continuity_context": _BASE + _AS_CHUNKED + _ADJUST + "\nSELECT * FROM prep",
    "conditioning_note": _BASE + _AS_CHUNKED + _ADJUST
    + "\nSELECT doc_id, chunk_idx, conditioning_note FROM noted",
    "scene_block": with_recursive(SCENES) + f"SELECT doc_id, {_BLOCK} AS scene_context FROM scenes",
    "prompt_batch": _BASE + _AS_CHUNKED + _ADJUST + _PROMPTS + """
SELECT *, length(prompt) AS prompt_char_count, length(transcript) AS transcript_char_count FROM pr""",
    "prompt_budget": _BASE + _AS_CHUNKED + _ADJUST + _PROMPTS + """
SELECT doc_id, count(*) AS requests, CAST(sum(length(prompt)) AS BIGINT) AS prompt_chars,
  CAST(sum(length(transcript)) AS BIGINT) AS transcript_chars FROM pr GROUP BY doc_id""",
    "narration_pipeline": _PIPELINE + """
SELECT doc_id, chunk_idx, transcript AS transcript_text, conditioning_note, last_punctuation_type, continuity_flag, prompt
FROM pr JOIN noted USING (doc_id, chunk_idx)""",
}
