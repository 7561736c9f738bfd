"""Queries of the extraction-quality operators, with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from narralake.operators import profile as pf
from narralake.plans.views_sql import DIRTY_DOCS, DIRTY_PAGES, DOC_PAGES, EXTRACTIONS, lit, strip, with_
from narralake.sources import tables as tb

KEYS = ["doc_id", "page_number"]


def _profiled(spark, sf_dir):
    return tb.dirty_pages(spark, sf_dir).withColumn("profile", pf.quality_profile(F.col("text")))


def _flags(*names):
    def query(spark, sf_dir):
        flags = F.col("profile.flags")
        return _profiled(spark, sf_dir).select(
            *KEYS, *[F.array_contains(flags, n).alias(n.lower()) for n in names]
        )

    return query


def script_profile(spark, sf_dir):
    return _profiled(spark, sf_dir).select(
        *KEYS,
        "profile.length",
        "profile.persian_char_count",
        "profile.persian_ratio",
        "profile.persian_detected",
    )


def quality_label(spark, sf_dir):
    return _profiled(spark, sf_dir).select(
        *KEYS, "profile.quality_warning", F.array_join("profile.flags", ",").alias("flags")
    )


def method_score(spark, sf_dir):
    scored = pf.score_extractions(tb.extractions(spark, sf_dir))
    return scored.select("page_id", "method", "score")


def method_rank(spark, sf_dir):
    ranked = pf.rank_methods(pf.score_extractions(tb.extractions(spark, sf_dir)))
    return ranked.select("page_id", "method", "score", "rank")


def corpus_quality_report(spark, sf_dir):
    return pf.flag_report(_profiled(spark, sf_dir), "lang", "source")


LINE_FLAGS = (
    "LIKELY_REVERSED_RTL",
    "ISOLATED_PUNCTUATION",
    "EXCESSIVE_LINE_BREAKS",
    "DIGIT_FRAGMENTATION",
)
TOKEN_FLAGS = ("SHORT_TOKEN_RATIO_HIGH", "MIXED_SCRIPT_FRAGMENTS")
CHAR_FLAGS = (
    "EMPTY_TEXT",
    "MISSING_PERSIAN",
    "GLYPH_SUBSTITUTION_ARTIFACTS",
    "LOW_PERSIAN_RATIO",
    "REPLACEMENT_CHARACTERS",
)

QUERIES = {
    "script_profile": script_profile,
    "line_flags": _flags(*LINE_FLAGS),
    "token_flags": _flags(*TOKEN_FLAGS),
    "char_flags": _flags(*CHAR_FLAGS),
    "quality_label": quality_label,
    "method_score": method_score,
    "method_rank": method_rank,
    "corpus_quality_report": corpus_quality_report,
}

# ----------------------------------------------------------------- SQL side --
_WIDE = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"


def _share(test: str) -> str:
    return f"(len(ls) > 0 AND len(list_filter(ls, lambda x: {test})) / len(ls) > {{0}})"


def _count(needle: str) -> str:
    return f"((length(t) - length(replace(t, {lit(needle)}, ''))) // {len(needle)})"


_RULES = [
    ("length(t) = 0", "EMPTY_TEXT"),
    ("p < 20 AND length(t) > 50", "MISSING_PERSIAN"),
    (_share("contains('.!؟۔,;:)', left(x, 1))").format(0.2), "LIKELY_REVERSED_RTL"),
    ("contains(t, 'لوا لصف') OR contains(t, 'کيتارکومد')", "LIKELY_REVERSED_RTL"),
    (f"{_count('اس)می')} >= 2 OR {_count(')می')} >= 2", "GLYPH_SUBSTITUTION_ARTIFACTS"),
    (
        _share(f"length(x) <= 3 AND NOT regexp_matches(x, '[{_WIDE}]')".replace("{", "{{").replace("}", "}}")).format(0.12),
        "ISOLATED_PUNCTUATION",
    ),
    (_share("NOT contains('.!?؟۔:)]»\"''', right(x, 1))").format(0.25), "EXCESSIVE_LINE_BREAKS"),
    (
        _share(r"regexp_full_match(x, '[\d۰-۹٠-٩ \t\n\r\f\v]+')").format(0.15),
        "DIGIT_FRAGMENTATION",
    ),
    (
        "len(toks) > 0 AND len(list_filter(toks, lambda x: length(x) <= 2)) / len(toks) > 0.35",
        "SHORT_TOKEN_RATIO_HIGH",
    ),
    ("p >= 20 AND p / greatest(length(t), 1) < 0.08 AND length(t) > 200", "LOW_PERSIAN_RATIO"),
    ("contains(t, chr(65533))", "REPLACEMENT_CHARACTERS"),
    ("p > 50 AND len(regexp_extract_all(t, '[a-zA-Z]{4,}')) > 8", "MIXED_SCRIPT_FRAGMENTS"),
]
_SEVERE = ", ".join(lit(f) for f in pf.SEVERE_FLAGS)


def _profile(src: str) -> str:
    arms = ", ".join(f"CASE WHEN {test} THEN '{flag}' END" for test, flag in _RULES)
    return rf"""
q1 AS (SELECT *, {strip('text')} AS t FROM {src}),
q2 AS (SELECT *, length(regexp_replace(t, '[^{_WIDE}]', '', 'g')) AS p,
  list_filter(list_transform(regexp_split_to_array(t, '[\n\r\f\v]'), lambda x: {strip('x')}),
              lambda x: x <> '') AS ls,
  regexp_extract_all(t, '[^ \t\n\r\f\v]+') AS toks FROM q1),
q3 AS (SELECT *, list_filter([{arms}], lambda f: f IS NOT NULL) AS flags FROM q2),
prof AS (SELECT *, CASE WHEN list_has_any(flags, [{_SEVERE}]) THEN 'POSSIBLE_BROKEN_TEXT'
  WHEN len(flags) > 0 THEN 'MINOR_ISSUES' ELSE 'OK' END AS quality_warning FROM q3)
"""


_PAGES = with_(DOC_PAGES, DIRTY_PAGES).rstrip() + "," + _profile("dirty_pages")
_SCORED = with_(DIRTY_DOCS, EXTRACTIONS).rstrip() + "," + _profile("extractions").rstrip() + """,
scored AS (SELECT *, CAST(CASE WHEN error <> '' THEN 10000 ELSE
  CASE WHEN list_contains(flags, 'LIKELY_REVERSED_RTL') THEN 200 ELSE 0 END
  + CASE quality_warning WHEN 'POSSIBLE_BROKEN_TEXT' THEN 100 WHEN 'MINOR_ISSUES' THEN 20 ELSE 0 END
  + len(flags) * 5 - least(p // 10, 50) + greatest(0, 500 - length(t)) // 10 END AS BIGINT) AS score
  FROM prof)
"""


def _flag_sql(names) -> str:
    cols = ", ".join(f"list_contains(flags, '{n}') AS {n.lower()}" for n in names)
    return _PAGES + f"SELECT doc_id, page_number, {cols} FROM prof"


ORACLES = {
    "script_profile": _PAGES + """SELECT doc_id, page_number, length(t) AS length,
  p AS persian_char_count, round(p / greatest(length(t), 1), 4) AS persian_ratio,
  p >= 20 AS persian_detected FROM prof""",
    "line_flags": _flag_sql(LINE_FLAGS),
    "token_flags": _flag_sql(TOKEN_FLAGS),
    "char_flags": _flag_sql(CHAR_FLAGS),
    "quality_label": _PAGES + """SELECT doc_id, page_number, quality_warning,
  array_to_string(flags, ',') AS flags FROM prof""",
    "method_score": _SCORED + "SELECT page_id, method, score FROM scored",
    "method_rank": _SCORED + """SELECT page_id, method, score,
  row_number() OVER (PARTITION BY page_id ORDER BY score, method_order) AS rank FROM scored""",
    "corpus_quality_report": _PAGES + """SELECT lang, source, flag, count(*) AS texts FROM (
  SELECT lang, source, unnest(list_append(list_distinct(flags), 'LEVEL:' || quality_warning)) AS flag
  FROM prof) GROUP BY lang, source, flag""",
}
