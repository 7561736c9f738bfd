"""Quality flags of extracted text and ranking of extraction methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.functions.rows import explode_once
from narralake.functions.text import DIGITS, LINE_END_MARKS, WS, let, strip, words

# --- fixed values: ranges, thresholds and weights -----------------------------
WIDE_PERSIAN = r"\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff"
LEADING_MARKS = ".!؟۔,;:)"
REVERSED_LITERALS = ("لوا لصف", "کيتارکومد")
MIN_PERSIAN_CHARS = 20
MIN_PERSIAN_RATIO = 0.08
MAX_ISOLATED = 0.12
MAX_SHORT_TOKENS = 0.35
MAX_SHORT_TOKEN = 2
MAX_OPEN_LINES = 0.25
MAX_DIGIT_LINES = 0.15
MAX_REVERSED_LINES = 0.20
SEVERE_FLAGS = (
    "EMPTY_TEXT",
    "MISSING_PERSIAN",
    "REPLACEMENT_CHARACTERS",
    "SHORT_TOKEN_RATIO_HIGH",
    "LOW_PERSIAN_RATIO",
    "LIKELY_REVERSED_RTL",
    "GLYPH_SUBSTITUTION_ARTIFACTS",
)
FAILED_SCORE = 10_000
# -----------------------------------------------------------------------------

LINE_BREAKS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def wide_persian_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{WIDE_PERSIAN}]"))


def visible_lines(c: Column) -> Column:
    parts = F.transform(F.split(c, LINE_BREAKS, -1), strip)
    return F.filter(parts, lambda x: x != "")


def line_measures(lines: Column) -> Column:
    """Counts of suspicious lines."""

    def count(test) -> Column:
        return F.size(F.filter(lines, test))

    def first_is(marks: str):
        return lambda x: F.lit(marks).contains(F.left(x, F.lit(1)))

    return F.struct(
        F.size(lines).alias("n"),
        count(first_is(LEADING_MARKS)).alias("reversed"),
        count(
            lambda x: (F.length(x) <= 3) & ~F.rlike(x, F.lit(f"[{WIDE_PERSIAN}]"))
        ).alias("isolated"),
        count(lambda x: ~F.lit(LINE_END_MARKS).contains(F.right(x, F.lit(1)))).alias("open"),
        count(lambda x: F.rlike(x, F.lit(rf"^[\p{{Nd}}{DIGITS}{WS}]+\z"))).alias("digits"),
    )


def token_measures(tokens: Column) -> Column:
    short = F.filter(tokens, lambda x: F.length(x) <= MAX_SHORT_TOKEN)
    return F.struct(F.size(tokens).alias("n"), F.size(short).alias("short"))


def _occurrences(c: Column, literal: str) -> Column:
    gone = F.replace(c, F.lit(literal), F.lit(""))
    return (F.length(c) - F.length(gone)) / len(literal)


def quality_profile(c: Column) -> Column:
    """``struct`` of length, script counts, flag list and warning level.

    The flag list keeps a flag that two rules raised twice, because the score
    counts it twice.
    """

    def measure(t: Column) -> Column:
        return F.struct(
            t.alias("t"),
            F.length(t).alias("length"),
            wide_persian_count(t).alias("persian"),
            let(visible_lines(t), line_measures).alias("lines"),
            let(words(t), token_measures).alias("tokens"),
            F.regexp_count(t, F.lit(r"[a-zA-Z]{4,}")).alias("latin_words"),
        )

    def flags(m: Column) -> Column:
        t, lines = m["t"], m["lines"]
        detected = m["persian"] >= MIN_PERSIAN_CHARS
        ratio = m["persian"] / F.greatest(m["length"], F.lit(1))

        def share(name: str, limit: float) -> Column:
            return (lines["n"] > 0) & (
                F.coalesce(F.try_divide(lines[name], lines["n"]), F.lit(0.0)) > limit
            )

        literal_reversed = F.contains(t, F.lit(REVERSED_LITERALS[0])) | F.contains(
            t, F.lit(REVERSED_LITERALS[1])
        )
        short_share = F.coalesce(F.try_divide(m["tokens"]["short"], m["tokens"]["n"]), F.lit(0.0))
        rules = [
            (m["length"] == 0, "EMPTY_TEXT"),
            (~detected & (m["length"] > 50), "MISSING_PERSIAN"),
            (share("reversed", MAX_REVERSED_LINES), "LIKELY_REVERSED_RTL"),
            (literal_reversed, "LIKELY_REVERSED_RTL"),
            (
                (_occurrences(t, "اس)می") >= 2) | (_occurrences(t, ")می") >= 2),
                "GLYPH_SUBSTITUTION_ARTIFACTS",
            ),
            (share("isolated", MAX_ISOLATED), "ISOLATED_PUNCTUATION"),
            (share("open", MAX_OPEN_LINES), "EXCESSIVE_LINE_BREAKS"),
            (share("digits", MAX_DIGIT_LINES), "DIGIT_FRAGMENTATION"),
            (short_share > MAX_SHORT_TOKENS, "SHORT_TOKEN_RATIO_HIGH"),
            (detected & (ratio < MIN_PERSIAN_RATIO) & (m["length"] > 200), "LOW_PERSIAN_RATIO"),
            (F.contains(t, F.lit("\ufffd")), "REPLACEMENT_CHARACTERS"),
            ((m["persian"] > 50) & (m["latin_words"] > 8), "MIXED_SCRIPT_FRAGMENTS"),
        ]
        raised = F.array_compact(F.array(*[F.when(test, F.lit(f)) for test, f in rules]))

        def result(found: Column) -> Column:
            severe = F.arrays_overlap(found, F.array(*[F.lit(f) for f in SEVERE_FLAGS]))
            warning = (
                F.when(severe, F.lit("POSSIBLE_BROKEN_TEXT"))
                .when(F.size(found) > 0, F.lit("MINOR_ISSUES"))
                .otherwise(F.lit("OK"))
            )
            return F.struct(
                m["length"].cast("bigint").alias("length"),
                detected.alias("persian_detected"),
                m["persian"].cast("bigint").alias("persian_char_count"),
                F.round(ratio, 4).alias("persian_ratio"),
                warning.alias("quality_warning"),
                found.alias("flags"),
            )

        return let(raised, result)

    return let(strip(F.coalesce(c, F.lit(""))), lambda t: let(measure(t), flags))


def method_score(profile: Column, error: Column) -> Column:
    """Penalty of one extraction; lower is better, a failed one is last."""
    penalty = (
        F.when(F.array_contains(profile["flags"], "LIKELY_REVERSED_RTL"), 200).otherwise(0)
        + F.when(profile["quality_warning"] == "POSSIBLE_BROKEN_TEXT", 100)
        .when(profile["quality_warning"] == "MINOR_ISSUES", 20)
        .otherwise(0)
        + F.size(profile["flags"]) * 5
        - F.least(F.floor(profile["persian_char_count"] / 10), F.lit(50))
        + F.floor(F.greatest(F.lit(0), 500 - profile["length"]) / 10)
    )
    failed = error.isNotNull() & (error != "")
    return F.when(failed, F.lit(FAILED_SCORE)).otherwise(penalty).cast("bigint")


def score_extractions(extractions: DataFrame) -> DataFrame:
    """Add ``profile`` and ``score`` to ``page_id, method, method_order, text, error``."""
    return extractions.withColumn("profile", quality_profile(F.col("text"))).withColumn(
        "score", method_score(F.col("profile"), F.col("error"))
    )


def rank_methods(scored: DataFrame) -> DataFrame:
    """Rank of each method on its page; a page has a handful of methods."""
    best_first = Window.partitionBy("page_id").orderBy("score", "method_order")
    return scored.withColumn("rank", F.row_number().over(best_first).cast("bigint"))


def flag_report(profiled: DataFrame, *by: str) -> DataFrame:
    """Texts per flag and group; warning levels appear as ``LEVEL:`` rows."""
    level = F.concat(F.lit("LEVEL:"), F.col("profile.quality_warning"))
    marks = F.concat(F.array_distinct(F.col("profile.flags")), F.array(level))
    return (
        explode_once(profiled, marks, "flag", "_pos", *by)
        .groupBy(*by, "flag")
        .agg(F.count(F.lit(1)).alias("texts"))
    )
