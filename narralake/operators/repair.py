"""Repair of extracted Persian text.

Every step maps a text to ``struct(text, changes)``.  The steps chain without a
shuffle; the change lists make the audit table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralake.functions.rows import explode_once
from narralake.functions.text import (
    DIGITS,
    PARAGRAPH_BREAK,
    PERSIAN,
    WS,
    WS_RUN,
    append,
    change,
    digits_to_persian,
    digits_to_western,
    empty_strings,
    ends_line,
    is_blank,
    is_persian_heavy,
    let,
    lstrip,
    no_changes,
    normalize_newlines,
    rewrite_matches,
    rstrip,
    starts_bullet,
    strip,
    words,
)

# --- fixed values: glyph corruptions and their repair ------------------------
GLYPH_REPLACEMENTS = {
    "روح 0 خمينی": "روح الله خمینی",
    "روح 0 خمینی": "روح الله خمینی",
    "اس)می": "اسلامی",
    "اس-می": "اسلامی",
    "انق)ب": "انقلاب",
    "انق-ب": "انقلاب",
    "انق)بی": "انقلابی",
    "جمھوری": "جمهوری",
    "مي-دی": "دهه\u200cی هشتاد",
    "ما=ر": "مارک",
    "ت)طم": "تلاطم",
    "ت)ش": "تلاش",
    "اع)م": "اعلام",
    "عُرفی": "عرفی",
}
KINDS = ("REPLACED", "YEAR_FIX", "JOINED_LINE", "JOINED_PARAGRAPH")
FIRST_YEAR, LAST_YEAR = "1900", "2099"
MAX_BROKEN_TAIL = 24
MAX_BROKEN_HEAD = 32
MAX_PARAGRAPH_PIECE = 120
#: Rows of a glyph table that may be sent to every task.
GLYPH_LIMIT = 10_000
# -----------------------------------------------------------------------------

# Joined-line counts as printable characters, written in strips.
CODE_BASE = 48
STRIP_LENGTH = 512

# Line anchors that know "\n" only, whatever else the engine calls a line end.
_BOL, _EOL = r"(?<![^\n])", r"(?![^\n])"
LINE_YEAR = rf"{_BOL}[{DIGITS}]{{1,2}}[{WS}]*\n[{WS}]*[{DIGITS}]{{2,3}}[{WS}]*{_EOL}"
CONTEXT_YEAR = rf"(?:سال|در سال)[{WS}]*\n[{WS}]*[{DIGITS}]{{4}}[{WS}]*(?=\n|\z)"
INLINE_YEAR = rf"[{DIGITS}][{WS}]+[{DIGITS}]{{2,3}}(?![{DIGITS}])"
YEAR_TOKEN = rf"(?<![{DIGITS}])[{DIGITS}]{{4}}(?![{DIGITS}])"


def ordered_glyphs(mapping: Mapping[str, str]) -> list[tuple[str, str]]:
    """Longest key first; equal lengths keep their given order."""
    return sorted(mapping.items(), key=lambda kv: -len(kv[0]))


def _result(text: Column, changes: Column) -> Column:
    return F.struct(text.alias("text"), changes.alias("changes"))


def glyph_repair(c: Column, mapping: Mapping[str, str] | None = None) -> Column:
    """Replace known corruptions one after another on the running text."""
    pairs = ordered_glyphs(mapping or GLYPH_REPLACEMENTS)
    table = F.array(
        *[F.struct(F.lit(k).alias("bad"), F.lit(v).alias("good")) for k, v in pairs]
    )
    return fold_glyphs(c, table)


def fold_glyphs(c: Column, table: Column) -> Column:
    """Apply an ordered array of (bad, good) to a text; the text and its changes."""

    def apply(acc: Column, g: Column) -> Column:
        removed = F.replace(acc["text"], g["bad"], F.lit(""))
        hits = ((F.length(acc["text"]) - F.length(removed)) / F.length(g["bad"])).cast("int")
        label = let(
            hits,
            lambda n: F.when(n == 1, g["good"]).otherwise(
                F.concat(g["good"], F.lit(" (×"), n.cast("string"), F.lit(")"))
            ),
        )
        return F.when(
            F.contains(acc["text"], g["bad"]),
            _result(
                F.replace(acc["text"], g["bad"], g["good"]),
                F.concat(acc["changes"], F.array(change("REPLACED", g["bad"], label))),
            ),
        ).otherwise(acc)

    return F.aggregate(table, _result(c, no_changes()), apply)


def glyph_arrays(glyphs: DataFrame, by: str | None = None, limit: int = GLYPH_LIMIT) -> DataFrame:
    """One row with `tables`: for each value of ``by`` its ordered array of (bad, good).

    ``glyphs``: bad, good, position (and ``by``, such as a language).  Longest
    first, equal lengths by position; of a corruption that is given twice the
    later repair counts.  Empty corruptions are left out; a null ``by`` is ''.
    More than ``limit`` rows are an error, as the arrays go to every task.
    """
    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    single = (
        glyphs.where(F.col("bad") != "")
        .groupBy(group.alias("_by"), "bad")
        .agg(F.max_by("good", "position").alias("good"), F.min("position").alias("position"))
    )
    entry = F.struct((-F.length("bad")).alias("length"), "position", "bad", "good")
    arrays = single.groupBy("_by").agg(F.array_sort(F.collect_list(entry)).alias("_a"), F.count("*").alias("_n"))
    pairs = F.transform("_a", lambda e: F.struct(e["bad"].alias("bad"), e["good"].alias("good")))
    total = F.sum("_n")
    checked = F.when(total > limit, F.raise_error(F.lit(f"more than {limit} glyph replacements"))).otherwise(
        F.map_from_entries(F.collect_list(F.struct("_by", pairs)))
    )
    return arrays.agg(checked.alias("tables"))


def repair_glyphs(
    pages: DataFrame, glyphs: DataFrame, by: str | None = None, text: str = "text", limit: int = GLYPH_LIMIT
) -> DataFrame:
    """pages with `repair`, the struct of glyph_repair(), by a table of replacements.

    The table becomes one value by a scalar subquery, so pages are not
    shuffled and nothing passes through the driver's code.  Pages whose value
    of ``by`` has no replacements stay as they are; an empty table changes
    nothing.
    """
    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    none = F.array().cast("array<struct<bad: string, good: string>>")
    held = pages.withColumn("_tables", glyph_arrays(glyphs, by, limit).scalar())
    table = F.coalesce(F.try_element_at("_tables", group), none)
    return held.withColumn("repair", fold_glyphs(F.col(text), table)).drop("_tables")


# ------------------------------------------------------------------- years ---
def _is_year(western: Column) -> Column:
    return (F.length(western) == 4) & western.between(FIRST_YEAR, LAST_YEAR)


def resolve_year(digits: Column) -> Column:
    """Persian-digit year for a token that is one forwards or backwards."""
    return let(
        digits_to_western(digits),
        lambda w: F.when(_is_year(w), digits_to_persian(w)).when(
            _is_year(F.reverse(w)), digits_to_persian(F.reverse(w))
        ),
    )


def fix_year_token(token: Column) -> Column:
    """Like ``resolve_year`` but null when the token already is canonical."""
    return F.nullif(resolve_year(token), token)


def _digit_runs(hit: Column) -> Column:
    return F.regexp_extract_all(hit, F.lit(f"[{DIGITS}]+"), F.lit(0))


def _found(out: Column, before: Column, after: Column) -> Column:
    return F.struct(out.alias("out"), before.alias("before"), after.alias("after"))


def year_join_lines(c: Column) -> Column:
    def resolve(hit: Column) -> Column:
        return let(
            _digit_runs(hit),
            lambda d: let(
                resolve_year(F.array_join(d, "")),
                lambda y: _found(y, F.array_join(d, "\n"), y),
            ),
        )

    return rewrite_matches(c, LINE_YEAR, resolve)


def year_after_context(c: Column) -> Column:
    def resolve(hit: Column) -> Column:
        digits = F.get(_digit_runs(hit), F.lit(0))
        prefix = F.regexp_extract(hit, "^(سال|در سال)", 1)

        def made(y: Column) -> Column:
            out = F.concat(prefix, F.lit(" "), y)
            return _found(out, F.concat(prefix, F.lit("\n"), digits), out)

        return let(resolve_year(digits), made)

    return rewrite_matches(c, CONTEXT_YEAR, resolve)


def year_inline_join(c: Column) -> Column:
    def resolve(hit: Column) -> Column:
        return let(
            resolve_year(F.array_join(_digit_runs(hit), "")),
            lambda y: _found(y, hit, y),
        )

    return rewrite_matches(c, INLINE_YEAR, resolve)


def year_reverse_fix(c: Column) -> Column:
    def resolve(hit: Column) -> Column:
        return let(fix_year_token(hit), lambda y: _found(y, hit, y))

    return rewrite_matches(c, YEAR_TOKEN, resolve)


def chain(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """Run repair steps one after another, adding up their changes."""

    def then(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda acc: let(
            step(acc["text"]),
            lambda r: _result(r["text"], F.concat(acc["changes"], r["changes"])),
        )

    out = steps[0](c)
    for step in steps[1:]:
        out = let(out, then(step))
    return out


def repair_years(c: Column) -> Column:
    fixed = chain(
        c, year_join_lines, year_after_context, year_inline_join, year_reverse_fix
    )
    return F.when(F.rlike(c, F.lit(f"[{DIGITS}]")), fixed).otherwise(
        _result(c, no_changes())
    )


# ------------------------------------------------------------------- lines ---
def _is_broken_word(upper: Column, lower: Column) -> Column:
    """``lower`` continues the last word of ``upper``.

    The short look at the lower line comes first; it turns most lines down.
    """
    one_digit = rf"^[{DIGITS}]\z"
    letter = rf"[\p{{L}}\p{{N}}{PERSIAN}]"

    def lower_fits(low: Column) -> Column:
        return (
            (low != "")
            & (F.length(low) <= MAX_BROKEN_TAIL)
            & ~F.contains(low, F.lit(" "))
            & ~starts_bullet(low)
            & F.rlike(low, F.lit(rf"^{letter}"))
            & ~F.rlike(low, F.lit(one_digit))
            & is_persian_heavy(low)
        )

    def upper_fits(u: Column) -> Column:
        return (
            (u != "")
            & ~ends_line(u)
            & ~F.startswith(u, F.lit("--- Page"))
            & is_persian_heavy(u)
            & let(F.element_at(words(u), -1), last_fits)
        )

    def last_fits(last: Column) -> Column:
        return (
            (F.length(last) <= MAX_BROKEN_HEAD)
            & ~F.rlike(last, F.lit(one_digit))
            & F.rlike(F.right(last, F.lit(1)), F.lit(letter))
        )

    return F.when(let(strip(lower), lower_fits), let(strip(upper), upper_fits)).otherwise(
        F.lit(False)
    )


def _join_words(upper: Column, lower: Column) -> Column:
    body = strip(upper)
    flat = F.regexp_replace(body, WS_RUN, " ")
    head = F.when(F.rlike(body, F.lit(f"[{WS}]")), flat).otherwise(rstrip(upper))
    return F.concat(head, lstrip(lower))


def join_broken_words(c: Column) -> Column:
    """Greedy left-to-right joins of a line with the next one.

    A joined pair is not extended, so the choice is a non-overlapping match
    over the 0/1 string of joinable lines: each ``1`` takes the character after
    it.  The regex engine finds those matches in one linear pass.
    """

    def mark(lines: Column) -> Column:
        joinable = F.transform(
            lines,
            lambda x, i: F.when(
                (i + 1 < F.size(lines)) & _is_broken_word(x, F.get(lines, i + 1)), F.lit("1")
            ).otherwise(F.lit("0")),
        )
        codes = F.split(F.regexp_replace(F.array_join(joinable, ""), "1.", "JS"), "", -1)
        return let(codes, lambda k: build(lines, k))

    def build(lines: Column, codes: Column) -> Column:
        out = F.transform(
            lines,
            lambda x, i: F.when(
                F.get(codes, i) == "J", _join_words(x, F.get(lines, i + 1))
            ).when(F.get(codes, i) != "S", x),
        )
        changes = F.transform(
            lines,
            lambda x, i: F.when(
                F.get(codes, i) == "J",
                change(
                    "JOINED_LINE",
                    F.concat(strip(x), F.lit(" + "), strip(F.get(lines, i + 1))),
                    strip(_join_words(x, F.get(lines, i + 1))),
                ),
            ),
        )
        return _result(F.array_join(F.array_compact(out), "\n"), F.array_compact(changes))

    worth_it = F.contains(c, F.lit("\n")) & F.rlike(c, F.lit(f"[{PERSIAN}]"))
    return F.when(worth_it, let(F.split(c, "\n", -1), mark)).otherwise(
        _result(c, no_changes())
    )


def _joined_counts(lines: Column) -> Column:
    """For each line, how many lines its piece had before it (0: a new piece).

    The grown piece feeds the next test, so this is a fold.  It writes one
    character per line, in strips of bounded length, so that its cost stays
    linear for a text of any number of lines.  A piece has at most
    ``MAX_PARAGRAPH_PIECE`` characters before it grows, which bounds the count.
    """

    def state(strips: Column, strip_: Column, prev: Column, count: Column) -> Column:
        return F.struct(
            strips.alias("strips"),
            strip_.alias("strip"),
            prev.alias("prev"),
            count.cast("int").alias("count"),
        )

    def step(acc: Column, cur: Column) -> Column:
        prev = acc["prev"]
        joins = (
            ~ends_line(prev)
            & ~starts_bullet(cur)
            & (F.length(prev) <= MAX_PARAGRAPH_PIECE)
            & (F.length(cur) <= MAX_PARAGRAPH_PIECE)
            & is_persian_heavy(prev)
            & is_persian_heavy(cur)
        )
        grown = F.when(
            joins, F.struct(F.concat(prev, F.lit(" "), cur).alias("prev"), (acc["count"] + 1).alias("count"))
        ).otherwise(F.struct(cur.alias("prev"), F.lit(0).alias("count")))

        def write(g: Column) -> Column:
            code = F.chr(g["count"] + CODE_BASE)
            full = F.length(acc["strip"]) >= STRIP_LENGTH
            return F.when(
                full, state(append(acc["strips"], acc["strip"]), code, g["prev"], g["count"])
            ).otherwise(
                state(acc["strips"], F.concat(acc["strip"], code), g["prev"], g["count"])
            )

        return let(grown, write)

    codes = F.aggregate(
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
        state(empty_strings(), F.lit(chr(CODE_BASE)), F.get(lines, F.lit(0)), F.lit(0)),
        step,
        lambda acc: F.array_join(append(acc["strips"], acc["strip"]), ""),
    )
    return F.transform(F.split(codes, "", -1), lambda k: F.ascii(k) - CODE_BASE)


def _join_paragraph(lines: Column) -> Column:
    """Lines of one paragraph to ``struct(text, changes)``."""

    def build(counts: Column) -> Column:
        glued = F.transform(
            lines,
            lambda x, i: F.when(i == 0, x)
            .when(F.get(counts, i) == 0, F.concat(F.lit("\n"), x))
            .otherwise(F.concat(F.lit(" "), x)),
        )

        def joined(x: Column, i: Column) -> Column:
            n = F.get(counts, i)
            return let(
                F.array_join(F.slice(lines, i - n + 1, n), " "),
                lambda prev: change(
                    "JOINED_PARAGRAPH",
                    F.concat(prev, F.lit(" | "), x),
                    F.concat(prev, F.lit(" "), x),
                ),
            )

        changes = F.transform(
            lines, lambda x, i: F.when(F.get(counts, i) > 0, joined(x, i))
        )
        return _result(F.array_join(glued, ""), F.array_compact(changes))

    return F.when(F.size(lines) > 1, let(_joined_counts(lines), build)).otherwise(
        _result(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), no_changes())
    )


def join_paragraph_lines(c: Column) -> Column:
    def lines_of(p: Column) -> Column:
        return F.filter(F.transform(F.split(p, "\n", -1), strip), lambda x: x != "")

    folded = F.transform(
        F.split(c, PARAGRAPH_BREAK, -1), lambda p: let(lines_of(p), _join_paragraph)
    )
    return let(
        folded,
        lambda r: _result(
            strip(F.array_join(F.transform(r, lambda x: x["text"]), "\n\n")),
            F.flatten(F.transform(r, lambda x: x["changes"])),
        ),
    )


def repair_text(c: Column, mapping: Mapping[str, str] | None = None) -> Column:
    """All repairs in order; a blank text stays as it is."""
    text = F.coalesce(c, F.lit(""))
    fixed = chain(
        normalize_newlines(text),
        lambda t: glyph_repair(t, mapping),
        repair_years,
        join_broken_words,
        join_paragraph_lines,
    )
    return F.when(is_blank(text), _result(text, no_changes())).otherwise(fixed)


# ------------------------------------------------------------------- audit ---
def repair_corpus(pages: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Pages with ``text`` repaired, the change list and its size; map-only."""
    fixed = pages.withColumn("_r", repair_text(F.col("text"), mapping))
    return fixed.select(
        *[c for c in pages.columns if c != "text"],
        F.col("_r.text").alias("text"),
        F.col("_r.changes").alias("changes"),
        F.size("_r.changes").cast("bigint").alias("fix_count"),
    )


def change_log(repaired: DataFrame, *keys: str) -> DataFrame:
    """One row per change, in order."""
    return explode_once(repaired, F.col("changes"), "c", "seq", *keys).select(
        *keys,
        "seq",
        F.col("c.kind").alias("kind"),
        F.col("c.before").alias("before"),
        F.col("c.after").alias("after"),
    )


def _count_kind(kind: str) -> Column:
    hits = F.filter("changes", lambda c: c["kind"] == kind)
    return F.size(hits).cast("bigint").alias(kind)


def fix_counts(repaired: DataFrame, *by: str) -> DataFrame:
    """Fixes by kind.  Pages are reduced to counts before the shuffle."""
    sized = repaired.select(*by, *[_count_kind(kind) for kind in KINDS])
    counts = sized.groupBy(*by).agg(*[F.sum(kind).alias(kind.lower()) for kind in KINDS])
    total = sum((F.col(kind.lower()) for kind in KINDS), F.lit(0))
    return counts.withColumn("fixes", total.cast("bigint")).withColumn(
        "repair_applied", F.col("fixes") > 0
    )


def diff_text(changes: Column) -> Column:
    """Readable diff of a change list."""
    blocks = F.transform(
        changes,
        lambda x: F.concat(
            F.lit("["), x["kind"], F.lit("]\n"), x["before"], F.lit("\n→ "), x["after"]
        ),
    )
    return F.when(F.size(changes) > 0, F.array_join(blocks, "\n\n")).otherwise(
        F.lit("(no changes applied)")
    )
