"""Character classes and the text expressions every family shares.

All functions take and return Columns, so each one runs inside the JVM, can be
used on a table column as well as inside ``transform`` over an array, and needs
no shuffle.  White space means Unicode white space (what a Python ``strip``
removes), which is wider than Spark's own ``trim`` and Java's plain ``\\s``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character classes (regex class bodies and plain sets) -----
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WIDE_WS = r"\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = r"\t-\r" + _WIDE_WS
INLINE_WS = r"\t\x0b-\r" + _WIDE_WS
INVISIBLE = r"\u200c-\u200f\u202a-\u202e\u2060\ufeff"
WORD = r"\p{L}\p{N}_"
PERSIAN = r"\u0600-\u06ff\u0750-\u077f"
LINE_END_MARKS = ".!?؟۔:])»\"'"
BULLETS = "-•*#"
SENTENCE_MARKS = "؟!؛.۔:…?;"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
WESTERN_DIGITS = "0123456789"
DIGITS = "۰-۹0-9٠-٩"
# -----------------------------------------------------------------------------

# A run of white space.  The look-ahead turns down printable ASCII and most other
# letters with a range test each, which is much cheaper than going through the whole class.
NO_LETTER = r"(?![!-~])(?![\u00a1-\u167f])"
WS_RUN = rf"{NO_LETTER}[{WS}]+"
LINE_END_CLASS = r".!?؟۔:\])»\"'"
BULLET_CLASS = r"\-•*#"
PARAGRAPH_BREAK = rf"\n[{WS}]*\n"
SENTENCE_BREAK = rf"{NO_LETTER}(?<=[{SENTENCE_MARKS}])[{WS}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Catalyst does not share common subexpressions inside lambdas; binding the
    value as a lambda variable does.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def words(c: Column) -> Column:
    """Tokens between white space, as an array.

    Splitting at the gaps is several times faster than extracting the tokens.
    """
    return F.filter(F.split(strip(c), WS_RUN, -1), lambda w: w != "")


def word_count(c: Column) -> Column:
    body = strip(c)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, WS_RUN, -1)))


def has_words(c: Column, least: int) -> Column:
    """At least so many words; reads no further than the last of them."""
    word = rf"(?:[!-~]++|[\u00a1-\u167f]++|[^{WS}])"
    words_ = F.rlike(c, F.lit(rf"\A[{WS}]*+(?:{word}++[{WS}]++){{{least - 1}}}[^{WS}]"))
    return (F.length(c) >= 2 * least - 1) & words_


def replace_if(c: Column, needle: str, pattern: str, replacement: str) -> Column:
    """Regex replacement that is tried only on texts containing ``needle``."""
    return let(
        c,
        lambda t: F.when(
            F.contains(t, F.lit(needle)), F.regexp_replace(t, pattern, replacement)
        ).otherwise(t),
    )


def snippet(c: Column, limit: int) -> Column:
    """First ``limit`` characters of the stripped text, with an ellipsis if cut."""
    body = strip(c)
    return F.when(F.length(body) <= limit, body).otherwise(
        F.concat(F.substring(body, 1, limit), F.lit("…"))
    )


# ---------------------------------------------------------------- cleaning ---
def normalize_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?=[\u2000-\uffff])[{INVISIBLE}]", "")


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, rf"([{WORD}])-\n([{WORD}])", "$1$2")


def unwrap_lines(c: Column) -> Column:
    """Join soft-wrapped lines.

    Once the lines are stripped, the two characters around a newline decide: it
    becomes a space unless a neighbour line is blank, the upper line ends a
    sentence, or the lower one is a list item.
    """

    def join(t: Column) -> Column:
        stripped = F.array_join(F.transform(F.split(t, "\n", -1), strip), "\n")
        joined = F.regexp_replace(
            stripped, rf"\n(?<=[^\n{LINE_END_CLASS}]\n)(?=[^\n{BULLET_CLASS}])", " "
        )
        return F.when(F.contains(t, F.lit("\n")), joined).otherwise(t)

    return let(c, join)


def collapse_spaces(c: Column) -> Column:
    """A single space for each run; where that is there already, the text is left alone."""
    return F.regexp_replace(c, f"{NO_LETTER}(?! [!-~])[{INLINE_WS}]+", " ")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def clean_text(c: Column) -> Column:
    """All cleaning steps in order.

    ``unwrap_lines`` has already stripped every line of a multi-line text, so
    the per-line trim and the outer strip are one ``strip`` here.
    """
    steps = (
        normalize_newlines,
        strip_invisible,
        dehyphenate,
        unwrap_lines,
        collapse_spaces,
        collapse_blank_lines,
        strip,
    )
    out = F.coalesce(c, F.lit(""))
    for step in steps:
        out = step(out)
    return out


# ------------------------------------------------------------------ digits ---
def digits_to_western(c: Column) -> Column:
    return F.translate(c, PERSIAN_DIGITS + ARABIC_DIGITS, WESTERN_DIGITS * 2)


def digits_to_persian(c: Column) -> Column:
    return F.translate(c, WESTERN_DIGITS + ARABIC_DIGITS, PERSIAN_DIGITS * 2)


# ------------------------------------------------------------------ script ---
def persian_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{PERSIAN}]"))


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[\p{{L}}{PERSIAN}]"))


def is_persian_heavy(c: Column) -> Column:
    """At least 40 % of the letters are Persian; no letters means no."""
    letters = letter_count(c)
    return (letters > 0) & (persian_count(c) * 5 >= letters * 2)


def ends_line(c: Column) -> Column:
    """The (stripped) text ends in a mark that closes a line."""
    return F.lit(LINE_END_MARKS).contains(F.right(c, F.lit(1))) & (c != "")


def starts_bullet(c: Column) -> Column:
    return F.lit(BULLETS).contains(F.left(c, F.lit(1))) & (c != "")


# --------------------------------------------------------------- sentences ---
def split_paragraphs(c: Column) -> Column:
    """Blank-line separated paragraphs, each flattened to one line."""

    def flatten_lines(p: Column) -> Column:
        lines = F.transform(F.split(p, "\n", -1), strip)
        return F.array_join(F.filter(lines, lambda x: x != ""), " ")

    paragraphs = F.transform(F.split(c, PARAGRAPH_BREAK, -1), flatten_lines)
    return F.filter(paragraphs, lambda p: p != "")


def split_sentences(c: Column) -> Column:
    """Pieces after a sentence mark and white space; the mark stays left.

    A break takes all of its white space, so only the outer ends need a strip.
    """
    return F.filter(F.split(strip(c), SENTENCE_BREAK, -1), lambda p: p != "")


def ends_sentence(c: Column) -> Column:
    """A sentence mark, maybe inside closing quotes or brackets, ends the text."""
    return F.rlike(rstrip(c), F.lit(rf"[{SENTENCE_MARKS}][\"')\]]*\z"))


# ------------------------------------------------------------------- lists ---
def append(done: Column, item: Column) -> Column:
    return F.concat(done, F.array(item))


FOLD_BLOCK = 512


def fold_strings(
    items: Column,
    carried: dict[str, Column],
    step: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column],
) -> Column:
    """Ordered fold whose state is a list ``done`` and a few carried fields.

    Spark copies the state at every step, so a long ``done`` would make the fold
    quadratic in the size of the text.  The items are therefore taken in blocks:
    inside a block ``done`` starts empty, and it is added to the outer list once
    per block.  ``step`` may append to ``done`` but must not read it.
    """

    def state(done: Column, fields) -> Column:
        return F.struct(done.alias("done"), *[fields[k].alias(k) for k in carried])

    def take_block(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, state(empty_strings(), acc), step)
        return let(inner, lambda r: state(F.concat(acc["done"], r["done"]), r))

    def run(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(FOLD_BLOCK))
        blocks = F.transform(starts, lambda i: F.slice(a, i, F.lit(FOLD_BLOCK)))
        return F.aggregate(blocks, state(empty_strings(), carried), take_block, finish)

    return let(items, run)


def rewrite_matches(
    c: Column, pattern: str, resolve: Callable[[Column], Column]
) -> Column:
    """Regex substitution with a computed replacement and a change list.

    ``resolve(hit)`` gives ``struct(out, before, after)``; a null ``out`` leaves
    the hit as it is.  ``split`` and ``regexp_extract_all`` find the same
    non-overlapping hits, so the pieces and hits interleave.
    """

    def interleave(s: Column) -> Column:
        text = F.array_join(
            F.transform(
                s["pieces"],
                lambda piece, i: F.concat(
                    F.coalesce(
                        F.get(s["found"], i - 1)["out"], F.get(s["hits"], i - 1), F.lit("")
                    ),
                    piece,
                ),
            ),
            "",
        )
        changed = F.filter(s["found"], lambda f: f["out"].isNotNull())
        changes = F.transform(changed, lambda f: change("YEAR_FIX", f["before"], f["after"]))
        return F.struct(text.alias("text"), changes.alias("changes"))

    def with_found(hits: Column) -> Column:
        return let(
            F.struct(
                F.split(c, pattern, -1).alias("pieces"),
                hits.alias("hits"),
                F.transform(hits, resolve).alias("found"),
            ),
            interleave,
        )

    rewritten = let(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), with_found)
    return F.when(F.rlike(c, F.lit(pattern)), rewritten).otherwise(
        F.struct(c.alias("text"), no_changes().alias("changes"))
    )


def change(kind: str, before: Column, after: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), before.alias("before"), after.alias("after")
    )


def no_changes() -> Column:
    return F.array().cast("array<struct<kind:string,before:string,after:string>>")
