"""Preparing chunks for narration: rhythm, continuity and prompt text.

A chunk's opening depends on how the chunk before it ended.  The feedback is a
plain look-back inside the document's own chunk array: adjusting an opening
never changes an ending, so one pass finds the endings and the next one uses
them.  Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from narralake.functions.text import (
    WS,
    WS_RUN,
    append,
    collapse_spaces,
    fold_strings,
    has_words,
    is_blank,
    let,
    normalize_newlines,
    replace_if,
    rstrip,
    split_sentences,
    strip,
    strip_invisible,
    word_count,
)

# --- fixed values: limits, word lists and prompt wording ---------------------
MAX_SENTENCE_WORDS = 40
MIN_FRAGMENT_WORDS = 6
MAX_CLAUSE_WORDS = 6
MAX_CONNECTOR_WORDS = 12
TAIL_SENTENCES = 2
CONNECTORS = ("و", "اما", "ولی", "که", "چون", "زیرا", "اگر", "چنانکه", "همچنین", "البته")
END_CLASSES = (
    ("comma", "،,"),
    ("question", "؟?"),
    ("exclamation", "!"),
    ("semicolon", "؛;"),
    ("period", ".۔…"),
)
OPENING_NOTE = (
    "This is the opening segment. Begin with a natural audiobook intro cadence."
)
REFERENCE_NOTE = (
    "CONTINUITY REFERENCE — for pacing and tone only; do NOT read these lines aloud:"
)
MID_THOUGHT_NOTE = (
    "The prior segment ended mid-thought (comma/semicolon). "
    "Continue the same breath and emotional line into the transcript below. "
    "Do not add a long pause at the start."
)
FULL_STOP_NOTE = (
    "The prior segment ended on a full stop. "
    "Begin the transcript below with a gentle fresh beat while keeping the same narrator voice."
)
SCENE_TITLE = "## Scene Context (do NOT read aloud)"
SCENE_DEFAULTS = {
    "scene": "default narration environment",
    "style": "neutral audiobook style",
    "tone": "consistent narration",
}
CONTINUITY_TITLE = "## Voice continuity (do NOT read aloud):"
DIRECTOR_PROMPT = """Read the following Persian audiobook narration.

# Director's note

Style:
Warm, emotionally engaging, cinematic, deeply human.

Voice:
Single narrator only — use prebuilt voice Sulafat for the entire audiobook.
Warm masculine Persian narrator.
Deep but soft voice.
Professional audiobook quality.
Natural Persian pronunciation.
Do not switch voices or introduce a second speaker.

Pacing:
Natural pacing.
Not too slow.
Not robotic.
Smooth storytelling rhythm.

Emotion:
Warm, reflective, emotionally engaging.
Speak naturally like a premium Persian audiobook narrator telling an important life story.

Avoid:
Monotone voice.
Cold documentary tone.
Excessive slowness.
Overly dramatic acting.

## Sample Context:
A premium Persian audiobook narrator telling an important life story in a warm, emotionally engaging, cinematic way. Natural pacing, warm emotional depth, human sounding voice.

## Transcript (single narrator — Sulafat):

Narration:
[speak warmly]
[natural pacing]
[cinematic]
[human tone]"""
# -----------------------------------------------------------------------------

_CONNECTOR = rf"^(?:{'|'.join(CONNECTORS)})[{WS}]+"


# ------------------------------------------------------------ normalisation --
def normalize_punctuation(c: Column) -> Column:
    """Spaces around commas and semicolons, repeated dots, stray spaces."""
    out = strip_invisible(normalize_newlines(c))
    out = replace_if(out, "..", r"\.{2,}", ".")
    out = replace_if(out, "……", "…+", "…")
    return _space_marks(collapse_spaces(out))


def _space_marks(c: Column) -> Column:
    """Spaces around marks, in a text whose white space is single spaces and line feeds."""

    def close_up(mark: str) -> Callable[[Column], Column]:
        loose = lambda t: F.contains(t, F.lit(f" {mark}")) | F.contains(t, F.lit(f"\n{mark}"))
        return lambda t: F.when(loose(t), F.regexp_replace(t, rf"[ \n]+{mark}", mark)).otherwise(t)

    out = c
    for mark in "،,؛;":
        out = let(out, close_up(mark))
        out = replace_if(out, mark, rf"{mark}(?=[^ \n])", f"{mark} ")
    return strip(F.regexp_replace(out, r"[ \n]++(?=[.!?؟۔])", ""))


def break_long_sentence(c: Column, limit: int = MAX_SENTENCE_WORDS) -> Column:
    """Pieces of at most ``limit`` words, ending at a soft break if there is one
    in the second half of the window.  Stated as one linear regex on the
    single-spaced sentence.
    """
    half = max(limit // 2, 1)
    pattern = (
        r"(?:[^ ]++(?: |\z)){1,%d}+\z" % limit
        + r"|(?:[^ ]++ ){%d,%d}[^ ]*[،؛;:](?: )" % (half, limit - 1)
        + r"|(?:[^ ]++ ){%d}" % limit
    )
    flat = strip(F.regexp_replace(c, WS_RUN, " "))
    pieces = F.transform(F.regexp_extract_all(flat, F.lit(pattern), F.lit(0)), strip)
    return F.when(~has_words(c, limit + 1), F.array(c)).otherwise(pieces)


def expand_long_sentences(sentences: Column, limit: int = MAX_SENTENCE_WORDS) -> Column:
    return F.flatten(F.transform(sentences, lambda s: break_long_sentence(s, limit)))


def merge_short_fragments(sentences: Column, floor: int = MIN_FRAGMENT_WORDS) -> Column:
    """Carry short pieces forward until enough words; a leftover joins the last."""

    def state(done: Column, carry: Column) -> Column:
        return F.struct(done.alias("done"), carry.cast("string").alias("carry"))

    def step(acc: Column, s: Column) -> Column:
        both = F.coalesce(F.concat(acc["carry"], F.lit(" "), s), s)
        return let(
            both,
            lambda b: F.when(~has_words(b, floor), state(acc["done"], b)).otherwise(
                state(append(acc["done"], b), F.lit(None))
            ),
        )

    def finish(acc: Column) -> Column:
        last = F.try_element_at(acc["done"], F.lit(-1))
        kept = F.slice(acc["done"], F.lit(1), F.greatest(F.size(acc["done"]) - 1, F.lit(0)))
        return (
            F.when(acc["carry"].isNull(), acc["done"])
            .when(F.size(acc["done"]) == 0, F.array(acc["carry"]))
            .otherwise(append(kept, F.concat(last, F.lit(" "), acc["carry"])))
        )

    return fold_strings(sentences, {"carry": F.lit(None).cast("string")}, step, finish)


def stabilize_punctuation(c: Column) -> Column:
    out = strip(c)
    for mark, pattern, steady in (
        ("!!", r"!{2,}", "!"),
        ("??", r"\?{2,}", "؟"),
        ("..", r"\.{2,}", "."),
        ("——", "—{2,}", "—"),
    ):
        out = replace_if(out, mark, pattern, steady)
    return out


def normalize_chunk(c: Column) -> Column:
    """All rules in order.

    No rule for repeated marks reaches over a space, so the joined sentences
    are steadied at once.  What is left to do then is the space around marks:
    all else was done before, and neither the cuts nor the steadied marks bring
    it back.
    """
    sentences = split_sentences(normalize_punctuation(strip(c)))
    merged = merge_short_fragments(expand_long_sentences(sentences))
    return _space_marks(stabilize_punctuation(F.array_join(merged, " ")))


# --------------------------------------------------------------- continuity --
def end_punctuation(c: Column) -> Column:
    """Class of the last visible character."""

    def classify(last: Column) -> Column:
        out = F.when(last == "", F.lit("none"))
        for name, marks in END_CLASSES:
            out = out.when(F.lit(marks).contains(last), F.lit(name))
        return out.otherwise(F.lit("other"))

    return let(F.right(rstrip(c), F.lit(1)), classify)


def tail_sentences(c: Column, count: int = TAIL_SENTENCES) -> Column:
    def tail(s: Column) -> Column:
        return F.when(F.size(s) == 0, strip(c)).otherwise(
            F.array_join(F.slice(s, F.greatest(F.size(s) - count + 1, F.lit(1)), F.lit(count)), " ")
        )

    return let(split_sentences(c), tail)


def chunk_context(c: Column) -> Column:
    """What the next chunk needs to know about this one."""

    def context(last: Column, tail: Column) -> Column:
        return let(
            end_punctuation(last),
            lambda p: F.struct(
                last.alias("last_sentence_end"),
                p.alias("last_punctuation_type"),
                p.isin("comma", "semicolon").alias("continuity_flag"),
                tail.alias("prior_sentences"),
            ),
        )

    def from_sentences(s: Column) -> Column:
        last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))
        return context(last, tail_sentences(c))

    return F.when(is_blank(c), no_context()).otherwise(let(split_sentences(strip(c)), from_sentences))


def no_context() -> Column:
    return F.struct(
        F.lit("").alias("last_sentence_end"),
        F.lit("none").alias("last_punctuation_type"),
        F.lit(False).alias("continuity_flag"),
        F.lit("").alias("prior_sentences"),
    )


def drop_leading_comma(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"^[،,][{WS}]*", "")


def soften_opening(c: Column, end_class: Column) -> Column:
    """Touch up an opening, given how the previous chunk ended.

    ``end_class`` is null when there is no previous text.
    """

    def first_of(s: Column) -> Column:
        first = F.get(s, F.lit(0))
        connected = F.rlike(first, F.lit(_CONNECTOR))
        # The list of openers is the connectors followed by one plain space.
        opener = F.rlike(first, F.lit(f"^(?:{'|'.join(CONNECTORS)}) "))
        mid_clause = (
            ~opener & (word_count(first) < MAX_CLAUSE_WORDS) & F.rlike(first, F.lit('^[a-z0-9"«(]'))
        )
        bare = strip(F.regexp_replace(first, _CONNECTOR, ""))
        softened = (
            F.when(end_class.isin("comma", "semicolon"),
                   F.when(mid_clause, F.concat(F.lit("و "), first)).otherwise(first))
            .when((end_class == "period") & connected & (word_count(first) < MAX_CONNECTOR_WORDS),
                  F.coalesce(F.nullif(bare, F.lit("")), first))
            .otherwise(first)
        )
        rest = F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))
        return F.array_join(F.concat(F.array(softened), rest), " ")

    touched = let(
        split_sentences(c), lambda s: F.when(F.size(s) == 0, c).otherwise(first_of(s))
    )
    return F.when(end_class.isNull(), c).otherwise(touched)


def conditioning_note(ctx: Column) -> Column:
    closing = F.when(ctx["continuity_flag"], F.lit(MID_THOUGHT_NOTE)).otherwise(
        F.lit(FULL_STOP_NOTE)
    )
    ending = F.concat(
        F.lit("Previous ending ("),
        ctx["last_punctuation_type"],
        F.lit("): «"),
        ctx["prior_sentences"],
        F.lit("»"),
    )
    return F.when(ctx["prior_sentences"] == "", F.lit(OPENING_NOTE)).otherwise(
        F.concat_ws("\n", F.lit(REFERENCE_NOTE), ending, closing)
    )


def adjust_openings(chunks: Column) -> Column:
    """Chunk array with every opening touched up.

    A chunk that is nothing but a comma becomes empty and leaves no context.
    """

    def with_ends(opened: Column, ends: Column) -> Column:
        return F.transform(opened, lambda x, i: soften_opening(x, F.get(ends, i - 1)))

    def opened_by(opened: Column) -> Column:
        ends = F.transform(
            opened, lambda x: F.when(~is_blank(x), end_punctuation(x))
        )
        return let(ends, lambda e: with_ends(opened, e))

    return let(F.transform(chunks, drop_leading_comma), opened_by)


def prepare_chunks(chunks: Column) -> Column:
    """Array of ``struct(transcript_text, conditioning_note, context fields)``.

    The context is that of the previous chunk as adjusted.  A resumed run has
    the same context here, because the whole document is at hand.
    """

    def assemble(adjusted: Column, contexts: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            return let(
                F.coalesce(F.get(contexts, i - 1), no_context()),
                lambda ctx: F.struct(
                    x.alias("transcript_text"),
                    conditioning_note(ctx).alias("conditioning_note"),
                    ctx["last_sentence_end"].alias("last_sentence_end"),
                    ctx["last_punctuation_type"].alias("last_punctuation_type"),
                    ctx["continuity_flag"].alias("continuity_flag"),
                    ctx["prior_sentences"].alias("prior_sentences"),
                ),
            )

        return F.transform(adjusted, row)

    return let(
        adjust_openings(chunks),
        lambda adj: let(F.transform(adj, chunk_context), lambda ctx: assemble(adj, ctx)),
    )


# ------------------------------------------------------------------ prompts --
def scene_block(use_scene: Column, scene: Column, style: Column, tone: Column) -> Column:
    """Scene lines of a prompt; empty unless switched on and something is set."""
    given = {"scene": scene, "style": style, "tone": tone}
    value = {
        k: F.coalesce(F.nullif(v, F.lit("")), F.lit(SCENE_DEFAULTS[k])) for k, v in given.items()
    }
    some = F.coalesce(*[F.nullif(v, F.lit("")) for v in given.values()]).isNotNull()
    block = rstrip(F.concat(
        F.lit(SCENE_TITLE),
        F.lit("\n- Scene: "), value["scene"],
        F.lit("\n- Style: "), value["style"],
        F.lit("\n- Tone: "), value["tone"],
    ))
    return F.when(F.coalesce(use_scene, F.lit(False)) & some, block).otherwise(F.lit(""))


def prompt_text(
    transcript: Column, note: Column, scene: Column, director: str = DIRECTOR_PROMPT
) -> Column:
    """Director text, continuity note, scene lines and transcript."""
    note_part = F.when(
        ~is_blank(note), F.concat(F.lit(f"\n\n{CONTINUITY_TITLE}\n"), strip(note))
    ).otherwise(F.lit(""))
    scene_part = F.when(scene != "", F.concat(F.lit("\n\n"), scene)).otherwise(F.lit(""))
    return F.concat(F.lit(director), note_part, scene_part, F.lit("\n\n"), strip(transcript))
