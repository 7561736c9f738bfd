"""Random document tables that stress the text rules."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

from narralake.operators.repair import GLYPH_REPLACEMENTS

PERSIAN = "کتاب انقلاب سال دموکر اتيک ما در آغاز متوجه نبودیم و اما که البته چون رفت خانه ۀ ی".split()
LATIN = "the of House-keeping naïve a be 3rd x_y end alpha beta gamma delta epsilon".split()
DIGITS = "1979 ۱۹۷۹ ٩٧٩١ 9791 1 ۱ ٩ ۷۹ 979 ۹۷۹ 12 1234567 ٠٨٩١ 19۸9 2100 0912".split()
MARKS = [".", "!", "?", "؟", "؛", "۔", ":", "…", ";", "،", ",", "..", "!!", "??", '."', ".)", "»", "-", "—— ", "……"]
BULLETS = ["- ", "• ", "* ", "# ", "--- Page 3 ---"]
GLYPHS = list(GLYPH_REPLACEMENTS)
ODD = ["‌", "﻿", "‏", "�", "(", "["]


def _word(rng: random.Random, wild: bool) -> str:
    kind = rng.random()
    if kind < 0.40:
        word = rng.choice(PERSIAN)
    elif kind < 0.75:
        word = rng.choice(LATIN)
    elif kind < 0.88:
        word = rng.choice(DIGITS)
    elif kind < 0.92:
        word = rng.choice(GLYPHS)
    elif wild and kind < 0.95:
        word = rng.choice(ODD) + rng.choice(PERSIAN)
    else:
        word = rng.choice(BULLETS).strip()
    if rng.random() < 0.22:
        word += rng.choice(MARKS).strip()
    return word


def _gap(rng: random.Random, wild: bool, breaks: float) -> str:
    if rng.random() < breaks:
        tame = ["\n", "\n", "\n", "\n\n"]
        odd = ["\r\n", "\r", "\n \n", "\n\n\n", " \n", "\n\t", "-\n", " ،", " ,"]
        return rng.choice(tame + odd if wild else tame)
    if wild and rng.random() < 0.06:
        return rng.choice(["  ", "\t", " \t ", " ;", "   "])
    return " "


def random_text(rng: random.Random, wild: bool, size: int) -> str:
    breaks = rng.choice([0.0, 0.02, 0.1, 0.4])
    marks = rng.random() < 0.85
    out = []
    for _ in range(size):
        word = _word(rng, wild)
        out.append(word if marks else word.rstrip(".!?؟؛۔:…;،,"))
        out.append(_gap(rng, wild, breaks))
    return "".join(out)


def write_documents(folder: str, seed: int, count: int, wild: bool) -> str:
    rng = random.Random(seed)
    texts = ["", "   ", "\n\n", ",", "x", "--- Page 4 ---\n\nbody."]
    while len(texts) < count:
        size = rng.choice([1, 2, 3, 5, 10, 40, 120, 400, 1500])
        texts.append(random_text(rng, wild, size))
    if not wild:
        texts = [" ".join(t.split(" ")).strip(" ") for t in texts]
    table = pa.table(
        {
            "doc_id": pa.array(range(len(texts)), pa.int64()),
            "text": texts,
            "lang": [("en", "fa")[i % 2] for i in range(len(texts))],
            "source": [f"src{i % 5}" for i in range(len(texts))],
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }
    )
    os.makedirs(folder, exist_ok=True)
    pq.write_table(table, os.path.join(folder, "documents.parquet"))
    return folder
