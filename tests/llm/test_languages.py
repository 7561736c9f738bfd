"""Operator 2: runs of three letters of whole texts, however they are cut, and clashing columns."""

import random

import numpy as np
import pytest

from narralake.llm import languages
from narralake.llm.common import ship


def plain(text):
    """Runs of three over words with one space around each, as the code points of a string."""
    letters = "".join(c if languages._letters()[ord(c)] else " " for c in text.lower())
    spaced = " " + "".join(w + " " for w in letters.split(" ") if w)
    return [spaced[i : i + 3] for i in range(len(spaced) - 2)]


def unpacked(keys):
    return ["".join(chr(int(k) >> s & 0x1FFFFF) for s in (42, 21, 0)) for k in keys]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 20])
def test_runs_do_not_depend_on_the_cuts(monkeypatch, chunk):
    monkeypatch.setattr(languages, "CHUNK", chunk)
    r = random.Random(chunk)
    for _ in range(300):
        text = "".join(r.choice("abxyzÉß 1.-\n中") for _ in range(r.randrange(30)))
        found = [g for part in languages.trigrams(text) for g in unpacked(part)]
        assert found == plain(text), text


def test_a_word_across_the_cut_stays_whole():
    text = "a" * (languages.CHUNK - 2) + "xqzv" + " tail"
    found = set(unpacked(np.unique(np.concatenate(list(languages.trigrams(text))))))
    assert {"axq", "xqz", "qzv", "zv "} <= found and "xq " not in found and " qz" not in found


def test_columns_with_clashing_names_stay(spark):
    ship(spark)
    rows = [(i, "the cat sat on the mat", "en", "x") for i in range(20)] + [(i, "der hund und die katze", "de", "y") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _found string")
    out = languages.identify(docs, languages.train(docs))
    assert {(r.lang, r._found, r.lang_pred) for r in out.collect()} == {("en", "x", "en"), ("de", "y", "de")}
