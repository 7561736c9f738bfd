"""Literal cases of cleaning, repair, records and quality flags."""

from pyspark.sql import functions as F

from narralake.functions import text as tx
from narralake.operators import profile as pf
from narralake.operators import records as rec
from narralake.operators import repair as rp


def test_clean_text(value):
    got = value(
        tx.clean_text,
        "سلام   دنیا",
        "پاراگراف اول.\n\nپاراگراف دوم.",
        "این یک جمله است که\nدر دو خط شکسته",
        "a\n\n\n\nb",
        "ab-\ncd \r\n x\r- y\nz.\nq",
        "می\u200cخواهم\ufeff",
        None,
        "\u2003x\u3000",
    )
    assert got == [
        "سلام دنیا",
        "پاراگراف اول.\n\nپاراگراف دوم.",
        "این یک جمله است که در دو خط شکسته",
        "a\n\nb",
        "abcd x\n- y z.\nq",
        "میخواهم",
        "",
        "x",
    ]


def test_word_helpers(value):
    assert value(tx.word_count, "", "  ", "a", " a\tb\u2003c ", "x\x1cy") == [0, 0, 1, 3, 2]
    assert value(tx.words, " a\n b ", "") == [["a", "b"], []]


def test_sentences(value):
    assert value(tx.split_sentences, "A b. c! d? e", "no end", "a.b. c", "؟ x", "") == [
        ["A b.", "c!", "d?", "e"],
        ["no end"],
        ["a.b.", "c"],
        ["؟", "x"],
        [],
    ]
    assert value(tx.ends_sentence, 'a."', "a.) ", "a", "a. b", "x؟") == [True, True, False, False, True]


def _fixed(value, fn, *texts):
    return [(r["text"], [tuple(c) for c in r["changes"]]) for r in value(fn, *texts)]


def test_glyph_repair_counts(value):
    got = _fixed(value, rp.repair_text, "رژيم اس)می در نخستين سال اس)می", "رھبری روح 0 خمينی برايران")
    assert got[0] == (
        "رژيم اسلامی در نخستين سال اسلامی",
        [("REPLACED", "اس)می", "اسلامی (×2)")],
    )
    assert "روح الله خمینی" in got[1][0]


def test_custom_glyph_map(value):
    got = _fixed(value, lambda c: rp.glyph_repair(c, {"xx": "y"}), "axxb")
    assert got == [("ayb", [("REPLACED", "xx", "y")])]


def test_year_repairs(value):
    texts = {
        "انقلاب ٩٧٩١ میلادی": "انقلاب ۱۹۷۹ میلادی",
        "ژوئيه ٠٨٩١": "ژوئيه ۱۹۸۰",
        "سال ٦٨٩١": "سال ۱۹۸۶",
        "سال ٩٨٩١": "سال ۱۹۸۹",
        "در 19۸9": "در ۱۹۸۹",
        "صفحه ١١ و ١٢۳۴": "صفحه ١١ و ١٢۳۴",
        "نرخ 25 درصد": "نرخ 25 درصد",
        "قیمت 1234567": "قیمت 1234567",
        "در سال ۱۹۷۹": "در سال ۱۹۷۹",
        "۱ ۹۷۹": "۱۹۷۹",
        "۱۹\n۷۹": "۱۹۷۹",
        "سال\n٩٧٩١\nو": "سال ۱۹۷۹\nو",
    }
    got = _fixed(value, rp.repair_years, *texts)
    assert [g[0] for g in got] == list(texts.values())
    assert got[8][1] == []
    assert got[0][1] == [("YEAR_FIX", "٩٧٩١", "۱۹۷۹")]


def test_line_repairs(value):
    got = _fixed(
        value,
        rp.repair_text,
        "انتخاب دموکر\nاتيک\n\nپاراگراف بعدی.",
        "ما در آغاز\nمتوجه نبودیم\n\nفصل بعد.",
        "Hello world.\n\nThis is a test paragraph.",
        "  ",
    )
    assert got[0][0] == "انتخاب دموکراتيک\n\nپاراگراف بعدی."
    assert got[0][1][0][0] == "JOINED_LINE"
    assert got[1][0] == "ما در آغاز متوجه نبودیم\n\nفصل بعد."
    assert got[1][1][0][0] == "JOINED_PARAGRAPH"
    assert got[2] == ("Hello world.\n\nThis is a test paragraph.", [])
    assert got[3] == ("  ", [])


def test_joined_pairs_do_not_chain(value):
    got = _fixed(value, rp.join_broken_words, "کتاب\nخانه\nرفت\nبود")
    assert got[0][0] == "کتابخانه\nرفتبود"
    assert len(got[0][1]) == 2


def test_diff_text(value):
    got = value(lambda c: rp.diff_text(rp.repair_years(c)["changes"]), "سال ٩٧٩١", "x")
    assert got == ["[YEAR_FIX]\n٩٧٩١\n→ ۱۹۷۹", "(no changes applied)"]


def test_full_text_round_trip(spark):
    pages = "array<struct<page_number:int,text:string>>"
    row = spark.sql(f"SELECT CAST(array(struct(1, ' a '), struct(2, ' '), struct(3, 'c')) AS {pages}) AS p")
    full = row.select(rec.full_text(F.col("p")).alias("t"))
    assert full.first()["t"] == "--- Page 1 ---\na\n\n--- Page 3 ---\nc"
    pages = full.select(rec.split_pages(F.col("t"), F.lit(3)).alias("p")).first()["p"]
    assert [tuple(p) for p in pages] == [(1, "a"), (3, "c")]
    same = spark.range(1).select(rec.split_pages(F.lit("plain"), F.lit(2)).alias("p")).first()["p"]
    assert [tuple(p) for p in same] == [(1, "plain"), (2, "plain")]


def test_intake_rejects_empty(spark):
    docs = spark.sql(
        "SELECT 1L AS intake_id, 'a.pdf' AS filename, array(struct(1 AS page_number, ' \u200c\n' AS text)) AS pages "
        "UNION ALL SELECT 2L, 'b.pdf', array(struct(1, ''), struct(2, 'سال ٩٧٩١'))"
    )
    got = rec.intake_records(docs).collect()
    assert len(got) == 1
    assert (got[0]["intake_id"], got[0]["page_count"], got[0]["repair_fix_count"]) == (2, 2, 1)
    assert got[0]["full_text"] == "--- Page 2 ---\nسال ۱۹۷۹"


def test_edit_and_delete(spark):
    records = spark.sql(
        "SELECT 1L AS intake_id, 2L AS page_count, 'old' AS full_text, 'old' AS preview_text, "
        "array(struct(1 AS page_number, 'old' AS text)) AS pages UNION ALL "
        "SELECT 2L, 1L, 'keep', 'keep', array(struct(1, 'keep'))"
    )
    edits = spark.sql("SELECT 1L AS intake_id, 'new text' AS new_text")
    out = {r["intake_id"]: r for r in rec.apply_edits(records, edits).collect()}
    assert out[1]["full_text"] == "new text" and len(out[1]["pages"]) == 2
    assert out[2]["full_text"] == "keep" and len(out[2]["pages"]) == 1
    left = rec.delete_records(records, spark.sql("SELECT 1L AS intake_id UNION ALL SELECT 9L"))
    assert [r["intake_id"] for r in left.collect()] == [2]


def test_upload_reasons(spark):
    files = spark.createDataFrame(
        [("a.pdf", 1), ("b.PDF", 52428800), ("c.txt", 5), ("d.pdf", 0), ("e.pdf", 52428801)],
        "name string, size bigint",
    )
    got = {r["name"]: r["reject_reason"] for r in rec.upload_filter(files).collect()}
    assert got == {"a.pdf": None, "b.PDF": None, "c.txt": "not a pdf", "d.pdf": "empty", "e.pdf": "too large"}


def test_quality_flags(value):
    broken = ".متن یک\n.متن دو\nسه اس)می اس)می \ufffd"
    got = value(pf.quality_profile, "", broken, "متن کامل فارسی برای آزمایش است." * 3, "1\n2\nab\n" * 3)
    assert got[0]["flags"] == ["EMPTY_TEXT"] and got[0]["quality_warning"] == "POSSIBLE_BROKEN_TEXT"
    assert {"LIKELY_REVERSED_RTL", "GLYPH_SUBSTITUTION_ARTIFACTS", "REPLACEMENT_CHARACTERS"} <= set(got[1]["flags"])
    assert got[2]["quality_warning"] == "OK" and got[2]["persian_detected"]
    assert {"ISOLATED_PUNCTUATION", "DIGIT_FRAGMENTATION", "SHORT_TOKEN_RATIO_HIGH"} <= set(got[3]["flags"])


def test_method_score_and_rank(spark):
    rows = spark.createDataFrame(
        [(1, "a", 0, "متن کامل فارسی برای آزمایش است." * 30, None), (1, "b", 1, "", None), (1, "c", 2, "", "boom")],
        "page_id bigint, method string, method_order bigint, text string, error string",
    )
    got = {r["method"]: (r["score"], r["rank"]) for r in pf.rank_methods(pf.score_extractions(rows)).collect()}
    assert got["c"] == (10000, 3)
    assert got["b"] == (100 + 5 + 50, 2)
    assert got["a"][1] == 1 and got["a"][0] < 0


def test_has_words_counts_as_word_count_does_and_stops_early(value):
    texts = ["", " \n", "a", " a ", "a b", "a\u00a0b ", "\u3000سلام دنیا\n", "a، b…\u2009c", "x" * 50, "\U0001f600 é"]
    for least in (1, 2, 3):
        assert value(lambda c: tx.has_words(c, least), *texts) == [n >= least for n in value(tx.word_count, *texts)]  # noqa: B023


def test_lone_spaces_are_not_rewritten(value):
    pattern = value(lambda c: F.lit(str(tx.collapse_spaces(c))), "")[0]
    assert "(?! [!-~])" in pattern
    assert value(tx.collapse_spaces, " a b  c\t d \n e\u00a0f \u200a") == [" a b c d \n e f "]
