"""Literal cases of chunking and narration preparation."""

import os

from pyspark.sql import functions as F

from narralake.functions import chunking as ck
from narralake.functions import narration as nr
from narralake.operators import chunks as ch
from narralake.plans import chunks as plans
from narralake.sources.sinks import write_by_bucket


def _chunks(value, text, **kw):
    return value(lambda c: ck.chunk_text(c, **kw), text)[0]


def test_markers_and_empty(value):
    assert _chunks(value, "--- Page 4 ---\n\nمتن صفحه.") == ["متن صفحه."]
    assert _chunks(value, "") == [] and _chunks(value, " \n ") == []


def test_lines_flow_together(value):
    got = _chunks(value, "خط اول از پاراگراف\nخط دوم همان پاراگراف\nخط سوم همان پاراگراف.")
    assert got == ["خط اول از پاراگراف خط دوم همان پاراگراف خط سوم همان پاراگراف."]


def test_small_paragraphs_merge(value):
    assert len(_chunks(value, "یک جمله کوتاه.\n\nجمله دیگر.")) == 1


def test_caps(value):
    long = "جمله دوم. " * 400 + "\n\n" + "جمله سوم. " * 400
    small, large = _chunks(value, long, cap=600), _chunks(value, long, cap=1300)
    assert len(small) >= len(large)
    assert max(map(len, small)) <= 600 and max(map(len, large)) <= 1300
    assert len(_chunks(value, "بخش. " * 500, soft_max=800)) > 1


def test_text_without_marks_is_cut_at_spaces(value):
    body = ("کلمه " * 1400) + "پایان."
    got = _chunks(value, body)
    assert all(len(c) <= ck.HARD_MAX for c in got)
    assert " ".join(got).split() == body.split()
    assert [len(c) for c in value(lambda c: ck.hard_split(c, 10), "x" * 25)[0]] == [10, 10, 5]
    assert value(lambda c: ck.hard_split(c, 10), "aaaa bbbbbb cc")[0] == ["aaaa bbbbb", "b cc"]
    assert value(lambda c: ck.hard_split(c, 10), "aaaaaaa bbbbbb cc")[0] == ["aaaaaaa", "bbbbbb cc"]


def test_small_middle_merges(value):
    got = _chunks(value, "جمله اول کامل. " * 25 + "\n\nکوتاه.\n\n" + "جمله سوم کامل. " * 25)
    assert all(len(c) >= ck.SMALL_CHUNK for c in got[:-1])


def test_clamp(value):
    got = value(lambda c: ck.clamp_cap(F.when(c != "", c.cast("int"))), "", "1000", "500", "2000")
    assert got == [1300, 1000, 600, 1300]
    assert [ck.resolve_cap(v) for v in (None, 1000, 500, 2000)] == [1300, 1000, 600, 1300]


def test_incomplete_ending_pulls(spark):
    df = spark.range(1).select(
        ck.fix_incomplete_endings(
            F.array(F.lit("open part"), F.lit("goes on. Next one."), F.lit("End."))
        ).alias("c")
    )
    assert df.first()["c"] == ["open part goes on.", "Next one.", "End."]


def test_small_goes_into_next(spark):
    long = "x" * 290
    df = spark.range(1).select(
        ck.merge_validation_small(F.array(F.lit("ab"), F.lit(long), F.lit("cd")), 300, 295).alias("c")
    )
    assert df.first()["c"] == ["ab " + long, "cd"]


def test_preview_warnings(spark):
    rows = spark.createDataFrame(
        [(1, 1, "x" * 150, 150), (1, 2, "y" * 1400, 1400), (1, 3, "z" * 400, 400)],
        "doc_id bigint, chunk_idx bigint, text string, char_count bigint",
    )
    got = ch.chunk_preview(rows).orderBy("index").collect()
    assert [r["warning"] for r in got] == ["Too small", "Too large", None]
    assert got[1]["preview"] == "y" * 300 + "…"


def test_chunk_invariants_on_corpus(spark, small):
    docs = plans._docs(spark, small)
    chunks = ch.chunk_documents(docs)
    squash = F.regexp_replace("text", r"\s+", "")
    whole = docs.select("doc_id", squash.alias("want"))
    glued = chunks.groupBy("doc_id").agg(
        F.expr("listagg(text, '') WITHIN GROUP (ORDER BY chunk_idx)").alias("text"),
        F.max("chunk_idx").alias("last"),
        F.count(F.lit(1)).alias("n"),
    ).select("doc_id", squash.alias("got"), "last", "n")
    assert whole.join(glued, "doc_id").where("want <> got OR last <> n").count() == 0
    oversized = chunks.where((F.col("char_count") > 1300) & F.col("text").rlike(r"[.!?;:…]\s+\S.*[.!?;:…]\s"))
    assert chunks.where("char_count > 2800").count() == 0
    assert oversized.count() == 0


def test_stats_of_empty_document(spark):
    docs = spark.createDataFrame([(1, ""), (2, "یک. دو.")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ch.document_stats(docs).collect()}
    assert (got[1]["total_chunks"], got[1]["avg_chunk_length"]) == (0, 0.0)
    assert (got[2]["total_chunks"], got[2]["count_small_chunks"]) == (1, 1)


def test_written_chunks_have_no_file_per_chunk(spark, small, tmp_path):
    folder = str(tmp_path / "t")
    chunks = ch.chunk_documents(plans._docs(spark, small))
    write_by_bucket(chunks, "doc_id", folder)
    files = sum(len([f for f in fs if f.endswith(".parquet")]) for _, _, fs in os.walk(folder))
    assert spark.read.parquet(folder).count() == chunks.count() > files


# ---------------------------------------------------------------- narration --
def test_normalize_chunk(value):
    fifty = " ".join(["کلمه"] * 50) + "."
    got = value(
        nr.normalize_chunk,
        "جمله اول..  جمله   دوم.",
        "متن اول ، متن دوم.",
        "بله. خیر. این یک جملهٔ کامل است که ادامه دارد.",
        fifty,
        "",
        "   ",
        "1,000 wait!! what??",
    )
    assert got[0] == "جمله اول. جمله دوم."
    assert got[1] == "متن اول، متن دوم."
    assert got[2].startswith("بله. خیر. این")
    assert len(got[3].split()) == 50
    assert got[4] == got[5] == ""
    assert got[6] == "1, 000 wait! what؟"


def test_long_sentence_breaks_at_comma(value):
    words = [f"w{i}" for i in range(60)]
    words[29] += "،"
    got = value(nr.break_long_sentence, " ".join(words))[0]
    assert [len(p.split()) for p in got] == [30, 30]
    plain = value(nr.break_long_sentence, " ".join(f"w{i}" for i in range(85)))[0]
    assert [len(p.split()) for p in plain] == [40, 40, 5]


def test_end_classes(value):
    got = value(nr.end_punctuation, "ادامه،", "a, ", "b?", "c!", "d;", "e…", "f", " ")
    assert got == ["comma", "comma", "question", "exclamation", "semicolon", "period", "other", "none"]


def test_tail(value):
    assert value(nr.tail_sentences, "اول. دوم. سوم. چهارم.", "تنها", "") == ["سوم. چهارم.", "تنها", ""]


def _prepared(spark, *chunks):
    arr = F.array(*[F.lit(c) for c in chunks])
    return spark.range(1).select(nr.prepare_chunks(arr).alias("p")).first()["p"]


def test_continuity(spark):
    a, b, c, d = _prepared(spark, "Start here,", "go on.", "و then it ends", "، last")
    assert a["conditioning_note"] == nr.OPENING_NOTE and a["prior_sentences"] == ""
    assert b["transcript_text"] == "و go on." and b["continuity_flag"]
    assert nr.MID_THOUGHT_NOTE in b["conditioning_note"] and "«Start here,»" in b["conditioning_note"]
    assert c["transcript_text"] == "then it ends" and c["last_punctuation_type"] == "period"
    assert c["prior_sentences"] == "و go on."
    assert d["transcript_text"] == "last" and d["last_punctuation_type"] == "other"


def test_lone_comma_resets_context(spark):
    got = _prepared(spark, "One.", ",", "و two.")
    assert got[1]["transcript_text"] == ""
    assert got[2]["transcript_text"] == "و two." and got[2]["conditioning_note"] == nr.OPENING_NOTE


def test_scene_and_prompt(spark):
    def block(*args):
        return spark.range(1).select(nr.scene_block(*[F.lit(a) for a in args]).alias("b")).first()["b"]

    assert block(False, "x", "documentary", "calm") == ""
    assert block(True, None, "", None) == ""
    assert block(True, None, "warm", None) == (
        f"{nr.SCENE_TITLE}\n- Scene: default narration environment\n- Style: warm\n- Tone: consistent narration"
    )
    prompt = spark.range(1).select(
        nr.prompt_text(F.lit(" متن "), F.lit("keep pace"), F.lit("## Scene")).alias("p")
    ).first()["p"]
    assert prompt.startswith(nr.DIRECTOR_PROMPT) and prompt.endswith("\n\n## Scene\n\nمتن")
    assert f"\n\n{nr.CONTINUITY_TITLE}\nkeep pace" in prompt
    bare = spark.range(1).select(nr.prompt_text(F.lit("x"), F.lit(""), F.lit("")).alias("p")).first()["p"]
    assert bare == nr.DIRECTOR_PROMPT + "\n\nx"
