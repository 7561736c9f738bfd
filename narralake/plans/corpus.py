"""Queries of the cleaning, repair and record operators, with their checks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.functions import text as tx
from narralake.functions.rows import explode_once
from narralake.operators import records as rec
from narralake.operators import repair as rp
from narralake.plans import repair_sql as rq
from narralake.plans.views_sql import (
    DIRTY_PAGES,
    DOC_PAGES,
    lit,
    strip,
    with_,
    with_recursive,
)
from narralake.sources import tables as tb
from narralake.sources.sinks import write_by_bucket

KEYS = ["doc_id", "page_number"]


def _on_dirty(fn):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tb.dirty_pages(spark, sf_dir).select(*KEYS, fn(F.col("text")).alias("text"))

    return query


def _on_dirty_repair(fn):
    """Repaired text and number of changes of one repair step."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = tb.dirty_pages(spark, sf_dir).withColumn("r", fn(F.col("text")))
        return pages.select(
            *KEYS,
            F.col("r.text").alias("text"),
            F.size("r.changes").cast("bigint").alias("fix_count"),
        )

    return query


# --------------------------------------------------------------- Spark side --
def scan_pages(spark, sf_dir):
    return tb.doc_pages(spark, sf_dir).select(*KEYS, "text")


def clean_corpus_metrics(spark, sf_dir):
    pages = tb.dirty_pages(spark, sf_dir)
    cleaned = pages.withColumn("clean", tx.clean_text(F.col("text")))
    return cleaned.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum((F.col("clean") != F.col("text")).cast("bigint")).alias("changed"),
        F.sum((F.length("text") - F.length("clean")).cast("bigint")).alias("chars_removed"),
    )


def _pages_some_blank(spark, sf_dir):
    """Documents as page arrays; every 25th has white space only."""
    blank = F.transform(
        F.col("pages"),
        lambda p: F.struct(p["page_number"].alias("page_number"), F.lit(" \n ").alias("text")),
    )
    return (
        tb.documents(spark, sf_dir)
        .select("doc_id", tb.page_array(F.col("text")).alias("pages"))
        .withColumn("pages", F.when(F.col("doc_id") % 25 == 0, blank).otherwise(F.col("pages")))
    )


def drop_empty_docs(spark, sf_dir):
    docs = _pages_some_blank(spark, sf_dir)
    return docs.where(rec.has_text(F.col("pages"))).select(
        "doc_id", F.size("pages").cast("bigint").alias("page_count")
    )


def upload_filter(spark, sf_dir):
    pages = tb.read_table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 4
    suffix = (
        F.when(kind == 0, F.lit(".pdf")).when(kind == 1, F.lit(".PDF")).when(kind == 2, F.lit(".txt"))
        .otherwise(F.lit(".pdf"))
    )
    files = pages.select(
        "page_id",
        F.concat(F.lit("file-"), F.col("page_id").cast("string"), suffix).alias("name"),
        (F.length("html").cast("bigint") * (F.col("page_id") % 5) * 10000).alias("size"),
    )
    return rec.upload_filter(files)


def persian_ratio(spark, sf_dir):
    return tb.dirty_pages(spark, sf_dir).select(
        *KEYS,
        tx.letter_count(F.col("text")).cast("bigint").alias("letters"),
        tx.persian_count(F.col("text")).cast("bigint").alias("persian"),
        tx.is_persian_heavy(F.col("text")).alias("persian_heavy"),
    )


def _digits(fn):
    def query(spark, sf_dir):
        return tb.dirty_pages(spark, sf_dir).select(*KEYS, fn(F.col("text")).alias("text"))

    return query


def repaired_pages(spark, sf_dir):
    """Repaired pages with their change lists."""
    return rp.repair_corpus(tb.dirty_pages(spark, sf_dir))


def repair_corpus(spark, sf_dir):
    return repaired_pages(spark, sf_dir).select(*KEYS, "text", "fix_count")


def repair_change_log(spark, sf_dir):
    """Every change of every repair step, in order."""
    return rp.change_log(repaired_pages(spark, sf_dir), *KEYS)


def glyph_table_repair(spark, sf_dir):
    """The glyph step by a table of replacements that has a map for each language."""
    pairs = [F.struct(F.lit(k).alias("bad"), F.lit(v).alias("good")) for k, v in rp.GLYPH_REPLACEMENTS.items()]
    langs = tb.documents(spark, sf_dir).select("lang").distinct()
    glyphs = langs.select("lang", F.posexplode(F.array(*pairs)).alias("position", "g")).select("lang", "position", "g.*")
    fixed = rp.repair_glyphs(tb.dirty_pages(spark, sf_dir), glyphs, "lang")
    return fixed.select(
        *KEYS, F.col("repair.text").alias("text"), F.size("repair.changes").cast("bigint").alias("fix_count")
    )


def repair_change_counts(spark, sf_dir):
    log = rp.change_log(repaired_pages(spark, sf_dir), *KEYS)
    return log.groupBy("kind").agg(F.count(F.lit(1)).alias("changes"))


def repair_audit(spark, sf_dir):
    """Before, after and readable diff of all repair steps, per page."""
    fixed = tb.dirty_pages(spark, sf_dir).withColumn("r", rp.repair_text(F.col("text")))
    return fixed.select(
        *KEYS,
        F.col("text").alias("before_text"),
        F.col("r.text").alias("after_text"),
        rp.diff_text(F.col("r.changes")).alias("diff"),
    )


def fix_counts(spark, sf_dir):
    """Fixes of a document by kind."""
    return rp.fix_counts(repaired_pages(spark, sf_dir), "doc_id")


def _doc_records(spark, sf_dir):
    pages = rec.clean_pages(tb.dirty_page_array(F.col("text"), F.col("doc_id")))
    return (
        tb.documents(spark, sf_dir)
        .select(F.col("doc_id").alias("intake_id"), pages.alias("pages"))
        .withColumn("full_text", rec.full_text(F.col("pages")))
        .withColumn("page_count", F.size("pages").cast("bigint"))
    )


def assemble_full_text(spark, sf_dir):
    return _doc_records(spark, sf_dir).select("intake_id", "page_count", "full_text")


def intake_records(spark, sf_dir):
    docs = tb.documents(spark, sf_dir).select(
        F.col("doc_id").alias("intake_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        tb.dirty_page_array(F.col("text"), F.col("doc_id")).alias("pages"),
    )
    return rec.intake_records(docs).drop("pages", "repair_diff")


def write_records(spark, sf_dir):
    """Records with nested pages stored as JSON by bucket and read back."""
    folder = os.path.join(tb.scratch_dir(spark, "records"), "table")
    write_by_bucket(_doc_records(spark, sf_dir), "intake_id", folder, "json")
    schema = (
        "intake_id long, pages array<struct<page_number:int,text:string>>, full_text string, "
        "page_count long"
    )
    stored = spark.read.schema(schema).json(folder)
    return stored.select(
        "intake_id", "page_count", "full_text", F.size("pages").cast("bigint").alias("pages")
    )


def split_pages(spark, sf_dir):
    """Pages out of full texts; every tenth text has no markers."""
    records = _doc_records(spark, sf_dir).withColumn(
        "full_text",
        F.when(F.col("intake_id") % 10 == 0, F.lit("plain")).otherwise(F.col("full_text")),
    )
    pages = rec.split_pages(F.col("full_text"), F.col("page_count"))
    return explode_once(records, pages, "p", "pos", "intake_id").select(
        "intake_id", F.col("p.page_number").alias("page_number"), F.col("p.text").alias("text")
    )


def edit_text(spark, sf_dir):
    records = _doc_records(spark, sf_dir).withColumn(
        "preview_text", F.substring("full_text", 1, rec.PREVIEW_CHARS)
    )
    edits = tb.documents(spark, sf_dir).where(F.col("doc_id") % 3 == 0).select(
        F.col("doc_id").alias("intake_id"), F.concat(F.lit("EDITED "), "text").alias("new_text")
    )
    out = rec.apply_edits(records, edits)
    return out.select(
        "intake_id",
        "page_count",
        "full_text",
        "preview_text",
        F.size("pages").cast("bigint").alias("pages"),
        F.get("pages", F.lit(0))["text"].alias("first_page"),
    )


def strip_page_markers(spark, sf_dir):
    from narralake.functions.chunking import strip_page_markers as strip_markers

    return _doc_records(spark, sf_dir).select(
        "intake_id", strip_markers(F.col("full_text")).alias("text")
    )


def delete_intake(spark, sf_dir):
    records = tb.documents(spark, sf_dir).select(
        F.col("doc_id").alias("intake_id"), "lang", "source"
    )
    gone = tb.read_table(spark, sf_dir, "labels").where("toxic = 1").select(
        F.col("doc_id").alias("intake_id")
    )
    return rec.delete_records(records, gone)


def doc_size_profile(spark, sf_dir):
    pages = tb.dirty_pages(spark, sf_dir)
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum(F.length("text").cast("bigint")).alias("chars"),
        F.max(F.length("text").cast("bigint")).alias("longest_page"),
    )


QUERIES = {
    "scan_pages": scan_pages,
    "normalize_newlines": _on_dirty(tx.normalize_newlines),
    "strip_invisible": _on_dirty(tx.strip_invisible),
    "dehyphenate": _on_dirty(tx.dehyphenate),
    "unwrap_lines": _on_dirty(tx.unwrap_lines),
    "collapse_spaces": _on_dirty(tx.collapse_spaces),
    "collapse_blank_lines": _on_dirty(tx.collapse_blank_lines),
    "clean_corpus": _on_dirty(tx.clean_text),
    "clean_corpus_metrics": clean_corpus_metrics,
    "drop_empty_docs": drop_empty_docs,
    "upload_filter": upload_filter,
    "glyph_repair": _on_dirty_repair(rp.glyph_repair),
    "glyph_table_repair": glyph_table_repair,
    "join_broken_words": _on_dirty_repair(rp.join_broken_words),
    "persian_ratio": persian_ratio,
    "join_paragraph_lines": _on_dirty_repair(rp.join_paragraph_lines),
    "year_join_lines": _on_dirty_repair(rp.year_join_lines),
    "year_after_context": _on_dirty_repair(rp.year_after_context),
    "year_inline_join": _on_dirty_repair(rp.year_inline_join),
    "year_reverse_fix": _on_dirty_repair(rp.year_reverse_fix),
    "digits_to_western": _digits(tx.digits_to_western),
    "digits_to_persian": _digits(tx.digits_to_persian),
    "repair_corpus": repair_corpus,
    "repair_change_log": repair_change_log,
    "repair_change_counts": repair_change_counts,
    "repair_audit": repair_audit,
    "fix_counts": fix_counts,
    "assemble_full_text": assemble_full_text,
    "intake_records": intake_records,
    "write_records": write_records,
    "split_pages": split_pages,
    "edit_text": edit_text,
    "strip_page_markers": strip_page_markers,
    "delete_intake": delete_intake,
    "doc_size_profile": doc_size_profile,
}

# ----------------------------------------------------------------- SQL side --
_VIEWS = with_(DOC_PAGES, DIRTY_PAGES)
_NEWLINES = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_INVISIBLE = r"regexp_replace({0}, '[\x{{200C}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}\x{{FEFF}}]', '', 'g')"
_DEHYPHEN = r"regexp_replace({0}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
_SPACES = r"regexp_replace({0}, '[ \t\r\f\v]+', ' ', 'g')"
_BLANKS = r"regexp_replace({0}, '\n\n\n+', chr(10) || chr(10), 'g')"
_ENDS = "contains('.!?؟۔:])»\"''', right({0}, 1))"
_BULLET = "contains('-•*#', left({0}, 1))"


def _unwrap(expr: str) -> str:
    lines = f"list_transform(string_split({expr}, chr(10)), lambda z: {strip('z')})"
    sep = (
        "CASE WHEN i = 1 THEN '' "
        f"WHEN x = '' OR ls[i - 1] = '' OR {_ENDS.format('ls[i - 1]')} OR {_BULLET.format('x')} "
        "THEN chr(10) ELSE ' ' END"
    )
    return (
        f"(SELECT CASE WHEN len(ls) <= 1 THEN {expr} ELSE array_to_string(list_transform(ls, "
        f"lambda x, i: {sep} || x), '') END FROM (SELECT {lines} AS ls))"
    )


def _page_sql(expr: str) -> str:
    return _VIEWS + f"SELECT doc_id, page_number, {expr} AS text FROM dirty_pages"


CLEAN_STEPS = f"""
  c1 AS (SELECT * EXCLUDE text, {_DEHYPHEN.format(_INVISIBLE.format(_NEWLINES.format('text')))} AS text
         FROM {{src}}),
  c2 AS (SELECT *, list_transform(string_split(text, chr(10)), lambda z: {strip('z')}) AS ls FROM c1),
  c3 AS (SELECT * EXCLUDE (text, ls), CASE WHEN len(ls) <= 1 THEN text ELSE array_to_string(
           list_transform(ls, lambda x, i: CASE WHEN i = 1 THEN '' WHEN x = '' OR ls[i - 1] = ''
             OR {_ENDS.format('ls[i - 1]')} OR {_BULLET.format('x')} THEN chr(10) ELSE ' ' END || x),
           '') END AS text FROM c2),
  clean AS (SELECT * EXCLUDE text, {strip(_BLANKS.format(_SPACES.format('text')))} AS text FROM c3)"""


def clean_from(src: str) -> str:
    return CLEAN_STEPS.replace("{src}", src)


_RVIEWS = with_recursive(DOC_PAGES, DIRTY_PAGES, rq.start("d", "dirty_pages")).rstrip() + ","


def _stage(stage) -> str:
    return _RVIEWS + stage("r", "d") + f"""
SELECT doc_id, page_number, text, CAST({rq.FIX_COUNT} AS BIGINT) AS fix_count FROM r"""


_FULL = with_recursive(DOC_PAGES, DIRTY_PAGES).rstrip() + "," + clean_from("dirty_pages") + """,
full_docs AS (SELECT doc_id AS intake_id, count(*) AS page_count,
  coalesce(string_agg('--- Page ' || page_number || ' ---' || chr(10) || text, chr(10) || chr(10)
    ORDER BY page_number) FILTER (text <> ''), '') AS full_text
  FROM clean GROUP BY doc_id)"""

_BODY = "'--- Page ' || page_number || ' ---' || chr(10) || text"
_MARK = r"(?m)^--- Page \d+ ---[ \t\n\r\f\v]*$"

ORACLES = {
    "scan_pages": with_(DOC_PAGES) + "SELECT doc_id, page_number, text FROM doc_pages",
    "normalize_newlines": _page_sql(_NEWLINES.format("text")),
    "strip_invisible": _page_sql(_INVISIBLE.format("text")),
    "dehyphenate": _page_sql(_DEHYPHEN.format("text")),
    "unwrap_lines": _page_sql(_unwrap("text")),
    "collapse_spaces": _page_sql(_SPACES.format("text")),
    "collapse_blank_lines": _page_sql(_BLANKS.format("text")),
    "clean_corpus": _VIEWS.rstrip() + "," + clean_from("dirty_pages")
    + "\nSELECT doc_id, page_number, text FROM clean",
    "clean_corpus_metrics": _VIEWS.rstrip() + "," + clean_from(
        "(SELECT *, text AS raw FROM dirty_pages)"
    ) + """
SELECT lang, source, count(*) AS pages, CAST(count(*) FILTER (raw <> text) AS BIGINT) AS changed,
       CAST(sum(length(raw) - length(text)) AS BIGINT) AS chars_removed
FROM clean GROUP BY lang, source""",
    "drop_empty_docs": with_(DOC_PAGES) + f"""
SELECT doc_id, count(*) AS page_count FROM (
  SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN ' ' || chr(10) || ' ' ELSE text END AS text FROM doc_pages)
GROUP BY doc_id HAVING bool_or({strip('text')} <> '')""",
    "upload_filter": """
SELECT *, CASE WHEN lower(name) NOT LIKE '%.pdf' THEN 'not a pdf' WHEN size = 0 THEN 'empty'
               WHEN size > 52428800 THEN 'too large' END AS reject_reason
FROM (SELECT page_id,
        'file-' || page_id || CASE page_id % 4 WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE '.pdf' END AS name,
        CAST(length(html) * (page_id % 5) * 10000 AS BIGINT) AS size FROM pages)""",
    "glyph_repair": _stage(rq.glyphs),
    "glyph_table_repair": _stage(rq.glyphs),
    "join_broken_words": _stage(rq.broken_words),
    "join_paragraph_lines": _stage(rq.paragraph_lines),
    "year_join_lines": _stage(rq.year_join_lines),
    "year_after_context": _stage(rq.year_after_context),
    "year_inline_join": _stage(rq.year_inline_join),
    "year_reverse_fix": _stage(rq.year_reverse_fix),
    "repair_corpus": with_recursive(DOC_PAGES, DIRTY_PAGES, rq.repair("r", "dirty_pages")) + f"""
SELECT doc_id, page_number, text, CAST({rq.FIX_COUNT} AS BIGINT) AS fix_count FROM r""",
    "repair_change_counts": with_recursive(DOC_PAGES, DIRTY_PAGES, rq.repair("r", "dirty_pages")) + """
SELECT kind, CAST(n AS BIGINT) AS changes FROM (
  SELECT 'REPLACED' AS kind, sum(replaced) AS n FROM r
  UNION ALL SELECT 'YEAR_FIX', sum(years) FROM r
  UNION ALL SELECT 'JOINED_LINE', sum(joined_lines) FROM r
  UNION ALL SELECT 'JOINED_PARAGRAPH', sum(joined_paragraphs) FROM r) WHERE n > 0""",
    "intake_records": _FULL.replace("full_docs AS", "full_clean AS") + "," + rq.repair("r", "clean") + f"""
SELECT doc_id AS intake_id, 'doc-' || doc_id || '.pdf' AS filename, count(*) AS page_count,
  coalesce(string_agg({_BODY}, chr(10) || chr(10) ORDER BY page_number) FILTER (text <> ''), '') AS full_text,
  left(coalesce(string_agg({_BODY}, chr(10) || chr(10) ORDER BY page_number) FILTER (text <> ''), ''), 12000) AS preview_text,
  sum({rq.FIX_COUNT}) > 0 AS repair_applied, CAST(sum({rq.FIX_COUNT}) AS BIGINT) AS repair_fix_count
FROM r GROUP BY doc_id""",
    "persian_ratio": _VIEWS + f"""SELECT doc_id, page_number,
  CAST({rq.LETTERS.format('text')} AS BIGINT) AS letters,
  CAST({rq.PERSIAN.format('text')} AS BIGINT) AS persian,
  {rq.heavy('text')} AS persian_heavy FROM dirty_pages""",
    "digits_to_western": _page_sql(rq.TO_WEST.format("text")),
    "digits_to_persian": _page_sql(rq.TO_PERSIAN.format("text")),
    "repair_change_log": with_recursive(DOC_PAGES, DIRTY_PAGES, rq.repair("r", "dirty_pages")) + """
SELECT doc_id, page_number, CAST(i AS BIGINT) AS seq, log[i].kind AS kind, log[i].before AS before,
  log[i].after AS after
FROM (SELECT *, unnest(range(1, len(log) + 1)) AS i FROM r)""",
    "repair_audit": with_recursive(DOC_PAGES, DIRTY_PAGES, rq.repair("r", "dirty_pages")) + """
SELECT doc_id, page_number, d.text AS before_text, r.text AS after_text,
  CASE WHEN len(log) = 0 THEN '(no changes applied)' ELSE array_to_string(list_transform(log, lambda c:
    '[' || c.kind || ']' || chr(10) || c.before || chr(10) || '→ ' || c.after), chr(10) || chr(10)) END AS diff
FROM r JOIN dirty_pages d USING (doc_id, page_number)""",
    "fix_counts": with_recursive(DOC_PAGES, DIRTY_PAGES, rq.repair("r", "dirty_pages")) + f"""
SELECT doc_id, CAST(sum({rq.FIX_COUNT}) AS BIGINT) AS fixes, sum({rq.FIX_COUNT}) > 0 AS repair_applied,
  CAST(sum(replaced) AS BIGINT) AS replaced, CAST(sum(years) AS BIGINT) AS year_fix,
  CAST(sum(joined_lines) AS BIGINT) AS joined_line,
  CAST(sum(joined_paragraphs) AS BIGINT) AS joined_paragraph
FROM r GROUP BY doc_id""",
    "assemble_full_text": _FULL + "\nSELECT intake_id, page_count, full_text FROM full_docs",
    "write_records": _FULL
    + "\nSELECT intake_id, page_count, full_text, page_count AS pages FROM full_docs",
    "split_pages": _FULL + rf""",
src AS (SELECT intake_id, page_count, CASE WHEN intake_id % 10 = 0 THEN 'plain' ELSE full_text END AS t
        FROM full_docs),
parts AS (SELECT *, regexp_extract_all(t, '(?m)^--- Page (\d+) ---[ \t\n\r\f\v]*$', 1) AS nums,
                 regexp_split_to_array(t, '{_MARK}') AS bodies FROM src)
SELECT intake_id, CAST(nums[i] AS INTEGER) AS page_number, {strip('bodies[i + 1]')} AS text
FROM (SELECT *, unnest(range(1, len(nums) + 1)) AS i FROM parts)
UNION ALL
SELECT intake_id, CAST(p AS INTEGER) AS page_number, t AS text
FROM (SELECT *, unnest(range(1, page_count + 1)) AS p FROM parts WHERE len(nums) = 0)""",
    "edit_text": _FULL + rf""",
firsts AS (SELECT doc_id, text FROM clean WHERE page_number = 1),
edits AS (SELECT doc_id, t AS new_text, len(regexp_extract_all(t, '{_MARK}')) AS marks,
    regexp_split_to_array(t, '{_MARK}') AS bodies
  FROM (SELECT doc_id, 'EDITED ' || text AS t FROM documents WHERE doc_id % 3 = 0))
SELECT f.intake_id, page_count, coalesce(new_text, full_text) AS full_text,
       left(coalesce(new_text, full_text), 12000) AS preview_text,
       CASE WHEN marks > 0 THEN marks ELSE page_count END AS pages,
       CASE WHEN marks > 0 THEN {strip('bodies[2]')} ELSE coalesce(new_text, p.text) END AS first_page
FROM full_docs f LEFT JOIN edits e ON e.doc_id = f.intake_id
JOIN firsts p ON p.doc_id = f.intake_id""",
    "strip_page_markers": _FULL + rf"""
SELECT intake_id, regexp_replace(full_text, '(?m)^--- Page \d+ ---[ \t\n\r\f\v]*\n?', '', 'g') AS text
FROM full_docs""",
    "delete_intake": """SELECT doc_id AS intake_id, lang, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""",
    "doc_size_profile": _VIEWS + """SELECT doc_id, count(*) AS page_count,
  CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS BIGINT) AS longest_page
FROM dirty_pages GROUP BY doc_id""",
}
