"""Document records: assembling, splitting, editing, filtering and auditing.

A document and its pages are one row (``pages`` is an array), so building the
full text of a document needs no grouping and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralake.functions.text import (
    INVISIBLE,
    WS,
    clean_text,
    digits_to_western,
    is_blank,
    let,
    strip,
)
from narralake.operators.repair import diff_text, repair_text

# --- fixed values -------------------------------------------------------------
PREVIEW_CHARS = 12_000
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
UPLOAD_SUFFIX = ".pdf"
# -----------------------------------------------------------------------------

PAGE_MARKER = rf"(?<![^\n])--- Page (\p{{Nd}}+) ---[{WS}]*(?![^\n])"


def full_text(pages: Column) -> Column:
    """Non-blank pages in order, each under its marker line."""

    def block(p: Column) -> Column:
        return F.concat(
            F.lit("--- Page "), p["page_number"].cast("string"), F.lit(" ---\n"), strip(p["text"])
        )

    filled = F.filter(F.array_sort(pages), lambda p: ~is_blank(p["text"]))
    return F.array_join(F.transform(filled, block), "\n\n")


def split_pages(text: Column, page_count: Column) -> Column:
    """Pages of a full text; without markers every page gets the whole text."""

    def by_marker(parts: Column) -> Column:
        numbers = F.regexp_extract_all(text, F.lit(PAGE_MARKER), F.lit(1))
        return F.transform(
            numbers,
            lambda n, i: F.struct(
                digits_to_western(n).cast("int").alias("page_number"),
                strip(F.get(parts, i + 1)).alias("text"),
            ),
        )

    everywhere = F.when(
        page_count >= 1,
        F.transform(
            F.sequence(F.lit(1), page_count.cast("int")),
            lambda n: F.struct(n.alias("page_number"), text.alias("text")),
        ),
    ).otherwise(F.array().cast("array<struct<page_number:int,text:string>>"))
    return F.when(
        F.rlike(text, F.lit(PAGE_MARKER)), let(F.split(text, PAGE_MARKER, -1), by_marker)
    ).otherwise(everywhere)


def clean_pages(pages: Column) -> Column:
    return F.transform(
        pages,
        lambda p: F.struct(
            p["page_number"].alias("page_number"), clean_text(p["text"]).alias("text")
        ),
    )


def has_text(pages: Column) -> Column:
    """Some page has text after cleaning.

    Cleaning takes out white space and invisible marks only, so the raw pages
    tell, and the filter can run before the cleaning does.
    """
    return F.exists(pages, lambda p: F.rlike(p["text"], F.lit(f"[^{WS}{INVISIBLE}]")))


def intake_records(docs: DataFrame) -> DataFrame:
    """Clean, reject empty, repair and assemble.

    ``docs``: intake_id, filename, pages.  One map-only pass; a document is
    rejected when no page has text after cleaning.
    """
    cleaned = docs.where(has_text(F.col("pages"))).withColumn(
        "pages", clean_pages(F.col("pages"))
    )
    repaired = F.transform(
        F.col("pages"),
        lambda p: F.struct(
            p["page_number"].alias("page_number"), repair_text(p["text"]).alias("r")
        ),
    )
    rebuilt = F.transform(
        F.col("_fixed"),
        lambda p: F.struct(p["page_number"].alias("page_number"), p["r"]["text"].alias("text")),
    )
    changes = F.flatten(F.transform(F.col("_fixed"), lambda p: p["r"]["changes"]))
    return (
        cleaned.withColumn("_fixed", repaired)
        .withColumn("changes", changes)
        .withColumn("pages", rebuilt)
        .withColumn("full_text", full_text(F.col("pages")))
        .select(
            "intake_id",
            "filename",
            F.size("pages").cast("bigint").alias("page_count"),
            "pages",
            "full_text",
            F.substring("full_text", 1, PREVIEW_CHARS).alias("preview_text"),
            (F.size("changes") > 0).alias("repair_applied"),
            F.size("changes").cast("bigint").alias("repair_fix_count"),
            diff_text(F.col("changes")).alias("repair_diff"),
        )
    )


def apply_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace edited texts with their preview and pages; keep other fields.

    ``edits``: intake_id, new_text (one row per intake).
    """
    joined = records.join(edits, "intake_id", "left")
    edited = F.col("new_text").isNotNull()
    return (
        joined.withColumn(
            "pages",
            F.when(edited, split_pages(F.col("new_text"), F.col("page_count"))).otherwise(
                F.col("pages")
            ),
        )
        .withColumn("full_text", F.coalesce("new_text", "full_text"))
        .withColumn("preview_text", F.substring("full_text", 1, PREVIEW_CHARS))
        .drop("new_text")
    )


def delete_records(records: DataFrame, deletions: DataFrame) -> DataFrame:
    return records.join(deletions, "intake_id", "left_anti")


def reject_reason(name: Column, size: Column) -> Column:
    """Why a file is not taken in; null if it is."""
    return (
        F.when(
            ~F.endswith(F.lower(F.coalesce(name, F.lit(""))), F.lit(UPLOAD_SUFFIX)),
            F.lit("not a pdf"),
        )
        .when(size <= 0, F.lit("empty"))
        .when(size > MAX_UPLOAD_BYTES, F.lit("too large"))
    )


def upload_filter(files: DataFrame) -> DataFrame:
    return files.withColumn("reject_reason", reject_reason(F.col("name"), F.col("size")))
