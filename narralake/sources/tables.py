"""Reading the given tables and the working views derived from them."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.functions.rows import explode_once
from narralake.functions.text import let
from narralake.operators.ordered import with_row_number
from narralake.operators.repair import GLYPH_REPLACEMENTS

LINES_PER_PAGE = 10
LINES_PER_PARAGRAPH = 5
TOKEN_NAMES = ("tok1", "tok2", "tok3", "tok4")
SAMPLE_RATES = (200, 300)

# Text appended to the page of a document, by doc_id modulo their number, so
# that every cleaning and repair rule has something to do.
INJECTED = (
    "رژيم " + " و ".join(GLYPH_REPLACEMENTS) + " اس)می بود.",
    "انقلاب ٩٧٩١ میلادی و 2024 و 12345.",
    "در سال ۱۹۷۹ بود.",
    "سال ۱ ۹۷۹ رسید.",
    "در سال\n٩٧٩١\n\nبا پیروزی.",
    "انتخاب دموکر\nاتيک\nبود\n\nپاراگراف بعدی.",
    "می\u200cخواهم و \u200fگفت\ufeff ، پس؛او رفت .",
    "خط یک\r\nخط دو\rپایان.",
    "first\n\n\n\nsecond.",
    "a  b\t\tc   d , e ;f  .",
    "The ab-\ncd and ef-\ngh.. So!! What?? End……",
    "list:\n- item one\n• item two\n* item three\n# head",
    "broken \ufffd char \ufffd.\n.\n1\n22\n(x)",
    "ما در آغاز\nمتوجه نبودیم\nو رفتیم",
    "۱۹\n۷۹\n\nصفحه ١١ و ١٢۳۴ قیمت 1234567",
    "",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for written tables and checkpoints, in ``spark.checkpoint.dir``.

    A session without that setting gets a folder set for all its tables.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = tempfile.mkdtemp(prefix="narralake-")
        spark.conf.set("spark.checkpoint.dir", shared)
    run = spark.sparkContext.applicationId
    return f"{shared.rstrip('/')}/{label}-{run}-{os.urandom(6).hex()}"


# ------------------------------------------------------------------- texts ---
def page_array(text: Column) -> Column:
    """Text to ``array<struct<page_number, text>>``, ten lines to a page."""

    def pages(lines: Column) -> Column:
        count = F.ceil(F.size(lines) / LINES_PER_PAGE).cast("int")
        return F.transform(
            F.sequence(F.lit(1), count),
            lambda p: F.struct(
                p.alias("page_number"),
                F.array_join(
                    F.slice(lines, (p - 1) * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n"
                ).alias("text"),
            ),
        )

    return let(F.split(text, "\n", -1), pages)


def explode_pages(docs: DataFrame, pages: Column, *keep: str) -> DataFrame:
    return explode_once(docs, pages, "_p", "_pos", *keep).select(
        *keep, F.col("_p.page_number").alias("page_number"), F.col("_p.text").alias("text")
    )


#: Session setting: documents are dealt out over so many tasks after the scan.
READ_PARTITIONS = "spark.narralake.read.partitions"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, dealt out evenly if the session asks for it.

    A file of one row group is one task's work however large it is.  A session
    that reads such files names the number of tasks in READ_PARTITIONS, and it
    is followed whatever the input; without the setting there is no exchange.
    """
    docs = read_table(spark, sf_dir, "documents")
    asked = spark.conf.get(READ_PARTITIONS, None)
    return docs.repartition(int(asked)) if asked else docs


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return explode_pages(docs, page_array(F.col("text")), "doc_id", "lang", "source")


def paragraphed(text: Column) -> Column:
    """A blank line after every fifth line."""

    def blocks(lines: Column) -> Column:
        last = F.floor((F.size(lines) - 1) / LINES_PER_PARAGRAPH).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda g: F.array_join(
                F.slice(lines, g * LINES_PER_PARAGRAPH + 1, F.lit(LINES_PER_PARAGRAPH)), "\n"
            ),
        )

    return F.array_join(let(F.split(text, "\n", -1), blocks), "\n\n")


def injected(doc_id: Column) -> Column:
    texts = F.array(*[F.lit(t) for t in INJECTED])
    return F.get(texts, (doc_id % len(INJECTED)).cast("int"))


def dirty(text: Column, doc_id: Column) -> Column:
    extra = injected(doc_id)
    return F.when(extra == "", text).otherwise(F.concat(text, F.lit("\n"), extra))


def dirty_page_array(text: Column, doc_id: Column) -> Column:
    return F.transform(
        page_array(text),
        lambda p: F.struct(
            p["page_number"].alias("page_number"), dirty(p["text"], doc_id).alias("text")
        ),
    )


def dirty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = doc_pages(spark, sf_dir)
    return pages.withColumn("text", dirty(F.col("text"), F.col("doc_id")))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four extraction methods to a page."""
    order = (F.col("doc_id") % 4).cast("bigint")
    return documents(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 4).cast("bigint").alias("page_id"),
        F.concat(F.lit("m"), order.cast("string")).alias("method"),
        order.alias("method_order"),
        "lang",
        "source",
        dirty(F.col("text"), F.col("doc_id")).alias("text"),
        F.when(F.col("doc_id") % 97 == 0, F.lit("cannot open")).alias("error"),
    )


def scene_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene fields per document; nulls, blanks and switched-off ones included."""
    kind = F.col("doc_id") % 5
    return documents(spark, sf_dir).select(
        "doc_id",
        "text",
        (kind != 4).alias("use_scene"),
        F.when(kind == 0, F.col("source")).when(kind == 1, F.lit("")).when(
            kind == 4, F.lit("studio")
        ).alias("scene"),
        F.when(kind <= 1, F.col("lang")).alias("style"),
        F.when(kind == 2, F.lit("calm")).when(kind == 3, F.lit("")).alias("tone"),
    )


# ------------------------------------------------------------------ events ---
def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _by_type(names: dict[str, str]) -> Column:
    out = None
    for event_type, status in names.items():
        test = F.col("event_type") == event_type
        out = F.when(test, F.lit(status)) if out is None else out.when(test, F.lit(status))
    return out


ATTEMPT_STATUS = {
    "click": "calling",
    "view": "success",
    "error": "quota_failed",
    "purchase": "switched",
    "signup": "waiting",
}
INTAKE_STATUS = {
    "click": "generating",
    "view": "completed",
    "error": "failed",
    "purchase": "merging",
    "signup": "waiting_quota",
}


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


# Now and then a run begins anew, is synced or ends; by event_id modulo RARE.
RARE = 97
RARE_STATUS = ("begin", "synced", "ended")


def attempts_from(events: DataFrame, *keep: str) -> DataFrame:
    """Log rows; a switch says from which token to which, and why."""
    seq = F.col("event_id")
    status = _by_type(ATTEMPT_STATUS)
    for i, name in enumerate(RARE_STATUS):
        status = F.when(seq % RARE == i, F.lit(name)).otherwise(status)
    rows = events.select(
        *keep,
        (F.col("user_id") % 20).alias("run_id"),
        seq.alias("seq"),
        F.concat(F.lit("tok"), (_k() % 4 + 1).cast("string")).alias("token"),
        _k().alias("chunk_id"),
        status.alias("status"),
        epoch_seconds(F.col("ts")).alias("epoch"),
    )
    switched = F.col("status") == "switched"
    other = F.concat(
        F.lit("tok"), ((F.col("chunk_id") % 4 + 1 + F.col("seq") % 3) % 4 + 1).cast("string")
    )
    reason = F.when(F.col("seq") % 2 == 0, F.lit("429_quota")).otherwise(F.lit("manual"))
    return rows.withColumns(
        {
            "from_token": F.when(switched, other),
            "to_token": F.when(switched, F.col("token")),
            "reason": F.when(switched, reason),
        }
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_from(read_table(spark, sf_dir, "events"))


def status_log_from(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("intake_id"),
        F.col("event_id").alias("seq"),
        _by_type(INTAKE_STATUS).alias("status"),
        _k().alias("current"),
        F.lit(100).cast("bigint").alias("total"),
        epoch_seconds(F.col("ts")).alias("epoch"),
    )


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_log_from(read_table(spark, sf_dir, "events"))


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("series_id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
        .cast("bigint")
        .alias("chunk_idx"),
        "event_id",
        F.round(F.col("value") * 40).cast("int").alias("s"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = with_row_number(
        raw_samples(spark, sf_dir), ["series_id", "chunk_idx"], "event_id", "_pos", "n_samples"
    )
    return numbered.select(
        "series_id",
        "chunk_idx",
        (F.col("_pos") - 1).alias("sample_idx"),
        "s",
        "n_samples",
        F.get(F.array(*[F.lit(r) for r in SAMPLE_RATES]), (F.col("series_id") % len(SAMPLE_RATES)).cast("int")).alias("rate"),
    )


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing of finished chunks, some with odd names or no bytes."""
    done = attempts(spark, sf_dir).where(F.col("status") == "success")
    folder = F.when(
        F.col("run_id") % 5 == 0, F.concat(F.lit("/audio/it's-"), F.col("run_id").cast("string"))
    ).otherwise(F.concat(F.lit("/audio/"), F.col("run_id").cast("string")))
    plain = F.col("chunk_id").cast("string")
    name = (
        F.when(F.col("seq") % 13 == 0, F.concat(plain, F.lit(".wav")))
        .when(F.col("seq") % 17 == 0, F.concat(F.lpad(plain, 4, "0"), F.lit(".WAV")))
        .when(F.col("seq") % 19 == 0, F.lit("x.wav"))
        .otherwise(F.concat(F.lpad(plain, 4, "0"), F.lit(".wav")))
    )
    size = F.when(F.col("seq") % 11 == 0, F.lit(0)).otherwise(F.col("seq") % 100000 + 1)
    return (
        done.select(
            "run_id",
            "seq",
            F.concat(folder, F.lit("/"), name).alias("path"),
            size.cast("bigint").alias("size"),
        )
        .groupBy("run_id", "path")
        .agg(F.max_by("size", "seq").alias("size"))
        .select(F.col("run_id").alias("intake_id"), "path", "size")
    )


def output_files(spark: SparkSession, sf_dir: str, root: str = "/outputs") -> DataFrame:
    """Listing of finished output files, one of three places per intake."""
    intake = F.col("user_id").cast("string")
    place = F.col("user_id") % 4
    path = (
        F.when(place == 0, F.concat(F.lit(f"{root}/custom-"), intake, F.lit(".wav")))
        .when(place == 1, F.concat(F.lit(f"{root}/"), intake, F.lit("/final_audiobook.wav")))
        .when(place == 2, F.concat(F.lit(f"{root}/"), intake, F.lit("_final_audiobook.wav")))
    )
    return (
        read_table(spark, sf_dir, "events")
        .select(path.alias("path"))
        .where(F.col("path").isNotNull())
        .distinct()
    )


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = attempts(spark, sf_dir).where(F.col("status") == "quota_failed")
    kind = F.col("chunk_id") % 7
    message = (
        F.when(kind == 0, F.lit("429 Too Many Requests"))
        .when(kind == 1, F.lit("Resource_Exhausted: try later"))
        .when(kind == 2, F.lit("quota used up"))
        .when(kind == 3, F.lit("API_KEY_INVALID for project"))
        .when(kind == 4, F.lit("401 unauthenticated"))
        .when(kind == 5, F.lit(""))
        .otherwise(F.concat(F.lit("connection reset "), F.repeat(F.lit("by peer "), 30)))
    )
    return failed.select("run_id", "seq", message.alias("message"))


# ------------------------------------------------------------------ tokens ---
def raw_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token list with the aliases, blanks and odd flags a config file has."""
    n = F.col("s_suppkey")
    key = F.when(
        n % 7 == 0, F.lit("  ")
    ).when(n % 5 == 0, F.concat(F.lit("k"), n.cast("string"))).otherwise(
        F.concat(F.lit("key-"), n.cast("string"), F.lit("-"), F.col("s_name"))
    )
    return read_table(spark, sf_dir, "supplier").select(
        n.alias("position"),
        F.when(n % 3 == 0, F.concat(F.col("s_name"), F.lit(" "))).alias("name"),
        F.when(n % 3 == 1, F.col("s_name")).alias("id"),
        F.when(n % 3 == 0, key).when(n % 3 == 2, F.lit("")).alias("api_key"),
        F.when(n % 3 != 0, key).alias("key"),
        F.when(n % 4 == 0, F.lit("true")).when(n % 4 == 1, F.lit("no")).when(
            n % 4 == 3, F.lit("YES")
        ).alias("enabled"),
    )


def edited_tokens(tokens: DataFrame, mask) -> DataFrame:
    """The list as a form sends it back: every second key masked, some renamed."""
    return tokens.select(
        "position",
        F.when(F.col("position") % 6 == 0, F.concat(F.col("name"), F.lit("-new")))
        .otherwise(F.col("name"))
        .alias("name"),
        F.when(F.col("position") % 2 == 0, mask(F.col("api_key")))
        .otherwise(F.concat(F.lit("new-"), F.col("api_key")))
        .alias("api_key"),
        "enabled",
    )
