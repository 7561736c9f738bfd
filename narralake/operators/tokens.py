"""Upkeep of the token list: reading, masking, merging and checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralake.functions.text import strip
from narralake.operators.ordered import with_row_number

# --- fixed values -------------------------------------------------------------
BULLET = "•"
PLACEHOLDER_TAIL = "****"
TRUE_WORDS = ("1", "true", "yes")
DEFAULT_NAME = "token"
FALLBACK_NAME = "env"
# -----------------------------------------------------------------------------


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def read_tokens(raw: DataFrame) -> DataFrame:
    """Lenient read of ``position, name, id, api_key, key, enabled``."""
    key = strip(F.coalesce(_given(F.col("api_key")), _given(F.col("key")), F.lit("")))
    name = strip(F.coalesce(_given(F.col("name")), _given(F.col("id")), F.lit(DEFAULT_NAME)))
    return raw.select(
        F.col("position").cast("bigint").alias("position"),
        name.alias("name"),
        key.alias("api_key"),
        F.coalesce(F.lower("enabled").isin(*TRUE_WORDS), F.lit(True)).alias("enabled"),
    ).where(F.col("api_key") != "")


def mask_secret(c: Column) -> Column:
    key = strip(F.coalesce(c, F.lit("")))
    return (
        F.when(key == "", F.lit(""))
        .when(F.length(key) <= 8, F.concat(F.substring(key, 1, 3), F.lit(BULLET * 6)))
        .otherwise(F.concat(F.substring(key, 1, 4), F.lit(BULLET * 8), F.right(key, F.lit(4))))
    )


def is_masked(c: Column) -> Column:
    return F.contains(c, F.lit(BULLET)) | F.endswith(c, F.lit(PLACEHOLDER_TAIL))


def upsert_keep_secret(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows replace the list; a masked key keeps the stored one."""
    stored = existing.groupBy("name").agg(F.max_by("api_key", "position").alias("_stored"))
    key = strip(F.col("api_key"))
    return incoming.join(stored, "name", "left").select(
        "position",
        "name",
        F.when(is_masked(key), F.coalesce("_stored", key)).otherwise(key).alias("api_key"),
        "enabled",
    )


def name_rejects(batch: DataFrame) -> DataFrame:
    """Names that make a batch unacceptable, with the reason."""
    name = strip(F.coalesce("name", F.lit("")))
    return (
        batch.groupBy(name.alias("name"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .where((F.col("name") == "") | (F.col("rows") > 1))
        .select(
            "name",
            "rows",
            F.when(F.col("name") == "", F.lit("blank")).otherwise(F.lit("duplicate")).alias("reason"),
        )
    )


def enabled_tokens(tokens: DataFrame, fallback_key: str = "") -> DataFrame:
    """Enabled rows; if there are none, the configured fallback."""
    enabled = tokens.where("enabled").select("position", "name", "api_key")
    spare = fallback_key.strip()
    none_left = enabled.agg(F.count(F.lit(1)).alias("n")).where(
        (F.col("n") == 0) & (F.lit(spare) != "")
    )
    fallback = none_left.select(
        F.lit(1).cast("bigint").alias("position"),
        F.lit(FALLBACK_NAME).alias("name"),
        F.lit(spare).alias("api_key"),
    )
    return enabled.unionByName(fallback)


def public_tokens(tokens: DataFrame) -> DataFrame:
    """Masked list with 1-based priority in list order."""
    ranked = with_row_number(tokens, [], "position", "priority")
    return ranked.select(
        F.col("priority").cast("bigint").alias("priority"),
        "name",
        mask_secret(F.col("api_key")).alias("api_key_masked"),
        "enabled",
    )


def idle_board(tokens: DataFrame) -> DataFrame:
    """Board shown while nothing runs: enabled tokens, all idle."""
    ranked = with_row_number(tokens.where("enabled"), [], "position", "priority")
    return ranked.select(
        F.col("priority").cast("bigint").alias("priority"), "name", F.lit("idle").alias("status")
    )


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
