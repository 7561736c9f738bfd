"""Attempt records as logged, from JSON text of any shape to typed columns.

A record is parsed once into a VARIANT.  Known leaf fields become typed
columns; keys that nobody knows are kept by their path, values of the wrong
type are named, and text that is no JSON object is kept as it is, so that a
log of mixed versions loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The leaf fields of a record by their path, and the type of each.
LEAVES = {
    "intake_id": ("$.intake_id", "string"),
    "chunk_index": ("$.chunk_index", "bigint"),
    "request_chunk_index": ("$.request.chunk_index", "bigint"),
    "prompt": ("$.request.prompt", "string"),
    "prompt_char_count": ("$.request.prompt_char_count", "bigint"),
    "model": ("$.request.config.model", "string"),
    "temperature": ("$.request.config.temperature", "double"),
    "voice_name": ("$.request.config.voice_name", "string"),
    "response_modalities": ("$.request.config.response_modalities", "array<string>"),
    "speech_mode": ("$.request.config.speech_mode", "string"),
    "continuity_note": ("$.request.continuity_note", "string"),
    "scene_context": ("$.request.scene_context", "string"),
    "transcript": ("$.request.transcript", "string"),
    "transcript_char_count": ("$.request.transcript_char_count", "bigint"),
    "token_name": ("$.request.token_name", "string"),
    "attempt": ("$.request.attempt", "bigint"),
    "success": ("$.response.success", "boolean"),
    "error": ("$.response.error", "string"),
    "wav_path": ("$.response.wav_path", "string"),
    "wav_size_bytes": ("$.response.wav_size_bytes", "bigint"),
    "mime_type": ("$.response.mime_type", "string"),
    "audio_bytes": ("$.response.audio_bytes", "bigint"),
    "timestamp": ("$.response.timestamp", "double"),
}
BRANCHES = ("$", "$.request", "$.request.config", "$.response")


def _inner_keys(branch: str) -> list[str]:
    paths = [p for p, _ in LEAVES.values()] + list(BRANCHES[1:])
    return sorted(p[len(branch) + 1 :] for p in paths if p.rpartition(".")[0] == branch)


def _shape(branch: str = "$") -> str:
    """The type of a record with every leaf field as it came, a VARIANT."""
    kinds = ((key, f"{branch}.{key}") for key in _inner_keys(branch))
    fields = (f"`{key}`: {_shape(path) if path in BRANCHES else 'variant'}" for key, path in kinds)
    return f"struct<{', '.join(fields)}>"


def _unknown(record: Column) -> Column:
    """Path to JSON text of every value under a known object that is no known field."""
    nothing = F.create_map().cast("map<string,string>")
    found = []
    for branch in BRANCHES:
        known = F.array(*(F.lit(k) for k in _inner_keys(branch)))
        # A walk for the keys alone: no value is copied or cast, as none has such a field.
        keys = F.map_keys(F.try_variant_get(record, branch, "map<string,struct<`\n`: variant>>"))
        values = F.try_variant_get(record, branch, "map<string,variant>")
        other = F.map_filter(values, lambda k, _: ~F.array_contains(known, k))  # noqa: B023
        named = F.transform_keys(other, lambda k, _: F.concat(F.lit(f"{branch}."), k))  # noqa: B023
        texts = F.transform_values(named, lambda _, v: F.to_json(v))
        found.append(F.when(F.size(F.array_except(keys, known)) > 0, texts).otherwise(nothing))
    return F.map_concat(*found)


def parse_records(log: DataFrame, text: str = "record") -> DataFrame:
    """log with the leaf fields, `unknown`, `mistyped` and `corrupt` in place of its text.

    ``unknown``: path to JSON text of keys that are no known field.
    ``mistyped``: names of fields whose value is not of their type; the field
    is null then.  ``corrupt``: the text itself where it is no JSON object
    (then all else is null or empty); a null text is neither.

    The leaves are taken out of a record in one walk.  They come out of an
    explode of one row, because a filter on a field would otherwise move below
    the parser and parse each record again.
    """
    rest = [c for c in log.columns if c != text and c not in LEAVES]
    parsed = log.withColumn("_parsed", F.try_parse_json(text))
    leaves = F.try_variant_get(F.col("_parsed"), "$", _shape())
    rows = parsed.select(*rest, F.col(text).alias("_text"), "_parsed", F.explode_outer(F.array(leaves)).alias("_leaves"))
    values = {name: F.col(f"_leaves.{path[2:]}") for name, (path, _) in LEAVES.items()}
    typed = {name: F.try_variant_get(values[name], "$", kind) for name, (_, kind) in LEAVES.items()}
    wrong = [
        F.when(values[n].isNotNull() & ~F.is_variant_null(values[n]) & typed[n].isNull(), F.lit(n)) for n in LEAVES
    ]
    record = F.when(F.col("_leaves").isNotNull(), F.col("_parsed"))
    return rows.select(
        *rest,
        *(column.alias(name) for name, column in typed.items()),
        _unknown(record).alias("unknown"),
        F.array_compact(F.array(*wrong)).alias("mistyped"),
        F.when(F.col("_leaves").isNull(), F.col("_text")).alias("corrupt"),
    )


def keyed(records: DataFrame) -> DataFrame:
    """Records that name their intake and chunk; others are not kept by any view."""
    return records.where((F.col("intake_id") != "") & F.col("chunk_index").isNotNull())


def record_health(records: DataFrame, *by: str) -> DataFrame:
    """How many records there are, are broken, lack a key, have unknown keys or mistyped fields."""
    broken = F.col("corrupt").isNotNull()
    has_key = F.coalesce((F.col("intake_id") != "") & F.col("chunk_index").isNotNull(), F.lit(False))
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(broken).alias("broken"),
        F.count_if(~broken & ~has_key).alias("without_key"),
        F.count_if(F.size("unknown") > 0).alias("with_unknown"),
        F.count_if(F.size("mistyped") > 0).alias("with_mistyped"),
    )
