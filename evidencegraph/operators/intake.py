"""Intake: ordered validation, routing by modality, numbering of tasks, entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import IMAGE_EXTENSIONS, VOICE_EXTENSIONS
from .order import numbered as by_order

MODALITIES = ("text", "voice", "image")


def reason(content: Column, content_is_text: Column, uuid: Column, has_uuid: Column, id_: Column, time_kind: Column, has_content: Column | None = None) -> Column:
    """FIL-1: the first reason against a row, or null.

    `time_kind` is the JSON kind of the timestamp: string, number, boolean, or anything else. `has_uuid` tells whether the key is
    there, even with null.
    """
    there = content.isNotNull() if has_content is None else has_content
    key = F.when(has_uuid, uuid).otherwise(id_)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(~there, "missing key: content")
        .when(~content_is_text | blank(content), "content invalid")
        .when(~has_uuid & id_.isNull(), "missing key: uuid or id")
        .when(blank(key), "uuid invalid")
        .when(~F.coalesce(time_kind, F.lit("")).isin("string", "number", "boolean"), "timestamp invalid type")
    )


def split_valid(rows: DataFrame, why: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and index and reason of the others."""
    return rows.filter(F.col(why).isNull()).drop(why), rows.filter(F.col(why).isNotNull()).select("index", F.col(why).alias("reason"))


def modality_of(type_: Column) -> Column:
    """FIL-2."""
    return F.when(type_.isin("voice", "image"), type_).otherwise("text")


def classified(path: Column, message_type: Column) -> Column:
    """FIL-3: struct modality, confidence, p_text, p_image, p_voice, reason, requires_verification.

    An ending counts wherever it stands in the path.
    """
    low = F.lower(F.coalesce(path, F.lit("")))

    def has(endings: tuple[str, ...]) -> Column:
        found = F.contains(low, F.lit(endings[0]))
        for e in endings[1:]:
            found = found | F.contains(low, F.lit(e))
        return found

    def made(kind: str, confidence: float, text: float, image: float, voice: float, why: str) -> Column:
        values = {"modality": kind, "confidence": confidence, "p_text": text, "p_image": image, "p_voice": voice, "reason": why, "requires_verification": confidence < 0.7}
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    return (
        F.when(has(IMAGE_EXTENSIONS), made("image", 0.9, 0.1, 0.8, 0.1, "File extension indicates image"))
        .when(has(VOICE_EXTENSIONS), made("voice", 0.9, 0.1, 0.1, 0.8, "File extension indicates voice"))
        .when(message_type == "image", made("image", 0.8, 0.2, 0.7, 0.1, "Message metadata indicates image"))
        .when(message_type == "voice", made("voice", 0.8, 0.2, 0.1, 0.7, "Message metadata indicates voice"))
        .otherwise(made("text", 0.7, 0.8, 0.1, 0.1, "Default to text"))
    )


def derived_probabilities(modality: Column, confidence: Column) -> Column:
    """FIL-4: map of modality to probability: 1 - confidence for the winner, a fifth of it for the others."""
    return F.create_map(*[x for m in MODALITIES for x in (F.lit(m), F.when(modality == m, 1 - confidence).otherwise(confidence * 0.2))])


def numbered(entries: DataFrame, modality: str = "modality", order: str = "pos") -> DataFrame:
    """FIL-7: `task_id` from task_0 on, texts first, then voices, then images, each by `order`.

    Numbers are counted in parallel.
    """
    rank = F.when(F.col(modality) == "text", 0).when(F.col(modality) == "voice", 1).otherwise(2)
    rows = by_order(entries.withColumn("_rank", rank), "_rank", order, name="_number")
    return rows.withColumn("task_id", F.concat(F.lit("task_"), F.col("_number").cast("string"))).drop("_rank", "_number")


def messages(rows: DataFrame, *fields: str) -> DataFrame:
    """PRJ-1: the named fields as text, empty where null."""
    return rows.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])


def entries(rows: DataFrame) -> DataFrame:
    """PRJ-2, PRJ-3: one frame of entries of all modalities with struct `entry`."""
    return rows.withColumn("entry", F.struct("uuid", "sender", "receiver", "timestamp", F.when(F.col("modality") == "text", F.col("content")).alias("content"), F.when(F.col("modality") != "text", F.col("file_path")).alias("file_path")))


def serialised(tasks: DataFrame) -> DataFrame:
    """PRJ-4: a JSON object for each task, with at most 100 characters of content."""
    return tasks.select("task_id", F.to_json(F.struct("task_id", "modality", F.substring("content", 1, 100).alias("content"))).alias("json"))


def serialised_results(results: DataFrame) -> DataFrame:
    """PRJ-4: a JSON object for each result."""
    return results.select("task_id", F.to_json(F.struct("task_id", "modality", "success", "confidence", "error"), {"ignoreNullFields": "false"}).alias("json"))


def unwrapped(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FIL-6: results that succeeded, by modality, and those that failed."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.filter(ok), results.filter(~ok)


def first_valid(rows: DataFrame, n: int = 100, why: str = "reason", order: str = "index") -> DataFrame:
    """FIL-11: the first `n` rows without a reason against them."""
    return split_valid(rows, why)[0].orderBy(order).limit(n)


def quality_report(valid: DataFrame, errors: DataFrame, most: int = 200) -> DataFrame:
    """SNK-1: one row: valid_count, error_count, and the first `most` errors as an array."""
    first = errors.orderBy("index").limit(most).agg(F.array_sort(F.collect_list(F.struct("index", "reason"))).alias("errors"))
    counts = valid.agg(F.count("*").alias("valid_count")).join(errors.agg(F.count("*").alias("error_count")))
    return counts.join(first)
