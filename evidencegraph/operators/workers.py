"""Workers for texts, voices and images, the classification that routes tasks to them, and what they report.

Each worker is a DataFrame function over its own tasks; the provider is called in Arrow batches on the executors, and an
error stays with its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import prompts
from ..functions import scalars as S
from .intake import classified
from .metrics import majority
from .providers import Offline, Provider, asked, called, text_results

Make = Callable[[], Provider]
#: Of a transcript's quality, from which it is used.
USABLE = 0.7


def voice_results(rows: DataFrame, key: str, path: str, make: Make = Offline) -> DataFrame:
    """UDF-3, UDF-6: transcript, quality and usability of each recording."""
    out = called(rows, key, path, "", make, method="transcribe")
    text = F.coalesce("reply", F.lit(""))
    out = out.withColumn("q", S.voice_quality(text))
    return out.select(key, text.alias("transcript"), "q.*", F.col("q.quality_score").alias("confidence"), (F.col("q.quality_score") >= USABLE).alias("usable"), "error")


def image_results(rows: DataFrame, key: str, path: str, make: Make = Offline, questions: list[str] | None = None) -> DataFrame:
    """UDF-2, UDF-8, AGG-6: the category by the votes of several questions; text is read only of images with drugs; FN-24 of both."""
    replies = asked(rows, key, path, questions or prompts("image"), make, method="look")
    votes = replies.withColumn("label", S.drug_related(F.coalesce("reply", F.lit("")), F.col("reply").isNull())["category"])
    chosen = majority(votes, key, "label", "n").select(key, F.col("label").alias("category"), "confidence")
    failed = replies.groupBy(key).agg(F.min("error").alias("error"))
    related = chosen.filter("category = 'drug_related'").join(rows.select(key, path), key)
    read = called(related, key, path, prompts("image_text")[0], make, method="look").select(key, F.col("reply").alias("ocr_text"))
    out = chosen.join(failed, key).join(read, key, "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))
    out = out.withColumn("q", S.image_quality(F.col("confidence"), F.length("ocr_text"), F.lit(0)))
    return out.select(key, "category", "confidence", "ocr_text", F.round("q.quality_score", 6).alias("quality_score"), "q.usable", "error")


def model_classified(reply: Column, path: Column, message_type: Column) -> Column:
    """FIL-5, MSC-1: struct modality, confidence, reason, by_model: from the JSON of a model's reply; rules over path and type where there is
    no reply, and over nothing where the reply can't be read or names no modality."""
    found = F.try_parse_json(S.salvaged_json(reply))
    of = lambda k, kind: F.try_variant_get(found, f"$.{k}", kind)
    modality = F.coalesce(of("modality", "string"), F.lit("text"))
    rule = F.when(reply.isNull(), classified(path, message_type)).otherwise(classified(F.lit(""), F.lit("")))
    by_rule = F.struct(rule["modality"].alias("modality"), rule["confidence"].alias("confidence"), rule["reason"].alias("reason"), F.lit(False).alias("by_model"))
    by_model = F.struct(modality.alias("modality"), F.coalesce(of("confidence", "double"), F.lit(0.5)).alias("confidence"), F.coalesce(of("reason", "string"), F.lit("")).alias("reason"), F.lit(True).alias("by_model"))
    return F.when(found.isNotNull() & modality.isin("text", "image", "voice", "unknown"), by_model).otherwise(by_rule)


def dispatched(tasks: DataFrame, make: Make = Offline, key: str = "task_id") -> DataFrame:
    """UDF-9 to UDF-11, FIL-6: tasks (key, content, file_path, message_type) to the worker of their modality.

    One row a task: modality, success, confidence (the classifier's times the worker's), detail, error.
    """
    sorted_ = tasks.withColumn("c", classified(F.col("file_path"), F.col("message_type")))
    own = sorted_.select(key, F.col("c.modality").alias("modality"), F.col("c.confidence").alias("sure"))
    of = lambda m: sorted_.filter(F.col("c.modality") == m)
    texts = text_results(of("text"), key, "content", make).select(key, F.array_join("drugs", ",").alias("detail"), "confidence", "error")
    voices = voice_results(of("voice"), key, "file_path", make).select(key, F.col("transcript").alias("detail"), "confidence", "error")
    images = image_results(of("image"), key, "file_path", make).select(key, F.col("category").alias("detail"), "confidence", "error")
    done = own.join(texts.unionByName(voices).unionByName(images), key, "left")
    success = F.col("error").isNull() & F.col("detail").isNotNull()
    return done.select(key, "modality", success.alias("success"), F.round(F.when(success, F.col("sure") * F.col("confidence")).otherwise(0.0), 6).alias("confidence"), "detail", "error")


def dispatch_statistics(results: DataFrame) -> DataFrame:
    """AGG-9, UDF-11, MSC-2, MSC-3: tasks, successes, failures and mean confidence of each modality, and of all (null)."""
    return results.rollup("modality").agg(F.count("*").alias("tasks"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg("confidence"), 6).alias("confidence"))


def fusion_counters(levels: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-9: how many matches of each level, mentions of each modality and edges of each relation: counter, value, n."""
    each = ((levels, "match_level"), (mentions, "modality"), (edges, "relation"))
    parts = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("counter"), "value", "n") for df, c in each]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
