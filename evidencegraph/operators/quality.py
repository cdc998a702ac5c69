"""Quality reports of extraction results: checks, score, level, batches and rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import confidence_level, quality_level

PASSED = 0.5


def _texts(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def checked(rows: DataFrame) -> DataFrame:
    """QUA-1 to QUA-6: quality_score, quality_level, passed, issues, warnings of each row.

    A row has uuid, confidence, error, modality, and by modality: has_drugs, has_entities, entity_drugs (texts); has_transcription,
    has_quality, voice_score, transcript (voices); has_classification, has_details, category, ocr_text (images). Null means absent.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    m = F.col("modality")
    missing = _texts(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("uuid", "confidence")])
    failed = F.col("error").isNotNull()
    valid = (F.size(missing) == 0) & ~failed
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    level = confidence_level(confidence)
    complete = (
        F.when(m == "text", yes("has_drugs") | yes("has_entities"))
        .when(m == "voice", yes("has_transcription") & yes("has_quality"))
        .when(m == "image", yes("has_classification") & yes("has_details"))
        .otherwise(False)
    )
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    clash = (
        F.when((m == "text") & yes("has_drugs") & yes("has_entities") & ~yes("entity_drugs"), "Extracted drugs but no drug information in entities")
        .when((m == "voice") & (F.coalesce(F.col("voice_score"), F.lit(0.0)) > 0.8) & (F.coalesce(F.length("transcript"), F.lit(0)) < 10), "High quality score but transcription text is too short")
        .when((m == "image") & F.col("category").isin("transaction", "chat_screenshot") & empty("ocr_text"), "Image category requires text but OCR is empty")
    )
    part = lambda c, x: F.when(c, x).otherwise(F.lit(0.0))
    score = part(valid, F.lit(0.3)) + part(level.isNotNull(), 0.3 * confidence) + part(complete, F.lit(0.2)) + part(clash.isNull(), F.lit(0.2))
    out = rows.withColumn("quality_score", F.least(score, F.lit(1.0)))
    issues = _texts(
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", "))),
        F.when(failed, F.concat(F.lit("Processing error: "), F.col("error"))),
    )
    warnings = _texts(
        F.when(level == "low", "Low confidence, manual review recommended"),
        F.when(~complete, "Incomplete data"),
        F.when(clash.isNotNull(), F.concat(F.lit("Consistency issue: "), clash)),
    )
    return out.withColumns({"quality_level": quality_level(F.col("quality_score")), "passed": F.col("quality_score") >= PASSED, "issues": issues, "warnings": warnings})


def batch_report(reports: DataFrame) -> DataFrame:
    """QUA-7, AGG-12: counts, rates and means of each modality."""
    levels = [F.count_if(F.col("quality_level") == x).alias(f"n_{x}") for x in ("excellent", "good", "fair", "poor")]
    return reports.groupBy("modality").agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"),
        F.round(F.avg("quality_score"), 6).alias("average_quality_score"),
        F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("average_confidence"),
        *levels,
    )


def global_statistics(reports: DataFrame) -> DataFrame:
    """AGG-13: by level, by modality, and in all."""
    each = reports.groupingSets([[F.col("quality_level")], [F.col("modality")], []], F.col("quality_level"), F.col("modality"))
    return each.agg(
        F.when(F.grouping_id() == 3, "all").when(F.grouping_id() == 1, "level").otherwise("modality").alias("by"),
        F.count("*").alias("checked"),
        F.count_if("passed").alias("passed"),
        F.sum(F.size("warnings")).cast("long").alias("warnings"),
    )


def anomalies(reports: DataFrame, seq: str = "seq", most: int = 100) -> DataFrame:
    """TOP-9: the last `most` rows that didn't pass."""
    return reports.filter(~F.col("passed")).orderBy(F.col(seq).desc()).limit(most)


def text_report(reports: DataFrame) -> DataFrame:
    """SNK-12: one line for each modality."""
    line = F.format_string("%s: %d checked, %d passed (%.2f), mean score %.4f", F.col("modality"), F.col("total"), F.col("passed"), F.col("pass_rate"), F.col("average_quality_score"))
    return batch_report(reports).select("modality", line.alias("line"))


def full_report(reports: DataFrame) -> DataFrame:
    """SNK-12: one row, `report`: totals, then the modalities in order of their names, then the levels."""
    b = batch_report(reports)
    line = F.format_string("%s: %d checked, %d passed (%.2f), mean score %.4f", F.col("modality"), F.col("total"), F.col("passed"), F.col("pass_rate"), F.col("average_quality_score"))
    levels = [F.sum(f"n_{x}").alias(x) for x in ("excellent", "good", "fair", "poor")]
    all_ = b.agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"), F.array_sort(F.collect_list(line)).alias("lines"), *levels)  # a line for each modality
    head = F.format_string("Checked: %d, passed: %d, failed: %d", F.col("total"), F.col("passed"), F.col("total") - F.col("passed"))
    foot = F.format_string("Levels: %d excellent, %d good, %d fair, %d poor", *[F.col(x) for x in ("excellent", "good", "fair", "poor")])
    return all_.select(F.concat_ws("\n", head, F.array_join("lines", "\n"), foot).alias("report"))


def histogram(rows: DataFrame, score: str = "quality") -> DataFrame:
    """AGG-11: mean and three buckets."""
    s = F.col(score)
    return rows.agg(F.count("*").alias("total"), F.round(F.avg(s), 6).alias("average"), F.count_if(s > 0.8).alias("high"), F.count_if(s.between(0.5, 0.8)).alias("medium"), F.count_if(s < 0.5).alias("low"))


def health(outcomes: DataFrame, group: str, seq: str, last: int = 10) -> DataFrame:
    """AGG-19, AGG-20, WIN-1: success rate of all outcomes, mean quality of the successes among the last ones, and .6 and .4 of both."""
    ranked = outcomes.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.col(seq).desc())))
    recent = F.when((F.col("_n") <= last) & F.col("success"), F.col("quality"))
    rate = F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.5))
    quality = F.coalesce(F.avg(recent), F.lit(0.5))
    out = ranked.groupBy(group).agg(rate.alias("_rate"), quality.alias("_quality"))
    return out.select(group, F.round("_rate", 6).alias("success_rate"), F.round("_quality", 6).alias("avg_quality"), F.round(0.6 * F.col("_rate") + 0.4 * F.col("_quality"), 6).alias("health"))


def best_worker(workers: DataFrame, preferred: str, least: float = 0.3) -> DataFrame:
    """TOP-7: for each modality the preferred worker if its health is over `least`, else the healthiest; then the others."""
    p = F.col("worker") == preferred
    ranked = F.struct((p & (F.col("health") > least)).cast("int").alias("a"), F.col("health").alias("b"), F.col("worker").alias("c"))
    return workers.groupBy("modality").agg(F.max_by("worker", ranked).alias("selected"), F.array_sort(F.collect_set("worker")).alias("workers")).withColumn("alternatives", F.array_except("workers", F.array("selected"))).drop("workers")


def agent_statistics(runs: DataFrame) -> DataFrame:
    """AGG-18: runs and mean time of each agent."""
    return runs.groupBy("agent").agg(F.count("*").alias("processed"), F.round(F.sum("seconds") / F.greatest(F.count("*"), F.lit(1)), 6).alias("avg_time"))
