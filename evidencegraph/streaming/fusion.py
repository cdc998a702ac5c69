"""Structured Streaming: incremental registration of entities, event counts, and sessions of users."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import normalized_name
from ..operators.resolve import resolve_in_order
from ..tables import written


def entity_table(batches: DataFrame) -> DataFrame:
    """The registry from all batches written so far: one row for each name."""
    return batches.groupBy("key").agg(F.min("first_seq").alias("first_seq"), F.max_by("name", F.struct("confidence", -F.col("first_seq"))).alias("name"), F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"))


def register(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """STR-1 to STR-3: entities of `modality_output` and `external_data` events (type, seq, name, confidence), pre-aggregated by batch.

    Each batch overwrites a folder of its own number, so that a batch that runs again changes nothing; `entity_table` reads them all.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.filter(F.col("type").isin("modality_output", "external_data") & (F.coalesce("name", F.lit("")) != ""))
        rows = kept.groupBy(normalized_name(F.col("name")).alias("key")).agg(
            F.min("seq").alias("first_seq"), F.max_by("name", F.struct("confidence", -F.col("seq"))).alias("name"), F.count("*").alias("mentions"), F.max("confidence").alias("confidence")
        )
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def register_by_keys(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """STR-2, STR-3: mentions (type, seq, confidence, source, and keys as for `resolve_in_order`) by all match levels, batch after batch.

    Entities are known by the mention that opened them. A batch meets the openers of the batches before, and overwrites a folder of
    its own number: seq, opened (the opener's seq), match_level, matching_field, and the mention's keys. Other events are left out;
    `entity_update` events have a folder of their own, `updates`, in which the last one of an entity counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = [c for c in ("name", "phone", "wechat", "id_card", "account") if c in batch.columns]
        kept = [c for c in ("seq", "confidence", "source", *keys) if c in batch.columns]
        known = batch.select("type", *kept).persist()
        known.filter("type = 'entity_update'").write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")
        new = known.filter(F.col("type").isin("modality_output", "external_data")).select(*kept)
        schema = f"seq long, opened long, match_level int, matching_field string, {', '.join(f'{c} {new.schema[c].dataType.simpleString()}' for c in kept[1:])}"
        before = spark.createDataFrame([], schema)
        if number:
            before = spark.read.schema(schema + ", batch long").option("basePath", f"{folder}/mentions").parquet(f"{folder}/mentions").filter(F.col("batch") < number).drop("batch")
        openers = before.filter("seq = opened").select(*kept)
        both = written(openers.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False))), "mentions")
        entities, log = resolve_in_order(both.drop("_old"))
        found = log.join(entities.select("entity_id", F.col("seq").alias("opened")), "entity_id").select("seq", "opened", "match_level", "matching_field")
        found.join(both.filter("not _old").drop("_old"), "seq").write.mode("overwrite").parquet(f"{folder}/mentions/batch={number}")
        known.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Events of each kind in tumbling windows; what comes later than `late` is left out. An extension of the event queue."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, user: str, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events with gaps under `gap`."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drained(query: StreamingQuery) -> None:
    """Work off all input that is there, then stop."""
    query.processAllAvailable()
    query.stop()


def checkpoint_folder(base: str) -> str:
    return f"{base}/stream-{uuid.uuid4().hex}"
