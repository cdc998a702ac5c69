"""The whole run: intake, pseudonyms, tasks, workers, fusion, export; each stage is a table from which a run can go on."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, intake, pseudonymize, resolve
from ..operators.providers import Offline, text_results
from ..sources import readers, writers

#: In the order in which they run.
STAGES = ("intake", "pseudonymized", "tasks", "results", "entities", "edges", "timeline")


@dataclass
class Run:
    """AGG-21, UDF-16: what a run has made, by stage, with seconds; `folder` keeps the tables."""

    spark: SparkSession
    folder: str
    salt: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    #: SNK-13: is told the stage, how many are done, and of how many.
    progress: Callable[[str, int, int], None] = lambda stage, done, of: None

    def statistics(self) -> dict[str, dict[str, float]]:
        """AGG-21: rows and seconds of each stage."""
        return {name: {"rows": df.count(), "seconds": self.seconds[name]} for name, df in self.tables.items()}

    def done(self, stage: str) -> bool:
        """A stage counts as done once its table is complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{stage}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def stage(self, name: str, make) -> DataFrame:
        began = time.monotonic()
        if self.done(name):
            out = self.spark.read.parquet(f"{self.folder}/{name}")
        else:
            out = writers.stage(make(), f"{self.folder}/{name}")
        self.tables[name] = out
        self.seconds[name] = time.monotonic() - began
        self.progress(name, len(self.tables), len(STAGES))
        return out


def mentions_of(results: DataFrame) -> DataFrame:
    """JOI-11, JOI-12: one row for each drug and person of each text."""
    drugs = results.select("uuid", "seq", "ts", F.posexplode("drugs").alias("at", "name"), F.lit("drug").alias("type"), F.lit(0.8).alias("confidence"))
    persons = results.select("uuid", "seq", "ts", F.posexplode("persons").alias("at", "name"), F.lit("person").alias("type"), F.lit(0.8).alias("confidence"))
    both = drugs.unionByName(persons)
    return both.select("uuid", "ts", "name", "type", "confidence", F.lit("text").alias("source"), ((2 * F.col("seq") + F.when(F.col("type") == "drug", 0).otherwise(1)) * (1 << 24) + F.col("at")).alias("seq"))  # drugs first, then persons, as they stand


def printed(stage: str, done: int, of: int) -> None:
    """SNK-13: a progress callback for the console."""
    print(f"[{done}/{of}] {stage}", flush=True)


def run(spark: SparkSession, path: str, folder: str, salt: str, make=Offline, progress: Callable[[str, int, int], None] | None = None) -> Run:
    """All stages over a JSON array of messages at `path`; stages whose tables are in `folder` are read, not made again."""
    r = Run(spark, folder, salt, **({"progress": progress} if progress else {}))
    rows = r.stage("intake", lambda: readers.chat_json(spark, path))
    valid, errors = intake.split_valid(rows)
    writers.one_file(intake.quality_report(valid, errors), f"{folder}/report")
    clean = r.stage("pseudonymized", lambda: pseudonymize.pseudonymized(valid, salt, seq="index"))
    tasks = r.stage("tasks", lambda: intake.numbered(clean.withColumn("modality", intake.modality_of(F.col("type"))), "modality", "index"))
    results = r.stage("results", lambda: _texts(tasks, make))
    mentions = mentions_of(results)
    entities = r.stage("entities", lambda: resolve.fused(mentions))
    edges = r.stage("edges", lambda: graph.cooccurrences(mentions.withColumn("entity", F.trim(F.lower("name")))))
    dated = mentions.groupBy(F.trim(F.lower("name")).alias("entity_id")).agg(F.min("ts").alias("ts"), F.min("seq").alias("seq"), F.max("confidence").alias("confidence"))
    r.stage("timeline", lambda: graph.timeline(dated))
    writers.graph(entities.select(F.col("key").alias("node"), "name", "type", "confidence"), edges, f"{folder}/graph")
    return r


def _texts(tasks: DataFrame, make) -> DataFrame:
    texts = tasks.filter("modality = 'text'").withColumn("seq", F.col("index"))
    found = text_results(texts, "task_id", "content", make)
    own = texts.select("task_id", "uuid", "seq", F.try_to_timestamp(S.normalized_time(F.col("timestamp"))).alias("ts"), S.person_tokens(F.col("content")).alias("persons"))
    return own.join(found, "task_id")
