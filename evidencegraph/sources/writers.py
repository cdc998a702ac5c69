"""Writers: reports, graphs, mappings, stage tables. Each writes a folder of files in parallel; `one_file` is for results of a known few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-2, SNK-3, SNK-9, SNK-10."""
    df.write.mode(mode).json(path)


def one_file(df: DataFrame, path: str) -> None:
    """SNK-1, SNK-12: a report of a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK-4, SNK-6."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def network(parts: dict[str, DataFrame], path: str) -> None:
    """SNK-5: entities, statistics, edges, timeline, conflicts, whichever are given."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def mapping(pairs: DataFrame, path: str, statistics: DataFrame | None = None) -> None:
    """SNK-7: original and pseudonym; beside them, in `path`_totals, how many there are, and the statistics (one row) if given."""
    pairs.select(F.col("raw").alias("original"), "pseudonym").write.mode("overwrite").json(path)
    totals = pairs.agg(F.count("*").alias("total_entities"))
    one_file(totals if statistics is None else totals.join(statistics), f"{path}_totals")


def stage(df: DataFrame, path: str) -> DataFrame:
    """SNK-8, SNK-11: a stage's table, read again, so that a later run can go on from it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
