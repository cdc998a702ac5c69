"""Tables that cut the lineage of iterations, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`. Only where it is unset and the master is local, a temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evidencegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that isn't there yet, in the shared one."""
    return f"{shared_folder(spark)}/evidencegraph/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table of its own in the shared folder, read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the files' columns that a task of a wide step takes, as Catalyst estimates them; in memory rows are some tens of times larger.
TASK_BYTES = 2 << 20


def tasks_of(*inputs: DataFrame) -> int:
    """Tasks for a step over `inputs`, so that one's rows don't grow with them: as many as there are cores, or more by the bytes that are read.

    Partitions of a given number are not put together by adaptive execution, which makes as many as there are cores, however large.
    """
    n, size = inputs[0].sparkSession.sparkContext.defaultParallelism, 0
    for df in inputs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        size += sum(s for s in sizes if s < 1 << 62)  # a leaf of unknown size has the greatest number
    return max(n, -(-size // TASK_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` to as many tasks as shuffles have, however few its bytes, for rows that take much work."""
    return df.repartition(max(tasks_of(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
