"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the Arrow batches that Spark makes for the Python stages, as texts can be long: rows and bytes.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
#: Bytes of text that a Python stage works on at a time.
SLICE_BYTES = 4 << 20


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session where the caller has set no bound; the settings are read when a plan runs, so they stay."""
    own = spark._jsparkSession.sessionState().conf()
    for key, bound in ARROW.items():
        if not own.contains(key):
            spark.conf.set(key, bound)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which all executors share.

    Only where it is unset and the master is local, as in tests, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evidencegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidencegraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def deleted(*tables: DataFrame) -> None:
    """Delete tables of `table` that nothing reads any more."""
    sc = tables[0].sparkSession.sparkContext
    for df in tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete such tables, and let Spark's cleaner drop the shuffles of finished steps."""
    deleted(*tables)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


#: What this Python worker keeps from task to task: the tables of one operator at a time, as workers serve one after another.
_KEPT: dict[tuple, object] = {}


def worker_cache(make: Callable, *args: str):
    """`make(*args)`, kept in this worker until another operator needs the memory."""
    if (key := (make, *args)) not in _KEPT:
        release()
        _KEPT[key] = make(*args)
    return _KEPT[key]


def release() -> None:
    """Give back what an operator before kept in this worker."""
    if _KEPT:
        _KEPT.clear()
        trimmed()


def trimmed() -> None:
    """Return freed memory of this worker to the system, where the C library can: workers that wait then hold little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim is not None:
        trim(0)


@cache
def _libc():
    return ctypes.CDLL(None)


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """Names like those wanted that clash with none of `names`, whatever their case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while (w := f"_{w}") in taken:
            pass
        taken.add(w)
        out.append(w)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged(rows: DataFrame, key: str, n: int) -> DataFrame:
    """`rows` with _id (`key`, the least long for null) and _part: about `n` ranges of _id between approximate quantiles."""
    keyed = rows.withColumn("_id", F.coalesce(key, F.lit(-(1 << 63)))).withColumn("_at", F.col("_id").cast("double"))
    bounds = sorted(set(keyed.approxQuantile("_at", [k / n for k in range(1, n)], 0.2 / n)))
    if bounds:
        keyed = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_at", outputCol="_part").transform(keyed)
    else:
        keyed = keyed.withColumn("_part", F.lit(0.0))
    return keyed.withColumn("_part", F.col("_part").cast("int")).drop("_at")


def utf8(text: str = "text"):
    """The bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def slices(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def groups(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `key`.

    A table ends where a group ends, once it has `most` rows; a larger group comes whole.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left")) if keys[0] != keys[-1] else 0
        if cut == 0:
            before = held[-2].column(key)[-1].as_py() if len(held) > 1 else None
            if before is None or before == keys[-1]:
                continue
        done = [*held[:-1], batch.slice(0, cut)] if cut else held[:-1]
        yield pa.Table.from_batches([x for x in done if x.num_rows])
        held, rows = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, with the length of the array at the end."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
