"""Connected components of links, and the search for links inside the buckets of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, groups, starts, table

#: Members that are compared within one bucket. A larger bucket is dealt to cells, each of two blocks of half as many.
BLOCK = 2048


def forest(n: int, linked: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among `n` rows; `linked` tells of two arrays of row numbers which pairs link.

    The work is quadratic in the number of rows, what it returns is linear, and memory is bounded by `width`, the bytes of a comparison.
    """
    a_out: list[np.ndarray] = [np.zeros(0, np.int64)]
    b_out: list[np.ndarray] = [np.zeros(0, np.int64)]
    left = np.arange(n)
    step = max(1, (1 << 22) // max(1, width * n))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            part, front = front[:step], front[step:]
            ok = linked(part, left)
            hit = ok.any(axis=0)
            if hit.any():
                a_out.append(part[ok.argmax(axis=0)[hit]])
                b_out.append(left[hit])
                front = np.concatenate((front, left[hit]))
                left = left[~hit]
    return np.concatenate(a_out), np.concatenate(b_out)


def in_cells(index: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of large buckets (`sizes`: key, n) under the keys of cells of two blocks, so that every two of a bucket meet in a cell.

    Blocks are of some BLOCK / 2 members, by a hash of the id; no bucket is ever together in one task.
    """
    blocks = F.ceil(2 * F.col("n") / BLOCK).cast("int")
    rows = index.join(sizes, "key").withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # a block meets itself in the cell with the next one
    own = (F.col("_other") != F.col("_own")) | (F.col("_blocks") == 1)
    return rows.filter(own).select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "id", "code")


def bucketed(index: DataFrame, find: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], name: str, width: int) -> DataFrame:
    """Links a, b of an index key, id, code: those that `find` names within each bucket of equal key.

    Buckets of one member vanish. Those of more than BLOCK members are dealt out to cells before they are compared, so that
    neither their rows nor their comparisons are in one task.
    `find` gets the codes of a bucket as rows of `width` bytes, and returns the row numbers that it links.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "key"):
            keys, ids = t.column("key").to_numpy(), t.column("id").to_numpy()
            edge = starts(keys)
            size = np.diff(edge)
            many = np.flatnonzero(size > 1)
            if not len(many):
                continue
            code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(-1, width)
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            two = many[size[many] == 2]
            for chunk in (two[i : i + 65536] for i in range(0, len(two), 65536)):
                pairs.append(find_pairs(code, edge[chunk], find, ids))
            for g in many[size[many] > 2]:
                a, b = edge[g], edge[g + 1]
                i, j = find(code[a:b])
                if len(i):
                    pairs.append((ids[a + i], ids[a + j]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (ids[:0], ids[:0])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    hot = table(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), f"{name}-hot")
    dealt = index
    if not hot.isEmpty():
        dealt = index.join(hot, "key", "left_anti").select("key", "id", "code").unionByName(in_cells(index, hot))
    return table(dealt.repartition("key").sortWithinPartitions("key", "id").mapInArrow(search, "a long, b long"), name)


def find_pairs(code: np.ndarray, at: np.ndarray, find: Callable, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of two members, at once: `find.two` tells which link."""
    ok = find.two(code[at], code[at + 1])
    return ids[at[ok]], ids[at[ok] + 1]


class Near:
    """Rows of bytes that agree in at least `least` positions and differ in at most `most` bits."""

    def __init__(self, most: int, least: int) -> None:
        self.most, self.least = most, least

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            x = codes[a][:, None, :] ^ codes[b][None, :, :]
            ok = np.count_nonzero(x == 0, axis=2) >= self.least
            if ok.any():
                i, j = np.nonzero(ok)
                far = np.bitwise_count(x[i, j]).sum(axis=1, dtype=np.int32) > self.most
                ok[i[far], j[far]] = False
            return ok

        return forest(len(codes), linked, codes.shape[1])

    def two(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = x ^ y
        return (np.count_nonzero(z == 0, axis=1) >= self.least) & (np.bitwise_count(z).sum(axis=1, dtype=np.int32) <= self.most)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node in `edges` (a, b): root is the smallest node that can be reached.

    Alternating large and small stars; each round is a table in the shared folder, and ends when no edge changes.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = table(e, "edges"), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        last, e = e, table(small.distinct(), "edges")
        deleted(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
