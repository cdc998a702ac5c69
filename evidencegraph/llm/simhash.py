"""SimHash near-duplicates through an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most d bits agree in at least 8 - d of their 8 bytes. The index
posts each fingerprint under small sets of positional bytes, chosen so that any pair with that many
agreeing bytes meets in a posting list. There the shared positional bytes of a pair are tallied, pairs
below the guaranteed number are let go, and the rest are verified by their differing bits.

Defined results: null and blank texts have the fingerprint zero and link like any other; fewer words than
a shingle make one shingle; rows of one doc_id are rows of one node, which links all that any of them
links to; a null doc_id is a row of its own component null
unless an equal text has an id; an empty table gives an empty result; columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, session, slices, table, unused, utf8
from .links import Near, bucketed, components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> list[int]:
    """XXH64 of the text's word shingles, repeats included."""
    words = text.translate(_LOWER).split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    begin = np.concatenate(([0], ends[: len(words) - size] + 1)).tolist()
    return [h(joined[a:b], seed) for a, b in zip(begin, ends[size - 1 :].tolist(), strict=True)]


def simhashes(texts: list[bytes], size: int) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is 1 if it is set in over half of the hashes."""
    return simhashes_of([shingle_hashes(t, size) for t in texts])


def simhashes_of(each: list[list[int]]) -> np.ndarray:
    """The SimHash of each list of shingle hashes."""
    n = np.fromiter(map(len, each), np.int64, len(each))
    out = np.zeros(len(each), np.uint64)
    flat = np.fromiter((x for e in each for x in e), ">u8", int(n.sum()))
    ends = np.cumsum(n)
    at = 0
    full = np.flatnonzero(n)
    while at < len(full):  # in pieces, as each hash becomes 64 bytes
        to = max(at + 1, int(np.searchsorted(ends[full], (ends[full[at]] - n[full[at]]) + (1 << 17), "right")))
        rows = full[at:to]
        a, b = ends[rows[0]] - n[rows[0]], ends[rows[-1]]
        count = np.zeros((len(rows), 64), np.int64)
        for lo in range(a, b, 1 << 18):  # a very long text is summed piece by piece
            hi = min(b, lo + (1 << 18))
            bits = np.unpackbits(flat[lo:hi].view(np.uint8).reshape(-1, 8), axis=1)
            first = ends[rows] - n[rows]
            has = np.flatnonzero((first < hi) & (ends[rows] > lo))
            count[has] += np.add.reduceat(bits, np.maximum(first[has] - lo, 0), axis=0, dtype=np.int64)
        out[rows] = np.packbits(count * 2 > n[rows][:, None], axis=1).view(">u8").ravel()
        at = to
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id") -> DataFrame:
    """doc_id (`key`) and fp, the fingerprint (long), of every row, with `_hash` where there is one."""
    session(docs.sparkSession)
    rest = [c for c in docs.columns if c == "_hash"]
    rows = docs.select(*rest, F.col(key).alias("doc_id"), utf8().alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            done = [simhashes(texts[a:b], shingle) for a, b in slices(np.array([len(t) for t in texts], np.int64))]
            fp = np.concatenate(done).view(np.int64) if done else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*batch.schema.names[:-1], "fp"])

    schema = rows.drop("text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("fp", F.lit(0).cast("long")).schema
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(work, schema)


def position_sets(most: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any 8 - `most` agreeing positions contain one.

    Of so many positions, half at least fall in one half of the bytes.
    """
    size = -(-(8 - most) // 2)
    return [c for half in (range(4), range(4, 8)) for c in combinations(half, size)]


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Links a, b between the nodes of distinct fingerprints (node, fp): enough to connect all that are linked."""
    if not 0 < most < 8:
        raise ValueError("the guarantee holds for 1 to 7 differing bits")
    masks = [sum(0xFF << 8 * p for p in c) - (1 << 64 if 7 in c else 0) for c in position_sets(most)]
    posted = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(masks)]
    code = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    index = fps.select(F.explode(F.array(*posted)).alias("key"), F.col("node").alias("id"), code.alias("code"))
    return bucketed(index, Near(most, 8 - most), "simhash", 8)


def groups_of(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row, with `_hash` where there is one."""
    fps = table(fingerprints(docs, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    roots = components(links(nodes.filter("node is not null"), most).unionByName(same_rows(fps)), 60)
    found = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(found, "fp")


def keep_one(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id, with its columns.

    Rows of one doc_id are one document, of which the row with the least hash of its text stays. Rows without a doc_id
    stay, equal texts once, unless a document with an id has their fingerprint.
    """
    id_, hashed = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(utf8())
    names = unused(docs.columns, "id", "hash")
    found = groups_of(docs.select("doc_id", hashed.alias("_hash"), "text"), shingle, most)
    least = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).agg(F.min("_hash").alias("_hash"))
    loose = found.filter("component_id is null").select(F.lit(-(1 << 63)).alias("_id"), "_hash").distinct()
    stays = table(least.unionByName(loose), "stays")
    return docs.withColumns(dict(zip(names, (id_, hashed), strict=True))).join(stays.toDF(*names), names).dropDuplicates(names).select(*docs.columns)


def same_rows(fps: DataFrame) -> DataFrame:
    """Links between the nodes of fingerprints that rows of one doc_id have; there are none where doc_id is unique."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    twice = fps.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc_id")
    own = fps.filter("doc_id is not null").join(twice, "doc_id").join(nodes, "fp").select("doc_id", "node")
    return own.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups_of(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple[int, str | None]], size: int = 3, most: int = 3) -> list[tuple[int, str, int]]:
    """What op9 returns, by comparing all pairs."""
    fps = []
    for _, text in docs:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))] if words else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = {d: d for d, _ in docs}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most and (a := find(docs[i][0])) != (b := find(docs[j][0])):
                root[max(a, b)] = min(a, b)
    return [(d, f"{f:016x}", find(d)) for (d, _), f in zip(docs, fps, strict=True)]
