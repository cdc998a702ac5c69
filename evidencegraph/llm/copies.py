"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, without loss.

SimHash comes first: fingerprints of the five-word shingles, linked through the index of byte positions of `simhash`, with
its tally of shared bytes and its bound on differing bits; links are then verified over the whole sets. As 64 bits can't tell
that similarity for certain, what the fingerprints miss is found by an index of the sets.

For this index each text is its set of 64-bit shingle hashes, in ascending order. Of two sets with that similarity, the beginnings of
|x| - ceil(0.8 |x|) + c hashes share c, so such pairs meet in the buckets of an index of these beginnings, and are let go
below that number, for c of `shared`. Before, pairs are let go by two bounds that hold for every such pair: on the sizes, and
on the bits that differ between parity sketches (at most the hashes that only one of both has), if the sets are
small enough for such a sketch to tell anything. What is left is verified over the whole sets.

With the links of the fingerprints, the buckets of the FIRST hashes of each set name spanning forests of their candidates, by
which nearly all groups of copies are found. After these are verified, the buckets of the whole index that hold different components name all
candidates between these, so that nothing is lost and a large group of copies does not give all its pairs.

Hashes of more than COMMON sets are common, and a set stays out of their buckets if it has fewer of them in its beginning
than it shares with any copy: then it shares another hash with each, and meets it there. So a passage that many texts have
does not pair them all, and the others' buckets give at most COMMON candidates a row. Nothing is lost by it.

Defined results: null and blank texts have the empty set, and are copies of each other; fewer words than a shingle make
one shingle; equal sets are one node; rows of one doc_id are one document; a null doc_id is a document of its own,
after all others; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, dropped, release, session, slices, table, unused, utf8
from .links import bucketed, components, forest
from .simhash import links, shingle_hashes, simhashes_of

SHINGLE = 5
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Bits in which linked fingerprints differ at most.
MOST = 3
#: Hashes of a set under which copies are looked for at first.
FIRST = 3
#: A hash in the beginnings of more sets than this is common.
COMMON = 16
#: Bits of a parity sketch.
BITS = 512
#: Bytes of a code: the size of the set, the sketch, the component.
WIDTH = 8 + BITS // 8 + 8
NULL = -(1 << 63)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    return distinct(shingle_hashes(text, size))


def distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64))


def shared(n: int) -> int:
    """So many hashes at least do the beginnings of a set of `n` and of any as large or larger share."""
    return 1 + n // 20


def beginning(n: int) -> int:
    """So many of the first hashes of a set of `n` go into the index."""
    return min(n, n - -(-OVER * n // UNDER) + shared(n)) if n else 0


def fewest(n: int) -> int:
    """So many hashes at least do the beginnings of a set of `n` and of any copy share, as that has 0.8 n hashes or more."""
    return shared(-(-OVER * n // UNDER))


def thinned(n):
    """One of so many hashes goes into the sketch of a set of `n`; sets of up to 1,023 have sketches of all."""
    return np.left_shift(1, np.maximum(np.log2(np.maximum(n, 1)).astype(np.int64) - 9, 0))


def sketch(s: np.ndarray) -> bytes:
    """The size of a set, and for each residue of its (thinned) hashes whether it is odd how many have it."""
    some = s[(s >> np.uint64(32)) % np.uint64(thinned(len(s))) == 0]
    odd = np.bincount((some % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return len(s).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def sets(docs: DataFrame) -> DataFrame:
    """_id, _hash (of the text), fp (of the set), n (its size), sim (its SimHash), sketch, keys (its beginning) of every row."""
    session(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("_id"), F.xxhash64(utf8()).alias("_hash"), utf8().alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fp, n, sims, codes, keys = [], [], [np.zeros(0, np.uint64)], [], []
            for lo, hi in slices(np.array([len(t.as_buffer()) for t in batch.column("text")], np.int64), 1 << 20):
                each = [distinct(shingle_hashes(t.as_py(), SHINGLE)) for t in batch.column("text")[lo:hi]]
                sims.append(simhashes_of([s.tolist() for s in each]))
                for s in each:
                    n.append(len(s))
                    fp.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                    codes.append(sketch(s))
                    keys.append(s[: beginning(len(s))].view(np.int64))
            new = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(np.concatenate(sims).view(np.int64)), pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new], names=["_id", "_hash", "fp", "n", "sim", "sketch", "keys"])

    return rows.mapInArrow(work, "_id long, _hash long, fp long, n long, sim long, sketch binary, keys array<long>")


def linked(prints: DataFrame) -> DataFrame:
    """Links a, b of the sets fp whose SimHash (sim) is the same or differs in MOST bits: enough to connect all of them."""
    nodes = table(prints.groupBy("sim").agg(F.min("fp").alias("node")), "simhash-nodes")
    same = prints.join(nodes, "sim").filter("fp <> node").select(F.col("node").alias("a"), F.col("fp").alias("b"))
    return links(nodes.withColumnRenamed("sim", "fp"), MOST).unionByName(same)


class Candidates:
    """Pairs of codes within the bounds: a spanning forest, or all those between different components.

    For the forest, thinned sketches count too, by what is to be expected of them; for all pairs they don't.
    """

    def __init__(self, across: bool) -> None:
        self.across = across

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, s, c = self.parts(codes)
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.across and (c == c[0]).all():
            return a_out[0], b_out[0]
        step = max(1, (1 << 22) // (BITS // 8 * len(codes)))

        def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return self.within(n[x][:, None], s[x][:, None, :], n[y][None, :], s[y][None, :, :])

        if self.across:
            at = np.arange(len(codes))
            for lo in range(0, len(codes), step):
                x, y = at[lo : lo + step], at[lo + 1 :]
                i, j = np.nonzero(fit(x, y) & (x[:, None] < y) & (c[x][:, None] != c[y]))
                a_out.append(x[i])
                b_out.append(y[j])
            return np.concatenate(a_out), np.concatenate(b_out)
        return forest(len(codes), fit, BITS // 8)

    def two(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, s, c = self.parts(x)
        m, t, d = self.parts(y)
        return self.within(n, s, m, t) & (c != d)

    @staticmethod
    def parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return codes[:, :8].copy().view("<i8")[:, 0], codes[:, 8:-8].copy().view("<u8"), codes[:, -8:].copy().view("<i8")[:, 0]

    def within(self, n: np.ndarray, s: np.ndarray, m: np.ndarray, t: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(s ^ t).sum(axis=-1, dtype=np.int64)
        r, q = thinned(n), thinned(m)
        most = (UNDER - OVER) / (UNDER + OVER) * (n + m)  # hashes that only one of both has
        near = np.where((r == 1) & (q == 1), differ <= most, True if self.across else (r == q) & (differ <= 1.3 * most / r + 24))
        return (UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)) & near


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs a, b of sets that have the similarity."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    one = rows.join(need, "fp").groupBy("fp").agg(F.min(F.struct("_id", "_hash")).alias("_r")).select("fp", "_r.*")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("_id"), F.xxhash64(utf8()).alias("_hash"), utf8().alias("text"))
    texts = table(keyed.join(one, ["_id", "_hash"]).dropDuplicates(["fp"]).select("fp", "text"), "candidate-texts")
    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, ta, b, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("b").to_pylist(), batch.column("tb"), strict=True):
                for k, t in ((a, ta), (b, tb)):
                    if k not in known:
                        if len(known) > 64:
                            known.clear()
                        known[k] = shingles(t.as_py())
                x, y = known.get(a), known[b]
                x = shingles(ta.as_py()) if x is None else x
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(UNDER * common >= OVER * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = table(both.select("a", "ta", "b", "tb").mapInArrow(work, "a long, b long"), "copies")
    dropped(texts)
    return found


def groups_of(docs: DataFrame) -> DataFrame:
    """_id (doc_id, the least long for null), _hash and root of every row: rows of one root are copies, directly or through others."""
    full = table(sets(docs), "shingle-sets")
    rows = table(full.select("_id", "_hash", "fp"), "shingle-prints")
    nodes = full.groupBy("fp").agg(F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    at = nodes.select("fp", F.posexplode("keys").alias("at", "key")).withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    met = table(at.select("key", "fp", (F.col("at") < FIRST).alias("early"), (F.col("n") > COMMON).alias("common")), "shared-shingles")
    many = met.filter("common").groupBy("fp").agg(F.count("*").alias("commons"))
    sketches = full.select("fp", "n", "sketch").dropDuplicates(["fp"]).join(many, "fp", "left").withColumn("commons", F.coalesce("commons", F.lit(0)))
    stays_in = F.col("commons") >= 1 + F.floor(F.ceil(OVER * F.col("n") / UNDER) / 20)  # `fewest`
    sketches = table(sketches.withColumn("stays_in", stays_in), "sketches")
    prints = table(full.select("fp", "sim").dropDuplicates(["fp"]), "simhashes")
    many = rows.groupBy("_id").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")).filter(f"a <> hi and _id <> {NULL}").select("_id", "a")
    edges = table(rows.join(many, "_id").select("a", F.col("fp").alias("b")).filter("a <> b"), "rows-of-one-document")
    deleted(full)
    for across in (False, True):
        known = met.join(components(edges), F.col("fp") == F.col("node"), "left").select("key", "fp", "early", "common", F.coalesce("root", "fp").alias("root"))
        if across:
            known = known.join(sketches.filter("commons > 0 and not stays_in").select("fp", F.lit(True).alias("out")), "fp", "left").filter("not common or out is null")
            known = table(known.select("key", "fp", "root"), "shared-components")
            several = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
            used = known.join(several, "key")
        else:
            used = known.filter("early")
        index = used.join(sketches, "fp").select("key", F.col("fp").alias("id"), F.concat("sketch", F.unhex(F.lpad(F.hex("root"), 16, "0"))).alias("code"))
        pairs = bucketed(index, Candidates(across), "candidates", WIDTH).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("common"))
        if across:  # all buckets that both are in name a pair, so that the hashes they share there are tallied
            sizes = [sketches.select(F.col("fp").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "commons", "stays_in"))) for x in ("a", "b")]
            untold = F.when(F.col("stays_in_a") & F.col("stays_in_b"), 0).otherwise(F.least("commons_a", "commons_b"))
            pairs = pairs.join(sizes[0], "a").join(sizes[1], "b").filter(F.col("common") + untold >= 1 + F.floor(F.least("n_a", "n_b") / 20))
        else:
            near = linked(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = pairs.select("a", "b").unionByName(near).distinct()
        pairs = table(pairs.select("a", "b"), "candidate-pairs")
        found = verified(pairs, docs, rows)
        edges = table(edges.unionByName(found), "copies")
        dropped(pairs, found)
    dropped(met, known, sketches, prints)
    return rows.join(components(edges), F.col("fp") == F.col("node"), "left").select("_id", "_hash", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of copies, the one of the smallest doc_id, with its columns; of its rows the one with the least hash of its text."""
    least = F.min(F.struct((F.col("_id") == NULL).alias("none"), "_id", "_hash")).alias("r")
    stays = table(groups_of(docs).groupBy("root").agg(least).select("r._id", "r._hash"), "stays")
    names = unused(docs.columns, "id", "hash")
    keyed = docs.withColumns(dict(zip(names, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)), F.xxhash64(utf8())), strict=True)))
    return keyed.join(stays.toDF(*names), names).dropDuplicates(names).select(*docs.columns)


def brute_force(docs: list[tuple[int | None, str | None]]) -> set[tuple[int | None, str]]:
    """doc_id and text of what `keep_one` keeps where no doc_id has two texts, by comparing all pairs."""

    def of(text: str | None) -> set[tuple]:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()

    each = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    s = [of(t) for _, t in each]
    group = list(range(len(each)))
    for i in range(len(each)):
        for j in range(i):
            if UNDER * len(s[i] & s[j]) >= OVER * len(s[i] | s[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return {each[g] for g in set(group)}
