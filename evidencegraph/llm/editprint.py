"""Document fingerprints from a randomised embedding of edit distance into Hamming distance.

Over each whole text goes a walk that all texts share: at step j a random bit of (j, the character under it) says whether
it moves on, and it puts out a random bit of j and the GRAM characters from there on. Two walks over similar texts fall into step again soon after an
edit, so few of their outputs differ, and the edits between texts become differing bits. The fingerprint is a sample
of the outputs: of a walk of up to T steps, those at the SAMPLED steps that belong to the scale T. Scales grow by a quarter;
the steps of a scale below the one before it are some of that one's, so that fingerprints of different scales compare too.
The likeness of two fingerprints is the share of outputs that agree less that of those which differ, of those that
either walk made, so that chance counts nothing.

Candidates for near-duplicates meet in bands of sampled bits, and are verified over all bits of their fingerprints.

Defined results: null and empty texts have the fingerprint of no step, equal to each other only; equal
texts have equal fingerprints; rows of equal doc_id are ordered by a hash of their texts; a null doc_id
comes after all others; a table of one row is its own next row; an empty table gives an empty result;
texts may be of any length; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, ranged, release, session
from .links import bucketed, components, forest

#: Outputs in a fingerprint, and characters that an output depends on: more than one, so that texts don't agree by common letters.
SAMPLED, GRAM = 512, 3
#: Steps of the least scale, and how scales grow.
LEAST_STEPS, GROWTH = 16, 1.25
#: A fingerprint: the scale, how many of the sampled steps the walk made, their outputs.
WIDTH = 1 + 2 + SAMPLED // 8
#: Code points that are embedded at a time, and texts from which they are walked over side by side.
CHUNK, MANY = 2_000_000, 64
#: Whether the walk moves on repeats after so many steps; what it puts out doesn't.
PERIOD = 4096

_rng = np.random.default_rng(20240229)
_MOVES = _rng.integers(0, 2, (256, PERIOD), dtype=np.uint8).astype(bool)
_CLASS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


def _waits() -> np.ndarray:
    """For each class and step how many steps the walk takes to leave a character of that class."""
    out = np.empty((256, PERIOD), np.uint8)
    for c in range(256):
        on = np.flatnonzero(_MOVES[c])
        at = np.concatenate((on, on[:1] + PERIOD))
        out[c] = at[np.searchsorted(at, np.arange(PERIOD))] - np.arange(PERIOD) + 1
    return out


_WAIT = _waits()
_WAIT_FLAT, _WAIT_OF = _WAIT.ravel(), [w.tobytes() for w in _WAIT]


def steps_in(scale: int) -> int:
    return int(LEAST_STEPS * GROWTH**scale)


@cache
def sampled(scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The sampled steps of a scale in ascending order, and which of the scale before it they go on with."""
    if scale == 0:
        return np.arange(LEAST_STEPS), np.zeros(0, np.int64)
    before, _ = sampled(scale - 1)
    old, new = steps_in(scale - 1), steps_in(scale)
    size = min(SAMPLED, new)
    keep = len(before) if new <= SAMPLED else round(size * old / new)
    rng = np.random.default_rng(scale)
    kept = np.sort(rng.permutation(len(before))[:keep])
    fresh = old + np.sort(rng.choice(new - old, size - keep, replace=False))
    return np.concatenate((before[kept], fresh)), kept


def _symbols(text: str) -> np.ndarray:
    """A class of 0 to 255 for each code point."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 256, c, (c * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(256)).astype(np.uint8)


def _walked(sym: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each character the step at which the walk leaves it; `ends` are where texts end, `start` is the step at which each walk begins."""
    out = np.empty(len(sym), np.int64)
    size = np.diff(ends, prepend=0)
    order = np.argsort(-size, kind="stable")
    begin, size = (ends - size)[order], size[order]
    step = start[order].astype(np.int64)
    i = 0
    if len(order) >= MANY:
        side = int(size[MANY - 1])  # so far go MANY texts at least
        live = np.searchsorted(-size, -np.arange(side), "left")  # texts longer than i
        for i in range(side):
            n = live[i]
            at, now = begin[:n] + i, step[:n]
            now += _WAIT_FLAT[sym[at].astype(np.int64) * PERIOD + (now & (PERIOD - 1))]
            out[at] = now
        i = side
    waits, mask = _WAIT_OF, PERIOD - 1
    for k in range(int(np.searchsorted(-size, -i, "left"))):
        a, z = int(begin[k]) + i, int(begin[k] + size[k])
        at, left = int(step[k]), []
        for c in sym[a:z].tobytes():
            at += waits[c][at & mask]
            left.append(at)
        out[a:z] = left
    return out


def _code(sym: np.ndarray, left: np.ndarray) -> bytes:
    """The fingerprint of a text from its classes and the steps at which the walk leaves them."""
    if not len(left):
        return bytes(WIDTH)
    scale, end = 0, int(left[-1])
    while steps_in(scale) < end:
        scale += 1
    steps = sampled(scale)[0]
    used = int(np.searchsorted(steps, end))
    steps = steps[:used]
    at = np.searchsorted(left, steps, "right")
    h = (steps.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(GRAM):
        inside = at + k < len(sym)
        h = (h ^ np.where(inside, _CLASS[sym[np.where(inside, at + k, 0)]], np.uint64(0))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    bits = (h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(63)).astype(np.uint8)
    return bytes([scale]) + used.to_bytes(2, "little") + np.packbits(bits).tobytes().ljust(SAMPLED // 8, b"\0")


def _embedded(texts: list[str], following: list[str | None]) -> Iterator[tuple[bytes, bytes | None]]:
    """The fingerprint of each text, and of each that has one following, edited (see `edited`); the walk over the first half serves both."""
    at = 0
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    total = np.cumsum(n)
    while at < len(texts):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + CHUNK, "right")))
        ends = total[at:to] - base
        sym = _symbols("".join(texts[at:to]))
        left = _walked(sym, ends, np.zeros(to - at, np.int64))
        half = [(i, int(n[i]) - int(n[i]) // 2, x[: int(n[i]) // 2]) for i, x in enumerate(following[at:to], at) if x is not None]
        more = _symbols("".join(x for _, _, x in half))
        first = np.array([int(ends[i - at] - n[i]) for i, _, _ in half], np.int64)
        own = np.array([k for _, k, _ in half], np.int64)
        start = np.where(own > 0, left[np.maximum(first + own - 1, 0)] if len(left) else 0, 0)
        more_ends = np.cumsum(np.fromiter((len(x) for _, _, x in half), np.int64, len(half)))
        more_left = _walked(more, more_ends, start)
        new: dict[int, bytes] = {}
        for (i, k, x), a, z in zip(half, first.tolist(), more_ends.tolist(), strict=True):
            part = slice(z - len(x), z)
            new[i] = _code(np.concatenate((sym[a : a + k], more[part])), np.concatenate((left[a : a + k], more_left[part])))
        for i in range(at, to):
            z = int(ends[i - at])
            a = z - int(n[i])
            yield _code(sym[a:z], left[a:z]), new.get(i)
        at = to


def fingerprints(texts: list[str]) -> np.ndarray:
    """WIDTH bytes of each text."""
    codes = b"".join(code for code, _ in _embedded(texts, [None] * len(texts)))
    return np.frombuffer(codes, np.uint8).reshape(-1, WIDTH)


def at_scale(codes: np.ndarray, scale: int) -> np.ndarray:
    """Fingerprints of one scale, as they are at a later one."""
    now = int(codes[0, 0])
    if now == scale:
        return codes
    used = codes[:, 1:3].copy().view("<u2")[:, 0].astype(np.int64)
    bits = np.unpackbits(codes[:, 3:], axis=1)
    while now < scale:
        now += 1
        kept = sampled(now)[1]
        used = np.searchsorted(kept, used)
        bits = np.concatenate((bits[:, kept], np.zeros((len(bits), SAMPLED - len(kept)), np.uint8)), axis=1)
    return np.concatenate((np.full((len(codes), 1), scale, np.uint8), used.astype("<u2")[:, None].view(np.uint8), np.packbits(bits, axis=1)), axis=1)


#: The first k bits of a fingerprint's outputs, for each k.
_FIRST = np.packbits(np.tri(SAMPLED + 1, SAMPLED, -1, dtype=np.uint8), axis=1)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The likeness of fingerprints of one scale, any shape but for the last axis."""
    used = [np.ascontiguousarray(c[..., 1:3]).view("<u2")[..., 0].astype(np.int64) for c in (x, y)]
    both, most = np.minimum(*used), np.maximum(*used)
    differ = np.bitwise_count((x[..., 3:] ^ y[..., 3:]) & _FIRST[both]).sum(axis=-1, dtype=np.int64)
    return np.where(most > 0, np.maximum(both - 2 * differ, 0) / np.maximum(most, 1), 1.0)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 to 1, for each row of two tables of fingerprints."""
    out = np.empty(len(x))
    scales = np.stack((x[:, 0], y[:, 0]), axis=1)
    for pair in np.unique(scales, axis=0):
        rows = np.flatnonzero((scales == pair).all(axis=1))
        out[rows] = _agreement(at_scale(x[rows], int(pair.max())), at_scale(y[rows], int(pair.max())))
    return out


def edited(own: str, following: str) -> str:
    """The last half of `own` replaced by the beginning of `following`."""
    k = len(own) // 2
    return own[: len(own) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """part, ghost, doc_id, text, sorted: a part's rows by descending doc_id, then (ghost) the row that follows them.

    Texts move once. Parts are ranges of doc_id between quantiles; only the first row of each part goes to two places.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = ranged(rows, "doc_id", 4 * partitions(spark))
    firsts = sorted(((r._part, r.top) for r in keyed.groupBy("_part").agg(F.max("_id").alias("top")).collect()), reverse=True)  # a row for each part
    to = [(top, firsts[k - 1][0]) for k, (_, top) in enumerate(firsts)]
    ghosts = F.broadcast(spark.createDataFrame(to or [(None, None)], "_id long, _to int"))
    places = F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("ghost")))
    places = F.when(F.col("_to").isNull(), places).otherwise(F.concat(places, F.array(F.struct(F.col("_to").alias("part"), F.lit(1).alias("ghost")))))
    dealt = keyed.join(ghosts, "_id", "left").select(F.explode(places).alias("_p"), "doc_id", "text").select("_p.part", "_p.ghost", "doc_id", "text")
    return dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))

def op5_editprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            # each but the last is followed by the next one, unless that is of another part or it is itself a ghost
            texts = [r[3] for r in rows]
            use = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            following: list[str | None] = [None] * len(rows)
            for i in use:
                following[i] = texts[i + 1]
            codes = list(_embedded(texts, following))
            table_of = lambda xs: np.frombuffer(b"".join(xs), np.uint8).reshape(-1, WIDTH)
            own, new, nxt = table_of(codes[i][0] for i in use), table_of(codes[i][1] for i in use), table_of(codes[i + 1][0] for i in use)
            cols = [
                pa.array([rows[i][2] for i in use], pa.int64()),
                pa.array([len(texts[i]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(edited(texts[i], texts[i + 1]).encode()).hexdigest() for i in use], pa.string()),
                pa.array([codes[i][0].hex() for i in use], pa.string()),
                pa.array([codes[i][1].hex() for i in use], pa.string()),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, nxt)),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size > CHUNK and len(held) > 1:
                    yield flush(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield flush(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(work, schema)


def prints(docs: DataFrame) -> DataFrame:
    """doc_id and code (WIDTH bytes) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fp = fingerprints(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f.tobytes() for f in fp], pa.binary())], names=["doc_id", "code"])

    rows = session(docs.sparkSession) and docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, code binary")


#: What the bands find at least of pairs whose likeness is at the threshold, if their bits differ independently.
RECALL = 0.99


def bands(least: float) -> tuple[int, int]:
    """Bits of a band and number of bands: the longest bands, of all sampled bits together, with RECALL at that likeness."""
    agree = (1 + least) / 2
    for rows in (32, 16, 8):
        if 1 - (1 - agree**rows) ** (SAMPLED // rows) >= RECALL:
            return rows, SAMPLED // rows
    raise ValueError("the bands don't find texts of so little likeness")


@cache
def _positions(scale: int, rows: int, many: int) -> np.ndarray:
    n = len(sampled(scale)[0])
    rng = np.random.default_rng((scale, rows))
    return rng.permutation(n)[: rows * many].reshape(many, rows) if n >= rows * many else rng.integers(0, n, (many, rows))


def banded(codes: DataFrame, least: float) -> DataFrame:
    """key, id, code: each fingerprint (id, code) in the bands of its scale and of the next one, as it is at that scale.

    Texts of that likeness are of one scale or of two that follow on each other.
    """
    rows, many = bands(least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            table_of = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, WIDTH)
            for scale in np.unique(table_of[:, 0]).tolist():
                own = np.flatnonzero(table_of[:, 0] == scale)
                for at in (scale, scale + 1):
                    now = at_scale(table_of[own], at)
                    bits = np.unpackbits(now[:, 3:], axis=1)[:, _positions(at, rows, many)]
                    keys = np.packbits(bits, axis=2).astype(np.uint64)
                    key = np.full((len(own), many), at, np.uint64) * np.uint64(1 << 8) + np.arange(many, dtype=np.uint64)
                    for k in range(keys.shape[2]):
                        key = (key ^ keys[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), batch.column("id").take(pa.array(np.repeat(own, many))), pa.array([c.tobytes() for c in now], pa.binary()).take(pa.array(np.repeat(np.arange(len(own)), many)))],
                        names=["key", "id", "code"],
                    )

    return codes.select("id", "code").mapInArrow(work, "key long, id long, code binary")


class Like:
    """Fingerprints of a band, which are of one scale, of a likeness of `least` or more."""

    def __init__(self, least: float) -> None:
        self.least = least

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return forest(len(codes), lambda a, b: _agreement(codes[a][:, None, :], codes[b][None, :, :]) >= self.least, 2 * WIDTH)

    def two(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _agreement(x, y) >= self.least


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and class_id (the smallest doc_id that links reach) of every row with a doc_id: links are of a likeness of `least` or more.

    Candidates share a band of sampled bits; equal fingerprints are one node. A link of exactly that likeness is found with a
    probability of RECALL, closer ones with more.
    """
    codes = prints(docs).filter("doc_id is not null")
    nodes = codes.groupBy("code").agg(F.min("doc_id").alias("id"))
    roots = components(bucketed(banded(nodes, least), Like(least), "editprint", WIDTH))
    return codes.join(nodes, "code").join(roots, F.col("id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "id").alias("class_id"))
