"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its hashed terms: words and the beginnings of words; neighbouring words are no
terms of their own. The machine adds to the linear weights an inner product of latent vectors for every
pair of terms, so that it learns that an insult beside a mention of a group weighs more than both alone.
Terms that go with the label enter it, and terms of which a pair goes with the label beyond what both do alone, so
that a pair whose halves mean nothing is learned too. It is trained here by logistic loss on a bounded sample of
labelled rows; a calibrated scale and offset turn the margin into a probability.

Defined results: null and empty texts get the score of no terms, below every threshold; labels that are
null, or of documents that don't exist, are not learned from; where a document has several labels the
highest counts; of rows of one doc_id one is learned from, that of the least hash of its text; without any label of both kinds the score is 0 for all; repeated rows get equal scores; an
empty table gives an empty result; other columns are never inputs and are carried along where asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, session, slices, unused, utf8

#: Labelled rows that are learned from at most: those of the lowest hash of doc_id.
SAMPLE = 12_000
BITS, FACTORS, EPOCHS, SEED = 18, 8, 30, 7
#: Bytes of text that are scored at a time; each takes some 70 bytes of terms and vectors.
SLICE_BYTES = 512 << 10
#: Terms enter the machine if their G-test against the label reaches this, or if with another one it reaches PAIR_TELLING beyond both alone.
TELLING, PAIR_TELLING = 14.0, 40.0
#: Terms of which pairs are tested at most: those in the most documents of the sample.
PAIR_TERMS = 1024

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Terms(dict):
    """Word to its hashed terms: itself, and its beginnings of 4, 5 and 6 characters."""

    most = 100_000

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("utf-8", "replace")
        keys = {b"w:" + word, *(f"p{n}:{text[:n]}".encode() for n in (4, 5, 6) if len(text) >= n)}
        out = tuple(sorted(xxhash.xxh32_intdigest(k) & ((1 << BITS) - 1) for k in keys))
        if len(self) >= self.most:
            self.clear()
        self[word] = out
        return out

    def of(self, text: bytes) -> set[int]:
        words = set(text.translate(_SPLIT).split())
        out: set[int] = set()
        for x in map(self.__getitem__, words):
            out.update(x)
        return out


@dataclass
class Machine:
    """w0 + sum of w_i + sum over pairs of <v_i, v_j>, over a set of terms; then scale, offset and logistic function."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    scale: float = 1.0
    offset: float = 0.0

    def margins(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.full(len(n), self.w0)
        has = np.flatnonzero(n)
        if len(has):
            at = (np.cumsum(n) - n)[has]
            v = self.v[flat]
            total = np.add.reduceat(v, at, axis=0)
            own = np.add.reduceat((v * v).sum(axis=1), at)
            out[has] += np.add.reduceat(self.w[flat], at) + 0.5 * ((total * total).sum(axis=1) - own)
        return out

    def scores(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margins(flat, n) + self.offset, -40, 40)))


def _g(cells: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Twice the sum of observed times the logarithm of observed to expected."""
    return sum(np.where(o > 0, 2 * o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0) for o, e in cells)


def telling(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which terms go with a label more than chance explains, alone or as one of a pair."""
    size = 1 << BITS
    pos = np.zeros(size)
    all_ = np.zeros(size)
    for a, y in zip(docs, labels.tolist(), strict=True):
        all_[a] += 1
        if y:
            pos[a] += 1
    n, p = len(docs), float(labels.sum())
    share = max(1.0, p) / n

    def alone(pos: np.ndarray, all_: np.ndarray) -> np.ndarray:
        return _g([(pos, all_ * share), (all_ - pos, all_ * (1 - share)), (p - pos, (n - all_) * share), (n - all_ - p + pos, (n - all_) * (1 - share))])

    use = (alone(pos, all_) >= TELLING) & (all_ >= 3)
    some = np.argsort(-all_, kind="stable")[:PAIR_TERMS]
    some = np.sort(some[(all_[some] >= 8) & (all_[some] < n)])
    at = np.full(size, -1)
    at[some] = np.arange(len(some))
    both, good = np.zeros((len(some),) * 2, np.float32), np.zeros((len(some),) * 2, np.float32)
    for lo in range(0, n, 2048):
        part = docs[lo : lo + 2048]
        x = np.zeros((len(part), len(some)), np.float32)
        for i, a in enumerate(part):
            held = at[a]
            x[i, held[held >= 0]] = 1
        both += x.T @ x
        toxic = x[labels[lo : lo + 2048] == 1]
        good += toxic.T @ toxic
    single, count, hit = alone(pos[some], all_[some]), all_[some], pos[some]
    for i in range(len(some)):
        # the four cells of having the one and the other, each by label
        cells = [(both[i], good[i]), (count[i] - both[i], hit[i] - good[i]), (count - both[i], hit - good[i]), (n - count[i] - count + both[i], p - hit[i] - hit + good[i])]
        joint = _g([z for all_in, pos_in in cells for z in ((pos_in, all_in * share), (all_in - pos_in, all_in * (1 - share)))])
        paired = np.flatnonzero(joint - single - single[i] >= PAIR_TELLING)
        if len(paired):
            use[some[i]] = True
            use[some[paired]] = True
    return use


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """Adaptive gradient steps over small batches of the telling terms; deterministic."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    use = telling(docs, labels)
    share = min(0.99, max(0.01, float(labels.mean())))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32))
    m.v[~use] = 0  # what was not learned has no weight and doesn't interact
    arrays = [a[use[a]] for a in docs]
    gw, gv, g0 = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(arrays))
        for lo in range(0, len(order), 64):
            rows = order[lo : lo + 64]
            n = np.array([len(arrays[i]) for i in rows])
            err0 = 1 / (1 + np.exp(-m.w0)) - labels[rows]
            flat = np.concatenate([arrays[i] for i in rows])
            who = np.repeat(np.arange(len(rows)), n)
            v = m.v[flat]
            total = np.stack([np.bincount(who, v[:, k], len(rows)) for k in range(FACTORS)], axis=1)
            margin = m.w0 + np.bincount(who, m.w[flat], len(rows)) + 0.5 * ((total**2).sum(1) - np.bincount(who, (v * v).sum(1), len(rows)))
            err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows] if len(flat) else err0
            terms, inv = np.unique(flat, return_inverse=True)
            dw = np.bincount(inv, err[who], len(terms)).astype(np.float32) + 2e-3 * m.w[terms]
            each = err[who, None] * (total[who] - v)
            dv = np.stack([np.bincount(inv, each[:, k], len(terms)) for k in range(FACTORS)], axis=1).astype(np.float32) + 1e-2 * m.v[terms]
            gw[terms] += dw**2
            gv[terms] += dv**2
            d0 = float(err.sum())
            g0 += d0 * d0
            m.w[terms] -= 0.2 * dw / np.sqrt(gw[terms])
            m.v[terms] -= 0.02 * dv / np.sqrt(gv[terms])
            m.w0 -= 0.1 * d0 / np.sqrt(g0)
    return m


def calibrate(m: Machine, docs: list[np.ndarray], labels: np.ndarray) -> None:
    """Scale and offset of least logistic loss on rows that were not trained on."""
    n = np.array([len(d) for d in docs])
    x = m.margins(np.concatenate(docs), n)
    a, b = 1.0, 0.0
    y = (labels * len(labels) + 1) / (len(labels) + 2) if len(labels) else labels
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 1e-2 * (a - 1), (p - y).sum()])
        s = p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(0.05, a - np.clip(step[0], -0.5, 0.5)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    m.scale, m.offset = float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """Learn from at most `sample` labelled rows whose crc32(doc_id) mod 4 is not 2, whole texts.

    Four fifths train the machine, the rest calibrates it. None if one of the labels is missing.
    """
    session(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    ids = F.broadcast(known.orderBy("h", "doc_id").limit(sample))  # `sample` rows of three numbers at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(ids, "doc_id").select("h", "doc_id", "toxic", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        terms = Terms()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sets = [sorted(terms.of(t)) for t in texts]
            order = pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], order, pa.array(sets, pa.list_(pa.int32()))], names=["h", "doc_id", "toxic", "at", "terms"])

    each = rows.mapInArrow(hashed, "h long, doc_id long, toxic int, at long, terms array<int>")
    got = each.groupBy("h", "doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("terms", "at").alias("terms")).toArrow()  # a row for each of the sample
    sets = {}
    for h, doc, y, terms in zip(*(got.column(c).to_numpy() for c in ("h", "doc_id", "toxic")), got.column("terms"), strict=True):
        sets[h, doc] = y, terms.values.to_numpy().astype(np.int64)
    order = sorted(sets)
    y = np.array([sets[k][0] for k in order])
    arrays = [sets[k][1] for k in order]
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(arrays)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        return train(arrays, y)
    m = train([s for s, h in zip(arrays, held, strict=True) if not h], y[~held])
    calibrate(m, [s for s, h in zip(arrays, held, strict=True) if h], y[held])
    return m


def scored(docs: DataFrame, machine: Machine | None, name: str = "score") -> DataFrame:
    """`docs` with a double column `name`: the score of each whole text."""
    spark = session(docs.sparkSession)
    if machine is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = spark.sparkContext.broadcast(machine)  # 2^BITS * (FACTORS + 1) floats

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        terms, m = Terms(), shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy()
            out = []
            for a, b in slices(lengths, SLICE_BYTES):
                sets = [terms.of(t or b"") for t in texts.slice(a, b - a).to_pylist()]
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                # in a fixed order, so that equal texts get equal sums
                out.append(m.scores(np.fromiter((t for s in sets for t in sorted(s)), np.int64, int(n.sum())), n))
            score = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=batch.schema.names)

    return (rows := docs.withColumn(name, F.lit(0.0))).mapInArrow(work, rows.schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, with the columns they came with."""
    (score,) = unused(docs.columns, "score")
    return scored(docs, fit(docs, labels), score).filter(F.col(score) < threshold).select(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return scored(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
