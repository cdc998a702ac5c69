"""Repeated byte strings by suffix arrays, which a linear grouping construction makes.

Every `length`-byte window has a minimizer: the leftmost of its shortest grams with the least hash. Equal
windows have it at the same offset, so windows meet in a bucket under the bytes that all windows of a cell
(a minimizer and a range of offsets) share. In a bucket the strings around that core are cut where two of
them part, and the pieces renamed to symbols; a suffix array over the symbols of many buckets shows with its
longest common prefixes which windows occur twice. Equal strings of a bucket are one class that stands for
all its members, so that groups of copies neither fill a bucket nor a task; a bucket of more than BUCKET
classes is cut by finer ranges of offsets, which share more, until it is small: a range of one offset has one class.
Where a text repeats itself without a break, its cells of one class are one row.

The suffix array is built in two phases: groups of suffixes, by first symbol, are taken in descending order, and
the suffixes before them, found by pointers to the previous suffix of a lower group, move up into groups of their
own, until each group is a Lyndon prefix; then each group's order is emitted from what is already placed, and
nothing is renamed or sorted again.

Defined results: null and empty texts have no bytes; texts shorter than `length` lose nothing; rows of equal text
are different places, whatever their doc_id, null among them; texts of any length are worked on in bounded pieces;
an empty table gives an empty result; other columns don't matter, and are carried by `dedup`.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, groups, release, session, slices, starts, table, trimmed, unused, utf8

#: Bytes of a gram, and bytes of text that are hashed at a time.
GRAM, PIECE = 32, 512 << 10
#: Classes in a bucket that goes to a suffix array, and symbols in one array.
BUCKET, SYMBOLS = 256, 60_000
#: A larger bucket is cut in PARTS by ranges of offsets, again and again.
PARTS = 4
#: Texts that a task remembers, so as not to list a copy again.
SEEN = 50_000

_rng = np.random.default_rng(400)
_GRAM = _rng.integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of whole numbers in ascending order, in linear time."""
    n = len(symbols) + 1  # with an end that is less than all
    if n == 1:
        return np.zeros(0, np.int64)
    _, rank, count = np.unique(symbols, return_inverse=True, return_counts=True)
    first = np.concatenate(([1], 1 + np.cumsum(count)[:-1]))
    group: list[int] = [*first[rank].tolist(), 0]  # a group is named by the number of suffixes in lower groups
    order = np.argsort(rank, kind="stable").tolist()
    members: dict[int, list[int]] = {0: [n - 1]}
    begins = bytearray(n)
    begins[0] = 1
    for a, c in zip(first.tolist(), count.tolist(), strict=True):
        members[a] = order[a - 1 : a - 1 + c]
        begins[a] = 1
    size = {a: len(x) for a, x in members.items()}
    before = [-1] * n

    at = n
    while (at := begins.rfind(1, 0, at)) > 0:
        own = [i for i in members[at] if group[i] == at] if size[at] != len(members[at]) else members[at]
        own.sort()
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= at:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if not pointed:
            continue
        by_times: dict[int, dict[int, list[int]]] = {}
        for j, times in pointed.items():
            by_times.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(by_times, reverse=True):
            for old, moved in by_times[times].items():
                if len(moved) == size[old]:
                    continue  # the whole group moves, and keeps its place
                size[old] -= len(moved)
                new = old + size[old]
                begins[new] = 1
                members[new], size[new] = moved, len(moved)
                for j in moved:
                    group[j] = new

    out = [-1] * n
    out[0] = n - 1
    free = list(range(n))  # the first free place of a group, by its name
    placed = bytearray(n)
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return np.array(out[1:], np.int64)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    size = 1
    while size < width:
        step = min(size, width - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


_powers: list[np.ndarray] = []


def _sums(b: np.ndarray) -> list[np.ndarray]:
    """Sums from which the hash of any range follows, for two hashes."""
    n = len(b)
    if not _powers or len(_powers[0]) <= n:
        _powers.clear()
        for base in _BASE:
            for x in (base, pow(base, -1, 1 << 64)):
                p = np.full(max(n, PIECE * 2) + 1, x, np.uint64)
                p[0] = 1
                _powers.append(np.multiply.accumulate(p))
    out = []
    for k in range(2):
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[k][b] * _powers[2 * k][:n], out=s[1:])
        out.append(s)
    return out


def _hash(sums: list[np.ndarray], a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return (sums[k][b] - sums[k][a]) * _powers[2 * k + 1][a]


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Cells:
    """Offsets of a minimizer in a window, cut in ranges: windows of a range share `core`, and what they span besides."""

    def __init__(self, length: int) -> None:
        self.length, self.gram = length, min(GRAM, max(1, length // 4))
        self.width = length - self.gram + 1
        half = (self.width + 1) // 2
        self.ranges = [(0, half - 1), (half, self.width - 1)] if self.width > 1 else [(0, 0)]

    def minimizers(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position of each minimizer, with the first and last window of which it is the one."""
        h = _GRAM[b]
        size = 1
        while size < self.gram:
            step = min(size, self.gram - size)
            h = h[:-step] * np.uint32(0x9E3779B1 + 2 * size) + h[step:] if step == size else h[:-step] * np.uint32(0x85EBCA6B) + h[step:] * np.uint32(3)
            size += step
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        keyed = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        at = (_least(keyed, self.width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = starts(at)
        return at[first[:-1]], first[:-1], first[1:] - 1

    def of(self, b: np.ndarray, ends: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text number, minimizer, cell, two hashes of the core, hash of the content, for the texts in `b`, and how far on the last of equal cells is.

        Equal cells that follow on each other, at most `length` apart, are one: together they cover one range.
        `cut` tells for each text whether more of it comes before and after; cells that reach there are left out.
        """
        begin = np.concatenate(([0], ends[:-1]))
        at, lo, hi = self.minimizers(b)
        sums = _sums(b)
        out = []
        for cell, (near, far) in enumerate(self.ranges):
            g, a, z = at, np.maximum(lo, at - far), np.minimum(hi, at - near)
            # windows of a run may lie in several texts: those of the text of the minimizer that stay inside it
            own = np.searchsorted(ends, g, "right")
            a, z = np.maximum(a, begin[own]), np.minimum(z, ends[own] - self.length)
            use = (a <= z) & ~(cut[own, 0] & (g - far < begin[own])) & ~(cut[own, 1] & (g - near + self.length > ends[own]))
            g, own = g[use], own[use]
            c0, c1 = g - near, g - far + self.length
            x, y = np.maximum(g - far, begin[own]), np.minimum(g - near + self.length, ends[own])
            tag = np.full(len(g), cell, np.uint64)
            k1, k2, c = _mixed(tag, _hash(sums, c0, c1, 0)), _mixed(tag, _hash(sums, c0, c1, 1)), _mixed(_hash(sums, x, y, 0), _hash(sums, x, y, 1), g - x, y - g)
            same = (own[1:] == own[:-1]) & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (c[1:] == c[:-1]) & (g[1:] - g[:-1] <= self.length)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), ~same)))
            last = np.append(first[1:] - 1, len(g) - 1) if len(g) else first
            out.append((own[first], (g - begin[own])[first], tag.astype(np.int64)[first], k1[first], k2[first], c[first], g[last] - g[first]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parts(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of a text that overlap by enough for every window and all it may span."""
    if n <= PIECE:
        yield 0, n
        return
    for a in range(0, max(1, n - 4 * length), PIECE):
        yield max(0, a - 2 * length), min(n, a + PIECE + 4 * length)


def members(texts: DataFrame, length: int) -> DataFrame:
    """h1, h2, at, cell, k1, k2, c, reach: each cell of the texts (h1, h2, text); `reach` tells how far on the last of equal ones is."""
    cells = Cells(length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            h1, h2 = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
            rows: list[tuple[int, int, bytes, tuple[bool, bool]]] = []
            for i, t in enumerate(batch.column("text")):
                if (h1[i], h2[i]) in seen or len(text := t.as_py()) < length:
                    continue
                seen.add((h1[i], h2[i]))
                rows.extend((i, a, text[a:z], (a > 0, z < len(text))) for a, z in _parts(len(text), length))
            if len(seen) > SEEN:
                seen.clear()
            for lo, hi in slices(np.array([len(r[2]) for r in rows], np.int64), PIECE):
                part = rows[lo:hi]
                b = np.frombuffer(b"".join(r[2] for r in part), np.uint8)
                own, at, cell, k1, k2, c, reach = cells.of(b, np.cumsum([len(r[2]) for r in part]), np.array([r[3] for r in part]))
                first = np.array([r[1] for r in part])
                who = [part[o][0] for o in range(len(part))]
                ids = [pa.array(np.array([h[w] for w in who], np.int64)[own]) for h in (h1, h2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(at + first[own]), pa.array(cell.astype(np.int8)), pa.array(k1), pa.array(k2), pa.array(c), pa.array(reach)], names=["h1", "h2", "at", "cell", "k1", "k2", "c", "reach"])
        trimmed()

    return texts.mapInArrow(work, "h1 long, h2 long, at long, cell byte, k1 long, k2 long, c long, reach long")


_PIECES = ["k1", "k2", "c", "near", "far", "before", "after"]


def pieces_of(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """k1, k2, c, near, far, before, after: the bytes beside the core of each wanted class (of h1, h2, at, cell, k1, k2, c).

    A row may come several times where a text does.
    """
    ranges = Cells(length).ranges
    asked = table(wanted.groupBy("h1", "h2").agg(F.collect_list(F.struct("at", "cell", "k1", "k2", "c")).alias("asked")), "asked")
    rows = texts.join(asked, ["h1", "h2"]).select("h1", "h2", "text", "asked")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            who = zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)
            for h, t, q in zip(who, batch.column("text"), batch.column("asked"), strict=True):
                if h in seen:
                    continue  # a copy
                seen.add(h)
                text, flat = t.as_py(), q.values
                at, cell = flat.field("at").to_pylist(), flat.field("cell").to_pylist()
                before, after, bounds = [], [], [ranges[x] for x in cell]
                for g, (near, far) in zip(at, bounds, strict=True):
                    before.append(text[max(0, g - far) : g - near])
                    after.append(text[g - far + length : g - near + length])
                yield pa.RecordBatch.from_arrays([*(flat.field(x) for x in ("k1", "k2", "c")), *(pa.array([x[i] for x in bounds], pa.int32()) for i in (0, 1)), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=_PIECES)
            if len(seen) > SEEN:
                seen.clear()
        trimmed()

    return rows.mapInArrow(work, "k1 long, k2 long, c long, near int, far int, before binary, after binary")


def _common(rows: list[bytes]) -> tuple[list[int], list[int]]:
    """For each row the longest prefix that it shares with another; all lengths at which two rows part."""
    order = sorted(range(len(rows)), key=rows.__getitem__)
    best = [0] * len(rows)
    cuts = set()
    for i, j in zip(order, order[1:], strict=False):
        x, y = rows[i], rows[j]
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            lo, hi = 0, n
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid)
            n = lo
        cuts.add(n)
        best[i], best[j] = max(best[i], n), max(best[j], n)
    return best, sorted(cuts - {0})


def bucket_symbols(before: list[bytes], after: list[bytes], core: int, length: int) -> list[tuple[int, int, list, list[int]]]:
    """Rows that may hold a repeated window: row number, bytes before the core, symbols, their lengths."""
    mirrored = [x[::-1] for x in before]
    left, left_cuts = _common(mirrored)
    right, right_cuts = _common(after)
    out = []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if a + core + b < length:
            continue
        symbols, sizes = [], []
        last = 0
        for cut in left_cuts:
            if cut > a:
                break
            symbols.append((-cut, mirrored[i][last:cut]))
            sizes.append(cut - last)
            last = cut
        symbols.reverse()
        sizes.reverse()
        symbols.append(())
        sizes.append(core)
        last = 0
        for cut in right_cuts:
            if cut > b:
                break
            symbols.append((cut, after[i][last:cut]))
            sizes.append(cut - last)
            last = cut
        out.append((i, a, symbols, sizes))
    return out


def repeated_runs(symbols: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose suffix shares `length` or more with another one, and how much: `symbols` below 0 are all different."""
    sa = suffix_array(symbols)
    a, b = sa[:-1], sa[1:]
    shared = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    padded = np.append(symbols, -1 - len(symbols) * 2)
    step = 0
    while len(live):
        x, y = a[live] + step, b[live] + step
        live = live[(x < len(symbols)) & (y < len(symbols))]
        x, y = a[live] + step, b[live] + step
        same = padded[x] == padded[y]
        live = live[same]
        shared[live] += sizes[x[same]]
        step += 1
    best = np.zeros(len(symbols), np.int64)
    np.maximum.at(best, a, shared)
    np.maximum.at(best, b, shared)
    found = np.flatnonzero(best >= length)
    return found, best[found]


def search(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """k1, k2, c, from, to: what is repeated of each class, relative to its minimizer."""
    held: list[tuple[int, int, int, int, int]] = []  # k1, k2, c, where it begins relative to the minimizer, first symbol
    names: list[int] = []
    sizes: list[int] = []
    fresh = 0

    def flush() -> pa.RecordBatch:
        size = np.array(sizes, np.int64)
        where, much = repeated_runs(np.array(names, np.int64), size, length)
        first = np.array([x[4] for x in held], np.int64)
        own = np.searchsorted(first, where, "right") - 1
        ends = np.concatenate(([0], np.cumsum(size)))
        begin = np.array([x[3] for x in held], np.int64)[own] + ends[where] - ends[first[own]]
        cols = [pa.array(np.array([x[k] for x in held], np.int64)[own]) for k in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(begin), pa.array(begin + much)], names=["k1", "k2", "c", "from", "to"])

    for t in groups(batches, "k1", 1 << 14):
        keys = np.stack([t.column(x).to_numpy() for x in ("k1", "k2", "c")], axis=1)
        t = t.filter(pa.array(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))))  # each class once
        keys = np.stack([t.column(x).to_numpy() for x in ("k1", "k2")], axis=1)
        edge = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
        c, bounds = t.column("c").to_numpy(), [t.column(x).to_numpy() for x in ("near", "far")]
        before, after = t.column("before").to_pylist(), t.column("after").to_pylist()
        for lo, hi in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            if hi - lo < 2:
                continue
            near, far = (int(x[lo]) for x in bounds)
            table_: dict = {}
            base = fresh
            for i, a, symbols, lengths in bucket_symbols(before[lo:hi], after[lo:hi], length - far + near, length):
                held.append((int(keys[lo, 0]), int(keys[lo, 1]), int(c[lo + i]), -near - a, len(names)))
                for s in symbols:
                    names.append(table_.setdefault(s, base + len(table_)))
                sizes.extend(lengths)
                names.append(-1 - len(names))  # nothing equals it
                sizes.append(0)
            fresh = base + len(table_)
            if len(names) > SYMBOLS:
                yield flush()
                held, names, sizes, fresh = [], [], [], 0
    if held:
        yield flush()
    trimmed()


def finer(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Each row's range of offsets cut in `parts`, whose windows share a longer core: k1, k2, c, near, far, before, after under new hashes, with o1, o2, oc of the row."""

    def longs(digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)

    for batch in batches:
        out: list[tuple] = []
        for k1, k2, c, near, far, before, after in zip(*(batch.column(x).to_pylist() for x in _PIECES), strict=True):
            width = far - near + 1
            for i in range(parts):
                lo, hi = near + i * width // parts, near + (i + 1) * width // parts - 1
                left, right = lo - near, far - hi  # what the core gains on either side
                if hi < lo or left > len(before) or right > len(after):
                    continue
                cut = len(before) - left
                own = struct.pack("<qqii", k1, k2, lo, hi)
                j1, j2 = longs(xxhash.xxh3_128_digest(own + before[cut:] + b"|" + after[:right]))
                x, y = before[max(0, cut - (hi - lo)) : cut], after[right : right + hi - lo]
                d, _ = longs(xxhash.xxh3_128_digest(struct.pack("<i", len(x)) + x + y))
                out.append((j1, j2, d, lo, hi, x, y, k1, k2, c))
        types = [*[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.binary()] * 2, *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[*_PIECES, "o1", "o2", "oc"])


def twice(rows: DataFrame, by: list[str], first: Column, last: Column) -> DataFrame:
    """The values of `by` that have two or more places, of rows that have places from `first` to `last`."""
    return rows.groupBy(*by).agg(several_places(first, last).alias("several")).filter("several").drop("several")


def several_places(first: Column, last: Column) -> Column:
    """Whether a group of rows has two or more places. Either end of a row may be the least or the greatest of them, as places are hashes."""
    return F.min(F.least(first, last)) != F.max(F.greatest(first, last))


def repeated_parts(rows: DataFrame, length: int) -> DataFrame:
    """k1, k2, c, from, to of what is repeated among the classes of each bucket (rows as of `pieces_of`).

    Buckets of up to BUCKET classes go to suffix arrays. In larger ones the range is cut in finer ones, of which equal rows are
    one class, and these buckets are taken likewise; the core of a range of one offset is the whole window.
    """
    key = ["k1", "k2"]
    sizes = table(rows.select(*key, "c").distinct().groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET), "hot-buckets")
    any_hot = not sizes.isEmpty()
    cold = rows.join(sizes, key, "left_anti") if any_hot else rows
    cold = cold.select(*_PIECES).repartition("k1").sortWithinPartitions("k1", "k2", "c")
    found = cold.mapInArrow(lambda it: search(it, length), "k1 long, k2 long, c long, `from` long, `to` long")
    if not any_hot:
        return found
    hot = rows.join(sizes.select(*key), key).select(*_PIECES)
    fine = table(hot.mapInArrow(lambda it: finer(it, PARTS), "k1 long, k2 long, c long, near int, far int, before binary, after binary, o1 long, o2 long, oc long"), "finer")
    one = F.min(F.struct("near", "far", "before", "after")).alias("one")
    classes = fine.groupBy(*key, "c").agg(one, (F.min("oc") != F.max("oc")).alias("known"))
    classes = table(classes.select(*key, "c", "one.*", "known"), "finer-classes")
    several = table(classes.groupBy(*key).agg(F.count("*").alias("n"), F.min("known").alias("all")).filter("n > 1 and not all").select(*key), "several")
    more = repeated_parts(classes.join(several, key), length)
    known = classes.filter("known").select(*key, "c", (-F.col("far")).cast("long").alias("from"), (length - F.col("near")).cast("long").alias("to"))
    parts = table(more.unionByName(known), "finer-found")
    back = fine.select(*key, "c", "o1", "o2", "oc").join(parts, [*key, "c"])
    return found.unionByName(back.select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), F.col("oc").alias("c"), "from", "to"))


def repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """h1, h2, spans (from, to; may overlap) of each text of `docs` (h1, h2, text) in which a window is repeated.

    A text that comes more than once is repeated as a whole.
    """
    session(docs.sparkSession)
    if length < 8:
        raise ValueError("windows of 8 bytes or more are expected")
    key, text = ["k1", "k2"], ["h1", "h2"]
    long = docs.filter(F.length("text") >= length)
    place, last = F.xxhash64("h1", "h2", "at"), F.xxhash64("h1", "h2", F.col("at") + F.col("reach"))
    every = table(members(long, length), "cells")
    cores = table(twice(every, key, place, last), "cores")
    own = table(every.join(cores, key), "repeated-cells")
    dropped(every, cores)
    one = F.min(F.struct("h1", "h2", "at", "cell")).alias("one")
    classes = own.groupBy(*key, "c").agg(one, several_places(place, last).alias("known"))
    classes = table(classes.select(*key, "c", "one.*", "known"), "classes")
    several = classes.groupBy(*key).agg(F.count("*").alias("n"), F.min("known").alias("all")).filter("n > 1 and not all")
    several = table(several.select(*key), "several")
    asked = table(pieces_of(classes.join(several, key).drop("known"), long, length), "pieces")
    dropped(several)
    # the places of a class that is known to repeat are covered from the first byte of its content to the last
    ranges = Cells(length).ranges
    near, far = (F.element_at(F.array(*[F.lit(x[i]) for x in ranges]), F.col("cell") + 1) for i in (0, 1))
    known = classes.filter("known").select(*key, "c", (-far).cast("long").alias("from"), (length - near).cast("long").alias("to"))
    part = repeated_parts(asked, length).unionByName(known).groupBy(*key, "c").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("s"))
    joined = F.aggregate("s", F.array().cast("array<struct<from:bigint,to:bigint>>"), _join)  # of one cell: a few hundred at most
    part = table(part.select(*key, "c", F.explode(joined).alias("s")), "found")
    dropped(asked, classes)
    here = F.struct((F.col("at") + F.col("s.from")).alias("from"), (F.col("at") + F.col("reach") + F.col("s.to")).alias("to"))
    spans = own.join(part, [*key, "c"]).select(*text, here.alias("s")).groupBy(*text).agg(F.collect_set("s").alias("s"))
    copies = long.groupBy(*text).agg(F.count("*").alias("n"), F.min(F.length("text")).cast("long").alias("to")).filter("n > 1")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("to")))
    return spans.join(copies, text, "full").select(*text, F.when(F.col("n") > 1, whole).otherwise(F.col("s")).alias("spans"))


def _join(acc, x):
    """Add a span to spans that are in order and apart."""
    last = F.try_element_at(acc, F.lit(-1))
    more = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))))
    return F.when(F.size(acc) == 0, F.array(x)).when(x["from"] <= last["to"], more).otherwise(F.concat(acc, F.array(x)))


def with_spans(docs: DataFrame, length: int = 400, text: str = "_text", spans: str = "_spans") -> DataFrame:
    """`docs` with `text` (bytes) and `spans` (from, to; may overlap; or null), in the place of columns of these names: what is repeated of each text."""
    rows = docs.withColumn(text, utf8()).drop(spans)
    h = unused(rows.columns, "h1", "h2")
    rows = rows.withColumns({h[0]: F.xxhash64(text), h[1]: F.xxhash64(F.lit(1), text)})
    found = table(repeats(rows.select(F.col(h[0]).alias("h1"), F.col(h[1]).alias("h2"), F.col(text).alias("text")), length), "spans")
    return rows.join(found.toDF(*h, spans), h, "left").drop(*h)


def kept(text: bytes, spans: pa.StructArray | None) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes removed, and of maximal removed runs."""
    if spans is None or not len(spans):
        return text, 0, 0
    a = np.maximum(spans.field("from").to_numpy(), 0)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(np.minimum(spans.field("to").to_numpy(), len(text))[order])
    first = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    begin, end = a[first].tolist(), b[np.append(first[1:] - 1, len(b) - 1)].tolist()
    left = b"".join(text[x:y] for x, y in zip([0, *end], [*begin, len(text)], strict=True))
    return left, len(text) - len(left), len(begin)


def dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """`docs` without the bytes that are repeated; what isn't UTF-8 then is dropped, and all other columns stay."""
    names = unused(docs.columns, "text", "spans")
    rows, schema = with_spans(docs, length, *names), docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept(t.as_py(), s.values)[0].decode("utf-8", "ignore") for t, s in zip(*(batch.column(c) for c in names), strict=True)]
            new = pa.array([x if ok else None for x, ok in zip(texts, batch.column("text").is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in schema.names], names=schema.names)

    return rows.mapInArrow(cut, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "_text", "_spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, runs, sha = [], [], [], []
            for t, s in zip(batch.column("_text"), batch.column("_spans"), strict=True):
                text = t.as_py()
                left, removed, count = kept(text, s.values)
                n.append(len(text))
                gone.append(removed)
                runs.append(count)
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def brute_force(docs: list[tuple[int, str | None]], length: int = 400) -> list[tuple]:
    """What op1 returns, by comparing all windows."""
    count: dict[bytes, int] = {}
    texts = [(t or "").encode() for _, t in docs]
    for t in texts:
        for i in range(len(t) - length + 1):
            w = hashlib.blake2b(t[i : i + length], digest_size=16).digest()
            count[w] = count.get(w, 0) + 1
    out = []
    for (doc, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[hashlib.blake2b(t[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
