"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items go into one automaton. Each document's words stream through it; the longest match
that ends at a word decides whether a window of the items ends there. A window is `window` consecutive
words of an item; an item of fewer words, but not none, is one window as a whole. Words between hit
words can be cut out of the text, and documents of which too much is hit can be dropped.

Defined results: a null text, or one without words, has no words and no hits; an item without words never
occurs; rows of the same doc_id are judged one by one; items of the same item_id count once; an
item of a null item_id hits, but is not among the items named, and the query op10 leaves it out as its SQL does; an empty
benchmark leaves all documents as they are; `decontaminate` carries columns of any other name along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, session, table, unused, utf8

#: Bytes of item texts in one automaton, which takes some 100 times as many. Larger benchmarks are split by item into several,
#: built and applied one after another; the results are the same.
AUTOMATON_BYTES = 4 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_CLEAR = bytes(32 if x == 32 else 120 for x in _TABLE)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences.

    State v stands for the substrings that end at the same places; the longest has `length[v]` words.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = []
        for item, text in sorted(set(items), key=lambda x: (x[0] is None, x[0] or "", x[1])):
            if seq := [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]:
                texts.append((item, seq))
                last = 0
                for c in seq:
                    last = self._extend(last, c)
        short: dict[int, list[tuple[int, set[str]]]] = {}
        self.shortest = window
        own: dict[int, set[str]] = {}
        self.at_window = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[v]
            self.at_window[v] = self.at_window[up] if self.length[up] >= window else v if self.length[v] >= window else -1
        for item, seq in texts:
            named = () if item is None else (item,)
            v = n = 0
            for c in seq:
                v, n = self._step(v, n, c)
                if n >= window:
                    own.setdefault(self.at_window[v], set()).update(named)
            if len(seq) < window:
                held = short.setdefault(v, [])
                for m, names in held:
                    if m == len(seq):
                        names.update(named)
                        break
                else:
                    held.append((len(seq), set(named)))
                self.shortest = min(self.shortest, len(seq))
        self.window_items = {v: sorted(x) for v, x in own.items()}
        # the short items that end with a state's longest substring, and the next state up that has any
        self.short = {v: [(m, sorted(x)) for m, x in held] for v, held in short.items()}
        self.up = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            p = self.link[v]
            self.up[v] = p if p in self.short else self.up[p] if p > 0 else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _step(self, v: int, n: int, c: int) -> tuple[int, int]:
        nxt = self.next
        while v and c not in nxt[v]:
            v = self.link[v]
            n = self.length[v]
        to = nxt[v].get(c)
        return (to, n + 1) if to is not None else (0, 0)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that windows cover, joined and in order, and the items whose windows occur."""
        nxt, link, length, window, least = self.next, self.link, self.length, self.window, self.shortest
        at_window, short, up = self.at_window, self.short, self.up
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        v = n = 0
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                v = n = 0
                continue
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(c)
            if to is None:
                n = 0
                continue
            v = to
            n += 1
            if n < least:
                continue
            size = 0
            if n >= window:
                size = window
                found.update(self.window_items[at_window[v]])
            s = v
            while s > 0:
                for m, names in short.get(s, ()):
                    if m <= n:
                        size = max(size, m)
                        found.update(names)
                s = up[s]
            if size:
                a = i + 1 - size
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found


def _automata(spark: SparkSession, benchmark: DataFrame, window: int) -> Iterator:
    """Broadcasts of automata, each of items of about AUTOMATON_BYTES in all (or of one item), made when asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8().alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // AUTOMATON_BYTES) or 1
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield spark.sparkContext.broadcast(Automaton([(r.item, bytes(r.text)) for r in part.collect()], window)), k + 1 == parts


def joined(ranges: list[tuple[int, int]]) -> list[int]:
    """Overlapping and touching ranges joined: start, end, start, ..."""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and out[-1] >= a:
            out[-1] = max(out[-1], b)
        else:
            out += a, b
    return out


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, spans: str, items: str, n_words: str, last, schema) -> DataFrame:
    """`docs` after one pass for each automaton: `last` makes the rows of `schema` from a batch and its words, ranges and items.

    All passes but the last leave ranges and items in columns of the given names.
    """
    out = docs
    held = {n_words: "long", spans: "array<int>", items: "array<string>"}
    for shared, final in _automata(session(docs.sparkSession), benchmark, window):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, final=final) -> Iterator[pa.RecordBatch]:
            release()
            auto = shared.value
            for batch in batches:
                before = spans in batch.schema.names
                n, ranges, names = [], [], []
                for i, text in enumerate(batch.column("text").cast(pa.binary())):
                    words = words_of(text.as_py() or b"")
                    got, found = auto.scan(words)
                    if before:
                        had = batch.column(spans)[i].as_py()
                        got = [*got, *zip(had[::2], had[1::2], strict=True)]
                        found = found.union(batch.column(items)[i].as_py())
                    n.append(len(words))
                    ranges.append(joined(got))
                    names.append(sorted(found))
                if final:
                    yield last(batch, n, ranges, names)
                else:
                    new = {n_words: pa.array(n, pa.int64()), spans: pa.array(ranges, pa.list_(pa.int32())), items: pa.array(names, pa.list_(pa.string()))}
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in new), *new.values()], names=[*(c for c in batch.schema.names if c not in new), *new])

        if final:
            return out.mapInArrow(scan, schema)
        out = table(out.mapInArrow(scan, docs.withColumns({c: F.lit(None).cast(t) for c, t in held.items()}).schema), "decontaminate")
    raise AssertionError("there is an automaton even of no items")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """`docs` with `_spans` (word ranges as start, end, start, ...), `_items` (sorted ids) and `_n_words`, in the place of columns of these names; an item without an id hits, but has no id to name."""
    own = docs.drop("_n_words", "_spans", "_items")
    kept = own.columns
    schema = own.withColumns({"_n_words": F.lit(0).cast("long"), "_spans": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")}).schema

    def last(batch: pa.RecordBatch, n: list, ranges: list, names: list) -> pa.RecordBatch:
        new = [pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=schema.names)

    return _scanned(own, benchmark, window, "_spans", "_items", "_n_words", last, schema)


def cut(text: bytes, spans: list[int]) -> bytes:
    """The text without its hit words and what stands between the words of a range."""
    if not spans:
        return text
    clear = text.translate(_CLEAR)
    begin, end, at = [], [], 0
    for piece in clear.split(b" "):
        if piece:
            begin.append(at)
            end.append(at + len(piece))
        at += len(piece) + 1
    kept, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        kept.append(text[last : begin[a]])
        last = end[b - 1]
    return b"".join([*kept, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """Cut test items out of the documents.

    Spans of more than `max_words` hit words are removed. A document of which more than `max_coverage` of
    the words is hit, or nothing is left after a removal, goes as a whole. All other columns stay;
    `n_chars`, where there is one, follows the text.
    """
    names = docs.columns

    def last(batch: pa.RecordBatch, n: list, ranges: list, _: list) -> pa.RecordBatch:
        keep, texts = [], []
        for text, words, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), n, ranges, strict=True):
            hit = sum(spans[1::2]) - sum(spans[::2])
            long = [x for a, b in zip(spans[::2], spans[1::2], strict=True) if b - a > max_words for x in (a, b)]
            new = cut(text, long) if long else text
            keep.append(not hit or (hit <= max_coverage * words and bool(new.strip())))
            texts.append(new)
        new_text = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([new_text if c == "text" else batch.column(c) for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    out = _scanned(docs, benchmark, window, *unused(names, "spans", "items", "n_words"), last, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit words of every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id is not null"))  # as its SQL
    hit = F.aggregate(F.sequence(F.lit(0), F.size("_spans") - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, F.col("_spans")[i]).otherwise(-F.col("_spans")[i]))
    n_hit = F.when(F.size("_spans") > 0, hit).otherwise(0).cast("long")
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    """What op10 returns, by comparing every window with every position."""
    wins: dict[tuple, set[str]] = {}
    for item, text in items:
        w = words_of((text or "").encode())
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words_of((text or "").encode())
        hit, names = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= got
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = rf"regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
with d as (select row_number() over () as r, doc_id, {_SPLIT} as w from documents),
items as (select distinct item_id::varchar as item, {_SPLIT} as w from benchmark where item_id is not null),
wins as (
  select distinct item, size, array_to_string(w[i:i + size - 1], ' ') as k
  from (select item, w, least(len(w), 10) as size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from items where len(w) > 0)
), sizes as (select distinct size from wins),
places as (select r, size, i, array_to_string(w[i:i + size - 1], ' ') as k from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
found as (select p.r, p.i, p.size, v.item from places p join wins v on p.size = v.size and p.k = v.k),
hit as (select r, count(distinct j) as n_hit from (select distinct r, unnest(range(i, i + size)) as j from found) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from found) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (r) left join named using (r)
"""
