"""Line dedup by a log-template tree of fixed depth.

A line is its tokens between ASCII white space; a token with a digit is a variable field. The tree's first level is the
number of tokens, the next DEPTH levels are the leading tokens. In a leaf, what follows of a line is cut in FIELDS
fields (or one for each token, if there are fewer); lines of VARIABLE such tokens or more that agree in three quarters of
the fields, or are linked so through others, have one template, in which the fields that differ are variable too. Other
lines share a template if they are equal but for their variable fields. A template recurs if `least` documents have it, or
two, if its lines have `long` constant tokens or more. It is kept in the first of these documents, and its lines are
dropped from the others.

Lines are named by 128-bit hashes, after each document has named each of its lines once, and fields by 16 bits. Leaves are
compared by whole tables of lines that differ, so copies of a line fill no leaf; a large leaf is dealt to several tasks.

Defined results: a null text has no lines and stays null; an empty one is one blank line; blank lines and
those of fewer than `tokens` tokens always stay; rows of one doc_id are one document; rows of a null doc_id are one document
if their texts are equal, after all others; a document of which no line but blank ones is left, though it had some, goes; texts
and lines may be of any length; an empty table gives an empty result; other columns don't matter and are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, release, session, table, unused, utf8
from .links import bucketed, components, forest

#: Leading tokens of a leaf, fields that the tokens after them are cut in, and tokens from which lines may share a template though fields differ.
DEPTH, FIELDS, VARIABLE = 3, 16, 8
#: A template recurs in so many documents; shorter lines are no templates.
LEAST, TOKENS = 5, 2
#: Constant tokens from which a template recurs in two documents.
LONG = 20
#: Lines of which a worker keeps the names.
KEPT = 50_000
LAST = (1 << 63) - 1
#: Bytes of a code: the number of fields, the fields.
WIDTH = 2 + 2 * FIELDS

_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
_OPEN = b"<*>"


class Lines(dict):
    """A line's name (leaf, rest; 16 bytes, none if it is no template), its code (none if its fields don't vary) and its number of constant tokens."""

    def __init__(self, tokens: int) -> None:
        super().__init__()
        self.tokens = tokens

    def __missing__(self, line: bytes) -> tuple[bytes, bytes | None, int]:
        words = line.split()
        n = len(words)
        out: tuple[bytes, bytes | None, int] = (b"", None, 0)
        if n >= self.tokens:
            if line.translate(None, _DIGITS):  # it has digits
                words = [_OPEN if w.translate(None, _DIGITS) else w for w in words]
            rest = words[DEPTH:]
            name = xxhash.xxh3_64_digest(b"%d " % n + b" ".join(words[:DEPTH])) + xxhash.xxh3_64_digest(b" ".join(rest))
            out = name, self.code(rest) if len(rest) >= VARIABLE else None, n - words.count(_OPEN)
        if len(self) >= KEPT:
            self.clear()
        self[line] = out
        return out

    @staticmethod
    def code(rest: list[bytes]) -> bytes:
        n, m = min(FIELDS, len(rest)), len(rest)
        fields = [xxhash.xxh32_intdigest(b" ".join(rest[i * m // n : (i + 1) * m // n])) & 0xFFFF for i in range(n)]
        return np.array([n, *fields, *[0] * (FIELDS - n)], "<u2").tobytes()


class Alike:
    """Codes of a leaf that agree in three quarters of the fields."""

    @staticmethod
    def fields(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = np.ascontiguousarray(codes).view("<u2")
        return whole[:, 0].astype(np.int64), whole[:, 1:]

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, fields = self.fields(codes)
        of = int(n[0])  # lines of a leaf have as many tokens
        fields = fields[:, :of]
        return forest(len(codes), lambda a, b: 4 * np.count_nonzero(fields[a][:, None, :] == fields[b][None, :, :], axis=2) >= 3 * of, of)

    def two(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (n, a), (_, b) = self.fields(x), self.fields(y)
        return 4 * (np.count_nonzero(a == b, axis=1) - (FIELDS - n)) >= 3 * n


def _document() -> tuple[Column, Column]:
    """What names the document of a row: its id, and for null a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.when(F.col("doc_id").isNull(), F.xxhash64(utf8())).otherwise(0).cast("long")


def named(docs: DataFrame, tokens: int) -> DataFrame:
    """k1, k2, code, constant, id, alt: each line of each row, once, and the row's document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        of = Lines(tokens)
        for batch in batches:
            keys: list[bytes] = []
            codes: list[bytes | None] = []
            constant: list[int] = []
            count = []
            for text in batch.column("text"):
                before = len(keys)
                own: set[bytes] = set()
                for line in set((text.as_py() or b"").split(b"\n")):
                    name, code, fixed = of[line]
                    if name and name not in own:
                        own.add(name)
                        keys.append(name)
                        codes.append(code)
                        constant.append(fixed)
                count.append(len(keys) - before)
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            who = pa.array(np.repeat(np.arange(len(count)), count))
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(codes, pa.binary()), pa.array(constant, pa.int32()), batch.column("id").take(who), batch.column("alt").take(who)], names=["k1", "k2", "code", "constant", "id", "alt"])

    of_id, alt = _document()
    rows = docs.select(of_id.alias("id"), alt.alias("alt"), F.col("text").cast("binary").alias("text"))
    return rows.filter("text is not null").mapInArrow(work, "k1 long, k2 long, code binary, constant int, id long, alt long")


def recurring(docs: DataFrame, least: int = LEAST, tokens: int = TOKENS, long: int | None = LONG) -> DataFrame:
    """id, alt, drop: for each document the names (k1, k2) of the lines that it loses."""
    key, doc = ["k1", "k2"], F.struct("id", "alt")
    enough = F.lit(least) if long is None else F.when(F.col("constant") >= long, min(2, least)).otherwise(least)
    rows = table(named(session(docs.sparkSession) and docs, tokens), "lines")
    lines = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(doc).alias("lo"), F.max(doc).alias("hi"), F.min("constant").alias("constant"), F.first("code").alias("code"))
    distinct = table(lines.withColumn("line", F.xxhash64(*key)), "distinct-lines")
    links = bucketed(distinct.filter("code is not null").select(F.col("k1").alias("key"), F.col("line").alias("id"), "code"), Alike(), "leaves", WIDTH)
    roots = components(links).select(F.col("node").alias("line"), F.col("root").alias("template"))
    # a line of one row alone in its template doesn't recur
    lines = distinct.drop("code").join(roots, "line", "left").filter("n > 1 or template is not null").withColumn("template", F.coalesce("template", "line"))
    lines = table(lines, "shared-lines")
    dropped(distinct)
    many = lines.groupBy("template").agg(F.sum("n").alias("n"), F.min("lo").alias("first"), F.max("hi").alias("hi"), F.min("constant").alias("constant"))
    many = many.filter((F.col("n") >= enough) & (F.col("first") < F.col("hi"))).select("template", "first", "constant")
    # the rows of the few templates left; a document with several rows counts once
    rest = table(rows.drop("constant", "code").join(lines.select(*key, "template").join(many, "template"), key), "template-places")
    found = rest.groupBy("template", "constant").agg(F.countDistinct(doc).alias("n")).filter(F.col("n") >= enough).select("template")
    lost = rest.filter(doc != F.col("first")).join(found, "template")
    out = table(lost.groupBy("id", "alt").agg(F.collect_set(F.struct(*key)).alias("drop")), "lost-lines")
    dropped(rows, lines, rest)
    return out


def kept_lines(text: bytes, drop: set[bytes], of: Lines) -> tuple[list[bytes], int]:
    """The lines that stay, and how many there were."""
    lines = text.split(b"\n")
    return [line for line in lines if of[line][0] not in drop], len(lines)


def _drops(column: pa.Array) -> Iterator[set[bytes]]:
    for x in column:
        if x.values is None:
            yield set()
        else:
            k = np.stack([x.values.field("k1").to_numpy(), x.values.field("k2").to_numpy()], axis=1)
            raw = k.astype("<i8").tobytes()
            yield {raw[i : i + 16] for i in range(0, len(raw), 16)}


def with_drops(docs: DataFrame, drop: str, least: int = LEAST, tokens: int = TOKENS, long: int | None = LONG) -> DataFrame:
    """`docs` with the column `drop`: names of the lines that go, or null."""
    names = unused([*docs.columns, drop], "id", "alt")
    lost = recurring(docs, least, tokens, long).toDF(*names, drop)
    return docs.withColumns(dict(zip(names, _document(), strict=True))).join(lost, names, "left").drop(*names)


def dedup_lines(docs: DataFrame, least: int = LEAST, tokens: int = TOKENS, long: int | None = LONG) -> DataFrame:
    """`docs` without lines of recurring templates, nor documents of which nothing is left; `n_chars`, where there is one, follows the text."""
    schema = docs.schema
    (lost,) = unused(docs.columns, "drop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        of = Lines(tokens)
        for batch in batches:
            texts, keep = [], []
            for t, drop in zip(batch.column("text"), _drops(batch.column(lost)), strict=True):
                text = t.as_py()
                if text is None or not drop:
                    texts.append(text)
                    keep.append(True)
                    continue
                lines, _ = kept_lines(text.encode(), drop, of)
                texts.append(b"\n".join(lines).decode())
                keep.append(any(map(bytes.strip, lines)) or not text.encode().strip())
            new = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in schema.names], names=schema.names).filter(pa.array(keep, pa.bool_()))

    out = with_drops(docs, lost, least, tokens, long).mapInArrow(cut, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).cast(schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the lines that stay, joined) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        of = Lines(TOKENS)
        for batch in batches:
            n, gone, sha = [], [], []
            for t, drop in zip(batch.column("text"), _drops(batch.column("drop")), strict=True):
                text = (t.as_py() or "").encode()
                if drop and t.is_valid:
                    lines, total = kept_lines(text, drop, of)
                    n.append(total)
                    gone.append(total - len(lines))
                    text = b"\n".join(lines)
                else:
                    n.append(text.count(b"\n") + 1 if t.is_valid else 0)
                    gone.append(0)
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string"
    return with_drops(docs, "drop").mapInArrow(work, schema)


#: By tokens and fields as text: pairs of lines of a leaf, what they reach, the documents of each template.
SQL = f"""
with recursive docs as (
  select row_number() over () as rowid_, doc_id, case when doc_id is null then concat('1 ', text) else concat('0 ', printf('%020d', doc_id)) end as doc, text from documents
), lines as (
  select rowid_, doc_id, doc, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from docs
), masked as (
  select *, list_transform(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as w from lines
), keyed as (
  select rowid_, doc_id, doc, pos, line, array_to_string(w, ' ') as k, len(w) as n, len(list_filter(w, lambda x: x <> '<*>')) as constant, w from masked where len(w) >= {TOKENS}
), each as (
  select k, any_value(n) as n, any_value(w) as w, any_value(constant) as constant from keyed group by k
), fielded as (
  select k, concat(n, ' ', array_to_string(w[1:{DEPTH}], ' ')) as leaf, least(n - {DEPTH}, {FIELDS}) as f, n - {DEPTH} as m, w[{DEPTH + 1}:] as rest
  from each where n - {DEPTH} >= {VARIABLE}
), fields as (
  select k, leaf, f, list_transform(range(f), lambda i: array_to_string(rest[i * m // f + 1 : (i + 1) * m // f], ' ')) as v from fielded
), pairs as (
  select x.k as a, y.k as b from fields x join fields y on x.leaf = y.leaf and x.k <> y.k
  where 4 * len(list_filter(range(1, x.f + 1), lambda i: x.v[i] = y.v[i])) >= 3 * x.f
), reach(a, b) as (
  select a, b from pairs union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a
), templates as (
  select k, least(k, coalesce(min(b), k)) as t, any_value(constant) as constant from each left join reach on k = a group by k
), recurring as (
  select t, min(doc) as first from keyed join templates using (k) group by t
  having count(distinct doc) >= case when min(templates.constant) >= {LONG} then 2 else {LEAST} end
), gone as (
  select distinct rowid_, pos from keyed join templates using (k) join recurring using (t) where doc <> first
), judged as (
  select lines.*, gone.pos is not null as lost from lines left join gone on lines.rowid_ = gone.rowid_ and lines.pos = gone.pos
)
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
from judged group by rowid_, doc_id
union all
select doc_id, 0, 0, sha256('') from documents where text is null
"""


def brute_force(docs: list[tuple[int | None, str | None]], least: int = LEAST, tokens: int = TOKENS, long: int | None = LONG) -> list[tuple]:
    """What op7 returns: lines as tuples of tokens, all pairs of a leaf, documents in sets."""

    def masked(line: str) -> tuple[bytes, ...]:
        return tuple(b"<*>" if any(48 <= c <= 57 for c in x) else x for x in line.encode().split())

    def alike(x: tuple, y: tuple) -> bool:
        if len(x) != len(y) or x[:DEPTH] != y[:DEPTH] or len(x) - DEPTH < VARIABLE:
            return False
        x, y = x[DEPTH:], y[DEPTH:]
        n = min(FIELDS, len(x))
        cuts = [i * len(x) // n for i in range(n + 1)]
        return sum(x[a:b] == y[a:b] for a, b in zip(cuts, cuts[1:], strict=False)) >= 0.75 * n

    seen: dict[tuple, set] = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(w := masked(line)) >= tokens:
                seen.setdefault(w, set()).add((d is None, d or 0, t if d is None else ""))
    root = {w: w for w in seen}
    for x in seen:
        for y in seen:
            if root[x] != root[y] and alike(x, y):
                old, new = root[y], root[x]
                root = {w: new if r == old else r for w, r in root.items()}
    members: dict[tuple, list] = {}
    for w, r in root.items():
        members.setdefault(r, []).append(w)
    first: dict[tuple, tuple] = {}
    for ws in members.values():
        own = set().union(*(seen[w] for w in ws))
        constant = min(sum(x != b"<*>" for x in w) for w in ws)
        if len(own) >= (min(2, least) if long is not None and constant >= long else least):
            first |= {w: min(own) for w in ws}
    out = []
    for d, t in docs:
        lines = [] if t is None else t.split("\n")
        own = (d is None, d or 0, t if d is None else "")
        stay = [x for x in lines if first.get(masked(x), own) == own]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out
