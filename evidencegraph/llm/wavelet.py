"""Token ids in wavelet-matrix files.

Documents are dealt to shards by ranges of doc_id; the ids of a shard, in ascending doc_id order, form one
sequence. Its wavelet matrix has a plane of bits for each binary digit, highest first; each plane orders
the ids for the next by that bit, zeros first. Planes are cut into blocks that are compressed one by one, with the
number of ones before each block, so that access, counting and occurrence lookup read only a few blocks.

File: magic, header length (4 bytes, little endian), header (zstd: int64 counts, doc ids, offsets, zeros of
each plane, ones before blocks, block ends), then the blocks.

Defined results: null and empty texts are the end id alone; a null doc_id comes before all others and rows
of one doc_id are ordered by a hash of their texts; an empty table gives no shard and an empty result; texts
may be of any length; other columns don't matter.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, ranged, session, shared_dir, table, worker_cache
from tokenizers import Tokenizer

VOCABULARY, END = "word_bpe_49k.json", 2
MAGIC = b"EGWM0001"
#: Bytes of a plane in one compressed block, and ids in one file before the next one of the shard begins.
BLOCK, FILE_IDS = 1 << 14, 6_000_000
#: Words that a worker keeps the ids of, in two generations.
WORDS = 300_000
NULL = -(1 << 63)
#: Marks words that the library gets as they are; no text holds it.
_WHOLE = "\ud800"


class Matrix:
    """A wavelet matrix over the bytes of one file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(data[8:12], "little")
        h = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[12 : 12 + size]), "<i8")
        self.n, n_docs, self.levels, blocks = (int(x) for x in h[:4])
        cuts = np.cumsum([4, n_docs, n_docs + 1, self.levels, self.levels * blocks, self.levels * blocks + 1])
        _, self.doc_ids, self.offsets, self.zeros, self.ones, self.ends = np.split(h, cuts[:-1])
        self.blocks = blocks
        self.body = memoryview(data)[12 + size :]
        self.kept: dict[int, np.ndarray] = {}

    @staticmethod
    def build(ids: np.ndarray, doc_ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The file of a sequence of ids (uint16 or uint32) and the offsets of its documents, the end among them."""
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        pack = zstandard.ZstdCompressor(level=1).compress
        zeros, ones, ends, parts = [], [], [0], []
        blocks = max(1, -(-len(ids) // (8 * BLOCK)))
        for k in range(levels - 1, -1, -1):
            bit = ids & ids.dtype.type(1 << k) != 0
            plane = np.packbits(bit)
            before = 0
            for b in range(blocks):
                piece = plane[b * BLOCK : (b + 1) * BLOCK]
                ones.append(before)
                before += int(np.bitwise_count(piece).sum(dtype=np.int64))
                parts.append(pack(piece.tobytes()))
                ends.append(ends[-1] + len(parts[-1]))
            zeros.append(len(ids) - before)
            if k:
                ids = np.concatenate((ids[~bit], ids[bit]))
        n = int(offsets[-1])
        head = np.concatenate(([n, len(doc_ids), levels, blocks], doc_ids, offsets, zeros, ones, ends)).astype("<i8")
        packed = zstandard.ZstdCompressor(level=3).compress(head.tobytes())
        return b"".join([MAGIC, len(packed).to_bytes(4, "little"), packed, *parts])

    def _block(self, level: int, b: int) -> np.ndarray:
        k = level * self.blocks + b
        if (got := self.kept.get(k)) is None:
            raw = zstandard.ZstdDecompressor().decompress(bytes(self.body[self.ends[k] : self.ends[k + 1]]), max_output_size=BLOCK)
            if len(self.kept) > 256:
                self.kept.clear()
            got = self.kept[k] = np.frombuffer(raw, np.uint8)
        return got

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // (8 * BLOCK))[i // 8 % BLOCK]) >> 7 - i % 8 & 1

    def _rank(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        if i >= self.n:
            return self.n - int(self.zeros[level])
        b, rest = divmod(i, 8 * BLOCK)
        piece = self._block(level, b)
        whole = int(np.bitwise_count(piece[: rest // 8]).sum(dtype=np.int64))
        last = int(piece[rest // 8]) >> 8 - rest % 8 if rest % 8 else 0
        return int(self.ones[level * self.blocks + b]) + whole + last.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) zero or one of a plane stands."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            r = self._rank(level, mid)
            if (r if bit else mid - r) <= k:
                lo = mid
            else:
                hi = mid
        return lo

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, r = self._bit(level, i), self._rank(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + r if bit else i - r
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank(level, lo), self._rank(level, hi)
            z = int(self.zeros[level])
            lo, hi = (z + a, z + b) if token >> self.levels - 1 - level & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id stands in positions lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int, k: int = 0) -> int:
        """The position of the k-th occurrence (from 0) of an id."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> self.levels - 1 - level & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest."""
        out = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        unpack = zstandard.ZstdDecompressor().decompress
        for level in range(self.levels - 1, -1, -1):
            k = level * self.blocks
            raw = b"".join(unpack(bytes(self.body[self.ends[k + b] : self.ends[k + b + 1]]), max_output_size=BLOCK) for b in range(self.blocks))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            z = int(self.zeros[level])
            new = np.empty_like(out)
            new[~bit] = out[:z]
            new[bit] = out[z:] | out.dtype.type(1 << self.levels - 1 - level)
            out = new
        return out


class Words:
    """Pieces of text to packed ids (little-endian, 16 bits) by the library.

    The vocabulary lower-cases, drops white space, and never joins what its splitting parts. In Latin-1, where
    lower case and composition keep each character one, the splitting is done here, and each piece is
    encoded by the library once; words with other characters, or a special token, go to it as they are. New
    pieces of letters go many at a time, and are told apart by their last tokens, which mark the end of a word.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.table: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids of 16 bits are expected")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        letters, digits, space = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+").findall
        self.simple = re.compile(f"[{letters}]+").fullmatch
        self.words = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall

    def _pieces(self, text: str) -> list[str]:
        if _latin(text):
            return self.split(text.lower())
        out: list[str] = []
        for w in self.words(text):
            if _latin(w):
                out += self.split(w.lower())
            else:
                out.append(_WHOLE + w)
        return out

    def _learn(self, new: Iterable[str]) -> None:
        rest, model = [], self.tokenizer.model.tokenize
        for x in new:
            if x.isascii() and x.isalpha():  # to such words normalising and splitting do nothing
                ids = [t.id for t in model(x)]
                self.table[x] = pack(f"<{len(ids)}H", *ids)
            else:
                rest.append(x)
        simple = [x for x in rest if self.simple(x)]
        for at in range(0, len(simple), 5000):
            some = simple[at : at + 5000]
            ids = np.array(self._encode(" ".join(some)), "<u2")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                data, begin = ids.tobytes(), 0
                for x, to in zip(some, (2 * cut).tolist(), strict=True):
                    self.table[x] = data[begin:to]
                    begin = to
        for x in rest:
            if x not in self.table:
                self.table[x] = np.array(self._encode(x.removeprefix(_WHOLE)), "<u2").tobytes()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.table) > WORDS:
            self.old, self.table = self.table, {}
        split = [self._pieces(t) for t in texts]
        missing = set().union(*split) - self.table.keys()
        if self.old:
            for w in missing & self.old.keys():
                self.table[w] = self.old[w]
            missing -= self.table.keys()
        self._learn(missing)
        get = self.table.__getitem__
        return [b"".join(map(get, s)) for s in split]


def _latin(text: str) -> bool:
    if "<|" in text:
        return False
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return True


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Write shards to `folder`, a URI that executors share. Returns part, seq, file, n_docs, n_ids of each file."""
    spark = session(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = ranged(rows, "doc_id", 4 * partitions(spark)).select(F.col("_part").alias("part"), F.col("_id").alias("doc_id"), "text")
    dealt = dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "doc_id", F.xxhash64("text"))
    vocabulary = path

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cache(Words, vocabulary or public_tokenizers.path(VOCABULARY))
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        last = np.array([end], "<u2").tobytes()
        part, seq = -1, 0
        held: list[bytes] = []
        docs_: list[int] = []
        size = 0

        def put() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u2")
            offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) // 2)))
            name = f"{root}/shard-{part:08d}-{seq:05d}.wm"
            temp = f"{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as f:
                f.write(Matrix.build(ids, np.array(docs_, np.int64), offsets))
            fs.move(temp, name)  # a task that runs twice writes the same file
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": f"{folder}/shard-{part:08d}-{seq:05d}.wm", "n_docs": len(docs_), "n_ids": len(ids)}], schema=pa.schema({"part": pa.int32(), "seq": pa.int32(), "file": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64()}))

        for batch in batches:
            packed = encode(batch.column("text").to_pylist())
            for p, d, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), packed, strict=True):
                if held and (p != part or size > 2 * FILE_IDS):
                    yield put()
                    seq = seq + 1 if p == part else 0
                    held.clear()
                    docs_.clear()
                    size = 0
                part = p
                held.append(x + last)
                docs_.append(d)
                size += len(x) + 2
        if held:
            yield put()

    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return table(dealt.mapInArrow(work, "part int, seq int, file string, n_docs long, n_ids long"), "shards")


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    spark = shards.sparkSession
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    rows = shards.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("file", "before")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                fs, name = pyarrow.fs.FileSystem.from_uri(file)
                with fs.open_input_stream(name) as f:
                    m = Matrix(f.read())
                data = m.ids().astype("<u4").tobytes()
                at = (4 * m.offsets).tolist()
                crc = [zlib.crc32(memoryview(data)[a:b]) for a, b in zip(at, at[1:], strict=False)]
                doc = pa.array(m.doc_ids, mask=m.doc_ids == NULL)
                yield pa.RecordBatch.from_arrays([doc, pa.array(m.offsets[:-1] + before), pa.array(np.diff(m.offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.repartition(partitions(spark), "file").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, f"{shared_dir(spark)}/evidencegraph/wavelet-{uuid.uuid4().hex}"))
