"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The encoding of a prefix ends with one certain token, and two tokens can stand side by side if and only
if the merges give back these two for their joined bytes. So the transducer reads bytes and keeps, for
each place where a longer token may still begin, the token that ends there. States are such sets; they are
made when first reached. Each move puts out the token with which the prefix so far ends, and so the tokens
follow backwards from any place: from the end of a piece, or in long ones, at each WINDOW bytes, from the last
place on which all that is alive agrees.

Decoding runs a UTF-8 state machine over token ids, and passes on whole characters only.

Defined results: null and empty texts have no tokens; texts of any length stream through; repeated rows
are encoded one by one; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, trimmed, worker_cache

VOCABULARY = "byte_bpe_50k.tiktoken"
#: States, pieces and pairs of tokens that a worker keeps; beyond that it starts anew.
STATES, PIECES, NEIGHBOURS, PIECE_CHARS = 150_000, 200_000, 200_000, 48
#: Bytes of a piece that are read at a time.
WINDOW = 4096
_BEYOND = re.compile("[^\x00-\xff]").search


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Bytes of one piece of text to token ids.

    A state holds, for each place where a longer token may still begin, the earliest first, the node that its bytes
    reach in the tree of tokens, and the token before it (node << 32 | token + 1); the place after all bytes comes last.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}  # the last merge that makes a token
        for rank, text in sorted(self.tokens.items()):
            for i in range(1, len(text)):
                a, b = ranks.get(text[:i]), ranks.get(text[i:])
                if a is not None and b is not None and a < rank and b < rank and self._apart(a, b, rank):
                    self.parts[rank] = a, b
                    break
        self.tree: dict[int, int] = {}  # node << 8 | byte: the node that follows
        self.token_at, self.depth, inner = [-1], [0], {0}
        for text, rank in ranks.items():
            node = 0
            for i, byte in enumerate(text, 1):
                inner.add(node)
                if (to := self.tree.get(node << 8 | byte)) is None:
                    to = self.tree[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(i)
                node = to
            self.token_at[node] = rank
        self.inner = bytes(node in inner for node in range(len(self.token_at)))
        self.reset()

    def reset(self) -> None:
        self.beside: dict[int, bool] = {}
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, int] = {}  # state << 8 | byte: next state << 32 | token
        self._state((0,))

    def _state(self, alive: tuple) -> int:
        if (s := self.number.get(alive)) is None:
            s = self.number[alive] = len(self.states)
            self.states.append(alive)
        return s

    def merge(self, text: bytes) -> list[int]:
        """The merges by rank, lowest and leftmost first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (ok := self.beside.get(key)) is None:
            if len(self.beside) > NEIGHBOURS:
                self.beside.clear()
            ok = self.beside[key] = left < 0 or self._apart(left, right)
        return ok

    def _apart(self, left: int, right: int, before: int = 1 << 60) -> bool:
        """Whether merges of ranks lower than `before` leave two tokens side by side.

        The merges that made both are undone, the last first. What then touches, `left` and `right`, must not have had a merge
        of its own before the one just undone: by rank, and of one rank from the left.
        """
        tokens, ranks, parts = self.tokens, self.ranks, self.parts
        while ranks.get(tokens[left] + tokens[right], before) >= before:
            if left > right and left in parts or right not in parts:
                if left not in parts:
                    return True
                before, left = left, parts[left][1]
            else:
                before, right = right + 1, parts[right][0]
        return False

    def _move(self, at_byte: int) -> int:
        byte, tree, inner = at_byte & 255, self.tree, self.inner
        now, token = [], -1
        for entry in self.states[at_byte >> 8]:
            if (to := tree.get(entry >> 32 << 8 | byte)) is None:
                continue
            if token < 0 and (found := self.token_at[to]) >= 0 and self._fits((entry & 0xFFFFFFFF) - 1, found):
                token = found
            if inner[to]:
                now.append(to << 32 | entry & 0xFFFFFFFF)
        now.append(token + 1)
        self.moves[at_byte] = moved = self._state(tuple(now)) << 32 | token
        return moved

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > STATES:
            self.reset()
        out: list[int] = []
        ends: list[int] = []  # at each byte of what isn't put out yet, the token that ends there
        at, moves = 0, self.moves.get
        for lo in range(0, len(piece), WINDOW):
            for byte in piece[lo : lo + WINDOW]:
                key = at >> 32 << 8 | byte
                if (at := moves(key)) is None:
                    at = self._move(key)
                ends.append(at & 0xFFFFFFFF)
            if lo + WINDOW < len(piece):
                agreed = self._agreed(ends, at >> 32)
                out += self._backwards(ends, agreed)
                del ends[:agreed]
        return out + self._backwards(ends, len(ends)) if out else self._backwards(ends, len(ends))

    def _backwards(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to a place."""
        out, size = [], self.size
        while at:
            out.append(token := ends[at - 1])
            at -= size[token]
        out.reverse()
        return out

    def _agreed(self, ends: list[int], state: int) -> int:
        """The last place through which the tokens go from wherever the next one begins."""
        places = {len(ends) - self.depth[node] for node in (entry >> 32 for entry in self.states[state])}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.size[ends[last - 1]])
        return places.pop()


#: The classes of the pattern among the characters up to U+00FF.
_LETTERS, _NUMBERS, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"


class Encoder(dict):
    """Text to packed ids; the pieces last seen are kept as whole paths of the transducer, in two generations."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        # the standard library takes half the time, but has no classes of Unicode: up to U+00FF they are listed
        listed = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
        listed = listed.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.split_latin = re.compile(listed).findall if "\\p" not in listed else self.split
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            seq = self.transducer.encode(piece.encode())
            ids = pack(f"<{len(seq)}I", *seq)
        if len(piece) <= PIECE_CHARS:
            self[piece] = ids
        return ids

    def forget(self) -> None:
        """Give back what was learned."""
        self.clear()
        self.old = {}
        self.transducer.reset()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self) > PIECES:
            self.old = dict(self)
            self.clear()
        split = self.split_latin if text.isascii() or not _BEYOND(text) else self.split
        return b"".join(map(self.__getitem__, split(text)))


#: UTF-8 by classes of bytes: what each state makes of a class; 0 stands between characters, 8 is an error.
_CLASS = bytes(
    0 if b < 0x80 else 1 if b < 0x90 else 2 if b < 0xA0 else 3 if b < 0xC0 else 4 if b < 0xC2 else 5 if b < 0xE0 else 6 if b == 0xE0 else 7 if b == 0xED else 8 if b < 0xF0 else 9 if b == 0xF0 else 10 if b < 0xF4 else 11 if b == 0xF4 else 4 for b in range(256)
)
_NEXT = [
    [0, 8, 8, 8, 8, 1, 3, 4, 2, 5, 6, 7],  # between characters
    [8, 0, 0, 0, 8, 8, 8, 8, 8, 8, 8, 8],  # one more
    [8, 1, 1, 1, 8, 8, 8, 8, 8, 8, 8, 8],  # two more
    [8, 8, 8, 1, 8, 8, 8, 8, 8, 8, 8, 8],  # after E0
    [8, 1, 1, 8, 8, 8, 8, 8, 8, 8, 8, 8],  # after ED
    [8, 8, 2, 2, 8, 8, 8, 8, 8, 8, 8, 8],  # after F0
    [8, 2, 2, 2, 8, 8, 8, 8, 8, 8, 8, 8],  # three more
    [8, 2, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8],  # after F4
    [8] * 12,
]


class Decoder:
    """Token ids to bytes, whole characters at a time."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.moves: dict[tuple[int, int], int] = {}
        self.whole = np.array([self.move(0, r) == 0 for r in range(len(self.tokens))])
        self.moves.clear()

    def move(self, state: int, token: int) -> int:
        """The state of the UTF-8 machine after a token."""
        if (to := self.moves.get((state, token))) is None:
            to = state
            for b in self.tokens[token]:
                to = _NEXT[to][_CLASS[b]]
            self.moves[state, token] = to
        return to

    def stream(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Chunks of whole characters as the ids come; what isn't UTF-8 is passed on as it is, at the end of its token."""
        state, held = 0, b""
        for i in ids:
            state = self.move(state, i)
            held += self.tokens[i]
            if state in (0, 8):
                yield held
                state, held = 0, b""
        if held:
            yield held

    def decode(self, ids: np.ndarray) -> bytes:
        """All bytes. Runs of tokens that are whole characters pass at once; the machine steps through the others."""
        if self.whole[ids].all():
            return self.joined(ids)
        out, at = [], 0
        for k in np.flatnonzero(~self.whole[ids]).tolist():
            if k < at:
                continue
            out.append(self.joined(ids[at:k]))
            state, at = 0, k
            while at < len(ids):
                token = int(ids[at])
                state = self.move(state, token)
                out.append(self.tokens[token])
                at += 1
                if state in (0, 8):
                    break
        out.append(self.joined(ids[at:]))
        return b"".join(out)

    def joined(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, one after another."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def coder(path: str) -> tuple[Encoder, Decoder]:
    ranks = load_ranks(path)
    return Encoder(ranks), Decoder(ranks)


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit; if kept), ids_sha256, decoded_sha256 of every row."""
    session(docs.sparkSession)
    name = path
    kept = ", ids binary" if keep_ids else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = worker_cache(coder, name or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            n, ids, hashes, decoded = [], [], [], []
            for text in batch.column("text"):
                packed = enc(text.as_py() or "")
                n.append(len(packed) // 4)
                hashes.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(dec.decode(np.frombuffer(packed, "<u4"))).hexdigest())
                if keep_ids:
                    ids.append(packed)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), *([pa.array(ids, pa.binary())] * keep_ids), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", *["ids"] * keep_ids, "ids_sha256", "decoded_sha256"])
        enc.forget()  # workers that wait hold the vocabulary only
        trimmed()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, f"doc_id long, n_tokens long{kept}, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids; bytes that aren't UTF-8 become replacement characters."""
    name = path

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = worker_cache(coder, name or public_tokenizers.path(VOCABULARY))[1]
        for batch in batches:
            texts = [dec.decode(np.frombuffer(x.as_py() or b"", "<u4")).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return session(encoded.sparkSession) and encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
