"""Byte-level BPE as a lazily determinised transducer, on Spark and for streams.

The merges define which two tokens may stand side by side: those that encoding their
joined bytes gives back. A token sequence is the encoding of its bytes if all its
neighbours may, so every prefix has exactly one last token. A state of the transducer is
the last token that is certain and the bytes read since; reading a byte finds the one
token that may end there, and as soon as every token that could still grow starts after a
common boundary, the tokens up to it are emitted. The lookahead is bounded by the longest
token. States and transitions are made when first needed and kept.

Text is cut by the tokenizer's pattern first; no merge crosses such a cut. What a whole
piece emits is kept too.

Defined cases: null and empty texts give an empty list; the names of special tokens are
ordinary text; blank, broken and very long texts are encoded as they are.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the vocabulary: its pattern, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Kept states and pieces; beyond that the tables start anew, with the same results.
MAX_KEPT = 150_000


class Vocabulary:
    """Tokens by bytes and the merge order; ids are ranks, as in a file of base64 tokens and ids."""

    def __init__(self, raw: bytes):
        pairs = (line.split() for line in raw.splitlines() if line.strip())
        self.ids = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.growing = {t[:k] for t in self.ids for k in range(len(t))}  # bytes that may become a token with more
        self.longest = max(map(len, self.ids), default=0)
        self._may: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Plain BPE: join the neighbours of the lowest rank until none can be joined."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min(((self.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def may_follow(self, left: int, token: int) -> bool:
        """Whether token may stand after left (-1: at the start)."""
        k = (left, token)
        if (ok := self._may.get(k)) is None:
            before = self.bytes_of[left] if left >= 0 else b""
            if len(self._may) > MAX_KEPT:
                self._may.clear()
            ok = self._may[k] = self.merged(before + self.bytes_of[token]) == ([left, token] if left >= 0 else [token])
        return ok


class Transducer:
    """Bytes in, tokens out; feed() walks, end() gives what is left and starts anew."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._clear()

    def _clear(self) -> None:
        # A state: the certain last token, the bytes since, and the start of the last token for each length of them.
        self.known: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.states: list[tuple[int, bytes, tuple[int, ...]]] = [(-1, b"", (0,))]
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.finals: list[tuple[int, ...] | None] = [()]
        self.at = 0

    def _token(self, state: tuple, start: int, end: int) -> int:
        return self.v.ids[state[1][start:end]]

    def _path(self, state: tuple, end: int) -> list[tuple[int, int]]:
        """Tokens as (start, end) from the certain boundary to end."""
        path = []
        while end > 0:
            path.append((state[2][end], end))
            end = state[2][end]
        return path[::-1]

    def _add(self, certain: int, pending: bytes, starts: tuple[int, ...]) -> int:
        s = self.known.get((certain, pending))
        if s is None:
            s = self.known[certain, pending] = len(self.states)
            self.states.append((certain, pending, starts))
            self.arcs.append({})
            self.finals.append(None)
        return s

    def step(self, s: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The arc of a state and a byte, made when first asked for."""
        certain, pending, starts = self.states[s]
        pending += bytes((byte,))
        n, ids, state = len(pending), self.v.ids, self.states[s]
        for j in range(max(0, n - self.v.longest), n):
            token = ids.get(pending[j:])
            if token is not None and self.v.may_follow(certain if j == 0 else self._token(state, starts[j], j), token):
                break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        state = (certain, pending, (*starts, j))
        # Every token to come starts at the end or grows from a start whose bytes are still part of a longer token.
        open_ = [k for k in range(max(0, n - self.v.longest), n + 1) if k == n or (k == 0 or state[2][k] < k) and pending[k:] in self.v.growing]
        common = None
        for k in open_:
            cut = {e for _, e in self._path(state, k)}
            common = cut if common is None else common & cut
        boundary = max(common, default=0)
        if not boundary:
            arc = (self._add(*state), ())
        else:
            out = [self._token(state, a, z) for a, z in self._path(state, boundary)]
            rest = tuple(max(0, x - boundary) for x in state[2][boundary:])
            arc = (self._add(out[-1], pending[boundary:], rest), tuple(out))
        self.arcs[s][byte] = arc
        return arc

    def final(self, s: int) -> tuple[int, ...]:
        if (out := self.finals[s]) is None:
            state = self.states[s]
            out = self.finals[s] = tuple(self._token(state, a, z) for a, z in self._path(state, len(state[1])))
        return out

    def feed(self, data: bytes) -> list[int]:
        """The tokens that these bytes make certain."""
        if len(self.states) > MAX_KEPT:  # start anew from the state at hand
            here = self.states[self.at]
            self._clear()
            self.at = self._add(*here)
        s, out, arcs = self.at, [], self.arcs
        for byte in data:
            arc = arcs[s].get(byte) or self.step(s, byte)
            s = arc[0]
            if arc[1]:
                out.extend(arc[1])
        self.at = s
        return out

    def end(self) -> list[int]:
        """The tokens left at the end of a piece."""
        out, self.at = list(self.final(self.at)), 0
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        self.at = 0
        return self.feed(piece) + self.end()


class Encoder(dict):
    """Piece of text -> its ids as packed 32-bit integers; kept pieces are found at once."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.transducer = vocabulary, Transducer(vocabulary)
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.transducer.encode(piece.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        if len(piece) < 64:
            if len(self) > MAX_KEPT:
                self.clear()
            self[piece] = out
        return out

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


@lru_cache(maxsize=2)
def encoder(raw: bytes) -> Encoder:
    """One encoder to a Python worker."""
    return Encoder(Vocabulary(raw))


class StreamEncoder:
    """Text in, ids out as soon as its pieces are certain: all but the last piece and the last LOOK characters, which what follows may join."""

    LOOK = 3

    def __init__(self, encoder: Encoder):
        self.encoder, self.cut, self.held = encoder, regex.compile(PATTERN), ""

    def feed(self, text: str) -> list[int]:
        self.held += text
        out, done, last = [], 0, None
        for m in self.cut.finditer(self.held):
            if last is not None and last.end() <= len(self.held) - self.LOOK:
                out.append(self.encoder[last[0]])
                done = last.end()
            last = m
        self.held = self.held[done:]
        return np.frombuffer(b"".join(out), np.int32).tolist()

    def end(self) -> list[int]:
        out, self.held = self.encoder.ids(self.held), ""
        return out


class StreamDecoder:
    """Ids in, text out as soon as its characters are whole; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(self.vocabulary.bytes_of[i] for i in ids))

    def end(self) -> str:
        return self.machine.decode(b"", final=True)


def default_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.tiktoken")


def _broadcast(spark: SparkSession, vocabulary_path: str | None):
    """The vocabulary file (under a megabyte) for the tasks; only the driver needs the path."""
    with open(vocabulary_path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str, text: str, vocabulary_path: str | None = None, rows: int = 512) -> DataFrame:
    """key, ids (array of int) of every row."""
    raw = _broadcast(df.sparkSession, vocabulary_path)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(raw.value)
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                b = whole.slice(a, rows)
                packed = [e.packed(t) for t in b.column(1).to_pylist()]
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, vocabulary_path: str | None = None) -> DataFrame:
    """The columns in keep and n_tokens of every row."""
    raw = _broadcast(df.sparkSession, vocabulary_path)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(raw.value)
        for b in batches:
            n = [len(e.packed(t)) // 4 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{kinds}, n_tokens long")


def decode(df: DataFrame, key: str, ids: str, vocabulary_path: str | None = None) -> DataFrame:
    """key, text of every row of ids."""
    raw = _broadcast(df.sparkSession, vocabulary_path)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(raw.value).vocabulary
        for b in batches:
            texts = []
            for row in b.column(1).to_pylist():
                d = StreamDecoder(v)
                texts.append(d.feed(row or []) + d.end())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, F.col(ids).alias("__ids")).mapInArrow(run, f"`{key}` {kind.simpleString()}, text string")
