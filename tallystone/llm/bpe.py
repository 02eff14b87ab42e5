"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The encodings of byte strings form a monoid: ``join`` gives the encoding of a concatenation from those of
its parts. A pre-token is cut into halves down to short leaves, the leaves are merged by rank, and neighbours
are joined up the tree. A join re-encodes a window around the seam and lets it grow until its first and last
tokens come out as they were (or the window has reached the end). Then no token outside can change: an
encoding is the right one exactly if each two adjacent tokens are the encoding of their own bytes, every
adjacent pair outside the window is unchanged, and those at its ends are pairs that stood there before. This
needs a vocabulary in which each token encodes to itself, which is checked when it is loaded.

Decoding concatenates the tokens' bytes up the same kind of tree.
"""

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

#: Bytes of a leaf of the encoding tree.
LEAF = 6
#: Bytes up to which pairs are merged in a plain list.
SHORT = 64
#: Ids of a leaf of the decoding tree.
RUN = 4096
#: Encoded chunks that a worker remembers; it forgets all of them beyond that.
REMEMBERED = 600_000
#: Rows that a worker returns at once.
PART = 512


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Encoder:
    """Encodes and decodes by a table of ranks and a pre-token pattern, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # the library's \s is the Unicode property; the regex module's also has U+001C to U+001F
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.inner: dict[str, bytes] = {}  # chunks after a space
        self.first: dict[str, bytes] = {}  # chunks at a line's start
        self.merged: dict[bytes, list[int]] = {}  # leaves and windows

    def check(self) -> None:
        """Raises ValueError unless each token encodes to itself."""
        for token, rank in self.ranks.items():
            if self.merge(token) != [rank]:
                raise ValueError(f"token {rank} doesn't encode to itself: joins would not be exact")

    def merge(self, piece: bytes) -> list[int]:
        """Rank-greedy merging, leftmost first among equals: the leaf of the tree and the window of a join."""
        get, none = self.ranks.get, len(self.tokens)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(piece) <= SHORT:
            pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
            while pairs and (best := min(pairs)) < none:
                i = pairs.index(best)
                del pairs[i]
                parts[i] = made = parts[i] + parts.pop(i + 1)
                if i < len(pairs):
                    pairs[i] = get(made + parts[i + 1], none)
                if i:
                    pairs[i - 1] = get(parts[i - 1] + made, none)
            return [self.ranks[p] for p in parts]
        # long windows: the same order of merges from a heap
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts) and (r := get(pair := parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(pair)))
        return [self.ranks[p] for p in parts if p]

    def window(self, piece: bytes) -> list[int]:
        """``merge``, remembered for short strings: halves and seams recur far more often than words."""
        if (ids := self.merged.get(piece)) is None:
            ids = self.merge(piece)
            if len(piece) <= 4 * LEAF:
                if len(self.merged) >= REMEMBERED:
                    self.merged.clear()
                self.merged[piece] = ids
        return ids

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of a concatenation from those of its two parts."""
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            x, y = left[-a:], right[:b]
            new = self.window(b"".join([self.tokens[t] for t in x + y]))
            stable_left = a == len(left) or new[0] == x[0]
            stable_right = b == len(right) or new[-1] == y[-1]
            if stable_left and stable_right:
                return left[:-a] + new + right[b:]
            a = a if stable_left else min(2 * a, len(left))
            b = b if stable_right else min(2 * b, len(right))

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, halves first."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) <= LEAF:
            return self.window(piece)
        half = len(piece) // 2
        return self.join(self.piece(piece[:half]), self.piece(piece[half:]))

    def plain(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers, each match of the pattern by itself."""
        return array("I", [i for m in self.pattern.findall(text) for i in self.piece(m.encode())]).tobytes()

    def encode(self, text: str) -> bytes:
        """As ``plain``, but chunks that end where the pattern ends any match are encoded once and remembered.

        A space or line feed between two characters that are no white space always starts a match, and
        nothing before it is part of that match. So a line cut there gives chunks that don't affect each other.
        """
        out = []
        for n, line in enumerate(text.split("\n")):
            chunks = line.split(" ")
            try:
                found = [self.first[chunks[0]], *[self.inner[c] for c in chunks[1:]]]
            except KeyError:
                if not line or UNSAFE.search(line):
                    return self.plain(text) if len(text) < 1000 else self.cut(text)
                self.learn(chunks)
                found = [self.first[chunks[0]], *[self.inner[c] for c in chunks[1:]]]
            if n:
                out.append(self.feed)
            out += found
        return b"".join(out)

    @property
    def feed(self) -> bytes:
        if (known := self.__dict__.get("_feed")) is None:
            known = self._feed = self.plain("\n")
        return known

    def learn(self, chunks: list[str]) -> None:
        if len(self.inner) + len(self.first) + len(chunks) > REMEMBERED:
            self.inner.clear()
            self.first.clear()
        if chunks[0] not in self.first:
            self.first[chunks[0]] = self.plain(chunks[0])
        for c in chunks[1:]:
            if c not in self.inner:
                self.inner[c] = self.plain(" " + c)

    def cut(self, text: str) -> bytes:
        """For texts with runs of white space: parts cut before single spaces and line feeds, several chunks each."""
        out, start = [], 0
        for m in CUT.finditer(text):
            if m.start() - start >= 200:
                out.append(self.plain(text[start : m.start()]))
                start = m.start()
        return b"".join([*out, self.plain(text[start:])])


def joined(tokens: list[bytes], ids: np.ndarray) -> bytes:
    """The bytes of ids, concatenated up a tree."""
    if len(ids) <= RUN:
        return b"".join([tokens[i] for i in ids.tolist()])
    half = len(ids) // 2
    return joined(tokens, ids[:half]) + joined(tokens, ids[half:])


#: White space in a line other than single spaces between characters that are no white space.
UNSAFE = regex.compile(r"\A\s|\s\Z| \s|\s ")
#: A single space or line feed between characters that are no white space; \s here has no less than the pattern's.
CUT = regex.compile(r"(?<=\S)[ \n](?=\S)")


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines())}


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    made = Encoder(_ranks(data), pattern)
    made.check()
    return made


@lru_cache(maxsize=2)
def _tokens(data: bytes) -> list[bytes]:
    ranks = _ranks(data)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _encoded(vocabulary, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _encoder(vocabulary.value, pattern)
        for b in batches:
            for i in range(0, b.num_rows, PART):
                part = b.slice(i, PART)
                ids = [made.encode(t) if (t := x.as_py()) else b"" for x in part.column(1)]
                columns = [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if decoded:
                    columns.append(pa.array([joined(made.tokens, np.frombuffer(x, "<u4")) for x in ids], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _decoded(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(vocabulary.value)
        for b in batches:
            for i in range(0, b.num_rows, PART):
                part = b.slice(i, PART)
                texts = [joined(tokens, np.frombuffer(x.as_py() or b"", "<u4")) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _shipped(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver and broadcast: a file of some 50,000 short lines, below 1 MB."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id``, ``n_tokens`` (long) and ``ids`` (binary, little-endian unsigned 32-bit) of every whole text.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored; one row per row. Null and empty texts
    have no ids. ``path`` names a file of base64 tokens and ranks. Work is per document, without a shuffle.
    """
    known = _shipped(docs.sparkSession, path or default_vocabulary())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(known, pattern, False), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the bytes of their ids; null ids give no bytes."""
    known = _shipped(encoded.sparkSession, path or default_vocabulary())
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoded(known), "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``decode(encode(docs))`` in one pass, with one worker a task instead of two."""
    known = _shipped(docs.sparkSession, path or default_vocabulary())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(known, pattern, True), "doc_id long, n_tokens long, ids binary, decoded binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(read_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
