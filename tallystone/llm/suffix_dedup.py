"""Suffix-array dedup: repeated byte strings of a least length, by threshold-bounded interval expansion.

What counts is which strings of 50 bytes start in which documents. In suffix order the suffixes that begin with one
string are an interval of rows. ``Transform`` holds the Burrows-Wheeler transform of a set of texts: the symbol
before each row's suffix, and where that longer suffix has its row. ``Transform.common_prefixes`` extends intervals
backward by one symbol, breadth first, all intervals of one length as one vector operation. An interval's end that
no shorter string has closed gets its common-prefix value then, so values appear in increasing order; an interval whose end is
closed already is dropped. Values below 50 are derived and no others: ends that are still open at 50 are within groups of
equal strings.

No machine holds the suffix array of all documents. Each string belongs to its least 20-byte hash (its key),
which depends on its content alone, so equal strings have equal keys. Consecutive strings of a document with one
key form a run, of 14 strings on average. Blocks of some 16 MB of documents first exchange their keys, 31 bits each;
the text of a run is sent only if its key is in several documents, once for each block that has it. A bucket of keys counts
each different text once; only the texts of keys that have several different texts need suffix order, the others
hold no string of another text. A key with very many different texts (where a frequent passage
meets ever other text) is split further by a hash of the whole string, so that a bucket holds at most one text of
a key for each block, and one string once it is split.

Blocks and buckets exchange one piece for each pair of them, as tasks of a shuffle do; both sides grow by bytes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Table, read_table

LENGTH, GRAM = 50, 20
BLOCK_BYTES = 16_000_000
BUCKET_BYTES = 8_000_000
#: Bytes whose keys are computed at once, and bytes of texts in one suffix order (more only for one key, see ``HOT``).
STEP, ORDERED_BYTES = 1 << 20, 1 << 20
#: Texts of a key, summed over the blocks, from which on its runs are split by string.
HOT = 65_536
#: Sorts after all doc_ids: a null doc_id.
NO_ID = np.iinfo(np.int64).max

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


_compressor, _decompressor = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()  # made once: blobs are many and small


def _deflate(b: bytes) -> bytes:
    return _compressor.compress(b)


def _inflate(b: bytes) -> bytes:
    return _decompressor.decompress(b)


def _pack(a: np.ndarray) -> bytes:
    return _deflate(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(_inflate(b), kind)


def _eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as an integer; bytes after the end are 0."""
    x = np.zeros(len(b) + 7, np.uint64)
    x[: len(b)] = b
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    return x[:-4] << np.uint64(32) | x[4:]


def _eight_at(b: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The eight bytes from each of the positions on as an integer."""
    x = b[positions].astype(np.uint64)
    for i in range(1, 8):
        x = x << np.uint64(8) | b[positions + i]
    return x


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(29)
    return h


def _keys(b: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes its key, the least hash of its ``GRAM``-byte parts."""
    if len(b) > STEP + length:
        return np.concatenate([_keys(b[i : i + STEP + length - 1], length) for i in range(0, len(b) - length + 1, STEP)])
    x = _eights(b)
    n = len(b) - GRAM + 1
    with np.errstate(over="ignore"):
        h = x[:n] * _A
        h ^= h >> np.uint64(31)
        h += x[8 : 8 + n] * _B
        h ^= h >> np.uint64(30)
        h += (x[GRAM - 8 : GRAM - 8 + n] ^ _C) * _B
        h = _mixed(h)
    width, size = length - GRAM + 1, 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


class Block:
    """A block of documents and the runs of their strings."""

    def __init__(self, ranks: np.ndarray, sizes: np.ndarray, data: bytes, length: int):
        self.ranks, self.sizes, self.data, self.length = ranks, sizes, data, length
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes

    @classmethod
    def of(cls, row: dict, length: int) -> "Block":
        return cls(_unpack(row["ranks"], np.int64), _unpack(row["sizes"], np.int64), _inflate(row["data"]), length)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, first start, number of starts and document's index of each run."""
        parts = [(np.empty(0, np.uint64), *(np.empty(0, np.int32),) * 3)]
        first, most = 0, np.searchsorted(self.ends, self.begins + STEP, "right")
        while first < len(self.sizes):
            last = max(first + 1, int(most[first]))
            parts.append(self._runs(first, last))
            first = last
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _runs(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs of documents ``first`` to ``last`` (not included)."""
        begin = int(self.begins[first])
        counts = np.maximum(self.sizes[first:last] - self.length + 1, 0)
        if not counts.any():
            return (np.empty(0, np.uint64), *(np.empty(0, np.int32),) * 3)
        key = _keys(np.frombuffer(self.data, np.uint8)[begin : int(self.ends[last - 1])], self.length)
        cuts = np.cumsum(counts)
        long = counts > 0
        starts = np.arange(cuts[-1], dtype=np.int32)
        starts += np.repeat((self.begins[first:last] - begin - (cuts - counts))[long].astype(np.int32), counts[long])
        key = key[starts]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        fresh[(cuts - counts)[long]] = True
        at = np.flatnonzero(fresh)
        return key[at], starts[at] + np.int32(begin), np.diff(np.append(at, len(key))).astype(np.int32), (np.searchsorted(cuts, at, "right") + first).astype(np.int32)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _short(key: np.ndarray) -> np.ndarray:
    """31 bits of a key that its bucket doesn't tell, shifted left for a mark."""
    return (key & np.uint64(0x7FFFFFFF)).astype(np.uint32) << np.uint32(1)


def _blocks(block_bytes: int):
    """Rows (doc_id, text, other columns) to blocks; the other columns travel as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ranks, texts, others, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal number, ranks, texts, others, size
            sizes = np.array([len(t) for t in texts], np.int64)
            stream = pa.BufferOutputStream()
            with pa.ipc.new_stream(stream, others[0].schema) as writer:
                for part in others:
                    writer.write_batch(part)
            blobs = [_pack(np.array(ranks, np.int64)), _pack(sizes), _deflate(b"".join(texts)), _deflate(stream.getvalue().to_pybytes())]
            row = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(sizes.sum())]), *(pa.array([x], pa.binary()) for x in blobs)], ["block", "bytes", "ranks", "sizes", "data", "others"])
            number, ranks, texts, others, size = number + 1, [], [], [], 0
            return row

        for b in batches:
            rest = b.select(b.schema.names[2:])
            begin = 0
            for n, (doc_id, text) in enumerate(zip(b.column(0), b.column(1)), 1):
                ranks.append(NO_ID if (i := doc_id.as_py()) is None else i)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= block_bytes or len(texts) >= 1 << 16:
                    others.append(rest.slice(begin, n - begin))
                    begin = n
                    yield out()
            if begin < b.num_rows:
                others.append(rest.slice(begin))
        if texts:
            yield out()

    return run


def _key_rows(buckets: int, length: int):
    """Each block's keys by bucket, with the binary logarithm of their different texts there, rounded up.

    The mark says that documents of different ids in the block have the key. Texts count as different by their length,
    first and last eight bytes: enough to tell which keys have very many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block.of(row, length)
                key, start, count, doc = block.runs()
                if not len(key):
                    continue
                view = np.frombuffer(block.data, np.uint8)
                with np.errstate(over="ignore"):
                    look = (_eight_at(view, start) * _A ^ _eight_at(view, start + count + length - 9)) * _B + count.astype(np.uint64)
                order = np.lexsort((look, key))
                key, look, rank = key[order], look[order], block.ranks[doc[order]]
                del start, count, doc, order
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                several = np.minimum.reduceat(rank, first) != np.maximum.reduceat(rank, first)
                differs = np.concatenate(([True], (key[1:] != key[:-1]) | (look[1:] != look[:-1])))
                texts = np.ceil(np.log2(np.add.reduceat(differs.astype(np.int64), first))).astype(np.uint8)
                key = key[first]
                bucket, short = _bucket(key, buckets), _short(key) | several.astype(np.uint32)
                order = np.lexsort((short, bucket))
                bucket, short, texts = bucket[order], short[order], texts[order]
                at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                ends = np.append(at[1:], len(bucket))
                blobs = ([x[i:j].tobytes() for i, j in zip(at, ends)] for x in (short, texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[at].astype(np.int32)), pa.array(np.full(len(at), row["block"])), *(pa.array(b, pa.binary()) for b in blobs)], ["bucket", "block", "keys", "texts"]
                )

    return run


def _shared(hot: int):
    """Of each block's keys in a bucket those that several documents have; the mark says that a key has very many texts."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
        texts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("texts")]).astype(np.float64)
        sizes = np.array([len(x) for x in blobs])
        keys = np.concatenate(blobs)
        key, several = keys >> np.uint32(1), (keys & np.uint32(1)).astype(np.int64)
        order = np.argsort(key)
        sorted_key = key[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
        count = np.diff(np.append(first, len(key)))
        wanted = (count > 1) | (np.add.reduceat(several[order], first) > 0)
        many = np.add.reduceat(np.exp2(texts[order]), first) > hot
        mark = np.empty(len(key), np.int8)
        mark[order] = np.repeat(wanted.astype(np.int8) + many, count)
        mark[order] *= np.repeat(wanted, count)
        ends = np.cumsum(sizes)
        out = [(keys[i:j] & ~np.uint32(1) | (mark[i:j] > 1).astype(np.uint32))[mark[i:j] > 0] for i, j in zip(ends - sizes, ends)]
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "keys": pa.array([x.tobytes() for x in out], pa.binary())})

    return run


#: The bucket of a row that tells a block which of its strings are in which text is this less the block's number.
PLAN = -1


def _deltas(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=x[:1] * 0).astype(np.int32))


def _undelta(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.int32), dtype=np.int64)


def _texts(buckets: int, length: int):
    """For each block: its texts of shared keys by bucket, and a plan of where they are."""
    names = ["bucket", "block", "texts", "sizes", "keys", "ranks"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({n: pa.array([], pa.int64() if n in ("bucket", "block") else pa.binary()) for n in names})
        if not left.num_rows or not right.num_rows:
            return none
        number = left.column("block")[0].as_py()
        block = Block.of(left.to_pylist()[0], length)
        key, start, count, doc = block.runs()
        wanted = [np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, k in zip(right.column("bucket").to_pylist(), right.column("keys").to_pylist())]
        wanted = np.sort(np.concatenate(wanted))
        bucket = _bucket(key, buckets)
        short = _short(key)
        code = short.astype(np.uint64) | bucket.astype(np.uint64) << np.uint64(32)
        at = np.searchsorted(wanted, code).clip(max=max(len(wanted) - 1, 0))
        found = (wanted[at] & ~np.uint64(1)) == code if len(wanted) else np.zeros(len(code), bool)
        hot = (wanted[at] & np.uint64(1)).astype(bool)[found] if len(wanted) else found[:0]
        bucket, start, count, doc, short = (x[found] for x in (bucket, start, count, doc, short))
        if hot.any():  # one string a run
            n = count[hot]
            s = np.repeat(start[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            view = np.frombuffer(block.data, np.uint8)
            spread = np.concatenate([_spread(view, s[i : i + STEP], length) for i in range(0, len(s), STEP)])
            parts = ((bucket, _bucket(spread, buckets)), (start, s), (doc, np.repeat(doc[hot], n)), (short, _short(spread)))
            bucket, start, doc, short = (np.concatenate((x[~hot], y)) for x, y in parts)
            count = np.concatenate((count[~hot], np.ones(len(s), np.int64)))
        if not len(start):
            return none
        order = np.lexsort((start, bucket))
        bucket, start, count, doc, short = (x[order] for x in (bucket, start, count, doc, short))
        data = block.data
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(cuts[1:], len(bucket))
        rows, places = [], []
        sizes = count + length - 1
        for i, j in zip(cuts.tolist(), ends.tolist()):
            known: dict[bytes, int] = {}
            same = np.fromiter((known.setdefault(data[a:b], len(known)) for a, b in zip(start[i:j].tolist(), (start + sizes)[i:j].tolist())), np.int64, j - i)
            least = np.full(len(known), NO_ID)
            np.minimum.at(least, same, block.ranks[doc[i:j]])
            of_text, size = np.empty(len(known), np.uint32), np.empty(len(known), np.int32)
            of_text[same], size[same] = short[i:j], sizes[i:j]
            rows.append((int(bucket[i]), _deflate(b"".join(known)), _pack(size), _pack(of_text), _pack(least)))
            places.append(same)
        plan = (_deltas(bucket[cuts]), _deltas(ends - cuts), _deltas(start), _pack(np.stack((count, np.concatenate(places))).astype(np.int32)))
        rows.append((PLAN - number, *plan))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([number] * len(rows), pa.int64()), **{n: pa.array([r[k] for r in rows], pa.binary()) for k, n in enumerate(names[2:], 1)}})

    return run


def _spread(view: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of each whole string."""
    total = np.zeros(len(starts), np.uint64)
    offsets = [*range(0, length - 8, 8), length - 8]
    with np.errstate(over="ignore"):
        for k, o in enumerate(offsets):
            total = (total ^ _eight_at(view, starts + o) * (_A, _B, _C)[k % 3]) * _B + np.uint64(k)
            total ^= total >> np.uint64(31)
        return _mixed(total)


#: The symbol that ends a text; a byte's symbol is one more than the byte.
END = 0


class Transform:
    """The Burrows-Wheeler transform of texts, their suffixes being ordered by their first ``length`` symbols at least.

    A text ends with ``END``, and so does each suffix: it is never compared beyond. ``order`` are the suffixes'
    positions by row, ``before`` the symbol before each; ``up[row]`` is the row of the suffix that begins one symbol earlier, and
    ``down`` its inverse. Rows of equal suffixes are in no particular order, which intervals of strings
    up to ``length`` don't depend on.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int):
        n = len(data) + len(sizes)
        self.ends = np.cumsum(sizes + 1) - 1
        symbols = np.ones(n, np.uint16)
        symbols[self.ends] = END
        symbols[symbols > 0] = data.astype(np.uint16) + 1
        self.left = np.repeat(self.ends, sizes + 1) - np.arange(n)  # bytes from each position to its text's end
        self.order = self._ordered(symbols, length)
        self.before = symbols[self.order - 1]
        self.first = symbols[self.order]
        self.down = np.argsort(self.before, kind="stable").astype(np.int32)
        self.up = np.empty(n, np.int32)
        self.up[self.down] = np.arange(n, dtype=np.int32)

    def _ordered(self, symbols: np.ndarray, length: int) -> np.ndarray:
        """Rows by prefix doubling, from seven symbols of nine bits in an integer."""
        n, reached = len(symbols), 7
        code = np.zeros(n, np.uint64)
        for i in range(reached):
            part = np.zeros(n, np.uint64)
            part[: n - i] = symbols[i:]
            part[self.left < i] = END
            code = code << np.uint64(9) | part
        order = np.argsort(code)
        while reached < length:
            sorted_code = code[order]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(np.concatenate(([True], sorted_code[1:] != sorted_code[:-1])), dtype=np.uint64)
            then = np.zeros(n, np.uint64)
            then[: n - reached] = rank[reached:]
            then[self.left < reached] = 0
            code = rank * np.uint64(n + 1) + then
            order = np.argsort(code)
            reached *= 2
        return order

    def common_prefixes(self, length: int) -> np.ndarray:
        """What each row's suffix has in common with that of the row before it, in symbols; ``length`` if at least that.

        The ends of the texts count as one symbol, so that equal suffixes shorter than ``length`` count as one string too.
        """
        n = len(self.order)
        value = np.full(n + 1, length, np.int16)
        value[0] = value[n] = 0
        low, high = np.array([0], np.int32), np.array([n], np.int32)
        for reached in range(length):
            size = high - low
            rows = np.arange(size.sum(), dtype=np.int32) + np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)
            lows, highs = np.repeat(low, size), np.repeat(high, size)
            if reached:  # nothing is asked of strings that reach over a text's begin
                within = self.before[rows] != END
                rows, lows, highs = rows[within], lows[within], highs[within]
            up = self.up[rows]
            symbol = self.before[rows]
            after = np.minimum(up + 1, n - 1)
            last = (up + 1 == n) | (self.first[after] != symbol) | (self.down[after] >= highs)
            prior = np.maximum(up - 1, 0)
            begins = (up == 0) | (self.first[prior] != symbol) | (self.down[prior] < lows)
            low, high = np.sort(up[begins]), np.sort(up[last]) + np.int32(1)
            open_ = value[high] == length
            low, high = low[open_], high[open_]
            value[high] = reached
            if not len(high):
                break
        value[0] = 0
        return value[:n]


def least_ranks(data: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes of each text, in order, the least rank of the texts that hold it."""
    made = Transform(data, sizes, length)
    first = np.flatnonzero(made.common_prefixes(length) < length)
    rank = np.where(made.left >= length, np.repeat(ranks, sizes + 1), NO_ID)[made.order]
    least = np.empty(len(rank), np.int64)
    least[made.order] = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(rank))))
    return least[made.left >= length]


def _slices(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of slices of the given offsets and lengths, one after the other."""
    return np.arange(counts.sum()) + np.repeat(offsets - (np.cumsum(counts) - counts), counts)


def _least_of_texts(texts: list[bytes], keys: np.ndarray, ranks: np.ndarray, length: int) -> np.ndarray:
    """Of the strings of different texts, one text after the other: the least rank of the texts that hold each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = sizes - length + 1
    offsets = np.cumsum(counts) - counts
    least = np.repeat(ranks, counts)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    several = np.repeat(n := np.diff(np.append(first, len(order))), n) > 1
    order = order[several]  # a text alone under its key shares no string
    following = np.append(np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1, len(order))  # where keys end
    upto = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        fit = np.searchsorted(upto, (upto[at - 1] if at else 0) + ORDERED_BYTES, "right")
        k = np.searchsorted(following, fit, "right") - 1
        if k < 0 or following[k] <= at:
            k = np.searchsorted(following, at, "right")
        end = int(following[k])
        own = order[at:end]
        found = least_ranks(np.frombuffer(b"".join([texts[t] for t in own.tolist()]), np.uint8), sizes[own], ranks[own], length)
        least[_slices(offsets[own], counts[own])] = found
        at = end
    return least


def _least(length: int):
    """For each block, the least rank that holds each string of its texts in a bucket; a plan passes as it is."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() <= PLAN:
            return table
        known: dict[bytes, int] = {}
        same, ranks, keys = [], [], []
        for texts, sizes, key, rank in zip(*(table.column(n) for n in ("texts", "sizes", "keys", "ranks"))):
            data, ends = _inflate(texts.as_py()), np.cumsum(_unpack(sizes.as_py(), np.int32), dtype=np.int64)
            same.append(np.fromiter((known.setdefault(data[a:b], len(known)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())), np.int64, len(ends)))
            ranks.append(_unpack(rank.as_py(), np.int64))
            keys.append(_unpack(key.as_py(), np.uint32))
        every = np.concatenate(same)
        rank, key = np.full(len(known), NO_ID), np.empty(len(known), np.uint32)
        np.minimum.at(rank, every, np.concatenate(ranks))
        key[every] = np.concatenate(keys)
        least = _least_of_texts(list(known), key, rank, length)
        counts = np.fromiter(map(len, known), np.int64, len(known)) - length + 1
        offsets = np.cumsum(counts) - counts
        blobs = [_pack(least[_slices(offsets[x], counts[x])]) for x in same]
        sized = [_pack(counts[x].astype(np.int32)) for x in same]
        empty = pa.array([b""] * len(same), pa.binary())
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "texts": empty, "sizes": pa.array(sized, pa.binary()), "keys": empty, "ranks": pa.array(blobs, pa.binary())})

    return run


def _whole_characters(gone: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``gone`` of a document without the bytes of UTF-8 characters of which another byte stays."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, len(data)))) if len(first) and not first[0] else gone


def _applied(length: int, whole: bool):
    """The documents of a block with what is removed from them, and their other columns."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block.of(row, length)
        data = np.frombuffer(block.data, np.uint8)
        # where strings begin and end; each document has one place more, for those that end with it, so that documents are worked off one by one
        change = np.zeros(len(data) + len(block.sizes), np.int8)
        answers = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        if answers:
            plan, answers = answers[0], answers[1:]  # the plan's number is below all buckets
            buckets, runs, start = (_undelta(plan[n]) for n in ("texts", "sizes", "keys"))
            count, place = _unpack(plan["ranks"], np.int32).astype(np.int64).reshape(2, -1)
            if [r["bucket"] for r in answers] != buckets.tolist():
                raise ValueError("a bucket's answer is missing")
            doc = np.searchsorted(block.ends, start, "right")
            rank = block.ranks[doc]
            end = 0
            for answer, n_runs in zip(answers, runs.tolist()):
                own = slice(end, end := end + n_runs)
                sizes = _unpack(answer["sizes"], np.int32).astype(np.int64)
                n = count[own]
                hit = _unpack(answer["ranks"], np.int64)[_slices((np.cumsum(sizes) - sizes)[place[own]], n)] < np.repeat(rank[own], n)
                at = _slices(start[own] + doc[own], n)[hit]
                change[at] += 1
                change[at + length] -= 1
        spans, kept = [], []
        for k, (i, j) in enumerate(zip(block.begins.tolist(), block.ends.tolist())):
            mask = np.cumsum(change[i + k : j + k], dtype=np.int32) > 0
            if whole and mask.any():
                mask = _whole_characters(mask, data[i:j])
            if not mask.any():
                spans.append([])
                kept.append(block.data[i:j])
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
            spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            kept.append(data[i:j][~mask].tobytes())
        others = pa.ipc.open_stream(_inflate(row["others"])).read_all()
        found = [pa.array(block.ranks, mask=block.ranks == NO_ID), pa.array(block.sizes), pa.array(spans, span), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays([*found, *others.columns], names=["_doc_id", "_n_bytes", "_spans", "_kept", *others.column_names])

    return run


def _removed(docs: DataFrame, others: list[str], length: int, block_bytes: int, bucket_bytes: int, hot: int, whole: bool) -> DataFrame:
    """``_doc_id``, ``_n_bytes``, ``_spans``, ``_kept`` and the columns ``others``, as other0 and so on, of every document."""
    if length < GRAM + 8:
        raise ValueError(f"strings have {GRAM + 8} bytes at least")
    named = [F.col(f"`{c}`").alias(f"other{i}") for i, c in enumerate(others)]
    text = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), F.col("text").cast("binary").alias("_text"), *named)
    blocks = Table(text.mapInArrow(_blocks(block_bytes), "block long, bytes long, ranks binary, sizes binary, data binary, others binary"), "blocks").df
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    # for each shuffle task two at least, so that few documents still use many tasks
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    own = blocks.select("block", "ranks", "sizes", "data")
    by_bucket = "bucket int, block long, keys binary"
    shared = Table(own.mapInArrow(_key_rows(buckets, length), f"{by_bucket}, texts binary").groupBy("bucket").applyInArrow(_shared(hot), by_bucket), "keys").df
    rows = "bucket long, block long, texts binary, sizes binary, keys binary, ranks binary"
    texts = own.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_texts(buckets, length), rows)
    plans = texts.groupBy("bucket").applyInArrow(_least(length), rows)
    kinds = T.StructType.fromDDL("_doc_id long, _n_bytes long, _spans array<struct<start:long,end:long>>, _kept binary")
    schema = T.StructType([*kinds.fields, *text.schema.fields[2:]])
    return blocks.drop("bytes").groupBy("block").cogroup(plans.groupBy("block")).applyInArrow(_applied(length, whole), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """What stays of every document when each repeated string of ``length`` bytes stays in its first document only.

    ``docs`` has ``doc_id`` and ``text`` (string or binary); other columns are ignored; one row per row. A
    byte is removed if it is covered by a string of ``length`` bytes that also starts in a document of smaller
    doc_id; strings are judged on the input, overlaps count, none crosses documents. Returns ``doc_id``, ``n_bytes``, ``spans``
    (array of start and end, byte offsets in the document, maximal removed runs) and ``kept`` (binary).

    Null texts are empty; texts shorter than ``length`` stay whole. A null doc_id is larger than any other. Of rows
    with equal doc_id none is first, so they don't affect each other. An empty table gives no rows.
    """
    done = _removed(docs, [], length, block_bytes, bucket_bytes, hot, False)
    return done.select(F.col("_doc_id").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), F.col("_spans").alias("spans"), F.col("_kept").alias("kept"))


def without_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """``docs``, all columns and rows, with what ``remove_repeats`` leaves of each text, in whole characters.

    A character of which a byte would stay stays. A null text becomes an empty one. ``n_chars``, if there is one, is
    the new text's length.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = _removed(docs, others, length, block_bytes, bucket_bytes, hot, True)
    named = {"doc_id": F.col("_doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text": F.col("_kept").cast("string").alias("text")}
    if "n_chars" in others:
        named["n_chars"] = F.length(F.col("_kept").cast("string")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*(named[c] if c in named else F.col(f"other{others.index(c)}").alias(c) for c in docs.columns))


def removed_bytes(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", removed_bytes().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
