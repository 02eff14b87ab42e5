"""SimHash near-dedup by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit of one of their two
32-bit segments. So each distinct fingerprint is indexed under 64 keys: each segment with each one of its
bits masked. Fingerprints that share a key are candidates; the full distance is then verified. Equal keys meet as in a
merge join of the index with itself: rows are dealt by key and sorted, and one scan compares neighbours of equal key, so that no pair is ever a row. A key with
more than ``GROUP`` fingerprints is not compared as a whole: its members are indexed again by the two
16-bit halves of the other segment, then by the two 8-bit quarters of what remains, in the same way. After
the third level at most 11 bits are free, so no group can have more than 2,048 members: the bound holds for
any input and loses no link.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Table, connected_components, read_table

DISTANCE = 3
#: The largest group compared at once, 2 ** 11; see above.
GROUP = 2048
#: Shared-key rows held at once by a task.
HELD = 1 << 18
SPACE = b" "


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes (unsigned): each bit is that of over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned 64-bit integer; 0 without words."""
    w = text.lower().split()  # bytes: lower() maps A-Z only, split() cuts at 0x20 and 0x09-0x0D
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(SPACE.join(w), seed)
    digest, join = xxhash.xxh64_intdigest, SPACE.join
    return majority(np.fromiter((digest(join(s), seed) for s in zip(*(w[i:] for i in range(words)))), np.uint64, len(w) - words + 1))


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", words, seed) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id`` and its SimHash ``fp`` (the unsigned value's bits as a signed long), one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, shingles are ``words`` of them joined by a
    space, repeats included. Shorter texts are one shingle; null, empty and blank texts have fingerprint 0.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def _close(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= distance


def _forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join what is linked within a group, one fewer than members for each linked part."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(fp))
    while len(left):
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = _close(fp[left], fp[front.pop()], distance)
            found, left = left[near], left[~near]
            edges += [(int(root), int(x)) for x in found]
            front += found.tolist()
    return edges


def _links(distance: int, group: int):
    """Over rows sorted by (k1, k2): edges within each key, or the rows of a key that holds more than ``group``."""
    names = ["a", "b", "k1", "k2"]

    def edges_of(k1: np.ndarray, k2: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
        sizes = np.diff(np.append(starts, len(fp)))
        a, b = [], []
        small = np.repeat(np.where(sizes <= 24, sizes, 0), sizes)
        left = small - (np.arange(len(fp)) - np.repeat(starts, sizes))  # members from here to the group's end
        step, at = 1, np.flatnonzero(left > 1)
        while len(at):
            near = at[_close(fp[at], fp[at + step], distance)]
            a.append(fp[near])
            b.append(fp[near + step])
            step += 1
            at = at[left[at] > step]
        for s, n in zip(starts[sizes > 24], sizes[sizes > 24]):
            if e := _forest(own := fp[s : s + n], distance):
                i, j = np.array(e).T
                a.append(own[i])
                b.append(own[j])
        none = np.empty(0, np.uint64)
        a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.uint64)
        return pairs[0], pairs[1]

    def out(a, b, k1=None, k2=None) -> pa.RecordBatch:
        nothing = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), nothing if b is None else pa.array(b.view(np.int64)), nothing if k1 is None else pa.array(k1), nothing if k2 is None else pa.array(k2)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows, large = 0, None  # large: the key whose rows are passed on
        for b in batches:
            k1, k2, fp = (b.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            if large is not None:
                same = (k1 == large[0]) & (k2 == large[1])
                if same.any():
                    yield out(fp[same], None, k1[same], k2[same])
                    k1, k2, fp = k1[~same], k2[~same], fp[~same]
                if not len(fp):
                    continue
                large = None
            held.append((k1, k2, fp))
            rows += len(fp)
            if rows < HELD:
                continue
            k1, k2, fp = (np.concatenate(x) for x in zip(*held))
            cut = int(np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1]))[-1]) + 1 if (k1[0], k2[0]) != (k1[-1], k2[-1]) else 0
            yield from done(k1[:cut], k2[:cut], fp[:cut])
            held, rows = [(k1[cut:], k2[cut:], fp[cut:])], len(fp) - cut
            if rows > group:
                large = (k1[-1], k2[-1])
                yield out(fp[cut:], None, k1[cut:], k2[cut:])
                held, rows = [], 0
        if rows:
            yield from done(*(np.concatenate(x) for x in zip(*held)))

    def done(k1, k2, fp) -> Iterator[pa.RecordBatch]:
        if not len(fp):
            return
        starts = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
        sizes = np.repeat(s := np.diff(np.append(starts, len(fp))), s)
        if (over := sizes > group).any():
            yield out(fp[over], None, k1[over], k2[over])
            k1, k2, fp = k1[~over], k2[~over], fp[~over]
        keep = sizes[~over] > 1
        if keep.any():
            yield out(*edges_of(k1[keep], k2[keep], fp[keep]))

    return run


def _masked(part, bits: int, at):
    """``part`` with the bit ``at`` cleared."""
    return part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), at)))


def _part(fp, shift, bits: int):
    return F.call_function("shiftrightunsigned", fp, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _keys(rows: DataFrame, level: int) -> DataFrame:
    """The index rows (k1, k2, fp) of a level; from level 2 on ``rows`` are those of keys that were too large.

    A key of level 1 holds segment (1 bit), masked bit (5), segment's other bits (32); level 2 adds half
    (1), masked bit (4) and bits (16), so that k1 has 59 bits; level 3 adds quarter, bit and bits in k2.
    """
    bits = {1: 32, 2: 16, 3: 8}[level]
    log = {1: 5, 2: 4, 3: 3}[level]
    variants = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2 * bits - 1))))
    half, at = F.floor(F.col("i") / bits).cast("int"), F.col("i") % bits
    code = F.col("i").cast("long")  # half and masked bit together
    if level == 1:
        part = _part(F.col("fp"), half * 32, 32)
        return variants.select(code.bitwiseOR(F.shiftleft(_masked(part, 32, at), 6)).alias("k1"), F.lit(0).cast("long").alias("k2"), "fp")
    other = (1 - F.shiftright(F.col("k1").bitwiseAND(F.lit(63).cast("long")), 5)).cast("int") * 32
    if level == 2:
        part = _part(F.col("fp"), other + half * 16, 16)
        return variants.select(F.col("k1").bitwiseOR(F.shiftleft(code.bitwiseOR(F.shiftleft(_masked(part, 16, at), log + 1)), 38)).alias("k1"), "k2", "fp")
    rest = (1 - F.shiftright(F.col("k1"), 38 + 4).bitwiseAND(F.lit(1).cast("long"))).cast("int") * 16
    part = _part(F.col("fp"), other + rest + half * 8, 8)
    return variants.select("k1", (F.lit(1).cast("long")).bitwiseOR(F.shiftleft(code.bitwiseOR(F.shiftleft(_masked(part, 8, at), log + 1)), 1)).alias("k2"), "fp")


def links(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all fingerprints within ``distance`` of each other.

    ``fps`` has a column ``fp`` of distinct longs. Every edge is verified; edges of a large group are a
    spanning forest of its links, so two fingerprints are connected by the edges if and only if they are
    connected by links. ``distance`` may be 3 at most.
    """
    if distance > 3:
        raise ValueError("one-bit variants of two segments find distances up to 3")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, parts = fps.select("fp").repartition(tasks), []  # each row becomes 64: not by as few tasks as there are files
    for level in (1, 2, 3):
        keys = _keys(rows, level).repartition("k1", "k2").sortWithinPartitions("k1", "k2")
        found = Table(keys.mapInArrow(_links(distance, group if level < 3 else max(group, GROUP)), "a long, b long, k1 long, k2 long"), "links")
        parts.append(found.df.where("b is not null").select("a", "b"))
        over = found.df.where("b is null")
        if not over.take(1):
            break
        rows = over.select(F.col("a").alias("fp"), "k1", "k2")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = 3, seed: int = 42, group: int = GROUP) -> DataFrame:
    """The near-duplicate component of every document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Returns one row per row of ``docs``:
    ``doc_id`` (long), ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest
    doc_id reachable over fingerprints at most ``distance`` bits apart, its own included.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that repeat a
    doc_id are documents of their own. A null doc_id keeps its row; it counts as no candidate for the
    smallest (its component_id is that of the others, or null if there are none). Empty tables give no rows.
    """
    own = Table(fingerprints(docs, words, seed), "fingerprints")
    fps = Table(own.df.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = Table(connected_components(links(fps.df, distance, group)), "components")
    rooted = fps.df.join(parts.df.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).join(rooted, "root").select("fp", "component_id")
    return own.df.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents whose doc_id is the smallest of their near-duplicate component, with their columns.

    Of rows that repeat that doc_id all stay; rows with a null doc_id stay.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), distance).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    near = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    return near.unionByName(docs.where(docs["doc_id"].isNull()))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
