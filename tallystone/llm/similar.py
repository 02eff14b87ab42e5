"""Near copies by exact word-shingle similarity: SimHash fingerprints, and beyond their reach MinHash signatures, find candidates; their texts decide.

Documents with the same set of shingles (five words each) are one node. Nodes whose SimHash fingerprints (of the sets) differ in three bits at most are candidates first, as in
``simhash.py``. Sets of similarity 0.8 may differ in up to some 20 bits, so what that leaves apart is searched by MinHash: each node is indexed under ``BANDS`` keys of
``ROWS`` minima each; nodes that share a key are candidates, and a pair is linked if the Jaccard similarity of its
shingle sets is ``SIMILARITY`` at least. Two sets of similarity 0.8 share no key with probability (1 - 0.8 ** 5) ** 32,
3 in a million. Within a key, the first member is compared with all others, then the first of the others with those of
other components than its own, ``ROUNDS`` times. So a large
group of copies costs some pairs for each member. Members of several components are left where many documents share a passage and little else, and where copies are changed so
much that not all are similar. The former have too many shingles that no other component has, and go at once. The others' sets are sent once to their key's task,
where those meet that share one of the fifth of their shingles (and one) that the fewest members have; of two sets of similarity 0.8 each has such a one. No pair is a row, and none that is similar is left out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import Table, connected_components, fresh

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SEED = 42
#: First members of a key that are compared with its others, one after the other; on the hot input of the check a second and third found 168 links of 5,700.
ROUNDS = 1
#: Bytes of sets that meet in one task.
BLOCK = 32_000_000
#: Shingles whose minima are taken at once.
STEP = 1 << 11
SPACE = b" "
_RANDOM = np.random.default_rng(SEED)
FLIPS, FACTORS = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct digests of a text's word shingles; of a shorter text its only one, of a blank one none."""
    w = text.lower().split()  # bytes: lower() maps A-Z only, split() cuts at 0x20 and 0x09-0x0D
    if not w:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, SPACE.join
    n = max(1, len(w) - words + 1)
    return np.unique(np.fromiter((digest(join(s), SEED) for s in (zip(*(w[i:] for i in range(words))) if len(w) >= words else [w])), np.uint64, n))


def keys(own: np.ndarray) -> list[int]:
    """The signed index keys of a set of shingles; of an empty set none."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), STEP):
        least = np.minimum(least, ((own[i : i + STEP] ^ FLIPS) * FACTORS).min(axis=1))
    bands = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bands)]


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets of shingles have the Jaccard similarity at least."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _nodes(words: int, signed: bool = False):
    """Each text's node with its index keys and size; ``signed``, also with its SimHash fingerprint ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, found, sizes, prints = [], [], [], []
            for t in b.column(2).cast(pa.binary()):
                own = shingles(t.as_py() or b"", words)
                sizes.append(len(own))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                found.append(keys(own))
                if signed:
                    prints.append(simhash.majority(own))
            fp = [pa.array(np.array(prints, np.uint64).view(np.int64))] if signed else []
            made = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), *fp]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "digest", "node", "keys", "size", "fp"][: len(made)])

    return run


def _sets(words: int):
    """Each node's sorted set of shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py() or b"", words).tobytes() for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "elements"])

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node, root and each shingle of a set."""
    for b in batches:
        sets = [np.frombuffer(x.as_py(), np.int64) for x in b.column(2)]
        at = pa.array(np.repeat(np.arange(len(sets)), np.array([len(x) for x in sets], np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], ["node", "root", "shingle"])


def _fitting(similarity: float):
    """Whether sets of these sizes can be similar."""
    return F.least("size", "_size") >= F.greatest("size", "_size") * similarity - 1e-9


def _able(rooted: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The nodes (node, root) that may be similar to one of another component: enough of their shingles are in another as well.

    Documents that share a passage and little else have too many shingles of their own, and are left out here, whatever their number.
    """
    every = Table(rooted.join(sets, "node").select("node", "root", "elements").mapInArrow(_each, "node long, root long, shingle long"), "shingles")
    common = every.df.groupBy("shingle").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("shingle")
    shared = every.df.join(common, "shingle").groupBy("node").agg(F.count("*").alias("_shared"))
    able = Table(rooted.join(sets.select("node", "size"), "node").join(shared, "node").where(F.col("_shared") >= F.col("size") * similarity - 1e-9).select("node", "root"), "able")
    every.drop()
    return able.df


class _Group:
    """The members of a key: their sets as numbers that ascend with how many members have a shingle, and what begins with few."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sizes = np.array([len(x) for x in sets])
        _, numbers, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        self.sets = [np.sort(x) for x in np.split(rank[numbers], np.cumsum(self.sizes)[:-1])]
        self.mark = np.zeros(len(counts), bool)
        # two similar sets share one of these rarest shingles of either
        self.first = [x[: len(x) - int(np.ceil(len(x) * similarity - 1e-9)) + 1] for x in self.sets]
        shingle = np.concatenate(self.first)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in self.first])
        order = np.argsort(shingle, kind="stable")
        self.owner = owner[order]
        self.begin = np.searchsorted(shingle[order], np.arange(len(counts) + 1))

    def meeting(self, i: int) -> np.ndarray:
        """The members that share a first shingle with member ``i``."""
        return np.unique(np.concatenate([self.owner[self.begin[t] : self.begin[t + 1]] for t in self.first[i]]))

    def shared(self, i: int, others: np.ndarray) -> Iterator[tuple[int, int]]:
        """Each of some members with the number of shingles it shares with ``i``."""
        self.mark[self.sets[i]] = True
        try:
            for j in others.tolist():
                yield j, int(self.mark[self.sets[j]].sum())
        finally:
            self.mark[self.sets[i]] = False


def _joined(similarity: float):
    """Links between the components of a key's members (or of two blocks of them), as few as connect what is similar."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own, low, high = (k.as_py() for k in key)
        nodes, roots, blocks = (rows.column(c).to_numpy() for c in ("node", "root", "block"))
        bands = np.array(rows.column("keys").to_pylist(), np.int64)
        group = _Group([np.frombuffer(x.as_py(), np.int64) for x in rows.column("elements")], similarity)
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        found = []
        for i in range(len(nodes)):
            near = group.meeting(i)
            near = near[near < i]
            near = near[(roots[near] != roots[i]) & ((blocks[near] != blocks[i]) | (low == high))]
            near = near[np.minimum(group.sizes[near], group.sizes[i]) >= similarity * np.maximum(group.sizes[near], group.sizes[i]) - 1e-9]
            if not len(near):
                continue
            # a pair is looked at in the first key that both have
            same = bands[near] == bands[i]
            near = near[bands[i][same.argmax(axis=1)] == own]
            todo = np.array([j for j in near.tolist() if find(roots[j]) != find(roots[i])], np.int64)
            for j, both in group.shared(i, todo):
                a, b = find(roots[i]), find(roots[j])
                if a != b and both >= similarity * (group.sizes[i] + group.sizes[j] - both):
                    up[a] = b
                    found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _across(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) between components that share a key (``members``: key, node, root), each verified.

    A key's members meet in one task, each set sent once; pairs are no rows. Keys whose sets have more than ``block`` bytes are cut into blocks of members, and
    every two blocks meet.
    """
    mixed = members.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("key")
    sized = members.join(mixed, "key").join(sets.select("node", "size"), "node")
    blocks = sized.groupBy("key").agg(F.ceil(F.sum("size") * 8 / block).cast("long").alias("blocks"))
    dealt = sized.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root")
    whole = rows.join(nodes.select("node", "keys"), "node").join(sets.select("node", "elements"), "node")
    return whole.groupBy("key", "low", "high").applyInArrow(_joined(similarity), "a long, b long")


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity) for x, y in zip(b.column(2), b.column(3))]
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    return run


def _close(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints ``fp`` differ in ``simhash.DISTANCE`` bits at most; one pair for each node, and for each edge of a forest."""
    fps = Table(nodes.groupBy("fp").agg(F.min("node").alias("one")), "fingerprints").df
    same = nodes.select("node", "fp").join(fps, "fp").where("node <> one").select(F.col("one").alias("x"), F.col("node").alias("y"))
    ends = lambda n, c: fps.select(F.col("fp").alias(n), F.col("one").alias(c))
    linked = simhash.links(fps.select("fp")).join(ends("a", "x"), "a").join(ends("b", "y"), "b").select("x", "y")
    return Table(same.union(linked).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "close").df


def links(nodes: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all nodes whose sets are similar; every edge is verified.

    ``nodes`` has distinct ``node`` with ``keys``, the ``size`` of its set and the ``digest`` of one of its texts, and may have its fingerprint ``fp``; ``texts`` has ``digest`` and ``text``.
    With fingerprints those close to each other are compared first, and keys then only join what is still apart.
    """
    every = nodes.select(F.explode("keys").alias("key"), "node", "size")
    several = every.groupBy("key").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).where("_low < _high").select("key")
    rows = Table(every.join(several, "key"), "keys")
    close = _close(nodes) if "fp" in nodes.columns else None
    asked = rows.df.select("node") if close is None else rows.df.select("node").union(close.select("a")).union(close.select("b"))
    named = Table(nodes.join(asked.distinct(), "node", "left_semi").select("node", "digest"), "candidates")
    kept = texts.join(named.df.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("text")).join(named.df, "digest").select("node", "text")
    sets = Table(kept.mapInArrow(_sets(words), "node long, elements binary").withColumn("size", F.expr("octet_length(elements) div 8")), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = sets.df.select(F.col("node").alias("a"), F.col("elements").alias("x")), sets.df.select(F.col("node").alias("b"), F.col("elements").alias("y"))
        return Table(pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInArrow(_verified(similarity), "a long, b long"), "links").df

    edges, left, rooted = None, rows.df.withColumn("root", F.col("node")), None
    if close is not None:
        edges = verified(close)
        left = rows.df.join(connected_components(edges), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    for _ in range(ROUNDS):
        # the first member of each key is compared with those of other components, and is then done
        first = left.groupBy("key").agg(F.min_by(F.struct("node", "size", "root"), "node").alias("one")).select("key", F.col("one.node").alias("_node"), F.col("one.size").alias("_size"), F.col("one.root").alias("_root"))
        both = left.join(first, "key").where((F.col("root") != F.col("_root")) & _fitting(similarity))
        found = verified(both.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct())
        edges = found if edges is None else edges.union(found)
        rooted = connected_components(edges)
        rest = left.drop("root").join(first.select("key", F.col("_node").alias("node")), ["key", "node"], "left_anti")
        named_rest = rest.join(rooted, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
        # keys whose other members are in one component are done
        mixed = named_rest.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("key")
        left = Table(named_rest.join(mixed, "key"), "left").df
    left = left.select("key", "node", "root")
    able = _able(left.select("node", "root").distinct(), sets.df, similarity)
    edges = edges.union(Table(_across(left.join(able.select("node"), "node", "left_semi"), nodes, sets.df, similarity, block), "across").df)
    for t in (rows, named, sets):
        t.drop()
    return edges


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest doc_id reachable over similar texts, one row per row of ``docs``.

    Texts shorter than ``words`` are similar if they have the same words; null, empty and blank ones are one node. A null
    doc_id keeps its row and counts as no candidate for the smallest.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    made = Table(texts.mapInArrow(_nodes(words, True), "doc_id long, digest long, node long, keys array<bigint>, size long, fp long"), "nodes")
    nodes = Table(made.df.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("digest", "keys", "size", "fp")).alias("one")).select("node", "least", "one.digest", "one.keys", "one.size", "one.fp"), "distinct")
    rooted = connected_components(links(nodes.df.where(F.size("keys") > 0), texts.select("digest", "text"), words, similarity))
    placed = nodes.df.select("node", "least").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = placed.groupBy("root").agg(F.min("least").alias("component_id")).join(placed, "root").select("node", "component_id")
    return made.df.select("doc_id", "node").join(parts, "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents whose doc_id is the smallest of their group of near copies, with their columns.

    Of rows that repeat that doc_id all stay; rows with a null doc_id stay.
    """
    name = fresh(docs.columns, "kept_id")
    kept = near_copies(docs.select("doc_id", "text"), words, similarity).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    near = docs.join(kept, docs["doc_id"] == kept[name], "left_semi")
    return near.unionByName(docs.where(docs["doc_id"].isNull()))
