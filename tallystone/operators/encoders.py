"""Sentence vectors: the boundary to an encoder, and a reproducible stand-in over hashed character trigrams.

The stand-in is relational: a text's unit vector is its rows (key, slot, weight), so cosines are equi-joins on slots and nothing dense is
kept. ``trigram_encoder`` makes the same vectors dense, where a dynamic programme needs many products; ``cosine`` is that of two texts of one row.
"""

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An encoder's unit vectors of a list of texts, a row each. Made in the worker by ``make()``.
Encoder = Callable[[list[str]], np.ndarray]

SLOTS = 4096


#: Slots and code points of the texts whose trigrams are counted at once, so that memory doesn't grow with a batch.
CELLS, POINTS = 1 << 20, 1 << 20
#: Trigrams whose slots a task remembers.
KNOWN = 1 << 20


def _padded(text: Column) -> Column:
    return F.concat(F.lit("  "), F.lower(text), F.lit("  "))


def _parts(sizes: list[int], slots: int) -> Iterator[slice]:
    """Runs of texts with at most ``CELLS`` slots and ``POINTS`` code points, or one text."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and (held + n > POINTS or (i + 1 - first) * slots > CELLS):
            yield slice(first, i)
            first, held = i, 0
        held += n
    if sizes:
        yield slice(first, len(sizes))


def _counts(texts: list[str], slots: int, seed: int, known: dict[int, int]) -> np.ndarray:
    """How many trigrams of each text have each slot, a row for each text (of three code points at least).

    A slot is the same in every process. Three code points of 21 bits are one number; ``known`` remembers the slots of such numbers.
    """
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    inside = row[:-2] == row[2:]
    grams, which = np.unique((points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inside], return_inverse=True)
    if len(known) > KNOWN:
        known.clear()
    for g in grams.tolist():
        if g not in known:
            gram = f"{seed}:{chr(g >> 42)}{chr(g >> 21 & 0x1FFFFF)}{chr(g & 0x1FFFFF)}"
            known[g] = int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % slots
    at = np.array([known[g] for g in grams.tolist()], np.int64)
    return np.bincount(row[:-2][inside] * slots + at[which], minlength=len(texts) * slots).reshape(len(texts), slots).astype(float)


def trigrams(df: DataFrame, key: list[str], text: str, slots: int = SLOTS, seed: int = 0) -> DataFrame:
    """``key``, ``slot`` and ``weight`` of each text's unit vector of trigram counts (lower case, two spaces about it).

    A blank text has the trigrams of spaces; a null text has no rows. ``key`` names one text.
    """
    known: dict[int, int] = {}

    @F.arrow_udf("array<struct<slot:bigint,weight:double>>")
    def vectors(text: pa.Array) -> pa.Array:
        texts = [t or "   " for t in text.to_pylist()]
        sizes, at, weights = [np.zeros(1, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for part in _parts([len(t) for t in texts], slots):
            n = _counts(texts[part], slots, seed, known)
            rows, found = np.nonzero(n)
            sizes.append((n > 0).sum(1))
            at.append(found)
            weights.append(n[rows, found] / np.sqrt((n * n).sum(1))[rows])
        each = pa.StructArray.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(weights))], ["slot", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), each)

    each = df.where(F.col(text).isNotNull()).select(*key, F.explode(vectors(_padded(F.col(text)))).alias("_v"))
    return each.select(*key, "_v.slot", "_v.weight")


def cosine(a: Column, b: Column, slots: int = SLOTS, seed: int = 0) -> Column:
    """The cosine of the vectors (as of ``trigrams``) of two texts of one row; null if one is null.

    A text that is in several rows near each other, as in pairs of neighbours, is counted once.
    """
    known: dict[int, int] = {}

    @F.arrow_udf("double")
    def cosines_of(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = [(i, x, y) for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())) if x is not None and y is not None]
        out: list[float | None] = [None] * len(a)
        for part in _parts([len(x) + len(y) for _, x, y in pairs], 2 * slots):
            places = {t: k for k, t in enumerate(dict.fromkeys(t for _, *both in pairs[part] for t in both))}
            n = _counts(list(places), slots, seed, known)
            norm = np.sqrt((n * n).sum(1))
            x, y = (np.array([places[p[k]] for p in pairs[part]]) for k in (1, 2))
            for (i, *_), value in zip(pairs[part], ((n[x] * n[y]).sum(1) / (norm[x] * norm[y])).tolist()):
                out[i] = value
        return pa.array(out, pa.float64())

    return cosines_of(_padded(a), _padded(b))


def cosines(pairs: DataFrame, vectors: DataFrame, a: list[str], b: list[str], key: list[str]) -> DataFrame:
    """``pairs`` (distinct, with columns ``a`` and ``b`` that name two keys) with ``cosine``; 0 where no slot is shared.

    Both joins are on keys and slots; only slots that both texts have make rows.
    """
    x = vectors.select(*(F.col(k).alias(n) for k, n in zip(key, a)), "slot", F.col("weight").alias("_x"))
    y = vectors.select(*(F.col(k).alias(n) for k, n in zip(key, b)), "slot", F.col("weight").alias("_y"))
    shared = pairs.select(*a, *b).join(x, a).join(y, [*b, "slot"]).groupBy(*a, *b).agg(F.sum(F.col("_x") * F.col("_y")).alias("cosine"))
    return pairs.join(shared, [*a, *b], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def trigram_encoder(slots: int = SLOTS, seed: int = 0) -> Encoder:
    """The vectors of ``trigrams``, dense."""
    known: dict[str, int] = {}

    def place(gram: str) -> int:
        if (at := known.get(gram)) is None:
            at = known[gram] = int(hashlib.md5(f"{seed}:{gram}".encode()).hexdigest()[:8], 16) % slots
        return at

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), slots), np.float32)
        for row, text in zip(out, texts):
            text = f"  {text.lower()}  "
            for at, n in Counter(place(text[i : i + 3]) for i in range(len(text) - 2)).items():
                row[at] = n
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def encoded(texts: DataFrame, make: Callable[[], Encoder], batch: int = 256) -> DataFrame:
    """Each distinct non-null ``text`` with its ``vector``, encoded once; an encoder is made once in each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield part.assign(vector=list(encoder(part["text"].tolist())))

    return texts.select("text").where("text is not null").distinct().mapInPandas(run, "text string, vector array<float>")


class InTask:
    """An encoder that runs where the texts are: no vector is written or sent. A text that several tasks or calls have is encoded by each."""

    def __init__(self, make: Callable[[], Encoder], batch: int = 256):
        self.make, self.batch, self.made = make, batch, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}  # each task makes its own

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The vectors of texts (one at least), a row each."""
        self.made = self.made or self.make()
        return np.concatenate([self.made(texts[at : at + self.batch]) for at in range(0, len(texts), self.batch)])

    def dot(self, a: Column, b: Column) -> Column:
        """The sum of the products of the vectors of two texts of one row, added in their order; null if one is null."""

        @F.arrow_udf("double")
        def dots(a: pa.Array, b: pa.Array) -> pa.Array:
            out: list[float | None] = [None] * len(a)
            pairs = [(i, x, y) for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())) if x is not None and y is not None]
            for at in range(0, len(pairs), self.batch):
                part = pairs[at : at + self.batch]
                places = {t: k for k, t in enumerate(dict.fromkeys(t for _, *both in part for t in both))}
                v = self(list(places)).astype(np.float64)
                x, y = (v[[places[p[k]] for p in part]] for k in (1, 2))
                for (i, *_), value in zip(part, np.add.accumulate(x * y, axis=1)[:, -1].tolist()):
                    out[i] = value
            return pa.array(out, pa.float64())

        return dots(a, b)
