"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One set of weights over hashed text features gives a document's score; ordered thresholds turn it into the probabilities
of the grades: P(grade <= k) = logistic(threshold_k - score). The expected grade ranks documents, the tail
probability of a grade selects them.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Table, fitting, read_table
from .toxicity import held_out

#: Rated documents that the model is fitted on at most, and their text in bytes.
SAMPLE, SAMPLE_BYTES = 8000, 40_000_000
SLOTS, ROUNDS, RATE, DECAY = 1 << 15, 250, 0.1, 1e-4
#: Rounds without the loss falling by ``LEAST_GAIN``, after which training ends.
PATIENCE, LEAST_GAIN = 10, 2e-3
REMEMBERED = 400_000
SHAPE = ((re.compile(r"[^\W\d_]+"), lambda m: "X" if m[0].isupper() else "x" if m[0].islower() else "Xx"), (re.compile(r"\d+"), lambda m: "9"))


def slots_of(word: str) -> list[int]:
    """A word's features: itself, its shape, the marks it ends with, and its length."""
    shape = word
    for pattern, to in SHAPE:
        shape = pattern.sub(to, shape)
    ending = word.rstrip("".join(set(word) - set("!?.,;:*#%&$|<>@/=-_"))) if not word[-1].isalnum() else ""
    parts = ("=" + word.lower(), "s" + shape[:12], "e" + ending[-3:], f"n{min(len(word), 20)}")
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for p in parts]


def _extra(words: list[str], lines: list[str]) -> list[float]:
    """Of the whole text: words that differ, lines that differ, its length, and one for having no word."""
    n = len(words)
    return [len(set(words)) / n, len(set(lines)) / max(len(lines), 1), np.log1p(n) / 10, 0.0] if n else [0.0, 0.0, 0.0, 1.0]


EXTRA = 4


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Sample:
    """Rated documents: each one's different slots with their share of its words, and its whole-text features."""

    def __init__(self, texts: list[str], grades: list[int]):
        known: dict[str, list[int]] = {}
        slots, share, rows, extra = [np.empty(0, np.int64)], [np.empty(0)], [], []
        for text in texts:
            words = text.split()
            for w in words:
                if w not in known:
                    known[w] = slots_of(w)
            own, times = np.unique(np.array([s for w in words for s in known[w]], np.int64), return_counts=True)
            slots.append(own)
            share.append(times / max(len(words), 1))
            rows.append(len(own))
            extra.append(_extra(words, [x for x in text.split("\n") if x.strip()]))
        self.slots, self.share = np.concatenate(slots), np.concatenate(share)
        self.rows = np.repeat(np.arange(len(texts)), rows)
        self.extra, self.y = np.array(extra, float).reshape(-1, EXTRA), np.array(grades, int)


def _loss(p: np.ndarray, d: _Sample, top: int) -> tuple[float, np.ndarray]:
    """The mean negative logarithm of the likelihood, with decay, and its gradient.

    ``p`` holds the weights, the first threshold and the logarithms of the steps to the others.
    """
    n, y = SLOTS + EXTRA, d.y
    steps = np.exp(np.minimum(p[n + 1 :], 30))
    score = np.bincount(d.rows, p[d.slots] * d.share, len(y)) + d.extra @ p[SLOTS:n]
    cuts = np.concatenate(([-np.inf], np.cumsum(np.concatenate(([p[n]], steps))), [np.inf]))
    hi, lo = _sigmoid(cuts[y + 1] - score), _sigmoid(cuts[y] - score)
    like = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
    of_score = (dhi - dlo) / len(y)
    g = np.zeros_like(p)
    g[:SLOTS] = np.bincount(d.slots, of_score[d.rows] * d.share, SLOTS)
    g[SLOTS:n] = d.extra.T @ of_score
    of_cut = (np.bincount(y, -dhi, top + 1)[:top] + np.bincount(y, dlo, top + 1)[1:]) / len(y)
    later = np.cumsum(of_cut[::-1])[::-1]
    g[n] = later[0]
    g[n + 1 :] = later[1:] * steps
    g[:n] += DECAY * p[:n] / 10
    return float(-np.log(like).mean() + DECAY / 20 * (p[:n] ** 2).sum()), g


def train(texts: list[str], grades: list[int], top: int) -> np.ndarray:
    """Weights of the slots, of the whole text's features, then ``top`` ascending thresholds; Adam until the loss hardly falls."""
    d = _Sample(texts, grades)
    n = SLOTS + EXTRA
    p = np.zeros(n + top)
    p[n] = -1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    best, since = np.inf, 0
    for step in range(1, ROUNDS + 1):
        loss, g = _loss(p, d, top)
        best, since = (loss, 0) if loss < best * (1 - LEAST_GAIN) else (best, since + 1)
        if since >= PATIENCE:
            break
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    p[n:] = np.cumsum(np.concatenate(([p[n]], np.exp(np.minimum(p[n + 1 :], 30)))))
    return p.astype(np.float32)


def fit(docs: DataFrame, ratings: DataFrame, top: int, sample: int = SAMPLE) -> bytes:
    """The model from rated documents (``doc_id``, ``grade`` from 0 to ``top``) that aren't held out.

    The ``sample`` first by a hash of doc_id are used (the documented bound), of these ``SAMPLE_BYTES`` of text. Null ids
    and grades, and ratings without a document, are left out; without any the middle of the grades is expected everywhere.
    """
    known = ratings.where("doc_id is not null and grade is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    order = (F.xxhash64("doc_id"), "doc_id", "grade")
    chosen = Table(known.where(~held_out() & F.col("grade").between(0, top)).distinct().orderBy(*order).limit(sample), "ratings").df
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.repartition(1).sortWithinPartitions(*order, F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, grades = fitting(batches, SAMPLE_BYTES)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([train(found, grades, top).tobytes()], pa.binary())], ["model"])

    got = rows.select("text", "grade").mapInArrow(run, "model binary").first()
    if got:
        return got["model"]
    return np.concatenate((np.zeros(SLOTS + EXTRA), np.arange(top) - (top - 1) / 2)).astype(np.float32).tobytes()


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id``, ``expected_grade`` and ``tails`` (P(grade >= k) for k from 1) of every whole text; one row per row.

    Null, empty and blank texts are scored by having no word. Other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.frombuffer(shipped.value, np.float32).astype(float)
        weights, whole, cuts = p[:SLOTS].tolist(), p[SLOTS : SLOTS + EXTRA], p[SLOTS + EXTRA :]
        known: dict[str, float] = {}
        for b in batches:
            tails = []
            for x in b.column(1):
                text = x.as_py() or ""
                words = text.split()
                total = 0.0
                for w in words:
                    if (s := known.get(w)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = s = sum([weights[i] for i in slots_of(w)])
                    total += s
                z = total / max(len(words), 1) + float(np.dot(_extra(words, [y for y in text.split("\n") if y.strip()]), whole))
                tails.append(_sigmoid(z - cuts).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(t) for t in tails], pa.float64()), pa.array(tails, pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))]))


def op8_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of use as training text: 0 low quality, 1 well written but toxic, 2 well written; kept if grade 1 or more is likelier than not.

    ``labels`` rates quality by 0 and 1 only. The middle grade comes from its other rating, as a well-written toxic text is of less use than a
    clean one and of more than junk. Whether a document is kept is the lowest threshold's business, which separates by quality alone.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = read_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("grade"))
    rated = score(docs, fit(docs, ratings, 2))
    return rated.select("doc_id", held_out().alias("held_out"), "expected_grade", F.get("tails", F.lit(0)).alias("tail_probability"), (F.get("tails", F.lit(0)) >= 0.5).alias("kept"))
