"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in hashed features of its words; a
document is toxic if any of its sentences is, so their probabilities are combined by noisy-or. The weights are
trained from document labels alone, and the sentence probabilities then locate what offends.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Table, fitting, fresh, read_table

#: Labelled documents that the model is trained on at most, and their text in bytes.
SAMPLE, SAMPLE_BYTES = 8000, 40_000_000
#: Hashed features.
SLOTS = 1 << 18
ROUNDS, RATE, DECAY = 300, 0.08, 5e-5
#: A feature has a weight if its chi-square against the labels, by document, is this at least.
TELLING = 15.0
#: Lengths of the word beginnings and of the parts that are features beside the word itself.
BEGINNINGS, PART = (4, 5, 6, 7, 8), 6
THRESHOLD = 0.3
#: Words whose score a worker remembers, some 25 MB that later stages find taken; it forgets all of them beyond that.
REMEMBERED = 200_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[int]:
    """The slots of a lower-case word: the word, its beginnings, its parts."""
    parts = ["=" + word, *("^" + word[:n] for n in BEGINNINGS if n <= len(word)), *(word[i : i + PART] for i in range(1, len(word) - PART + 1))]
    return list({zlib.crc32(p.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for p in parts})


def _softplus(z):
    return np.logaddexp(0, z)


def _telling(words, sizes, bags, y, slots) -> np.ndarray:
    """Which slots are in toxic documents more often than chance has it."""
    ends = np.cumsum(np.add.reduceat(sizes, np.cumsum(bags) - bags))
    toxic, clean = np.zeros(SLOTS), np.zeros(SLOTS)
    for label, start, end in zip(y, [0, *ends[:-1]], ends):
        (toxic if label else clean)[np.unique(np.concatenate([slots[w] for w in np.unique(words[start:end])]))] += 1
    n1, n0 = y.sum(), (~y).sum()
    a, b, c, d = toxic, clean, n1 - toxic, n0 - clean
    chi = (a * d - b * c) ** 2 * len(y) / np.maximum((a + b) * (c + d) * n1 * n0, 1)
    return (chi >= TELLING) & (a * n0 > b * n1)


def train(texts: list[str], labels: list[int]) -> np.ndarray:
    """Weights of the slots, then the bias; Adam on the noisy-or likelihood of the document labels."""
    ids: dict[str, int] = {}
    words: list[int] = []
    sentence_sizes, bag_sizes = [], []
    for text in texts:
        n = 0
        for sentence in SENTENCE.findall(text):
            if found := WORD.findall(sentence.lower()):
                words += [ids.setdefault(w, len(ids)) for w in found]
                sentence_sizes.append(len(found))
                n += 1
        bag_sizes.append(n)
    y = np.array(labels, bool)
    model = np.zeros(SLOTS + 1)
    used = np.array(bag_sizes) > 0
    if not used.any() or y[used].all() or not y[used].any():
        model[-1] = -8.0 if not y.any() else 0.0  # nothing to learn from one class
        return model.astype(np.float32)
    y, bags = y[used], np.array(bag_sizes)[used]
    words, sizes = np.array(words, np.int32), np.array(sentence_sizes)
    slots = [np.array(features_of(w), np.int32) for w in ids]
    telling = _telling(words, sizes, bags, y, slots)
    slots = [s[telling[s]] for s in slots]
    widths = np.array([len(s) for s in slots])
    at_word = np.cumsum(widths) - widths
    slots = np.concatenate(slots)
    # only words with a weight count from here on
    of_word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    of_word, words = of_word[widths[words] > 0], words[widths[words] > 0]
    width = widths[words]
    pairs = np.repeat(at_word[words] - (np.cumsum(width) - width), width) + np.arange(width.sum())
    slots, of_pair = slots[pairs], np.repeat(of_word, width)
    at_bag = np.cumsum(bags) - bags
    of_sentence = np.repeat(np.arange(len(bags), dtype=np.int32), bags)
    w, bias = np.zeros(SLOTS), -6.0
    m, v, mb, vb = np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        z = np.bincount(of_pair, w[slots], len(sizes)) + bias
        rate = np.add.reduceat(_softplus(z), at_bag)
        of_rate = np.where(y, -1 / np.expm1(np.clip(rate, 1e-9, 500.0)), 1.0)
        of_z = of_rate[of_sentence] / (1 + np.exp(-np.maximum(z, -500.0)))
        of_w = np.bincount(slots, of_z[of_pair], SLOTS) / len(y) + DECAY * w
        of_bias = of_z.sum() / len(y)
        m, v = 0.9 * m + 0.1 * of_w, 0.999 * v + 0.001 * of_w**2
        mb, vb = 0.9 * mb + 0.1 * of_bias, 0.999 * vb + 0.001 * of_bias**2
        scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= scale * m / (np.sqrt(v) + 1e-8)
        bias -= scale * mb / (np.sqrt(vb) + 1e-8)
    model[:-1], model[-1] = w, bias
    return model.astype(np.float32)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = fitting(batches, SAMPLE_BYTES)
    yield pa.RecordBatch.from_arrays([pa.array([train(texts, labels).tobytes()], pa.binary())], ["model"])


def held_out():
    """Whether a row's label is never learnt from; false for a null doc_id, whose label isn't learnt from either."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The model from labelled documents that aren't held out.

    Of those, the ``sample`` first by a hash of their doc_id are used (the documented bound on training), of these
    as many as have ``SAMPLE_BYTES`` of text together. One task trains; it returns some 1 MB of weights. Labels
    or doc_ids that are null, and labels without a document, are left out.
    """
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out())
    order = (F.xxhash64("doc_id"), "doc_id", "toxic")
    chosen = Table(known.distinct().orderBy(*order).limit(sample), "labels").df
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.repartition(1).sortWithinPartitions(*order, F.xxhash64("text"))
    found = rows.select("text", "toxic").mapInArrow(_trained, "model binary").first()
    return found["model"] if found else train([], []).tobytes()


class _Scores(dict):
    """A word's score, remembered."""

    def __init__(self, model: bytes):
        super().__init__()
        self.weights = np.frombuffer(model, np.float32).astype(np.float64)
        self.list = self.weights.tolist()
        self.bias = self.list[-1]

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        weights = self.list
        self[word] = score = sum([weights[i] for i in features_of(word)])
        return score


def sentence_scores(text: str, scores: _Scores) -> list[tuple[int, int, float]]:
    """(start, end, probability) of each sentence with a word."""
    out = []
    get = scores.__getitem__
    for m in SENTENCE.finditer(text):
        if found := WORD.findall(m[0].lower()):
            z = min(max(sum(map(get, found)) + scores.bias, -60.0), 60.0)
            out.append((m.start(), m.end(), 1 / (1 + np.exp(-z)) if abs(z) < 60 else float(z > 0)))
    return out


SPANS = "array<struct<start:int,end:int,score:double>>"
_KNOWN: dict = {}


def _scored(shipped, at_least: float, text_at: int, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        key = zlib.crc32(model), len(model)
        if key not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[key] = _Scores(model)
        scores = _KNOWN[key]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            total, spans = [], []
            for x in b.column(text_at):
                found = sentence_scores(x.as_py() or "", scores)
                clean = 1.0
                for _, _, p in found:
                    clean *= 1 - p
                total.append(1 - clean)
                spans.append([{"start": s, "end": e, "score": float(p)} for s, e, p in found if p >= at_least])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total, pa.float64()), pa.array(spans, kind)], [*b.schema.names, *names])

    return run


def score(docs: DataFrame, model: bytes, at_least: float = THRESHOLD, names: tuple[str, str] = ("_score", "_spans")) -> DataFrame:
    """``docs`` with ``_score``, the noisy-or of its sentences' probabilities, and ``_spans``.

    ``_spans`` are start and end (code points, end exclusive) and score of each sentence of at least
    ``at_least``. Only ``text`` is read, the whole of it. Texts without a word (null, empty, blank) score 0.
    All columns of ``docs`` stay; ``names`` are those of the two, which no column of ``docs`` may have. One row per
    row, without a shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"`{names[0]}` double, `{names[1]}` {SPANS}").fields])
    return docs.mapInArrow(_scored(shipped, at_least, docs.columns.index("text"), names), schema)


def keep_civil(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with their columns."""
    names = fresh(docs.columns, "civility_score"), fresh(docs.columns, "civility_spans")
    rated = score(docs, model, threshold, names)
    return rated.where(rated[names[0]] < threshold).drop(*names)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    rated = score(docs, model)
    return rated.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
