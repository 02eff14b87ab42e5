"""Alignment of word and sentence sequences. Each step depends on the last, so a document is one pandas group.

Sentence splitting and embeddings are pluggable; the dynamic programmes here are plain: least edits, and the best sum of
similarities.
"""

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _by_time(words: list[tuple[float, float]], sentences: list[tuple[float, float]]) -> list[int]:
    """For each word the sentence of the largest overlap from two before the last one on, else the nearest; never going back."""
    out, j = [], 0
    for start, end in words:
        best, key = None, None
        for k in range(max(0, j - 2), len(sentences)):
            low, high = sentences[k]
            common = min(end, high) - max(start, low)
            middle = (start + end) / 2
            away = 0.0 if low <= middle <= high else min(abs(middle - low), abs(middle - high))
            mine = (max(common, 0.0), -away, -k)
            if key is None or mine > key:
                best, key = k, mine
            if low > max(end, middle):  # sentences are sorted by start: the others begin later still
                break
        j = max(best if best is not None else j, j)
        out.append(j)
    return out


def align_by_time(words: DataFrame, sentences: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``pos``, ``sentence`` of words (``pos``, ``start``, ``end``) on sentences (``sentence``, ``start``, ``end``)."""

    def run(key: tuple, w: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(w) or not len(s):
            return pd.DataFrame({**{b: [] for b in by}, "pos": [], "sentence": []})
        w, s = w.sort_values("pos"), s.sort_values(["start", "sentence"])
        at = _by_time(list(zip(w["start"], w["end"])), list(zip(s["start"], s["end"])))
        return pd.DataFrame({**{b: k for b, k in zip(by, key)}, "pos": w["pos"].to_numpy(), "sentence": s["sentence"].to_numpy()[at]})

    kinds = dict(words.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "pos long, sentence long"])
    return words.groupBy(*by).cogroup(sentences.groupBy(*by)).applyInPandas(run, schema)


def resegment(hypothesis: list[str], references: list[list[str]]) -> list[int]:
    """For each hypothesis word the reference sentence it falls in by a least-edit alignment; never going back.

    Word error rate against the concatenated references is minimal; inserted words stay with the sentence before.
    """
    flat = [w for r in references for w in r]
    owner = [i for i, r in enumerate(references) for _ in r]
    n, m = len(hypothesis), len(flat)
    if not n:
        return []
    if not m:
        return [0] * n
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys([*hypothesis, *flat]))}
    h, f = np.array([vocabulary[w] for w in hypothesis]), np.array([vocabulary[w] for w in flat])
    cost = np.empty((n + 1, m + 1), np.int32)
    cost[0] = np.arange(m + 1)
    step = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.minimum(cost[i - 1] + 1, np.concatenate(([i], cost[i - 1, :-1] + (f != h[i - 1]))))
        cost[i] = np.minimum.accumulate(row - step) + step
    out = [0] * n
    i, j = n, m
    while i > 0:
        if j > 0 and cost[i, j] == cost[i - 1, j - 1] + (f[j - 1] != h[i - 1]):
            i, j = i - 1, j - 1
            out[i] = owner[j]
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out[i] = owner[max(j - 1, 0)]
        else:
            j -= 1
    return np.maximum.accumulate(out).tolist()


def align_sentences(similarity: np.ndarray, skip: float = 0.2, merge: float = 0.05) -> list[tuple[list[int], list[int]]]:
    """Monotonic alignment of two lists of sentences by similarity: pairs of index lists, 1:1, 1:2, 2:1, 1:0 or 0:1.

    The sum of similarities (of merged sentences their mean less ``merge``), less ``skip`` for each one left out, is maximal.
    """
    n, m = similarity.shape
    best = np.full((n + 1, m + 1), -np.inf)
    best[0, 0] = 0
    moves = ((1, 1), (1, 2), (2, 1), (1, 0), (0, 1))
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for i in range(n + 1):
        for j in range(m + 1):
            for a, b in moves:
                if i < a or j < b:
                    continue
                gain = -skip if not (a and b) else float(similarity[i - a : i, j - b : j].mean()) * max(a, b) - merge * (a + b - 2)
                if best[i - a, j - b] + gain > best[i, j]:
                    best[i, j], back[i, j] = best[i - a, j - b] + gain, (a, b)
    out = []
    i, j = n, m
    while i or j:
        a, b = back[i, j]
        out.append((list(range(i - a, i)), list(range(j - b, j))))
        i, j = i - a, j - b
    return out[::-1]


def locate_quotes(quotes: list[list[str]], text: list[str], slack: int = 10) -> list[tuple[int, int] | None]:
    """Word ranges of quotes in a text, each searched from where the last one began; the longest matching block decides."""
    out, position = [], 0
    for quote in quotes:
        window = text[position : position + len(quote) + slack]
        block = difflib.SequenceMatcher(None, quote, window, autojunk=False).find_longest_match(0, len(quote), 0, len(window))
        if block.size == 0:
            out.append(None)
            continue
        start = position + max(0, block.b - block.a)
        out.append((start, min(len(text), start + len(quote))))
        position += block.b
    return out


def located_quotes(quotes: DataFrame, texts: DataFrame, by: list[str], slack: int = 10) -> DataFrame:
    """``by``, ``pos``, ``first`` and ``last`` word (from 0, both included; null where nothing matches) of quotes (``by``, ``pos``, ``quote``) in texts (``by``, ``text``), searched forward.

    Where a quote is sought depends on the ones before it, so a document's quotes are one group. Documents without a text find nothing.
    """

    def run(key: tuple, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        q = q.sort_values("pos")
        text = (t["text"].iloc[0] or "").split() if len(t) else []
        found = locate_quotes([(x or "").split() for x in q["quote"]], text, slack)
        first, last = ([None if f is None or f[1] <= f[0] else f[0] + (f[1] - f[0] - 1) * k for f in found] for k in (0, 1))
        return pd.DataFrame({**{b: pd.Series([k] * len(q), dtype=object) for b, k in zip(by, key)}, "pos": q["pos"].to_numpy(), "first": pd.array(first, "Int64"), "last": pd.array(last, "Int64")})

    kinds = dict(quotes.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "pos long, first long, last long"])
    return quotes.select(*by, "pos", "quote").groupBy(*by).cogroup(texts.select(*by, "text").groupBy(*by)).applyInPandas(run, schema)
