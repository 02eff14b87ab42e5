"""Least-edit resegmentation of a hypothesis to reference sentences, in memory that grows with the text and not with its square.

The edit table is computed row by row in a band about the diagonal. A band of half-width t holds every cheapest path if the distance found
in it is t at most (a path of d edits strays d cells at most from the diagonal), so the band doubles until it is proved wide enough. Some rows
are kept; between two of them the rows are computed again, from the last pair back to the first, in as many levels as the memory allows, and the path is traced
through them. Cells of the band on a cheapest path have the values of the full table and others no lower ones, so the path is the one that the full table gives.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Half-width of the first band.
FIRST = 64
#: Bytes of kept rows at each level.
KEPT = 64_000_000
FAR = np.int32(1 << 30)


class _Band:
    """Rows of the edit table between hypothesis and reference words (numbers), each the 2 t + 1 cells about the diagonal."""

    def __init__(self, hypothesis: np.ndarray, reference: np.ndarray, t: int):
        self.h, self.n, self.m, self.t = hypothesis, len(hypothesis), len(reference), t
        self.width = 2 * t + 1
        self.step = np.arange(self.width, dtype=np.int32)
        # reference word of cell k of row i: f[i + k - t - 1]; beyond either end no word
        self.f = np.concatenate((np.full(t + 1, -1, np.int64), reference, np.full(self.n + t + 1, -1, np.int64)))

    def first(self) -> np.ndarray:
        row = self.step - self.t
        return np.where((row < 0) | (row > self.m), FAR, row).astype(np.int32)

    def after(self, row: np.ndarray, i: int) -> np.ndarray:
        """Row ``i`` from row ``i - 1``."""
        out = row + (self.f[i : i + self.width] != self.h[i - 1]).astype(np.int32)
        np.minimum(out[:-1], row[1:] + 1, out=out[:-1])
        low, high = self.t - i, self.m - i + self.t  # cells of columns below 0 and above m
        if low > 0:
            out[:low] = FAR
        if low >= 0 and low < self.width:
            out[low] = i
        if high < self.width - 1:
            out[max(high + 1, 0) :] = FAR
        return np.minimum(np.minimum.accumulate(out - self.step) + self.step, FAR)

    def distance(self) -> int:
        row = self.first()
        for i in range(1, self.n + 1):
            row = self.after(row, i)
        return int(row[self.m - self.n + self.t])


def distance_band(hypothesis: np.ndarray, reference: np.ndarray, first: int = FIRST) -> _Band:
    """The narrowest doubled band that is proved wide enough."""
    longest = max(len(hypothesis), len(reference))
    t = max(first, abs(len(hypothesis) - len(reference)))
    while True:
        band = _Band(hypothesis, reference, min(t, longest))
        if t >= longest or band.distance() <= t:
            return band
        t *= 2


def _traced(band: _Band, kept: int) -> list[int]:
    """For each hypothesis word the reference word it stands for, -1 - j for an inserted one after reference words [0, j)."""
    out = [0] * band.n
    most = max(2, kept // (4 * band.width))

    def walk(begin: int, row: np.ndarray, end: int, j: int) -> int:
        """Traces back from (end, j) to row ``begin``; gives the column there."""
        size = end - begin
        if size <= most:
            rows = [row]
            for i in range(begin + 1, end + 1):
                rows.append(band.after(rows[-1], i))
            i = end
            while i > begin:
                here, above = rows[i - begin], rows[i - 1 - begin]
                k = j - i + band.t
                if j > 0 and here[k] == above[k] + (band.f[i + k] != band.h[i - 1]):
                    i, j = i - 1, j - 1
                    out[i] = j
                elif k + 1 < band.width and here[k] == above[k + 1] + 1:
                    i -= 1
                    out[i] = -1 - j
                else:
                    j -= 1
            return j
        step = -(-size // most)
        marks = list(range(begin, end, step))
        held = [row]
        for i in range(begin + 1, marks[-1] + 1):
            row = band.after(row, i)
            if (i - begin) % step == 0:
                held.append(row)
        stop = end
        for at in reversed(range(len(marks))):
            j = walk(marks[at], held.pop(), stop, j)
            stop = marks[at]
        return j

    walk(0, band.first(), band.n, band.m)
    return out


def resegment(hypothesis: list[str], references: list[list[str]], first: int = FIRST, kept: int = KEPT) -> list[int]:
    """For each hypothesis word the reference sentence it falls in by a least-edit alignment; never going back.

    Word error rate against the concatenated references is minimal; inserted words stay with the sentence before. Of equal alignments
    the one traced from the end that prefers pairs, then insertions, is taken. Without reference words all fall in the first sentence.
    """
    flat = [w for r in references for w in r]
    if not hypothesis:
        return []
    if not flat:
        return [0] * len(hypothesis)
    owner = [i for i, r in enumerate(references) for _ in r]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys([*hypothesis, *flat]))}
    h, f = (np.array([vocabulary[w] for w in x], np.int64) for x in (hypothesis, flat))
    found = _traced(distance_band(h, f, first), kept)
    return np.maximum.accumulate([owner[x if x >= 0 else max(-2 - x, 0)] for x in found]).tolist()


def resegmented(words: DataFrame, sentences: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``pos``, ``sentence`` (null in keys without sentences) of hypothesis words (``by``, ``pos``, ``word``) on reference sentences (``by``, ``sentence``, ``text``).

    Sentences are in order of ``sentence``; their texts are cut at white space, null ones have no words. A key's recording is one group, as each word's
    place depends on all others; it takes memory in proportion to its words.
    """

    def run(key: tuple, w: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        w, s = w.sort_values("pos", kind="stable"), s.sort_values("sentence")
        numbers = s["sentence"].to_numpy()
        at = resegment([x or "" for x in w["word"]], [(x or "").split() for x in s["text"]])
        return pd.DataFrame({**{b: pd.Series([k] * len(w), dtype=object) for b, k in zip(by, key)}, "pos": w["pos"].to_numpy(), "sentence": pd.array(numbers[at] if len(s) else [None] * len(w), "Int64")})

    kinds = dict(words.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "pos long, sentence long"])
    return words.select(*by, "pos", "word").groupBy(*by).cogroup(sentences.select(*by, F.col("sentence").cast("long").alias("sentence"), "text").groupBy(*by)).applyInPandas(run, schema)
