"""Sentence alignment of a text with its translation: n:m units, their labels, and cut points within them.

Pieces of consecutive sentences are rows, and each distinct text is encoded once; or texts are encoded in the task that needs them, and no vector is written. A document's units come from a coarse-to-fine dynamic programme: both sides are
halved by averaging neighbours' vectors until the full table is small, and the path of each coarser level gives the band of the next, so work and memory grow with the
document's length. A pair of pieces costs (1 - cosine) times their sentences, over what the pieces cost with sentences from all over the other side; leaving a
sentence out costs a low percentile of the costs of such random pairs.

Words of units of several source sentences are divided at first by time or in proportion to length. Then the cut points are moved: candidate pieces
about each first guess are rows, encoded likewise, and a programme over cut positions runs as one join and one aggregation for each sentence of a unit.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.written import written
from .encoders import InTask

#: Sentences of both sides in one unit at most; pairs that a full table may have; cells about the path besides half of SIZE; sampled sentences.
SIZE, FULL, BUFFER, SAMPLES = 5, 90_000, 5, 20
#: The percentile of random costs that leaving out a sentence takes.
DELETION = 0.2
# What the label of a unit begins with, and the marks after which a cut is likelier.
LABEL = "vecalign"
MARKS = [",", ".", ";", ":", "?", "!", "…", "–", "—"]


def pieces(sentences: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """``by``, ``sentence``, ``size`` and ``text`` of 1 to ``size`` - 1 consecutive sentences; null texts count as empty."""
    w = W.partitionBy(*by).orderBy("sentence")
    window = w.rowsBetween(0, size - 2)
    following = F.collect_list(F.coalesce("text", F.lit(""))).over(window)
    all_ = F.transform(F.sequence(F.lit(1), F.size("_next")), lambda k: F.struct(k.alias("size"), F.array_join(F.slice("_next", F.lit(1), k), " ").alias("text")))
    return sentences.withColumn("_next", following).select(*by, "sentence", F.inline(all_))


def _halved(v: np.ndarray) -> np.ndarray:
    """Averages of neighbours, of unit length."""
    if len(v) % 2:
        v = np.concatenate((v, v[-1:]))
    v = v[0::2] + v[1::2]
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _sampled(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(n, SAMPLES)).astype(int))


class _Costs:
    """Costs of pairs of pieces: ``s[a][i]`` is the vector of the a + 1 source sentences from i on, ``t`` likewise."""

    def __init__(self, s: list[np.ndarray], t: list[np.ndarray]):
        self.s, self.t = s, t
        x, y = s[0][_sampled(len(s[0]))], t[0][_sampled(len(t[0]))]
        self.s_norm = [(1 - v @ y.T).sum(axis=1) / len(y) for v in s]
        self.t_norm = [(1 - v @ x.T).sum(axis=1) / len(x) for v in t]
        some = np.concatenate([self.pair(0, i, 0, _sampled(len(t[0]))) for i in _sampled(len(s[0]))])
        self.skip = float(np.quantile(some, DELETION))

    def pair(self, a: int, i: int, b: int, j: np.ndarray) -> np.ndarray:
        """Of the a + 1 source sentences from i on, with the b + 1 target sentences from each of ``j`` on."""
        apart = 1 - self.t[b][j] @ self.s[a][i]
        return np.maximum(apart, 0) * (a + 1) * (b + 1) / np.maximum(self.s_norm[a][i] + self.t_norm[b][j], 1e-6)


def _programme(costs: _Costs, n: int, m: int, low: np.ndarray, high: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The cheapest path from (0, 0) to (n, m) within the columns [low, high] of each row: its corners, in order."""
    best, back = [], []
    for i in range(n + 1):
        j = np.arange(low[i], high[i] + 1)
        row = np.full(len(j), np.inf)
        move = np.zeros((len(j), 2), np.int8)
        if i == 0 and low[0] == 0:
            row[0] = 0.0
        for a in range(1, min(i, max(size - 1, 1)) + 1):
            before, start, stop = best[i - a], low[i - a], high[i - a]
            for b in range(1, size - a + 1):
                use = np.flatnonzero((j - b >= start) & (j - b <= stop))
                if len(use):
                    value = before[j[use] - b - start] + costs.pair(a - 1, i - a, b - 1, j[use] - b)
                    less = value < row[use]
                    row[use[less]] = value[less]
                    move[use[less]] = a, b
            if a == 1:
                use = np.flatnonzero((j >= start) & (j <= stop))
                value = before[j[use] - start] + costs.skip
                less = value < row[use]
                row[use[less]] = value[less]
                move[use[less]] = 1, 0
        rest = costs.skip * np.arange(len(j))
        along = np.minimum.accumulate(row - rest) + rest
        move[along < row - 1e-12] = 0, 1
        row = np.minimum(row, along)
        best.append(row)
        back.append(move)
    path, i, j = [(n, m)], n, m
    while i or j:
        a, b = back[i][j - low[i]]
        i, j = i - int(a), j - int(b)
        path.append((i, j))
    return path[::-1]


def _band(path: list[tuple[int, int]], n: int, m: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of each row of a level twice as fine as that of ``path``, ``width`` to either side of it."""
    low, high = np.full(n + 1, m), np.zeros(n + 1, np.int64)
    for (a, b), (c, d) in zip(path, path[1:] or path):
        for i in range(min(2 * a, n), min(2 * c, n) + 1):
            low[i] = min(low[i], 2 * b)
            high[i] = max(high[i], 2 * d)
    low, high = np.clip(low - width, 0, m), np.clip(high + width, 0, m)
    low[0], high[n] = 0, m
    return np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)


def units(s: list[np.ndarray], t: list[np.ndarray], size: int = SIZE, full: int = FULL, buffer: int = BUFFER) -> list[tuple[int, int, int, int]]:
    """Units (source start, length, target start, length) in order, from the vectors of pieces of 1, 2, ... sentences."""
    n, m = len(s[0]) if s else 0, len(t[0]) if t else 0
    if not n or not m:
        return [(i, 1, 0, 0) for i in range(n)] + [(0, 0, j, 1) for j in range(m)]
    levels = [(s, t)]
    while (len(levels[-1][0][0]) + 1) * (len(levels[-1][1][0]) + 1) > full and min(len(levels[-1][0][0]), len(levels[-1][1][0])) > 2:
        x, y = levels[-1]
        levels.append(([_halved(x[0])], [_halved(y[0])]))
    path = None
    for x, y in reversed(levels):
        n, m = len(x[0]), len(y[0])
        low, high = (np.zeros(n + 1, np.int64), np.full(n + 1, m)) if path is None else _band(path, n, m, -(-size // 2) + buffer)
        path = _programme(_Costs(x, y), n, m, low, high, size if x is s else 2)
    return [(i, k - i, j, q - j) for (i, j), (k, q) in zip(path, path[1:])]


def _stacked(part: pd.DataFrame) -> list[np.ndarray]:
    """Vectors of pieces by size and sentence."""
    if not len(part):
        return []
    return [np.stack([np.asarray(v, np.float64) for v in g.sort_values("sentence")["vector"]]) for _, g in sorted(part.groupby("size"), key=lambda x: x[0])]


def _encoded(part: pd.DataFrame, encode: InTask, size: int) -> list[np.ndarray]:
    """Vectors of pieces by size and sentence, encoded here."""
    texts = [t or "" for t in part.sort_values("sentence")["text"]]
    all_ = [[" ".join(texts[i : i + k]) for i in range(len(texts) - k + 1)] for k in range(1, size)]
    return [encode(x).astype(np.float64) for x in all_ if x]


def sentence_units(source: DataFrame, target: DataFrame, by: list[str], encode, size: int = SIZE, full: int = FULL, buffer: int = BUFFER) -> DataFrame:
    """Aligned units: ``by``, ``unit`` (from 0), ``source_at``, ``n_source``, ``target_at``, ``n_target``; starts count sentences from 0 in order.

    Both sides have ``by``, ``sentence`` (its order) and ``text``; ``encode`` gives distinct texts (``text``) their unit vectors (``vector``), as
    ``encoders.encoded`` does, or is an ``encoders.InTask``, which encodes a document's pieces where they meet. A unit has ``size`` sentences of both sides at most; n:m, n:0 and 0:m. Keys of one side only have units of the other
    side's nothing. Each step depends on those before, so a document is one group, of memory in proportion to its sentences.
    """
    kinds = dict(source.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "unit long, source_at long, n_source long, target_at long, n_target long"])
    inside = isinstance(encode, InTask)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = (rows[rows["side"] == k] for k in (0, 1))
        found = units(*(_encoded(x, encode, size) if inside else _stacked(x) for x in sides), size, full, buffer)
        out = pd.DataFrame(found, columns=["source_at", "n_source", "target_at", "n_target"], dtype="int64")
        return pd.DataFrame({**{c: pd.Series([k] * len(out), dtype=object) for c, k in zip(by, key)}, "unit": range(len(out))}).join(out)

    each = lambda x: x.select(*by, "sentence", "text") if inside else pieces(x, by, size)
    rows = each(source).withColumn("side", F.lit(0)).unionByName(each(target).withColumn("side", F.lit(1)))
    if not inside:
        # a vector is larger than its text, which is all that sizes are told from: none is broadcast
        rows = rows.join(encode(rows.select("text")).hint("merge"), "text").select(*by, "side", "sentence", "size", "vector")
    return written(rows.groupBy(*by).applyInPandas(run, schema), "units")


def labelled(found: DataFrame, by: list[str]) -> DataFrame:
    """Units with ``owner``, the unit whose words theirs are divided with, ``holder``, the source sentence that takes target words alone, and what labels need.

    Targets that stand for nothing go with the source sentence before; at the beginning their words belong to the first unit that has a source sentence.
    Adds ``before`` (whether such targets come first), and ``after`` (how many such units follow).
    """
    w = W.partitionBy(*by).orderBy("unit")
    real = F.col("n_source") > 0
    last = F.last(F.when(real, F.struct("unit", (F.col("source_at") + F.col("n_source") - 1).alias("sentence"))), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    first = F.min(F.when(real, F.struct("unit", "source_at", "n_source", "n_target"))).over(W.partitionBy(*by))
    seen = found.withColumn("_last", last).withColumn("_first", first)
    leading = ~real & F.col("_last").isNull() & F.col("_first").isNotNull()
    joins = leading & (F.col("_first.n_target") > 0)
    owned = seen.withColumn("owner", F.when(joins, F.col("_first.unit")).otherwise(F.col("unit")))
    owned = owned.withColumn("holder", F.when(real, F.col("source_at")).when(leading, F.col("_first.source_at")).otherwise(F.col("_last.sentence")))
    told = F.when(real, F.col("unit")).when(leading, F.col("_first.unit")).otherwise(F.col("_last.unit"))
    group = W.partitionBy(*by, "_told")
    owned = owned.withColumn("_told", told).withColumn("_leading", leading).withColumn("before", F.max(F.col("_leading")).over(group)).withColumn("after", F.count_if(~real & ~F.col("_leading")).over(group))
    inside = F.when(joins, F.struct(F.col("_first.source_at").alias("at"), F.col("_first.n_source").alias("n"))).otherwise(F.struct(F.col("source_at").alias("at"), F.col("n_source").alias("n")))
    return owned.withColumn("of", inside).drop("_last", "_first", "_told", "_leading")


def sentence_labels(marked: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``source_at`` and ``label`` of every source sentence: ``vecalign a:b`` of its unit, with ``split`` where it has several source sentences, and ``vecalign 1:0`` where nothing stands for it.

    ``+ins`` tells of targets that stand for nothing: on the first source sentence those before it, else on the last one of the unit before them, for each such unit.
    """
    unit = F.concat(F.lit(f"{LABEL} "), F.col("n_source").cast("string"), F.lit(":"), F.col("n_target").cast("string"), F.when((F.col("n_source") > 1) & (F.col("n_target") > 0), " split").otherwise(""))
    each = marked.where("n_source > 0").select(*by, "before", "after", "n_source", F.col("source_at").alias("_at"), unit.alias("unit"), F.explode(F.sequence("source_at", F.col("source_at") + F.col("n_source") - 1)).alias("source_at"))
    lead = F.when(F.col("before") & (F.col("source_at") == F.col("_at")), "+ins").otherwise("")
    tail = F.when(F.col("source_at") == F.col("_at") + F.col("n_source") - 1, F.repeat(F.lit("+ins"), F.col("after").cast("int"))).otherwise("")
    return each.select(*by, "source_at", F.concat("unit", lead, tail).alias("label"))


def guessed(marked: DataFrame, words: DataFrame, source: DataFrame, by: list[str], timed: bool = False) -> DataFrame:
    """Words with ``unit``, their place ``word_at`` among its ``n_words``, its ``source_at`` and ``n_source``, and the first guess ``at`` of their source sentence (from 0; null in keys without any).

    ``words`` have ``by``, ``pos``, ``word`` and ``target_at`` (the number of their target sentence); ``timed``, also ``start`` and ``end``. ``source`` has ``by``, ``sentence`` (from 0),
    ``text`` and, timed, ``end``. Within a unit of several source sentences words go by their middle against the sentences' ends, never back, or in proportion to the sentences' words.
    """
    held = W.partitionBy(*by, "unit")
    several = marked.where("n_target > 0").select(*by, F.col("owner").alias("unit"), F.col("of.at").alias("source_at"), F.col("of.n").alias("n_source"), "holder", F.explode(F.sequence("target_at", F.col("target_at") + F.col("n_target") - 1)).alias("target_at"))
    placed = words.join(several.hint("merge"), [*by, "target_at"]).withColumn("word_at", F.row_number().over(held.orderBy("pos")) - 1).withColumn("_n", F.count("*").over(held))
    size = F.greatest(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")), F.lit(1))
    inside = marked.where("n_source > 1").select(*by, "unit", F.explode(F.sequence("source_at", F.col("source_at") + F.col("n_source") - 1)).alias("sentence"))
    ends = F.array_sort(F.collect_list(F.struct("sentence", *(["_stop"] if timed else []), size.alias("size"))))
    told = source.withColumnRenamed("end", "_stop") if timed else source
    known = inside.hint("merge").join(told, [*by, "sentence"]).groupBy(*by, "unit").agg(ends.alias("_of"))
    both = placed.join(known.hint("merge"), [*by, "unit"], "left")
    upto = lambda i: F.aggregate(F.slice("_of", F.lit(1), i + 1), F.lit(0), lambda n, x: n + x["size"])
    if timed:
        passed = F.transform("_of", lambda x: (F.col("start") + F.col("end")) / 2 > x["_stop"])
    else:
        passed = F.transform("_of", lambda x, i: F.col("word_at") >= upto(i) / upto(F.size("_of") - 1) * F.col("_n"))
    # the first sentence that the word isn't past, the last at most
    open_ = F.array_position(F.slice(passed, F.lit(1), F.size(passed) - 1), False)
    within = F.when(open_ > 0, open_ - 1).otherwise(F.size("_of") - 1)
    so_far = F.max(F.coalesce(within, F.lit(0))).over(held.orderBy("word_at").rowsBetween(W.unboundedPreceding, 0))
    at = F.when(F.col("n_source") > 1, F.col("source_at") + so_far).otherwise(F.col("holder"))
    return both.select(*by, "pos", "word", "unit", "source_at", "n_source", "word_at", F.col("_n").alias("n_words"), at.cast("long").alias("at"))


def _ends_clause(word: Column) -> Column:
    stripped = F.regexp_replace(word, "[\"'”»)]+$", "")
    return F.substring(stripped, F.length(stripped), F.lit(1)).isin(*MARKS)


def cut_points(placed: DataFrame, source: DataFrame, by: list[str], encode, window: int = 6, length_weight: float = 0.2, bonus: float = 0.05) -> DataFrame:
    """``placed`` (of ``guessed``) with better cuts in units of several source sentences: the best sum of cosines of sentences and pieces.

    Each cut may move ``window`` words from its first guess. A piece's score is its cosine with the source sentence, less ``length_weight`` times the
    absolute logarithm of the lengths' ratio, and ``bonus`` where the piece ends a clause before the unit's end; an empty piece has 0. Of equal sums the earlier cuts win.
    """
    key = [*by, "unit"]
    placed = written(placed, "placed")
    split = placed.where("n_source > 1")
    cuts = F.transform(F.sequence(F.lit(1), F.col("n_source").cast("int") - 1), lambda q: F.size(F.filter("_at", lambda a: a < F.col("source_at") + q)))
    listed = split.groupBy(*key, "source_at", "n_source").agg(F.array_sort(F.collect_list(F.struct("word_at", "word", "at"))).alias("_w"))
    unit = listed.withColumn("_words", F.transform("_w", lambda x: x["word"])).withColumn("_at", F.transform("_w", lambda x: x["at"])).withColumn("_cuts", cuts).withColumn("_n", F.size("_w"))
    near = lambda q: F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda d: F.least(F.greatest(F.element_at("_cuts", q) + d, F.lit(0)), F.col("_n")))))
    part = unit.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n_source").cast("int") - 1)))
    # where q is the first or the last, the other branch must not be looked up
    starts = F.when(F.col("q") == 0, F.array(F.lit(0))).otherwise(near(F.greatest(F.col("q"), F.lit(1))))
    ends = F.when(F.col("q") == F.col("n_source") - 1, F.array(F.col("_n"))).otherwise(near(F.least(F.col("q") + 1, F.col("n_source").cast("int") - 1)))
    texts = source.select(*by, "sentence", F.coalesce("text", F.lit("")).alias("_source"))
    # a unit's words meet its sentences before candidates are made of them
    part = part.select(*key, (F.col("source_at") + F.col("q")).alias("sentence"), "q", "n_source", "_words", "_n", starts.alias("_from"), ends.alias("_to")).join(texts.hint("merge"), [*by, "sentence"])
    every = part.withColumn("x", F.explode("_from")).withColumn("y", F.explode("_to")).where("x <= y")
    paired = every.select(
        *key, "_source", "q", "n_source", "x", "y", F.array_join(F.slice("_words", F.col("x") + 1, F.col("y") - F.col("x")), " ").alias("text"),
        ((F.col("y") > 0) & (F.col("y") < F.col("_n")) & F.coalesce(_ends_clause(F.try_element_at("_words", F.greatest(F.col("y"), F.lit(1)))), F.lit(False))).alias("clause"),
    )
    if isinstance(encode, InTask):
        scored, dot = paired, encode.dot(F.col("_source"), F.when(F.col("x") < F.col("y"), F.col("text")))
    else:
        vectors = written(encode(paired.where("x < y").select("text").union(paired.select(F.col("_source").alias("text")))), "vectors").hint("merge")
        scored = paired.join(vectors.withColumnRenamed("vector", "_v"), "text", "left").join(vectors.select(F.col("text").alias("_source"), F.col("vector").alias("_u")).hint("merge"), "_source", "left")
        dot = F.aggregate(F.zip_with("_u", "_v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, z: s + z)
    lengths = F.abs(F.log((F.length("text") + 1) / (F.length("_source") + 1)))
    score = F.when(F.col("x") == F.col("y"), 0.0).otherwise(dot - length_weight * lengths + F.when(F.col("clause"), bonus).otherwise(0.0))
    rows = written(scored.select(*key, "q", "n_source", "x", "y", score.alias("score")), "pieces")
    # one step for each sentence of a unit: a unit has few, however many units there are
    most = rows.agg(F.max("n_source")).first()[0] or 0
    begin = F.struct((-F.col("score")).alias("loss"), F.array("y").alias("path"))
    now = rows.where("q = 0").select(*key, "n_source", F.col("y").alias("x"), begin.alias("best"))
    done = None
    for q in range(1, int(most)):
        grown = F.struct((F.col("best.loss") - F.col("score")).alias("loss"), F.array_append("best.path", F.col("y")).alias("path"))
        now = now.join(rows.where(F.col("q") == q).drop("q", "n_source").hint("merge"), [*key, "x"]).groupBy(*key, "n_source", "y").agg(F.min(grown).alias("best")).withColumnRenamed("y", "x")
        ended = now.where(F.col("n_source") == q + 1).select(*key, F.col("best.path").alias("_path"))
        done = ended if done is None else done.unionByName(ended)
        now = now.where(F.col("n_source") > q + 1)
    if done is None:
        return placed
    after = F.size(F.filter(F.slice("_path", F.lit(1), F.size("_path") - 1), lambda c: F.col("word_at") >= c))
    moved = F.when(F.col("_path").isNotNull(), F.col("source_at") + after).otherwise(F.col("at")).cast("long")
    return placed.join(done.hint("merge"), key, "left").withColumn("at", moved).drop("_path")
