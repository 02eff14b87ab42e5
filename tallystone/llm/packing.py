"""Packing into optimal length buckets.

A global histogram of lengths gives the bucket boundaries that minimise padding, by dynamic programming; batches of
a token budget are then formed inside each bucket. The histogram has a bin for each length that occurs, so it is
bounded by the longest text, however large the corpus is; the programme's choices ascend, which keeps it near linear in the bins.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import BLANKS
from .shared import Table, read_table

#: Tokens of a padded batch, and buckets.
BUDGET, BUCKETS = 16384, 12
#: Rows of a numbering cell on average.
CELL = 20_000


def n_words(text: str = "text"):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; 0 for null."""
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"\s+"))).cast("long")


def boundaries(tops: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The padded lengths, ascending, of ``buckets`` buckets at most that minimise the sum of padded lengths.

    ``tops`` ascend; each bucket is a run of bins padded to its largest top. Of equal minima the one whose
    last boundaries come earliest is taken. No bins give no boundaries.
    """
    n = len(tops)
    if not n:
        return []
    below = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    top = np.array(tops, np.float64)
    best = top * below[1:]  # one bucket for the bins up to each
    choices = []
    for _ in range(min(buckets, n) - 1):
        cost, choice = np.empty(n), np.empty(n, np.int64)
        previous = np.concatenate(([0.0], best))
        # the best choice of a bin is never before that of a smaller bin, so halves bound each other
        spans = [(0, n - 1, 0, n - 1)]
        while spans:
            low, high, first, last = spans.pop()
            j = (low + high) // 2
            i = np.arange(first, min(last, j) + 1)
            over = previous[i] + top[j] * (below[j + 1] - below[i])
            at = int(over.argmin())
            choice[j], cost[j] = first + at, over[at]
            if low < j:
                spans.append((low, j - 1, first, int(choice[j])))
            if j < high:
                spans.append((j + 1, high, int(choice[j]), last))
        choices.append(choice)
        best = cost
    out, j = [], n - 1
    for choice in [*reversed(choices), None]:
        out.append(int(tops[j]))
        j = -1 if choice is None else int(choice[j]) - 1
        if j < 0:
            break
    return out[::-1]


def pack(docs: DataFrame, length=None, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """The bucket and batch of every document.

    ``docs`` has ``doc_id`` and, unless ``length`` (a Column) says otherwise, ``text`` with words as tokens; other
    columns are ignored; one row per row. Returns ``doc_id``, ``n_tokens``, ``bucket`` (int, from 0 by length),
    ``bucket_len`` (tokens that the bucket's documents are padded to), ``batch`` (long, from 0 within a
    bucket), ``slot`` (int, place in the batch) and ``batch_size``, the documents that fill a batch: bucket_len
    times batch_size is within ``budget``, or batch_size is 1 where one document alone is over it. Documents
    are never cut. Each bucket's batches but its last are full.

    Null and empty texts have 0 tokens and are in the first bucket. Order in a bucket is by a hash of doc_id and length, so
    neighbours in the table are spread over the batches; repeated and null doc_ids are rows of their own.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (n_words() if length is None else F.coalesce(length.cast("long"), F.lit(0))).alias("n_tokens"))
    sized = Table(sized.withColumn("top", F.greatest("n_tokens", F.lit(1).cast("long"))), "lengths").df
    bins = sized.groupBy("top").agg(F.count("*").alias("n")).orderBy("top").collect()  # as many as there are lengths
    ends = boundaries([b["top"] for b in bins], [b["n"] for b in bins], buckets)
    total = sum(b["n"] for b in bins)
    if not ends:
        ends = [1]
    bucket = F.lit(len(ends) - 1)
    padded = F.lit(ends[-1])
    for k in reversed(range(len(ends) - 1)):
        bucket = F.when(F.col("top") <= ends[k], k).otherwise(bucket)
        padded = F.when(F.col("top") <= ends[k], ends[k]).otherwise(padded)
    placed = sized.select(
        "doc_id", "n_tokens", bucket.cast("int").alias("bucket"), padded.cast("long").alias("bucket_len"), F.md5(F.concat_ws(":", "doc_id", "n_tokens")).alias("h")
    )
    placed = placed.withColumn("cell", F.conv(F.substring("h", 1, 15), 16, 10).cast("long") % max(1, -(-total // CELL)))
    # rows are numbered within cells of bounded size; a cell starts where the cells before it end
    counts = placed.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    placed = placed.join(_starts(counts), ["bucket", "cell"])
    number = "row_number() over (partition by bucket, cell order by h, doc_id, n_tokens) - 1 + start"
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    return placed.withColumn("number", F.expr(number)).select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.floor(F.col("number") / fits).cast("long").alias("batch"), (F.col("number") % fits).cast("int").alias("slot"), fits.alias("batch_size"),
    )


def _starts(counts: DataFrame) -> DataFrame:
    """(bucket, cell, start): running totals of the cells' counts. A row for each 20,000 documents and bucket."""
    return counts.selectExpr("bucket", "cell", "sum(n) over (partition by bucket order by cell) - n as start")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
