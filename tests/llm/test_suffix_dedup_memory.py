"""Suffix dedup's last step: its memory, and strings at the edges of documents."""

import random
import tracemalloc

import pyarrow as pa

from tallystone.llm import suffix_dedup


def test_applying_takes_a_few_bytes_for_each_of_the_block(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(suffix_dedup, "TaskContext", Task)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh é", k=2000)).encode() for _ in range(2000)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    (block,) = suffix_dedup._blocks(1 << 30)(iter([rows]))
    none = pa.table({n: pa.array([], pa.int64() if n in ("bucket", "block") else pa.binary()) for n in ("bucket", "block", "texts", "sizes", "keys", "ranks")})
    left = pa.Table.from_batches([block.drop_columns(["bytes"])])
    tracemalloc.start()
    done = suffix_dedup._applied(50, True)((), left, none)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done.column("_kept").to_pylist() == texts
    assert peak < 8 * sum(map(len, texts))


def test_strings_at_the_edges_of_documents(spark):
    """A string that ends with its document says nothing of the next one's begin."""
    rng = random.Random(4)
    a, b, c = ("".join(rng.choices("abcdefgh", k=80)) for _ in range(3))
    docs = spark.createDataFrame([(1, a + b), (2, c + a), (3, b + c), (4, ""), (5, a), (6, c[:49])], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == {1: a + b, 2: c, 3: "", 4: "", 5: "", 6: c[:49]}
