"""Which texts hold which of a list of strings, and where first."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import written

#: Bytes of needles up to which they are shipped to every task as one automaton.
SHIPPED = 16_000_000
GRAM = 24
#: Bits of the map of the needles' hashes.
BITS = 1 << 26


def _scan(needles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        by_text: dict[str, list] = {}
        for item, needle in needles.value:
            by_text.setdefault(needle, []).append(item)
        for needle, items in by_text.items():
            automaton.add_word(needle, (items, len(needle)))
        automaton.make_automaton()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                seen = set()
                for end, (items, size) in automaton.iter(text.as_py() or ""):
                    if items[0] not in seen:
                        seen.add(items[0])
                        out += [(doc_id, i, end - size + 1) for i in items]
            if out:
                ids, items, places = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(places, pa.int32())], ["doc_id", "item_id", "beg"])

    return run


def _mark(part: str) -> int:
    return xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass")) - (1 << 63)


def _heads(gram: int):
    """Needles (item_id, needle) with the hash of their first ``gram`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [_mark(x.as_py()[:gram]) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.int64())], ["item_id", "needle", "mark"])

    return run


def _marks(gram: int, known):
    """Each text's digest with the hashes of its different substrings of ``gram`` characters that a needle may begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.int64)
        for b in batches:
            for digest, text in zip(b.column(0), b.column(1)):
                t = text.as_py()
                own = np.fromiter({_mark(t[i : i + gram]) for i in range(len(t) - gram + 1)}, np.int64)
                place = own & (BITS - 1)
                own = own[(bits[place >> 6] >> (place & 63) & 1).astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()] * len(own), pa.string()), pa.array(own, pa.int64())], ["digest", "mark"])

    return run


def _bitmap(marks: DataFrame) -> bytes:
    """A bit for each hash, by its last digits: ``BITS`` bits in all, however many needles there are."""
    words = marks.selectExpr(f"shiftright(mark & {BITS - 1}L, 6) as word", "shiftleft(1L, cast(mark & 63L as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.tobytes()


def contained(docs: DataFrame, needles: DataFrame, shipped: int = SHIPPED) -> DataFrame:
    """``doc_id``, ``item_id``, ``beg`` (first place, code points from 0) of each (document, needle) where the text holds the needle.

    ``docs`` has doc_id and text, ``needles`` item_id and needle; null and empty needles are in no text. Up to
    ``shipped`` bytes of needles (checked) go to every task as one automaton, which reads each text once. Beyond that
    texts are read into hashes of their substrings, those that no needle begins with are left out by a bitmap, and an equi-join on the hash gives candidates, which
    are verified; needles shorter than that share their whole length's hash in the same way, a pass for each length. What a text holds depends on it alone, so candidates meet texts by digest,
    and rows of null or repeated ids are kept.
    """
    needles = needles.where("item_id is not null and needle <> ''")
    size = needles.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    text = docs.select("doc_id", "text").where("text is not null")
    if size <= shipped:
        known = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["needle"]) for r in needles.collect()])
        return text.mapInArrow(_scan(known), "doc_id long, item_id long, beg int")
    short = [r[0] for r in needles.where(F.length("needle") < GRAM).select(F.length("needle")).distinct().collect()]  # below GRAM of them
    keyed = text.withColumn("digest", F.sha2("text", 256))
    found = None
    for gram in [*short, GRAM]:
        own = needles.where(F.length("needle") == gram if gram < GRAM else F.length("needle") >= GRAM)
        marks = written(own.select("item_id", "needle").mapInArrow(_heads(gram), "item_id long, needle string, mark long"), "needles")
        bits = docs.sparkSession.sparkContext.broadcast(_bitmap(marks))
        hit = keyed.select("digest", "text").mapInArrow(_marks(gram, bits), "digest string, mark long").distinct().join(marks, "mark").select("digest", "item_id", "needle")
        hits = keyed.join(hit, "digest").where(F.instr("text", F.col("needle")) > 0).select("doc_id", "item_id", (F.instr("text", F.col("needle")) - 1).cast("int").alias("beg"))
        found = hits if found is None else found.union(hits)
    return found
