"""Adding a system's words to the wide records of documents: aligned by time, by least edits or by lines, each document for itself.

A document that can't be aligned gives an error row, beside the others' records from the same pass; its own records stay as they are.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import written
from .alignment import _by_time
from .resegmentation import resegment

#: How words find their sentences, and what the records then say of it.
LABELS = {"time": "time", "mwer": "mwer", "lines": "lines 1:1"}


def _placed(method: str, words: pd.DataFrame, sentences: pd.DataFrame) -> list[int]:
    """The place of each word's sentence; raises ValueError where there is none."""
    if method == "lines":
        lines = words["line"].drop_duplicates().tolist()
        if len(lines) != len(sentences):
            raise ValueError(f"{len(lines)} lines for {len(sentences)} sentences")
        at = {x: k for k, x in enumerate(sorted(lines))}
        return [at[x] for x in words["line"]]
    if method == "time":
        if words[["start", "end"]].isna().any(axis=None):
            raise ValueError("words without times")
        order = sentences[["beg", "end"]].itertuples(index=False)
        return _by_time(list(zip(words["start"], words["end"])), [tuple(x) for x in order])
    if sentences["reference"].isna().all():
        raise ValueError("no text of the reference system")
    return resegment([w or "" for w in words["word"]], [(t or "").split() for t in sentences["reference"]])


def add_system(records: DataFrame, words: DataFrame, by: str, name: str, lan: str, method: str = "mwer", reference: str | None = None, human: bool = False, overwrite: bool = False, joiner: str = " ") -> tuple[DataFrame, DataFrame]:
    """The records with a system's text, words and alignment, and the documents (``by``) that failed with their ``error``.

    ``records`` have ``by``, ``sentence`` (its order), ``beg``, ``end`` and the maps ``systems_info`` (struct lan, is_human), ``text``, ``alignment``; other
    columns stay. ``words`` have ``by``, ``pos``, ``word``, ``start``, ``end`` and ``line``. Documents that ``words`` doesn't have are left as they are, without an error;
    those whose words are all null or blank, that know the system already (unless ``overwrite``), or that the method can't align, have one. ``reference`` is the system to align to by
    least edits, else the first one of the same language.
    """
    if method not in LABELS:
        raise ValueError(f"method {method!r} is none of {sorted(LABELS)}")
    same = F.filter(F.array_sort(F.map_entries("systems_info")), lambda e: (e["value"]["lan"] == lan) & (e["key"] != name))
    ref = F.lit(reference) if reference else F.get(same, 0)["key"]
    known = F.map_contains_key("systems_info", F.lit(name))
    sides = records.select(by, "sentence", F.col("beg").cast("double").alias("beg"), F.col("end").cast("double").alias("end"), F.try_element_at("text", ref).alias("reference"), known.alias("known"))
    spoken = words.select(by, "pos", F.trim("word").alias("word"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("line").cast("long").alias("line"))

    def run(key: tuple, w: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=["doc", "pos", "sentence", "word", "error"])
        if not len(w) or not len(s):
            return out
        w, s = w.sort_values("pos", kind="stable"), s.sort_values("sentence", kind="stable").reset_index(drop=True)
        try:
            if s["known"].any() and not overwrite:
                raise ValueError(f"system {name!r} is there already")
            if not (w["word"].fillna("") != "").any():
                raise ValueError("no words")
            at = _placed(method, w, s)
            return pd.DataFrame({"doc": pd.Series([key[0]] * len(w), dtype=object), "pos": w["pos"].to_numpy(), "sentence": s["sentence"].to_numpy()[at], "word": w["word"].to_numpy(), "error": None})
        except Exception as error:  # one document's fault is no other's
            return pd.DataFrame([(key[0], None, None, None, str(error))], columns=out.columns)

    kinds = dict(records.dtypes)
    found = written(spoken.groupBy(by).cogroup(sides.groupBy(by)).applyInPandas(run, f"doc {kinds[by]}, pos long, sentence {kinds['sentence']}, word string, error string"), "placed").withColumnRenamed("doc", by)
    # written places take few bytes a row, so their file's size says nothing of what they take in memory: none is broadcast
    errors = found.where("error is not null").select(by, "error").hint("merge")
    good = found.where("error is null")
    texts = good.where(F.coalesce("word", F.lit("")) != "").groupBy(by, "sentence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), joiner).alias("_added"))
    done = good.select(by).distinct().withColumn("_done", F.lit(True))
    both = records.join(done.hint("merge"), by, "left").join(texts.hint("merge"), [by, "sentence"], "left")

    def upserted(column: str, value) -> None:
        nonlocal both
        rest = F.map_filter(F.coalesce(column, F.create_map().cast(kinds[column])), lambda k, _: k != name)
        both = both.withColumn(column, F.when(F.col("_done"), F.map_concat(rest, F.create_map(F.lit(name), value))).otherwise(F.col(column)))

    upserted("systems_info", F.struct(F.lit(lan).alias("lan"), F.lit(human).alias("is_human")))
    upserted("text", F.coalesce("_added", F.lit("")))
    upserted("alignment", F.lit(LABELS[method]))
    return both.select(*records.columns), errors
