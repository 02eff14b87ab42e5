"""Building and merging evaluation records: word ranges, contexts, prefilled rules, gold verdicts, unified manifests."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .joins import overlap_pairs

EPS = 1e-6
WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))


def usable_times(words: Column) -> Column:
    """Whether all words of an array<struct<start,end>> have times, the starts don't fall, and not all words are points."""
    starts = F.transform(words, lambda w: w["start"])
    known = F.forall(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    rising = F.forall(F.zip_with(F.slice(starts, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(starts, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: b >= a - EPS), lambda ok: ok)
    long = F.exists(words, lambda w: F.abs(w["end"] - w["start"]) > EPS)
    return F.coalesce((F.size(words) > 0) & known & rising & long, F.lit(False))


def word_range(words: Column, seg_start: Column, seg_end: Column, low: Column, high: Column) -> Column:
    """struct(first, last), from 1: the words of a segment in the closed interval [low, high]; null for none.

    A word is where its middle is, or with unusable times spread evenly over the segment. If none is inside a
    real interval the nearest to its middle is taken, of equals (to six digits) the first. A segment without length is in the interval as a whole or not.
    """
    n = F.size(words)
    spread = F.transform(words, lambda _, i: seg_start + (i + 0.5) / n * (seg_end - seg_start))
    timed = usable_times(words)
    at = F.when(timed, F.transform(words, lambda w: (w["start"] + w["end"]) / 2)).otherwise(spread)
    inside = F.filter(F.transform(at, lambda p, i: F.when((p >= low) & (p <= high), i + 1)), lambda i: i.isNotNull())
    middle = (low + high) / 2
    nearest = F.array_min(F.transform(at, lambda p, i: F.struct(F.round(F.abs(p - middle), 6).alias("d"), (i + 1).alias("i"))))["i"]
    pair = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    point = ~timed & (seg_end - seg_start <= EPS)
    return (
        F.when((n <= 0) | n.isNull() | (~timed & (seg_start.isNull() | seg_end.isNull())), None)
        .when(point, F.when((seg_start >= low - EPS) & (seg_start <= high + EPS), pair(F.lit(1), n)))
        .when(F.size(inside) > 0, pair(F.array_min(inside), F.array_max(inside)))
        .when(high - low > EPS, pair(nearest, nearest))
    )


def part_named(first: Column, last: Column, n: Column, whole: str, head: str, tail: str, middle: str) -> Column:
    """A word range in words: formats for all ``n``, the first, the last, and from first to last."""
    return (
        F.when((first == 1) & (last == n), F.format_string(whole, n))
        .when(first == 1, F.format_string(head, last))
        .when(last == n, F.format_string(tail, n - first + 1))
        .otherwise(F.format_string(middle, first, last))
    )


def contexts(ranges: DataFrame, words: DataFrame, segments: DataFrame, by: list[str], ident: str) -> DataFrame:
    """For each word range (``by``, ``ident``, ``first``, ``last``) its ``start`` and ``end`` times, and by ``lang`` the joined text that overlaps it.

    ``words`` has by, ``pos`` (from 1), ``start``, ``end``; ``segments`` by, ``lang``, ``index``, ``first``, ``last``, ``text``. Times are null
    where the range leaves the words. Languages without an overlapping segment give no row; ranges without any give one with null lang.
    """
    begin = words.select(*by, F.col("pos").alias("first"), F.col("start"))
    finish = words.select(*by, F.col("pos").alias("last"), F.col("end"))
    known = words.select(*by).distinct().withColumn("_known", F.lit(True))
    timed = ranges.join(begin, [*by, "first"], "left").join(finish, [*by, "last"], "left").join(known, by, "left")
    both = F.col("start").isNotNull() & F.col("end").isNotNull()
    timed = timed.select(*by, ident, "first", "last", F.when(both, F.col("start")).alias("start"), F.when(both, F.col("end")).alias("end"))
    s = segments.select(*by, "lang", "index", F.col("first").alias("_f"), F.col("last").alias("_l"), "text")
    met = overlap_pairs(timed.select(*by, ident, "first", "last"), s, by, ("first", "last"), ("_f", "_l"), 8.0, closed=True)
    texts = met.groupBy(*by, ident, "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), " ").alias("context"))
    return timed.join(texts, [*by, ident], "left").select(*by, ident, "start", "end", "lang", "context")


def prefilled(items: DataFrame, rules: DataFrame) -> DataFrame:
    """``key``, ``rule`` for items (``key``, ``seg``, ``span``) from rules (``key``, ``rule_id``, ``spans``, ``rule``).

    A rule whose key an item has is that item's; else it goes to the items of its segment (``rule_id`` without ``.rN``) with one of its spans.
    """
    keyed = rules.join(items.select("key").distinct(), "key", "left_semi").select("key", "rule")
    rest = rules.join(items.select("key").distinct(), "key", "left_anti").withColumn("seg", F.regexp_replace("rule_id", r"\.r\d+$", "")).select("seg", "spans", "rule")
    each = rest.select("seg", F.explode(F.array_distinct("spans")).alias("span"), "rule")
    return keyed.unionByName(items.join(each, ["seg", "span"]).select("key", "rule"))


def same_language(texts: Column, languages: Column, reference: Column, skip: list[str]) -> Column:
    """The map of texts of the systems that have the reference system's language, itself included; systems without a language stay unless in ``skip``."""
    lan = F.try_element_at(languages, reference)
    other = lambda s: F.try_element_at(languages, s)
    return F.map_filter(texts, lambda s, _: (s == reference) | F.when(other(s).isNotNull() & lan.isNotNull(), other(s) == lan).otherwise(~s.isin(*skip)))


#: How the columns of a manifest tell its kind.
KINDS = {"audio_id": "annotated", "video_id": "timed"}


def manifest_kind(manifest: DataFrame) -> str:
    """Which normalisation a manifest needs, told by its columns."""
    for column, kind in KINDS.items():
        if column in manifest.columns:
            return kind
    raise ValueError(f"no column of {sorted(KINDS)}")


def unified(manifest: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """``id``, ``session``, ``speaker``, ``start``, ``end``, ``text`` of either kind of manifest; rows without an annotation keep null ``start``.

    A timed manifest has key, video_id, start_seconds, end_seconds and text; an annotated one audio_id, speaker_id and text, and its
    ``annotations`` audio_id, session, start, end. What isn't matched is told by ``start is null``.
    """
    if manifest_kind(manifest) == "timed":
        return manifest.select(F.col("key").alias("id"), F.coalesce(F.nullif(F.col("video_id"), F.lit("")), F.lit("unknown")).alias("session"), F.lit(None).cast("string").alias("speaker"), F.col("start_seconds").cast("double").alias("start"), F.col("end_seconds").cast("double").alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    joined = manifest.join(annotations.select("audio_id", "session", "start", "end"), "audio_id", "left")
    return joined.select(F.col("audio_id").alias("id"), "session", F.col("speaker_id").alias("speaker"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.coalesce("text", F.lit("")).alias("text"))


def flag_index(records: DataFrame) -> DataFrame:
    """By ``audio`` and system of the targets: ``flags`` (targets with a span), and ``gold`` of the first target that has any list of gold.

    ``records`` has ``line``, ``audio``, ``targets`` (array of struct with system, span) and ``gold`` (array of boolean). Gold of another length than
    the targets can't be paired and counts as none.
    """
    sound = F.size("gold") == F.size("targets")
    each = records.select("line", "audio", sound.alias("_ok"), "gold", F.posexplode("targets").alias("k", "t"))
    each = each.select("audio", F.struct("line", "k").alias("_o"), F.col("t.system").alias("system"), F.col("t.span").alias("span"), F.when(F.col("_ok"), F.get("gold", F.col("k"))).alias("gold"))
    return each.groupBy("audio", "system").agg(F.count("span").alias("flags"), F.min_by(F.struct("gold"), "_o")["gold"].alias("gold"))


@F.pandas_udf(WORDS)
def respaced(words: pd.Series, text: pd.Series) -> pd.Series:
    """Words with a leading space exactly where the text has one before them; where text and words differ a word stays as it is."""

    def one(found, t):
        if found is None or t is None:
            return found
        out, cursor = [], 0
        for w in found:
            token = w["word"].strip()
            at = t.find(token, cursor)
            if at >= 0 and not t[cursor:at].strip():
                cursor = at + len(token)
                w = {**w, "word": (" " if at == 0 or t[at - 1].isspace() else "") + token}
            out.append(w)
        return out

    return pd.Series([one(w, t) for w, t in zip(words, text)])


def timed_segment(words: Column, text: Column) -> Column:
    """struct(start, end, words): blank and untimed words go, spaces follow the text, the first word gets one; null without words."""
    kept = F.filter(words, lambda w: (F.trim(w["word"]) != "") & w["start"].isNotNull() & w["end"].isNotNull())
    spaced = respaced(kept, text)
    led = F.transform(spaced, lambda w, i: F.struct(F.when((i == 0) & ~w["word"].rlike(r"^\s"), F.concat(F.lit(" "), w["word"])).otherwise(w["word"]).alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    return F.when(F.size(kept) > 0, F.struct(F.get(led, F.lit(0))["start"].alias("start"), F.try_element_at(led, F.lit(-1))["end"].alias("end"), led.alias("words")))


def participants(named: Column, attributions: Column) -> Column:
    """The names in a comma-separated list, else the different values of a JSON map of speakers in order; null for none."""
    listed = F.filter(F.transform(F.split(named, ","), lambda p: F.trim(p)), lambda p: p != "")
    spoken = F.array_distinct(F.map_values(F.from_json(attributions, "map<string,string>")))
    return F.when(F.size(listed) > 0, listed).when(F.size(spoken) > 0, spoken)


def wait(retry_after: Column, failures: Column, most: float, key: Column) -> Column:
    """Seconds before another try: what the server says, else 2 ** failures (10 at most), at most ``most``, times 0.5 to 1.5 by a hash of ``key``."""
    told = F.expr("try_cast(0 as double)") if retry_after is None else retry_after.try_cast("double")
    base = F.coalesce(told, F.pow(F.lit(2.0), F.least(failures, F.lit(10))))
    return F.least(base, F.lit(most)) * (0.5 + F.pmod(F.crc32(key), F.lit(1000)) / 1000)


def padded_segments(segments: DataFrame, by: list[str], ends: DataFrame, least: float = 0.01) -> DataFrame:
    """``by``, ``offset``, ``duration``, ``text``, ``padding`` of reference segments (by, start, end, text), and an empty one to each recording's ``audio_end``.

    Durations are ``least`` at least; white space in texts is squeezed; the padding comes only where it is longer than ``least``.
    """
    own = segments.select(*by, F.round("start", 3).alias("offset"), F.round(F.greatest(F.col("end") - F.col("start"), F.lit(least)), 3).alias("duration"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.lit(False).alias("padding"))
    last = segments.groupBy(*by).agg(F.max_by("end", F.col("start")).alias("_end")).join(ends, by).where(F.col("audio_end") - F.col("_end") > least)
    pads = last.select(*by, F.round("_end", 3).alias("offset"), F.round(F.col("audio_end") - F.col("_end"), 3).alias("duration"), F.lit("").alias("text"), F.lit(True).alias("padding"))
    return own.unionByName(pads)


def wrong_durations(files: DataFrame, slack: float = 2.0) -> DataFrame:
    """The files (``begin``, ``finish`` from the name, ``duration`` probed) whose duration is off by over ``slack`` seconds, with ``expected``; unprobed ones too."""
    expected = F.col("finish") - F.col("begin")
    return files.withColumn("expected", expected).where(F.col("duration").isNull() | (F.abs(F.col("duration") - expected) > slack))


def judged(shown: Column, spans: Column, markers: Column) -> Column:
    """struct(gold, detail) of one annotator on one system's output: spans mean harmful, else markers tell, else null; null if not shown."""
    gold = F.when(F.coalesce(shown, F.lit(False)), F.when(F.size(spans) > 0, True).when(F.size(markers) > 0, False))
    detail = F.when(gold, "harmful").when(~gold, F.when(F.array_contains(markers, "undecidable"), "undecidable").otherwise("no_harm"))
    return F.struct(gold.alias("gold"), detail.alias("detail"))


def gold(votes: DataFrame, keys: list[str], any_votes: bool = False) -> DataFrame:
    """By keys (a segment's target) the combined ``gold`` of its annotators (``user``, ``gold``, ``spans``), merged ``gold_spans``, and ``by_user``.

    All must vote harmful, or with ``any_votes`` one; nulls don't vote. Spans are those of users who voted harmful, merged, where gold is true;
    none where it is false, null where nobody voted. The vote of a null user counts, but has no spans and no entry.
    """
    from ..functions import spans as sp

    own = F.when(F.col("gold") & F.col("user").isNotNull(), F.col("spans"))
    all_ = votes.groupBy(*keys).agg(
        (F.bool_or("gold") if any_votes else F.bool_and("gold")).alias("gold"), F.flatten(F.collect_list(own)).alias("_s"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("gold").isNotNull() & F.col("user").isNotNull(), F.struct("user", "gold"))))).alias("by_user"),
    )
    return all_.select(*keys, "gold", F.when(F.col("gold"), sp.merged(F.col("_s"))).when(~F.col("gold"), F.array().cast(sp.KIND)).alias("gold_spans"), "by_user")


def confirmed(records: DataFrame, key: list[str], system: str, order: list[str]) -> DataFrame:
    """One row for each target over files: the first ``target`` by ``order``, its different machine ``spans`` (signature start, end, intended), its users' verdicts combined.

    ``records`` has key, system, target, span (struct start, end, intended or null), user, gold. Targets are kept where all votes are harmful.
    """
    distinct = records.where("span is not null").groupBy(*key, system, "span").agg(F.min(F.struct(*order)).alias("_o"))
    spans = distinct.groupBy(*key, system).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "span"))), lambda x: x["span"]).alias("spans"))
    firsts = records.groupBy(*key, system).agg(F.min_by("target", F.struct(*order)).alias("target"), F.bool_and("gold").alias("gold"), F.count_distinct("user").alias("n_users"))
    return firsts.where("gold").join(spans, [*key, system], "left").select(*key, system, "target", "n_users", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def split_back(chunks: DataFrame) -> DataFrame:
    """Records from chunk answers (``chunk``, ``sources``: array of struct pos, start, end; ``answer``): ``chunk``, ``pos``, ``start``, ``end``, ``text``.

    An answer of as many lines as sources gives a record for each; another is one record from the first's start to the last's end. Blank texts go.
    """
    lines = F.split("answer", "\n")
    whole = F.array(F.struct(F.get("sources", F.lit(0))["pos"].alias("pos"), F.get("sources", F.lit(0))["start"].alias("start"), F.try_element_at("sources", F.lit(-1))["end"].alias("end"), F.col("answer").alias("text")))
    each = F.zip_with("sources", lines, lambda s, t: F.struct(s["pos"].alias("pos"), s["start"].alias("start"), s["end"].alias("end"), t.alias("text")))
    rows = chunks.select("chunk", F.explode(F.when(F.size(lines) == F.size("sources"), each).otherwise(whole)).alias("r"))
    return rows.select("chunk", "r.*").where(F.trim("text") != "")


SHARD = r"^([^/]+)/([^/]+)-(\d+)-of-(\d+)\.parquet$"


def shards(paths: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``config``, ``split`` and sorted ``files`` of ``path`` values config/split-i-of-n.parquet; other paths and excluded configs are left out."""
    found = paths.where(F.rlike("path", F.lit(SHARD))).select("path", F.regexp_extract("path", SHARD, 1).alias("config"), F.regexp_extract("path", SHARD, 2).alias("split"))
    return found.where(~F.col("config").isin(*exclude)).groupBy("config", "split").agg(F.sort_array(F.collect_list("path")).alias("files"))


def occurrences(documents: DataFrame) -> DataFrame:
    """A row for each error of model documents (``document``, ``model``, ``segments``: array of struct index, chunks: array of struct ok, errors: array of struct type, quote).

    Chunks that are ok, and errors without a quote, give none. ``ordinal`` numbers a segment's errors from 0 over its chunks.
    """
    each = documents.select("document", "model", F.explode("segments").alias("s"))
    flat = F.flatten(F.transform(F.filter("s.chunks", lambda c: ~F.coalesce(c["ok"], F.lit(False))), lambda c: F.coalesce(c["errors"], F.array().cast("array<struct<type:string,quote:string>>"))))
    return each.select("document", "model", F.col("s.index").alias("segment"), F.posexplode(flat).alias("ordinal", "e")).where(F.coalesce(F.trim("e.quote"), F.lit("")) != "").select("document", "model", "segment", "ordinal", "e.type", "e.quote")


def best_quote(quotes: Column, text: Column, least: int = 3, share: float = 0.7) -> Column:
    """Of quotes (trimmed) the one whose longest part in the text is longest, of equals the first; null if none has enough of it there.

    A part counts from ``share`` of the quote's characters on, rounded down, ``least`` of them at the least. Only parts that long are looked for.
    """
    held = F.coalesce(text, F.lit(""))

    def part(q: Column) -> Column:
        n = F.length(q)
        low = F.greatest(F.lit(least), F.floor(n * share).cast("int"))
        fits = lambda size: F.exists(F.sequence(F.lit(1), n - size + 1), lambda i: F.contains(held, F.substring(q, i, size)))
        sizes = F.when(low <= n, F.sequence(low, n))
        return F.when(F.contains(held, q) & (n >= low), n).otherwise(F.coalesce(F.array_max(F.filter(sizes, fits)), F.lit(0)))

    trimmed = F.filter(F.transform(quotes, lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != ""))
    told = F.filter(F.transform(trimmed, lambda q, i: F.struct((-part(q)).alias("n"), i.alias("i"), q.alias("q"))), lambda s: s["n"] < 0)
    return F.array_min(told)["q"]


def annotated(renderings: Column, explanation: Column) -> Column:
    """Renderings (array of struct with ``text`` and ``correct``) with a ``quote``: for incorrect ones the explanation's quote that fits the text best, else null."""
    quotes = tx.quoted(explanation)
    return F.transform(renderings, lambda r: r.withField("quote", F.when(~F.coalesce(r["correct"], F.lit(True)), best_quote(quotes, r["text"]))))


def report(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """Statistics as one JSON object for each group (``by``) and for all, in ``stats``; groups that are null stay apart from the whole."""
    whole = df.groupingSets([by, []], *by).agg(F.grouping_id().alias("_g"), *(v.alias(k) for k, v in values.items()))
    return whole.select(*by, (F.col("_g") > 0).alias("whole"), F.to_json(F.struct(*values)).alias("stats"))


def rules_of(jobs: DataFrame, make, n: int) -> DataFrame:
    """``n`` rules at most for each job (``key``, ``prompt``) from a backend's answers, one a line: ``key``, ``k`` (from 1), ``rule``."""
    from .models import generate

    lines = F.filter(F.transform(F.split("answer", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])\s*", ""))), lambda x: x != "")
    return generate(jobs, make).select("key", F.posexplode(F.slice(lines, 1, n)).alias("k", "rule")).select("key", (F.col("k") + 1).alias("k"), "rule")
