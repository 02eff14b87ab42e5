"""Predicates, projections and small aggregates of evaluation records.

Column functions give a Column; the others take DataFrames. Values that a record doesn't have pass filters where it is said.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def projected(values: Column, keys: list[str]) -> Column:
    """The entries of a map for those of ``keys`` that it has, in the order of ``keys``: array of struct key, value."""
    has = lambda k: F.map_contains_key(values, k)
    return F.transform(F.filter(F.array(*map(F.lit, keys)), has), lambda k: F.struct(k.alias("key"), F.element_at(values, k).alias("value")))


def wanted(confidence: Column | None = None, severity: Column | None = None, language: Column | None = None, source: Column | None = None, models: Column | None = None, *, least: float | None = None, severities: list | None = None, languages: list | None = None, sources: list | None = None, min_models: int | None = None) -> Column:
    """Whether a target passes all filters given: ``least`` confidence, one of ``severities``, ``languages``, ``sources``, ``min_models``. A missing confidence, severity or count passes; a missing language or source doesn't."""
    passes = F.lit(True)
    if least is not None:
        passes = passes & (confidence.isNull() | (confidence >= least))
    if severities:
        passes = passes & (severity.isNull() | severity.isin(*severities))
    if languages:
        passes = passes & F.coalesce(language.isin(*languages), F.lit(False))
    if sources:
        passes = passes & F.coalesce(source.isin(*sources), F.lit(False))
    if min_models is not None:
        passes = passes & (models.isNull() | (models >= min_models))
    return F.coalesce(passes, F.lit(True))


def voted(votes: DataFrame, item: list[str], voter: str, least: int) -> DataFrame:
    """``item`` and its number of different ``voters``, where they are ``least`` or more."""
    return votes.groupBy(*item).agg(F.count_distinct(voter).alias("voters")).where(F.col("voters") >= least)


def implicated(targets: Column, system: str, source: str, name: Column, word: str) -> Column:
    """Whether any target is of the system ``name``, or its error source holds ``word``, in any case."""
    return F.coalesce(F.exists(targets, lambda t: F.coalesce(t[system] == name, F.lit(False)) | F.coalesce(F.contains(F.lower(t[source]), F.lit(word.lower())), F.lit(False))), F.lit(False))


def valid_span(start: Column, end: Column, duration: Column, slack: float = 1.0) -> Column:
    """Whether a span has both ends, begins at 0 or later, has a length, and ends within the duration and ``slack``."""
    return F.coalesce((start >= 0) & (end > start) & (end <= duration + slack), F.lit(False))


def unlike_source(targets: DataFrame, lines: DataFrame, on: list[str], text: str = "text", line: str = "line_text") -> DataFrame:
    """The targets whose text isn't that of their source line, white space squeezed; ``found`` tells whether there is such a line.

    ``on`` names document and line number on both sides; of a repeated line number the least text counts.
    """
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    known = lines.groupBy(*on).agg(F.min(line).alias(line), F.lit(True).alias("found"))
    both = targets.join(known, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return both.where(~F.col("found") | (squeezed(F.col(text)) != squeezed(F.col(line))))


def updated(df: DataFrame, given: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` overwritten by the values that ``given`` has for its key; nulls there keep the old ones."""
    new = given.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    both = df.join(new, key, "left")
    return both.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))


def universe(keys: list[str], inputs: DataFrame | None = None, ledgers: list[DataFrame] | None = None, flagged: list[DataFrame] | None = None) -> DataFrame:
    """The distinct keys that negatives are counted over: those of the input if there is one, else those that all ledgers have, else those that any run has flagged."""
    if inputs is not None:
        return inputs.select(*keys).distinct()
    if ledgers:
        found = ledgers[0].select(*keys).distinct()
        for other in ledgers[1:]:
            found = found.intersect(other.select(*keys))
        return found
    if not flagged:
        raise ValueError("no input, ledger or flags to take keys from")
    found = flagged[0].select(*keys)
    for other in flagged[1:]:
        found = found.union(other.select(*keys))
    return found.distinct()


def lateness(words: DataFrame, by: list[str], emitted: str, end: Column) -> DataFrame:
    """``by`` with ``late`` words, emitted at the recording's end or after it, of ``n``."""
    return words.groupBy(*by).agg(F.count_if(F.col(emitted) >= end).alias("late"), F.count("*").alias("n"))


def widened(windows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """``by`` with ``lo`` and ``hi`` of all attached windows; missing bounds don't count."""
    return windows.groupBy(*by).agg(F.min(start).alias("lo"), F.max(end).alias("hi"))


def prefix_walk(segments: DataFrame, by: list[str], order: list[str], text: str, wanted_length: int) -> DataFrame:
    """``by`` and ``k`` (from 1), the first segment at whose end the texts, joined by single spaces, have the wanted length; keys that never do have no row."""
    size = F.coalesce(F.length(text), F.lit(0)).cast("long") + 1
    run = ranks.running(segments, by, order, {"_before": size, "_k": F.lit(1).cast("long")})
    return run.where(F.col("_before") + size - 1 >= wanted_length).groupBy(*by).agg((F.min("_k") + 1).alias("k"))


def proportional_parts(rows: DataFrame, by: list[str], order: list[str], size: Column, n: int, out: str = "part") -> DataFrame:
    """Rows with the one of ``n`` equal parts of their key's total size that their middle is in; keys without any size give no rows."""
    sized = rows.withColumn("_size", size.cast("double"))
    total = sized.groupBy(*by).agg(F.sum("_size").alias("_total")).where("_total > 0")
    placed = ranks.running(sized, by, order, {"_before": F.col("_size")}).join(total, by)
    part = F.floor(F.lit(n) * (F.col("_before") + F.col("_size") / 2) / F.col("_total"))
    return placed.withColumn(out, F.least(F.lit(n - 1), part).cast("int")).drop("_size", "_before", "_total")


def jobs(items: DataFrame, spans: Column, targets: Column, rules: Column) -> DataFrame:
    """A row for each span, target and rule of an item (``span``, ``target``, ``rule``), without a shuffle; items that lack any of them have none."""
    each = items.withColumn("_t", targets).withColumn("_r", rules).withColumn("span", F.explode(spans))
    return each.withColumn("target", F.explode("_t")).withColumn("rule", F.explode("_r")).drop("_t", "_r")


def reasons(failures: DataFrame, reason: str, order: str) -> DataFrame:
    """Each different ``reason`` with its count ``n`` and ``first``, where it was first seen."""
    return failures.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def violated(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that aren't met, in their order; an unknown one isn't met."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(met, F.lit(False)), F.lit(name)) for name, met in conditions.items())))


def in_order_of_appearance(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each different ``key`` with ``first``, the least ``order`` of its rows, and its ``place`` (from 1); keys are documents or sources, a row each. A null key beside others is an error."""
    groups = rows.groupBy(key).agg(F.min(order).alias("first"))
    placed = ranks.numbered(groups, [], ["first", key], "_n").withColumn("place", (F.col("_n") + 1).cast("int")).drop("_n")
    lone = F.when(F.col(key).isNull() & (F.col("place") > 1), F.raise_error(F.lit(f"rows without {key} beside others")).cast("int"))
    return placed.withColumn("place", F.coalesce(lone, "place"))


def placed_by_list(rows: DataFrame, key: str, wanted_order: list[str]) -> DataFrame:
    """Rows with ``place``, that of their key in a list (from 1); keys that it doesn't have share the place after its last."""
    at = F.array_position(F.array(*map(F.lit, wanted_order)), F.col(key))
    return rows.withColumn("place", F.when(at > 0, at).otherwise(len(wanted_order) + 1).cast("int"))


def first_documents(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of the ``n`` documents that come first by ``key``."""
    return rows.join(F.broadcast(rows.select(key).distinct().orderBy(key).limit(n)), key, "left_semi") if n <= 10_000 else rows.join(rows.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def by_rate(rows: DataFrame, name: str, rate: Column) -> DataFrame:
    """Each different ``name`` with its ``place`` (from 1) by ``rate`` of its rows, the largest first, then by name; names are systems or sources."""
    rated = rows.groupBy(name).agg((-rate).alias("_rate"))
    return ranks.numbered(rated, [], ["_rate", name], "_n").select(name, (F.col("_n") + 1).cast("int").alias("place"))


def numbered_rules(rules: DataFrame, segment: str, order: list[str], out: str = "rule") -> DataFrame:
    """Rules with their names: segment, ``.r`` and their number within it, from 1."""
    named = ranks.numbered(rules, [segment], order, "_n")
    return named.withColumn(out, F.concat(F.col(segment).cast("string"), F.lit(".r"), (F.col("_n") + 1).cast("string"))).drop("_n")


def chat(rows: Column, role: str, text: str) -> Column:
    """A prompt of an array of turns, a line each: number in brackets, role and text; missing texts are empty."""
    told = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(r[role], F.lit("")), F.lit(": "), F.coalesce(r[text], F.lit("")))
    return F.array_join(F.transform(rows, told), "\n")


def stratum(confidence: Column, which: str, sure: float = 1.0, borderline: float = 0.5) -> Column:
    """Whether a confidence is in a stratum: ``all``, ``harmful`` (``sure`` at least) or ``borderline`` (``borderline`` at least, less than ``sure``). An unknown confidence is in ``all`` only."""
    within = {"all": F.lit(True), "harmful": confidence >= sure, "borderline": (confidence >= borderline) & (confidence < sure)}
    return F.coalesce(within[which], F.lit(False))


def shown_to(system: Column, asr_system: Column, language: Column, languages: list[str] | None, with_asr: bool = True) -> Column:
    """Whether a target is wanted: the transcript's by ``with_asr`` alone, translations by their language, if any is asked for."""
    other = F.coalesce(language.isin(*languages), F.lit(False)) if languages else F.lit(True)
    return F.when(F.coalesce(system == asr_system, F.lit(False)), F.lit(with_asr)).otherwise(other)


def plain_segments(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """Machine translations as segments: ``segment``, trimmed, and ``id`` where there is one; null and blank texts stay as empty segments."""
    return rows.select(F.trim(F.coalesce(text, F.lit(""))).alias("segment"), F.col(ident).alias("id"))


def sentence_text(words: Column, word: str, offset: str) -> Column:
    """The words of an array joined as they were spaced: with a space where a word begins later than the last one ended, with single spaces where offsets are unknown."""

    def joined(s: Column, w: Column) -> Column:
        known = s["end"].isNotNull() & w[offset].isNotNull()
        gap = F.when(s["text"] == "", "").when(known & (w[offset] <= s["end"]), "").otherwise(" ")
        return F.struct(F.concat(s["text"], gap, w[word]).alias("text"), (w[offset] + F.length(w[word])).cast("int").alias("end"))

    return F.aggregate(words, F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("end")), joined, lambda s: s["text"])
