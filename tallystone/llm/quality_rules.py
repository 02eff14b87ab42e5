"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good or bad on a document or abstains. The label model has two classes of documents, good and bad, and
votes are independent given the class. It is fitted by expectation-maximisation to the counts of the vote patterns, of
which there are 3 ** (number of rules) at most however large the corpus is. That estimates for every rule how often it votes bad,
good or not at all on good and on bad documents; the posterior probability of "good" then decides.

No label is read: what tells a rule that errs from one that finds junk is agreement. Two bad votes start as bad, none as good,
one as undecided, and the rounds settle what a single bad vote of each rule is worth. A rule whose bad votes the others
don't share is overruled by their good votes; several abstentions where good documents seldom have any can
reject without a bad vote. So kinds of junk should be seen by two rules at least, as they are by ``RULES``.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Table, fresh, read_table

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window for repeats.
WINDOW = 5
ROUNDS = 20
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Votes that each estimate starts from, so that no probability is zero.
PRIOR_COUNT = 0.1
#: Probability of "good" by the number of bad votes, 0, 1, and 2 or more, from which the first estimates are made.
START = (0.98, 0.5, 0.02)


@dataclass(frozen=True)
class Rule:
    """Votes bad if ``value`` is in the SQL condition ``bad``, else good if in ``good``, else abstains."""

    name: str
    bad: str
    good: str


#: On the columns of ``features``. Ratios are compared by products: no division by zero.
RULES = (
    Rule("length", "n_words < 20", "n_words >= 60"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars >= 4 * n_words and word_chars <= 7 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("lines", "5 * n_dup_lines > 2 * n_lines", "10 * n_dup_lines <= n_lines"),
    Rule("repeats", "4 * n_repeat_words > n_words", "10 * n_repeat_words <= n_words"),
    Rule("letters", "4 * n_letters < 3 * word_chars", "10 * n_letters >= 9 * word_chars"),
    Rule("capitals", "2 * n_capitals > n_letters", "10 * n_capitals <= n_letters"),
    Rule("variety", "3 * n_distinct < n_words", "2 * n_distinct >= n_words"),
    Rule("marks", "2 * n_marks > n_words or 50 * n_marks < n_words", "4 * n_marks <= n_words and 25 * n_marks >= n_words"),
)


def features(docs: DataFrame, row: str | None = None) -> DataFrame:
    """By doc_id the counts that the rules read, all long, over whole texts; a null text counts as empty.

    ``n_words``, ``n_distinct`` (different words), ``word_chars`` (code points in words), ``n_symbols``, ``n_marks`` (of ``.!?``),
    ``n_lines`` (lines with a word), ``n_dup_lines`` (those equal to an earlier line), ``n_repeat_words`` (words in a window of five that
    the text holds twice or more, the first included), ``n_letters``, ``n_capitals``. With ``row`` there is a column of
    this name that holds all columns of ``docs`` as a struct; else no other column is read or kept.
    """
    text = F.coalesce("text", F.lit(""))
    carried = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row)] if row else []
    also = [row] if row else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, text.alias("text")).select("*", F.btrim("text", F.lit(BLANKS)).alias("body"))
    cut = base.select(
        "doc_id",
        *also,
        "text",
        F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", r"\s+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    hashed = cut.select("*", F.array_join("words", "").alias("joined"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    # A window's hash is that of its words' hashes. Equal windows have equal hashes. Only where two hashes are equal are the
    # words themselves sorted, so that equal windows are neighbours, and the starts of those found twice or more kept.
    shifted = F.arrays_zip("h", *(F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))).alias(f"h{k}") for k in range(1, WINDOW)))
    windows = F.transform(F.slice(shifted, F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))), lambda z: F.xxhash64(z))
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    texts = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("words", i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("i")))
    marked = hashed.withColumn("hashes", windows).withColumn("windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(texts)))
    twice = F.transform(
        "windows",
        lambda x, k: F.when((x["w"] == F.get("windows", k - 1)["w"]) | (x["w"] == F.get("windows", k + 1)["w"]), x["i"]),
    )
    repeated = marked.withColumn("at", F.sort_array(F.array_compact(twice)))
    covered = F.transform("at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - i, F.lit(WINDOW))))
    return repeated.select(
        "doc_id",
        *also,
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
        F.length("joined").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda n, c: n + c), F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.length("joined") - F.regexp_count("joined", F.lit(r"\P{L}"))).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), BAD).when(F.expr(rule.good), GOOD).otherwise(ABSTAIN)


def _slots(rules) -> Column:
    """The votes as slots of a class's parameters: 3 for each rule, then one for the class's share."""
    return F.array(*(vote(r) + 3 * k for k, r in enumerate(rules)), F.lit(3 * len(rules)))


def _posterior(model: list[list[float]], votes: str = "votes") -> Column:
    """The posterior probability of "good" from the slots of the votes."""
    odds = [b - g for g, b in zip(*model)]
    return 1 / (1 + F.exp(F.aggregate(votes, F.lit(0.0), lambda total, slot: total + F.get(F.lit(odds), slot))))


def fit(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> list[list[float]]:
    """The label model from the distinct ``votes`` (slots) and their count ``n``.

    Returns a list for "good" and one for "bad": the logarithms of the probabilities of (bad, abstain, good) for each
    rule, and of the class's share. Each round is one aggregation over the patterns, to a row for each slot.
    """
    last = 3 * n_rules
    against = F.size(F.filter("votes", lambda slot: (slot < last) & (slot % 3 == BAD)))
    p = F.get(F.lit(list(START)), F.least(against, F.lit(2)))
    model = None
    for _ in range(rounds):
        rated = patterns.select("n", "votes", (p if model is None else _posterior(model)).alias("p"))
        sums = rated.select(F.explode("votes").alias("slot"), "n", "p").groupBy("slot").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad"))
        found = {r["slot"]: (r["good"], r["bad"]) for r in sums.collect()}
        sizes = found.get(last, (0.0, 0.0))
        model = []
        for c, size in enumerate(sizes):
            votes = [math.log((found.get(k, (0.0, 0.0))[c] + PRIOR_COUNT) / (size + 3 * PRIOR_COUNT)) for k in range(last)]
            model.append([*votes, math.log((size + PRIOR_COUNT) / (sum(sizes) + 2 * PRIOR_COUNT))])
    return model


def _judged(docs: DataFrame, rules, rounds: int, at_least: float, row: str | None) -> DataFrame:
    voted = Table(features(docs, row).withColumn("votes", _slots(rules)), "votes").df
    patterns = Table(voted.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1).sortWithinPartitions("votes"), "patterns")
    model = fit(patterns.df, len(rules), rounds)
    patterns.drop()
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.withColumn("posterior", _posterior(model)).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= at_least))


def judge(docs: DataFrame, rules=RULES, rounds: int = ROUNDS, at_least: float = 0.5) -> DataFrame:
    """The counts, the votes' posterior and the verdict for every document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored; one row per row, repeated and null
    doc_ids included. Returns the columns of ``features``, ``base_failed`` (fewer than 10 words, or over
    20 % of the words repeated), ``posterior`` (double, probability of "good") and ``kept`` (false if
    base_failed, else posterior >= ``at_least``). Null, empty and blank texts have no words and fail. The
    model is fitted to all documents, an empty table gives no rows.
    """
    return _judged(docs, rules, rounds, at_least, None).drop("votes")


def keep_good(docs: DataFrame, rules=RULES, rounds: int = ROUNDS, at_least: float = 0.5) -> DataFrame:
    """The documents that ``judge`` keeps, with their columns; a row with a null doc_id is judged like any other.

    The columns are written along with the votes, so that nothing is joined back.
    """
    kept = _judged(docs, rules, rounds, at_least, "row").where("kept")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
