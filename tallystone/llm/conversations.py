"""Repair of conversations whose turns were dropped, blanked, cut, repeated or given to the wrong speaker.

Windows flag each turn's fault. A conversation's flags are collected in order and folded by ``aggregate``: four
structs (cost, audit), one for each thing the repaired roles may end with (nothing, system, user, assistant), are carried from turn to turn, and ``least`` of
structs takes the cheapest audit, the ASCII-least of equals. Two audits of equal cost at one state never begin one with the other (they would
differ by insertions, which cost), so the least prefix stays the least.

Long conversations are folded in pieces of ``PIECE`` turns, from each state that a piece may begin in; a second fold joins the pieces by
the same least expressions. So an audit is copied once for each piece, and a piece is a row of its own: a conversation of any length is dealt over tasks.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Table, read_table

STATES = 4
PIECE = 512
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Above the cost of any repair.
NEVER = 1 << 40
# White space and sentence ends.
INK = r"[^\x20\x09-\x0D]"
ENDS = r"[.!?][\x20\x09-\x0D]*\z"


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` rows with one of five kinds of damage, by a hash of conversation and turn; nulls count as one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20
    known = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return known.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def flagged(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with ``pos`` (from 0), ``initial``, ``fault`` (blank, duplicate, truncated or null: the first that holds) and ``illegal``, whether
    the role may not follow the one before.

    Turns are in order of ``turn`` (nulls first), equal ones of role and text. A turn is a duplicate if role and text were seen earlier in the conversation.
    """
    known = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = known.withColumn("pos", F.row_number().over(order) - 1).withColumn("initial", F.substring("role", 1, 1))
    pair = F.concat(F.lag("initial").over(W.partitionBy("conv_id").orderBy("pos")), F.col("initial"))
    # the texts' digest keeps the sort of this window small
    again = F.row_number().over(W.partitionBy("conv_id", "role", "_digest").orderBy("pos")) > 1
    seen = numbered.withColumn("_digest", F.sha2("text", 256)).withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))).withColumn("_again", again)
    fault = F.when(~F.col("text").rlike(INK), "blank").when(F.col("_again"), "duplicate").when(~F.col("text").rlike(ENDS), "truncated")
    return seen.withColumn("fault", fault).drop("_digest", "_again")


def _entry(cost: Column, audit: Column) -> Column:
    return F.struct(cost.alias("cost"), audit.alias("audit"))


def _more(state: Column, cost, letter: str) -> Column:
    return _entry(state["cost"] + cost, F.concat(state["audit"], F.lit(letter)))


def _inserted(s: list[Column]) -> list[Column]:
    """The four states after any insertions that may help: a user turn after nothing, system or assistant, then an assistant turn."""
    user = F.least(s[2], _more(s[0], INSERT, "I"), _more(s[1], INSERT, "I"), _more(s[3], INSERT, "I"))
    two = lambda x: _entry(x["cost"] + 2 * INSERT, F.concat(x["audit"], F.lit("II")))
    return [s[0], s[1], user, F.least(s[3], _more(s[2], INSERT, "I"), two(s[0]), two(s[1]))]


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _states(s: list[Column]) -> Column:
    return F.struct(*(x.alias(f"s{k}") for k, x in enumerate(s)))


def _parts(s: Column) -> list[Column]:
    return [s[f"s{k}"] for k in range(STATES)]


def _step(states: Column, turn: Column) -> Column:
    """The four states after a turn: it is kept, given another role or deleted, after insertions."""

    def edited(x: Column) -> Column:
        s = _parts(x)
        extra = turn["extra"]
        to_user = F.least(_more(s[0], REROLE + extra, "R"), _more(s[1], REROLE + extra, "R"), _more(s[3], REROLE + extra, "R"))
        kept_user = F.least(_more(s[0], extra, "K"), _more(s[1], extra, "K"), _more(s[3], extra, "K"))
        gone = [_more(y, DELETE, "D") for y in s]
        able, initial = turn["able"], turn["initial"]
        return _states([
            gone[0],
            F.when(able & (initial == "s"), F.least(gone[1], _more(s[0], extra, "K"))).otherwise(gone[1]),
            F.when(~able, gone[2]).when(initial == "u", F.least(gone[2], kept_user)).otherwise(F.least(gone[2], to_user)),
            F.when(~able, gone[3]).when(initial == "a", F.least(gone[3], _more(s[2], extra, "K"))).otherwise(F.least(gone[3], _more(s[2], REROLE + extra, "R"))),
        ])

    return _let(_states(_inserted(_parts(states))), edited)


def _start(at: int) -> Column:
    entry = lambda cost: _entry(F.lit(cost).cast("long"), F.lit(""))
    return _states([entry(0 if k == at else NEVER) for k in range(STATES)])


def _joined(states: Column, piece: Column) -> Column:
    """The four states after a piece, whose own states are known for each state that it may begin in."""
    s = _parts(states)
    through = lambda end: F.least(*(_entry(s[k]["cost"] + piece[f"from{k}"][f"s{end}"]["cost"], F.concat(s[k]["audit"], piece[f"from{k}"][f"s{end}"]["audit"])) for k in range(STATES)))
    return _states([through(end) for end in range(STATES)])


def audits(flags: DataFrame, piece: int = PIECE) -> DataFrame:
    """``conv_id``, ``cost`` and ``audit`` of the cheapest edits of flagged turns that leave roles ``(s?(ua)+)?``: a letter for each edit in order (Keep, Rerole to user or assistant,
    Delete, Insert an empty user or assistant turn); of equal costs the ASCII-least audit.

    Keep costs 0, Rerole 2, Delete 3, Insert 2, and a truncated turn that isn't deleted 1; blank and duplicate turns must be deleted.
    """
    able = ~F.col("fault").isin("blank", "duplicate")
    turn = F.struct("pos", "initial", F.coalesce(able, F.lit(True)).alias("able"), F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).alias("extra"))
    lists = flags.select("conv_id", F.floor(F.col("pos") / piece).alias("part"), turn.alias("turn")).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    # only a conversation's first piece has one state to begin in
    folds = [F.when((F.col("part") == 0) & F.lit(k > 0), _start(k)).otherwise(F.aggregate("turns", _start(k), _step)).alias(f"from{k}") for k in range(STATES)]
    pieces = lists.select("conv_id", F.struct("part", *folds).alias("piece")).groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))

    def ended(s: Column) -> Column:
        return _let(_states(_inserted(_parts(s))), lambda x: F.least(x["s0"], x["s3"]))

    return pieces.select("conv_id", F.aggregate("pieces", _start(0), _joined, ended).alias("_best")).select("conv_id", "_best.cost", "_best.audit")


def repaired(flags: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns that ``edits`` (``conv_id``, ``audit``) leave: ``conv_id``, ``place`` (from 0), ``role``, ``text``, and the ``edit`` letter."""
    letters = edits.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    so_far = "over (partition by conv_id order by at rows between unbounded preceding and current row)"
    placed = letters.withColumn("pos", F.expr(f"case when edit <> 'I' then count_if(edit <> 'I') {so_far} - 1 end")).withColumn("place", F.expr(f"count_if(edit <> 'D') {so_far} - 1")).where("edit <> 'D'")
    turns = flags.select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos"), "role", "initial", "text")
    both = placed.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left")
    # roles alternate after a system turn, if there is one
    lead = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K") & (F.col("initial") == "s"), 1).otherwise(0)).over(W.partitionBy("conv_id"))
    given = F.when((F.col("place") - F.col("_lead")) % 2 == 0, "user").otherwise("assistant")
    kept = both.withColumn("_lead", lead)
    return kept.select("conv_id", "place", F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def faults(flags: DataFrame) -> DataFrame:
    """By ``conv_id`` the turns of each fault, adjacent roles that may not follow each other, and ``gaps`` in the turn numbers."""
    count = lambda kind: F.count_if(F.coalesce(F.col("fault") == kind, F.lit(False))).alias(kind)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    return flags.groupBy("conv_id").agg(gaps.alias("gaps"), count("blank"), count("duplicate"), count("truncated"), F.count_if("illegal").alias("illegal"))


def repair(turns: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored) a row for each conversation (``faults`` with ``cost`` and ``audit``),
    and the repaired turns (``repaired``).

    A null conv_id is a conversation of its own; null roles and texts count as one space, so such texts are blank and such roles must be changed. Rows that repeat are
    duplicates. Equal turn numbers are in order of role and text. Empty tables give no rows; a conversation of which nothing is left has an empty audit.
    """
    flags = Table(flagged(turns), "turns").df
    edits = Table(audits(flags, piece), "audits").df
    named = edits.select(F.col("conv_id").alias("_conv"), "cost", "audit")
    whole = faults(flags).join(named, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return whole, repaired(flags, edits)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    whole, turns = repair(damaged(rows))
    line = F.struct("place", F.concat_ws(":", "role", "text").alias("line"))
    texts = turns.groupBy(F.col("conv_id").alias("_told")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("told"))
    every = rows.select(F.col("conv_id").alias("_every")).distinct()
    found = every.join(whole, F.col("_every").eqNullSafe(F.col("conv_id")), "left").join(texts, F.col("_every").eqNullSafe(F.col("_told")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    numbers = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("_every").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("told", F.lit("")), 256).alias("repaired_sha256"))
