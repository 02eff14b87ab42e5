"""Votes, first-wins rules and set operations on flagged spans.

"First" always means the smallest of an explicit order column: a shuffle keeps no other order.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(value, order, where: Column | None = None) -> Column:
    """The value of the smallest order among rows where it is not null (and ``where`` holds)."""
    value = F.col(value) if isinstance(value, str) else value
    order = F.col(order) if isinstance(order, str) else order
    known = value.isNotNull() if where is None else value.isNotNull() & where
    return F.min(F.when(known, F.struct(order.alias("o"), value.alias("v"))))["v"]


def largest_by(value, key, order) -> Column:
    """The value of the largest key (a column or its name), of equals the one of the smallest order (a numeric column)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.max(F.struct(key.alias("k"), (-F.col(order)).alias("o"), F.col(value).alias("v")))["v"]


def all_votes(value: str) -> Column:
    """True if all known votes are, false if any known is false, null if none is known."""
    return F.bool_and(value)


def any_vote(value: str) -> Column:
    return F.bool_or(value)


def segment_outcome(value: str) -> Column:
    """True if any is true, false if all are false (or there are none), else null."""
    return F.when(F.count_if(F.col(value)) > 0, True).when(F.count_if(F.col(value).isNull()) == 0, False)


def verdict_of(value: str) -> Column:
    """fail if any fails, else error if any is an error, else pass."""
    return F.when(F.bool_or(F.col(value) == "fail"), "fail").when(F.bool_or(F.col(value) == "error"), "error").otherwise("pass")


def combined_gold(gold: str, detail: str, order: str) -> list[Column]:
    """First known ``gold`` and its detail, and whether known votes or details disagree."""
    known = F.col(gold).isNotNull()
    both = F.min(F.when(known, F.struct(F.col(order).alias("o"), F.col(gold).alias("g"), F.col(detail).alias("d"))))
    apart = (F.count_distinct(gold) > 1) | (F.count_distinct(detail) > 1)
    return [both["g"].alias(gold), both["d"].alias(detail), apart.alias("disagreement")]


def first_file_wins(df: DataFrame, keys: list[str], file: str) -> DataFrame:
    """The rows of the smallest file that has their key; several rows of that file stay."""
    owner = df.groupBy(*keys).agg(F.min(file).alias("_owner"))
    return df.join(owner, keys).where(F.col(file) == F.col("_owner")).drop("_owner")


def support(df: DataFrame, keys: list[str], file: str, order: str, matches=None) -> DataFrame:
    """For each flag and other file, the first flag there with the same keys that ``matches`` (all do by default).

    Columns: keys, ``file``, ``order``, ``other``, ``other_order``. ``matches`` takes two functions from a column's
    name to the Column of either side. Keys are a segment and a system: a handful of flags.
    """
    names = [c for c in df.columns if c not in keys]
    a = df.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in names))
    b = df.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in names))
    pairs = a.join(b, keys).where(F.col(f"_a_{file}") != F.col(f"_b_{file}"))
    if matches is not None:
        pairs = pairs.where(matches(lambda c: F.col(f"_a_{c}"), lambda c: F.col(f"_b_{c}")))
    best = pairs.groupBy(*keys, F.col(f"_a_{file}").alias(file), F.col(f"_a_{order}").alias(order), F.col(f"_b_{file}").alias("other"))
    return best.agg(F.min(f"_b_{order}").alias("other_order"))


def in_at_least(df: DataFrame, keys: list[str], file: str, n: int) -> DataFrame:
    """``df``'s keys that ``n`` files have at least, with ``n_agree`` and the sorted ``agreed_by``.

    Files are counted by key and file first, so a hot key is reduced before it is shuffled whole.
    """
    each = df.select(*keys, file).distinct()
    found = each.groupBy(*keys).agg(F.count("*").alias("n_agree"), F.sort_array(F.collect_list(file)).alias("agreed_by"))
    return found.where(F.col("n_agree") >= n)


def with_missing(df: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` and, for each of ``shown``'s keys that it lacks, a row with null elsewhere."""
    return df.unionByName(shown.join(df.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def greedy_distinct(df: DataFrame, keys: list[str], order: list[str], matches) -> DataFrame:
    """Rows of a key in order, without those that match an already kept one: ``matches`` takes two struct Columns.

    Whether a row is kept depends on which were kept before, so it is a fold over a key's sorted rows. Keys are a
    segment and a system: a handful of flags.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("_rows"))
    none = F.slice("_rows", 1, 0)
    kept = F.aggregate("_rows", none, lambda done, row: F.when(F.exists(done, lambda k: matches(row, k)), done).otherwise(F.array_append(done, row)))
    return lists.select(*keys, F.explode(kept).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in [*order, *rest]))


def upserted(entries: Column, name: str, value: Column, overwrite: bool = True) -> Column:
    """A map with an entry added; an existing one is replaced, or kept if not ``overwrite``."""
    mine = F.create_map(F.lit(name), value)
    if overwrite:
        return F.map_concat(F.map_filter(entries, lambda k, _: k != name), mine)
    return F.when(F.map_contains_key(entries, name), entries).otherwise(F.map_concat(entries, mine))


def merged_on_grid(left: DataFrame, right: DataFrame, keys: list[str], entries: str) -> DataFrame:
    """Two sets of arrays on one grid of keys: the arrays of both, the left one's first, and where they come from."""
    l = left.select(*keys, F.col(entries).alias("_l"))
    r = right.select(*keys, F.col(entries).alias("_r"))
    none = F.array().cast(left.schema[entries].dataType)
    both = l.join(r, keys, "full_outer")
    origin = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return both.select(*keys, F.concat(F.coalesce("_l", none), F.coalesce("_r", none)).alias(entries), origin.alias("origin"))


def violations(df: DataFrame, invariants: list[str]) -> DataFrame:
    """The rows that break an invariant (SQL conditions; null breaks it too), with ``broken``: the conditions, in order."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(i), F.lit(False)), i) for i in invariants)))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)
