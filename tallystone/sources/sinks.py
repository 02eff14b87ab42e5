"""Sinks. Spark's commit protocol writes aside and renames, so a failed job leaves nothing half-written."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_by(df: DataFrame, keys: list[str], path: str) -> None:
    """JSON lines in a folder for each value of the keys; rows of a key are brought together to write few files."""
    df.repartition(*keys).write.partitionBy(*keys).option("ignoreNullFields", "false").json(path)


def flat_rows(df: DataFrame, targets: str, columns: list[str], ident: list[str]) -> DataFrame:
    """A row for each target, lists joined by commas: what a CSV summary holds."""
    each = df.select(*ident, F.explode(targets).alias("_t"))
    kinds = dict(each.select("_t.*").dtypes)
    show = lambda c: F.array_join(F.col(f"_t.{c}").cast("array<string>"), ",") if kinds[c].startswith("array") else F.col(f"_t.{c}")
    return each.select(*ident, *(show(c).alias(c) for c in columns))


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", "true").option("sep", sep).csv(path)


def campaign_pages(items: DataFrame, task: str, page: str, order: str, item: Column) -> DataFrame:
    """``task``, ``page``, ``items``: a row for each page, for campaigns of any size; a page holds what an annotator sees at once."""
    rows = items.groupBy(F.col(task).alias("task"), F.col(page).alias("page")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))).alias("x"))
    return rows.select("task", "page", F.transform("x", lambda x: x["i"]).alias("items"))


def campaign(items: DataFrame, task: str, page: str, order: str, item: Column, info: dict, campaign_id: str) -> DataFrame:
    """One JSON ``value``: {info, campaign_id, data: tasks of pages of items}. A campaign in one object is for human annotators: thousands of items; see ``campaign_pages`` for more."""
    pages = items.select(task, page, F.struct(F.col(order).alias("o"), item.alias("i")).alias("x")).groupBy(task, page).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["i"]).alias("items"))
    tasks = pages.groupBy(task).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), "items"))), lambda x: x["items"]).alias("pages"))
    whole = tasks.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(task).alias("t"), "pages"))), lambda x: x["pages"]).alias("data"))
    return whole.select(F.to_json(F.struct(F.struct(*(F.lit(v).alias(k) for k, v in info.items())).alias("info"), F.lit(campaign_id).alias("campaign_id"), "data")).alias("value"))


def append_with_ledger(records: DataFrame, keys: list[str], path: str, ledger: str) -> None:
    """Appends records, then their keys to a ledger: a crash between the two repeats records, it loses none."""
    records.write.mode("append").parquet(path)
    records.select(*keys).distinct().write.mode("append").parquet(ledger)


def changed(wanted: DataFrame, manifest: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The rows of ``wanted`` that the manifest doesn't have, or has with other values: what must be written anew."""
    old = manifest.select(*keys, *(F.col(v).alias(f"_old_{v}") for v in values), F.lit(True).alias("_known"))
    same = F.col("_known").isNotNull()
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_old_{v}"))
    return wanted.join(old, keys, "left").where(~same).select(*wanted.columns)
