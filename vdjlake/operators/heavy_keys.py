"""Distinct counts per key where a handful of keys hold most rows.

Two-stage salted aggregation. A first pass counts rows per key (combined before
the shuffle, so a heavy key sends one partial row per task). Keys that would
fill more than a fair share of a task get as many salts as their rows need; the
salt is a hash of the counted item, so equal items meet under one salt and the
partial distinct counts of the salts add up exactly. Stage one counts per
(key, salt), stage two adds the partials per key.

Only the heavy keys are broadcast. Their number is bounded: each holds more
than ``rows / (tasks * HEAVY_PER_TASK)`` rows, so there are fewer than
``tasks * HEAVY_PER_TASK`` of them, whatever the data.

Defined cases: rows whose item or any key column is null are not counted; an
empty table gives an empty result; repeated rows count once; ties have no
influence; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjlake.session import shuffle_partitions

#: A key is heavy when it has more rows than this part of an average task.
HEAVY_PER_TASK = 4


def salted_distinct(df: DataFrame, keys: list[str], item: str, tasks: int | None = None) -> DataFrame:
    """``keys..., items``: the number of distinct ``item`` per key, in even time.

    Items of one key that is heavy are spread over salts; all other keys stay
    in one piece under salt 0.
    """
    spark = df.sparkSession
    tasks = tasks or shuffle_partitions(spark)
    ks = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)], F.col(item).alias("__item"))
    rows = rows.where(" and ".join(f"{n} is not null" for n in [*ks, "__item"]))

    counts = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n"))
    share = counts.agg(F.sum("__n")).scalar() / F.lit(tasks * HEAVY_PER_TASK)
    heavy = counts.where(F.col("__n") > F.greatest(share, F.lit(1))).select(
        *[F.col(n).alias(f"{n}_h") for n in ks], F.ceil(F.col("__n") / share).cast("int").alias("__salts")
    )
    salted = rows.join(F.broadcast(heavy), [F.col(n) == F.col(f"{n}_h") for n in ks], "left").select(
        *ks,
        F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64("__item"), F.col("__salts"))).otherwise(F.lit(0)).cast("int").alias("__salt"),
        "__item",
    )
    # equal items of a key share a salt, so both aggregates run on this one exchange
    spread = salted.repartition(tasks, *ks, "__salt")
    partial = spread.dropDuplicates([*ks, "__salt", "__item"]).groupBy(*ks, "__salt").agg(F.count(F.lit(1)).alias("__items"))
    return partial.groupBy(*ks).agg(F.sum("__items").alias("items")).select(*[F.col(n).alias(k) for k, n in zip(keys, ks)], "items")


def salted_profile(df: DataFrame, keys: list[str], item: str, measure: str, tasks: int | None = None) -> DataFrame:
    """``keys..., items, total, least, greatest``: per key over distinct items, two-stage salted.

    ``measure`` must agree within an item; the smallest one of an item counts.
    Null measures are left out of ``total``, ``least`` and ``greatest``.
    """
    spark = df.sparkSession
    tasks = tasks or shuffle_partitions(spark)
    ks = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)], F.col(item).alias("__item"), F.col(measure).cast("double").alias("__x"))
    rows = rows.where(" and ".join(f"{n} is not null" for n in [*ks, "__item"]))
    # the item itself is the salt: one partial row per (key, item), combined before the shuffle
    items = rows.groupBy(*ks, "__item").agg(F.min("__x").alias("__x"))
    salted = items.groupBy(*ks, F.pmod(F.xxhash64("__item"), F.lit(tasks)).alias("__salt")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__x").alias("__s"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")
    )
    return salted.groupBy(*ks).agg(
        F.sum("__n").alias("items"), F.sum("__s").alias("total"), F.min("__lo").alias("least"), F.max("__hi").alias("greatest")
    ).select(*[F.col(n).alias(k) for k, n in zip(keys, ks)], "items", "total", "least", "greatest")


def dominant_keys(df: DataFrame, keys: list[str], item: str, share: float = 0.01, all_items: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``keys..., items, share``: the keys that hold at least ``share`` of all distinct items.

    The distinct items of all keys together are the sum over the keys when an
    item belongs to one key only; pass ``all_items`` (a one-column table) where
    items repeat across keys.
    """
    per = salted_distinct(df, keys, item, tasks)
    if all_items is None:
        total = per.agg(F.sum("items"))
    else:
        total = all_items.select(F.col(all_items.columns[0]).alias("__i")).where("__i is not null").distinct().agg(F.count(F.lit(1)))
    out = per.withColumn("share", F.col("items") / total.scalar())
    return out.where(F.col("share") >= F.lit(share)).select(*keys, "items", "share")
