"""Diversity metrics of clone sizes per group, in one pass over a size table.

Rows are first aggregated to one row per (group, clone); every metric then
comes from that table. Metrics that need an order (D50, Gini, top shares) are
computed over the *histogram of sizes* - one row per (group, size), of which
there are few even where a group has billions of clones - so no window ever
holds the clones of a group.

Rows without a clone form one pseudo clone, or are dropped (``null_clone``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clone_sizes(df: DataFrame, group: list[str], clone: str = "clone_id", null_clone: str = "bucket") -> DataFrame:
    """``group..., clone, size``; null clones as clone -1 (``bucket``) or left out (``drop``)."""
    if null_clone not in ("bucket", "drop"):
        raise ValueError("null_clone is 'bucket' or 'drop'")
    rows = df if null_clone == "bucket" else df.where(F.col(clone).isNotNull())
    return rows.groupBy(*group, F.coalesce(F.col(clone), F.lit(-1)).alias("clone")).agg(F.count(F.lit(1)).alias("size"))


def size_histogram(sizes: DataFrame, group: list[str]) -> DataFrame:
    """``group..., size, clones`` with what lies before each size, from the largest down and from the smallest up."""
    h = sizes.groupBy(*group, "size").agg(F.count(F.lit(1)).alias("clones"))
    down = Window.partitionBy(*group).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(*group).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return h.select(
        *group,
        "size",
        "clones",
        F.coalesce(F.sum(F.col("size") * F.col("clones")).over(down), F.lit(0)).alias("rows_above"),
        F.coalesce(F.sum("clones").over(down), F.lit(0)).alias("clones_above"),
        F.coalesce(F.sum("clones").over(up), F.lit(0)).alias("clones_below"),
        F.sum(F.col("size") * F.col("clones")).over(whole).alias("total"),
        F.sum("clones").over(whole).alias("richness"),
    )


def diversity(df: DataFrame, group: list[str], clone: str = "clone_id", null_clone: str = "bucket") -> DataFrame:
    """Size metrics per group.

    total, clones, mean_clone_size, shannon (natural log), simpson (1 - sum p^2),
    d50 (largest clones that reach half of all rows), chao1 (classic form; the
    bias-corrected one where no clone has two rows), gini, expanded (share of rows
    in clones of two or more), top1 and top10 (share of the largest clones).
    """
    h = size_histogram(clone_sizes(df, group, clone, null_clone), group)
    p = F.col("size") / F.col("total")
    n, m = F.col("size"), F.col("clones")
    half = F.col("total") / 2
    # of a run of equally large clones, those that start below half
    d50 = F.greatest(F.lit(0), F.least(m, F.ceil((half - F.col("rows_above")) / n)))
    top = lambda k: F.greatest(F.lit(0), F.least(m, F.lit(k) - F.col("clones_above"))) * n
    # sum of ranks (ascending) of a run of equal sizes
    ranks = m * F.col("clones_below") + m * (m + 1) / 2
    a = h.groupBy(*group).agg(
        F.max("total").alias("total"),
        F.max("richness").alias("clones"),
        (-F.sum(m * p * F.log(p))).alias("shannon"),
        (1 - F.sum(m * p * p)).alias("simpson"),
        F.sum(d50).cast("long").alias("d50"),
        F.coalesce(F.sum(F.when(n == 1, m)), F.lit(0)).alias("f1"),
        F.coalesce(F.sum(F.when(n == 2, m)), F.lit(0)).alias("f2"),
        F.sum(ranks * n).alias("rank_mass"),
        F.coalesce(F.sum(F.when(n >= 2, m * n)), F.lit(0)).alias("in_expanded"),
        F.sum(top(1)).alias("in_top1"),
        F.sum(top(10)).alias("in_top10"),
    )
    s, t = F.col("clones"), F.col("total")
    chao1 = F.when(F.col("f2") == 0, s + F.col("f1") * (F.col("f1") - 1) / 2).otherwise(s + F.col("f1") * F.col("f1") / (2 * F.col("f2")))
    gini = F.when(s > 1, 2 * F.col("rank_mass") / (s * t) - (s + 1) / s).otherwise(0.0)
    return a.select(
        *group,
        "total",
        "clones",
        (t / s).alias("mean_clone_size"),
        (F.col("shannon") + 0.0).alias("shannon"),
        "simpson",
        "d50",
        chao1.cast("double").alias("chao1"),
        gini.alias("gini"),
        (F.col("in_expanded") / t).alias("expanded"),
        (F.col("in_top1") / t).alias("top1"),
        (F.col("in_top10") / t).alias("top10"),
    )


def mutation_stats(df: DataFrame, group: list[str], shm: str = "shm", productive: str = "productive") -> DataFrame:
    """mean_shm and median_shm (nulls left out, 0 if none), productive_percent (null counts as productive)."""
    return df.groupBy(*group).agg(
        F.coalesce(F.avg(shm), F.lit(0.0)).alias("mean_shm"),
        F.coalesce(F.percentile(F.col(shm).cast("double"), 0.5), F.lit(0.0)).alias("median_shm"),
        (F.avg(F.coalesce(F.col(productive), F.lit(True)).cast("int")) * 100).alias("productive_percent"),
    )


def bundle(df: DataFrame, group: list[str], clone: str = "clone_id", null_clone: str = "bucket") -> DataFrame:
    """All fourteen metrics per group."""
    return diversity(df, group, clone, null_clone).join(mutation_stats(df, group), group)


def rank_abundance(df: DataFrame, group: list[str], clone: str = "clone_id", top: int | None = None) -> DataFrame:
    """``group..., clone, size, rank``: clones by size, ties by clone; ``top`` keeps the first ones."""
    s = clone_sizes(df, group, clone)
    out = s.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("size"), "clone")))
    return out.where(F.col("rank") <= top) if top else out


def with_clone_size(df: DataFrame, clone: str = "clone_id", keys: list[str] | None = None, name: str = "clone_size") -> DataFrame:
    """Every row with the size of its clone; 0 for rows without one. A join, so a huge clone is not one task's window."""
    ks = [*(keys or []), clone]
    s = df.where(F.col(clone).isNotNull()).groupBy(*ks).agg(F.count(F.lit(1)).alias(name))
    return df.join(s, ks, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def pooled(metrics: DataFrame, group: list[str]) -> DataFrame:
    """Metrics of samples pooled per group: counts and chao1 summed, ratios averaged, d50 rounded."""
    return metrics.groupBy(*group).agg(
        F.sum("total").alias("total"),
        F.sum("clones").alias("clones"),
        F.sum("chao1").alias("chao1"),
        F.avg("shannon").alias("shannon"),
        F.avg("simpson").alias("simpson"),
        F.avg("gini").alias("gini"),
        F.floor(F.avg("d50") + 0.5).cast("long").alias("d50"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """One row: rows and clones summed, shannon and mean_shm averaged."""
    return metrics.agg(
        F.sum("total").alias("total"), F.sum("clones").alias("clones"), F.coalesce(F.avg("shannon"), F.lit(0.0)).alias("shannon"), F.coalesce(F.avg("mean_shm"), F.lit(0.0)).alias("mean_shm")
    )
