"""Gene-family and isotype usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vdjlake.functions import sequence as X


def family_usage(df: DataFrame, group: list[str], gene: str = "v") -> DataFrame:
    """``group..., family, n, frequency``: share among the rows that have a family."""
    f = df.select(*group, X.v_family(gene).alias("family")).where("family is not null")
    n = f.groupBy(*group, "family").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def top_families(usage: DataFrame, limit: int = 10) -> DataFrame:
    """``family, frequency``: families by their frequencies summed over groups, ties by name."""
    return usage.groupBy("family").agg(F.sum("frequency").alias("frequency")).orderBy(F.desc("frequency"), "family").limit(limit)


def isotype_usage(df: DataFrame, group: list[str], c_call: str = "c_call", v: str = "v") -> DataFrame:
    """``group..., class, n, frequency`` of heavy rows, with a row for each of the five classes."""
    heavy = df.select(*group, X.ig_class(c_call).alias("class"), X.chain(v).alias("chain")).where("chain = 'Heavy' and class is not null")
    n = heavy.groupBy(*group, "class").agg(F.count(F.lit(1)).alias("n"))
    grid = n.select(*group).distinct().select(*group, F.explode(F.array(*[F.lit(c) for c, _ in X.IG_CLASSES])).alias("class"))
    full = grid.join(n, [*group, "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def isotype_counts(df: DataFrame, c_call: str = "c_call") -> DataFrame:
    """``c_gene, n``: rows per constant-region gene without allele."""
    return df.where(F.col(c_call).isNotNull()).groupBy(X.strip_allele(c_call).alias("c_gene")).agg(F.count(F.lit(1)).alias("n"))


def isotype_tiles(df: DataFrame, track: list[str], timepoint: str = "timepoint", c_call: str = "c_call", shm: str = "shm", patient: str = "patient") -> DataFrame:
    """``track..., timepoint, n, dominant, mean_shm, patients``: dominant class by count, ties in the order of the classes."""
    order = F.create_map(*[F.lit(x) for i, (c, _) in enumerate(X.IG_CLASSES) for x in (c, i)])
    rows = df.withColumn("class", X.ig_class(c_call))
    by = rows.where("class is not null").groupBy(*track, timepoint, "class").agg(F.count(F.lit(1)).alias("k"))
    top = by.groupBy(*track, timepoint).agg(F.max_by("class", F.struct(F.col("k"), -F.element_at(order, F.col("class")))).alias("dominant"), F.max("k").alias("dominant_n"))
    all_ = rows.groupBy(*track, timepoint).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(shm), F.lit(0.0)).alias("mean_shm"), F.countDistinct(patient).alias("patients"))
    return all_.join(top, [*track, timepoint], "left")


def label_scores(items: DataFrame, label: str, item: str, confidence: str, per: float = 20.0, cap: float = 100.0, top: int = 8) -> DataFrame:
    """``label, score, items, best``: capped sum of confidence, distinct items and the surest item; the ``top`` labels."""
    a = items.groupBy(label).agg(
        F.least(F.lit(cap), F.sum(F.col(confidence) * F.lit(per))).alias("score"), F.countDistinct(item).alias("items"), F.max_by(item, F.struct(confidence, item)).alias("best")
    )
    return a.orderBy(F.desc("score"), label).limit(top)
