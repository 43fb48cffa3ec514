"""Matching clones against an antibody reference by equal length and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vdjlake.functions import sequence as X

#: fixed values: identity from which a match is high, and the shortest texts compared (longer than these)
HIGH, VH_LONGER, CDR3_LONGER = 90.0, 10, 3


def length_matches(queries: DataFrame, reference: DataFrame, key: str, text: str, ref_key: str, ref_text: str, longer_than: int, top: int = 20, least: float = 0.0) -> DataFrame:
    """``key, ref_key, identity, rank``: the ``top`` equally long reference texts of each query by identity, ties by name.

    Distinct texts are joined on their length and compared once; the best ones
    per text are kept before the records are attached. Texts of at most
    ``longer_than`` letters are left out on both sides.
    """
    q = queries.where((F.length(text) > longer_than) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    r = reference.where((F.length(ref_text) > longer_than) & F.col(ref_key).isNotNull()).select(F.col(ref_key).alias("rk"), F.col(ref_text).alias("rt")).distinct()
    pairs = q.select("t").distinct().withColumn("n", F.length("t")).join(r.withColumn("n", F.length("rt")), "n").select("t", "rk", X.identity_percent("t", "rt").alias("identity")).where(F.col("identity") >= least)
    best = pairs.groupBy("t", "rk").agg(F.max("identity").alias("identity"))
    w = Window.partitionBy("t").orderBy(F.desc("identity"), "rk")
    kept = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return q.join(kept, "t").select(F.col("k").alias(key), F.col("rk").alias(ref_key), "identity", "rank")


def top_clones(df: DataFrame, n: int, keys: list[str], row_id: str = "sequence_id", chosen: DataFrame | None = None) -> DataFrame:
    """``keys..., size, representative``: the ``n`` largest clones (ties by key), or those ``chosen``; smallest row id stands for a clone."""
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    if chosen is not None:
        rows = rows.join(chosen, keys, "left_semi")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min(row_id).alias("representative"))
    return sizes if chosen is not None else sizes.orderBy(F.desc("size"), *keys).limit(n)


def match_stats(clones: DataFrame, vh: DataFrame, cdr3: DataFrame, key: str, high: float = HIGH) -> DataFrame:
    """One row: clones analysed, with a VH match, with a CDR3 match, with a match of at least ``high``."""
    best = lambda m, n: m.groupBy(key).agg(F.max("identity").alias(n))
    j = clones.select(key).join(best(vh, "vh"), key, "left").join(best(cdr3, "cdr3"), key, "left")
    return j.agg(
        F.count(F.lit(1)).alias("analysed"),
        F.count("vh").alias("with_vh"),
        F.count("cdr3").alias("with_cdr3"),
        F.count(F.when(F.greatest("vh", "cdr3") >= high, 1)).alias("high"),
    )


def stats_by_timepoint(best: DataFrame, scope: list[str], timepoint: str = "timepoint", identity: str = "identity", high: float = HIGH) -> DataFrame:
    """Matches per scope and timepoint, with an ``All`` row per scope: n, high, percent_high."""
    full = best.rollup(*scope, timepoint) if not scope else best.groupingSets([[F.col(s) for s in scope], [F.col(s) for s in [*scope, timepoint]]], *scope, timepoint)
    out = full.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(identity) >= high, 1)).alias("high"), F.grouping(timepoint).alias("__all"))
    return out.select(*scope, F.when(F.col("__all") == 1, "All").otherwise(F.col(timepoint)).alias(timepoint), "n", "high", (F.col("high") / F.col("n") * 100).alias("percent_high"))


def identity_bands(matches: DataFrame, identity: str = "identity") -> DataFrame:
    """``band, n``: matches at 95 or more, 90-94, 80-89 and below 80 percent."""
    x = F.col(identity)
    band = F.when(x >= 95, ">=95").when(x >= 90, "90-94").when(x >= 80, "80-89").otherwise("<80")
    return matches.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def filter_by_timepoint(matches: DataFrame, rows: DataFrame, keys: list[str], timepoint: str, value: str) -> DataFrame:
    """Matches of clones that any row places at a timepoint."""
    return matches.join(rows.where(F.col(timepoint) == value).select(*keys).distinct(), keys, "left_semi")
