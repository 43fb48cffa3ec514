"""Rank-sum tests, false-discovery control and descriptive statistics."""

from __future__ import annotations

import functools
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the rational approximation of the error function (formula 7.1.26 in Abramowitz and Stegun)
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911)

#: Pooled sizes up to which the p-value is exact.
EXACT_UPTO = 20


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by the polynomial above, clamped beyond +-8."""
    a1, a2, a3, a4, a5, p = ERF
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * x)
    e = 1 - (((((a5 * t + a4) * t) + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.when(z < -8, 0.0).when(z > 8, 1.0).otherwise(F.when(z >= 0, 0.5 * (1 + e)).otherwise(0.5 * (1 - e)))


@functools.lru_cache(maxsize=4096)
def u_counts(n1: int, n2: int) -> tuple[int, ...]:
    """Number of arrangements with each value of U, for samples without ties."""
    if n1 == 0 or n2 == 0:
        return (1,)
    out = np.zeros(n1 * n2 + 1, dtype=object)
    with_first = u_counts(n1 - 1, n2)  # the largest value belongs to sample 1: it beats all n2
    for u, c in enumerate(with_first):
        out[u + n2] += c
    for u, c in enumerate(u_counts(n1, n2 - 1)):
        out[u] += c
    return tuple(out)


def exact_p(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p-value of the smaller U; halves (ties) count the values up to the half."""
    c = u_counts(n1, n2)
    return float(min(1.0, 2 * sum(c[: int(np.floor(u)) + 1]) / comb(n1 + n2, n1)))


@F.pandas_udf(T.DoubleType())
def _exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([exact_p(a, int(b), int(c)) if b <= EXACT_UPTO and c <= EXACT_UPTO and b > 0 and c > 0 and b + c <= EXACT_UPTO else None for a, b, c in zip(u, n1, n2)], dtype="float64")


def midranks(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Rows with their average rank within ``by``, from the counts per distinct value."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    r = c.select(*by, value, (F.coalesce(F.sum("__c").over(w), F.lit(0)) + (F.col("__c") + 1) / 2).alias(name))
    return df.join(r, [*by, value])


def rank_sum(df: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """Two-sided rank-sum test of ``value`` between ``side`` = 1 and 2, per ``by``.

    n1, n2, valid (three or more on either side), u (smaller U), r_abs and signed
    r (effect size), p: exact for pooled sizes up to 20, else normal with
    continuity correction and no tie correction. Null values are left out;
    invalid tests have null u, r and p.
    """
    rows = midranks(df.where(F.col(side).isin(1, 2)).select(*by, side, value), by, value)
    a = rows.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col(side) == 1, F.col("rank"))), F.lit(0.0)).alias("r1"),
        F.count(F.when(F.col(side) == 1, 1)).alias("n1"),
        F.count(F.when(F.col(side) == 2, 1)).alias("n2"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    a = a.withColumn("valid", (n1 >= 3) & (n2 >= 3)).withColumn("u1", u1).withColumn("u", F.least(u1, n1 * n2 - u1))
    mean, sd = n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    z = (F.abs(F.col("u") - mean) - 0.5) / sd
    normal = F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.greatest(z, F.lit(0.0)))))
    exact = _exact(F.col("u"), n1, n2)
    p = F.when(n1 + n2 <= EXACT_UPTO, exact).otherwise(normal)
    keep = lambda c: F.when(F.col("valid"), c)
    return a.select(*by, "n1", "n2", "valid", keep(F.col("u")).alias("u"), keep(1 - 2 * F.col("u") / (n1 * n2)).alias("r_abs"), keep(2 * F.col("u1") / (n1 * n2) - 1).alias("r"), keep(p).alias("p"))


def fdr(tests: DataFrame, pool: list[str] | None = None, p: str = "p", name: str = "q") -> DataFrame:
    """Step-up adjusted p-values within a pool; rows without p keep null. Equal p-values share the largest rank's value.

    A pool is one family of tests - metrics x timepoints x pairs - not data rows.
    """
    pool = pool or []
    has = F.col(p).isNotNull()
    all_ = Window.partitionBy(*pool, has)
    rank = F.row_number().over(Window.partitionBy(*pool, has).orderBy(p))
    raw = F.col(p) * F.count(F.lit(1)).over(all_) / rank
    t = tests.withColumn("__raw", F.when(has, raw))
    w = Window.partitionBy(*pool, has).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("__q", F.when(has, F.least(F.lit(1.0), F.min("__raw").over(w))))
    same = Window.partitionBy(*pool, p)
    return t.withColumn(name, F.when(has, F.min("__q").over(same))).drop("__raw", "__q")


def mean_sem(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and standard error (sample variance; 0 for one value)."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(F.lit(1))), F.lit(0.0)).alias("sem")
    )


def box(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles (linear interpolation), whiskers clamped to 1.5 and a robust range clamped to 2 interquartile ranges."""
    a = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.percentile(F.col(value).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    iqr = q3 - q1
    return a.select(
        *by, "n", q1.alias("q1"), q2.alias("median"), q3.alias("q3"),
        F.greatest("lo", q1 - 1.5 * iqr).alias("low_whisker"), F.least("hi", q3 + 1.5 * iqr).alias("high_whisker"),
        F.greatest("lo", q1 - 2 * iqr).alias("range_low"), F.least("hi", q3 + 2 * iqr).alias("range_high"),
    )


def long_metrics(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``keys..., metric, value``: one row per metric."""
    return metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*keys, "m.metric", "m.value")


def compare_groups(long: DataFrame, cohort: str, strata: list[str]) -> DataFrame:
    """Rank-sum test of every pair of cohorts per stratum: ``strata..., cohort_1, cohort_2, ...``.

    Each sample row takes part once per other cohort, of which a study has a few;
    rows are never joined to each other.
    """
    names = long.agg(F.array_sort(F.collect_set(cohort))).scalar()
    other = long.where(F.col(cohort).isNotNull()).select(*strata, cohort, "value", F.explode(F.array_remove(names, F.col(cohort))).alias("__o"))
    rows = other.select(*strata, "value", F.least(cohort, "__o").alias("cohort_1"), F.greatest(cohort, "__o").alias("cohort_2"), F.when(F.col(cohort) < F.col("__o"), 1).otherwise(2).alias("side"))
    return rank_sum(rows, [*strata, "cohort_1", "cohort_2"], "side", "value")
