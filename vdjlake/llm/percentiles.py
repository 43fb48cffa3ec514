"""Percentiles with bounded rank error from mergeable compactor hierarchies.

The sketch is the KLL hierarchy of randomized compactors: a level that is full
is sorted and every other value, from a random start, moves up with twice the
weight; two sketches merge level by level. Spark's built-in aggregate keeps it
JVM-side and combines it before the shuffle. A sketch is made per (group, part)
- a part being e.g. a day - and the groups' sketches are merged from those, so
parts can be kept and combined later in any order.

``k`` is the size of the largest compactor. The rank error of a single quantile
is below ``RANK_ERROR * (200 / k) ** 0.9021`` of the values at 99 % confidence.

Defined cases: null values and values outside ``least``..``greatest`` are left
out; an item counts once, however often it is delivered; a group without values
has no row; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised rank error of a quantile at k = 200, at 99 % confidence.
RANK_ERROR = 0.0133
#: Size of the top compactor: rank error of about 0.16 %.
K = 2048


def rank_error(k: int = K) -> float:
    return RANK_ERROR * (200 / k) ** 0.9021


def once(df: DataFrame, item: str, group: str, value: str, part: Column) -> DataFrame:
    """``group, part, value`` with one row per item: the one of the earliest part."""
    picked = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("__item")).agg(
        F.min(F.struct(part.alias("part"), F.col(group).alias("grp"), F.col(value).cast("long").alias("val"))).alias("r")
    )
    return picked.select("r.grp", "r.part", "r.val")


def sketches(values: DataFrame, by: list[str], value: str = "val", k: int = K) -> DataFrame:
    """``by..., sketch, n``: one compactor hierarchy per key."""
    return values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_bigint(value, k).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Merges sketches of parts into one per key, level by level."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def quantile(sketch: str, q: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(min(1.0, max(0.0, q))))


def percentiles(sk: DataFrame, by: list[str], qs: list[float], k: int = K) -> DataFrame:
    """``by..., n, q, value, low, high``: estimates with the bounds of the rank error."""
    e = rank_error(k)
    rows = F.array(*[F.struct(F.lit(q).alias("q"), quantile("sketch", q).alias("value"), quantile("sketch", q - e).alias("low"), quantile("sketch", q + e).alias("high")) for q in qs])
    return sk.select(*by, "n", F.explode(rows).alias("r")).select(*by, "n", "r.q", "r.value", "r.low", "r.high")


def median_deviations(values: DataFrame, stated: DataFrame, more_than: float, k: int = K) -> DataFrame:
    """``grp, stated, low, high, median``: groups whose stated median is off by more than ``more_than``.

    ``values`` has grp, part, val; ``stated`` has grp, stated. The merged sketch
    brackets the median at three times its rank error; a verdict that is the same at
    both ends of the bracket stands. Only the groups whose bracket leaves it
    open are settled by exact counting, on the few distinct values inside the
    bracket plus the number below it.
    """
    e = 3 * rank_error(k)
    val = values.where("val is not null")
    sk = merged(sketches(val, ["grp", "part"], k=k), ["grp"], k)
    b = sk.select("grp", "n", quantile("sketch", 0.5 - e).alias("low"), quantile("sketch", 0.5 + e).alias("high")).join(stated.where("stated is not null"), "grp")
    off = lambda c: F.abs(F.col(c).cast("double") - F.col("stated")) > F.lit(more_than)
    # the median lies in low..high; outside the accepted interval on one side is a verdict, inside as well
    sure = (F.col("low") - F.col("stated") > more_than) | (F.col("stated") - F.col("high") > more_than)
    fine = ~off("low") & ~off("high")
    b = b.withColumn("verdict", F.when(sure, F.lit(True)).when(fine, F.lit(False)))
    open_ = b.where("verdict is null").select(F.col("grp").alias("g"), "n", "low", "high")
    inside = val.join(open_, F.col("grp") == F.col("g")).groupBy("grp", "n", F.when(F.col("val") < F.col("low"), F.col("low") - 1).when(F.col("val") > F.col("high"), F.col("high") + 1).otherwise(F.col("val")).alias("val")).agg(F.count(F.lit(1)).alias("c"))
    from pyspark.sql import Window

    w = Window.partitionBy("grp").orderBy("val").rowsBetween(Window.unboundedPreceding, 0)
    at = inside.withColumn("upto", F.sum("c").over(w))
    middle = lambda r: F.min(F.when(F.col("upto") >= r, F.col("val")))
    exact = at.groupBy("grp").agg(((middle(F.floor((F.col("n") + 1) / 2)) + middle(F.floor(F.col("n") / 2) + 1)) / 2).alias("median"))
    out = b.join(exact, "grp", "left").withColumn("verdict", F.coalesce("verdict", F.abs(F.col("median") - F.col("stated")) > more_than))
    return out.where("verdict").select("grp", "stated", "low", "high", "median")
